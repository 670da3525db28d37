"""Prefix trie of conversations: intervals of sorted conversations by range minima over their common prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import ranked, written
from alertloom.llm.merkle import crc32_sql

# Sorted conversations of a block; the neighbours on both sides come with it.
BITS = 12
FAMILY, HEADS = 20, 4
_WORD = r"[^\x20\x09-\x0D]+"

NODES = (
    "block long, key string, parent_key string, open boolean, depth long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, ends_sha256 string"
)
_NO_END = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: for each conversation its turns in order, as digest of role and text and number of words of the text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = F.md5(F.concat(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")).cast("binary"))
    words = F.regexp_count(text("text"), F.lit(_WORD)).cast("long")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", said.alias("said"), words.alias("words")).filter("conv_id IS NOT NULL")
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "said", "words"))).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda t: F.struct(t["said"], t["words"])).alias("turns"))


def head_length(conv_id: Column) -> Column:
    """How many turns a conversation takes over from the first one of its family."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def rebuilt(listed: DataFrame) -> DataFrame:
    """``turns`` of each conversation with its first few replaced by those of the first one of its family of 20."""
    first = listed.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("_first"), F.slice("turns", 1, HEADS - 1).alias("_head"))
    joined = listed.join(first, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("_first"), "left")
    h = head_length(F.col("conv_id"))
    none = F.slice("turns", 1, 0)
    made = F.concat(F.slice(F.coalesce("_head", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))
    return joined.select("conv_id", made.alias("turns"))


class RangeMinimum:
    """Sparse table of the minima of ``values`` over every run of a power of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while (half := 1 << (len(self.levels) - 1)) * 2 <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The minimum of each ``values[first .. last]``."""
        size = np.frexp((last - first + 1).astype(float))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(size):
            at = size == k
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] - (1 << int(k)) + 1])
        return out

    def right(self, start: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The last place so that all values after ``start`` up to it are ``floor`` or more."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            fits = at + (1 << k) < len(self.levels[0])
            fits[fits] = level[at[fits] + 1] >= floor[fits]
            at[fits] += 1 << k
        return at

    def left(self, start: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The first place so that all values after it up to ``start`` are ``floor`` or more."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            fits = at - (1 << k) >= 0
            fits[fits] = self.levels[k][at[fits] - (1 << k) + 1] >= floor[fits]
            at[fits] -= 1 << k
        return at


def common(a: list[str], b: list[str]) -> int:
    """The number of turns two conversations have in common from the start."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _prefix_keys(said: list[str], most: int) -> list[str]:
    """Digests of the first 0, 1, ... ``most`` turns."""
    digest, out = hashlib.md5(), []
    for d in range(most + 1):
        out.append(digest.hexdigest())
        if d < most:
            digest.update(said[d].encode())
    return out


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each block; columns block, rows (rank, conv_id, turns, own), of which the neighbours of the block are not its own."""
    for batch in batches:
        for i in range(batch.num_rows):
            block, rows = batch.column(0)[i].as_py(), batch.column(1)[i].values
            ids = rows.field("conv_id").to_numpy()
            lists = rows.field("turns")
            offsets, inner = lists.offsets.to_numpy(), lists.values
            said, words = inner.field("said"), inner.field("words").to_numpy()
            seqs = [said.slice(a, b - a).to_pylist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            lcp = np.array([-1, *(common(a, b) for a, b in zip(seqs, seqs[1:], strict=False))], np.int64)
            own = np.flatnonzero(rows.field("own").to_numpy(zero_copy_only=False))
            lo, hi = own[0], own[-1] + 1
            # What the block shares with the conversation before it and with the one after.
            before, after = int(lcp[lo]), int(lcp[hi]) if hi < len(seqs) else -1
            seqs, ids, offsets, lcp = seqs[lo:hi], ids[lo:hi], offsets[lo : hi + 1], lcp[lo:hi].copy()
            lens = np.diff(offsets)
            lcp[0] = -1
            # A candidate for each prefix a conversation does not share with the one before it: by conversation, then depth, which is the order of the trie.
            count = lens - lcp
            conv = np.repeat(np.arange(len(seqs)), count)
            place = np.concatenate([[0], np.cumsum(count)])
            depth = np.arange(len(conv)) - place[conv] + lcp[conv] + 1
            table = RangeMinimum(lcp)
            left, right = table.left(conv, depth), table.right(conv, depth)
            opens, opened = (left == 0) & (depth <= before), (right == len(seqs) - 1) & (depth <= after)
            members = right - left + 1
            least = RangeMinimum(ids).least(left, right)
            cost = np.where(depth > 0, words[np.minimum(offsets[conv] + depth - 1, len(words) - 1)] if len(words) else 0, 0)
            saved = cost * (members - ~opens)
            # A node's last block knows whether any member goes on.
            leaf = ((lens[right] == depth) & ~opened).astype(np.int64)
            starts = (~opens).astype(np.int64)
            # The parent's interval starts where the conversations that share one turn less do.
            up = np.maximum(depth - 1, 0)
            parent_at = table.left(conv, up)
            parent = place[parent_at] + up - (lcp[parent_at] + 1)
            children = np.bincount(parent[depth > 0], starts[depth > 0], len(conv)).astype(np.int64)
            end = place[right + 1]
            summed = lambda x: np.concatenate([[0], np.cumsum(x)])
            subtree = lambda x: summed(x)[end] - summed(x)[np.arange(len(conv))]
            # Members that end at a node are the first ones of its interval.
            stop = np.full(len(conv), -1)
            full = lens[conv] == depth
            same = np.append((lcp[1:] == lens[1:]) & (lens[1:] == lens[:-1]), False)
            breaks = np.flatnonzero(~same)
            stop[full] = breaks[np.searchsorted(breaks, conv[full])]
            open_ = opens | opened
            ended = [",".join(map(str, ids[c : s + 1])) if s >= 0 else "" for c, s in zip(conv, stop, strict=True)]
            keys_first, keys_last = _prefix_keys(seqs[0], max(before, 0)), _prefix_keys(seqs[-1], max(after, 0))

            def key(at: int) -> str | None:
                if not open_[at]:  # noqa: B023
                    return None
                return keys_first[depth[at]] if opens[at] else keys_last[depth[at]]  # noqa: B023

            keys = [key(at) for at in range(len(conv))]
            top = depth == 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(conv), block)), pa.array(keys, pa.string()), pa.array([None if t else keys[p] for t, p in zip(top, parent, strict=True)], pa.string()),
                    pa.array(open_), pa.array(depth), pa.array(least), pa.array(least[parent], mask=top),
                    pa.array(members), pa.array(children), pa.array(subtree(leaf)), pa.array(subtree(saved)),
                    pa.array([e if o else None for e, o in zip(ended, open_, strict=True)], pa.string()),
                    pa.array([None if o else hashlib.sha256(e.encode()).hexdigest() for e, o in zip(ended, open_, strict=True)], pa.string()),
                ],
                names=[f.split()[0] for f in NODES.split(", ")],
            )


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest of the comma-joined ``ends`` of each key, which come in order; only the running digest is kept."""
    key, digest, some = None, None, False
    for batch in batches:
        out = []
        for k, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest, some = k, hashlib.sha256(), False
            digest.update((("," if some else "") + ends).encode())
            some = True
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([d for _, d in out], pa.string())], names=["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])


def prefix_trie(listed: DataFrame) -> DataFrame:
    """The nodes of the trie over ``listed`` (conv_id long, unique; turns array of said, words): ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Conversations are sorted by their turns and cut into blocks of 4096, whatever prefix they share.  In a block each prefix
    finds its members as the interval in which neighbours have so many turns in common, by binary search to the
    left and to the right in a sparse table of minima; sums over subtrees are differences of running sums.  Prefixes
    shared over the edge of a block have a part in each block; parts are added up by a digest of the prefix, a few for each edge.
    A task holds the digests of a block's turns: 4096 conversations, however long.
    """
    rows = listed.select("conv_id", "turns", F.col("turns.said").alias("said"))
    sorted_rows = ranked(rows, [], ["said", "conv_id"], "sorted").select("rank", "n", "conv_id", "turns")
    block, at = F.shiftright("rank", BITS), F.col("rank").bitwiseAND(F.lit((1 << BITS) - 1))
    last = (at == (1 << BITS) - 1) & (F.col("rank") + 1 < F.col("n"))
    into = F.concat(F.array(block), F.when((at == 0) & (F.col("rank") > 0), F.array(block - 1)).otherwise(F.array().cast("array<bigint>")), F.when(last, F.array(block + 1)).otherwise(F.array().cast("array<bigint>")))
    dealt = sorted_rows.withColumn("block", F.explode(into)).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("rank", "conv_id", "turns", (block == F.col("block")).alias("own")))).alias("rows"))
    nodes = written(dealt.mapInArrow(_nodes, NODES), "nodes")

    parts = nodes.filter("open")
    sums = parts.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    )
    # The decimal ids of thousands of members are one row; the running digest passes over the rows of a key.
    told = parts.filter("ends <> ''").select("key", "ends", "block").repartition("key").sortWithinPartitions("key", "block").select("key", "ends")
    ends = told.mapInArrow(_ends, "key string, ends_sha256 string")
    shared = written(sums.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_END))), "shared")
    named = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = shared.join(named, "parent_key", "left").select(*columns)
    # Nodes in one block under a parent in several: parents are looked up by block, so that no prefix draws all its children to one task.
    known = parts.select("block", F.col("key").alias("parent_key")).join(named, "parent_key").withColumnRenamed("parent_conv_id", "_parent")
    inner = nodes.filter("NOT open").join(known, ["block", "parent_key"], "left").withColumn("parent_conv_id", F.coalesce("_parent", "parent_conv_id"))
    return inner.select(*columns).unionByName(whole)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of the rebuilt ``conversations`` (conv_id, turn, role, text; further columns are ignored).

    Turns are ordered by turn (null first), those of equal turn by the md5 of role and text; null role or text
    is empty, long texts are read whole; rows without conv_id take no part.  An empty table gives no rows.
    """
    return prefix_trie(written(rebuilt(turns(conversations)), "rebuilt"))


_STRUCT = "{'r': coalesce(role, ''), 't': coalesce(text, '')}"
ORACLE = rf"""
WITH g AS (SELECT conv_id, list({_STRUCT} ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, {crc32_sql("conv_id")} % {HEADS} AS h FROM g),
c AS (SELECT h.conv_id, list_concat(coalesce(b.t, [])[1:h.h], h.t[h.h + 1:]) AS t FROM h LEFT JOIN g b ON b.conv_id = h.conv_id - h.conv_id % {FAMILY}),
m AS (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS depth FROM c),
n AS (SELECT t[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN len(t) = depth THEN cast(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends,
      CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(any_value(t[depth].t), '{_WORD}')) END AS saved FROM m GROUP BY p, depth),
x AS (SELECT *, p[1:depth - 1] AS up FROM n),
k AS (SELECT up, depth - 1 AS depth, count(*) AS n_children FROM x WHERE depth > 0 GROUP BY ALL),
y AS (SELECT x.*, coalesce(k.n_children, 0) AS n_children FROM x LEFT JOIN k ON k.up = x.p AND k.depth = x.depth),
z AS (SELECT p[1:d] AS p, d AS depth, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
      FROM (SELECT p, saved, n_children, unnest(range(0, depth + 1)) AS d FROM y) GROUP BY 1, 2)
SELECT y.conv_id, y.depth, u.conv_id AS parent_conv_id, y.n_convs, y.n_children, z.n_leaves, cast(z.saved_tokens AS BIGINT) AS saved_tokens, sha256(y.ends) AS ends_sha256
FROM y JOIN z ON z.p = y.p AND z.depth = y.depth LEFT JOIN n u ON y.depth > 0 AND u.p = y.up AND u.depth = y.depth - 1
"""
