"""Merkle manifest of a dataset: digest-to-children records, and proofs by descent from the root."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.llm.common import ranked, written

# Levels of the tree whose records lie together in a page; a page has at most 2^DIGITS nodes at its foot.
DIGITS = 10
PERIOD = 7

_STEP = "struct<before:string,after:string>"
_NAMES = T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())])


def hashed(*parts: Column) -> Column:
    """H: lowercase hex sha256 of the parts one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars: Column | None = None) -> Column:
    """The leaf of a row of documents, with ``n_chars`` in place of its own."""
    return hashed(*(_field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") if n_chars is None else n_chars, F.col("text"))))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _height(n: Column) -> Column:
    """Levels above the foot of a page in a tier of ``n`` nodes."""
    return F.when(n > 1 << DIGITS, DIGITS).otherwise(F.length(F.bin(n - 1)) - F.when(n == 1, 1).otherwise(0)).cast("int")


def _strings(values: list[str]) -> pa.Array:
    return pa.array(values, pa.string())


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's root and the records of its inner nodes, lowest level first; columns grp, page, n, height, feet."""
    for batch in batches:
        for i in range(batch.num_rows):
            nodes, digests, children, ends = batch.column(4)[i].values.field("digest").to_pylist(), [], [], [0]
            for _ in range(batch.column(3)[i].as_py()):
                above = []
                for at in range(0, len(nodes), 2):
                    run = nodes[at : at + 2]
                    above.append(_sha("".join(run)))
                    children += run
                    ends.append(len(children))
                digests += above
                nodes = above
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _strings(children))
            records = pa.StructArray.from_arrays([_strings(digests), listed], names=["digest", "children"])
            one = pa.ListArray.from_arrays(pa.array([0, len(digests)], pa.int32()), records)
            yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:3], _strings(nodes), one], names=["grp", "page", "n", "digest", "records"])


@dataclass
class Trees:
    """``tops`` (grp, size, digest): the root of each group's tree; ``store``: digest-to-children records, a table of pages for each tier."""

    tops: DataFrame
    store: list[DataFrame]


def grow(feet: DataFrame) -> Trees:
    """A tree for each ``grp`` over its ``feet`` (grp, rank, n, digest), rank from 0 and n the size of the group.

    Every two consecutive nodes become the hash of both, a last one alone the hash of itself, until one is left.
    A task builds whole pages of 2^DIGITS feet; their roots are the feet of the next tier.
    """
    rows, store, tops = feet.select("grp", "rank", "n", "digest", F.col("n").alias("size")), [], []
    while True:
        cut = rows.groupBy("grp", F.shiftright("rank", DIGITS).alias("page"), "n", "size").agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("feet"))
        # The size of the whole group travels in n, that of the tier follows from the number of tiers.
        made = cut.select("grp", "page", F.struct("n", "size").alias("n"), _height(F.col("n")).alias("height"), "feet")
        spec = "grp string, page long, n struct<n:bigint,size:bigint>, digest string, records array<struct<digest:string,children:array<string>>>"
        pages = written(made.mapInArrow(_pages, spec), f"pages-{len(store)}")
        store.append(pages.groupBy("digest").agg(F.first("records").alias("records")))
        tops.append(pages.filter(f"n.n <= {1 << DIGITS}").select("grp", F.col("n.size").alias("size"), "digest"))
        rows = pages.filter(f"n.n > {1 << DIGITS}").select("grp", F.col("page").alias("rank"), F.shiftright(F.col("n.n") + ((1 << DIGITS) - 1), DIGITS).alias("n"), "digest", F.col("n.size").alias("size"))
        if rows.isEmpty():
            return Trees(reduce(DataFrame.unionByName, tops), store)


def _descend(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From a page's root down to each wanted foot by the digits of its rank; columns height, digest, path, records, wants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                height, top = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                above = [(s["before"], s["after"]) for s in batch.column(2)[i].as_py()]
                records = batch.column(3)[i].values
                children_of = dict(zip(records.field("digest").to_pylist(), records.field("children").to_pylist(), strict=True))
                wants = batch.column(4)[i].values
                found, before, after, ends = [], [], [], [0]
                for rank in wants.field("rank").to_pylist():
                    node, path = top, list(above)
                    for level in range(height - 1, -1, -1):
                        children = children_of[node]
                        pick = rank >> level & 1
                        path.append(("".join(children[:pick]), "".join(children[pick + 1 :])))
                        node = children[pick]
                    found.append(node)
                    before += [b for b, _ in path]
                    after += [a for _, a in path]
                    ends.append(len(before))
                steps = pa.StructArray.from_arrays([_strings(before), _strings(after)], names=["before", "after"])
                paths = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)
                yield pa.RecordBatch.from_arrays([*(wants.field(n) for n in names), _strings(found), paths], names=[*names, "digest", "path"])

    return run


def descend(trees: Trees, heads: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (grp, rank, n, further columns) with ``digest``, the foot found there, and ``path``, what was not taken on the way, root first.

    ``heads`` (grp, digest, path): where each group starts, and the path that leads there.  A step holds the digests before
    and after the node taken.  Requests that share a page go down to it once: tier by tier the
    pages on the way are requested, and met with their records by digest.
    """
    reached: DataFrame | None = None
    for tier in range(len(trees.store) - 1, -1, -1):
        low, high = 1 << DIGITS * tier, 1 << DIGITS * (tier + 1)
        at = wanted.filter(F.col("n") > low) if tier else wanted
        size = F.shiftright(F.col("n") + (low - 1), DIGITS * tier)
        here = at.select("grp", F.shiftright("rank", DIGITS * tier).alias("rank"), size.alias("_n"), "n", *([c for c in wanted.columns if c not in ("grp", "rank", "n")] if not tier else []))
        here = here.distinct() if tier else here
        names = [c for c in here.columns if c != "_n"]
        pages = here.groupBy("grp", F.shiftright("rank", DIGITS).alias("page"), "_n", (F.col("n") <= high).alias("top")).agg(F.collect_list(F.struct(*names)).alias("wants"))
        starts = heads.select(F.col("grp").alias("_grp"), F.lit(0).cast("long").alias("_page"), F.lit(True).alias("_top"), "digest", "path")
        if reached is not None:
            starts = starts.unionByName(reached.select(F.col("grp").alias("_grp"), F.col("rank").alias("_page"), F.lit(False).alias("_top"), "digest", "path"))
        placed = pages.join(starts, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("page") == F.col("_page")) & (F.col("top") == F.col("_top")))
        met = placed.join(trees.store[tier], "digest").select(_height(F.col("_n")).alias("height"), "digest", "path", "records", "wants")
        fields = here.select(*names).schema.fields
        spec = T.StructType([*fields, T.StructField("digest", T.StringType()), T.StructField("path", T.ArrayType(_NAMES))])
        reached = met.mapInArrow(_descend(names), spec)
        if tier:
            reached = written(reached, f"reached-{tier}")
    return reached


def siblings_digest(path: Column) -> Column:
    """H of the siblings on a path, the lowest level first, left to right."""
    return F.sha2(F.array_join(F.transform(F.reverse(path), lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(F.reverse(path), start, lambda node, s: hashed(s["before"], node, s["after"]))


def manifest(docs: DataFrame) -> tuple[DataFrame, Trees, DataFrame, Trees]:
    """``leaves`` (grp, rank, n, doc_id, leaf, forged), a tree for each lang, their ``roots`` (rank, n, lang, subroot) in the order of lang, and the tree over those.

    ``grp`` is the lang; null is a group of its own, the first.  ``forged`` is the leaf after tampering, which adds 1 to ``n_chars``; null where it changes nothing.
    """
    fields = docs.select("doc_id", "source", "lang", "n_chars", "text")
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % PERIOD == 0) & F.col("n_chars").isNotNull()
    one_more = F.col("n_chars").cast("decimal(20,0)") + 1
    rows = fields.select(F.col("lang").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("leaf"), F.when(tampered, leaf(one_more)).alias("forged"))
    # Equal rows are told apart by the place they were written at, so that they spread over ranges.
    kept = written(rows.withColumn("place", F.monotonically_increasing_id()), "leaves")
    leaves = written(ranked(kept, ["grp"], ["doc_id", "leaf", "place"], "ordered").drop("place"), "ranked")
    trees = grow(leaves.select("grp", "rank", "n", F.col("leaf").alias("digest")))
    subroots = trees.tops.select(F.col("grp").alias("lang"), F.col("digest").alias("subroot"))
    roots = written(ranked(subroots, [], ["lang"], "subroots").withColumn("grp", F.lit(None).cast("string")), "roots")
    return leaves, trees, roots, grow(roots.select("grp", "rank", "n", F.col("subroot").alias("digest")))


def verified(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of ``docs`` (doc_id, source, lang, n_chars, text).

    Every leaf's proof is found by descent from the root; ``folded_root`` is what the tampered leaf (else the
    original one) gives with the original siblings.  Null fields count as ``-``; a null doc_id sorts first and is not tampered with; rows
    repeated under one doc_id are leaves of their own, by leaf digest; long texts are hashed whole; further columns are ignored; an empty table gives no rows.
    """
    leaves, trees, roots, top = manifest(docs)
    # The root of all is one digest.
    root = top.tops.first()
    start = top.tops.select("grp", "digest", F.array().cast(f"array<{_STEP}>").alias("path"))
    heads = written(descend(top, start, roots).select(F.col("lang").alias("grp"), "digest", "path"), "heads")
    subroots = roots.select(F.col("lang").alias("_grp"), "subroot")
    found = descend(trees, heads, leaves).join(subroots, F.col("grp").eqNullSafe(F.col("_grp")))
    folded = found.select("*", F.lit(root and root["digest"]).cast("string").alias("root"), fold(F.coalesce("forged", "leaf"), F.col("path")).alias("folded_root"))
    return folded.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def crc32_sql(value: str) -> str:
    """Unsigned crc32 of a number's decimal digits, in DuckDB's SQL."""
    code = f"list_transform(string_split(cast({value} AS VARCHAR), ''), lambda c: cast(ascii(c) AS BIGINT))"
    shifted = "list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, zero: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295, {code}), lambda crc, byte: {shifted}), 4294967295)"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(cast({c} AS VARCHAR)) || ':' || cast({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _tree_sql(feet: str) -> str:
    return f"{feet} UNION ALL SELECT grp, lv + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM {{}} WHERE n > 1 GROUP BY grp, lv, pos // 2, n"


def _steps_sql(tree: str, feet: str) -> str:
    return f"""SELECT f.grp, f.pos, v.lv, CASE WHEN (f.pos >> v.lv) % 2 = 1 THEN s.digest ELSE '' END AS b, CASE WHEN (f.pos >> v.lv) % 2 = 0 THEN coalesce(s.digest, '') ELSE '' END AS a
      FROM {feet} f JOIN (SELECT DISTINCT grp, lv FROM {tree} WHERE n > 1) v ON v.grp IS NOT DISTINCT FROM f.grp
      LEFT JOIN {tree} s ON s.grp IS NOT DISTINCT FROM f.grp AND s.lv = v.lv AND s.pos = xor(f.pos >> v.lv, 1)"""


ORACLE = f"""
WITH RECURSIVE l AS (SELECT *, lang AS grp, {_leaf_sql("n_chars")} AS leaf, CASE WHEN {crc32_sql("doc_id")} % {PERIOD} = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS forged FROM documents),
p AS (SELECT grp, doc_id, leaf, coalesce(CASE WHEN n_chars IS NOT NULL THEN forged END, leaf) AS told,
      row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM l),
t(grp, lv, pos, n, digest) AS ({_tree_sql("SELECT grp, 0, pos, n, leaf FROM p").format("t")}),
r AS (SELECT NULL AS grp, grp AS lang, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, digest FROM t WHERE n = 1),
u(grp, lv, pos, n, digest) AS ({_tree_sql("SELECT grp, 0, pos, n, digest FROM r").format("u")}),
lower_steps AS ({_steps_sql("t", "p")}), upper_steps AS ({_steps_sql("u", "r")}),
steps AS (SELECT grp, pos, 0 AS tree, lv, b, a FROM lower_steps
          UNION ALL SELECT p.grp, p.pos, 1, s.lv, s.b, s.a FROM p JOIN r ON r.lang IS NOT DISTINCT FROM p.grp JOIN upper_steps s ON s.pos = r.pos),
paths AS (SELECT grp, pos, list({{'b': b, 'a': a}} ORDER BY tree, lv) AS path FROM steps GROUP BY grp, pos),
o AS (SELECT p.*, r.digest AS subroot, (SELECT digest FROM u WHERE n = 1) AS root, coalesce(path, []) AS path
      FROM p JOIN r ON r.lang IS NOT DISTINCT FROM p.grp LEFT JOIN paths q ON q.grp IS NOT DISTINCT FROM p.grp AND q.pos = p.pos),
f AS (SELECT *, list_reduce(list_prepend({{'b': told, 'a': ''}}, path), lambda x, s: {{'b': sha256(s.b || x.b || s.a), 'a': ''}}).b AS folded_root FROM o)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda s: s.b || s.a), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""
