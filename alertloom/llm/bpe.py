"""Byte-level BPE: encoding by a segment tree of pair ranks, and decoding."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import tidy, worker_model

# Distinct pieces of a generation whose ids a worker remembers, and the longest of them; only a saving of time.
REMEMBERED, REMEMBERED_CHARS = 200_000, 48
# Children of a node of the segment tree.
FAN = 16


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: always the pair of lowest rank is joined, of equal ones the leftmost.

    A leaf of the tree stands for the token that starts at a byte and holds the rank
    of the token together with its right neighbour, and its place; a node holds the
    smallest of its sixteen children, so the top is the next pair.  A merge
    clears one leaf and changes two, and the nodes above them: logarithmic in the bytes.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    none = (len(ranks) + 1) * n
    leaves = [none] * n
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            leaves[i] = rank * n + i
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([min(below[at : at + FAN]) for at in range(0, len(below), FAN)])
    top, flat = levels[-1], len(levels) == 2
    # Where the token at a byte ends, and where the one that ends at a byte starts.
    ends, starts = list(range(1, n + 1)), list(range(-1, n))
    while top[0] < none:
        i = top[0] % n
        j = ends[i]
        end = ends[i] = ends[j]
        starts[end] = i
        leaves[j] = none
        rank = get(piece[i : ends[end]]) if end < n else None
        leaves[i] = none if rank is None else rank * n + i
        k = starts[i] if i else i
        if i:
            rank = get(piece[k:end])
            leaves[k] = none if rank is None else rank * n + k
        if flat:
            top[0] = min(leaves)
            continue
        changed = {i // FAN, j // FAN, k // FAN}
        for below, level in zip(levels, levels[1:], strict=False):
            for at in changed:
                level[at] = min(below[at * FAN : at * FAN + FAN])
            changed = {at // FAN for at in changed}
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class Memory(dict):
    """Packed ids of the pieces met before, in two generations: a full young one becomes the old one, so frequent pieces stay."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.old = ranks, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("i", merge(piece.encode(), self.ranks)).tobytes()
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of base64 bytes and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def _memory(data: bytes) -> Memory:
    return worker_model("bpe", hash(data), lambda: Memory(read_ranks(data)))


def _tokens(data: bytes) -> pa.Array:
    ranks = read_ranks(data)
    return pa.array(sorted(ranks, key=ranks.get), pa.binary())


def _decoded(ids: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """The bytes of each list of ids."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens.take(ids.flatten())), b"")


def encode_text(text: str, memory: Memory, pieces: regex.Pattern) -> np.ndarray:
    return np.frombuffer(b"".join(map(memory.__getitem__, pieces.findall(text))), np.int32)


def load(docs: DataFrame, path: str) -> Broadcast:
    """The rank file at ``path``, sent to the executors (a vocabulary: fixed size)."""
    with open(path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """``doc_id, ids`` for each row of ``docs`` (doc_id long, text string), without special tokens; null and empty texts have no ids.

    Whole texts are encoded, each match of ``pattern`` by itself.  Other columns are ignored; repeated rows give repeated results.
    ``decoded`` adds ``bytes``, decoded from the ids as ``decode`` does, in the same pass.
    """
    file = load(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # White space and letters are those of Unicode, as in the library's own splitter.
        memory, pieces = _memory(file.value), regex.compile(pattern)
        tokens = _tokens(file.value) if decoded else None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [encode_text(t or "", memory, pieces) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *(len(r) for r in rows)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows)))
                more = [_decoded(ids, tokens)] if decoded else []
                yield pa.RecordBatch.from_arrays([part.column(0), ids, *more], names=["doc_id", "ids", "bytes"][: 2 + len(more)])
        tidy("bpe")

    spec = "doc_id long, ids array<int>" + ", bytes binary" * decoded
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, spec)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, bytes`` of rows ``doc_id, ids``: the ids' bytes joined; null ids give no bytes."""
    file = load(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(file.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(part.column(1), tokens)], names=["doc_id", "ids", "bytes"])
        tidy("bpe")

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, bytes binary")
