"""Language identification by cross-parsing entropy with suffix automata."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.llm.common import tidy, unused, worker_model

# The bounded sample of labelled rows a language is learned from: so many rows at most, whole texts, of so many characters together (but one row at least).
SAMPLE_ROWS, SAMPLE_CHARS = 48, 32_768
# Rows looked at for it, and groups of hashes in which they are ranked first.
LOOKED_AT, GROUPS = 256, 64
# Texts are parsed in blocks of this many symbols side by side; where a block's first phrase starts is guessed by a parse from a little ahead of it, and checked.
BLOCK, AHEAD = 384, 48
# So few phrases under way at the ends of their blocks, and so few blocks, are not worth a step side by side.
FEW, MANY = 48, 200
UNKNOWN = "und"
# Symbols: 0 ends a text, 1 is any run of characters that are not letters, 2 a letter no sample has; then the samples' letters, frequent ones first.
FILL, GAP, OTHER, FIRST_LETTER = 0, 1, 2, 3
# Moves by symbols below this are a full table; those by further letters, as in Chinese samples, a sorted list.
DENSE = 256


def held_out() -> Column:
    """Whether a document is kept from learning: ``crc32`` of the doc_id's text leaves 1 modulo 3."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def learn(docs: DataFrame) -> list[tuple[str, str]]:
    """``(lang, sample text)`` by language, from labelled rows that are not held out.

    A language's distinct texts are taken whole, in the order of their hashes, at most ``SAMPLE_ROWS`` of them and as
    long as they fit in ``SAMPLE_CHARS`` together; one that does not fit is passed over, but the shortest of those looked at is taken
    where none fits.  This bounded sample is all that reaches the driver.
    """
    rows = docs.filter(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    # First inside groups of hashes, so that no language meets in one task with all of its rows.
    grouped = rows.select("lang", "h", F.length("text").alias("n")).distinct().withColumn("g", F.pmod("h", F.lit(GROUPS)))
    first = lambda df, *keys: df.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "n"))).filter(F.col("r") <= LOOKED_AT).drop("r")
    listed: dict[str, list[tuple[int, int]]] = {}
    for r in first(first(grouped, "lang", "g"), "lang").orderBy("lang", "h", "n").collect():
        listed.setdefault(r.lang, []).append((r.h, r.n))
    chosen: list[tuple[str, int]] = []
    for lang, texts in listed.items():
        left, taken = SAMPLE_CHARS, []
        for h, n in texts:
            if n <= left and len(taken) < SAMPLE_ROWS:
                taken.append((lang, h))
                left -= n
        chosen += taken or [(lang, min(texts, key=lambda t: (t[1], t[0]))[0])]
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame(chosen, "lang string, h long")
    picked = rows.join(F.broadcast(wanted), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    samples: dict[str, list[str]] = {}
    for lang, _, text in sorted(picked.collect()):
        samples.setdefault(lang, []).append(text)
    return [(lang, "\n".join(texts)) for lang, texts in samples.items()]


class Automaton(NamedTuple):
    """Moves of a suffix automaton; state 1 is the start, 0 means no transition."""

    table: np.ndarray
    # state * width + symbol of the moves by symbols from DENSE on, in order, and their targets
    width: int
    keys: np.ndarray
    targets: np.ndarray

    def move(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        dense = self.table.shape[1]
        there = np.take(self.table, state * dense + (symbol if self.width <= dense else np.minimum(symbol, dense - 1)))
        if len(self.keys) and (rare := symbol >= dense).any():
            key = state[rare] * self.width + symbol[rare]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there[rare] = np.where(self.keys[at] == key, self.targets[at], 0)
        elif self.width > dense:
            there[symbol >= dense] = 0
        return there


    def follow(self, state: int, symbols: np.ndarray) -> int:
        """How many of ``symbols``, of which one ends the match, continue it."""
        n = 0
        for at in range(0, len(symbols), 4096):
            for c in symbols[at : at + 4096].tolist():
                state = self.step(state, c)
                if not state:
                    return n
                n += 1
        return n

    def step(self, state: int, symbol: int) -> int:
        """``move`` of one."""
        if symbol < self.table.shape[1]:
            return self.table.item(state, symbol)
        return int(self.move(np.array([state]), np.array([symbol]))[0])


def automaton(symbols: list[int], width: int) -> Automaton:
    """The suffix automaton of ``symbols``, which are below ``width``."""
    moves: list[dict[int, int]] = [{}, {}]
    length, link, last = [0, 0], [0, 0], 1
    for c in symbols:
        now = len(length)
        length.append(length[last] + 1)
        link.append(1)
        moves.append({})
        p = last
        while p and c not in moves[p]:
            moves[p][c] = now
            p = link[p]
        if p:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(length)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    table = np.zeros((len(moves), min(width, DENSE)), np.int32)
    rare = []
    for state, out in enumerate(moves):
        for c, to in out.items():
            if c < DENSE:
                table[state, c] = to
            else:
                rare.append((state * width + c, to))
    rare.sort()
    return Automaton(table, width, np.array([k for k, _ in rare], np.int64), np.array([t for _, t in rare], np.int32))


def _symbols(text: str, table: np.ndarray) -> np.ndarray:
    """Lower-cased letters as symbols, each run of other characters as one gap; none at the start."""
    out = table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = out == GAP
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    return out[keep]


def _model(samples: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, list[Automaton], np.ndarray]:
    """The symbol of each code point, an automaton for each sample, and the bits that naming a place in a sample takes; built once in a worker."""
    counts: dict[str, int] = {}
    for _, text in samples:
        for c in text.lower():
            if c.isalpha():
                counts[c] = counts.get(c, 0) + 1
    letters = sorted(counts, key=lambda c: (-counts[c], c))
    table = np.array([OTHER if chr(i).isalpha() else GAP for i in range(0x110000)], np.uint8 if FIRST_LETTER + len(letters) <= 256 else np.int32)
    for k, c in enumerate(letters):
        table[ord(c)] = FIRST_LETTER + k
    width = FIRST_LETTER + len(letters)
    parsed = [_symbols(text, table) for _, text in samples]
    return table, [automaton(p.tolist(), width) for p in parsed], np.log2([len(p) + 1 for p in parsed] or [1])


def _parse(flat: np.ndarray, again: np.ndarray, moves: Automaton, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest-match phrases from each place of ``start`` in the symbols ``flat``: how many start before ``end``, and where the first one after them starts.

    Places are parsed side by side, a symbol a step, the longest first, so that those at work are always the first ones.
    ``again`` is for each place of ``flat`` the state that a phrase started there is in, 1 where none can start.
    """
    order = np.argsort(start - end, kind="stable")
    first, length = start[order], np.maximum(end - start, 0)[order]
    state, count = np.ones(len(order), np.int64), np.zeros(len(order), np.int64)
    working = np.searchsorted(-length, -np.arange(length[0] if len(order) else 0), "left").tolist()
    for t, k in enumerate(working):
        place, now = first[:k] + t, state[:k]
        there = moves.move(now, flat[place])
        miss = there == 0
        new = again[place]
        # A phrase ends before a symbol that does not continue it; a symbol that no phrase can start with is one by itself.
        count[:k] += miss & (now > 1)
        count[:k] += miss & (new == 1)
        state[:k] = np.where(miss, new, there)
    # Phrases under way go on to their ends.
    at, lane = first + length, np.flatnonzero(state > 1)
    while len(lane) > FEW:
        there = moves.move(state[lane], flat[at[lane]])
        miss = there == 0
        count[lane[miss]] += 1
        lane = lane[~miss]
        state[lane] = there[~miss]
        at[lane] += 1
    # A few that go on for long, as where a text is in the sample, are followed one by one.
    for i in lane.tolist():
        at[i] += moves.follow(int(state[i]), flat[at[i] :])
        count[i] += 1
    counts, out = np.empty_like(count), np.empty_like(at)
    counts[order], out[order] = count, at
    return counts, out


def _parse_one(flat: np.ndarray, again: np.ndarray, moves: Automaton, start: int, end: int) -> tuple[int, int]:
    """``_parse`` from one place."""
    state, count, step = 1, 0, moves.step
    for symbol, new in zip(flat[start:end].tolist(), again[start:end].tolist(), strict=True):
        there = step(state, symbol)
        if not there:
            count += (state > 1) + (new == 1)
            there = new
        state = there
    place = max(start, end)
    if state > 1:
        count += 1
        place += moves.follow(state, flat[place:])
    return count, place


def phrases(texts: list[np.ndarray], moves: Automaton) -> np.ndarray:
    """How many longest-match phrases each text (an array of symbols) needs.

    Blocks of all texts are parsed side by side, each from where a parse that began a little ahead of it comes in.  Where the
    block before then ends elsewhere, the block is parsed again from there, until all fit together: what comes
    out is the parse of the whole text from its start.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.concatenate([x for t in texts for x in (t, np.full(1, FILL, t.dtype))]) if len(texts) else np.zeros(1, np.uint8)
    base = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    blocks = np.maximum(-(-sizes // BLOCK), 1)
    owner = np.repeat(np.arange(len(texts)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = base[owner] + nth * BLOCK
    end = np.minimum(begin + BLOCK, base[owner] + sizes[owner])
    again = np.maximum(moves.move(np.ones(len(flat), np.int64), flat), 1)
    entry = begin.copy()
    later = np.flatnonzero(nth > 0)
    entry[later] = _parse(flat, again, moves, begin[later] - AHEAD, begin[later])[1]
    count, out = _parse(flat, again, moves, entry, end)
    while len(wrong := later[out[later - 1] != entry[later]]):
        entry[wrong] = out[wrong - 1]
        if len(wrong) > MANY:
            count[wrong], out[wrong] = _parse(flat, again, moves, entry[wrong], end[wrong])
        else:
            for i in wrong.tolist():
                count[i], out[i] = _parse_one(flat, again, moves, int(entry[i]), int(end[i]))
    return np.bincount(owner, count, len(texts)).astype(np.int64)


def lettered(docs: DataFrame) -> DataFrame:
    """The rows whose text holds a letter, by the test that ``identify`` uses."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [any(c.isalpha() for c in (text.as_py() or "").lower()) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays(batch.columns[1:], names=names).filter(pa.array(kept, pa.bool_()))

    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.select(F.col("text").cast("string").alias(unused(docs, "_text")), *names).mapInArrow(run, spec)


def identify(docs: DataFrame, samples: list[tuple[str, str]], keep: tuple[str, ...] = ("doc_id",), added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of each row of ``docs`` (doc_id long, text string), and ``lang_pred, score`` (or the names in ``added``), from whole texts.

    The language that parses the text into the fewest phrases wins, each phrase counted with the bits that name a place
    in the language's sample, so that a short sample is no handicap; of equal ones the first by name.  ``score`` is one minus the ratio of its bits to the second
    language's: 0 for a tie, 1 where only one language is known.  Null texts, texts without a letter, and
    all texts where nothing was learned, are ``und`` with score 0.  Each row is judged by its text alone, so
    repeated rows and rows without doc_id get theirs as any other.
    """
    model = docs.sparkSession.sparkContext.broadcast(tuple(samples))
    names = [lang for lang, _ in samples]
    fields = [*keep, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, automata, cost = worker_model("langid", model.value, lambda: _model(model.value))

        def judge(part: pa.RecordBatch, rows: list[np.ndarray]) -> pa.RecordBatch:
            known = np.array([(r != GAP).any() for r in rows], bool) & bool(names)
            langs, score = [UNKNOWN] * len(rows), np.zeros(len(rows))
            if known.any():
                total = np.stack([phrases(rows, a) * c for a, c in zip(automata, cost, strict=True)])
                second = np.partition(total, 1, 0)[1] if len(names) > 1 else np.full(len(rows), np.inf)
                score = np.where(known, 1 - total.min(0) / np.maximum(second, 1e-9), 0.0)
                langs = [names[b] if k else UNKNOWN for b, k in zip(total.argmin(0), known, strict=True)]
            return pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(langs, pa.string()), pa.array(score)], names=fields)

        for batch in batches:
            rows, first, size = [], 0, 0
            for i, text in enumerate(batch.column(0)):
                rows.append(_symbols(text.as_py() or "", table))
                size += len(rows[-1])
                if size > 1 << 21 or i + 1 == batch.num_rows:
                    yield judge(batch.slice(first, len(rows)), rows)
                    rows, first, size = [], i + 1, 0
        tidy("langid")

    kept = docs.select(*keep)
    spec = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    return docs.select(F.col("text").cast("string").alias(unused(docs, "_text")), *keep).mapInArrow(run, f"{spec}`{added[0]}` string, `{added[1]}` double")
