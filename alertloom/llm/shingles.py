"""Words and word shingles of texts as 64-bit hashes, block by block on Arrow buffers.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased.  A set holds the
distinct five-word shingles; a text with one to four words has its whole sequence
as one shingle; a text without words, and null, has the empty set.  The work is
done in blocks of about half a megabyte, a longer text in pieces cut between
words, so memory does not grow with the texts of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
BLOCK = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, *range(9, 14)]] = False
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_powers = {b: np.ones(1, np.uint64) for b in (_BASE, _BACK)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        steps = np.full(max(n, BLOCK + 4096), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """``first row, row after the last, first byte, byte after the last``; a long row comes in several pieces."""
    rows, row = len(offsets) - 1, 0
    while row < rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1)
        at, end = int(offsets[row]), int(offsets[to])
        while to == row + 1 and end - at > BLOCK:
            cut = at + BLOCK
            while cut < end and _IN_WORD[data[cut : cut + BLOCK]].all():
                cut += BLOCK
            cut = min(end, cut + int(np.argmin(_IN_WORD[data[cut : cut + BLOCK]]))) if cut < end else end
            yield row, to, at, cut
            at = cut
        yield row, to, at, end
        row = to


def word_blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first row, row after the last, hashes of their words, bounds``: row i's words are ``hashes[bounds[i]:bounds[i + 1]]``."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    held: list[np.ndarray] = []
    for row, to, at, end in _pieces(data, offsets):
        part = data[at:end]
        inside = _IN_WORD[part]
        starts = offsets[row:to] - at
        starts = starts[(starts > 0) & (starts < len(part))]
        before = np.concatenate([[False], inside[:-1]]) if len(part) else inside
        after = np.concatenate([inside[1:], [False]]) if len(part) else inside
        before[starts] = False
        after[starts - 1] = False
        first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((_LOWER[part].astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(part)), out=sums[1:])
        words = mix((sums[last] - sums[first]) * _power(_BACK, len(part) + 1)[first] + (last - first).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))
        if to == row + 1 and end < offsets[to]:
            held.append(words)
            continue
        if held:
            words, held = np.concatenate([*held, words]), []
            yield row, to, words, np.array([0, len(words)])
        else:
            yield row, to, words, np.concatenate([np.searchsorted(first, offsets[row:to] - at), [len(words)]])


def shingle_sets(words: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a block."""
    full = max(0, len(words) - WIDTH + 1)
    sums = np.zeros(full, np.uint64)
    for k in range(WIDTH if full else 0):
        sums += words[k : k + full] * _PLACE[k]
    hashes = mix(sums)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= WIDTH:
            out.append(np.unique(hashes[lo : hi - WIDTH + 1]))
        elif hi > lo:
            out.append(mix((words[lo:hi] * _PLACE[: hi - lo]).sum(keepdims=True, dtype=np.uint64) + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_blocks(texts: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """``first row, row after the last, their shingle sets``."""
    for row, to, words, bounds in word_blocks(texts):
        yield row, to, shingle_sets(words, bounds)
