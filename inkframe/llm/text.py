"""Word and shingle hashes of many texts at once, for operators that run numpy inside Spark tasks.

A word is a maximal run of ASCII letters or digits or of any characters beyond ASCII, in lower case.
Hashes of all words of a batch come from one running polynomial sum over its bytes, so nothing loops
over words in Python. Texts are cut nowhere: a batch is split between documents only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy step handles; a longer document is a step of its own.
STEP_BYTES = 1_000_000
SHINGLE = 5

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"p": np.ones(1, dtype=np.uint64), "i": np.ones(1, dtype=np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        _powers[kind] = np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(n, base, dtype=np.uint64))])
    return _powers[kind][:n]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end, and where each begins (one entry more than texts)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def steps(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about STEP_BYTES of text each."""
    _, at = bytes_of(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + STEP_BYTES, side="right")) - 1)
        yield lo, min(hi, len(column))
        lo = hi


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first byte, end byte) of each word, in order; bytes count from the batch's start."""
    raw, at = bytes_of(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    return word_hashes(raw, at)


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if not len(raw):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    inside = _WORD[raw]
    before = np.concatenate([[False], inside[:-1]])
    before[at[:-1][at[:-1] < len(raw)]] = False
    after = np.concatenate([inside[1:], [False]])
    last = at[1:] - 1
    after[last[last >= 0]] = False
    first, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _pow("p", _P, len(raw)), out=total[1:])
    hashes = mix((total[end] - total[first]) * _pow("i", _P_INVERSE, len(raw))[first])
    return hashes, np.searchsorted(at, first, side="right") - 1, first, end


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of ``width`` words. A text of fewer words has one shingle of all of them."""
    if not len(hashes):
        return hashes, rows
    count = np.bincount(rows, minlength=n)
    short = (count < width)[rows]
    held, owner = hashes[~short], rows[~short]
    run = np.zeros(max(0, len(held) - width + 1), dtype=np.uint64)
    for j in range(width):
        run = mix(run * np.uint64(3) + held[j : len(held) - width + 1 + j])
    same = owner[: len(run)] == owner[width - 1 :] if len(run) else np.zeros(0, dtype=bool)
    out, of = run[same], owner[: len(run)][same]
    if short.any():
        few, by = hashes[short], rows[short]
        edge = np.flatnonzero(np.diff(by, prepend=-1))
        place = np.arange(len(few)) - np.repeat(edge, np.diff(np.append(edge, len(few))))
        lone = np.add.reduceat(mix(few + place.astype(np.uint64)), edge)
        out, of = np.concatenate([out, mix(lone)]), np.concatenate([of, by[edge]])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def counted(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, row) with their counts, by row and then hash."""
    if not len(hashes):
        return hashes, rows, np.zeros(0, dtype=np.int64)
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    edge = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]))
    return h[edge], r[edge], np.diff(np.append(edge, len(h)))
