"""Words of Arrow string columns as 64-bit hashes, without a Python object a word.

A batch is cut into chunks of whole texts. A word's hash is a polynomial over its bytes modulo 2^64 (a random odd number
for each byte value, letters A-Z folded to a-z), read from one running sum, and then scrambled. Chance alone makes two
words of a corpus of 10^9 different words collide with probability below 0.03.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
CHUNK = 1 << 20


def _byte_values(fold: bool) -> np.ndarray:
    t = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold:
        t[ord("A") : ord("Z") + 1] = t[ord("a") : ord("z") + 1]
    return t


_VALUES = _byte_values(True)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Letters of ASCII and every byte of other scripts.
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[128:] = True
ECHO = np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers; each salt gives another one."""
    x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, CHUNK + 1)
        for name, step in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, step, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def chunks(column: pa.Array, limit: int = CHUNK, most: int = 4096) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) for runs of at most ``most`` texts and about ``limit`` bytes; a null text is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, min(first + most, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word and the end) of one chunk.

    Words are runs of bytes that are not ASCII white space or, with ``letters_only``, runs of letters.
    """
    starts, ends, total, down = _spans(data, offsets, letters_only)
    return mix((total[ends] - total[starts]) * down[starts], 1), np.searchsorted(starts, offsets)


def tokens(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = (), marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, index of each one's text): all words of letters and the first characters of those that are longer; with
    ``marks`` also the runs of other characters that are not white space, and ECHO for a word like the two before it."""
    starts, ends, total, down = _spans(data, offsets, True)
    of = np.searchsorted(offsets, starts, side="right") - 1
    found, where = [mix((total[ends] - total[starts]) * down[starts], 1)], [of]
    if prefixes:
        heads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # first bytes of characters, and the end
        at = np.searchsorted(heads, starts)
        for k in prefixes:
            stop = heads[np.minimum(at + k, len(heads) - 1)]
            long = stop < ends
            a = starts[long]
            found.append(mix((total[stop[long]] - total[a]) * down[a], 100 + k))
            where.append(of[long])
    if marks:
        a, b, total, down = _spans(data, offsets, ~_LETTER & ~_SPACE)
        found.append(mix((total[b] - total[a]) * down[a], 99))
        where.append(np.searchsorted(offsets, a, side="right") - 1)
        again = np.flatnonzero((found[0][2:] == found[0][1:-1]) & (found[0][2:] == found[0][:-2]) & (of[2:] == of[:-2]))
        found.append(np.full(len(again), ECHO))
        where.append(of[again])
    return np.concatenate(found), np.concatenate(where)


def _spans(data: np.ndarray, offsets: np.ndarray, kind: bool | np.ndarray) -> tuple[np.ndarray, ...]:
    """(starts and ends of words, running sums of the bytes' values, powers that bring a sum back to its start).

    ``kind`` is a table of the bytes that words are made of, or whether they are letters only.
    """
    n = len(data)
    inside = kind[data] if isinstance(kind, np.ndarray) else _LETTER[data] if kind else ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:n], out=total[1:])
    return starts, ends, total, down


_STEP = [np.uint64(mix(np.array([i], np.uint64), 77)[0] | np.uint64(1)) for i in range(64)]


def shingles(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, across texts; the caller takes each text's own."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += word_hashes[i : i + n] * _STEP[i]
    return mix(out, 1000 + k)


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the text, sorted distinct shingle hashes). Under k words: one hash of them all; without words: none."""
    for first, data, offsets in chunks(column):
        h, at = words(data, offsets)
        s = shingles(h, k)
        for i in range(len(offsets) - 1):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= k:
                yield first + i, np.unique(s[a : b - k + 1])
            elif b > a:
                yield first + i, shingles(h[a:b], b - a)
            else:
                yield first + i, np.zeros(0, np.uint64)
