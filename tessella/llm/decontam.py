"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased, their ASCII punctuation and white space become single spaces, and all else is UTF-8
bytes. Both get a space on each side, so that words do not match within longer ones at any length. An item of m bytes
may appear in a text with k = floor(RATE * m) edits. It is cut into k + 1 pieces: k edits
leave at least one piece whole, so every appearance holds an exact piece hit. One automaton finds all pieces of all
items in a pass over a text. Around each hit the window is first held against a lemma that loses nothing: k edits
spoil at most k * q of an item's different runs of q bytes, so a window with fewer common ones cannot hold the item. The rest is
verified by Myers' bit-parallel distance (one step a byte, the item's bytes as bits of one number). Windows of hits
that overlap are verified once.

The benchmark is a stated set of queries: it goes to the executors in blocks of at most BLOCK_BYTES, for which a Python
worker builds tables of about 200 times that, and every text is read once a block.

Defined cases: null texts and items that are null or hold no letter or digit match nothing; items whose budget is 0
match only exactly, as whole words; repeated items and documents give a row each; columns besides doc_id, text,
item_id are carried or ignored, whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.09
RUN = 6
BLOCK_BYTES = 2 << 20
_CLEAN = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def normal(text: str | None) -> str:
    """One character a byte, between spaces; empty without letters and digits."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_CLEAN).split()
    return b" ".join([b"", *words, b""]).decode("latin-1") if words else ""


def budget(item: str, rate: float = RATE) -> int:
    """Edits that a normalised item may have."""
    return int((len(item) - 2) * rate)


def myers(item_bits: dict[str, int], m: int, window: str) -> tuple[int, int]:
    """(least distance of the item to a part of the window, that part's end)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(window):
        eq = item_bits.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, i + 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
    return best, end


class Matcher:
    """Piece automaton and bit tables of a block of items ``(item_id, text)``."""

    def __init__(self, items: list, rate: float = RATE):
        import ahocorasick

        self.items, pieces = [], {}
        for item_id, text in items:
            n = normal(text)
            if not n:
                continue
            k, bits = budget(n, rate), {}
            for i, c in enumerate(n):
                bits[c] = bits.get(c, 0) | 1 << i
            cuts = [len(n) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(n[a:b], []).append((len(self.items), a))
            runs = frozenset(n[i : i + RUN] for i in range(len(n) - RUN + 1))
            self.items.append((item_id, n, k, bits, runs))
        self.automaton = ahocorasick.Automaton()
        for p, where in pieces.items():
            self.automaton.add_word(p, (len(p), where))
        if pieces:
            self.automaton.make_automaton()

    def matches(self, text: str | None, first_only: bool = False) -> list[tuple]:
        """``(item_id, distance, length)`` for every item that the text holds."""
        t = normal(text)
        if not t or not self.items:
            return []
        starts: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(t):
            for item, offset in where:
                starts.setdefault(item, set()).add(end - size + 1 - offset)
        out = []
        for item, at in starts.items():
            item_id, n, k, bits, runs = self.items[item]
            d = self._distance(t, n, k, bits, runs, sorted(at))
            if d <= k:
                out.append((item_id, d, len(n) - 2))
                if first_only:
                    break
        return out

    @staticmethod
    def _distance(t: str, n: str, k: int, bits: dict, runs: frozenset, at: list[int]) -> int:
        m, common = len(n), len(runs) - k * RUN
        if any(s >= 0 and t.startswith(n, s) for s in at):
            return 0
        if not k:
            return 1
        best, lo, hi = k + 1, None, None
        for s in [*at, None]:
            if lo is not None and (s is None or s - k > hi):
                window = t[max(0, lo) : hi]
                if len(runs.intersection([window[i : i + RUN] for i in range(len(window) - RUN + 1)])) >= common:
                    best = min(best, myers(bits, m, window)[0])
                lo = None
            if s is not None:
                lo, hi = (s - k if lo is None else lo), s + m + k
        return best


_built: dict = {}


def _matcher(shared, rate: float) -> Matcher:
    """Built once a Python worker; a worker keeps the last one."""
    items = shared.value
    key = (hash(tuple(items)), rate)
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(items, rate)
    return _built[key]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list]:
    """The items, in blocks that fit the driver and a broadcast; their number comes from the table's measured size."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(-(-total // block_bytes))
    for i in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield sorted(((r[0], r[1]) for r in part.toLocalIterator()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, distance, item_bytes``: a row for each item found in a document, distance at most its budget."""
    schema, out = "doc_id long, item_id long, distance int, item_bytes int", None
    for items in _blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared, rate)
            for batch in batches:
                rows = [(d.as_py(), *m) for d, text in zip(batch.column(0), batch.column(1), strict=True) for m in matcher.matches(text.as_py())]
                columns = list(zip(*rows, strict=True)) or [[], [], [], []]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "distance", "item_bytes"])

        found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold an item; all columns and other rows stay as they are."""
    at = docs.columns.index("text")
    for items in _blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.matches(t.as_py(), True) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
