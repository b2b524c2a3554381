"""Exact top-k inner products without random access (NRA).

Vectors become integers, floor(256 * x). Candidates stay where they are: every task reads its own in cells of at most CELL
rows. Queries go to them in blocks of at most QUERY_BYTES, so every query meets every candidate once and nothing grows
with the product of the two but the work itself.

In a cell every dimension is a list of the candidates sorted by value, read only in sequence, for a query from the end
that its component wants (a negative one wants small values). After each step a candidate's score lies between its read
part plus the least, and plus the most, that its unread dimensions can add: the most is the border up to which a list is
read. The floor of a query is the k-th best score that it has from the cells before; in a task's first cell, a small one,
the k-th best lower bound, where an id counts once and the query's own id not at all. Once the borders alone are below
the floor, a candidate whose upper bound is below it is out for good, as are those that no list has shown yet. Reading
ends when few candidates are left; their final scores are resolved exactly, in integers, and raise the floor.

The best of each task are merged by query. Ties go to the smaller vec_id.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, as query or candidate;
vectors of different lengths do not meet; rows with a null id take no part; a query's own row is left out by its id, so
rows that repeat an id are not each other's candidates, and rows that repeat id and score count once; a query without
candidates gives no row; other columns are ignored, whatever their names. Bounds are floating-point numbers with room for
their rounding; scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm import scratch

K, EVERY, SCALE = 5, 50, 256
FIRST, CELL, QUERY_BYTES = 1 << 10, 1 << 14, 8 << 20
#: Shares of the lists after which bounds are compared, and candidates a wanted result that end the reading.
READ = (0.25, 0.5, 0.625, 0.75, 1.0)
FEW = 30
RESULT = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame) -> DataFrame:
    """``id, v``: usable vectors as integers."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    fine = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return vectors.filter(fine).select(F.col("vec_id").cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * SCALE).cast("long")).alias("v"))


class Cell:
    """Candidates ``v`` (integers, a row each) with their ids, and each dimension's list: a row of ``order`` and ``lists``."""

    def __init__(self, v: np.ndarray, ids: np.ndarray):
        n, d = v.shape
        self.v, self.ids, columns = v, ids, np.ascontiguousarray(v.T)
        self.order = np.argsort(columns, axis=1, kind="stable")
        self.lists = np.take_along_axis(columns, self.order, axis=1).astype(float)
        self.place = np.empty((n, d), np.int32)
        self.place[self.order.ravel(), np.repeat(np.arange(d), n)] = np.tile(np.arange(n, dtype=np.int32), d)
        self.largest = np.abs(self.lists[:, [0, -1]]).max(axis=1)
        self.repeats = len(np.unique(ids)) < n

    def best(self, q: np.ndarray, own: int, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the few candidates of query ``q`` that can be among its k best; ``floor`` is what these need."""
        n, d = self.v.shape
        w, up = q.astype(float), q >= 0
        room = 1e-12 * float(np.abs(w) @ self.largest)
        got, alive, read, known = np.zeros(n), np.flatnonzero(self.ids != own), 0, floor > -np.inf
        for share in READ:
            to = max(int(n * share), read)
            if len(alive) <= FEW * k or to == n:
                break
            for dims, part in ((np.flatnonzero(up), slice(n - to, n - read)), (np.flatnonzero(~up), slice(read, to))):
                got += np.bincount(self.order[dims, part].ravel(), (self.lists[dims, part] * w[dims, None]).ravel(), n)
            read = to
            border = np.where(up, self.lists[:, n - 1 - read], self.lists[:, read]) * w
            if known and border.sum() + room >= floor:
                continue  # candidates that no list has shown yet may still be among the best
            place = self.place[alive]
            hidden = np.where(up, place < n - read, place >= read).astype(float)
            if not known:
                lower = got[alive] + hidden @ (np.where(up, self.lists[:, 0], self.lists[:, -1]) * w)
                if self.repeats:
                    by_id = np.argsort(self.ids[alive], kind="stable")
                    first = np.flatnonzero(np.diff(self.ids[alive][by_id], prepend=self.ids[alive][by_id[0]] - 1))
                    lower = np.maximum.reduceat(lower[by_id], first)
                if len(lower) >= k:
                    floor = max(floor, np.partition(lower, -k)[-k] - room)
            alive = alive[got[alive] + hidden @ border + room >= floor]
        return self.v[alive] @ q, self.ids[alive]


class Search:
    """Queries ``v`` with their ids, and the k best distinct (score, id) of each so far."""

    def __init__(self, v: np.ndarray, ids: np.ndarray, k: int):
        self.v, self.ids, self.k = v, ids, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id)

    def read(self, cell: Cell) -> None:
        for i, (q, own) in enumerate(zip(self.v, self.ids, strict=True)):
            have = self.found[i]
            floor = -have[-1][0] if len(have) == self.k else -np.inf
            scores, ids = cell.best(q, own, floor, self.k)
            new = np.flatnonzero(scores >= floor)
            self.found[i] = sorted({*have, *zip((-scores[new]).tolist(), ids[new].tolist(), strict=True)})[: self.k]

    def rows(self) -> list[tuple[int, int, int]]:
        return [(int(own), c, -s) for own, have in zip(self.ids, self.found, strict=True) for s, c in have]


def _matrix(column: pa.ListArray, rows: np.ndarray, dim: int) -> np.ndarray:
    starts = column.offsets.to_numpy()[rows]
    return column.values.to_numpy()[starts[:, None] + np.arange(dim)]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, ids, vectors) for each length of vector in ``batch(id, v)``."""
    ids, sizes = batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy())
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield dim, ids[rows], _matrix(batch.column(1), rows, dim)


def _scan(batches: Iterator[pa.RecordBatch], queries: dict, k: int) -> Iterator[pa.RecordBatch]:
    searches = {dim: Search(v, ids, k) for dim, (ids, v) in queries.items()}
    waiting: dict[int, list] = {dim: [] for dim in searches}
    fresh = dict.fromkeys(searches, True)

    def read(dim: int, rows: int = 1) -> None:
        while sum(len(ids) for ids, _ in waiting[dim]) >= rows:
            ids, v = (np.concatenate(x) for x in zip(*waiting[dim], strict=True))
            n = FIRST if fresh.pop(dim, False) else CELL
            searches[dim].read(Cell(v[:n], ids[:n]))
            waiting[dim] = [(ids[n:], v[n:])] if len(ids) > n else []

    for batch in batches:
        for dim, ids, v in _groups(batch):
            if dim in searches:
                waiting[dim].append((ids, v))
                read(dim, CELL)
    for dim in searches:
        read(dim)
    found = [r for s in searches.values() for r in s.rows()]
    columns = list(zip(*found, strict=True)) or [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, is_query: Column | None = None, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of every query, which is by default every row whose id
    is divisible by EVERY. Candidates are all rows with another id."""
    spark = vectors.sparkSession
    all_ = scratch.save(integers(vectors).dropDuplicates(["id", "v"]), "vectors")
    queries = all_.filter(F.pmod("id", F.lit(EVERY)) == 0 if is_query is None else is_query)
    size = queries.agg(F.sum(8 * F.size("v"))).first()[0] or 0
    n = max(1, -(-size // QUERY_BYTES))
    best = None
    for i in range(n):
        part = queries.filter(F.pmod(F.xxhash64("id", "v"), F.lit(n)) == i).toArrow().combine_chunks()
        held: dict[int, tuple] = {}
        for batch in part.to_batches():
            for dim, ids, v in _groups(batch):
                a, b = held.get(dim, (ids[:0], v[:0]))
                held[dim] = np.concatenate([a, ids]), np.concatenate([b, v])
        shared = spark.sparkContext.broadcast(held)
        found = all_.mapInArrow(lambda batches, shared=shared: _scan(batches, shared.value, k), RESULT)
        found = scratch.save(found, "found") if n > 1 else found
        best = found if best is None else best.unionByName(found)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def sql(k: int = K) -> str:
    return f"""
WITH e AS (SELECT DISTINCT vec_id AS id, len(embedding) AS d, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
f AS (SELECT id, d, unnest(range(d)) AS i, unnest(v) AS x FROM e),
s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM f q JOIN f c ON q.i = c.i AND q.d = c.d
  WHERE q.id % {EVERY} = 0 AND q.id <> c.id GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= {k}"""
