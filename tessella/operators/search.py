"""Vector top-k of a table of queries against all rows.

Queries and candidates are dealt to cells of about QUERIES by CANDIDATES vectors, so that every query meets every
candidate in one cell, a product of matrices; the best of the cells are merged by query.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERIES, CANDIDATES = 256, 4096


def _best(table: pa.Table, k: int, digits: int | None) -> pa.Table:
    """The k best rows of a cell for each of its queries: ``query_id, vec_id, score`` and what else the rows hold.

    The product of matrices only says which rows can be among the best, within its error. These are scored by adding their
    products from the first to the last, so a score does not depend on the cell, and equal vectors score alike.
    """
    is_query, ids = table["is_query"].to_numpy(), table["id"].to_numpy()
    v = np.concatenate([x.flatten().to_numpy() for x in table["v"].chunks]).reshape(len(ids), -1).astype(float)
    q, c, q_ids, c_ids = v[is_query], v[~is_query], ids[is_query], ids[~is_query]
    queries, places, scores = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0)]
    if len(q_ids) and len(c_ids):
        nth = len(c_ids) - min(k, len(c_ids))
        with np.errstate(invalid="ignore", over="ignore"):
            near = q @ c.T
            # twice the bound of either sum's error, and what rounding makes equal
            off = 4 * v.shape[1] * np.finfo(float).eps * np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)) + (0 if digits is None else 2 * 10.0**-digits)
            own = q_ids[:, None] == c_ids
            low = np.where(own | ~np.isfinite(near - off), -np.inf, near - off)
            alive = ~own & ~(near + off < np.partition(low, nth, axis=1)[:, nth, None])
            for i in range(len(q_ids)):
                rows = np.flatnonzero(alive[i])
                s = np.add.accumulate(q[i] * c[rows], axis=1)[:, -1] + 0.0
                s = s if digits is None else np.round(s, digits)
                best = np.lexsort((c_ids[rows], -s, ~np.isnan(s)))[:k]  # NaN is the largest, as in Spark's order
                queries.append(np.full(len(best), q_ids[i]))
                places.append(rows[best])
                scores.append(s[best])
    rest = table.drop_columns(["is_query", "v", "dim", "qb", "cb"]).rename_columns({"id": "vec_id"}).filter(pa.array(~is_query))
    return rest.take(pa.array(np.concatenate(places))).add_column(0, "query_id", pa.array(np.concatenate(queries), pa.int64())).append_column("score", pa.array(np.concatenate(scores)))


def top_k(queries: DataFrame, vectors: DataFrame, k: int, digits: int | None = 6, keep: Sequence[str] = ()) -> DataFrame:
    """``query_id, vec_id, score, rank`` by inner product to ``digits`` places, all of them if None; other ids only; ties go
    to the smaller id. The columns ``keep`` of the found vectors come along.

    Rows with a null id and vectors that are null, empty or hold a null have no product and take no part; vectors of
    different lengths do not meet.
    """
    fine = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull())
    rows = lambda df, *more: df.filter(fine).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"), F.size("embedding").alias("dim"), *more)
    kept = vectors.select(*keep).schema if keep else []
    q, c = rows(queries, *[F.lit(None).cast(f.dataType).alias(f.name) for f in kept]), rows(vectors, *keep)
    q_blocks, c_blocks = max(1, -(-q.count() // QUERIES)), max(1, -(-c.count() // CANDIDATES))

    def deal(n: int) -> Column:
        return F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n)).cast("int")

    def spread(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # dealt first: beside an explode, the number of a row would be that of a copy, and a query's copies would part
    q, c = q.withColumn("qb", deal(q_blocks)), c.withColumn("cb", deal(c_blocks))
    both = q.select("*", F.lit(True).alias("is_query"), spread(c_blocks).alias("cb")).unionByName(c.select("*", F.lit(False).alias("is_query"), spread(q_blocks).alias("qb")))
    schema = "query_id long, vec_id long, " + "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "score double"
    best = both.groupBy("dim", "qb", "cb").applyInArrow(lambda t: _best(t, k, digits), schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank", *keep)
