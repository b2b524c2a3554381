"""Multinomial resampling with replacement: as many draws as rows, a row's chance in proportion to its weight.

Weights are whole units of 1e-8, so running totals are exact in any order of addition, and a draw is a digest of its
number, so that runs repeat. Rows lie end to end on a line of their weights; draws are points on it. Both are dealt by
ranges of their place on the line and sorted there, and a draw belongs to the last row that begins at or before it. A
range that has no row before its first draw takes the last row of the ranges before it, from a table of one row a range.
So no row meets more than its own draws: neither a row with most of the weight nor very many rows with almost none
crowd a task, and nothing but the tables of ranges is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.streaming.rollouts import state_folder

UNIT = 1e-8
PLACE = "decimal(38,0)"


def dealt(df: DataFrame, *order: str) -> DataFrame:
    """A saved table with ``_part``, the range that a row is in; ranges are in order."""
    where = f"{state_folder(df.sparkSession)}/dealt"
    df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(where)
    return df.sparkSession.read.parquet(where)


def before(parts: DataFrame, value: Column) -> DataFrame:
    """``_p, _of``: ``value`` over all ranges before each one; a row a range."""
    return F.broadcast(parts.select(F.col("_part").alias("_p"), value.over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_of")))


def uniform(number: Column, seed: str) -> Column:
    """In [0, 1), from 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), number.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(2**52)


def draws(rows: DataFrame, key: str, weight: str, seed: str = "resample-1", size: int | None = None) -> DataFrame:
    """``key, times`` of the rows that are drawn. ``key`` names a row; ``size`` is the number of draws, else that of rows.

    A null or negative weight counts as 0 and is never drawn; without any weight the result is empty.
    """
    units = F.coalesce(F.greatest(F.round(F.col(weight) / UNIT), F.lit(0.0)), F.lit(0.0)).cast(PLACE)
    line = dealt(rows.select(F.col(key), units.alias("units")).filter("units > 0"), key)
    own = F.sum("units").over(W.partitionBy("_part").orderBy(key).rowsBetween(W.unboundedPreceding, -1))
    starts = before(line.groupBy("_part").agg(F.sum("units").alias("s")), F.sum("s"))
    zero = F.lit(0).cast(PLACE)
    begins = line.withColumn("_own", F.coalesce(own, zero)).join(starts, F.col("_part") == F.col("_p")).select(F.col(key), (F.col("_own") + F.coalesce("_of", zero)).cast(PLACE).alias("place"), F.lit(0).alias("kind"))
    total = line.agg(F.sum("units")).first()[0]
    spark = rows.sparkSession
    n = (rows.count() if size is None else size) if total else 0
    point = F.floor(uniform(F.col("id"), seed) * float(total or 0)).cast(PLACE)
    points = spark.range(n).select(F.lit(None).cast(rows.schema[key].dataType).alias(key), point.alias("place"), F.lit(1).alias("kind"))
    both = dealt(begins.unionByName(points), "place", "kind")
    at = F.last(key, ignorenulls=True).over(W.partitionBy("_part").orderBy("place", "kind").rowsBetween(W.unboundedPreceding, 0))
    ends = both.groupBy("_part").agg(F.max_by(key, F.when(F.col("kind") == 0, F.col("place"))).alias("k"))
    carried = before(ends, F.last("k", ignorenulls=True))
    found = both.withColumn("_at", at).filter("kind = 1").join(carried, F.col("_part") == F.col("_p"))
    return found.groupBy(F.coalesce("_at", "_of").alias(key)).agg(F.count("*").alias("times"))
