"""Event-time operators on streams: sessions, repeated deliveries and joins within an interval, with state that expires.

A watermark follows the largest event time of what has arrived, ``delay`` behind it. Rows at or below it are late and
dropped (a session's row: if its whole session would be below); state below it is given up, so it is bounded by the rows
of the delay and of the interval or gap, whatever the length of the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.streaming import rollouts as Z


def sessions(rows: DataFrame, key: str, ts: str, gap: str, delay: str, **aggregates: Column) -> DataFrame:
    """``key, start, end`` and the aggregates of runs of rows that are less than ``gap`` apart; ``end`` is ``gap`` after the last."""
    own = rows.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("_w"), key).agg(*[c.alias(n) for n, c in aggregates.items()])
    return own.select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *aggregates)


def first_deliveries(rows: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Rows without those whose keys have been seen before, for as long as the first one is within the delay."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def follow_ups(first: DataFrame, then: DataFrame, key: str, ts: str, within: str, delay: str) -> DataFrame:
    """Pairs of a row and one of the same key at its time or up to ``within`` later; columns of ``then`` get the prefix ``then_``."""
    a = first.withWatermark(ts, delay)
    b = then.select(*[F.col(c).alias(f"then_{c}") for c in then.columns]).withWatermark(f"then_{ts}", delay)
    near = (F.col(f"then_{ts}") >= F.col(ts)) & (F.col(f"then_{ts}") <= F.col(ts) + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(key) == F.col(f"then_{key}")) & near)


def arrivals(spark: SparkSession, parts: list[DataFrame], build: Callable[[Callable[[], DataFrame]], DataFrame]) -> DataFrame:
    """The appended results of a stream whose rows arrive in parts, as a batch table.

    ``build`` makes the query from a function that opens the stream. Each part is appended to the stream's folder, and a
    run from the last checkpoint processes it, so state and watermark pass from run to run, as after a restart.
    """
    where = Z.state_folder(spark)
    schema = parts[0].schema
    for part in parts:
        part.write.mode("append").parquet(f"{where}/in")
        out = build(lambda: spark.readStream.schema(schema).parquet(f"{where}/in"))
        q = out.writeStream.format("parquet").outputMode("append").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{where}/out")
