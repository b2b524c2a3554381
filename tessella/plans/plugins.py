"""Datasets and metric sinks that are data sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import table
from tessella.sources import plugin
from tessella.streaming.rollouts import state_folder

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


MONTHS = "SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS step, CAST(count(*) AS DOUBLE) AS orders, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total FROM orders GROUP BY 1"


def _monthly(spark, d) -> DataFrame:
    """Metrics of orders, a step a month."""
    step = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
    months = table(spark, d, "orders").groupBy(step.alias("step")).agg(F.count("*").cast("double").alias("orders"), F.round(F.sum("o_totalprice"), 2).cast("double").alias("total"))
    return months.select("step", F.create_map(F.lit("orders"), "orders", F.lit("total"), "total").alias("data"))


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("step", F.col("data")["orders"].alias("orders"), F.col("data")["total"].alias("total"))


@query("k05_metric_sink", MONTHS)
def k05_metric_sink(spark, d):
    """Metrics of each month, logged in two commits, the second of which is tried twice."""
    path, rows = state_folder(spark), _monthly(spark, d)
    plugin.log_metrics(rows.filter("step % 2 = 0"), path, "even")
    for _ in range(2):
        plugin.log_metrics(rows.filter("step % 2 = 1"), path, "odd")
    return _flat(spark.read.format(plugin.metric_lines(spark)).load(path))


@query("s09_source", f"WITH m AS ({MONTHS}) SELECT * FROM m WHERE step >= 1995 * 12 AND step < 1997 * 12")
def s09_source(spark, d):
    """A dataset class as a source: of the logged months those of two years, by bounds that the source takes."""
    path = state_folder(spark)
    plugin.log_metrics(_monthly(spark, d), path)
    return _flat(spark.read.format(plugin.metric_lines(spark)).options(low=1995 * 12, high=1997 * 12 - 1).load(path))


@query("s09_source_stream", f"WITH m AS ({MONTHS}) SELECT step % 2 AS batch, count(*) AS months, CAST(sum(orders) AS DOUBLE) AS orders FROM m GROUP BY 1")
def s09_source_stream(spark, d):
    """The dataset as a stream: a run after each commit gets that commit's rows alone."""
    path, rows = state_folder(spark), _monthly(spark, d)
    name = plugin.metric_lines(spark)
    for odd in (0, 1):
        plugin.log_metrics(rows.filter(F.col("step") % 2 == odd), f"{path}/metrics")
        stream = spark.readStream.format(name).load(f"{path}/metrics").withColumn("batch", F.lit(odd).cast("long"))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    out = spark.read.schema("step long, data map<string,double>, batch long").parquet(f"{path}/out")
    return out.groupBy("batch").agg(F.count("*").alias("months"), F.sum(F.col("data")["orders"]).alias("orders"))
