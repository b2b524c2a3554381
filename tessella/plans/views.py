"""Rollouts derived from the relational tables, in Spark and in SQL.

``tok``: a row a token. ``ev``: a row a scored response. ``seqs``: a row a sample of ``tok``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.session import table

ORDER = "l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


def tok(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = items.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pos = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ORDER)) - 1
    return rows.select(
        F.col("o_custkey").alias("uid"),
        F.col("l_orderkey").alias("sample_id"),
        pos.alias("pos"),
        (F.col("l_discount") + 0.0).alias("reward"),
        (F.col("l_tax") + 0.0).alias("value"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("mask"),
        (-10 * F.col("l_tax") - 0.01).alias("old_lp"),
        (-10 * F.col("l_discount") - 0.01).alias("rollout_lp"),
    )


TOK = f"""tok AS (SELECT o_custkey AS uid, l_orderkey AS sample_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) - 1 AS INTEGER) AS pos,
  l_discount + 0.0 AS reward, l_tax + 0.0 AS value, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS mask,
  -10 * l_tax - 0.01 AS old_lp, -10 * l_discount - 0.01 AS rollout_lp
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``uid, sample_id, score, length``: masked reward sums and token counts."""
    return tok(spark, sf_dir).groupBy("uid", "sample_id").agg(F.sum(F.col("reward") * F.col("mask")).alias("score"), F.sum("mask").alias("length"), F.count("*").alias("width"))


SEQS = f"""{TOK},
seqs AS (SELECT uid, sample_id, sum(reward * mask) AS score, CAST(sum(mask) AS BIGINT) AS length, count(*) AS width FROM tok GROUP BY 1, 2)"""


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("uid"), F.col("event_id").alias("sample_id"), F.col("event_type").alias("pred"), F.col("value").alias("score"), F.to_date("ts").alias("step")
    )


EV = "ev AS (SELECT user_id AS uid, event_id AS sample_id, event_type AS pred, value AS score, CAST(ts AS DATE) AS step FROM events)"
