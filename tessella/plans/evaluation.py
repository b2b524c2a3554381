"""Offline evaluation over responses made from ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import answers
from tessella.session import table


def prompts_with_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a prompt: an id, a source, a true answer and four responses (right, comma form, wrong, none)."""
    o = table(spark, sf_dir, "orders")
    truth = F.col("o_custkey").cast("string")
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderpriority").alias("data_source"),
        truth.alias("truth"),
        F.array(
            F.concat(F.lit("so it is #### "), truth),
            F.concat(F.lit("we get #### "), F.format_number(F.col("o_custkey"), 0)),
            F.concat(F.lit("#### "), (F.col("o_orderkey") % 97).cast("string")),
            F.concat(F.lit("the result is "), truth),
        ).alias("responses"),
    )


def mean_of_means(rows: DataFrame, row_id: str, source: str, score: str) -> DataFrame:
    """The mean of a row's scores, then the mean of a source's rows: ``data_source, n_rows, score``."""
    per_row = rows.groupBy(row_id, source).agg(F.avg(score).alias("_row"))
    return per_row.groupBy(F.col(source).alias("data_source")).agg(F.count("*").alias("n_rows"), F.round(F.avg("_row"), 9).alias("score"))


def a20_offline_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prompts_with_responses(spark, sf_dir).select("row_id", "data_source", "truth", F.explode("responses").alias("response"))
    scored = rows.withColumn("s", answers.equals_score(answers.hash_answer(F.col("response")), F.col("truth")))
    return mean_of_means(scored, "row_id", "data_source", "s")


# The responses again, for DuckDB.
RESPONSES_SQL = """
SELECT o_orderkey AS row_id, o_orderpriority AS data_source, CAST(o_custkey AS VARCHAR) AS truth, u.k AS ord,
  CASE u.k WHEN 1 THEN 'so it is #### ' || CAST(o_custkey AS VARCHAR)
           WHEN 2 THEN 'we get #### ' || format('{:,}', o_custkey)
           WHEN 3 THEN '#### ' || CAST(o_orderkey % 97 AS VARCHAR)
           ELSE 'the result is ' || CAST(o_custkey AS VARCHAR) END AS response
FROM orders, (SELECT unnest([1, 2, 3, 4]) AS k) u
"""

QUERIES = {"a20_offline_eval": a20_offline_eval}
SQL = {
    "a20_offline_eval": f"""
WITH r AS ({RESPONSES_SQL}),
e AS (SELECT *, regexp_extract_all(right(response, 300), '#### (-?[0-9.,]+)', 1) AS f FROM r),
s AS (SELECT row_id, data_source, CASE WHEN replace(replace(f[len(f)], ',', ''), '$', '') = truth THEN 1.0 ELSE 0.0 END AS s FROM e),
p AS (SELECT row_id, data_source, avg(s) AS m FROM s GROUP BY 1, 2)
SELECT data_source, count(*) AS n_rows, round(avg(m), 9) AS score FROM p GROUP BY 1"""
}
