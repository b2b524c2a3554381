"""Sketches that are kept and merged, grouping sets, and weighted resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import advantage as A
from tessella.operators import metrics, partition, resample
from tessella.operators import sketches as K
from tessella.plans.rollouts import rounded
from tessella.plans.views import EV, ev
from tessella.session import table
from tessella.streaming.rollouts import state_folder

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@query(
    "a33_sketches",
    """WITH g AS (SELECT event_type, user_id, value FROM events UNION ALL SELECT 'all', user_id, value FROM events)
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_within, true AS median_within, true AS tail_within FROM g GROUP BY event_type""",
)
def a33_sketches(spark, d):
    """Sketches a day and type are saved and merged over days and types; their estimates are held against all rows."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    where = f"{state_folder(spark)}/sketches"
    K.sketch(e, ["day", "event_type"], "user_id", "value").write.partitionBy("day").parquet(where)
    kept = spark.read.parquet(where).select("event_type", "n", "keys", "values")
    merged = K.merge(kept, ["event_type"]).unionByName(K.merge(kept.withColumn("event_type", F.lit("all")), ["event_type"]))
    marks = merged.select(F.col("event_type").alias("kind"), "n", K.distinct(F.col("keys")).alias("about"), *[K.quantile(F.col("values"), q).alias(f"q{int(q * 100)}") for q in (0.5, 0.95)])
    exact = e.select(F.explode(F.array("event_type", F.lit("all"))).alias("event_type"), "user_id", "value").join(F.broadcast(marks), F.col("event_type") == F.col("kind"))
    share = lambda c: F.avg((F.col("value") <= F.col(c)).cast("double"))
    users = F.countDistinct("user_id")
    near = lambda x, y, e: F.abs(x - y) <= e
    return exact.groupBy("event_type").agg(
        F.max("n").alias("n"),
        users.alias("users"),
        near(users, F.max("about"), F.greatest(K.COUNT_ERROR * users, F.lit(0.5))).alias("users_within"),
        near(share("q50"), F.lit(0.5), F.lit(K.RANK_ERROR) + 1 / F.count("*")).alias("median_within"),
        near(share("q95"), F.lit(0.95), F.lit(K.RANK_ERROR) + 1 / F.count("*")).alias("tail_within"),
    )


@query(
    "a33_grouping_sets",
    """SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, CAST(grouping_id(o_orderstatus, o_orderpriority, year(o_orderdate)) AS BIGINT) AS level, count(*) AS n, round(avg(o_totalprice), 4) AS mean
FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority, year(o_orderdate)), (o_orderstatus), ())""",
)
def a33_grouping_sets(spark, d):
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate").cast("long"))
    s, p, y = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("y")
    return o.groupingSets([[s, p], [p, y], [s], []], s, p, y).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("a33_cube", "SELECT o_orderstatus, o_orderpriority, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS level, count(DISTINCT o_custkey) AS customers, round(max(o_totalprice), 2) AS top FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def a33_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("level"), F.countDistinct("o_custkey").alias("customers"), F.round(F.max("o_totalprice"), 2).alias("top"))


@query(
    "w16_draws",
    f"""WITH {EV}, units AS (SELECT sample_id, CAST(round((pow(abs(score), 2) + 1e-8) / 1e-8) AS HUGEINT) AS u FROM ev),
line AS (SELECT sample_id, coalesce(sum(u) OVER (ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM units),
total AS (SELECT CAST(sum(u) AS DOUBLE) AS t, count(*) AS n FROM units),
points AS (SELECT CAST(floor(CAST(CAST('0x' || substr(md5('resample-1|' || i), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 * t) AS HUGEINT) AS x FROM (SELECT unnest(range(n)) AS i, t FROM total))
SELECT sample_id, count(*) AS times FROM points ASOF JOIN line ON points.x >= line.place GROUP BY sample_id""",
)
def w16_draws(spark, d):
    return resample.draws(A.resample_weights(ev(spark, d).select("sample_id", "score"), "score"), "sample_id", "weight")


@query(
    "a16_bootstrap_draws",
    f"""WITH {EV}, r AS (SELECT pred, score, row_number() OVER (PARTITION BY pred ORDER BY sample_id) - 1 AS i, count(*) OVER (PARTITION BY pred) AS n FROM ev),
d AS (SELECT DISTINCT pred, n, b, j FROM r, (SELECT unnest(range(1000)) AS b), (SELECT unnest(range(4)) AS j)),
x AS (SELECT pred, b, CAST(floor(CAST(CAST('0x' || substr(md5('bootstrap-1|' || pred || '|' || b || '|' || j), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 * n) AS BIGINT) AS i FROM d),
e AS (SELECT pred, b, max(score) AS hi, min(score) AS lo, avg(score) AS m FROM x JOIN r USING (pred, i) GROUP BY pred, b)
SELECT pred, round(avg(hi), 6) AS best_mean, round(stddev_pop(hi), 6) AS best_std, round(avg(lo), 6) AS worst_mean, round(stddev_pop(lo), 6) AS worst_std, round(stddev_pop(m), 6) AS average_std FROM e GROUP BY pred""",
)
def a16_bootstrap_draws(spark, d):
    out = metrics.bootstrap_draws(ev(spark, d), "pred", "sample_id", "score", 4)
    return rounded(out, "best_mean", "best_std", "worst_mean", "worst_std", "average_std")


@query(
    "u17_blocks",
    """SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity * l_quantity) AS BIGINT) AS total, count(*) AS keys, 8 AS parts, true AS within FROM lineitem GROUP BY l_returnflag""",
)
def u17_blocks(spark, d):
    """Whole lines of a return flag over 8 parts: every line once, and parts that differ by the largest load at most."""
    rows = table(spark, d, "lineitem").select("l_returnflag", F.concat_ws("-", "l_orderkey", "l_linenumber", F.xxhash64("*")).alias("key"), (F.col("l_quantity") * F.col("l_quantity")).cast("long").alias("load"))
    parts = partition.balanced_blocks(rows, "l_returnflag", "key", "load", 8, block_rows=4096).groupBy("l_returnflag", "part").agg(F.count("*").alias("n"), F.sum("load").alias("s"), F.max("load").alias("most"), F.countDistinct("key").alias("keys"))
    return parts.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.sum("s").alias("total"), F.sum("keys").alias("keys"), F.count("*").cast("int").alias("parts"), (F.max("s") - F.min("s") <= F.max("most")).alias("within"))
