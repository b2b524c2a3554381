"""Balancing and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import partition as P
from tessella.plans.rollouts import rounded
from tessella.plans.views import EV, TOK, ev, tok
from tessella.session import table
from tessella.streaming import rollouts as Z

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def lengths(spark, d):
    """Samples with their length and batch: about 256 a batch."""
    per = tok(spark, d).groupBy("uid", "sample_id").agg(F.count("*").alias("length"))
    return per.withColumn("batch", F.floor(F.col("sample_id") / 256).cast("int"))


LENGTHS = f"{TOK}, lengths AS (SELECT uid, sample_id, count(*) AS length, CAST(sample_id // 256 AS INTEGER) AS batch FROM tok GROUP BY 1, 2)"


@query("u17_karmarkar_karp")
def u17(spark, d):
    return P.balanced(lengths(spark, d), "batch", "sample_id", "length", 8)


@query("u18_greedy", f"""WITH RECURSIVE {LENGTHS}, i AS (SELECT batch, sample_id, length, row_number() OVER (PARTITION BY batch ORDER BY sample_id) AS k FROM lengths),
s AS (SELECT batch, CAST(0 AS BIGINT) AS k, [0::BIGINT, 0, 0, 0] AS sums, CAST(NULL AS BIGINT) AS sample_id, CAST(NULL AS BIGINT) AS length, 0 AS part FROM i WHERE k = 1
  UNION ALL SELECT i.batch, i.k, [CASE WHEN j = list_position(s.sums, list_min(s.sums)) THEN s.sums[j] + i.length ELSE s.sums[j] END FOR j IN range(1, 5)], i.sample_id, i.length,
    CAST(list_position(s.sums, list_min(s.sums)) - 1 AS INTEGER) FROM s JOIN i ON i.batch = s.batch AND i.k = s.k + 1)
SELECT batch, sample_id, length, part FROM s WHERE k > 0""")
def u18(spark, d):
    return P.balanced(lengths(spark, d), "batch", "sample_id", "length", 4, "greedy")


@query("u20_group_balanced")
def u20(spark, d):
    rows = lengths(spark, d).withColumn("batch", F.floor(F.col("uid") / 100).cast("int"))
    return P.group_balanced(rows, "uid", "uid", "batch", "length", 4).select("batch", "uid", "sample_id", "length", "part")


@query("u21_workload", f"WITH {LENGTHS} SELECT sample_id, 24576 * length + length * length AS load FROM lengths")
def u21(spark, d):
    return lengths(spark, d).select("sample_id", P.workload(F.col("length")).alias("load"))


@query("u22_micro_batches")
def u22(spark, d):
    return P.micro_batches(lengths(spark, d), "batch", "sample_id", "length", 128)


@query("u22_parts_needed", f"WITH {LENGTHS} SELECT batch, CAST(greatest(1, least(count(*), ceil(sum(length) / 128.0))) AS BIGINT) AS n_parts FROM lengths GROUP BY 1")
def u22_parts(spark, d):
    return P.token_budget_parts(lengths(spark, d), "batch", "length", 128)


@query("u24_snake_order", f"WITH {LENGTHS}, i AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY length, sample_id) - 1 AS i, count(*) OVER (PARTITION BY batch) AS n FROM lengths) SELECT batch, sample_id, CAST(CASE WHEN i % 2 = 0 THEN i // 2 ELSE n - 1 - (i - 1) // 2 END AS INTEGER) AS place FROM i")
def u24(spark, d):
    return P.snake_order(lengths(spark, d), "batch", "length", "sample_id").select("batch", "sample_id", "place")


@query("u25_imbalance", f"WITH {LENGTHS}, p AS (SELECT batch, sum(length) AS s FROM lengths GROUP BY 1) SELECT CAST(min(s) AS BIGINT) AS min, CAST(max(s) AS BIGINT) AS max, CAST(max(s) - min(s) AS BIGINT) AS diff, round(avg(s), 6) AS mean FROM p")
def u25(spark, d):
    return rounded(P.imbalance(lengths(spark, d), "batch", "length"), "mean")


@query("a16_bootstrap")
def a16(spark, d):
    from tessella.operators.metrics import bootstrap

    return rounded(bootstrap(ev(spark, d), "pred", "score", 4), "mean", "std")


def stream_events(spark, d):
    return Z.with_event_time(Z.read_stream(spark, f"{d}/events.parquet"))


@query("z01_bounded_queue", "SELECT user_id, list(event_id ORDER BY event_id) FILTER (k <= 16) AS held, count(*) AS produced, greatest(count(*) - 16, 0) AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) GROUP BY 1")
def z01(spark, d):
    return Z.run_latest(Z.bounded_queues(Z.read_stream(spark, f"{d}/events.parquet"), "user_id", "event_id", 16), "user_id")


@query("z01_newest", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 16")
def z01_batch(spark, d):
    return Z.newest(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 16)


@query("z05_stale_counts", "SELECT user_id, count(*) AS n, count(*) FILTER (10 - event_id % 11 >= 1) AS stale, max(10 - event_id % 11) AS max_lag FROM events GROUP BY 1")
def z05(spark, d):
    e = Z.read_stream(spark, f"{d}/events.parquet").withColumn("version", F.col("event_id") % 11).withColumn("current", F.lit(10))
    return Z.run(Z.stale_counts(e, "user_id", "version", "current"), "complete")


@query("z06_assemble", "SELECT user_id, event_id, CAST(i // 8 AS INTEGER) AS batch FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE i // 8 < n // 8")
def z06(spark, d):
    return Z.assemble(table(spark, d, "events").select("user_id", "event_id"), "event_id", 8, "user_id")


@query("z07_resumed_first", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value < 10 THEN 1 ELSE 0 END DESC, event_id) AS place FROM events")
def z07(spark, d):
    e = table(spark, d, "events").withColumn("cancelled", F.col("value") < 10)
    return Z.resumed_first(e, "cancelled", "event_id", "user_id").select("user_id", "event_id", "place")


@query("z10_ready", "SELECT event_id, value, event_type FROM events WHERE value >= 5 AND event_type <> 'click'")
def z10(spark, d):
    read = lambda: Z.read_stream(spark, f"{d}/events.parquet")
    scored, typed = read().filter("value >= 5").select("event_id", "value"), read().filter("event_type <> 'click'").select("event_id", "event_type")
    return Z.run(Z.ready([scored, typed], "event_id"))


@query("z12_tumbling", "SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def z12(spark, d):
    e = stream_events(spark, d).withWatermark("ts", "1 hour")
    agg = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out = Z.run(agg.select(F.col("w.start").alias("start"), "event_type", "n", "total"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("m06_token_bucket", """WITH RECURSIVE e AS (SELECT user_id, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS t, value AS n, row_number() OVER (PARTITION BY user_id ORDER BY date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6, value) AS k FROM events),
s AS (SELECT user_id, k, t, n, least(100.0, 100.0 + t * 0.001) - n AS level FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.k, e.t, e.n, least(100.0, s.level + (e.t - s.t) * 0.001) - e.n FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT user_id, round(t, 3) AS t, round(n, 6) AS n, round(greatest(0.0, -level / 0.001), 3) + 0.0 AS wait FROM s""")
def m06(spark, d):
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1e6
    e = table(spark, d, "events").select("user_id", t.alias("t"), F.col("value").alias("n"))
    out = Z.token_bucket(e, "t", "n", "user_id", 0.001, 100.0)
    return out.select("user_id", F.round("t", 3).alias("t"), F.round("n", 6).alias("n"), (F.round("wait", 3) + 0.0).alias("wait"))
