"""Event-time streams over events that arrive in ten-day parts, some of them late.

Of the first half of a part every 20th event arrives a part late, days below the watermark; of its last 30 minutes every
second one arrives a part late, but within the delay. A row beyond all others closes what is open. The SQL knows each
row's part and the watermark before it, and has no other state.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.session import table
from tessella.streaming import eventtime as E

QUERIES: dict = {}
SQL: dict = {}

DELAY, GAP, WITHIN = "1 hour", "2 hours", "3 hours"
PARTS = 5
#: Microseconds since the first day, the ten-day part and the part of arrival: one expression for Spark and SQL.
DAYS = 86400 * 1_000_000
OWN = f"CAST(floor(micros / {10 * DAYS}.0) AS INTEGER)"
PART = f"{OWN} + CASE WHEN micros % {10 * DAYS} < {5 * DAYS} AND event_id % 20 = 0 OR micros % {10 * DAYS} >= {10 * DAYS - 30 * 60_000_000} AND event_id % 2 = 0 THEN 1 ELSE 0 END"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def arriving(spark, d):
    """The events with their part of arrival; the last part has the closing row."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withColumn("micros", F.unix_micros("ts") - F.unix_micros(F.lit("2024-01-01").cast("timestamp")))
    e = e.select("event_id", "user_id", "event_type", "value", "ts", F.expr(PART).alias("part"))
    closing = e.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("2030-01-01").cast("timestamp").alias("ts"), F.lit(PARTS - 1).alias("part"))
    return e, closing


def parts_of(e, closing):
    rows = [e.filter(F.col("part") == p).drop("part") for p in range(PARTS - 1)]
    return [*rows, closing.drop("part")]


TIMED = f"""e AS (SELECT *, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) AS micros FROM events),
parted AS (SELECT event_id, user_id, event_type, value, ts, {PART} AS part FROM e),
marks AS (SELECT p.part, date_trunc('millisecond', max(q.ts)) - INTERVAL 1 HOUR AS mark FROM (SELECT DISTINCT part FROM parted) p JOIN parted q ON q.part < p.part GROUP BY p.part),
marked AS (SELECT parted.*, mark FROM parted LEFT JOIN marks USING (part))"""


@query(
    "z12_sessions",
    f"""WITH {TIMED}, ok AS (SELECT * FROM marked WHERE mark IS NULL OR ts + INTERVAL 2 HOUR > mark),
starts AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM ok WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM starts)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n, round(sum(value), 4) AS total FROM runs GROUP BY user_id, run""",
)
def z12_sessions(spark, d):
    build = lambda read: E.sessions(read(), "user_id", "ts", GAP, DELAY, n=F.count("*"), total=F.sum("value"))
    out = E.arrivals(spark, parts_of(*arriving(spark, d)), build).filter("user_id >= 0")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("total", 4).alias("total"))


@query(
    "z12_first_deliveries",
    f"""WITH {TIMED}, last_mark AS (SELECT max(mark) AS m FROM marks),
again AS (SELECT event_id, ts + INTERVAL 20 MINUTE AS ts, part + 1 AS part FROM parted WHERE event_id % 3 = 0 AND part < {PARTS - 2}),
given AS (SELECT event_id, ts, part FROM parted UNION ALL SELECT * FROM again),
marks2 AS (SELECT p.part, date_trunc('millisecond', max(q.ts)) - INTERVAL 1 HOUR AS mark FROM (SELECT DISTINCT part FROM given) p JOIN given q ON q.part < p.part GROUP BY p.part),
ok AS (SELECT g.*, mark FROM given g LEFT JOIN marks2 USING (part) WHERE mark IS NULL OR ts > mark)
SELECT b.event_id, b.ts FROM ok b WHERE NOT EXISTS (SELECT 1 FROM ok a WHERE a.event_id = b.event_id AND a.part < b.part AND a.ts + INTERVAL 1 HOUR > b.mark)""",
)
def z12_first_deliveries(spark, d):
    e, closing = arriving(spark, d)
    again = e.filter(f"event_id % 3 = 0 AND part < {PARTS - 2}").withColumn("ts", F.col("ts") + F.expr("INTERVAL 20 MINUTES")).withColumn("part", F.col("part") + 1)
    build = lambda read: E.first_deliveries(read(), ["event_id"], "ts", DELAY)
    out = E.arrivals(spark, parts_of(e.unionByName(again), closing), build).filter("event_id >= 0")
    return out.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(
    "z12_follow_ups",
    f"""WITH {TIMED}, ok AS (SELECT * FROM marked WHERE mark IS NULL OR ts > mark)
SELECT a.event_id, b.event_id AS then_event_id FROM ok a JOIN ok b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 3 HOUR WHERE a.event_type IN ('view', 'click') AND b.event_type = 'purchase'""",
)
def z12_follow_ups(spark, d):
    def build(read):
        kinds = ["event_id", "user_id", "ts"]
        seen, bought = read().filter("event_type IN ('view', 'click', 'end')").select(*kinds), read().filter("event_type IN ('purchase', 'end')").select(*kinds)
        return E.follow_ups(seen, bought, "user_id", "ts", WITHIN, DELAY)

    return E.arrivals(spark, parts_of(*arriving(spark, d)), build).filter("event_id >= 0").select("event_id", "then_event_id")
