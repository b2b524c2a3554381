"""Datasets that grow by versions, and copies of folders that are verified."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.session import table
from tessella.sources import copies
from tessella.sources.growth import GrowingDataset
from tessella.streaming.rollouts import state_folder

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _next(v: int) -> str:
    return f"SELECT key * 10 + {v} AS key, price / 2 AS price FROM v{v - 1} WHERE (key + {v}) % 3 = 0 AND price / 2 >= 20000"


STEPS = 3
GROWN = "v0 AS (SELECT o_orderkey AS key, o_totalprice AS price FROM orders WHERE o_totalprice >= 20000), " + ", ".join(f"v{v} AS (SELECT * FROM v{v - 1} UNION ALL {_next(v)})" for v in range(1, STEPS + 1))


@query(
    "s10_growth",
    f"WITH {GROWN} " + " UNION ALL ".join(f"SELECT CAST({v + 1} AS BIGINT) AS version, count(*) AS n, round(sum(price), 2) AS total, (SELECT count(*) FROM v0) AS epoch FROM v{v}" for v in range(STEPS + 1)),
)
def s10_growth(spark, d):
    """Each batch appends what is made of the version before it, while an epoch goes on reading the first one."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    data = GrowingDataset(spark, f"{state_folder(spark)}/growing", orders.schema, keep=lambda rows: rows.filter("price >= 20000"))
    epoch = data.snapshot(data.append(orders))
    for v in range(1, STEPS + 1):
        data.on_batch_end(lambda rows, v=v: rows.filter((F.col("key") + v) % 3 == 0).select((F.col("key") * 10 + v).alias("key"), (F.col("price") / 2).alias("price")))
    out = None
    for v in range(1, STEPS + 2):
        one = data.snapshot(v).agg(F.lit(v).cast("long").alias("version"), F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out.crossJoin(F.broadcast(epoch.agg(F.count("*").alias("epoch"))))


@query(
    "n11_copies",
    """WITH t AS (SELECT DISTINCT event_type, dense_rank() OVER (ORDER BY event_type) AS k FROM events)
SELECT 'event_type=' || event_type AS directory, CASE k WHEN 1 THEN 'missing' WHEN 2 THEN 'extra' ELSE 'size' END AS what, true AS found_by_root FROM t WHERE k <= 3""",
)
def n11_copies(spark, d):
    """A folder of events and its copy, in which one type's files are missing, one has an extra file, and one has files of another size."""
    where = state_folder(spark)
    e = table(spark, d, "events")
    kinds = [r.event_type for r in e.select("event_type").distinct().orderBy("event_type").limit(3).collect()]
    e.repartition("event_type").write.partitionBy("event_type").parquet(f"{where}/a")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{where}/{p}")
    fs = path("a").getFileSystem(conf)
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path("a"), fs, path("b"), False, conf)
    fs.delete(path(f"b/event_type={kinds[0]}"), True)

    def put(p):
        out = fs.create(p, True)
        out.write(0)
        out.close()

    put(path(f"b/event_type={kinds[1]}/more.parquet"))
    for f in fs.listStatus(path(f"b/event_type={kinds[2]}")):
        put(f.getPath())
    a, b = copies.listing(spark, f"{where}/a"), copies.listing(spark, f"{where}/b")
    found = not copies.same(a, b) and copies.same(a, copies.listing(spark, f"{where}/a"))
    return copies.differences(a, b).select(F.regexp_replace("path", "/[^/]*$", "").alias("directory"), "what").distinct().withColumn("found_by_root", F.lit(found))
