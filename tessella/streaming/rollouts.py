"""Streaming intake of rollouts, with a batch form of each operator.

The version of a sample is a column, so lateness is a difference of versions: late rows are kept and counted. Only the
bounded queue drops rows, the oldest first.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def state_folder(spark: SparkSession) -> str:
    """Where streams keep their checkpoints: below the cluster's shared folder, else a folder of this process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        import uuid

        return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="stream-")


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet folder, or one file of a folder, as a stream; files a trigger are the back-pressure."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return source.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return source.parquet(path)


def run_latest(stream: DataFrame, key: str) -> DataFrame:
    """Process all that is there in update mode; of each key's rows the last micro-batch's, as a batch table."""
    where, names = state_folder(stream.sparkSession), stream.columns
    put = lambda df, n: df.withColumn("_batch", F.lit(n)).write.mode("append").parquet(f"{where}/out")
    stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{where}/out")
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in names if c != key]), "_batch").alias("_s")).select(key, "_s.*").select(*names)


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all that is there, then stop; the result as a batch table.

    Complete results come through foreachBatch (the last one counts), appended ones through files.
    """
    spark = stream.sparkSession
    where = state_folder(spark)
    if mode == "append":
        q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    else:
        put = lambda df, _: df.write.mode("overwrite").parquet(f"{where}/out")
        q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def with_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


# --- bounded queue -----------------------------------------------------------------------------------------------------


def newest(df: DataFrame, queue: str, order: str, capacity: int) -> DataFrame:
    """The batch form: what a queue that drops its oldest row when full holds in the end."""
    rank = F.row_number().over(W.partitionBy(queue).orderBy(F.desc(order)))
    return df.withColumn("_k", rank).filter(F.col("_k") <= capacity).drop("_k")


def bounded_queues(stream: DataFrame, queue: str, order: str, capacity: int) -> DataFrame:
    """The stream form: ``queue, held, produced, dropped`` after each micro-batch; the state is a ring of ``capacity``."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, produced, dropped = (list(state.get[0]), *state.get[1:]) if state.exists else ([], 0, 0)
        for pdf in frames:
            held += [int(x) for x in pdf[order]]
            produced += len(pdf)
        held.sort()
        dropped += max(0, len(held) - capacity)
        held = held[-capacity:]
        state.update((held, produced, dropped))
        yield pd.DataFrame({queue: [key[0]], "held": [held], "produced": [produced], "dropped": [dropped]})

    kind = stream.schema[queue].dataType.simpleString()
    from pyspark.sql.streaming.state import GroupStateTimeout

    return stream.select(queue, order).groupBy(queue).applyInPandasWithState(step, f"{queue} {kind}, held array<long>, produced long, dropped long", "held array<long>, produced long, dropped long", "update", GroupStateTimeout.NoTimeout)


# --- staleness -----------------------------------------------------------------------------------------------------------


def staleness_budget(required: int, threshold: float, sync_every: int) -> int:
    """Samples that may be in flight before intake pauses."""
    return int(required * (threshold + 1) * sync_every)


def stale_counts(df: DataFrame, by: str, version: str, current: str) -> DataFrame:
    """``by, n, stale, max_lag``: rows at least one version behind are stale, and stay."""
    lag = F.col(current) - F.col(version)
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(lag >= 1).alias("stale"), F.max(lag).alias("max_lag"))


def assemble(df: DataFrame, order: str, required: int, queue: str) -> DataFrame:
    """``batch`` numbers of ``required`` rows a queue in order of arrival; an incomplete last batch waits."""
    w = W.partitionBy(queue)
    n = F.row_number().over(w.orderBy(order)) - 1
    rows = df.withColumn("_i", n).withColumn("_n", F.count("*").over(w)).withColumn("batch", F.floor(F.col("_i") / required).cast("int"))
    return rows.filter(F.col("batch") < F.floor(F.col("_n") / required)).drop("_i", "_n")


def resumed_first(df: DataFrame, cancelled: str, order: str, queue: str) -> DataFrame:
    """``place``: cancelled work comes before new work, each in order of arrival."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(queue).orderBy(F.desc(F.col(cancelled).cast("int")), order)))


def ready(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows whose fields have all arrived: an inner join of the streams (or tables) of fields on the key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key)
    return out


def token_bucket(df: DataFrame, order: str, tokens: str, queue: str, rate: float, capacity: float) -> DataFrame:
    """``wait`` of each request: seconds until the bucket, refilled at ``rate`` up to ``capacity``, lets it through.

    Requests take their tokens in order, so a level below 0 is a debt that later ones wait for. A fold over a queue's
    requests; queues are independent.
    """
    packed = df.groupBy(queue).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("double").alias("t"), F.col(tokens).cast("double").alias("n")))).alias("r"))

    def step(s, x):
        level = F.least(F.lit(float(capacity)), s["level"] + (x["t"] - s["t"]) * rate) - x["n"]
        own = F.array(F.struct(x["t"].alias("t"), x["n"].alias("n"), F.greatest(F.lit(0.0), -level / rate).alias("wait")))
        return F.struct(level.alias("level"), x["t"].alias("t"), F.concat(s["out"], own).alias("out"))

    zero = F.struct(F.lit(float(capacity)).alias("level"), F.lit(0.0).alias("t"), F.array().cast("array<struct<t:double,n:double,wait:double>>").alias("out"))
    return packed.select(queue, F.explode(F.aggregate("r", zero, step, lambda s: s["out"])).alias("x")).select(queue, "x.*")


def for_each_batch(stream: DataFrame, f: Callable[[DataFrame, int], None], where: str | None = None) -> None:
    """Run ``f`` on every micro-batch of what is there: growth of datasets, curricula, feedback."""
    where = where or state_folder(stream.sparkSession)
    stream.writeStream.foreachBatch(f).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()


def gets(items: DataFrame, calls: DataFrame, queue: str, order: str, call: str) -> DataFrame:
    """``queue, call, item``: the oldest row that is left for each call; null for calls after the last row."""
    rows = items.select(queue, F.col(order).alias("item"), F.row_number().over(W.partitionBy(queue).orderBy(order)).alias("_k"))
    asked = calls.select(queue, call, F.row_number().over(W.partitionBy(queue).orderBy(call)).alias("_k"))
    return asked.join(rows, [queue, "_k"], "left").select(queue, call, "item")


def version_advances(df: DataFrame, queue: str, version: str, produced: str, consumed: str, active: str, elapsed: str) -> DataFrame:
    """``staleness`` after each advance of the version, which is what is outstanding then, and the ``idle_ratio`` before it."""
    w = W.partitionBy(queue).orderBy(version).rowsBetween(W.unboundedPreceding, 0)
    left = F.sum(F.col(produced) - F.col(consumed)).over(w)
    return df.select(queue, version, left.alias("staleness"), (1.0 - F.col(active) / F.col(elapsed)).alias("idle_ratio"))
