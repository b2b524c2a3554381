"""Intermediate tables in the folder that the cluster shares.

Tables are written as Parquet below ``spark.checkpoint.dir``, so a lost executor costs the tasks that it ran and not the
lineage before the table. Where that setting is unset, a local master uses a folder of this process, and any other one
is an error, as its executors would each write to a disk of their own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own.setdefault("dir", tempfile.mkdtemp(prefix="tessella-"))


def save(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` and read it back: the plan before it is cut, and several readers share one computation.

    ``options`` are those of the Parquet writer.
    """
    path = f"{folder(df.sparkSession)}/tessella-{uuid.uuid4().hex}/{label}"
    df.write.options(**options).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._tessella_path = path
    return back


def drop(df: DataFrame) -> None:
    """Delete a saved table that nothing reads any more."""
    if path := getattr(df, "_tessella_path", None):
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p.getParent(), True)


def join_keyed(rows: DataFrame, keyed: DataFrame, key: str, weight: str, small: int = 50_000, hot_keys: int = 1_000) -> DataFrame:
    """``rows`` joined with a saved table of one row a key, where ``weight`` says how many of the rows have the key.

    A table of at most ``small`` rows is broadcast. Of a larger one the heaviest keys are: those with at least one in
    ``hot_keys`` of all rows, of which there cannot be more than that. So no task gets all rows of a heavy key.
    """
    found = keyed.agg(F.count("*"), F.sum(weight)).first()
    if found[0] <= small:
        return rows.join(F.broadcast(keyed), key)
    cut = max(256, -(-found[1] // hot_keys))
    hot, rest = F.broadcast(keyed.filter(F.col(weight) >= cut)), keyed.filter(F.col(weight) < cut)
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(keyed.filter(F.col(weight) >= cut).select(key)), key, "left_anti").join(rest, key))


def broadcast_if_small(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """A broadcast hint behind a count of the saved table; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
