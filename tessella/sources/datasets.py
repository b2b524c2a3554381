"""Readers, writers and the records of the training schema."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING = "-"
# The columns of a raw corpus, in order.
RAW = ("idx", "kind", "dataset", "answer", "elo", "prompt", "description", "tests", "embedding", "system")

READERS: dict[str, Callable[..., DataFrame]] = {
    ".parquet": lambda spark, paths, **o: spark.read.parquet(*paths),
    ".jsonl": lambda spark, paths, schema=None, **o: (spark.read.schema(schema) if schema else spark.read).json(list(paths)),
    ".json": lambda spark, paths, schema=None, **o: (spark.read.schema(schema) if schema else spark.read).option("multiLine", True).json(list(paths)),
}
DATASETS: dict[str, Callable[[SparkSession], DataFrame]] = {}


def read(spark: SparkSession, paths: str | Sequence[str], schema=None) -> DataFrame:
    """Files of one kind, by suffix; another suffix is an error. ``_file`` is the place of a row's file in ``paths``."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    kinds = {os.path.splitext(p.rstrip("/"))[1] for p in paths}
    if len(kinds) != 1 or not kinds <= READERS.keys():
        raise ValueError(f"cannot read files of kind {sorted(kinds)}")
    return READERS[kinds.pop()](spark, paths, schema=schema)


def read_in_order(spark: SparkSession, paths: Sequence[str], schema=None) -> DataFrame:
    """Several files, each row with ``_file``, the place of its file."""
    out = None
    for i, p in enumerate(paths):
        one = read(spark, p, schema).withColumn("_file", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def register(name: str):
    def add(f):
        DATASETS[name] = f
        return f

    return add


def load(spark: SparkSession, name: str) -> DataFrame:
    if name not in DATASETS:
        raise ValueError(f"no such dataset: {name}; there are {sorted(DATASETS)}")
    return DATASETS[name](spark)


def step_dumps(spark: SparkSession, folder: str) -> DataFrame:
    """``<step>.jsonl`` files of a folder with ``step``; rows of a file are numbered by ``idx`` if they carry one."""
    return spark.read.json(f"{folder}/*.jsonl").withColumn("step", F.regexp_extract(F.input_file_name(), r"(\d+)\.jsonl", 1).cast("int"))


def raw_corpus(df: DataFrame) -> DataFrame:
    """The columns of RAW that exist or have a default; a missing or null text is the sentinel."""
    for c in ("kind", "dataset", "answer", "elo", "prompt", "description", "tests", "system"):
        df = df.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) if c in df.columns else F.lit(MISSING))
    return df.select(*[c for c in RAW if c in df.columns])


def messages(prompt: Column, system: str | None = None) -> Column:
    said = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    return F.array(*([said("system", F.lit(system))] if system else []), said("user", prompt))


def training_record(df: DataFrame, index: str, split: str, system: str | None = None, ability: str = MISSING) -> DataFrame:
    """The five fields of the training schema; the ground truth of code is its tests, else the answer."""
    truth = F.when(F.col("kind") == "code", F.col("tests")).otherwise(F.col("answer"))
    return df.select(
        index,
        F.col("dataset").alias("data_source"),
        messages(F.col("prompt"), system).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col(index).cast("string").alias("index")).alias("extra_info"),
    )


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_steps(df: DataFrame, path: str, step: str = "step") -> None:
    """Generation dumps, a folder a step."""
    df.write.mode("overwrite").partitionBy(step).json(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, made and written first if it is not there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def json_array_lines(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rn, line``: the lines of one JSON array of all rows, in order; no task holds more than its own rows."""
    from tessella.operators.batch import with_ordinal

    n = df.count()
    rows = with_ordinal(df, order, "rn")
    line = F.concat(F.when(F.col("rn") == 0, "[").otherwise(","), F.to_json(F.struct(*df.columns)), F.when(F.col("rn") == n - 1, "]").otherwise(""))
    return rows.select("rn", line.alias("line"))


def parse_json_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank ones are skipped."""
    return lines.filter(F.trim(column) != "").select(F.from_json(column, schema).alias("_r")).select("_r.*")


def example(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``json``: the first row by key."""
    return df.orderBy(*order).limit(1).select(F.to_json(F.struct(*df.columns)).alias("json"))


def traced(df: DataFrame, step: str, sample: str, most: int, seed: str = "0") -> DataFrame:
    """All rows of ``most`` sample ids of each step, drawn by a digest."""
    from pyspark.sql import Window as W

    ids = df.select(step, sample).distinct()
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col(step).cast("string"), F.col(sample).cast("string")).cast("binary"))
    chosen = ids.withColumn("_k", F.row_number().over(W.partitionBy(step).orderBy(digest, sample))).filter(F.col("_k") <= most).drop("_k")
    return df.join(chosen, [step, sample], "left_semi")
