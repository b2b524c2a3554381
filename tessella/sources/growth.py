"""A dataset that grows while it is read: parts are only ever added, and a manifest says which ones a version has.

Each version is one file of the manifest, which names the part that it adds. A version is written under its number and
fails if that is taken, so two writers cannot both make it: the later one sees the new last version and tries the next.
A reader's snapshot is the parts up to its version, so an epoch reads the same rows however much is added meanwhile, and
a part whose writer died before its manifest entry is in no version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, part string, n_rows long"
ATTEMPTS = 100


class GrowingDataset:
    """A folder that executors share. ``keep`` filters what is appended, such as over-long prompts."""

    def __init__(self, spark: SparkSession, where: str, schema, keep: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.where, self.schema, self.keep = spark, where.rstrip("/"), schema, keep

    def versions(self) -> DataFrame:
        """``version, part, n_rows``, a row for each version; versions are numbered from 1."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.where}/manifest")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(f"{self.where}/manifest")

    def last(self) -> int:
        return self.versions().agg(F.max("version")).first()[0] or 0

    def append(self, rows: DataFrame) -> int:
        """Add the rows that ``keep`` lets through; returns the version that has them."""
        part = f"data/{uuid.uuid4().hex}"
        (self.keep(rows) if self.keep else rows).select(*[f.name for f in self.schema]).write.parquet(f"{self.where}/{part}")
        n = self.spark.read.schema(self.schema).parquet(f"{self.where}/{part}").count()
        version = self.last()
        for _ in range(ATTEMPTS):
            version += 1
            entry = self.spark.createDataFrame([(version, part, n)], MANIFEST).coalesce(1)
            try:
                entry.write.mode("error").json(f"{self.where}/manifest/{version:012d}")
                return version
            except AnalysisException as e:
                if e.getCondition() != "PATH_ALREADY_EXISTS":
                    raise
        raise RuntimeError(f"no free version after {ATTEMPTS} attempts")

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one by default; parts added later are not in it."""
        upto = self.last() if version is None else version
        parts = [f"{self.where}/{r.part}" for r in self.versions().filter(F.col("version") <= upto).select("part").collect()]
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def on_batch_end(self, generate: Callable[[DataFrame], DataFrame], version: int | None = None) -> int:
        """Append what ``generate`` makes of a snapshot."""
        return self.append(generate(self.snapshot(version)))
