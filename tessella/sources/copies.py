"""Verification of copied folders by a tree of digests over their file listings.

A file's digest is that of its path below the folder and its length; a directory's is the exclusive or over all files
below it, so it needs no order and adds up from partial states. Two copies are equal if their roots are. If not, only
directories whose digests differ are looked into, down to the files. Contents are not read.

Spark lists neither empty files nor hidden ones (names that begin with ``_`` or a dot): a file that a broken copy left
empty counts as missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length`` of all files below ``folder``, paths relative to it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return files.select(F.substring_index("path", f"{root}/", -1).alias("path"), "length")


def tree(files: DataFrame) -> DataFrame:
    """``directory, depth, files, bytes, digest``: all directories of a listing; the root is the empty path."""
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda i: F.struct(F.array_join(F.slice(steps, F.lit(1), i), "/").alias("directory"), i.alias("depth")))
    rows = files.select(F.explode(above).alias("at"), "length", F.xxhash64("path", "length").alias("own"))
    return rows.groupBy("at.directory", "at.depth").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.bit_xor("own").alias("digest"))


def same(source: DataFrame, copy: DataFrame) -> bool:
    """Whether two listings have equal roots; two empty ones have."""
    a, b = ([(r.files, r.bytes, r.digest) for r in tree(x).filter("depth = 0").collect()] for x in (source, copy))
    return a == b


def differences(source: DataFrame, copy: DataFrame) -> DataFrame:
    """``path, what``: files that are ``missing`` in the copy, ``extra`` in it, or of another ``size``."""
    a, b = tree(source).alias("a"), tree(copy).alias("b")
    unequal = a.join(b, "directory", "full").filter(~(F.col("a.digest").eqNullSafe(F.col("b.digest")) & F.col("a.files").eqNullSafe(F.col("b.files")) & F.col("a.bytes").eqNullSafe(F.col("b.bytes")))).select("directory")
    parent = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    inside = lambda files, name: files.withColumn("directory", parent).join(unequal, "directory", "left_semi").select("path", F.col("length").alias(name))
    both = inside(source, "there").join(inside(copy, "here"), "path", "full")
    what = F.when(F.col("here").isNull(), "missing").when(F.col("there").isNull(), "extra").when(F.col("here") != F.col("there"), "size")
    return both.select("path", what.alias("what")).filter("what IS NOT NULL")
