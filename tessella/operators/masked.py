"""Masked aggregates over tokens, in the long layout (a row a token) and as arrays.

A value outside the mask becomes 0 first, so NaN there is harmless; NaN inside goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def inside(value: Column | str, mask: Column | str) -> Column:
    v, m = (F.col(x) if isinstance(x, str) else x for x in (value, mask))
    return F.when(m != 0, v * m).otherwise(0.0)


def masked_sum(value, mask) -> Column:
    """An aggregate."""
    return F.sum(inside(value, mask))


def masked_mean(value, mask) -> Column:
    """An aggregate, with EPS in the denominator."""
    m = F.col(mask) if isinstance(mask, str) else mask
    return masked_sum(value, mask) / (F.sum(m) + EPS)


def masked_var(df: DataFrame, value: str, mask: str, unbiased: bool = True) -> DataFrame:
    """``mean, var, n`` of all tokens, in two passes; a mask of sum 0 or, if unbiased, 1 is an error."""
    mean = df.agg(masked_mean(value, mask).alias("mean"), F.sum(mask).alias("n"))
    rows = df.select(value, mask).crossJoin(F.broadcast(mean))  # one row
    var = rows.agg(masked_mean((F.col(value) - F.col("mean")) * (F.col(value) - F.col("mean")), F.col(mask)).alias("var"), F.max("mean").alias("mean"), F.max("n").alias("n"))
    bad = F.coalesce(F.col("n") <= (1 if unbiased else 0), F.lit(True))
    factor = F.try_divide(F.col("n"), F.col("n") - 1) if unbiased else F.lit(1.0)
    return var.select("mean", F.when(bad, F.raise_error(F.lit("the mask's sum is too small for a variance")).cast("double")).otherwise(F.col("var") * factor).alias("var"), "n")


def whiten(df: DataFrame, value: str, mask: str, out: str, shift_mean: bool = True) -> DataFrame:
    """``(x - mean) / sqrt(var + EPS)`` with the statistics of all masked tokens; without ``shift_mean``, the mean is added again."""
    stats = masked_var(df, value, mask).select(F.col("mean").alias("_mean"), F.col("var").alias("_var"))
    z = (F.col(value) - F.col("_mean")) / F.sqrt(F.col("_var") + EPS)
    return df.crossJoin(F.broadcast(stats)).withColumn(out, z if shift_mean else z + F.col("_mean")).drop("_mean", "_var")


def array_masked_sum(values: Column, mask: Column) -> Column:
    return F.aggregate(F.zip_with(values, mask, lambda v, m: F.when(m != 0, v * m).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def array_masked_mean(values: Column, mask: Column) -> Column:
    return array_masked_sum(values, mask) / (F.aggregate(mask, F.lit(0.0), lambda s, x: s + x) + EPS)


AGGREGATIONS = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")


def aggregate_loss(df: DataFrame, loss: str, mask: str, sample: str, mode: str, scale: float | None = None) -> DataFrame:
    """One row, ``loss``. Fully masked samples do not count as samples, except with ``-norm``, where every sample's sum
    is divided by ``scale``, by default the longest sample's number of tokens."""
    if mode == "token-mean":
        return df.agg(F.try_divide(masked_sum(loss, mask), F.sum(mask)).alias("loss"))
    if mode not in AGGREGATIONS:
        raise ValueError(f"no such mode: {mode}")
    per = df.groupBy(sample).agg(masked_sum(loss, mask).alias("_s"), F.sum(mask).alias("_n"), F.count("*").alias("_w"))
    some = F.when(F.col("_n") > 0, 1.0).otherwise(0.0)
    if mode == "seq-mean-token-sum":
        return per.agg(F.try_divide(F.sum(F.col("_s") * some), F.sum(some)).alias("loss"))
    if mode == "seq-mean-token-mean":
        return per.agg(F.try_divide(F.sum(F.col("_s") / (F.col("_n") + EPS) * some), F.sum(some)).alias("loss"))
    return per.agg((F.sum("_s") / (F.lit(scale) if scale else F.max("_w"))).alias("loss"))
