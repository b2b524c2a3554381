"""Group statistics and look-ups between rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.batch import with_ordinal


def mean_std_count(score: str, group: str, eps: float = 1e-6) -> tuple[Column, Column, Column]:
    """(mean, std, count) over the group: sample std with its variance floored at ``eps``; (0, 1, 1) for one row."""
    w = W.partitionBy(group)
    n = F.count(score).over(w)
    mean = F.when(n <= 1, 0.0).otherwise(F.avg(score).over(w))
    std = F.when(n <= 1, 1.0).otherwise(F.sqrt(F.greatest(F.var_samp(score).over(w), F.lit(eps))))
    return mean, std, n


def group_index(df: DataFrame, key: str, name: str = "gidx") -> DataFrame:
    """Keys as 0, 1, ... in sorted order; the distinct keys are ranked, not the rows."""
    return df.join(with_ordinal(df.select(key).filter(F.col(key).isNotNull()).distinct(), [key], name).withColumn(name, F.col(name).cast("int")), key)


def sibling_success(df: DataFrame, group: str, key: str, success: Column, exclude_self: bool = True, name: str = "solution") -> DataFrame:
    """For each row the first successful row of its group, by ``key``, other than itself.

    The two smallest successful keys of a group decide it, so a group is aggregated and not collected.
    """
    won = df.filter(success).select(F.col(group).alias("_g"), F.col(key).alias("_k"))
    first = won.groupBy("_g").agg(F.min("_k").alias("_first"))
    second = won.join(first, "_g").filter("_k > _first").groupBy("_g").agg(F.min("_k").alias("_second"))
    both = first.join(second, "_g", "left")
    out = df.join(both, F.col(group) == F.col("_g"), "left")
    chosen = F.when(F.col("_first") != F.col(key), F.col("_first")).otherwise(F.col("_second")) if exclude_self else F.col("_first")
    return out.withColumn(name, chosen).drop("_g", "_first", "_second")


def majority(df: DataFrame, groups: list[str], label: str, value: str, order: str) -> DataFrame:
    """The value of the first row with the most frequent label of a group; of equally frequent ones, the first seen."""
    per = df.groupBy(*groups, label).agg(F.count("*").alias("_n"), F.min(order).alias("_first"), F.min_by(value, order).alias("_v"))
    return per.groupBy(*groups).agg(F.min_by(F.struct(F.col(label).alias("label"), F.col("_v").alias("value"), F.col("_n").alias("votes")), F.struct(-F.col("_n"), "_first")).alias("m")).select(*groups, "m.label", "m.value", "m.votes")
