"""Statistics that are kept as mergeable sketches, a row for each step and group, so that later reports read no raw rows.

Distinct counts are HyperLogLog sketches of 2^``LG_K`` registers and quantiles KLL sketches of size ``KLL_K``; both have
a bounded size, partial states that merge map-side, and unions that are as good as a sketch of all rows. Their stated
errors hold with 99 % probability (three standard errors of the count; the published rank error of KLL).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14
KLL_K = 200
#: Relative error of a distinct count, and error of a quantile's rank.
COUNT_ERROR = 3 * 0.8326 / 2 ** (LG_K / 2)
RANK_ERROR = 0.0165


def sketch(rows: DataFrame, groups: list[str], key: str, value: str) -> DataFrame:
    """``groups, n, keys, values``: the sketches of each group. Nulls count in ``n`` only."""
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), F.hll_sketch_agg(key, LG_K).alias("keys"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("values"))


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """The sketches of coarser groups."""
    return sketches.groupBy(*groups).agg(F.sum("n").alias("n"), F.hll_union_agg("keys").alias("keys"), F.kll_merge_agg_double("values").alias("values"))


def distinct(keys: Column) -> Column:
    return F.hll_sketch_estimate(keys)


def quantile(values: Column, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(values, F.lit(q))


def rank(values: Column, value: Column) -> Column:
    """The share of values at or below ``value``."""
    return F.kll_sketch_get_rank_double(values, value)
