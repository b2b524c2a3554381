"""Metric reduction, validation metrics, bootstrap and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators import resample


def adaptive_kl(steps: DataFrame, order: str, kl: str, n: str, start: float, target: float, horizon: float, limit: float = 0.2) -> DataFrame:
    """``order, beta``: the coefficient after each step, a running product of factors that do not depend on it.

    Steps are a table of one row a training step, so its one window is small.
    """
    error = F.greatest(F.least(F.col(kl) / target - 1, F.lit(limit)), F.lit(-limit))
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return steps.select(order, (start * F.exp(F.sum(F.ln(1 + error * F.col(n) / horizon)).over(w))).alias("beta"))


def reduce_by_name(metrics: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """``key, value``: the maximum where the name holds "max", else the minimum where it holds "min", else the mean."""
    return metrics.groupBy(key).agg(
        F.when(F.col(key).contains("max"), F.max(value)).when(F.col(key).contains("min"), F.min(value)).otherwise(F.avg(value)).alias(value)
    )


#: How a name says that its values are joined over steps; the first that fits counts.
STEP_RULES = (("timing_s/", "sum"), ("mean", "avg"), ("avg", "avg"), ("max", "max"), ("min", "min"), ("sum", "sum"), ("total", "sum"))


def aggregate_steps(metrics: DataFrame, explicit: dict[str, str] | None = None, key: str = "key", value: str = "value", step: str = "step") -> DataFrame:
    """``key, value`` over all steps, by explicit rules (sum, avg, max, min, last), then by name, else the mean."""
    made = {"sum": F.sum(value), "avg": F.avg(value), "max": F.max(value), "min": F.min(value), "last": F.max_by(value, step)}
    cases = [(F.col(key) == k, r) for k, r in (explicit or {}).items()]
    cases += [(F.startswith(F.col(key), F.lit(word)) if word.endswith("/") else F.col(key).contains(word), r) for word, r in STEP_RULES]
    out = None
    for test, rule in cases:
        out = F.when(test, made[rule]) if out is None else out.when(test, made[rule])
    return metrics.groupBy(key).agg(out.otherwise(made["avg"]).alias(value))


def group_sizes(n_max: int) -> list[int]:
    """2, 4, 8, ... and the largest itself."""
    out, n = [], 2
    while n < n_max:
        out.append(n)
        n *= 2
    return [*out, n_max]


def best_of(n: Column, rank: str = "_i", size: str = "_n") -> Column:
    """The weight of the rank-th smallest of ``size`` values in the expected maximum of ``n`` draws with replacement."""
    i, big = F.col(rank).cast("double"), F.col(size).cast("double")
    return F.pow(i / big, n) - F.pow((i - 1) / big, n)


def expected_extremes(rows: DataFrame, groups: list[str], value: str, sizes: list[int]) -> DataFrame:
    """``groups, n, best, worst``: the expected largest and smallest of n draws with replacement, in closed form."""
    w = W.partitionBy(*groups)
    ranked = rows.withColumn("_i", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))
    each = ranked.withColumn("n", F.explode(F.array(*[F.lit(s) for s in sizes])))
    down = each.withColumn("_j", F.col("_n") - F.col("_i") + 1)
    return down.groupBy(*groups, "n").agg(F.sum(F.col(value) * best_of(F.col("n"))).alias("best"), F.sum(F.col(value) * best_of(F.col("n"), "_j")).alias("worst"))


def bootstrap(rows: DataFrame, group: str, value: str, size: int, n: int = 1000, seed: int = 42, reduce_: str = "max") -> DataFrame:
    """``group, mean, std``: reducers of ``n`` resamples of ``size`` draws with replacement, by NumPy in one task a group."""
    import numpy as np
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.sort(pdf[value].to_numpy())
        rng = np.random.RandomState(seed)
        drawn = getattr(np, reduce_)(data[rng.randint(0, len(data), (n, size))], axis=1)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "mean": [drawn.mean()], "std": [drawn.std()]})

    kind = rows.schema[group].dataType.simpleString()
    return rows.select(group, value).groupBy(group).applyInPandas(one, f"{group} {kind}, mean double, std double")


def bootstrap_draws(rows: DataFrame, group: str, key: str, value: str, size: int, n: int = 1000, seed: str = "bootstrap-1") -> DataFrame:
    """``group, best_mean, best_std, worst_mean, worst_std, average_std``: of ``n`` resamples of ``size`` draws each.

    A draw is a digest of its group, resample and number, and names one of the group's rows by its ordinal in the order
    of ``key``. Rows get ordinals from ranges of the table, draws meet them by equality, and resamples are partial
    sums, so a group may have any number of rows and none of its parts is in one task. Deviations are of the population.
    """
    line = resample.dealt(rows.select(group, key, value), group, key)
    before = resample.before(line.groupBy("_part").agg(F.count("*").alias("n")), F.sum("n"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(group, key)) - 1
    placed = line.withColumn("_own", own).join(before, F.col("_part") == F.col("_p")).select(group, value, (F.col("_own") + F.coalesce("_of", F.lit(0))).alias("_at"))
    sizes = placed.groupBy(group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    drawn = sizes.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    name = F.concat_ws("|", F.col(group).cast("string"), F.col("_b").cast("string"), F.col("_j").cast("string"))
    drawn = drawn.select(F.col(group).alias("_g"), "_b", (F.col("_first") + F.floor(resample.uniform(name, seed) * F.col("_n"))).alias("_to"))
    each = drawn.join(placed, F.col("_to") == F.col("_at")).groupBy("_g", "_b").agg(F.max(value).alias("_hi"), F.min(value).alias("_lo"), F.avg(value).alias("_mean"))
    of = [F.avg("_hi").alias("best_mean"), F.stddev_pop("_hi").alias("best_std"), F.avg("_lo").alias("worst_mean"), F.stddev_pop("_lo").alias("worst_std"), F.stddev_pop("_mean").alias("average_std")]
    return each.groupBy(F.col("_g").alias(group)).agg(*of)


def validation(rows: DataFrame, source: str, uid: str, value: str) -> DataFrame:
    """``source, mean, std, n``: per prompt the mean and population std over its responses, then means over prompts."""
    per = rows.groupBy(source, uid).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count("*").alias("_n"))
    return per.groupBy(source).agg(F.avg("_m").alias("mean"), F.avg("_s").alias("std"), F.max("_n").alias("n"))


def drift(df: DataFrame, a: str, b: str, mask: str) -> DataFrame:
    """One row: largest, mean and std of the difference of probabilities inside the mask, and their correlation."""
    rows = df.filter(F.col(mask) != 0).select(F.exp(a).alias("p"), F.exp(b).alias("q"))
    gap = F.abs(F.col("p") - F.col("q"))
    return rows.agg(F.max(gap).alias("diff_max"), F.avg(gap).alias("diff_mean"), F.stddev_samp(gap).alias("diff_std"), F.corr("p", "q").alias("pearson"))


def accumulate(df: DataFrame, name: str, kind: str, value: str) -> DataFrame:
    """``name, kind, value``: each metric by its own kind, mean, sum, min or max; a metric of two kinds is an error."""
    v = F.col(value)
    by = F.when(F.first(kind) == "mean", F.avg(v)).when(F.first(kind) == "sum", F.sum(v)).when(F.first(kind) == "min", F.min(v)).when(F.first(kind) == "max", F.max(v))
    by = by.otherwise(F.raise_error(F.lit("no such kind of metric")).cast("double"))
    one = F.when(F.min(kind) == F.max(kind), by).otherwise(F.raise_error(F.lit("a metric of two kinds")).cast("double"))
    return df.groupBy(name).agg(F.first(kind).alias(kind), one.alias(value))
