"""Advantage estimators, registered by name.

Sequence estimators take a row a response (``uid, sample_id, score`` and, for some, ``length``) and add ``adv``; a token's
advantage is ``adv`` times its mask. Token estimators take a row a token (``uid, sample_id, pos, reward, value, mask``)
and add ``adv`` and ``ret``. Groups are window partitions, so a group's size is its number of responses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.groups import mean_std_count
from tessella.operators.masked import whiten

ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    def add(f):
        if ESTIMATORS.setdefault(name, f) is not f:
            raise ValueError(f"{name} is registered already")
        return f

    return add


def estimate(name: str, df: DataFrame, **how) -> DataFrame:
    if name not in ESTIMATORS:
        raise ValueError(f"no such estimator: {name}; there are {sorted(ESTIMATORS)}")
    return ESTIMATORS[name](df, **how)


def _group():
    w = W.partitionBy("uid")
    return F.count("*").over(w), F.avg("score").over(w), F.stddev_samp("score").over(w), F.sum("score").over(w)


@register("grpo")
def grpo(df: DataFrame, normalise: bool = True, eps: float = 1e-6) -> DataFrame:
    """Score less group mean, over group std; a single response keeps its score over 1."""
    n, mean, std, _ = _group()
    centred = F.col("score") - F.when(n == 1, 0.0).otherwise(mean)
    return df.withColumn("adv", centred / (F.when(n == 1, 1.0).otherwise(std) + eps) if normalise else centred)


@register("grpo_vectorized")
def grpo_vectorized(df: DataFrame, normalise: bool = True, eps: float = 1e-6) -> DataFrame:
    """As ``grpo``, with the variance floored at eps in place of eps added to the std."""
    mean, std, _ = mean_std_count("score", "uid", eps)
    return df.withColumn("adv", (F.col("score") - mean) / (std + eps) if normalise else F.col("score") - mean)


@register("grpo_passk")
def grpo_passk(df: DataFrame, normalise: bool = True, eps: float = 1e-6) -> DataFrame:
    """Only a group's best response has an advantage, its lead over the second; a group of one is an error."""
    n, _, std, _ = _group()
    by = W.partitionBy("uid").orderBy(F.desc("score"), "sample_id")
    lead = F.col("score") - F.lead("score").over(by)
    best = F.row_number().over(by) == 1
    alone = F.raise_error(F.lit("pass@k needs two responses a group")).cast("double")
    return df.withColumn("adv", F.when(n < 2, alone).when(best, lead / (std + eps) if normalise else lead).otherwise(0.0))


@register("rloo")
def rloo(df: DataFrame) -> DataFrame:
    """Score less the mean of the others; a single response keeps its score."""
    n, mean, _, _ = _group()
    return df.withColumn("adv", F.when(n == 1, F.col("score")).otherwise(n / F.greatest(n - 1, F.lit(1)) * (F.col("score") - mean)))


@register("rloo_vectorized")
def rloo_vectorized(df: DataFrame) -> DataFrame:
    """As ``rloo``, but 0 for a single response."""
    n, _, _, total = _group()
    return df.withColumn("adv", (n * F.col("score") - total) / F.greatest(n - 1, F.lit(1)) * (n > 1).cast("int"))


@register("opo")
def opo(df: DataFrame) -> DataFrame:
    """Score less the length-weighted mean of the group; baseline 0 for a single response."""
    w = W.partitionBy("uid")
    base = F.try_divide(F.sum(F.col("length") * F.col("score")).over(w), F.sum("length").over(w))
    return df.withColumn("adv", F.col("score") - F.when(F.count("*").over(w) == 1, 0.0).otherwise(base))


@register("gpg")
def gpg(df: DataFrame, f_norm: float = 1.0) -> DataFrame:
    """``alpha * (score - mean) / f_norm`` with alpha the batch's rows over its non-zero scores."""
    n, mean, _, _ = _group()
    alpha = df.agg((F.count("*") / F.greatest(F.count_if(F.col("score") != 0), F.lit(1))).alias("_alpha"))
    centred = F.col("score") - F.when(n == 1, 0.0).otherwise(mean)
    return df.crossJoin(F.broadcast(alpha)).withColumn("adv", F.col("_alpha") * centred / f_norm).drop("_alpha")


@register("reinforce_plus_plus_baseline")
def reinforce_plus_plus_baseline(tokens: DataFrame, seqs: DataFrame) -> DataFrame:
    """Group-centred scores on every token, whitened over all masked tokens, then masked."""
    n, mean, _, _ = _group()
    centred = seqs.select("sample_id", (F.col("score") - F.when(n == 1, 0.0).otherwise(mean)).alias("_c"))
    out = whiten(tokens.join(centred, "sample_id"), "_c", "mask", "adv")
    return out.withColumn("adv", F.col("adv") * F.col("mask")).withColumn("ret", F.col("adv")).drop("_c")


def arrays(tokens: DataFrame, *columns: str) -> DataFrame:
    """A row a sample: arrays of its tokens' columns, in order of ``pos``."""
    packed = F.array_sort(F.collect_list(F.struct("pos", *columns)))
    return tokens.groupBy("uid", "sample_id").agg(packed.alias("t"))


def _scanned(tokens: DataFrame, columns: list[str], scan: Callable[..., np.ndarray], name: str) -> DataFrame:
    """Tokens with what a scan from the last to the first token of each sample gives for them, as column ``name``.

    ``scan`` gets iterators over the places of a batch of samples, from the end, and works on all of them at once, so
    time is linear in the number of tokens.
    """
    wide = arrays(tokens, *columns)
    kept = [c for c in columns if c != name]
    kinds = {c: wide.schema["t"].dataType.elementType[c].dataType.simpleString() for c in ("pos", *kept)}
    ids = {c: wide.schema[c].dataType.simpleString() for c in ("uid", "sample_id")}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, ends = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            size = np.diff(ends)
            values = {c: flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in columns}
            order = np.argsort(-size, kind="stable")  # the samples that have a j-th token from the end come first
            last, alive = ends[1:][order] - 1, np.searchsorted(-size[order], -np.arange(size.max(initial=0)), side="left")
            out = scan((last[:n] - j for j, n in enumerate(alive)), len(size), values)
            of = np.repeat(np.arange(len(size)), size)
            columns_ = [batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), flat.field("pos"), *[flat.field(c) for c in kept], pa.array(out)]
            yield pa.RecordBatch.from_arrays(columns_, [*ids, "pos", *kept, name])

    schema = ", ".join(f"{c} {k}" for c, k in (ids | kinds | {name: "double"}).items())
    return wide.select("uid", "sample_id", "t").mapInArrow(apply, schema)


@register("gae")
def gae(tokens: DataFrame, gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """Generalised advantages by a reverse scan that goes through masked tokens unchanged; returns, then whitening."""

    def scan(places: Iterator[np.ndarray], n: int, x: dict) -> np.ndarray:
        after, carried, out = np.zeros(n), np.zeros(n), np.zeros(len(x["value"]))
        for at in places:
            k, m, v = len(at), x["mask"][at], x["value"][at]
            delta = x["reward"][at] + gamma * after[:k] - v
            carried[:k] = (delta + gamma * lam * carried[:k]) * m + (1 - m) * carried[:k]
            after[:k] = v * m + (1 - m) * after[:k]
            out[at] = carried[:k]
        return out

    raw = _scanned(tokens, ["reward", "value", "mask"], scan, "raw").withColumn("ret", F.col("raw") + F.col("value"))
    return whiten(raw, "raw", "mask", "adv").drop("raw")


@register("reinforce_plus_plus")
def reinforce_plus_plus(tokens: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Discounted returns that start anew before a masked token, whitened and masked."""

    def scan(places: Iterator[np.ndarray], n: int, x: dict) -> np.ndarray:
        run, out = np.zeros(n), np.zeros(len(x["reward"]))
        for at in places:
            out[at] = x["reward"][at] + gamma * run[: len(at)]
            run[: len(at)] = out[at] * x["mask"][at]
        return out

    out = whiten(_scanned(tokens, ["reward", "mask"], scan, "ret"), "ret", "mask", "adv")
    return out.withColumn("adv", F.col("adv") * F.col("mask"))


def returns(tokens: DataFrame) -> DataFrame:
    """``ret``: the masked rewards from each token on."""
    w = W.partitionBy("sample_id").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0)
    return tokens.withColumn("ret", F.sum(F.col("reward") * F.col("mask")).over(w))


@register("remax")
def remax(tokens: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Returns less the sample's baseline, a column."""
    return returns(tokens).withColumn("adv", F.col("ret") - F.col(baseline) * F.col("mask"))


@register("optimal_token_baseline")
def optimal_token_baseline(tokens: DataFrame, zero_tail: bool = False, weights: str | None = None, eps: float = 1e-8, compact: bool = False) -> DataFrame:
    """Baselines for every position of a group, weighted by path variance. Needs ``old_lp`` and ``sum_pi2``.

    With ``compact`` positions count masked-in tokens only, for texts of several turns. ``zero_tail`` leaves the part
    of a group's one longest response beyond the second longest without a baseline.
    """
    w = 1 - 2 * F.exp("old_lp") + F.col("sum_pi2")
    if weights:
        w = w * F.col(weights) * F.col(weights)
    so_far = W.partitionBy("sample_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = returns(tokens).withColumn("_w", F.sum(w * F.col("mask")).over(so_far))
    rows = rows.withColumn("_at", F.sum("mask").over(so_far) - 1 if compact else F.col("pos"))
    if compact:
        rows = rows.withColumn("_at", F.when(F.col("mask") != 0, F.col("_at")))
    here = W.partitionBy("uid", "_at")
    base = F.sum(F.col("ret") * F.col("_w") * F.col("mask")).over(here) / (F.sum(F.col("_w") * F.col("mask")).over(here) + eps)
    per = tokens.groupBy("uid", "sample_id").agg(F.sum("mask").alias("_len"))
    group = per.groupBy("uid").agg(F.count("*").alias("_n"), F.max("_len").alias("_max"), F.count("*").alias("_c"))
    second = per.join(group.select("uid", "_max"), "uid").groupBy("uid").agg(F.count_if(F.col("_len") == F.col("_max")).alias("_tops"), F.max(F.when(F.col("_len") < F.col("_max"), F.col("_len"))).alias("_second"))
    rows = rows.join(per.join(group.drop("_c"), "uid").join(second, "uid").drop("uid"), "sample_id")
    cut = (F.col("_tops") == 1) & (F.col("_len") == F.col("_max")) & (F.col("_at") >= F.col("_second"))
    base = F.when(F.col("_n") == 1, 0.0).when(cut & F.lit(zero_tail), 0.0).otherwise(base)
    rows = rows.withColumn("_b", base)
    return rows.withColumn("adv", (F.col("ret") - F.when(F.col("mask") != 0, F.col("_b")).otherwise(0.0)) * F.col("mask")).drop("_w", "_at", "_len", "_n", "_max", "_tops", "_second", "_b")


def response_mask(df: DataFrame, is_eos: str, order: str = "pos", sample: str = "sample_id") -> DataFrame:
    """``mask``: 1 up to and including the first end token."""
    w = W.partitionBy(sample).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("mask", (F.sum(is_eos).over(w) - F.col(is_eos) == 0).cast("int"))


def position_ids(df: DataFrame, attention: str, order: str = "pos", sample: str = "sample_id") -> DataFrame:
    w = W.partitionBy(sample).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("position_id", F.greatest(F.sum(attention).over(w) - 1, F.lit(0)))


def resample_weights(df: DataFrame, score: str, method: str = "pow", power: float = 2.0) -> DataFrame:
    """``weight`` of each response for resampling: ``pow``, ``max_min`` (the extremes) or ``max_random``."""
    s = F.col(score)
    if method == "pow":
        return df.withColumn("weight", F.pow(F.abs(s), F.lit(power)) + 1e-8)
    ends = df.agg(F.max(score).alias("_hi"), F.min(score).alias("_lo"))
    if method == "max_min":
        w = F.when((s == F.col("_hi")) | (s == F.col("_lo")), 1.0).otherwise(0.0)
    elif method == "max_random":
        w = F.when(s == F.col("_hi"), 0.4).otherwise(0.1)
    else:
        raise ValueError(f"no such method: {method}")
    return df.crossJoin(F.broadcast(ends)).withColumn("weight", w + 1e-8).drop("_hi", "_lo")
