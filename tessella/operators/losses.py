"""Policy and value losses as forward values, registered by name.

Tokens have ``sample_id, pos, old_lp, lp, adv, mask`` and optionally ``is_weight``. Each loss adds ``loss`` to tokens (or,
for the geometric mean, to samples); ``policy_loss`` reduces it to one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.batch import with_ordinal
from tessella.operators.correction import clamp
from tessella.operators.masked import aggregate_loss, masked_mean

LOSSES: dict[str, tuple[Callable[..., DataFrame], str | None]] = {}


def register(name: str, mode: str | None = None):
    def add(f):
        LOSSES[name] = (f, mode)
        return f

    return add


def policy_loss(name: str, tokens: DataFrame, mode: str = "token-mean", weights: str | None = None, **how) -> DataFrame:
    """``loss``, one row. Some losses fix their own mode of aggregation."""
    if name not in LOSSES:
        raise ValueError(f"no such loss: {name}; there are {sorted(LOSSES)}")
    f, fixed = LOSSES[name]
    out = f(tokens, **how)
    if fixed == "samples":
        return out.agg(F.avg("loss").alias("loss"))
    if weights:
        out = out.withColumn("loss", F.col("loss") * F.col(weights))
    return aggregate_loss(out, "loss", "mask", "sample_id", fixed or mode)


def ratio() -> Column:
    return F.exp(clamp(F.col("lp") - F.col("old_lp")))


def _clipped(r: Column, low: float, high: float) -> Column:
    a = F.col("adv")
    return F.greatest(-a * r, -a * clamp(r, 1 - low, 1 + high))


@register("vanilla")
def vanilla(t: DataFrame, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> DataFrame:
    """Clipped ratio, and for negative advantages at most ``dual`` times the advantage."""
    worst = _clipped(ratio(), low, high)
    return t.withColumn("loss", F.when(F.col("adv") < 0, F.least(-F.col("adv") * dual, worst)).otherwise(worst))


def clip_fractions(t: DataFrame, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> DataFrame:
    """``clipfrac, clipfrac_lower, ppo_kl``, one row."""
    a, m = F.col("adv"), F.col("mask")
    first, worst = -a * ratio(), _clipped(ratio(), low, high)
    over = (-a * clamp(ratio(), 1 - low, 1 + high) > first).cast("double")
    lower = ((worst > -a * dual) & (a < 0)).cast("double")
    return t.agg(masked_mean(over, m).alias("clipfrac"), masked_mean(lower, m).alias("clipfrac_lower"), masked_mean(-clamp(F.col("lp") - F.col("old_lp")), m).alias("ppo_kl"))


def _mean_over_sample(x: Column, floor: bool = True) -> Column:
    w = W.partitionBy("sample_id")
    n = F.sum("mask").over(w)
    return F.sum(x * F.col("mask")).over(w) / (F.greatest(n, F.lit(1)) if floor else n + 1e-8)


@register("gspo", "seq-mean-token-mean")
def gspo(t: DataFrame, low: float = 3e-4, high: float = 4e-4) -> DataFrame:
    """One ratio a sequence: the exponential of the mean log-ratio."""
    t = t.withColumn("_r", F.exp(F.least(_mean_over_sample(F.col("lp") - F.col("old_lp")), F.lit(10.0))))
    return t.withColumn("loss", _clipped(F.col("_r"), low, high)).drop("_r")


@register("sapo", "seq-mean-token-mean")
def sapo(t: DataFrame, tau_pos: float = 1.0, tau_neg: float = 1.05) -> DataFrame:
    """A sigmoid gate around ratio 1 in place of the clip."""
    tau = F.when(F.col("adv") > 0, tau_pos).otherwise(tau_neg)
    gate = 4 / tau / (1 + F.exp(-tau * (ratio() - 1)))
    return t.withColumn("loss", -gate * F.col("adv"))


@register("gpg")
def gpg(t: DataFrame) -> DataFrame:
    return t.withColumn("loss", -F.col("lp") * F.col("adv"))


@register("cispo")
def cispo(t: DataFrame, low: float = 0.2, high: float = 0.2) -> DataFrame:
    return t.withColumn("loss", -clamp(ratio(), 1 - low, 1 + high) * F.col("adv") * F.col("lp"))


@register("reinforce")
def reinforce(t: DataFrame) -> DataFrame:
    return t.withColumn("loss", -F.col("adv") * F.col("lp"))


@register("geo_mean", "samples")
def geo_mean(t: DataFrame, low: float = 0.4, high: float = 0.4) -> DataFrame:
    """A row a sample: mean advantage times the geometric mean of ratios clipped on the advantage's side."""
    d, sign = clamp(F.col("lp") - F.col("old_lp")), F.signum("adv")
    side = sign * F.least(sign * d, sign * clamp(d, -low, high))
    n = F.sum("mask") + 1e-8
    return t.groupBy("sample_id").agg((-(F.sum(F.col("adv") * F.col("mask")) / n) * F.exp(F.sum(side * F.col("mask")) / n)).alias("loss"))


def _covariance(t: DataFrame) -> DataFrame:
    means = t.agg(masked_mean("adv", "mask").alias("_a"), masked_mean("lp", "mask").alias("_l"))
    return t.crossJoin(F.broadcast(means)).withColumn("cov", (F.col("adv") - F.col("_a")) * (F.col("lp") - F.col("_l"))).drop("_a", "_l")


@register("kl_cov")
def kl_cov(t: DataFrame, share: float = 0.0002, coef: float = 1.0) -> DataFrame:
    """The tokens of largest covariance, a share of all, get a KL penalty. Ties by sample and position.

    Ranks come from ranges of the covariance, so no task gets all of a share that grows with the tokens.
    """
    rows = _covariance(t)
    k = max(1, int(t.agg(F.sum("mask")).first()[0] * share))
    top = with_ordinal(rows.filter("mask <> 0").select("cov", "sample_id", "pos"), [F.desc("cov"), "sample_id", "pos"], "_o").filter(F.col("_o") < k).select(F.col("sample_id").alias("_s"), F.col("pos").alias("_p"))
    plain = -F.col("adv") * F.exp(F.col("lp") - F.col("old_lp"))
    out = rows.join(top, (F.col("sample_id") == F.col("_s")) & (F.col("pos") == F.col("_p")), "left")
    return out.withColumn("loss", plain + F.when(F.col("_s").isNotNull(), coef * F.abs(F.col("lp") - F.col("old_lp"))).otherwise(0.0)).drop("_s", "_p", "cov")


@register("clip_cov")
def clip_cov(t: DataFrame, share: float = 0.0002, lower: float = 1.0, upper: float = 5.0, low: float = 0.2, high: float = 0.2, seed: str = "clip") -> DataFrame:
    """Of the unclipped tokens with a covariance between the bounds, some drawn by a digest, do not count."""
    rows = _covariance(t)
    a, r = F.col("adv"), ratio()
    clipped = -a * clamp(r, 1 - low, 1 + high) > -a * r
    k = max(1, int(t.agg(F.sum("mask")).first()[0] * share))
    draw = F.md5(F.concat_ws("|", F.lit(seed), "sample_id", "pos").cast("binary"))
    able = rows.filter((F.col("mask") != 0) & ~clipped & (F.col("cov") > lower) & (F.col("cov") < upper))
    drawn = with_ordinal(able.select(draw.alias("_d"), "sample_id", "pos"), ["_d", "sample_id", "pos"], "_o").filter(F.col("_o") < k).select(F.col("sample_id").alias("_s"), F.col("pos").alias("_p"))
    out = rows.join(drawn, (F.col("sample_id") == F.col("_s")) & (F.col("pos") == F.col("_p")), "left")
    return out.withColumn("loss", F.when(F.col("_s").isNotNull(), 0.0).otherwise(_clipped(r, low, high))).drop("_s", "_p", "cov")


def value_loss(t: DataFrame, new: str = "new_value", old: str = "value", ret: str = "ret", clip: float = 0.5, mode: str = "token-mean") -> DataFrame:
    """``loss, clipfrac``: half the larger squared error of the value and of the value clipped around the old one."""
    v = F.col(new)
    near = F.least(F.greatest(v, F.col(old) - clip), F.col(old) + clip)
    plain, held = (v - F.col(ret)) * (v - F.col(ret)), (near - F.col(ret)) * (near - F.col(ret))
    out = t.withColumn("loss", 0.5 * F.greatest(plain, held)).withColumn("_c", (held > plain).cast("double"))
    return aggregate_loss(out, "loss", "mask", "sample_id", mode).crossJoin(out.agg(masked_mean("_c", "mask").alias("clipfrac")))


def log_sum_exp(x: Column) -> Column:
    top = F.array_max(x)
    return top + F.ln(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


def log_softmax_at(logits: Column, index: Column) -> Column:
    """The log-probability of one label, counted from 0."""
    return F.element_at(logits, (index + 1).cast("int")) - log_sum_exp(logits)


def entropy(logits: Column) -> Column:
    z = log_sum_exp(logits)
    return z - F.aggregate(logits, F.lit(0.0), lambda s, v: s + F.exp(v - z) * v)


def sum_squared_probabilities(logits: Column) -> Column:
    z = log_sum_exp(logits)
    return F.aggregate(logits, F.lit(0.0), lambda s, v: s + F.exp(2 * (v - z)))


def with_tail(log_probs: Column) -> Column:
    """A last entry for what the others leave of the probability."""
    s = F.least(log_sum_exp(log_probs), F.lit(-1e-7))
    return F.concat(log_probs, F.array(F.ln(-F.expm1(s))))


def renormalised(log_probs: Column) -> Column:
    z = log_sum_exp(log_probs)
    return F.transform(log_probs, lambda v: v - z)


def _divergence(x: Column, y: Column) -> Column:
    """Sum of exp(y) * (y - x)."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.exp(b) * (b - a)), F.lit(0.0), lambda s, v: s + v)


def distillation(student: Column, teacher: Column, alpha: float) -> Column:
    """Per token: forward KL for alpha 0, reverse KL for 1, between them the generalised Jensen-Shannon divergence."""
    if alpha == 0.0:
        return _divergence(student, teacher)
    if alpha == 1.0:
        return _divergence(teacher, student)
    mixed = F.zip_with(student, teacher, lambda a, b: F.ln(F.exp(a) * (1 - alpha) + F.exp(b) * alpha))
    return (1 - alpha) * _divergence(mixed, student) + alpha * _divergence(mixed, teacher)
