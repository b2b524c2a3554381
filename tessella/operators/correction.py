"""Off-policy correction: importance weights, rejection rules, KL estimators and their metrics, a row a token.

Tokens have ``sample_id, pos, old_lp, rollout_lp, mask``; ``d`` is old_lp - rollout_lp.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.masked import masked_mean, masked_sum

BOUND = 20.0
RULES = tuple(f"{level}_{k}" for level in ("token", "seq_sum", "seq_mean") for k in ("k1", "k2", "k3")) + ("seq_max_k2", "seq_max_k3")


def clamp(x: Column, lo: float = -BOUND, hi: float = BOUND) -> Column:
    return F.greatest(F.least(x, F.lit(float(hi))), F.lit(float(lo)))


def log_ratio() -> Column:
    return F.col("old_lp") - F.col("rollout_lp")


def importance_weights(df: DataFrame, level: str = "token", threshold: float = 2.0, normalise: bool = False, name: str = "is_weight") -> DataFrame:
    """Masked weights, truncated above; per token or, from the clamped sum, per sequence. ``normalise`` brings the mean to 1."""
    if level == "token":
        d = clamp(log_ratio())
    elif level == "sequence":
        d = clamp(F.sum(F.when(F.col("mask") != 0, log_ratio()).otherwise(0.0)).over(W.partitionBy("sample_id")))
    else:
        raise ValueError(f"no such level: {level}")
    out = df.withColumn(name, F.least(F.exp(d) * F.col("mask"), F.lit(float(threshold))))
    if not normalise:
        return out
    if level == "token":
        mean = out.agg(masked_mean(name, "mask").alias("_m"))
    else:
        per = out.filter("mask <> 0").groupBy("sample_id").agg(F.max(name).alias("_w"))
        mean = per.agg(F.avg("_w").alias("_m"))
    return out.crossJoin(F.broadcast(mean)).withColumn(name, F.when(F.col("_m") > 1e-8, F.col(name) / F.col("_m")).otherwise(F.col(name))).drop("_m")


def estimators() -> dict[str, Column]:
    d = clamp(log_ratio())
    return {"k1": -d, "k2": 0.5 * d * d, "k3": F.exp(d) - 1 - d}


def parse_thresholds(rules: list[str], spec: str | float) -> dict[str, tuple[float | None, float]]:
    """``rule -> (lower, upper)``: one shared entry or one a rule; ``lo_hi`` for k1, whose lower is else 1 / upper."""
    parts = [p.strip() for p in str(spec).split(",") if p.strip()]
    if len(parts) not in (1, len(rules)):
        raise ValueError(f"{len(parts)} thresholds for {len(rules)} rules")
    out = {}
    for i, rule in enumerate(rules):
        if rule not in RULES:
            raise ValueError(f"no such rule: {rule}")
        text = parts[0] if len(parts) == 1 else parts[i]
        values = [float(v) for v in text.split("_")]
        if any(v <= 0 for v in values) or len(values) > 2 or (len(values) == 2 and not rule.endswith("k1")):
            raise ValueError(f"bad threshold {text} for {rule}")
        upper = values[-1]
        out[rule] = ((values[0] if len(values) == 2 else 1 / upper) if rule.endswith("k1") else None, upper)
    return out


def rejection_mask(df: DataFrame, rules: str, thresholds: str | float, name: str = "new_mask") -> DataFrame:
    """``mask`` without the tokens that a rule rejects; rules are joined by AND. k1 is two-sided in logarithms."""
    chosen = list(dict.fromkeys(r.strip() for r in rules.split(",") if r.strip()))
    limits, w, est = parse_thresholds(chosen, thresholds), W.partitionBy("sample_id"), estimators()
    keep = F.lit(True)
    out = df.withColumns({f"_{k}": v for k, v in est.items()})
    for rule in chosen:
        level, _, k = rule.rpartition("_")
        v, (lower, upper) = F.col(f"_{k}"), limits[rule]
        inside = F.when(F.col("mask") != 0, v)
        total = F.coalesce(F.sum(inside).over(w), F.lit(0.0))
        stat = {"token": v, "seq_sum": total, "seq_mean": total / (F.sum("mask").over(w) + 1e-8), "seq_max": F.coalesce(F.max(inside).over(w), F.lit(0.0))}[level]
        ok = (stat >= math.log(lower)) & (stat <= math.log(upper)) if k == "k1" else stat <= upper
        keep = keep & ok
    return out.withColumn(name, F.col("mask") * keep.cast("int")).drop(*[f"_{k}" for k in est])


def rejection_metrics(df: DataFrame, new_mask: str = "new_mask") -> DataFrame:
    """``masked_fraction, seq_masked_fraction``: of tokens, and of sequences that lost one."""
    lost = (F.col("mask") != 0) & (F.col(new_mask) == 0)
    per = df.groupBy("sample_id").agg(F.count_if(lost).alias("_lost"), F.sum("mask").alias("_n"))
    return per.agg((F.sum("_lost") / (F.sum("_n") + 1e-8)).alias("masked_fraction"), F.avg(F.when(F.col("_lost") > 0, 1.0).otherwise(0.0)).alias("seq_masked_fraction"))


def correct(df: DataFrame, level: str | None = "token", threshold: float = 2.0, rules: str | None = None, rs_threshold: str | float = 2.0) -> DataFrame:
    """Weights (1 without ``level``) and the new mask (the mask without ``rules``)."""
    out = importance_weights(df, level, threshold) if level else df.withColumn("is_weight", F.lit(1.0))
    return rejection_mask(out, rules, rs_threshold) if rules else out.withColumn("new_mask", F.col("mask"))


def bypass(df: DataFrame) -> DataFrame:
    """The rollout's log-probabilities stand for the old ones."""
    return df.withColumn("old_lp", F.col("rollout_lp"))


# Named settings of ``correct``; bypassing ones take the rollout's log-probabilities for the old ones.
PRESETS: dict[str, dict] = {
    "decoupled_token_is": {"level": "token", "threshold": 2.0},
    "decoupled_seq_is": {"level": "sequence", "threshold": 2.0},
    "decoupled_seq_is_rs": {"level": "sequence", "threshold": 2.0, "rules": "seq_sum_k1", "rs_threshold": "0.5_2.0"},
    "decoupled_geo_rs": {"level": None, "rules": "seq_mean_k1", "rs_threshold": "0.999_1.001"},
    "bypass_ppo_clip": {"level": None, "bypass": True, "loss": "ppo_clip"},
    "bypass_ppo_clip_geo_rs": {"level": None, "rules": "seq_mean_k1", "rs_threshold": "0.999_1.001", "bypass": True, "loss": "ppo_clip"},
    "bypass_ppo_clip_k3_rs": {"level": None, "rules": "seq_mean_k3", "rs_threshold": 0.01, "bypass": True, "loss": "ppo_clip"},
    "bypass_pg_is": {"level": "sequence", "threshold": 2.0, "bypass": True, "loss": "reinforce"},
    "bypass_pg_geo_rs": {"level": None, "rules": "seq_mean_k1", "rs_threshold": "0.999_1.001", "bypass": True, "loss": "reinforce"},
    "decoupled_geo_rs_seq_tis": {"level": "sequence", "threshold": 2.0, "rules": "seq_mean_k1", "rs_threshold": "0.999_1.001"},
    "decoupled_geo_rs_token_tis": {"level": "token", "threshold": 2.0, "rules": "seq_mean_k1", "rs_threshold": "0.999_1.001"},
    "bypass_pg_geo_rs_seq_tis": {"level": "sequence", "threshold": 2.0, "rules": "seq_mean_k1", "rs_threshold": "0.999_1.001", "bypass": True, "loss": "reinforce"},
    "bypass_pg_geo_rs_token_tis": {"level": "token", "threshold": 2.0, "rules": "seq_mean_k1", "rs_threshold": "0.999_1.001", "bypass": True, "loss": "reinforce"},
    "decoupled_k3_rs": {"level": None, "rules": "seq_mean_k3", "rs_threshold": 0.01},
    "decoupled_k3_rs_seq_tis": {"level": "sequence", "threshold": 2.0, "rules": "seq_mean_k3", "rs_threshold": 0.01},
    "decoupled_k3_rs_token_tis": {"level": "token", "threshold": 2.0, "rules": "seq_mean_k3", "rs_threshold": 0.01},
    "disabled": {"level": None},
}


def preset(df: DataFrame, name: str) -> DataFrame:
    """``correct`` with a named setting. A bypassing one corrects the rollout against ``old_lp`` and leaves the rollout's
    log-probabilities there, as the loss is taken against them."""
    if name not in PRESETS:
        raise ValueError(f"no such setting: {name}; there are {sorted(PRESETS)}")
    how = {k: v for k, v in PRESETS[name].items() if k not in ("bypass", "loss")}
    out = correct(df, **how)
    return bypass(out) if PRESETS[name].get("bypass") else out


def off_policy_metrics(df: DataFrame) -> DataFrame:
    """One row: perplexities, KL, k3-KL, perplexity ratios and chi-squared of tokens and sequences."""
    d = log_ratio()
    token = df.agg(
        masked_mean(-d, F.col("mask")).alias("kl"),
        masked_mean(F.exp(d) - d - 1, F.col("mask")).alias("k3_kl"),
        (masked_mean(F.exp(2 * clamp(d)), F.col("mask")) - 1).alias("chi2_token"),
    )
    per = df.groupBy("sample_id").agg(masked_mean("old_lp", "mask").alias("o"), masked_mean("rollout_lp", "mask").alias("r"), masked_sum(d, F.col("mask")).alias("s"))
    diff = F.col("r") - F.col("o")
    seq = per.agg(
        F.avg(F.exp(-F.col("o"))).alias("training_ppl"), F.avg(-F.col("o")).alias("training_log_ppl"),
        F.avg(F.exp(-F.col("r"))).alias("rollout_ppl"), F.avg(-F.col("r")).alias("rollout_log_ppl"),
        F.avg(diff).alias("log_ppl_diff"), F.avg(F.abs(diff)).alias("log_ppl_abs_diff"), F.max(diff).alias("log_ppl_diff_max"), F.min(diff).alias("log_ppl_diff_min"),
        F.avg(F.exp(diff)).alias("ppl_ratio"), (F.avg(F.exp(2 * clamp(F.col("s")))) - 1).alias("chi2_seq"),
    )
    return token.crossJoin(seq)


def weight_metrics(df: DataFrame, weight: str = "is_weight", upper: float = 2.0, lower: float | None = None) -> DataFrame:
    """One row: mean, extremes, std and effective sample size of token weights, fractions beyond, sequence statistics."""
    lower = 1 / upper if lower is None else lower
    m, w = F.col("mask"), F.col(weight)
    c = clamp(w, lower, upper)
    stats = df.agg(
        masked_mean(w, m).alias("mean"), F.max(F.when(m != 0, w)).alias("max"), F.min(F.when(m != 0, w)).alias("min"),
        masked_mean((w > upper).cast("double"), m).alias("fraction_high"), masked_mean((w < lower).cast("double"), m).alias("fraction_low"),
        masked_mean(c, m).alias("_c"), masked_mean(c * c, m).alias("_c2"),
    )
    stats = stats.withColumn("std", F.sqrt(F.greatest(F.col("_c2") - F.col("_c") * F.col("_c"), F.lit(0.0)))).withColumn("eff_sample_size", (F.col("_c") + 1e-8) * (F.col("_c") + 1e-8) / F.col("_c2")).drop("_c", "_c2")
    per = df.groupBy("sample_id").agg(masked_mean(w, m).alias("s"))
    s = F.col("s")
    seq = per.agg(
        F.avg(s).alias("seq_mean"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("seq_std"), F.max(s).alias("seq_max"), F.min(s).alias("seq_min"),
        F.max(F.abs(s - 1)).alias("seq_max_deviation"), F.avg((s > upper).cast("double")).alias("seq_fraction_high"), F.avg((s < lower).cast("double")).alias("seq_fraction_low"),
    )
    return stats.crossJoin(seq)


def kl_penalty(log_prob: Column, ref: Column, kind: str) -> Column:
    """Per-token KL estimates by name; a ``+`` at the end changes only gradients, so not the value."""
    d, kind = log_prob - ref, kind.rstrip("+")
    if kind in ("kl", "k1"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("mse", "k2"):
        return 0.5 * d * d
    if kind in ("low_var_kl", "k3"):
        x = clamp(-d)
        return clamp(F.exp(x) - x - 1, -10, 10)
    raise ValueError(f"no such estimate: {kind}")
