"""Masked aggregates, group statistics, advantages, corrections and losses over the derived rollouts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators import advantage as A
from tessella.operators import correction as C
from tessella.operators import groups as G
from tessella.operators import losses as L
from tessella.operators import masked as M
from tessella.plans.views import EV, SEQS, TOK, ev, seqs, tok
from tessella.session import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df, *columns, digits: int = 6):
    return df.withColumns({c: F.round(F.col(c) + 0.0, digits) for c in columns})


@query("a01_masked_aggregates", f"WITH {TOK} SELECT uid, round(sum(reward * mask), 6) AS s, round(sum(reward * mask) / (sum(mask) + 1e-8), 6) AS m FROM tok GROUP BY uid")
def a01(spark, d):
    return rounded(tok(spark, d).groupBy("uid").agg(M.masked_sum("reward", "mask").alias("s"), M.masked_mean("reward", "mask").alias("m")), "s", "m")


STATS = "st AS (SELECT sum({v} * mask) / (sum(mask) + 1e-8) AS mean, sum(mask) AS n FROM {t}), va AS (SELECT max(mean) AS mean, sum(({v} - mean) * ({v} - mean) * mask) / (sum(mask) + 1e-8) * max(n) / (max(n) - 1) AS var, max(n) AS n FROM {t}, st)"


@query("a03_masked_variance", f"WITH {TOK}, {STATS.format(v='value', t='tok')} SELECT round(mean, 6) AS mean, round(var, 6) AS var, CAST(n AS BIGINT) AS n FROM va")
def a03(spark, d):
    return rounded(M.masked_var(tok(spark, d), "value", "mask"), "mean", "var")


@query("a04_whiten", f"WITH {TOK}, {STATS.format(v='reward', t='tok')} SELECT sample_id, pos, round((reward - mean) / sqrt(var + 1e-8), 6) + 0.0 AS z FROM tok, va")
def a04(spark, d):
    return rounded(M.whiten(tok(spark, d), "reward", "mask", "z").select("sample_id", "pos", "z"), "z")


GROUP = "g AS (SELECT *, count(*) OVER w AS n, avg(score) OVER w AS mean, stddev_samp(score) OVER w AS sd, sum(score) OVER w AS total FROM {t} WINDOW w AS (PARTITION BY uid))"


@query("a05_group_stats", f"WITH {EV}, {GROUP.format(t='ev')} SELECT sample_id, round(CASE WHEN n = 1 THEN 0 ELSE mean END, 6) AS mean, round(CASE WHEN n = 1 THEN 1 ELSE sqrt(greatest(sd * sd, 1e-6)) END, 6) AS std, n FROM g")
def a05(spark, d):
    mean, std, n = G.mean_std_count("score", "uid")
    return rounded(ev(spark, d).select("sample_id", mean.alias("mean"), std.alias("std"), n.alias("n")), "mean", "std")


@query("a06_group_index", f"WITH {EV} SELECT sample_id, CAST(dense_rank() OVER (ORDER BY pred) - 1 AS INTEGER) AS gidx FROM ev")
def a06(spark, d):
    return G.group_index(ev(spark, d), "pred").select("sample_id", "gidx")


def _advantage(name, sql):
    """A sequence estimator over ``seqs``; sql is the expression of its advantage over g."""

    @query(f"{name}", f"WITH {SEQS}, {GROUP.format(t='seqs')} SELECT sample_id, round({sql}, 9) + 0.0 AS adv FROM g")
    def run(spark, d, estimator=name.split("_", 1)[1]):
        return rounded(A.estimate(estimator, seqs(spark, d)).select("sample_id", "adv"), "adv", digits=9)

    return run


_advantage("w02_grpo", "CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - mean) / (sd + 1e-6) END")
_advantage("w03_grpo_vectorized", "CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - mean) / (sqrt(greatest(sd * sd, 1e-6)) + 1e-6) END")
_advantage("w06_rloo", "CASE WHEN n = 1 THEN score ELSE n * 1.0 / (n - 1) * (score - mean) END")
_advantage("w07_rloo_vectorized", "CASE WHEN n = 1 THEN 0 ELSE (n * score - total) / (n - 1) END")
_advantage("w08_opo", "score - CASE WHEN n = 1 THEN 0 ELSE sum(length * score) OVER (PARTITION BY uid) / nullif(sum(length) OVER (PARTITION BY uid), 0) END")
_advantage("w11_gpg", "(SELECT count(*) * 1.0 / greatest(count(*) FILTER (score <> 0), 1) FROM seqs) * (score - CASE WHEN n = 1 THEN 0 ELSE mean END)")


@query("w04_grpo_passk", f"WITH {SEQS}, two AS (SELECT * FROM seqs QUALIFY count(*) OVER (PARTITION BY uid) > 1), {GROUP.format(t='two')} SELECT sample_id, round(CASE WHEN row_number() OVER v = 1 THEN (score - lead(score) OVER v) / (sd + 1e-6) ELSE 0 END, 6) + 0.0 AS adv FROM g WINDOW v AS (PARTITION BY uid ORDER BY score DESC, sample_id)")
def w04(spark, d):
    two = seqs(spark, d).withColumn("_n", F.count("*").over(W.partitionBy("uid"))).filter("_n > 1")
    return rounded(A.estimate("grpo_passk", two).select("sample_id", "adv"), "adv")


@query("w05_reinforce_plus_plus_baseline", f"WITH {SEQS}, {GROUP.format(t='seqs')}, c AS (SELECT sample_id, score - CASE WHEN n = 1 THEN 0 ELSE mean END AS c FROM g), x AS (SELECT t.sample_id, pos, mask, c FROM tok t JOIN c USING (sample_id)), {STATS.format(v='c', t='x')} SELECT sample_id, pos, round((c - mean) / sqrt(var + 1e-8) * mask, 6) + 0.0 AS adv FROM x, va")
def w05(spark, d):
    return rounded(A.estimate("reinforce_plus_plus_baseline", tok(spark, d), seqs=seqs(spark, d)).select("sample_id", "pos", "adv"), "adv")


NUMBERED = f"WITH RECURSIVE {TOK}, k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos DESC) AS k FROM tok)"


@query("w01_gae", f"""{NUMBERED}, s AS (
  SELECT sample_id, pos, k, mask, value, CAST(value * mask AS DOUBLE) AS nextv, CAST((reward - value) * mask AS DOUBLE) AS raw FROM k WHERE k = 1
  UNION ALL SELECT k.sample_id, k.pos, k.k, k.mask, k.value, CASE WHEN k.mask = 1 THEN k.value ELSE s.nextv END,
    CASE WHEN k.mask = 1 THEN k.reward + 0.99 * s.nextv - k.value + 0.99 * 0.95 * s.raw ELSE s.raw END FROM s JOIN k ON k.sample_id = s.sample_id AND k.k = s.k + 1),
{STATS.format(v='raw', t='s')} SELECT sample_id, pos, round((raw - mean) / sqrt(var + 1e-8), 6) + 0.0 AS adv, round(raw + value, 6) + 0.0 AS ret FROM s, va""")
def w01(spark, d):
    return rounded(A.estimate("gae", tok(spark, d), gamma=0.99, lam=0.95).select("sample_id", "pos", "adv", "ret"), "adv", "ret")


@query("w09_reinforce_plus_plus", f"""{NUMBERED}, s AS (SELECT sample_id, pos, k, mask, CAST(reward AS DOUBLE) AS ret FROM k WHERE k = 1
  UNION ALL SELECT k.sample_id, k.pos, k.k, k.mask, k.reward + 0.9 * s.ret * s.mask FROM s JOIN k ON k.sample_id = s.sample_id AND k.k = s.k + 1),
{STATS.format(v='ret', t='s')} SELECT sample_id, pos, round((ret - mean) / sqrt(var + 1e-8) * mask, 6) + 0.0 AS adv, round(ret, 6) AS ret FROM s, va""")
def w09(spark, d):
    return rounded(A.estimate("reinforce_plus_plus", tok(spark, d), gamma=0.9).select("sample_id", "pos", "adv", "ret"), "adv", "ret")


@query("w10_remax", f"WITH {TOK} SELECT sample_id, pos, round(sum(reward * mask) OVER (PARTITION BY sample_id ORDER BY pos DESC) - 0.05 * mask, 6) + 0.0 AS adv FROM tok")
def w10(spark, d):
    return rounded(A.estimate("remax", tok(spark, d).withColumn("baseline", F.lit(0.05))).select("sample_id", "pos", "adv"), "adv")


def _otb_sql(at: str, tail: bool) -> str:
    cut = "CASE WHEN n = 1 THEN 0 WHEN tops = 1 AND len = longest AND att >= second THEN 0 ELSE b END" if tail else "CASE WHEN n = 1 THEN 0 ELSE b END"
    return f"""WITH {TOK}, l AS (SELECT uid, sample_id, sum(mask) AS len FROM tok GROUP BY 1, 2),
l2 AS (SELECT *, count(*) OVER (PARTITION BY uid) AS n, max(len) OVER (PARTITION BY uid) AS longest FROM l),
l3 AS (SELECT *, sum(CASE WHEN len = longest THEN 1 ELSE 0 END) OVER (PARTITION BY uid) AS tops, max(CASE WHEN len < longest THEN len END) OVER (PARTITION BY uid) AS second FROM l2),
r AS (SELECT *, sum(reward * mask) OVER (PARTITION BY sample_id ORDER BY pos DESC) AS ret,
  sum((1 - 2 * exp(old_lp) + 0.3) * mask) OVER (PARTITION BY sample_id ORDER BY pos) AS w, {at} AS att FROM tok),
b AS (SELECT *, sum(ret * w * mask) OVER (PARTITION BY uid, att) / (sum(w * mask) OVER (PARTITION BY uid, att) + 1e-8) AS b FROM r)
SELECT b.sample_id, pos, round((ret - CASE WHEN mask = 1 THEN {cut} ELSE 0 END) * mask, 6) + 0.0 AS adv FROM b JOIN l3 USING (sample_id)"""


def _otb(spark, d, **how):
    tokens = tok(spark, d).withColumn("sum_pi2", F.lit(0.3))
    return rounded(A.estimate("optimal_token_baseline", tokens, **how).select("sample_id", "pos", "adv"), "adv")


@query("w12_optimal_token_baseline", _otb_sql("pos", False))
def w12(spark, d):
    return _otb(spark, d)


@query("w12_zero_tail", _otb_sql("pos", True))
def w12_tail(spark, d):
    return _otb(spark, d, zero_tail=True)


@query("w13_multi_turn_baseline", _otb_sql("CASE WHEN mask = 1 THEN sum(mask) OVER (PARTITION BY sample_id ORDER BY pos) - 1 END", False))
def w13(spark, d):
    return _otb(spark, d, compact=True)


@query("w14_reward_minus_kl", f"WITH {TOK} SELECT sample_id, pos, round(reward - 0.05 * (old_lp - rollout_lp) * mask, 6) + 0.0 AS reward FROM tok")
def w14(spark, d):
    kl = C.kl_penalty(F.col("old_lp"), F.col("rollout_lp"), "kl")
    return rounded(tok(spark, d).select("sample_id", "pos", (F.col("reward") - 0.05 * kl * F.col("mask")).alias("reward")), "reward")


@query("w15_adaptive_kl", f"""WITH RECURSIVE {EV}, s AS (SELECT step, avg(score) / 50 AS kl, count(*) AS n, row_number() OVER (ORDER BY step) AS k FROM ev GROUP BY step),
r AS (SELECT k, step, 0.1 * (1 + greatest(-0.2, least(0.2, kl / 0.9 - 1)) * n / 10000) AS beta FROM s WHERE k = 1
  UNION ALL SELECT s.k, s.step, r.beta * (1 + greatest(-0.2, least(0.2, s.kl / 0.9 - 1)) * s.n / 10000) FROM r JOIN s ON s.k = r.k + 1)
SELECT step, round(beta, 6) AS beta FROM r""")
def w15(spark, d):
    from tessella.operators.metrics import adaptive_kl

    steps = ev(spark, d).groupBy("step").agg((F.avg("score") / 50).alias("kl"), F.count("*").alias("n"))
    return rounded(adaptive_kl(steps, "step", "kl", "n", start=0.1, target=0.9, horizon=10000), "beta")


@query("w16_resample_weights", f"WITH {EV} SELECT sample_id, round(pow(abs(score), 2) + 1e-8, 6) AS weight FROM ev")
def w16(spark, d):
    return rounded(A.resample_weights(ev(spark, d), "score").select("sample_id", "weight"), "weight")


@query("w17_response_mask", f"WITH {TOK}, e AS (SELECT *, CASE WHEN mask = 0 THEN 1 ELSE 0 END AS eos FROM tok) SELECT sample_id, pos, CAST(sum(eos) OVER (PARTITION BY sample_id ORDER BY pos) - eos = 0 AS INTEGER) AS mask FROM e")
def w17(spark, d):
    t = tok(spark, d).withColumn("eos", 1 - F.col("mask"))
    return A.response_mask(t, "eos").select("sample_id", "pos", "mask")


@query("w18_position_ids", f"WITH {TOK} SELECT sample_id, pos, CAST(greatest(sum(mask) OVER (PARTITION BY sample_id ORDER BY pos) - 1, 0) AS BIGINT) AS position_id FROM tok")
def w18(spark, d):
    return A.position_ids(tok(spark, d), "mask").select("sample_id", "pos", "position_id")


D = "greatest(-20, least(20, old_lp - rollout_lp))"


@query("r01_token_weights", f"WITH {TOK} SELECT sample_id, pos, round(least(exp({D}) * mask, 2.0), 6) AS is_weight FROM tok")
def r01(spark, d):
    return rounded(C.importance_weights(tok(spark, d)).select("sample_id", "pos", "is_weight"), "is_weight")


@query("r02_sequence_weights", f"WITH {TOK} SELECT sample_id, pos, round(least(exp(greatest(-20, least(20, sum((old_lp - rollout_lp) * mask) OVER (PARTITION BY sample_id)))) * mask, 2.0), 6) AS is_weight FROM tok")
def r02(spark, d):
    return rounded(C.importance_weights(tok(spark, d), "sequence").select("sample_id", "pos", "is_weight"), "is_weight")


@query("r03_normalised_weights", f"WITH {TOK}, w AS (SELECT sample_id, pos, mask, least(exp({D}) * mask, 2.0) AS w FROM tok), m AS (SELECT sum(w * mask) / (sum(mask) + 1e-8) AS m FROM w) SELECT sample_id, pos, round(w / m, 6) AS is_weight FROM w, m")
def r03(spark, d):
    return rounded(C.importance_weights(tok(spark, d), normalise=True).select("sample_id", "pos", "is_weight"), "is_weight")


K = {"k1": f"-({D})", "k2": f"0.5 * {D} * {D}", "k3": f"exp({D}) - 1 - {D}"}


def _rule(rule: str, spec: str):
    level, _, k = rule.rpartition("_")
    stat = {"token": "k", "seq_sum": "sum(k * mask) OVER s", "seq_mean": "sum(k * mask) OVER s / (sum(mask) OVER s + 1e-8)", "seq_max": "coalesce(max(CASE WHEN mask = 1 THEN k END) OVER s, 0)"}[level]
    test = f"BETWEEN ln({spec.split('_')[0]}) AND ln({spec.split('_')[1]})" if k == "k1" else f"<= {spec}"

    @query(f"r05_{rule}", f"WITH {TOK}, k AS (SELECT *, {K[k]} AS k FROM tok) SELECT sample_id, pos, CASE WHEN {stat} {test} THEN mask ELSE 0 END AS new_mask FROM k WINDOW s AS (PARTITION BY sample_id)")
    def run(spark, d):
        return C.rejection_mask(tok(spark, d), rule, spec).select("sample_id", "pos", "new_mask")


for _name, _spec in (("token_k1", "0.751_1.331"), ("token_k2", "0.0321"), ("token_k3", "0.0321"), ("seq_sum_k1", "0.511_2.013"), ("seq_sum_k2", "0.2511"), ("seq_sum_k3", "0.2511"), ("seq_mean_k1", "0.8013_1.2513"), ("seq_mean_k2", "0.0511"), ("seq_mean_k3", "0.0511"), ("seq_max_k2", "0.1313"), ("seq_max_k3", "0.1313")):
    _rule(_name, _spec)


@query("r07_correction", f"WITH {TOK}, k AS (SELECT *, {K['k1']} AS k1, {K['k3']} AS k3 FROM tok), m AS (SELECT *, least(exp({D}) * mask, 2.0) AS w, CASE WHEN k1 BETWEEN ln(0.751) AND ln(1.331) AND sum(k3 * mask) OVER s / (sum(mask) OVER s + 1e-8) <= 0.0511 THEN mask ELSE 0 END AS nm FROM k WINDOW s AS (PARTITION BY sample_id)), p AS (SELECT sample_id, sum(CASE WHEN mask = 1 AND nm = 0 THEN 1 ELSE 0 END) AS lost, sum(mask) AS n FROM m GROUP BY 1) SELECT round(sum(lost) / (sum(n) + 1e-8), 6) AS masked_fraction, round(avg(CASE WHEN lost > 0 THEN 1.0 ELSE 0.0 END), 6) AS seq_masked_fraction FROM p")
def r07(spark, d):
    out = C.correct(tok(spark, d), rules="token_k1,seq_mean_k3", rs_threshold="0.751_1.331,0.0511")
    return rounded(C.rejection_metrics(out), "masked_fraction", "seq_masked_fraction")


@query("r10_kl_estimators", f"WITH {TOK}, d AS (SELECT sample_id, pos, old_lp - rollout_lp AS d FROM tok) SELECT sample_id, pos, round(d, 6) + 0.0 AS k1, round(abs(d), 6) AS abs, round(0.5 * d * d, 6) AS k2, round(least(10, greatest(-10, exp(least(20, greatest(-20, -d))) - least(20, greatest(-20, -d)) - 1)), 6) + 0.0 AS k3 FROM d")
def r10(spark, d):
    kinds = {k: C.kl_penalty(F.col("old_lp"), F.col("rollout_lp"), k).alias(k) for k in ("k1", "abs", "k2", "k3")}
    return rounded(tok(spark, d).select("sample_id", "pos", *kinds.values()), *kinds)


@query("a21_off_policy_metrics", f"""WITH {TOK}, d AS (SELECT *, old_lp - rollout_lp AS d FROM tok),
t AS (SELECT sum(-d * mask) / (sum(mask) + 1e-8) AS kl, sum((exp(d) - d - 1) * mask) / (sum(mask) + 1e-8) AS k3_kl, sum(exp(2 * d) * mask) / (sum(mask) + 1e-8) - 1 AS chi2_token FROM d),
p AS (SELECT sample_id, sum(old_lp * mask) / (sum(mask) + 1e-8) AS o, sum(rollout_lp * mask) / (sum(mask) + 1e-8) AS r, sum(d * mask) AS s FROM d GROUP BY 1),
q AS (SELECT avg(exp(-o)) AS training_ppl, avg(-o) AS training_log_ppl, avg(exp(-r)) AS rollout_ppl, avg(-r) AS rollout_log_ppl, avg(r - o) AS log_ppl_diff, avg(abs(r - o)) AS log_ppl_abs_diff,
  max(r - o) AS log_ppl_diff_max, min(r - o) AS log_ppl_diff_min, avg(exp(r - o)) AS ppl_ratio, avg(exp(2 * greatest(-20, least(20, s)))) - 1 AS chi2_seq FROM p)
SELECT {", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in "kl k3_kl chi2_token training_ppl training_log_ppl rollout_ppl rollout_log_ppl log_ppl_diff log_ppl_abs_diff log_ppl_diff_max log_ppl_diff_min ppl_ratio chi2_seq".split())} FROM t, q""")
def a21(spark, d):
    m = C.off_policy_metrics(tok(spark, d))
    return rounded(m, *m.columns, digits=5)


@query("a22_weight_metrics", f"""WITH {TOK}, w AS (SELECT *, least(exp({D}) * mask, 2.0) AS w FROM tok), c AS (SELECT *, greatest(0.5, least(2.0, w)) AS c FROM w),
t AS (SELECT sum(w * mask) / (sum(mask) + 1e-8) AS mean, max(w) FILTER (mask = 1) AS max, min(w) FILTER (mask = 1) AS min, sum(mask) FILTER (w > 2.0) AS hi, coalesce(sum(mask) FILTER (w < 0.5), 0) / (sum(mask) + 1e-8) AS fraction_low,
  sum(c * mask) / (sum(mask) + 1e-8) AS c1, sum(c * c * mask) / (sum(mask) + 1e-8) AS c2 FROM c),
p AS (SELECT sample_id, sum(w * mask) / (sum(mask) + 1e-8) AS s FROM w GROUP BY 1),
q AS (SELECT avg(s) AS seq_mean, stddev_samp(s) AS seq_std, max(s) AS seq_max, min(s) AS seq_min, max(abs(s - 1)) AS seq_max_deviation, avg(CASE WHEN s > 2.0 THEN 1.0 ELSE 0.0 END) AS seq_fraction_high, avg(CASE WHEN s < 0.5 THEN 1.0 ELSE 0.0 END) AS seq_fraction_low FROM p)
SELECT round(mean, 5) AS mean, round(max, 5) AS max, round(min, 5) AS min, coalesce(hi, 0) * 1.0 AS fraction_high, round(fraction_low, 5) AS fraction_low, round(sqrt(greatest(c2 - c1 * c1, 0)), 5) AS std, round((c1 + 1e-8) * (c1 + 1e-8) / c2, 5) AS eff_sample_size,
  {", ".join(f"round({c}, 5) AS {c}" for c in "seq_mean seq_std seq_max seq_min seq_max_deviation seq_fraction_high seq_fraction_low".split())} FROM t, q""")
def a22(spark, d):
    m = C.weight_metrics(C.importance_weights(tok(spark, d)))
    return rounded(m, *m.columns, digits=5)


LOSS_TOK = f"{TOK}, lt AS (SELECT *, rollout_lp AS lp, reward * 20 - 1 AS adv, exp(greatest(-20, least(20, rollout_lp - old_lp))) AS r FROM tok)"


def loss_tokens(spark, d):
    return tok(spark, d).withColumn("lp", F.col("rollout_lp")).withColumn("adv", F.col("reward") * 20 - 1)


def _loss(name: str, per_token: str, mode: str = "token-mean", extra: str = "", source: str = "lt", **how):
    reduce_ = {
        "token-mean": "SELECT round(sum(loss * mask) / sum(mask), 6) + 0.0 AS loss FROM z",
        "seq-mean-token-mean": "SELECT round(avg(l), 6) + 0.0 AS loss FROM (SELECT sum(loss * mask) / (sum(mask) + 1e-8) AS l FROM z GROUP BY sample_id HAVING sum(mask) > 0)",
        "seq-mean-token-sum": "SELECT round(avg(l), 6) + 0.0 AS loss FROM (SELECT sum(loss * mask) AS l FROM z GROUP BY sample_id HAVING sum(mask) > 0)",
        "seq-mean-token-sum-norm": "SELECT round(sum(l) / max(w), 6) + 0.0 AS loss FROM (SELECT sum(loss * mask) AS l, count(*) AS w FROM z GROUP BY sample_id)",
        "samples": "SELECT round(avg(loss), 6) + 0.0 AS loss FROM z",
    }[mode]
    key, loss = name.split(":")

    @query(key, f"WITH {LOSS_TOK}{extra}, z AS (SELECT {'*, ' if mode != 'samples' else ''}{per_token} AS loss FROM {source}{' GROUP BY sample_id' if mode == 'samples' else ''}) {reduce_}")
    def run(spark, d):
        return rounded(L.policy_loss(loss, loss_tokens(spark, d), mode, **how), "loss")


PPO = "CASE WHEN adv < 0 THEN least(-adv * 3, greatest(-adv * r, -adv * greatest(0.8, least(1.2, r)))) ELSE greatest(-adv * r, -adv * greatest(0.8, least(1.2, r))) END"
_loss("l01_ppo:vanilla", PPO)
_loss("a29_seq_mean_token_sum:vanilla", PPO, "seq-mean-token-sum")
_loss("a29_seq_mean_token_mean:vanilla", PPO, "seq-mean-token-mean")
_loss("a29_seq_mean_token_sum_norm:vanilla", PPO, "seq-mean-token-sum-norm")
_loss("l02_gspo:gspo", "greatest(-adv * g, -adv * greatest(1 - 3e-4, least(1 + 4e-4, g)))", "seq-mean-token-mean", ", gs AS (SELECT *, exp(least(10, sum((lp - old_lp) * mask) OVER s / greatest(sum(mask) OVER s, 1))) AS g FROM lt WINDOW s AS (PARTITION BY sample_id))", "gs")
_loss("l03_sapo:sapo", "-adv * 4 / (CASE WHEN adv > 0 THEN 1.0 ELSE 1.05 END) / (1 + exp(-(CASE WHEN adv > 0 THEN 1.0 ELSE 1.05 END) * (r - 1)))", "seq-mean-token-mean")
_loss("l04_gpg:gpg", "-lp * adv")
_loss("l08_cispo:cispo", "-greatest(0.8, least(1.2, r)) * adv * lp")
_loss("l09_reinforce:reinforce", "-adv * lp", "seq-mean-token-sum")
_loss("l07_geo_mean:geo_mean", "-(sum(adv * mask) / (sum(mask) + 1e-8)) * exp(sum(sign(adv) * least(sign(adv) * (lp - old_lp), sign(adv) * greatest(-0.4, least(0.4, lp - old_lp))) * mask) / (sum(mask) + 1e-8))", "samples")
COV = ", mu AS (SELECT sum(adv * mask) / (sum(mask) + 1e-8) AS a, sum(lp * mask) / (sum(mask) + 1e-8) AS l, sum(mask) AS n FROM lt), cv AS (SELECT lt.*, n, (adv - a) * (lp - l) AS cov FROM lt, mu), ck AS (SELECT *, CASE WHEN mask = 1 THEN row_number() OVER (PARTITION BY mask ORDER BY {order}) END AS k, greatest(1, CAST(floor(n * {share}) AS BIGINT)) AS top FROM cv {where})"
_loss("l06_kl_cov:kl_cov", "-adv * exp(lp - old_lp) + CASE WHEN k <= top THEN abs(lp - old_lp) ELSE 0 END", extra=COV.format(order="cov DESC, sample_id, pos", share=0.01, where=""), source="ck", share=0.01)
_loss("l05_clip_cov:clip_cov", "CASE WHEN able AND k <= top THEN 0 ELSE greatest(-adv * r, -adv * greatest(0.8, least(1.2, r))) END", extra=""", mu AS (SELECT sum(adv * mask) / (sum(mask) + 1e-8) AS a, sum(lp * mask) / (sum(mask) + 1e-8) AS l, sum(mask) AS n FROM lt), cv AS (SELECT lt.*, n, mask = 1 AND NOT (-adv * greatest(0.8, least(1.2, r)) > -adv * r) AND (adv - a) * (lp - l) > 0.05 AND (adv - a) * (lp - l) < 0.5 AS able FROM lt, mu),
ck AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY md5('clip|' || sample_id || '|' || pos), sample_id, pos) AS k, greatest(1, CAST(floor(n * 0.01) AS BIGINT)) AS top FROM cv)""", source="ck", share=0.01, lower=0.05, upper=0.5)


@query("l01_clip_fractions", f"WITH {LOSS_TOK}, c AS (SELECT *, -adv * r AS p1, -adv * greatest(0.8, least(1.2, r)) AS p2 FROM lt) SELECT round(sum(CASE WHEN p2 > p1 THEN mask ELSE 0 END) / (sum(mask) + 1e-8), 6) AS clipfrac, round(sum(CASE WHEN greatest(p1, p2) > -adv * 3 AND adv < 0 THEN mask ELSE 0 END) / (sum(mask) + 1e-8), 6) AS clipfrac_lower, round(sum((old_lp - lp) * mask) / (sum(mask) + 1e-8), 6) + 0.0 AS ppo_kl FROM c")
def l01_fractions(spark, d):
    return rounded(L.clip_fractions(loss_tokens(spark, d)), "clipfrac", "clipfrac_lower", "ppo_kl")


@query("l11_value_loss", f"WITH {TOK}, v AS (SELECT *, value + reward AS nv, reward * 3 AS ret FROM tok), c AS (SELECT *, least(greatest(nv, value - 0.05), value + 0.05) AS cv FROM v), e AS (SELECT mask, (nv - ret) * (nv - ret) AS a, (cv - ret) * (cv - ret) AS b FROM c) SELECT round(sum(0.5 * greatest(a, b) * mask) / sum(mask), 6) AS loss, round(sum(CASE WHEN b > a THEN mask ELSE 0 END) / (sum(mask) + 1e-8), 6) AS clipfrac FROM e")
def l11(spark, d):
    t = tok(spark, d).withColumn("new_value", F.col("value") + F.col("reward")).withColumn("ret", F.col("reward") * 3)
    return rounded(L.value_loss(t, clip=0.05), "loss", "clipfrac")


LOGITS = "lg AS (SELECT vec_id, [CAST(x AS DOUBLE) * 4 FOR x IN embedding[1:8]] AS s, [CAST(x AS DOUBLE) * 4 FOR x IN embedding[9:16]] AS t, label % 8 AS y FROM embeddings), ls AS (SELECT vec_id, y, s, ln(list_sum([exp(x) FOR x IN s])) AS zs, ln(list_sum([exp(x) FOR x IN t])) AS zt, t FROM lg), lp AS (SELECT vec_id, y, s, zs, [x - zs FOR x IN s] AS a, [x - zt FOR x IN t] AS b FROM ls)"


def _logits(spark, d):
    part = lambda at: F.transform(F.slice("embedding", at, 8), lambda x: x.cast("double") * 4)
    return table(spark, d, "embeddings").select("vec_id", part(1).alias("s"), part(9).alias("t"), (F.col("label") % 8).alias("y"))


@query("l12_entropy", f"WITH {LOGITS} SELECT vec_id, round(-list_sum([exp(x) * x FOR x IN a]), 6) AS entropy, round(list_sum([exp(2 * x) FOR x IN a]), 6) AS sum_pi2, round(a[y + 1], 6) AS label_lp FROM lp")
def l12(spark, d):
    s = F.col("s")
    out = _logits(spark, d).select("vec_id", L.entropy(s).alias("entropy"), L.sum_squared_probabilities(s).alias("sum_pi2"), L.log_softmax_at(s, F.col("y")).alias("label_lp"))
    return rounded(out, "entropy", "sum_pi2", "label_lp")


PAIRS = "list_sum([exp({y}[i]) * ({y}[i] - {x}[i]) FOR i IN range(1, len(a) + 1)])"
MIX = "[ln(exp(a[i]) * 0.5 + exp(b[i]) * 0.5) FOR i IN range(1, len(a) + 1)]"


@query("l13_distillation", f"WITH {LOGITS}, m AS (SELECT vec_id, a, b, {MIX} AS m FROM lp) SELECT vec_id, round({PAIRS.format(x='a', y='b')}, 6) AS forward_kl, round({PAIRS.format(x='b', y='a')}, 6) AS reverse_kl, round(0.5 * {PAIRS.format(x='m', y='a')} + 0.5 * {PAIRS.format(x='m', y='b')}, 6) AS jsd FROM m")
def l13(spark, d):
    norm = _logits(spark, d).select("vec_id", L.renormalised(F.col("s")).alias("a"), L.renormalised(F.col("t")).alias("b"))
    names = {"forward_kl": 0.0, "reverse_kl": 1.0, "jsd": 0.5}
    return rounded(norm.select("vec_id", *[L.distillation(F.col("a"), F.col("b"), v).alias(k) for k, v in names.items()]), *names)


@query("l13_topk_tail", f"WITH {LOGITS}, k AS (SELECT vec_id, a[1:3] AS a3, b[1:3] AS b3 FROM lp), m AS (SELECT vec_id, a3 || [ln(1 - list_sum([exp(x) FOR x IN a3]))] AS a, b3 || [ln(1 - list_sum([exp(x) FOR x IN b3]))] AS b FROM k) SELECT vec_id, round({PAIRS.format(x='b', y='a')}, 6) AS reverse_kl FROM m")
def l13_tail(spark, d):
    cut = lambda c: L.with_tail(F.slice(L.renormalised(F.col(c)), 1, 3))
    return rounded(_logits(spark, d).select("vec_id", cut("s").alias("a"), cut("t").alias("b")).select("vec_id", L.distillation(F.col("a"), F.col("b"), 1.0).alias("reverse_kl")), "reverse_kl")
