"""Remaining functions and small operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import answers as A
from tessella.functions import scoring as S
from tessella.functions import texts as T
from tessella.operators import batch as B
from tessella.operators import correction as C
from tessella.operators import losses as L
from tessella.plans.rollouts import D, LOSS_TOK, loss_tokens, rounded
from tessella.plans.views import EV, TOK, ev, tok
from tessella.session import table
from tessella.streaming.rollouts import staleness_budget

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("p18_row_enrichment", "SELECT event_id, coalesce(CAST(props::JSON->>'k' AS INTEGER), 0) AS index, CAST(props::JSON->>'tools' AS VARCHAR) AS tools FROM events")
def p18(spark, d):
    get = lambda k: F.get_json_object("props", f"$.{k}")
    return table(spark, d, "events").select("event_id", F.coalesce(get("k").cast("int"), F.lit(0)).alias("index"), get("tools").alias("tools"))


@query("p19_generation_split", f"WITH {EV} SELECT sample_id, uid, step FROM ev")
def p19(spark, d):
    return B.pop(ev(spark, d), ["pred", "score"])[1]


@query("f05_labelled", "SELECT doc_id, lang FROM documents WHERE length(lang) > 0")
def f05(spark, d):
    return table(spark, d, "documents").filter(F.length("lang") > 0).select("doc_id", "lang")


@query("f08_not_aborted", f"WITH {TOK} SELECT sample_id, CAST(sum(mask) AS BIGINT) AS length FROM tok GROUP BY 1 HAVING sum(mask) > 0")
def f08(spark, d):
    return tok(spark, d).groupBy("sample_id").agg(F.sum("mask").alias("length")).filter("length > 0")


@query("f09_not_blank", "SELECT doc_id FROM documents WHERE length(trim(text)) > 0")
def f09(spark, d):
    return table(spark, d, "documents").filter(F.length(F.trim("text")) > 0).select("doc_id")


@query("j03_group_lookup", f"WITH {EV}, g AS (SELECT uid, avg(score) AS mean FROM ev GROUP BY 1) SELECT sample_id, round(score - mean, 9) + 0.0 AS centred FROM ev JOIN g USING (uid)")
def j03(spark, d):
    e = ev(spark, d)
    means = e.groupBy("uid").agg(F.avg("score").alias("mean"))
    return rounded(e.join(means, "uid").select("sample_id", (F.col("score") - F.col("mean")).alias("centred")), "centred", digits=9)


@query("u10_equal_parts", "SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // ((SELECT count(*) FROM customer) // 5) AS INTEGER) AS chunk FROM customer")
def u10(spark, d):
    return B.chunk(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], 5)


@query("u27_mini_batches", "WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('3|' || c_custkey), c_custkey) - 1 AS rn FROM customer) SELECT c_custkey, CAST(rn // 50 AS INTEGER) AS part FROM o")
def u27(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.md5(F.concat(F.lit("3|"), F.col("c_custkey").cast("string")).cast("binary")).alias("h"))
    return B.split(c, ["h", "c_custkey"], 50).drop("h")


@query("a12_lengths", f"WITH {TOK} SELECT sample_id, list(mask ORDER BY pos) AS mask, CAST(sum(mask) AS BIGINT) AS length FROM tok GROUP BY 1")
def a12(spark, d):
    from tessella.operators.advantage import arrays

    m = F.transform("t", lambda t: t["mask"])
    return arrays(tok(spark, d), "mask").select("sample_id", m.alias("mask"), F.aggregate(m, F.lit(0).cast("long"), lambda s, x: s + x).alias("length"))


@query("a10_derived_metrics", f"WITH {EV}, s AS (SELECT step, max(score) AS hi, min(score) AS lo, sum(score) AS total, count(*) AS n FROM ev GROUP BY 1) SELECT step, round(hi - lo, 6) AS minmax_diff, round(n / nullif(total, 0), 6) AS throughput, round(lo / hi, 6) AS idle_ratio FROM s")
def a10(spark, d):
    s = ev(spark, d).groupBy("step").agg(F.max("score").alias("hi"), F.min("score").alias("lo"), F.sum("score").alias("total"), F.count("*").alias("n"))
    out = s.select("step", (F.col("hi") - F.col("lo")).alias("minmax_diff"), F.try_divide("n", "total").alias("throughput"), (F.col("lo") / F.col("hi")).alias("idle_ratio"))
    return rounded(out, "minmax_diff", "throughput", "idle_ratio")


@query("a19_metric_routing", "SELECT source, var, n, CASE WHEN var = 'acc' AND n = max(n) OVER (PARTITION BY source, var) THEN 'val-core' ELSE 'val-aux' END || '/' || source || '/' || var || '/mean@' || n AS name FROM (SELECT event_type AS source, unnest(['acc', 'reward']) AS var, user_id % 4 + 1 AS n FROM events) GROUP BY 1, 2, 3")
def a19(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("source"), F.explode(F.array(F.lit("acc"), F.lit("reward"))).alias("var"), (F.col("user_id") % 4 + 1).alias("n")).distinct()
    top = F.max("n").over(W.partitionBy("source", "var"))
    rows = rows.withColumn("core", (F.col("var") == "acc") & (F.col("n") == top))
    return rows.select("source", "var", "n", F.concat(F.when(F.col("core"), "val-core").otherwise("val-aux"), F.lit("/"), "source", F.lit("/"), "var", F.lit("/mean@"), F.col("n").cast("string")).alias("name"))


@query("a23_rejection_metrics", f"WITH {TOK}, k AS (SELECT *, 0.5 * {D} * {D} AS k2 FROM tok), p AS (SELECT sample_id, sum(CASE WHEN mask = 1 AND k2 > 0.0321 THEN 1 ELSE 0 END) AS lost, sum(mask) AS n FROM k GROUP BY 1) SELECT round(sum(lost) / (sum(n) + 1e-8), 6) AS masked_fraction, round(avg(CASE WHEN lost > 0 THEN 1.0 ELSE 0.0 END), 6) AS seq_masked_fraction FROM p")
def a23(spark, d):
    return rounded(C.rejection_metrics(C.rejection_mask(tok(spark, d), "token_k2", 0.0321)), "masked_fraction", "seq_masked_fraction")


@query("a32_append_to_lists", f"WITH {EV} SELECT uid, list(score ORDER BY sample_id) AS score FROM ev GROUP BY 1")
def a32(spark, d):
    packed = F.array_sort(F.collect_list(F.struct("sample_id", "score")))
    return ev(spark, d).groupBy("uid").agg(packed.alias("s")).select("uid", F.col("s").getField("score").alias("score"))


@query("r04_estimators", f"WITH {TOK} SELECT sample_id, pos, round(-({D}), 6) + 0.0 AS k1, round(0.5 * {D} * {D}, 6) AS k2, round(exp({D}) - 1 - ({D}), 6) + 0.0 AS k3 FROM tok")
def r04(spark, d):
    e = C.estimators()
    return rounded(tok(spark, d).select("sample_id", "pos", *[v.alias(k) for k, v in e.items()]), *e)


@query("r08_bypass", f"WITH {TOK} SELECT sample_id, pos, round(rollout_lp, 6) AS old_lp FROM tok")
def r08(spark, d):
    return rounded(C.bypass(tok(spark, d)).select("sample_id", "pos", "old_lp"), "old_lp")


@query("l10_bypass_loss", f"WITH {LOSS_TOK}, c AS (SELECT *, -(greatest(-20, least(20, old_lp - rollout_lp))) AS k1, least(exp(greatest(-20, least(20, old_lp - rollout_lp))) * mask, 2.0) AS w FROM lt), n AS (SELECT *, CASE WHEN k1 BETWEEN ln(0.751) AND ln(1.331) THEN mask ELSE 0 END AS nm, -adv * lp * w AS l FROM c) SELECT round(sum(l * nm) / sum(nm), 6) + 0.0 AS loss FROM n")
def l10(spark, d):
    out = C.correct(loss_tokens(spark, d), rules="token_k1", rs_threshold="0.751_1.331").drop("mask").withColumnRenamed("new_mask", "mask")
    return rounded(L.policy_loss("reinforce", out, weights="is_weight"), "loss")


@query("t04_topk_tokens", f"WITH {TOK} SELECT sample_id, pos, reward FROM tok ORDER BY reward DESC, sample_id, pos LIMIT 100")
def t04(spark, d):
    return tok(spark, d).select("sample_id", "pos", "reward").orderBy(F.desc("reward"), "sample_id", "pos").limit(100)


@query("x03_hash_answer_loose", r"SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || '.5' AS strict, CASE WHEN o_custkey >= 1000 THEN CAST(o_custkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) END AS loose FROM orders")
def x03(spark, d):
    n = F.col("o_custkey").cast("string")
    plain = F.regexp_extract(F.concat(F.lit("a #### "), n, F.lit(".5")), r"####\s*([0-9]+(\.[0-9]+)?)", 1)
    return table(spark, d, "orders").select("o_orderkey", plain.alias("strict"), A.hash_answer(F.concat(F.lit("a #### "), F.format_number("o_custkey", 0))).alias("loose"))


@query("x16_geometry", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.0 END AS score FROM orders")
def x16(spark, d):
    n = F.col("o_custkey").cast("string")
    boxed = F.concat(F.lit(r"so \boxed{"), n, F.lit("}"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("<think>hm</think> "), boxed)).when(F.col("o_orderkey") % 3 == 1, boxed).otherwise(n)
    return table(spark, d, "orders").select("o_orderkey", F.round(S.geometry_score(text, n), 6).alias("score"))


@query("x21_output_equal", "SELECT doc_id, true AS same FROM documents")
def x21(spark, d):
    return table(spark, d, "documents").select("doc_id", S.output_equal(F.concat(F.lit(" "), "lang", F.lit("\n"), "source", F.lit(" ")), F.concat("lang", F.lit(" "), "source")).alias("same"))


@query("x22_test_feedback", """WITH t AS (SELECT item_id, item_id % 3 = 0 AS broken, length(text) AS n, CASE WHEN length(text) > 250 THEN left(text, 250) || '...' ELSE text END AS x FROM benchmark)
SELECT item_id, CASE WHEN broken THEN 'input 4: want a, got nothing' ELSE 'input 11: want none, got ' || item_id || chr(10) || 'input 123456: want ' || x || ', got yes' END AS feedback FROM t""")
def x22(spark, d):
    one = lambda i, w, g: F.struct(F.lit(i).alias("input"), w.alias("want"), g.alias("got"))
    gave = F.when(F.col("item_id") % 3 != 0, "a")
    r = F.array(one("0", F.lit("x"), F.lit("x")), one("1" * 90, F.lit("y"), F.lit("z")), one("123456", F.col("text"), F.lit("yes")), one("11", F.lit("none"), F.col("item_id").cast("string")), one("4", F.lit("a"), gave))
    return table(spark, d, "benchmark").select("item_id", T.test_feedback(r).alias("feedback"))


@query("x25_description", "SELECT item_id, 'Solve task ' || item_id || ' now.' AS description FROM benchmark")
def x25(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.description(F.concat(F.lit("Solve task "), F.col("item_id").cast("string"), F.lit(" now.\nInput -\n-----Input-----\nn"))).alias("description"))


@query("x26_first_number", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN item_id + 0.5 ELSE 7.0 END AS n FROM benchmark")
def x26(spark, d):
    text = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" "), (F.col("item_id") + 0.5).cast("string"), F.lit(" seconds"))).otherwise("none given")
    return table(spark, d, "benchmark").select("item_id", S.first_number(text, 7.0).alias("n"))


@query("x29_function_names", "SELECT item_id, 'f' || item_id AS name, 'Add.' AS doc FROM benchmark")
def x29(spark, d):
    source = F.concat(F.lit("import x\ndef f"), F.col("item_id").cast("string"), F.lit('(a, b):\n    """ Add.\n    >>> f(1)\n    """'))
    return table(spark, d, "benchmark").select("item_id", T.function_name(source).alias("name"), F.regexp_replace(T.docstring(source), r"\s+$", "").alias("doc"))


@query("x36_single_turn_mask", "SELECT item_id, [CASE WHEN i >= item_id % 5 AND i < 7 THEN 1 ELSE 0 END FOR i IN range(8)] AS mask FROM benchmark")
def x36(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.single_turn_mask(F.lit(8), (F.col("item_id") % 5 + 1).cast("int")).alias("mask"))


@query("x38_without_padding", f"WITH {TOK} SELECT sample_id, coalesce(list(pos ORDER BY pos) FILTER (mask = 1), []) AS kept FROM tok GROUP BY 1")
def x38(spark, d):
    from tessella.operators.advantage import arrays

    t = arrays(tok(spark, d), "mask")
    return t.select("sample_id", T.without_padding(F.col("t").getField("pos"), F.col("t").getField("mask")).alias("kept"))


@query("x40_reprompt", "SELECT doc_id, lang || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Correct solution:' || chr(10) || source ELSE chr(10) || 'Feedback:' || chr(10) || 'no' END AS prompt FROM documents")
def x40(spark, d):
    solution = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    return table(spark, d, "documents").select("doc_id", T.reprompt(F.col("lang"), solution, F.lit("no")).alias("prompt"))


@query("x42_turn_history", "SELECT conv_id, turn, string_agg(role, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS history FROM conversations WHERE turn IS NOT NULL AND conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) = count(DISTINCT turn))")
def x42(spark, d):
    rows = table(spark, d, "conversations")
    whole = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.countDistinct("turn").alias("k")).filter("n = k").select("conv_id")
    so_far = F.collect_list("role").over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    return rows.filter("turn IS NOT NULL").join(whole, "conv_id", "left_semi").select("conv_id", "turn", F.array_join(so_far, "|").alias("history"))


@query("x43_remove_self", "SELECT doc_id, CASE WHEN source = 'src1' THEN 'def f(a)' ELSE 'def f(self, a)' END AS text FROM documents")
def x43(spark, d):
    return table(spark, d, "documents").select("doc_id", T.remove_self(F.lit("def f(self, a)"), F.col("source"), "src1").alias("text"))


@query("n14_mixed_numbers", "SELECT o_orderkey, '7+3/4' AS mixed, CAST(o_custkey + 10000 AS VARCHAR) AS plain FROM orders")
def n14(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.mixed_number(F.lit("7 3/4")).alias("mixed"), T.mixed_number(F.format_number(F.col("o_custkey") + 10000, 0)).alias("plain"))


@query("n15_json_equal", "SELECT event_id, true AS same FROM events")
def n15(spark, d):
    a = F.concat(F.lit('{"b": 1, "a": "'), "event_type", F.lit('"}'))
    b = F.concat(F.lit('{"a":"'), "event_type", F.lit('","b":1}'))
    schema = "a string, b int"
    return table(spark, d, "events").select("event_id", (T.canonical_json(a, schema) == T.canonical_json(b, schema)).alias("same"))


@query("z03_staleness_budget", "SELECT user_id, count(*) AS in_flight, count(*) >= 72 AS paused FROM events GROUP BY 1")
def z03(spark, d):
    budget = staleness_budget(16, 0.5, 3)
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("in_flight"), (F.count("*") >= budget).alias("paused"))
