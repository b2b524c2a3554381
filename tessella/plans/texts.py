"""Answer scorers, text functions, reward managers and validation metrics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import answers as A
from tessella.functions import scoring as S
from tessella.operators import groups as G
from tessella.operators import metrics as M
from tessella.plans.evaluation import RESPONSES_SQL, prompts_with_responses
from tessella.plans.rollouts import rounded
from tessella.plans.views import EV, TOK, ev, tok
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


def responses(spark, d):
    return prompts_with_responses(spark, d).select("row_id", "data_source", "truth", F.posexplode("responses").alias("ord", "response")).withColumn("ord", F.col("ord") + 1)


R = f"r AS ({RESPONSES_SQL})"


@query("x02_last_number", f"WITH {R}, e AS (SELECT *, regexp_extract_all(right(response, 300), '(-?[0-9.,]+)', 1) AS f FROM r), g AS (SELECT *, list_filter(f, lambda x: x NOT IN ('', '.')) AS ok FROM e) SELECT row_id, ord, coalesce(ok[len(ok)], f[1]) AS answer FROM g")
def x02(spark, d):
    return responses(spark, d).select("row_id", "ord", A.last_number(F.col("response")).alias("answer"))


@query("x01_gsm8k_score", f"WITH {R}, e AS (SELECT *, regexp_extract_all(right(response, 300), '#### (-?[0-9.,]+)', 1) AS f FROM r) SELECT row_id, ord, CASE WHEN len(f) = 0 THEN 0.0 WHEN replace(f[len(f)], ',', '') = truth THEN 1.0 ELSE 0.1 END AS score FROM e")
def x01(spark, d):
    return responses(spark, d).select("row_id", "ord", S.gsm8k_score(F.col("response"), F.col("truth"), format_score=0.1).alias("score"))


@query("x04_boxed", r"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE '\frac{' || o_custkey || '}{' || (o_orderkey % 7 + 1) || '}' END AS answer FROM orders")
def x04(spark, d):
    inner = F.concat(F.lit(r"\frac{"), F.col("o_custkey").cast("string"), F.lit("}{"), (F.col("o_orderkey") % 7 + 1).cast("string"), F.lit("}"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(r"first \boxed{1}, then \boxed{"), inner, F.lit("} done}")))
    text = text.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(r"it is \fbox{"), inner, F.lit("}"))).otherwise(F.concat(F.lit(r"open \boxed{"), inner))
    return table(spark, d, "orders").select("o_orderkey", S.last_boxed(text).alias("answer"))


#: One expression for Spark and SQL: raw answers from the numbers of an order.
BS = "chr(92)"
A_, B_ = "CAST(o_custkey AS STRING)", "CAST(o_orderkey % 9 + 1 AS STRING)"
D_ = "CAST(o_custkey % 9 + 1 AS STRING)"
LATEX_TEXT = f"""CASE o_orderkey % 16 WHEN 0 THEN {A_} || '/' || {B_} WHEN 1 THEN {BS} || 'left .' || {D_} || {BS} || '%' WHEN 2 THEN {BS} || 'dfrac' || {D_} || {B_}
  WHEN 3 THEN {BS} || 'frac' || {D_} || '{{' || {A_} || '}}' WHEN 4 THEN {BS} || 'tfrac{{' || {A_} || '}}{{' || {B_} || '}}' WHEN 5 THEN {BS} || {BS} || 'left(' || {A_} || {BS} || 'right)'
  WHEN 6 THEN 'x = ' || {A_} || {BS} || 'text{{ cm}}' WHEN 7 THEN {BS} || 'sqrt' || {D_} || ' + ' || {BS} || 'sqrt{{' || {A_} || '}}' WHEN 8 THEN {A_} || '^' || {BS} || 'circ' WHEN 9 THEN {BS} || '$' || {A_} || '.' || {B_}
  WHEN 10 THEN '0.5' WHEN 11 THEN {BS} || 'frac' || {D_} WHEN 12 THEN '0' || {A_} || '/' || {B_} WHEN 13 THEN {A_} || {BS} || 'text{{ a}}' || {BS} || 'text{{ b}}' WHEN 14 THEN 'f(x)=' || {A_} ELSE {BS} || 'frac' || {D_} || 'b+' || {BS} || 'frac{{1}}' || {B_} END"""
LATEX_FORM = rf"""CASE o_orderkey % 16 WHEN 0 THEN '\frac{{' || {A_} || '}}{{' || {B_} || '}}' WHEN 1 THEN CASE WHEN o_custkey % 9 = 4 THEN '\frac{{1}}{{2}}' ELSE '0.' || {D_} END
  WHEN 2 THEN '\frac{{' || {D_} || '}}{{' || {B_} || '}}' WHEN 3 THEN '\frac{{' || {D_} || '}}{{' || {A_} || '}}' WHEN 4 THEN '\frac{{' || {A_} || '}}{{' || {B_} || '}}' WHEN 5 THEN '(' || {A_} || ')' WHEN 6 THEN {A_}
  WHEN 7 THEN '\sqrt{{' || {D_} || '}}+\sqrt{{' || {A_} || '}}' WHEN 8 THEN {A_} WHEN 9 THEN CASE WHEN o_custkey = 0 AND o_orderkey % 9 = 4 THEN '\frac{{1}}{{2}}' ELSE {A_} || '.' || {B_} END WHEN 10 THEN '\frac{{1}}{{2}}' WHEN 11 THEN '\frac' || {D_} WHEN 12 THEN '0' || {A_} || '/' || {B_}
  WHEN 13 THEN NULL WHEN 14 THEN 'f(x)=' || {A_} ELSE '\frac{{' || {D_} || '}}{{b}}+\frac{{1}}' || {B_} END"""


@query("x06_latex", f"SELECT o_orderkey, {LATEX_FORM} AS answer FROM orders")
def x06(spark, d):
    return table(spark, d, "orders").withColumn("t", F.expr(LATEX_TEXT)).select("o_orderkey", S.canonical_latex(F.col("t")).alias("answer"))


@query("x08_minerva", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '[INVALID]' ELSE CAST(o_custkey AS VARCHAR) END AS answer, CASE WHEN o_orderkey % 4 = 0 THEN -1.0 ELSE 1.0 END AS score FROM orders")
def x08(spark, d):
    n = F.col("o_custkey").cast("string")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.lit("I do not know")).otherwise(F.concat(F.lit("Answer: 1\nso\nANSWER : "), n, F.lit("\nbye")))
    return table(spark, d, "orders").select("o_orderkey", S.minerva_answer(text).alias("answer"), S.dapo_score(text, n).alias("score"))


CHOICE = "substr('ABCD', CAST(event_id % 4 + 1 AS INTEGER), 1)"


@query("x11_choices", f"SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE {CHOICE} END AS xml, {CHOICE} AS mmlu, {CHOICE} AS gpqa FROM events")
def x11(spark, d):
    letter = F.substring(F.lit("ABCD"), (F.col("event_id") % 4 + 1).cast("int"), F.lit(1))
    xml = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("just "), letter)).otherwise(F.concat(F.lit("<answer>E</answer> no, <answer> "), letter, F.lit(" </answer> ok")))
    mmlu = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("so the answer is ("), letter, F.lit(")."))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("I think. Answer: "), letter)).otherwise(F.concat(F.lit("it must be "), letter, F.lit(", yes")))
    gpqa = F.concat(F.lit("not E but "), F.lower(letter), F.lit(" it is"))
    return table(spark, d, "events").select("event_id", S.xml_choice(xml).alias("xml"), S.mmlu_choice(mmlu).alias("mmlu"), S.gpqa_choice(gpqa).alias("gpqa"))


#: One expression for Spark and SQL: what a model said and what it should have said.
SAID = """'Action: find' || chr(10) || 'Action Input: {"user": ' || CAST(user_id AS STRING) || ', "kind": "' || event_type || '"}' || chr(10) || CASE event_id % 6 WHEN 0 THEN 'Action: open' || chr(10) || 'Action Input: {"page": 1, "user": 7}'
  WHEN 1 THEN 'Action: open' || chr(10) || 'Action Input: {"page": 1, bad}' WHEN 2 THEN 'Action:open' WHEN 3 THEN 'Action: open' || chr(10) || 'Action Input: {"kind": "click"}' WHEN 4 THEN '' ELSE 'Action: find' || chr(10) || 'Action Input:' || chr(10) || '{"page": [1, 2]}' END"""
SHOULD = """CASE event_id % 5 WHEN 0 THEN '[{"Action": "open", "Action_Input": "{}"}, {"Action": "find", "Action_Input": {"kind": "' || event_type || '", "user": ' || CAST(user_id AS STRING) || '}}]'
  WHEN 1 THEN '[{"Action": "find", "Action_Input": {"user": 1, "kind": "click"}}, {"Action": "open", "Action_Input": {"user": ' || CAST(user_id AS STRING) || '}}]'
  WHEN 2 THEN '[{"Action": "find", "Action_Input": {"page": 1, "kind": "' || event_type || '"}}, {"Action": "open", "Action_Input": {"user": 7}}]'
  WHEN 3 THEN '[{"Action": "find", "Action_Input": {"kind": "' || event_type || '"}}, {"Action": "find", "Action_Input": {"user": ' || CAST(user_id AS STRING) || ', "page": [1, 2]}}]' ELSE 'no list' END"""


def _sorted_entries(j: str) -> str:
    return f"list_sort(list_transform(json_keys({j}), lambda k: k || '=' || CAST(json_extract({j}, '$.\"' || k || '\"') AS VARCHAR)))"


@query(
    "x14_tool_use",
    rf"""WITH e AS (SELECT event_id, {SAID} AS said, {SHOULD} AS should FROM events),
f AS (SELECT event_id, list_sort(regexp_extract_all(said, 'Action:\s*(\w+)', 1)) AS a, list_filter(regexp_extract_all(said, 'Action Input:\s*(\{{.*?\}})', 1), lambda b: json_valid(b)) AS b,
  CASE WHEN json_valid(should) THEN should END AS should FROM e),
g AS (SELECT event_id, a, list_reduce(list_concat(['{{}}'], b), lambda x, y: CAST(json_merge_patch(x, y) AS VARCHAR)) AS got,
  list_sort(from_json(json_extract(should, '$[*].Action'), '["VARCHAR"]')) AS want_a, json_merge_patch(CASE WHEN json_type(should, '$[0].Action_Input') = 'VARCHAR' THEN json_extract_string(should, '$[0].Action_Input') ELSE CAST(json_extract(should, '$[0].Action_Input') AS VARCHAR) END,
    CAST(json_extract(should, '$[1].Action_Input') AS VARCHAR)) AS early FROM (SELECT *, '' AS x FROM f)),
h AS (SELECT event_id, a, got, want_a, CAST(early AS VARCHAR) AS want FROM g)
SELECT event_id, CASE WHEN a = want_a AND {_sorted_entries("got")} = {_sorted_entries("want")} THEN 1.0 ELSE 0.0 END AS score FROM h""",
)
def x14(spark, d):
    e = table(spark, d, "events").select("event_id", F.expr(SAID).alias("said"), F.expr(SHOULD).alias("should"))
    return e.select("event_id", S.tool_score(F.col("said"), F.col("should")).alias("score"))


@query("x15_exact_match", "SELECT c_custkey, 1.0 AS em, CASE WHEN c_custkey % 2 = 0 THEN 1.0 ELSE 0.0 END AS sub FROM customer")
def x15(spark, d):
    name = F.concat(F.lit("customer "), F.col("c_custkey").cast("string"))
    said = F.concat(F.lit("The  "), F.upper(name), F.lit("!"))
    longer = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("it is a "), name, F.lit(", surely"))).otherwise(F.lit("nobody"))
    return table(spark, d, "customer").select("c_custkey", S.exact_match(said, F.array(F.lit("x"), name)).alias("em"), S.substring_match(longer, F.array(name)).alias("sub"))


@query("x17_numeric_equal", "SELECT o_orderkey, o_orderkey % 3 <> 2 AS same FROM orders")
def x17(spark, d):
    n = F.col("o_custkey") + 1
    other = F.when(F.col("o_orderkey") % 3 == 0, F.format_number(n, 0)).when(F.col("o_orderkey") % 3 == 1, (n * 100).cast("string")).otherwise((n * 7).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", S.numeric_equal(n.cast("string"), other).alias("same"))


@query("x19_code_blocks", "SELECT doc_id, 'longer block ' || source || chr(10) AS longest, 'x' || chr(10) AS last FROM documents")
def x19(spark, d):
    text = F.concat(F.lit("```\na\n```\nthen\n```text\nlonger block "), F.col("source"), F.lit("\n```\nand ```python\nx\n```"))
    return table(spark, d, "documents").select("doc_id", S.longest_fence(text).alias("longest"), S.last_python(text).alias("last"))


@query("x20_test_results", "SELECT uid, CASE WHEN bool_and(ok) THEN 1.0 ELSE 0.0 END AS sparse, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT user_id AS uid, value > 5 AS ok FROM events) GROUP BY 1")
def x20(spark, d):
    per = table(spark, d, "events").groupBy(F.col("user_id").alias("uid")).agg(F.collect_list(F.col("value") > 5).alias("r"))
    return rounded(per.select("uid", S.tests_score(F.col("r")).alias("sparse"), S.tests_score(F.col("r"), False).alias("share")), "share")


@query("x23_score_by_source", f"WITH {R}, s AS (SELECT *, CASE ord WHEN 1 THEN 'openai/gsm8k' WHEN 2 THEN 'gpqa' WHEN 3 THEN 'aime24' ELSE 'searchR1_nq' END AS source FROM r) SELECT row_id, ord, CASE ord WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 WHEN 3 THEN -1.0 ELSE 0.0 END AS score FROM s")
def x23(spark, d):
    source = F.element_at(F.array(*[F.lit(s) for s in ("openai/gsm8k", "gpqa", "aime24", "searchR1_nq")]), F.col("ord"))
    return responses(spark, d).select("row_id", "ord", S.score_by_source(source, F.col("response"), F.col("truth")).alias("score"))


@query("x24_without_thoughts", "SELECT doc_id, source || lang AS text FROM documents")
def x24(spark, d):
    return table(spark, d, "documents").select("doc_id", S.without_thoughts(F.concat(F.lit("<think>a\nb</think> \n"), F.col("source"), F.lit("<think>c</think>"), F.col("lang"))).alias("text"))


@query("x32_clean_wiki", "SELECT doc_id, 'Go. ' || source || ' on' AS text, upper(left(lang, 1)) || lower(substr(lang, 2)) AS name FROM documents")
def x32(spark, d):
    text = F.concat(F.lit(" Go [title]"), F.col("source"), F.lit(" [step 1] on"))
    return table(spark, d, "documents").select("doc_id", S.clean_wiki(text).alias("text"), S.capitalise(F.col("lang")).alias("name"))


@query("x34_tool_calls", "SELECT event_id, 'see  end' AS content, event_type AS name, props AS arguments FROM events")
def x34(spark, d):
    text = F.concat(F.lit('see <tool_call>{"name": "'), F.col("event_type"), F.lit('", "arguments": '), F.col("props"), F.lit("}</tool_call> end<tool_call>bad</tool_call>"))
    t = S.tool_calls(text)
    one = F.element_at(t["calls"], 1)
    return table(spark, d, "events").select("event_id", t["content"].alias("content"), one["name"].alias("name"), F.regexp_replace(one["arguments"], r'":(?=\d)', '": ').alias("arguments"))


#: One expression for Spark and SQL: reasoning that holds a call, padding, and up to two calls.
CHANNELS = """CASE WHEN event_id % 2 = 0 THEN '<|start|>assistant' ELSE '' END || '<|channel|>analysis<|message|>try' || chr(10) || '<|start|>assistant<|channel|>commentary to=functions.no <|constrain|>json<|message|>{}<|call|><|end|>'
  || CASE WHEN event_id % 3 > 0 THEN '<|start|>assistant<|channel|>commentary to=functions.' || event_type || ' <|constrain|>json<|message|>' || props || '<|call|>' ELSE 'so ' END || '<|pad|>'
  || CASE WHEN event_id % 5 = 0 THEN '<|start|>assistant<|channel|>final<|message|>done' WHEN event_id % 5 = 1 THEN '<|start|>assistant<|channel|>x to=functions.user_' || CAST(user_id AS STRING) || ' <|constrain|>json<|message|>not' || chr(10) || 'json<|call|> end' ELSE '' END"""


@query(
    "x34_channel_calls",
    rf"""WITH t AS (SELECT event_id, regexp_replace(replace({CHANNELS}, '<|pad|>', ''), '{S.CHANNEL_REASONING}', '', 'gs') AS x FROM events)
SELECT event_id, regexp_replace(x, '{S.CHANNEL_CALL}', '', 'gs') AS content, array_to_string(regexp_extract_all(x, '{S.CHANNEL_CALL}', 1, 's'), ',') AS names, array_to_string(regexp_extract_all(x, '{S.CHANNEL_CALL}', 2, 's'), ';') AS arguments FROM t""",
)
def x34_channel_calls(spark, d):
    t = S.channel_calls(F.expr(CHANNELS), "<|pad|>")
    return table(spark, d, "events").select("event_id", t["content"].alias("content"), F.array_join(t["calls"]["name"], ",").alias("names"), F.array_join(t["calls"]["arguments"], ";").alias("arguments"))


@query("x35_message_mask", "SELECT conv_id, [CASE WHEN role = 'assistant' THEN 1 ELSE 0 END FOR role IN list(role ORDER BY turn)] AS mask FROM conversations WHERE turn IS NOT NULL GROUP BY conv_id")
def x35(spark, d):
    rows = table(spark, d, "conversations").filter("turn IS NOT NULL")
    packed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"))
    return packed.select("conv_id", F.transform("m", lambda m: F.when(m["role"] == "assistant", 1).otherwise(0)).alias("mask"))


@query("x37_pad_or_cut", "SELECT vec_id, [1, 2, 3][1:CAST(vec_id % 4 AS INTEGER)] || [0 FOR i IN range(3 - CAST(vec_id % 4 AS INTEGER))] AS padded, label FROM (SELECT vec_id, label FROM embeddings WHERE vec_id % 4 < 4)")
def x37(spark, d):
    ids = F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), (F.col("vec_id") % 4).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", S.pad_or_cut(ids, 3, 0).alias("padded"), "label")


@query("x44_overlong", "SELECT doc_id, round(least(-(n_chars - 1500) / 500.0 * 0.5, 0.0), 6) + 0.0 AS penalty FROM documents")
def x44(spark, d):
    return rounded(table(spark, d, "documents").select("doc_id", S.overlong_penalty(F.col("n_chars"), 2000, 500, 0.5).alias("penalty")), "penalty")


@query("x45_last_token_reward", f"WITH {TOK}, s AS (SELECT sample_id, sum(mask) AS len, count(*) AS w FROM tok GROUP BY 1), p AS (SELECT *, unnest(range(w)) AS i FROM s) SELECT sample_id, list(CASE WHEN i = CASE WHEN len > 0 THEN len - 1 ELSE w - 1 END THEN 1.0 ELSE 0.0 END ORDER BY i) AS rewards FROM p GROUP BY sample_id")
def x45(spark, d):
    per = tok(spark, d).groupBy("sample_id").agg(F.sum("mask").cast("int").alias("n"), F.count("*").cast("int").alias("w"))
    return per.select("sample_id", S.reward_on_last(F.lit(1.0), F.col("n"), F.col("w")).alias("rewards"))


@query("p17_placeholders", "WITH t AS (SELECT doc_id, 'look: <image>' || replace(text, 'a', '<image>') || '<image>' AS x FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, x, string_split(x, '<image>') AS s FROM t) SELECT doc_id, len(s) - 1 + len(list_filter(s, lambda v: v <> '')) AS n, len(s) - 1 AS media FROM p")
def p17(spark, d):
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    parts = S.expand_media(F.concat(F.lit("look: <image>"), F.replace("text", F.lit("a"), F.lit("<image>")), F.lit("<image>")))
    rows = docs.select("doc_id", parts.alias("parts"))
    return rows.select("doc_id", F.size("parts").cast("long").alias("n"), F.size(F.filter("parts", lambda p: p["type"] == "image")).cast("long").alias("media"))


@query("n20_cut_tool_response", "SELECT item_id, left(text, 40) || '...(truncated)' AS head, '(truncated)...' || right(text, 40) AS tail, left(text, 20) || '...(truncated)...' || right(text, 20) AS both FROM benchmark")
def n20(spark, d):
    t = F.col("text")
    return table(spark, d, "benchmark").select("item_id", S.cut_response(t, 40, "left").alias("head"), S.cut_response(t, 40, "right").alias("tail"), S.cut_response(t, 40, "middle").alias("both"))


@query("n16_status_codes", "SELECT event_id, CASE event_type WHEN 'click' THEN CASE WHEN value > 10 THEN 1 ELSE 0 END WHEN 'view' THEN -2 WHEN 'purchase' THEN -3 WHEN 'login' THEN -4 ELSE -1 END AS code FROM events")
def n16(spark, d):
    status = F.when(F.col("event_type") == "click", "ok").when(F.col("event_type") == "view", "runtime_error").when(F.col("event_type") == "purchase", "timeout").when(F.col("event_type") == "login", "compile_error").otherwise("api_error")
    return table(spark, d, "events").select("event_id", S.status_code(status, F.col("value") > 10).alias("code"))


@query("n17_tool_step_reward", f"WITH {EV} SELECT uid, sample_id, CASE WHEN score > coalesce(lag(score) OVER w, 0) THEN 0.0 ELSE -0.05 END AS reward FROM ev WINDOW w AS (PARTITION BY uid ORDER BY sample_id)")
def n17(spark, d):
    before = F.coalesce(F.lag("score").over(W.partitionBy("uid").orderBy("sample_id")), F.lit(0.0))
    return ev(spark, d).select("uid", "sample_id", F.when(F.col("score") > before, 0.0).otherwise(-0.05).alias("reward"))


@query("n18_last_assistant", "SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL AND conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) = count(DISTINCT turn)) GROUP BY conv_id")
def n18(spark, d):
    rows = table(spark, d, "conversations")
    whole = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.countDistinct("turn").alias("k")).filter("n = k").select("conv_id")
    said = rows.filter("role = 'assistant' AND turn IS NOT NULL").join(whole, "conv_id", "left_semi")
    return said.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


@query("a17_majority", f"WITH {EV}, c AS (SELECT uid, pred, count(*) AS n, min(sample_id) AS first, arg_min(score, sample_id) AS v FROM ev GROUP BY 1, 2) SELECT uid, pred AS label, v AS value, n AS votes FROM c QUALIFY row_number() OVER (PARTITION BY uid ORDER BY n DESC, first) = 1")
def a17(spark, d):
    return G.majority(ev(spark, d), ["uid"], "pred", "score", "sample_id")


@query("a16_expected_extremes", f"WITH {EV}, r AS (SELECT uid, score, row_number() OVER (PARTITION BY uid ORDER BY score) AS i, count(*) OVER (PARTITION BY uid) AS c FROM ev), k AS (SELECT *, unnest([2, 4, 8]) AS n FROM r) SELECT uid, n, round(sum(score * (pow(i * 1.0 / c, n) - pow((i - 1) * 1.0 / c, n))), 6) AS best, round(sum(score * (pow((c - i + 1) * 1.0 / c, n) - pow((c - i) * 1.0 / c, n))), 6) AS worst FROM k GROUP BY 1, 2")
def a16(spark, d):
    return rounded(M.expected_extremes(ev(spark, d), ["uid"], "score", [2, 4, 8]), "best", "worst")


@query("a18_validation", f"WITH {EV}, p AS (SELECT pred, uid, avg(score) AS m, stddev_pop(score) AS s, count(*) AS n FROM ev GROUP BY 1, 2) SELECT pred, round(avg(m), 6) AS mean, round(avg(s), 6) AS std, max(n) AS n FROM p GROUP BY 1")
def a18(spark, d):
    return rounded(M.validation(ev(spark, d), "pred", "uid", "score"), "mean", "std")


LONG = "metrics AS (SELECT step, unnest(['reward/max', 'reward/min', 'timing_s/gen', 'score/mean', 'loss']) AS key, unnest([hi, lo, n, avg_, total]) AS value FROM (SELECT step, max(score) AS hi, min(score) AS lo, CAST(count(*) AS DOUBLE) AS n, avg(score) AS avg_, sum(score) AS total FROM ev GROUP BY step))"


def step_metrics(spark, d):
    per = ev(spark, d).groupBy("step").agg(F.max("score").alias("a"), F.min("score").alias("b"), F.count("*").cast("double").alias("c"), F.avg("score").alias("d"), F.sum("score").alias("e"))
    return per.selectExpr("step", "stack(5, 'reward/max', a, 'reward/min', b, 'timing_s/gen', c, 'score/mean', d, 'loss', e) AS (key, value)")


@query("a07_reduce_by_name", f"WITH {EV}, {LONG} SELECT key, round(CASE WHEN contains(key, 'max') THEN max(value) WHEN contains(key, 'min') THEN min(value) ELSE avg(value) END, 6) AS value FROM metrics GROUP BY key")
def a07(spark, d):
    return rounded(M.reduce_by_name(step_metrics(spark, d)), "value")


@query("a09_aggregate_steps", f"WITH {EV}, {LONG} SELECT key, round(CASE WHEN key = 'loss' THEN arg_max(value, step) WHEN starts_with(key, 'timing_s/') THEN sum(value) WHEN contains(key, 'mean') THEN avg(value) WHEN contains(key, 'max') THEN max(value) WHEN contains(key, 'min') THEN min(value) ELSE avg(value) END, 6) AS value FROM metrics GROUP BY key")
def a09(spark, d):
    return rounded(M.aggregate_steps(step_metrics(spark, d), {"loss": "last"}), "value")


@query("a11_batch_metrics", f"WITH {TOK}, s AS (SELECT sample_id, sum(mask) AS len, count(*) AS w, sum(reward * mask) AS score FROM tok GROUP BY 1) SELECT round(avg(score) FILTER (len > 0), 6) AS score_mean, round(max(score) FILTER (len > 0), 6) AS score_max, round(min(score) FILTER (len > 0), 6) + 0.0 AS score_min, round(avg(len), 6) AS length_mean, CAST(max(len) AS BIGINT) AS length_max, CAST(min(len) AS BIGINT) AS length_min, round(avg(CASE WHEN len = w THEN 1.0 ELSE 0.0 END), 6) AS clip_ratio, round(avg(CASE WHEN len = 0 THEN 1.0 ELSE 0.0 END), 6) AS aborted_ratio FROM s")
def a11(spark, d):
    per = tok(spark, d).groupBy("sample_id").agg(F.sum("mask").alias("len"), F.count("*").alias("w"), F.sum(F.col("reward") * F.col("mask")).alias("score"))
    live = F.when(F.col("len") > 0, F.col("score"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    out = per.agg(F.avg(live).alias("score_mean"), F.max(live).alias("score_max"), F.min(live).alias("score_min"), F.avg("len").alias("length_mean"), F.max("len").alias("length_max"), F.min("len").alias("length_min"), share(F.col("len") == F.col("w")).alias("clip_ratio"), share(F.col("len") == 0).alias("aborted_ratio"))
    return rounded(out, "score_mean", "score_max", "score_min", "length_mean", "clip_ratio", "aborted_ratio")


@query("a11_explained_variance", f"WITH {TOK}, m AS (SELECT reward - value AS e, reward AS r FROM tok WHERE mask = 1) SELECT round(1 - var_samp(e) / (var_samp(r) + 1e-5), 6) AS explained_variance FROM m")
def a11_ev(spark, d):
    rows = tok(spark, d).filter("mask = 1")
    return rounded(rows.agg((1 - F.var_samp(F.col("reward") - F.col("value")) / (F.var_samp("reward") + 1e-5)).alias("explained_variance")), "explained_variance")


@query("a15_variance_proxies", f"WITH {TOK}, s AS (SELECT sample_id, sum(reward * mask) AS a, sum((1 - 2 * exp(old_lp) + 0.3) * mask) AS w FROM tok GROUP BY 1), p AS (SELECT avg(a * a * w) AS p2, pow(avg(a * sqrt(greatest(w, 0))), 2) AS p1, count(*) AS n FROM s) SELECT round(p2, 6) AS power, round(greatest((p2 - p1) / (n - 1), 0), 9) AS variance FROM p")
def a15(spark, d):
    w = (1 - 2 * F.exp("old_lp") + 0.3) * F.col("mask")
    per = tok(spark, d).groupBy("sample_id").agg(F.sum(F.col("reward") * F.col("mask")).alias("a"), F.sum(w).alias("w"))
    p2, p1 = F.avg(F.col("a") * F.col("a") * F.col("w")), F.avg(F.col("a") * F.sqrt(F.greatest("w", F.lit(0.0))))
    out = per.agg(p2.alias("power"), F.greatest((p2 - p1 * p1) / (F.count("*") - 1), F.lit(0.0)).alias("variance"))
    return out.select(F.round("power", 6).alias("power"), F.round("variance", 9).alias("variance"))


@query("a24_drift", f"WITH {TOK}, p AS (SELECT exp(old_lp) AS p, exp(rollout_lp) AS q FROM tok WHERE mask = 1) SELECT round(max(abs(p - q)), 6) AS diff_max, round(avg(abs(p - q)), 6) AS diff_mean, round(stddev_samp(abs(p - q)), 6) AS diff_std, round(corr(p, q), 6) AS pearson FROM p")
def a24(spark, d):
    out = M.drift(tok(spark, d), "old_lp", "rollout_lp", "mask")
    return rounded(out, *out.columns)


@query("a25_percentiles", f"WITH {EV} SELECT pred, round(quantile_cont(score, 0.5), 6) AS tp50, round(quantile_cont(score, 0.95), 6) AS tp95, round(quantile_cont(score, 0.99), 6) AS tp99 FROM ev GROUP BY 1")
def a25(spark, d):
    q = {"tp50": 0.5, "tp95": 0.95, "tp99": 0.99}
    return rounded(ev(spark, d).groupBy("pred").agg(*[F.percentile("score", p).alias(k) for k, p in q.items()]), *q)


@query("a26_partial_work", "SELECT l_suppkey, count(*) FILTER (l_linenumber > 3) AS partial, round(avg(CASE WHEN l_linenumber > 3 THEN 1.0 ELSE 0.0 END), 6) AS ratio, max(abs(l_linenumber - 1)) AS longest, count(DISTINCT l_linenumber) AS versions FROM lineitem GROUP BY 1")
def a26(spark, d):
    moved = F.col("l_linenumber") > 3
    out = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(moved).alias("partial"), F.avg(F.when(moved, 1.0).otherwise(0.0)).alias("ratio"), F.max(F.abs(F.col("l_linenumber") - 1)).alias("longest"), F.countDistinct("l_linenumber").alias("versions"))
    return rounded(out, "ratio")


@query("a28_slowest_row", f"WITH {EV} SELECT pred, arg_min(sample_id, sample_id) FILTER (score = top) AS slowest, max(top) AS time FROM (SELECT *, max(score) OVER (PARTITION BY pred) AS top FROM ev) GROUP BY pred")
def a28(spark, d):
    return ev(spark, d).groupBy("pred").agg(F.max_by("sample_id", F.struct("score", -F.col("sample_id"))).alias("slowest"), F.max("score").alias("time"))


@query("m02_reward_manager", f"WITH {R}, e AS (SELECT *, regexp_extract_all(right(response, 300), '#### (-?[0-9.,]+)', 1) AS f FROM r), s AS (SELECT *, CASE WHEN len(f) > 0 AND replace(f[len(f)], ',', '') = truth THEN 1.0 ELSE 0.0 END AS acc FROM e) SELECT row_id, ord, acc, round(acc + least(-(length(response) - 12) / 8.0 * 1.0, 0), 6) AS score FROM s")
def m02(spark, d):
    r = responses(spark, d).withColumn("acc", S.gsm8k_score(F.col("response"), F.col("truth")))
    return rounded(r.select("row_id", "ord", "acc", (F.col("acc") + S.overlong_penalty(F.length("response"), 20, 8, 1.0)).alias("score")), "score")


@query("m08_self_distillation", f"WITH {EV}, s AS (SELECT e.uid, e.sample_id, min(o.sample_id) AS sol FROM ev e LEFT JOIN ev o ON o.uid = e.uid AND o.sample_id <> e.sample_id AND o.score >= 90 GROUP BY 1, 2) SELECT round(avg(CASE WHEN sol IS NULL THEN 0.0 ELSE 1.0 END), 6) AS with_solution, count(DISTINCT CASE WHEN sol IS NOT NULL THEN uid END) AS groups_with_solution FROM s")
def m08(spark, d):
    s = G.sibling_success(ev(spark, d), "uid", "sample_id", F.col("score") >= 90)
    return rounded(s.agg(F.avg(F.col("solution").isNotNull().cast("double")).alias("with_solution"), F.countDistinct(F.when(F.col("solution").isNotNull(), F.col("uid"))).alias("groups_with_solution")), "with_solution")


@query("p16_training_record", "SELECT doc_id, source AS data_source, 'system' AS first_role, 'user' AS last_role, lang AS last_content, 2 AS n_messages, 'text' AS ability, 'rule' AS style, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS ground_truth, 'train' AS split, CAST(doc_id AS VARCHAR) AS index FROM documents")
def p16(spark, d):
    from tessella.sources.datasets import training_record

    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("dataset"), F.when(F.col("doc_id") % 2 == 0, "code").otherwise("text").alias("kind"), F.col("lang").alias("tests"), F.col("source").alias("answer"), F.col("lang").alias("prompt"))
    r = training_record(docs, "doc_id", "train", system="Be brief.", ability="text")
    return r.select("doc_id", "data_source", F.col("prompt")[0]["role"].alias("first_role"), F.col("prompt")[1]["role"].alias("last_role"), F.col("prompt")[1]["content"].alias("last_content"), F.size("prompt").alias("n_messages"), "ability", "reward_model.*", "extra_info.*")
