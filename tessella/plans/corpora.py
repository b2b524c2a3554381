"""Dataset builders, dispatch and remaining functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators import dispatch as D
from tessella.plans.rollouts import rounded
from tessella.plans.views import EV, ev
from tessella.session import table
from tessella.sources import loaders as L

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("e01_train_corpus", "SELECT doc_id AS idx, CASE WHEN lang = 'en' THEN 'code' ELSE 'text' END AS kind, source AS dataset, '-' AS answer, '-' AS elo, lang || CASE WHEN lang = 'en' THEN ' as code' ELSE '' END AS prompt, '-' AS description, '-' AS tests, '-' AS system FROM documents")
def e01(spark, d):
    raw = table(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.when(F.col("lang") == "en", "code").otherwise("text").alias("kind"), F.col("source").alias("dataset"), F.col("lang").alias("prompt"))
    return L.build("train", raw, suffixes={"code": " as code"})


@query("e03_choices", "SELECT event_id AS idx, 'mcq' AS kind, 'computer science' AS dataset, '-' AS answer, '1500' AS elo, event_type || chr(10) || 'A. ' || user_id || chr(10) || 'B. no' || chr(10) || 'Give the letter only.' AS prompt, '-' AS description, '-' AS tests, '-' AS system FROM events WHERE event_id % 2 = 0")
def e03(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("idx"), F.col("event_type").alias("question"), F.array(F.col("user_id").cast("string"), F.lit("no")).alias("options"), F.when(F.col("event_id") % 2 == 0, "computer science").otherwise("law").alias("category"))
    return L.build("choices", rows, category="computer_science")


@query("e14_gsm8k", "SELECT 'openai/gsm8k' AS data_source, 'q' || o_orderkey || ' Let''s think step by step and output the final answer after \"####\".' AS content, CAST(o_custkey AS VARCHAR) AS ground_truth, o_orderkey AS index FROM orders")
def e14(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("question"), F.concat(F.lit("so\n#### "), F.format_number("o_custkey", 0)).alias("answer"))
    out = L.build("gsm8k", rows)
    return out.select("data_source", F.col("prompt")[0]["content"].alias("content"), "reward_model.ground_truth", "extra_info.index")


@query("e15_endings", "SELECT doc_id AS index, lang || ': ' || source || ' ' || upper(left(source, 1)) || lower(substr(source, 2)) AS content, 1 AS ground_truth FROM documents WHERE doc_id % 2 = 1")
def e15(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.col("lang").alias("activity"), F.col("source").alias("ctx_a"), F.col("source").alias("ctx_b"), F.array("lang", "source").alias("endings"), F.when(F.col("doc_id") % 2 == 1, "1").otherwise("").alias("label"))
    return L.build("hellaswag", rows).select("extra_info.index", F.col("prompt")[0]["content"].alias("content"), "reward_model.ground_truth")


@query("e16_preference_head", "WITH o AS (SELECT doc_id, source AS prompt, lang AS chosen, source AS rejected, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents) SELECT doc_id, prompt, chosen, rejected FROM o WHERE rn >= floor(n * 0.75)")
def e16(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("prompt"), F.col("lang").alias("chosen"), F.col("source").alias("rejected"))
    return L.build("preference_rm", rows, order="doc_id", part="test")


@query("e17_search_qa", "SELECT 'searchR1_' || source AS data_source, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, source) AS ground_truth, doc_id AS index FROM documents")
def e17(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.col("lang").alias("question"), F.col("source").alias("golden_answers"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("ground_truth"), F.col("source").alias("data_source"))
    return L.build("search_qa", rows).select("data_source", "reward_model.ground_truth", "extra_info.index")


@query("e18_conversations", "SELECT conv_id, count(*) AS n, string_agg(role, '>' ORDER BY turn, role, text) AS roles FROM conversations WHERE turn IS NOT NULL GROUP BY conv_id")
def e18(spark, d):
    out = L.build("conversations", table(spark, d, "conversations").filter("turn IS NOT NULL"))
    return out.select("conv_id", F.size("messages").cast("long").alias("n"), F.array_join(F.transform("messages", lambda m: m["role"]), ">").alias("roles"))


@query("e07_code", "SELECT item_id AS idx, 'code' AS kind, '-' AS dataset, '-' AS answer, '1200' AS elo, 'Do ' || item_id || ' things.' || chr(10) || '-----' || chr(10) || 'rest' || chr(10) || 'Use this signature: def f(x):' AS prompt, 'Do ' || item_id || ' things.' AS description, '{\"inputs\":[\"1\"],\"outputs\":[\"2\"],\"testtype\":\"stdin\",\"fn_name\":\"\"}' AS tests, '-' AS system FROM benchmark")
def e07(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("idx"), F.concat(F.lit("Do "), F.col("item_id").cast("string"), F.lit(" things.\n-----\nrest")).alias("statement"), F.lit("def f(x):").alias("signature"), F.array(F.lit("1")).alias("inputs"), F.array(F.lit("2")).alias("outputs"), F.lit(1200).alias("rating"))
    return L.build("code", rows)


@query("u15_sample_tests", "WITH t AS (SELECT item_id, unnest(range(item_id % 7)) AS i FROM benchmark), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY md5('0|' || item_id || '|' || i), i) AS k, count(*) OVER (PARTITION BY item_id) AS n FROM t) SELECT item_id, list(i ORDER BY i) AS kept FROM r WHERE k <= greatest(1, CAST(floor(n * 0.5) AS BIGINT)) GROUP BY item_id")
def u15(spark, d):
    n = (F.col("item_id") % 7).cast("int")
    rows = table(spark, d, "benchmark").filter(n > 0).select("item_id", F.sequence(F.lit(0), n - 1).alias("t"))
    return rows.select("item_id", L.sample_tests(F.col("t"), F.col("item_id")).alias("kept"))


@query("d01_one_to_all", "SELECT doc_id, lang, n FROM documents LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) USING (lang)")
def d01(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return D.one_to_all(docs, docs.groupBy("lang").agg(F.count("*").alias("n")), ["lang"]).select("doc_id", "lang", "n")


@query("d03_data_parallel", f"WITH {EV} SELECT sample_id, round(score * 2, 6) AS doubled FROM ev")
def d03(spark, d):
    out = D.data_parallel(ev(spark, d).select("sample_id", "score"), lambda p: p.assign(doubled=p["score"] * 2)[["sample_id", "doubled"]], "sample_id long, doubled double")
    return rounded(out, "doubled")


@query("d08_all_reduce_max", f"WITH {EV} SELECT sample_id, max(score) OVER () AS max_score FROM ev")
def d08(spark, d):
    return D.all_reduce_max(ev(spark, d).select("sample_id", "score"), "score").select("sample_id", "max_score")


@query("n10_console_lines", f"WITH {EV} SELECT 'step:' || CAST(step AS VARCHAR) || ' - n:' || count(*) || ' - users:' || count(DISTINCT uid) AS line FROM ev GROUP BY step")
def n10(spark, d):
    per = ev(spark, d).groupBy("step").agg(F.count("*").alias("n"), F.countDistinct("uid").alias("users"))
    return per.select(F.concat_ws(" - ", F.concat(F.lit("step:"), F.col("step").cast("string")), F.concat(F.lit("n:"), "n"), F.concat(F.lit("users:"), "users")).alias("line"))


@query("n19_agent_replay", "WITH c AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations WHERE turn IS NOT NULL AND conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) = count(DISTINCT turn))), s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM c) SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS mask, total <= 2000 AS within FROM s")
def n19(spark, d):
    rows = table(spark, d, "conversations")
    whole = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.countDistinct("turn").alias("k")).filter("n = k").select("conv_id")
    said = rows.filter("turn IS NOT NULL").join(whole, "conv_id", "left_semi")
    total = F.sum(F.length("text")).over(W.partitionBy("conv_id").orderBy("turn"))
    return said.select("conv_id", "turn", F.when(F.col("role") == "assistant", 1).otherwise(0).alias("mask"), (total <= 2000).alias("within"))


@query("a31_topk_share", f"WITH {EV}, r AS (SELECT pred, score, row_number() OVER (PARTITION BY pred ORDER BY score DESC, sample_id) AS k FROM ev) SELECT pred, round(sum(score) FILTER (k <= 10) / sum(score), 6) AS share, max(score) AS hi, min(score) AS lo FROM r GROUP BY 1")
def a31(spark, d):
    k = F.row_number().over(W.partitionBy("pred").orderBy(F.desc("score"), "sample_id"))
    r = ev(spark, d).withColumn("k", k)
    return rounded(r.groupBy("pred").agg((F.sum(F.when(F.col("k") <= 10, F.col("score"))) / F.sum("score")).alias("share"), F.max("score").alias("hi"), F.min("score").alias("lo")), "share")


@query("a13_timing_per_token", f"WITH {EV}, t AS (SELECT CAST(sum(CASE WHEN pred = 'click' THEN 1 ELSE 0 END) AS DOUBLE) AS response, CAST(count(*) AS DOUBLE) AS total FROM ev) SELECT name, round(seconds * 1000 / CASE WHEN name = 'gen' THEN response ELSE total END, 6) AS per_token_ms, round(total / seconds / 8, 6) AS throughput FROM (VALUES ('gen', 12.5), ('ref', 3.5), ('values', 2.0)) v(name, seconds), t")
def a13(spark, d):
    tokens = ev(spark, d).agg(F.count_if(F.col("pred") == "click").cast("double").alias("response"), F.count("*").cast("double").alias("total"))
    timing = spark.createDataFrame([("gen", 12.5), ("ref", 3.5), ("values", 2.0)], "name string, seconds double").crossJoin(F.broadcast(tokens))
    per = F.col("seconds") * 1000 / F.when(F.col("name") == "gen", F.col("response")).otherwise(F.col("total"))
    return rounded(timing.select("name", per.alias("per_token_ms"), (F.col("total") / F.col("seconds") / 8).alias("throughput")), "per_token_ms", "throughput")


@query("s13_epochs", "SELECT doc_id, CAST(e AS INTEGER) AS epoch FROM documents, (SELECT unnest(range(2)) AS e)")
def s13(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("epoch"))


@query("k01_parquet_round_trip", "SELECT item_id, text FROM benchmark")
def k01(spark, d):
    from tessella.sources.datasets import read, write_parquet
    from tessella.streaming.rollouts import state_folder

    path = state_folder(spark) + "/benchmark.parquet"
    write_parquet(table(spark, d, "benchmark"), path)
    return read(spark, path)


@query("k04_step_dumps", "SELECT CAST(event_id % 3 AS INTEGER) AS step, event_id, event_type FROM events")
def k04(spark, d):
    from tessella.sources.datasets import write_steps
    from tessella.streaming.rollouts import state_folder

    path = state_folder(spark) + "/dumps"
    write_steps(table(spark, d, "events").select((F.col("event_id") % 3).cast("int").alias("step"), "event_id", "event_type"), path)
    return spark.read.schema("event_id long, event_type string, step int").json(path).select("step", "event_id", "event_type")
