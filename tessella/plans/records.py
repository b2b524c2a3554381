"""Batches as records: selection, merging, samplers, sinks and readers, dispatch, streaming details, annex functions."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import scoring as S
from tessella.functions import texts as T
from tessella.operators import batch as B
from tessella.operators import correction as C
from tessella.operators import dispatch as D
from tessella.operators import metrics as M
from tessella.operators import partition as P
from tessella.plans.rollouts import rounded
from tessella.plans.views import EV, SEQS, TOK, ev, seqs, tok
from tessella.session import table
from tessella.sources import datasets as X
from tessella.streaming import rollouts as Z

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def events(spark, d):
    return table(spark, d, "events")


# --- readers and sinks -------------------------------------------------------------------------------------------------


@query("s02_jsonl", "SELECT n_nationkey, n_name FROM nation")
def s02(spark, d):
    path = Z.state_folder(spark) + "/nation.jsonl"
    table(spark, d, "nation").select("n_nationkey", "n_name").write.json(path)
    return X.read(spark, path, "n_nationkey long, n_name string")


@query("s03_by_suffix", "SELECT r_regionkey, r_name, 'parquet' AS kind FROM region UNION ALL SELECT r_regionkey, r_name, 'jsonl' FROM region")
def s03(spark, d):
    where, region = Z.state_folder(spark), table(spark, d, "region").select("r_regionkey", "r_name")
    region.write.json(f"{where}/r.jsonl")
    X.write_parquet(region, f"{where}/r.parquet")
    kinds = {"parquet": X.read(spark, f"{where}/r.parquet"), "jsonl": X.read(spark, f"{where}/r.jsonl", "r_regionkey long, r_name string")}
    return B.unite([df.select("r_regionkey", "r_name", F.lit(k).alias("kind")) for k, df in kinds.items()])


@query("s04_files_in_order", "SELECT CAST(1 AS INTEGER) AS file, r_regionkey AS key FROM region UNION ALL SELECT 0, n_nationkey FROM nation")
def s04(spark, d):
    where = Z.state_folder(spark)
    X.write_parquet(table(spark, d, "nation").select(F.col("n_nationkey").alias("key")), f"{where}/a.parquet")
    X.write_parquet(table(spark, d, "region").select(F.col("r_regionkey").alias("key")), f"{where}/b.parquet")
    return X.read_in_order(spark, [f"{where}/a.parquet", f"{where}/b.parquet"]).select(F.col("_file").alias("file"), "key")


@query("s05_named_dataset", "SELECT item_id, 'benchmark' AS dataset FROM benchmark")
def s05(spark, d):
    X.register("benchmark-items")(lambda s: table(s, d, "benchmark").select("item_id", F.lit("benchmark").alias("dataset")))
    return X.load(spark, "benchmark-items")


@query("s07_step_files", "SELECT CAST(event_id % 3 AS INTEGER) AS step, event_id, event_type FROM events")
def s07(spark, d):
    where = Z.state_folder(spark)
    for step in range(3):
        events(spark, d).filter(F.col("event_id") % 3 == step).select("event_id", "event_type").write.json(f"{where}/{step}.jsonl")
    return X.step_dumps(spark, where).select("step", "event_id", "event_type")


@query("s08_preference_pairs", "SELECT item_id, CAST(place AS INTEGER) AS place, CASE place WHEN 0 THEN text ELSE 'no ' || item_id END AS response FROM benchmark, (SELECT unnest([0, 1]) AS place)")
def s08(spark, d):
    from tessella.sources.loaders import build

    path = Z.state_folder(spark) + "/pairs.parquet"
    n = F.col("item_id").cast("string")
    X.write_parquet(table(spark, d, "benchmark").select(n.alias("prompt"), F.col("text").alias("chosen"), F.concat(F.lit("no "), n).alias("rejected")), path)
    return build("preference_sft", X.read(spark, path)).select(F.col("prompt").cast("long").alias("item_id"), "place", "response")


@query("s11_cached", "SELECT uid, count(*) AS n FROM (SELECT user_id AS uid FROM events) GROUP BY 1")
def s11(spark, d):
    path, made = Z.state_folder(spark) + "/rollouts", []

    def make():
        made.append(1)
        return ev(spark, d).groupBy("uid").agg(F.count("*").alias("n"))

    X.cached(spark, path, make)
    out = X.cached(spark, path, make)
    if len(made) != 1:
        raise AssertionError("the table was made again")
    return out


@query("k02_parquet_sink", "SELECT c_custkey, c_name FROM customer")
def k02(spark, d):
    path = Z.state_folder(spark) + "/customer.parquet"
    X.write_parquet(table(spark, d, "customer").select("c_custkey", "c_name"), path)
    return spark.read.parquet(path)


@query("k03_json_array", "WITH n AS (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS rn, count(*) OVER () AS c FROM nation) SELECT rn, CASE WHEN rn = 0 THEN '[' ELSE ',' END || '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' || CASE WHEN rn = c - 1 THEN ']' ELSE '' END AS line FROM n")
def k03(spark, d):
    lines = table(spark, d, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("x")).withColumn("x", F.explode(F.array("x", F.lit("  "))))
    return X.json_array_lines(X.parse_json_lines(lines, "x", "n_nationkey long, n_name string"), ["n_nationkey"])


@query("k06_validation_table", f"WITH {EV} SELECT CAST(step AS VARCHAR) AS step, sample_id, pred, score FROM ev")
def k06(spark, d):
    path = Z.state_folder(spark) + "/validation"
    rows = ev(spark, d).select(F.col("step").cast("string").alias("step"), "sample_id", "pred", "score")
    for half in (0, 1):  # two validation runs append to one table
        rows.filter(F.col("sample_id") % 2 == half).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("k08_example_row", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region ORDER BY r_regionkey LIMIT 1")
def k08(spark, d):
    return X.example(table(spark, d, "region").select("r_regionkey", "r_name"), ["r_regionkey"])


@query("k09_traced_samples", f"WITH {EV}, r AS (SELECT step, uid, row_number() OVER (PARTITION BY step ORDER BY md5('0|' || step || '|' || uid), uid) AS k FROM (SELECT DISTINCT step, uid FROM ev)) SELECT ev.step, ev.uid, ev.sample_id FROM ev JOIN r USING (step, uid) WHERE k <= 3")
def k09(spark, d):
    return X.traced(ev(spark, d), "step", "uid", 3).select("step", "uid", "sample_id")


# --- selection, merging, samplers --------------------------------------------------------------------------------------


@query("p02_get_keys", "SELECT event_id, value FROM events")
def p02(spark, d):
    return B.select(events(spark, d), ["event_id", "value"])


@query("p07_get_item", "SELECT 'int' AS how, event_id FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events) WHERE rn = 7 UNION ALL SELECT 'slice', event_id FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events) WHERE rn >= 5 AND (rn - 5) % 3 = 0 UNION ALL SELECT 'list', event_id FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events) WHERE rn IN (2, 4) UNION ALL SELECT 'mask', event_id FROM events WHERE value > 20")
def p07(spark, d):
    e = events(spark, d).select("event_id", "value")
    items = {"int": 7, "slice": slice(5, None, 3), "list": [4, 2], "mask": F.col("value") > 20}
    return B.unite([B.get_item(e, ["event_id"], x).select(F.lit(k).alias("how"), "event_id") for k, x in items.items()])


@query("p10_transpose", f"WITH {EV}, k AS (SELECT sample_id, unnest(['n', 'score']) AS key, unnest([CAST(uid AS DOUBLE), score]) AS v FROM ev WHERE uid < 20) SELECT key, len(list(v)) AS n, round(sum(v), 4) AS total, first(v ORDER BY sample_id) AS head FROM k GROUP BY key")
def p10(spark, d):
    rows = ev(spark, d).filter("uid < 20").select("sample_id", F.create_map(F.lit("n"), F.col("uid").cast("double"), F.lit("score"), F.col("score")).alias("m"))
    out = B.transpose(rows, "sample_id", "m")
    return out.select("key", F.size("values").cast("long").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.element_at("values", 1).alias("head"))


@query("p21_info", "SELECT * FROM (VALUES ('event_id', 'bigint'), ('value', 'double'), ('event_type', 'string')) v(\"column\", type)")
def p21(spark, d):
    return B.info(events(spark, d).select("event_id", "value", "event_type")).select("column", "type")


@query("p22_differences", "SELECT event_id, event_type, CASE WHEN event_id % 5 = 0 THEN 'left' ELSE 'right' END AS side FROM events WHERE event_id % 5 IN (0, 1)")
def p22(spark, d):
    e = events(spark, d).select("event_id", "event_type")
    return B.differences(e.filter("event_id % 5 <> 1"), e.filter("event_id % 5 <> 0"))


@query("f07_success", f"WITH {EV} SELECT sample_id FROM ev WHERE score >= 12.5")
def f07(spark, d):
    return B.where(ev(spark, d), F.col("score") >= 12.5).select("sample_id")


@query("f10_row_range", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS rn, count(*) OVER () AS n FROM events) WHERE rn >= 100 AND rn < least(100 + 1000000, n)")
def f10(spark, d):
    return B.row_range(events(spark, d), ["event_id"], 100, 1_000_000).select("event_id")


@query("f11_described", "SELECT doc_id, length(trim(text)) > 0 AS ok FROM documents WHERE text IS NOT NULL AND length(trim(text)) > 0")
def f11(spark, d):
    docs = table(spark, d, "documents").filter(F.length(F.trim("text")) > 0)
    ok = F.when(F.length(F.trim("text")) > 0, True).otherwise(F.raise_error(F.lit("a blank description")).cast("boolean"))
    return docs.select("doc_id", ok.alias("ok"))


@query("f15_rejected_tokens", f"WITH {TOK}, k AS (SELECT *, -greatest(-20, least(20, old_lp - rollout_lp)) AS k FROM tok) SELECT sample_id, pos, CASE WHEN k BETWEEN ln(1 / 1.331) AND ln(1.331) THEN mask ELSE 0 END AS new_mask FROM k")
def f15(spark, d):
    return C.rejection_mask(tok(spark, d), "token_k1", "1.331").select("sample_id", "pos", "new_mask")


@query("j01_positional_join", "WITH a AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k FROM events), b AS (SELECT value, event_id, row_number() OVER (ORDER BY event_id DESC) AS k FROM events) SELECT a.event_id, b.event_id AS other FROM a JOIN b USING (k)")
def j01(spark, d):
    e = events(spark, d).select("event_id")
    other = B.with_ordinal(e.withColumnRenamed("event_id", "other"), [F.desc("other")], "k")
    return B.union_columns(B.with_ordinal(e, ["event_id"], "k"), other, ["k"]).select("event_id", "other")


@query("j02_gather", "SELECT i.event_id % 50 AS place, e.event_type FROM events i JOIN (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events) e ON e.rn = i.event_id % 50")
def j02(spark, d):
    index = events(spark, d).select((F.col("event_id") % 50).alias("place"))
    return index.join(B.with_ordinal(events(spark, d).select("event_id", "event_type"), ["event_id"], "rn"), F.col("place") == F.col("rn")).select("place", "event_type")


@query("j07_outer_merge", f"WITH {EV}, a AS (SELECT uid, list(sample_id ORDER BY sample_id) AS v FROM ev WHERE sample_id % 3 = 0 GROUP BY 1), b AS (SELECT uid, list(sample_id ORDER BY sample_id) AS v FROM ev WHERE sample_id % 3 = 1 AND uid % 4 > 0 GROUP BY 1) SELECT uid, coalesce(a.v, []) || coalesce(b.v, []) AS v FROM a FULL JOIN b USING (uid)")
def j07(spark, d):
    part = lambda cond: ev(spark, d).filter(cond).groupBy("uid").agg(F.array_sort(F.collect_list("sample_id")).alias("v"))
    return B.outer_merge(part("sample_id % 3 = 0"), part("sample_id % 3 = 1 AND uid % 4 > 0"), "uid", "v")


@query("j09_nearest", "WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, c.label, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 25 AND q.vec_id <> c.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s) SELECT query_id, list(vec_id ORDER BY k) AS found, count(DISTINCT label) AS labels FROM r WHERE k <= 4 GROUP BY 1")
def j09(spark, d):
    from tessella.operators.search import top_k

    e = table(spark, d, "embeddings")
    found = top_k(e.filter("vec_id % 50 = 25"), e, 4, digits=None, keep=["label"])
    passages = F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda s: s["vec_id"])
    return found.groupBy("query_id").agg(passages.alias("found"), F.countDistinct("label").alias("labels"))


@query("u02_jagged_concat", "SELECT doc_id, len(string_split(coalesce(text, ''), ' ')) AS n FROM documents")
def u02(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), " ").alias("words"))
    return B.unite([docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")]).select("doc_id", F.size("words").cast("long").alias("n"))


@query("u03_empty_concat", "SELECT event_id, value FROM events")
def u03(spark, d):
    e = events(spark, d).select("event_id", "value")
    return B.unite([e, e.limit(0), e.limit(0)])


@query("u04_shard_concat", "SELECT doc_id, lang FROM documents")
def u04(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return B.unite([docs.filter(F.pmod("doc_id", F.lit(4)) == i) for i in range(4)])


@query("u19_balanced", f"WITH {SEQS}, g AS (SELECT uid, count(*) AS n FROM seqs GROUP BY 1 HAVING count(*) >= 2) SELECT uid, n, CAST(2 AS BIGINT) AS parts, true AS whole FROM g")
def u19(spark, d):
    s = seqs(spark, d).select("uid", "sample_id", P.workload(F.col("length")).cast("long").alias("load"))
    enough = s.groupBy("uid").agg(F.count("*").alias("n")).filter("n >= 2")
    parts = P.balanced(s.join(enough.select("uid"), "uid", "left_semi"), "uid", "sample_id", "load", 2)
    per = parts.groupBy("uid").agg(F.count("*").alias("m"), F.countDistinct("part").alias("parts"), F.countDistinct("sample_id").alias("k"))
    return enough.join(per, "uid").select("uid", "n", "parts", ((F.col("m") == F.col("n")) & (F.col("k") == F.col("n"))).alias("whole"))


@query("u23_undo_permutation", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS ord, event_id FROM events")
def u23(spark, d):
    e = events(spark, d).select("event_id")
    digest = F.md5(F.col("event_id").cast("string").cast("binary"))
    to = B.with_ordinal(B.with_ordinal(e, ["event_id"], "rn"), [digest, F.col("event_id")], "ord").select("rn", "ord")
    moved = B.reorder(e, ["event_id"], to).withColumnRenamed("ord", "now")
    return B.reorder(moved, ["now"], B.inverse(to)).select("ord", "event_id")


@query("u26_ceil_div", "SELECT o_orderkey, CAST(ceil(o_orderkey / 7.0) AS BIGINT) AS parts, CAST(ceil(o_orderkey / 7.0) * 7 AS BIGINT) AS padded FROM orders")
def u26(spark, d):
    up = F.ceil(F.col("o_orderkey") / 7).cast("long")
    if P.ceil_div(15, 7) != 3 or P.round_up(15, 7) != 21:
        raise AssertionError("ceil_div")
    return table(spark, d, "orders").select("o_orderkey", up.alias("parts"), (up * 7).alias("padded"))


_DRAW = "md5('7|' || event_id)"


@query("t05_samplers", f"SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS plain, row_number() OVER (ORDER BY {_DRAW}, event_id) - 1 AS drawn, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS hard FROM events")
def t05(spark, d):
    e = events(spark, d).select("event_id", "value")
    out = B.sampled_order(e, "event_id", name="plain")
    for kind, name in (("random", "drawn"), ("curriculum", "hard")):
        out = out.join(B.sampled_order(e, "event_id", kind, 7, "value", name).select("event_id", name), "event_id")
    return out.drop("value")


@query("z09_curriculum_feedback", "SELECT user_id, round(CASE WHEN s IS NULL THEN 1.0 ELSE 1.0 + 0.5 * (1.0 - s - 1.0) END, 6) AS weight FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END) AS s FROM events WHERE event_type = 'click' GROUP BY 1) USING (user_id)")
def z09(spark, d):
    e = events(spark, d)
    weights = e.select("user_id").distinct().withColumn("weight", F.lit(1.0))
    where, done = Z.state_folder(spark), []

    def learn(batch, _):
        B.feedback(weights, batch.filter("event_type = 'click'").withColumn("s", (F.col("value") > 10).cast("double")), "user_id", "s").write.mode("overwrite").parquet(f"{where}/weights")
        done.append(1)

    Z.for_each_batch(Z.read_stream(spark, f"{d}/events.parquet", 1000), learn, where)
    return rounded(spark.read.parquet(f"{where}/weights"), "weight")


# --- metrics, corrections ------------------------------------------------------------------------------------------------


@query("a02_masked_mean", f"WITH {TOK} SELECT sample_id, round(sum(CASE WHEN mask = 1 THEN value ELSE 0 END) / (sum(mask) + 1e-8), 6) + 0.0 AS mean FROM tok GROUP BY 1")
def a02(spark, d):
    from tessella.operators.masked import masked_mean

    per = tok(spark, d).groupBy("sample_id").agg(masked_mean("value", "mask").alias("mean"))
    return rounded(per, "mean").withColumn("mean", F.col("mean") + 0.0)


@query("a08_accumulate", f"WITH {EV} SELECT pred || '/' || k AS name, k AS kind, round(CASE k WHEN 'mean' THEN avg(score) WHEN 'sum' THEN sum(score) WHEN 'min' THEN min(score) ELSE max(score) END, 4) AS value FROM ev, (SELECT unnest(['mean', 'sum', 'min', 'max']) AS k) GROUP BY pred, k")
def a08(spark, d):
    rows = ev(spark, d).select("pred", "score", F.explode(F.array(*[F.lit(k) for k in ("mean", "sum", "min", "max")])).alias("kind"))
    out = M.accumulate(rows.select(F.concat_ws("/", "pred", "kind").alias("name"), "kind", F.col("score").alias("value")), "name", "kind", "value")
    return out.withColumn("value", F.round("value", 4))


@query("a14_throughput", f"WITH {SEQS} SELECT uid, round(sum(length) / (count(*) * 8.0), 6) AS per_gpu FROM seqs GROUP BY 1")
def a14(spark, d):
    return rounded(seqs(spark, d).groupBy("uid").agg((F.sum("length") / (F.count("*") * 8.0)).alias("per_gpu")), "per_gpu")


@query("a27_coverage", f"WITH {EV}, g AS (SELECT uid, bool_or(score > 30) AS solved FROM ev GROUP BY 1) SELECT round(avg(CASE WHEN g.solved THEN 1.0 ELSE 0.0 END), 6) AS of_samples, round((SELECT avg(CASE WHEN solved THEN 1.0 ELSE 0.0 END) FROM g), 6) AS of_groups, count(DISTINCT uid) AS groups FROM ev JOIN g USING (uid)")
def a27(spark, d):
    rows = ev(spark, d)
    per = rows.groupBy("uid").agg(F.max((F.col("score") > 30).cast("double")).alias("solved"), F.count("*").alias("n"))
    return rounded(per.agg((F.sum(F.col("solved") * F.col("n")) / F.sum("n")).alias("of_samples"), F.avg("solved").alias("of_groups"), F.count("*").alias("groups")), "of_samples", "of_groups")


@query("a30_all_ranks", f"WITH {EV} SELECT round(avg(score), 6) AS mean, max(score) AS max, min(score) AS min, round(stddev_samp(score), 6) AS std FROM ev")
def a30(spark, d):
    return rounded(ev(spark, d).agg(F.avg("score").alias("mean"), F.max("score").alias("max"), F.min("score").alias("min"), F.stddev_samp("score").alias("std")), "mean", "std")


@query("r06_thresholds", "SELECT * FROM (VALUES ('token_k1', 0.5, 2.0), ('seq_mean_k3', NULL, 0.01), ('seq_sum_k1', 0.25, 4.0)) v(rule, low, high)")
def r06(spark, d):
    found = C.parse_thresholds(["token_k1", "seq_mean_k3", "seq_sum_k1"], "2.0, 0.01, 0.25_4.0")
    return spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in found.items()], "rule string, low double, high double")


_GEO = "CASE WHEN sum(-greatest(-20, least(20, old_lp - rollout_lp)) * mask) OVER s / (sum(mask) OVER s + 1e-8) BETWEEN ln(0.999) AND ln(1.001) THEN mask ELSE 0 END"
_SEQ = "round(least(exp(greatest(-20, least(20, sum((old_lp - rollout_lp) * mask) OVER s))) * mask, 2.0), 6)"


@query("r09_presets", f"WITH {TOK} SELECT sample_id, pos, 'decoupled_geo_rs_seq_tis' AS name, {_SEQ} AS is_weight, {_GEO} AS new_mask, old_lp FROM tok WINDOW s AS (PARTITION BY sample_id) UNION ALL SELECT sample_id, pos, 'bypass_pg_geo_rs', 1.0, {_GEO}, rollout_lp FROM tok WINDOW s AS (PARTITION BY sample_id) UNION ALL SELECT sample_id, pos, 'disabled', 1.0, mask, old_lp FROM tok")
def r09(spark, d):
    rows = tok(spark, d)
    names = ("decoupled_geo_rs_seq_tis", "bypass_pg_geo_rs", "disabled")
    return rounded(B.unite([C.preset(rows, n).select("sample_id", "pos", F.lit(n).alias("name"), "is_weight", "new_mask", "old_lp") for n in names]), "is_weight")


# --- dispatch ------------------------------------------------------------------------------------------------------------


@query("d02_all_to_all", f"WITH {EV} SELECT sample_id, score FROM ev")
def d02(spark, d):
    return D.data_parallel(ev(spark, d).select("sample_id", "score"), lambda p: p, "sample_id long, score double")


@query("d04_given_parts", f"WITH {EV} SELECT uid, count(*) AS n, round(sum(score), 4) AS total FROM ev GROUP BY 1")
def d04(spark, d):
    part = lambda p: p.groupby("uid", as_index=False).agg(n=("score", "size"), total=("score", "sum"))
    rows = ev(spark, d).select("uid", "score").repartition("uid")
    some = D.data_parallel(rows, part, "uid long, n long, total double")
    return some.groupBy("uid").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@query("d05_mesh", "WITH e AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // CAST(ceil(count(*) OVER () / 4.0) AS BIGINT) AS shard FROM events) SELECT event_id, CAST(shard * 2 + r AS INTEGER) AS rank, r = 0 AS collects FROM e, (SELECT unnest([0, 1]) AS r)")
def d05(spark, d):
    return B.mesh(events(spark, d).select("event_id"), ["event_id"], 4, 2).select("event_id", "rank", "collects")


@query("d06_rank_zero", "SELECT count(*) AS n FROM events")
def d06(spark, d):
    rows = B.mesh(events(spark, d).select("event_id"), ["event_id"], 4, 2)
    return rows.filter("collects").agg(F.count("*").alias("n"))


@query("d07_all_gather", "SELECT r_regionkey, CAST(k AS INTEGER) AS rank FROM region, (SELECT unnest(range(3)) AS k)")
def d07(spark, d):
    return B.all_gather(table(spark, d, "region").select("r_regionkey"), 3)


# --- texts, choices, tests -----------------------------------------------------------------------------------------------


@query("x27_templates", "SELECT doc_id, 'Which one? ' || lang || chr(10) || 'A. ' || lang || chr(10) || 'B. ' || source || chr(10) || 'C. none' || chr(10) || 'Give the letter only.' AS prompt FROM documents")
def x27(spark, d):
    from tessella.sources.loaders import choices

    options = F.array("lang", "source", F.lit("none"))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("Which one? "), "lang", F.lit("\n"), choices(options), F.lit("\nGive the letter only.")).alias("prompt"))


@query("x28_shuffled_choices", "WITH o AS (SELECT doc_id, i, CASE i WHEN 0 THEN lang WHEN 1 THEN source ELSE 'x' || i END AS x, row_number() OVER (PARTITION BY doc_id ORDER BY md5('0|' || doc_id || '|' || i), i) AS k FROM documents, (SELECT unnest(range(4)) AS i)) SELECT doc_id, list(x ORDER BY k) AS options, chr(CAST(64 + max(k) FILTER (i = 1) AS INTEGER)) AS \"right\" FROM o GROUP BY doc_id")
def x28(spark, d):
    options = F.array("lang", "source", F.lit("x2"), F.lit("x3"))
    return table(spark, d, "documents").withColumn("s", T.shuffled_choices(options, F.lit(1), F.col("doc_id"))).select("doc_id", "s.options", "s.right")


@query("x30_test_cases", """SELECT item_id, CASE item_id % 3 WHEN 0 THEN '{"inputs":["' || item_id || '"],"outputs":["1"],"testtype":"stdin","fn_name":""}'
 WHEN 1 THEN '{"inputs":["1","' || item_id || '"],"outputs":["2","3"],"testtype":"functional","fn_name":"f","time_limit":2.5}' ELSE '{"inputs":["' || item_id || '","4"],"outputs":["5","6"],"testtype":"stdin","fn_name":""}' END AS tests FROM benchmark""")
def x30(spark, d):
    n, k = F.col("item_id").cast("string"), F.col("item_id") % 3
    one = F.concat(F.lit('{"outputs": ["1"], "inputs": ["'), n, F.lit('"]}'))
    two = F.concat(F.lit('{"inputs": ["1", "'), n, F.lit('"], "outputs": ["2", "3"], "fn_name": "f", "time_limit": 2.5}'))
    three = F.concat(F.lit('[{"input": "'), n, F.lit('", "output": "5"}, {"input": "4", "output": "6"}]'))
    return table(spark, d, "benchmark").select("item_id", T.test_cases(F.when(k == 0, one).when(k == 1, two).otherwise(three)).alias("tests"))


@query("t08_shortest_first", "SELECT item_id, 'input b: want x, got ' || item_id || chr(10) || 'input ccc: want y, got ' || item_id AS feedback FROM benchmark")
def t08(spark, d):
    n = F.col("item_id").cast("string")
    r = F.array(*[F.struct(F.lit(i).alias("input"), F.lit(w).alias("want"), n.alias("got")) for i, w in (("ddddd", "z"), ("ccc", "y"), ("b", "x"))])
    return table(spark, d, "benchmark").select("item_id", T.test_feedback(r).alias("feedback"))


@query("m01_scored_or_given", f"WITH {EV} SELECT sample_id, CASE WHEN uid % 3 = 0 THEN round(score, 6) WHEN pred = 'click' THEN 1.0 ELSE 0.0 END AS score FROM ev")
def m01(spark, d):
    given = F.when(F.col("uid") % 3 == 0, F.col("score"))
    said = F.concat(F.lit("<answer> "), "pred", F.lit(" </answer>"))
    own = S.SCORERS["sciknoweval"](said, F.lit("click"))
    return rounded(ev(spark, d).select("sample_id", F.coalesce(given, own).alias("score")), "score")


@query("m04_batch_scores", f"WITH {EV} SELECT sample_id, round(score / 100, 6) AS score FROM ev")
def m04(spark, d):
    out = D.data_parallel(ev(spark, d).select("sample_id", "score"), lambda p: p.assign(score=p["score"] / 100), "sample_id long, score double")
    return rounded(out, "score")


@query("m07_custom_scorer", f"WITH {EV} SELECT sample_id, CASE WHEN pred = 'view' THEN 0.25 ELSE 0.0 END AS score FROM ev")
def m07(spark, d):
    S.SCORERS["own/views"] = lambda text, truth, credit=0.25: F.when(text == truth, credit).otherwise(0.0)
    try:
        return ev(spark, d).select("sample_id", S.score_by_source(F.lit("own/views"), F.col("pred"), F.lit("view")).alias("score"))
    finally:
        del S.SCORERS["own/views"]


# --- streaming -------------------------------------------------------------------------------------------------------------


@query("z02_single_gets", "WITH i AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), c AS (SELECT user_id, event_id AS call, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT c.user_id, call, CASE WHEN k2.event_id IS NULL THEN NULL ELSE k2.event_id END AS item FROM c LEFT JOIN (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM i WHERE event_id % 2 = 0) k2 ON c.user_id = k2.user_id AND c.k = k2.k")
def z02(spark, d):
    e = events(spark, d)
    return Z.gets(e.filter("event_id % 2 = 0"), e.select("user_id", F.col("event_id").alias("call")), "user_id", "event_id", "call")


@query("z04_version_advance", "WITH v AS (SELECT user_id, date_trunc('day', ts) AS version, count(*) AS produced, count(*) FILTER (value > 5) AS consumed, sum(value) AS active, sum(value) + 10 AS elapsed FROM events GROUP BY 1, 2) SELECT user_id, CAST(version AS DATE) AS version, CAST(sum(produced - consumed) OVER (PARTITION BY user_id ORDER BY version) AS BIGINT) AS staleness, round(1.0 - active / elapsed, 6) AS idle_ratio FROM v")
def z04(spark, d):
    v = events(spark, d).groupBy("user_id", F.to_date("ts").alias("version")).agg(F.count("*").alias("produced"), F.count_if(F.col("value") > 5).alias("consumed"), F.sum("value").alias("active"), (F.sum("value") + 10).alias("elapsed"))
    return rounded(Z.version_advances(v, "user_id", "version", "produced", "consumed", "active", "elapsed"), "idle_ratio")


# --- annex -----------------------------------------------------------------------------------------------------------------


def _log_sum_exp(logits):
    """By the C library, as in SQL: the JVM's exp and log may differ from it in the last place, and so in the sign of a
    difference that is next to zero. Nulls are skipped; what is too large for exp is infinite."""
    total, some = 0.0, False
    for v in logits if logits is not None else ():
        if v is not None:
            try:
                total, some = total + math.exp(v), True
            except OverflowError:
                total, some = total + math.inf, True
    return (math.log(total) if total else -math.inf) if some else None


@query("n01_label_log_probs", f"WITH {EV}, x AS (SELECT sample_id, [score / 10, uid / 50.0, 0.5] AS l, sample_id % 3 AS k FROM ev) SELECT sample_id, round(l[CAST(k + 1 AS INTEGER)] - ln(list_sum(list_transform(l, lambda v: exp(v)))), 6) AS log_prob FROM x")
def n01(spark, d):
    logits = F.array(F.col("score") / 10, F.col("uid") / 50.0, F.lit(0.5))
    label = F.nullif((F.col("sample_id") % 3 + 1).cast("int"), F.lit(0))  # a list has no element 0
    x = ev(spark, d).select("sample_id", (F.element_at(logits, label) - F.udf(_log_sum_exp, "double", useArrow=True)(logits)).alias("x"))
    return x.select("sample_id", (F.round(F.abs("x"), 6) * F.signum("x")).alias("log_prob"))  # round() loses the sign of a zero, which SQL keeps


@query("n02_temperature", f"WITH {EV} SELECT sample_id, round(score / 0.7, 6) AS a, round(uid / 0.7, 6) AS b FROM ev")
def n02(spark, d):
    x = T.with_temperature(F.array("score", F.col("uid").cast("double")), 0.7)
    return rounded(ev(spark, d).select("sample_id", x.alias("x")).select("sample_id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b")), "a", "b")


@query("n03_clip_by_bounds", f"WITH {EV} SELECT sample_id, [least(greatest(score, 1.0), 9.0), least(greatest(CAST(uid AS DOUBLE), 20.0), 10.0)] AS x FROM ev")
def n03(spark, d):
    low, high = F.array(F.lit(1.0), F.lit(20.0)), F.array(F.lit(9.0), F.lit(10.0))
    return ev(spark, d).select("sample_id", T.clip_by(F.array("score", F.col("uid").cast("double")), low, high).alias("x"))


@query("n04_unpad_offsets", f"WITH {SEQS} SELECT uid, sample_id, CAST(coalesce(sum(length) OVER (PARTITION BY uid ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS starts, CAST(length AS BIGINT) AS expanded FROM seqs")
def n04(spark, d):
    w = W.partitionBy("uid").orderBy("sample_id").rowsBetween(W.unboundedPreceding, -1)
    rows = seqs(spark, d).withColumn("starts", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long"))
    return rows.select("uid", "sample_id", "starts", F.size(F.array_repeat("score", F.col("length").cast("int"))).cast("long").alias("expanded"))


@query("n05_gather_to_lists", f"WITH {EV} SELECT pred, list(sample_id ORDER BY sample_id) AS ids, count(*) AS n FROM ev GROUP BY 1")
def n05(spark, d):
    return ev(spark, d).groupBy("pred").agg(F.array_sort(F.collect_list("sample_id")).alias("ids"), F.count("*").alias("n"))


@query("n07_assigned_value", f"WITH {EV} SELECT sample_id, 'run-1' AS run, CAST(2 AS INTEGER) AS epoch FROM ev")
def n07(spark, d):
    return ev(spark, d).select("sample_id").withColumns({"run": F.lit("run-1"), "epoch": F.lit(2)})


@query("n08_dict_union", f"WITH {EV} SELECT sample_id, uid, score FROM ev")
def n08(spark, d):
    rows = ev(spark, d)
    return B.union_columns(rows.select("sample_id", "uid"), rows.select("sample_id", "uid", "score"), ["sample_id"])


@query("n09_timings", f"WITH {EV} SELECT pred AS name, round(avg(score), 6) AS mean, max(score) AS max, min(score) AS min, list(DISTINCT uid ORDER BY uid) AS ranks FROM ev GROUP BY 1")
def n09(spark, d):
    per = ev(spark, d).groupBy(F.col("pred").alias("name")).agg(F.avg("score").alias("mean"), F.max("score").alias("max"), F.min("score").alias("min"), F.array_sort(F.collect_set("uid")).alias("ranks"))
    return rounded(per, "mean")


@query("n22_call_arguments", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 4 <> 0 AS valid FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{}' ELSE props END AS props FROM events)")
def n22(spark, d):
    text = F.when(F.col("event_id") % 4 == 0, "not json").otherwise(F.col("props"))
    found = F.from_json(text, "k long")
    return events(spark, d).select("event_id", found["k"].alias("k"), found["k"].isNotNull().alias("valid"))
