"""Projection, selection, repetition, chunks, filters, joins, sorts and sampling over events, orders and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators import batch as B
from tessella.plans.views import EV, ev
from tessella.session import table

RN = f"{EV}, o AS (SELECT *, row_number() OVER (ORDER BY sample_id) - 1 AS rn FROM ev)"
KEY = ["sample_id"]

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("p01_select", f"WITH {EV} SELECT uid, score FROM ev")
def p01(spark, d):
    return B.select(ev(spark, d), ["uid", "score"])


@query("p03_pop", f"WITH {EV} SELECT sample_id, pred, step FROM ev")
def p03(spark, d):
    return B.pop(ev(spark, d), ["uid", "score"])[1]


@query("p04_rename", f"WITH {EV} SELECT uid AS group_id, sample_id, pred, score AS reward, step FROM ev")
def p04(spark, d):
    return B.rename(ev(spark, d), ["uid", "score"], ["group_id", "reward"])


@query("p05_pick", f"WITH {RN}, w AS (SELECT unnest([5, 3, 3, 100, 0]) AS i, unnest([0, 1, 2, 3, 4]) AS ord) SELECT CAST(ord AS BIGINT) AS ord, uid, sample_id, pred, score, step FROM o JOIN w ON rn = i")
def p05(spark, d):
    return B.pick(ev(spark, d), KEY, [5, 3, 3, 100, 0])


@query("p05_mask", f"WITH {EV} SELECT * FROM ev WHERE score > 50 AND pred <> 'view'")
def p05_mask(spark, d):
    return B.get_item(ev(spark, d), KEY, (F.col("score") > 50) & (F.col("pred") != "view"))


@query("p06_slice", f"WITH {RN} SELECT * FROM o WHERE rn >= 10 AND rn < 500 AND (rn - 10) % 7 = 0")
def p06(spark, d):
    return B.get_item(ev(spark, d), KEY, slice(10, 500, 7))


@query("p08_reorder", f"WITH {RN} SELECT (SELECT count(*) FROM ev) - 1 - rn AS ord, sample_id, score FROM o")
def p08(spark, d):
    e = B.select(ev(spark, d), ["sample_id", "score"])
    n = e.count()
    return B.reorder(e, KEY, spark.range(n).select(F.col("id").alias("ord"), (n - 1 - F.col("id")).alias("rn")))


@query("p09_union_columns", f"WITH {EV} SELECT uid, sample_id, score, pred FROM ev")
def p09(spark, d):
    e = ev(spark, d)
    return B.union_columns(e.select("uid", "sample_id", "score"), e.select("sample_id", "score", "pred"), KEY)


@query("p11_collate", f"WITH {RN} SELECT CAST(rn // 64 AS INTEGER) AS fold, list(sample_id ORDER BY rn) AS sample_id, list(score ORDER BY rn) AS score FROM o GROUP BY 1")
def p11(spark, d):
    return B.fold(ev(spark, d), KEY, 64, ["sample_id", "score"])


@query("p12_fold_unfold", f"WITH {RN} SELECT CAST(rn // 8 AS INTEGER) AS fold, CAST(rn % 8 AS INTEGER) AS k, sample_id, score FROM o")
def p12(spark, d):
    return B.unfold(B.fold(ev(spark, d), KEY, 8, ["sample_id", "score"]), ["sample_id", "score"])


@query("p13_unfold_chunks", "SELECT vec_id, CAST(p AS INTEGER) AS piece, embedding[p * 16 + 1:p * 16 + 16] AS embedding FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS p)")
def p13(spark, d):
    return B.unfold_chunks(table(spark, d, "embeddings").select("vec_id", "embedding"), ["embedding"], 4)


@query("p14_defaults", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '-') AS o_orderstatus, '-' AS tests FROM orders")
def p14(spark, d):
    status = F.expr("nullif(o_orderstatus, 'P')")
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(status, F.lit("-")).alias("o_orderstatus"), F.lit("-").alias("tests"))


@query("p15_ordinal", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents")
def p15(spark, d):
    return B.with_ordinal(table(spark, d, "documents").select("doc_id"), ["doc_id"], "idx")


@query("p20_prefix", f'WITH {EV} SELECT uid AS "val/uid", score AS "val/score" FROM ev')
def p20(spark, d):
    return B.prefixed(ev(spark, d).select("uid", F.col("score").alias("val/score")), "val")


@query("p23_trajectory", f"WITH {EV}, a AS (SELECT sample_id, pred, sum(CASE WHEN p IS NOT DISTINCT FROM pred THEN 0 ELSE 1 END) OVER (ORDER BY sample_id) AS run FROM (SELECT *, lag(pred) OVER (ORDER BY sample_id) AS p FROM ev)) SELECT sample_id, pred, row_number() OVER (PARTITION BY run ORDER BY sample_id) - 1 AS rollout_n FROM a")
def p23(spark, d):
    return B.trajectory_numbers(ev(spark, d).select("sample_id", "pred"), "pred", KEY)


@query("u01_concat", f"WITH {EV} SELECT uid, sample_id, score, NULL AS pred FROM ev WHERE score < 10 UNION ALL SELECT uid, sample_id, score, pred FROM ev WHERE score > 90")
def u01(spark, d):
    e = ev(spark, d)
    return B.unite([e.filter("score < 10").select("uid", "sample_id", "score"), e.filter("score > 90").select("uid", "sample_id", "score", "pred")])


@query("u05_preference_rows", "SELECT doc_id, k AS chosen, CASE k WHEN 0 THEN source ELSE lang END AS text FROM documents, (SELECT unnest([0, 1]) AS k)")
def u05(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.array("source", "lang")).alias("chosen", "text"))


@query("u06_repeat", "SELECT item_id, CAST(k AS INTEGER) AS rep FROM benchmark, (SELECT unnest(range(4)) AS k)")
def u06(spark, d):
    return B.repeat(table(spark, d, "benchmark").select("item_id"), 4, order=["item_id"])


@query("u07_repeat_each", "SELECT c.doc_id, c.n, CAST(k AS INTEGER) AS rep FROM (SELECT doc_id, doc_id % 4 AS n FROM documents) c, (SELECT unnest(range(3)) AS k) WHERE k < n")
def u07(spark, d):
    return B.repeat_each(table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 4).alias("n")), "n")


@query("u08_chunk", f"WITH {RN}, n AS (SELECT count(*) AS n FROM ev) SELECT sample_id, CAST(rn // CAST(ceil(n / 7) AS BIGINT) AS INTEGER) AS chunk FROM o, n")
def u08(spark, d):
    return B.chunk(ev(spark, d).select("sample_id"), KEY, 7, pad=True)


@query("u09_split", f"WITH {RN} SELECT sample_id, CAST(rn // 300 AS INTEGER) AS part FROM o")
def u09(spark, d):
    return B.split(ev(spark, d).select("sample_id"), KEY, 300)


@query("u11_pad_to_divisor", "WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS rn FROM customer), n AS (SELECT count(*) AS n FROM o) SELECT c_custkey, rn, false AS is_pad FROM o UNION ALL SELECT c_custkey, rn + n, true FROM o, n WHERE rn < (64 - n % 64) % 64")
def u11(spark, d):
    return B.pad_to_divisor(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], 64)


@query("u12_pad_with_edge", "SELECT n_nationkey, false AS is_pad FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation), true FROM range(3)")
def u12(spark, d):
    return B.pad_with_edge(table(spark, d, "nation").select("n_nationkey"), ["n_nationkey"], 3)


@query("u14_head_tail_split", "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN rn < floor(n * 0.75) THEN 'train' ELSE 'test' END AS split FROM o")
def u14(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    head = int(docs.count() * 0.75)
    return B.with_ordinal(docs, ["doc_id"]).select("doc_id", F.when(F.col("rn") < head, "train").otherwise("test").alias("split"))


@query("u13_hash_split", "SELECT doc_id, CASE WHEN CAST('0x' || substr(md5('7|' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 1000 THEN 'test' ELSE 'train' END AS split FROM documents")
def u13(spark, d):
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 10000
    return table(spark, d, "documents").select("doc_id", F.when(draw < 1000, "test").otherwise("train").alias("split"))


@query("u16_set_operations", "SELECT k, what FROM (SELECT o_custkey AS k, 'both' AS what FROM orders INTERSECT SELECT c_custkey, 'both' FROM customer) UNION ALL (SELECT c_custkey, 'none' FROM customer EXCEPT SELECT o_custkey, 'none' FROM orders)")
def u16(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return o.intersect(c).withColumn("what", F.lit("both")).unionByName(c.subtract(o).withColumn("what", F.lit("none")))


@query("f02_category_alias", "SELECT doc_id, CASE source WHEN 'src1' THEN 'src 1' ELSE source END AS source FROM documents WHERE source IN ('src1', 'src2')")
def f02(spark, d):
    name = F.when(F.col("source") == "src1", "src 1").otherwise(F.col("source"))
    return table(spark, d, "documents").filter(F.col("source").isin("src1", "src2")).select("doc_id", name.alias("source"))


@query("f01_overlong_prompts", r"SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words FROM documents WHERE coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 201) <= 200")
def f01(spark, d):
    n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return table(spark, d, "documents").select("doc_id", n.cast("long").alias("n_words")).filter(F.coalesce("n_words", F.lit(201)) <= 200)


@query("f03_multi_in", "SELECT event_id, CAST(props::JSON->>'k' AS INTEGER) AS k FROM events WHERE event_type IN ('click', 'view') AND CAST(props::JSON->>'k' AS INTEGER) IN (1, 2, 3)")
def f03(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").filter(F.col("event_type").isin("click", "view") & k.isin(1, 2, 3)).select("event_id", k.alias("k"))


@query("f04_date_range", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def f04(spark, d):
    return table(spark, d, "events").filter("ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-12'").select("event_id", "user_id")


@query("f06_fenced", "SELECT doc_id, coalesce(starts_with(text, 'T') AND ends_with(text, '.'), false) AS ok FROM documents")
def f06(spark, d):
    ok = F.startswith("text", F.lit("T")) & F.endswith("text", F.lit("."))
    return table(spark, d, "documents").select("doc_id", F.coalesce(ok, F.lit(False)).alias("ok"))


@query("f12_mask_strings", r"SELECT doc_id, regexp_replace(source, '[0-9]+', '*', 'g') AS source, regexp_replace(lang, '[0-9]+', '*', 'g') AS lang FROM documents")
def f12(spark, d):
    masked = {c: F.regexp_replace(c, "[0-9]+", "*") for c in ("source", "lang")}
    return table(spark, d, "documents").select("doc_id", *[v.alias(k) for k, v in masked.items()])


@query("f13_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'stupid') AND replace(CAST(doc_id AS VARCHAR), '-', '') <> ''")
def f13(spark, d):
    return table(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit("stupid")) & (F.replace(F.col("doc_id").cast("string"), F.lit("-"), F.lit("")) != "")).select("doc_id")


@query("f14_group_signal", f"WITH {EV} SELECT uid, sample_id, score FROM ev QUALIFY min(score) OVER (PARTITION BY uid) <> max(score) OVER (PARTITION BY uid)")
def f14(spark, d):
    w = W.partitionBy("uid")
    e = ev(spark, d).select("uid", "sample_id", "score").withColumn("_v", F.min("score").over(w) != F.max("score").over(w))
    return e.filter("_v").drop("_v")


@query("j04_sibling_success", f"""WITH {EV}, s AS (SELECT uid, sample_id FROM ev WHERE score >= 90),
c AS (SELECT e.uid, e.sample_id, min(s.sample_id) AS solution FROM ev e LEFT JOIN s ON s.uid = e.uid AND s.sample_id <> e.sample_id GROUP BY 1, 2) SELECT * FROM c""")
def j04(spark, d):
    from tessella.operators.groups import sibling_success

    return sibling_success(ev(spark, d), "uid", "sample_id", F.col("score") >= 90).select("uid", "sample_id", "solution")


@query("j05_default_lookup", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def j05(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("j06_semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j06(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").filter("toxic = 1"), "doc_id", "left_semi")


@query("j08_epochs", "SELECT item_id, CAST(e AS INTEGER) AS epoch FROM benchmark, (SELECT unnest(range(3)) AS e)")
def j08(spark, d):
    return B.repeat(table(spark, d, "benchmark").select("item_id"), 3, name="epoch")


@query("j10_native_joins", "SELECT c.c_custkey, n.n_name, r.r_name, count(o.o_orderkey) AS n_orders FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1, 2, 3")
def j10(spark, d):
    c, n, r, o = (table(spark, d, t) for t in ("customer", "nation", "region", "orders"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    counts = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return rows.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "n_name", "r_name", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("j11_asof_join", "SELECT e.event_id, e.user_id, p.event_id AS purchase FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def j11(spark, d):
    e = table(spark, d, "events")
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True)
    w = W.partitionBy("user_id").orderBy("ts").rangeBetween(W.unboundedPreceding, W.currentRow)
    return e.select("event_id", "user_id", last.over(w).alias("purchase"))


@query("t01_head_limit", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def t01(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").orderBy("doc_id").limit(50)


@query("t01_seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('11|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def t01_sample(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("11|"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").limit(100)


@query("t02_sort_scores", f"WITH {EV}, f AS (SELECT sample_id, coalesce(CASE WHEN score > 50 THEN score END, CASE WHEN score > 25 THEN score END, 0.0) AS s FROM ev) SELECT sample_id, s, row_number() OVER (ORDER BY s DESC NULLS LAST, sample_id) - 1 AS rn FROM f")
def t02(spark, d):
    above = lambda t: F.when(F.col("score") > t, F.col("score"))
    return B.with_ordinal(ev(spark, d).select("sample_id", F.coalesce(above(50), above(25), F.lit(0.0)).alias("s")), [F.desc("s"), "sample_id"])


@query("t03_top2_per_group", f"WITH {EV} SELECT uid, sample_id, score, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, sample_id) AS k FROM ev) WHERE k <= 2")
def t03(spark, d):
    k = F.row_number().over(W.partitionBy("uid").orderBy(F.desc("score"), "sample_id"))
    return ev(spark, d).select("uid", "sample_id", "score", k.alias("k")).filter("k <= 2")


@query("t06_vector_topk", "WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(e[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE))), 6) AS score FROM embeddings, q WHERE vec_id <> query_id) SELECT query_id, vec_id, score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s) WHERE k <= 5")
def t06(spark, d):
    from tessella.operators.search import top_k

    e = table(spark, d, "embeddings")
    return top_k(e.filter("vec_id % 50 = 0"), e, 5)


@query("t07_batches", "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents) SELECT doc_id, CAST(rn // 96 AS INTEGER) AS batch FROM o WHERE rn // 96 < n // 96")
def t07(spark, d):
    return B.batches(table(spark, d, "documents").select("doc_id"), ["doc_id"], 96)


@query("a33_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def a33(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
