"""Every registered query against its DuckDB counterpart, and operators on small fixtures."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import answers, scoring
from tessella.operators import advantage as A
from tessella.operators import batch as B
from tessella.operators import correction as C
from tessella.operators import groups, losses, masked, metrics, partition, search
from tessella.plans import registry
from tessella.sources import datasets
from tessella.streaming import rollouts as Z
from tools_oracle import compare, connect

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_duckdb(spark, duck, name):
    ok, what = compare(spark, duck, name, registry.queries()[name], SQL.get(name), SF)
    assert ok, what


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "strict", "flexible"),
    [("so #### 1,234", "1234", "1,234"), ("no number", None, None), ("#### -5. and 7", "-5.", "7"), ("a . b", None, "."), ("#### 3 #### $4", "3", "4")],
)
def test_answers(spark, text, strict, flexible):
    assert one(spark, answers.hash_answer(F.col("t")), t=text) == strict
    assert one(spark, answers.last_number(F.col("t")), t=text) == flexible


@pytest.mark.parametrize(("text", "boxed"), [(r"\boxed{1} \boxed{\frac{a}{b}} x", r"\frac{a}{b}"), (r"\boxed{open {1}", None), ("none", None), (r"\fbox{2}", "2"), (r"\boxed{}", "")])
def test_boxed(spark, text, boxed):
    assert one(spark, scoring.last_boxed(F.col("t")), t=text) == boxed


@pytest.mark.parametrize(("a", "b", "same"), [("1,000", "1000", True), ("50", "0.5", True), ("1.00001", "1", True), ("2", "3", False), ("x", "1", False)])
def test_numeric_equal(spark, a, b, same):
    assert one(spark, scoring.numeric_equal(F.col("a"), F.col("b")), a=a, b=b) is same


def test_masked_mean_and_nan(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 0), (4.0, 1)], "v double, m int")
    assert df.agg(masked.masked_mean("v", "m").alias("x")).first().x == pytest.approx(2.5)
    assert math.isnan(df.withColumn("m", F.lit(1)).agg(masked.masked_mean("v", "m").alias("x")).first().x)
    with pytest.raises(Exception, match="too small"):
        masked.masked_var(df.filter("m = 1").limit(1), "v", "m").collect()


def test_group_statistics(spark):
    df = spark.createDataFrame([("0", 1.0), ("1", 2.0), ("0", 3.0)], "uid string, score double")
    mean, std, n = groups.mean_std_count("score", "uid")
    got = {(r.uid, r.m, round(r.s, 6), r.n) for r in df.select("uid", mean.alias("m"), std.alias("s"), n.alias("n")).collect()}
    assert got == {("0", 2.0, round(2**0.5, 6), 2), ("1", 0.0, 1.0, 1)}


def rollouts(spark):
    rows = [(u, 10 * u + s, p, (7 * u + 3 * s + p) % 5 / 4, (u + p) % 3 / 2, int((s + p) % 4 > 0)) for u in range(4) for s in range(u + 1) for p in range(3 + s)]
    return spark.createDataFrame(rows, "uid long, sample_id long, pos int, reward double, value double, mask int")


def test_gae_ignores_observation_tokens(spark):
    t = rollouts(spark)
    changed = t.withColumn("value", F.when(F.col("mask") == 0, F.col("value") + 9).otherwise(F.col("value")))
    key = lambda df: {(r.sample_id, r.pos): round(r.adv, 6) for r in df.collect() if r.mask}
    assert key(A.estimate("gae", t, gamma=0.9, lam=0.8)) == key(A.estimate("gae", changed, gamma=0.9, lam=0.8))


def test_rloo_forms_agree_on_groups_of_two_or_more(spark):
    s = spark.createDataFrame([(i % 7, i, (i * 37 % 11) / 3) for i in range(60)], "uid long, sample_id long, score double")
    a, b = ({r.sample_id: round(r.adv, 6) for r in A.estimate(n, s).collect()} for n in ("rloo", "rloo_vectorized"))
    assert a == b
    with pytest.raises(ValueError, match="no such"):
        A.estimate("nothing", s)
    single = spark.createDataFrame([(1, 1, 5.0)], "uid long, sample_id long, score double")
    assert A.estimate("rloo", single).first().adv == 5.0 and A.estimate("rloo_vectorized", single).first().adv == 0.0
    with pytest.raises(Exception, match="two responses"):
        A.estimate("grpo_passk", single).collect()


def test_thresholds():
    assert C.parse_thresholds(["token_k1", "seq_sum_k2"], "0.5_2.0,0.3") == {"token_k1": (0.5, 2.0), "seq_sum_k2": (None, 0.3)}
    assert C.parse_thresholds(["token_k1"], 4)["token_k1"] == (0.25, 4.0)
    for bad in ("-1", "1,2,3"):
        with pytest.raises(ValueError):
            C.parse_thresholds(["token_k1", "token_k2"], bad)


@pytest.mark.parametrize("rule", C.RULES)
def test_rejection_only_removes(spark, rule):
    t = rollouts(spark).withColumn("old_lp", -F.col("value")).withColumn("rollout_lp", -F.col("reward"))
    out = C.rejection_mask(t, rule, "1.1")
    assert out.filter("new_mask > mask OR new_mask < 0").count() == 0


def test_weights_are_bounded(spark):
    t = rollouts(spark).withColumn("old_lp", F.col("value")).withColumn("rollout_lp", -F.col("reward"))
    for level in ("token", "sequence"):
        r = C.importance_weights(t, level, 2.0).agg(F.min("is_weight"), F.max("is_weight")).first()
        assert 0 <= r[0] and r[1] <= 2.0


def test_ppo_on_policy_is_minus_the_advantage(spark):
    t = rollouts(spark).withColumn("old_lp", -F.col("value")).withColumn("lp", -F.col("value")).withColumn("adv", F.col("reward") - 0.4)
    want = t.agg((-F.sum(F.col("adv") * F.col("mask")) / F.sum("mask")).alias("x")).first().x
    assert losses.policy_loss("vanilla", t).first().loss == pytest.approx(want)


def test_batch_round_trips(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(23)], "k int, v double")
    assert B.unpad(B.pad_to_divisor(df, ["k"], 8)).count() == 23 and B.pad_to_divisor(df, ["k"], 8).count() == 24
    back = B.unfold(B.fold(df, ["k"], 5, ["k", "v"]), ["k", "v"], name="place").select("k", "v")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        B.chunk(df, ["k"], 4)
    with pytest.raises(KeyError):
        B.select(df, ["nope"])
    with pytest.raises(Exception, match="differ"):
        B.union_columns(df, df.withColumn("v", F.col("v") + 1), ["k"]).collect()
    assert [r.k for r in B.pick(df, ["k"], [3, 3, 1]).orderBy("ord").collect()] == [3, 3, 1]


def test_reorder_keeps_every_row(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(0, 1000, 2)], "k long, t string")
    places = spark.range(500).select(F.col("id").alias("ord"), (F.col("id") * 7 % 500).alias("rn"))
    got = B.reorder(df, ["k"], places).orderBy("ord").collect()
    assert [(r.ord, r.k, r.t) for r in got] == [(i, 2 * (i * 7 % 500), f"t{2 * (i * 7 % 500)}") for i in range(500)]
    assert registry.queries()["p08_reorder"](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()
    for bad in (places.filter("ord < 499"), places.withColumn("rn", F.col("rn") % 499), places.withColumn("rn", F.col("rn") + 1)):
        with pytest.raises(ValueError, match="permutation"):
            B.reorder(df, ["k"], bad)


def test_sort_of_scores_reaches_the_fallbacks(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = [(r.rn, r.s) for r in registry.queries()["t02_sort_scores"](spark, SF).orderBy("rn").collect()]
    assert [rn for rn, _ in got] == list(range(events.count()))
    s = [s for _, s in got]
    assert s == sorted((v if v > 25 else 0.0 for v in (r.value for r in events.select("value").collect())), reverse=True)
    assert s[-1] == 0.0 and any(25 < v <= 50 for v in s)


def test_vector_search_of_many_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "CANDIDATES", 500, raising=False)
    x = [(i, [float(i * 37 % 101), float(-(i * 53 % 89)), float(i % 7)]) for i in range(1200)]
    x += [(None, [1.0, 1.0, 1.0]), (2000, None), (2001, [None, 1.0, 1.0]), (2002, [9.0])]
    df = spark.createDataFrame(x, "vec_id long, embedding array<float>")
    got = {}
    for r in search.top_k(df, df, 3).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert got.keys() == set(range(1200))
    for q in (0, 1, 599, 1199):
        score = {i: sum(a * b for a, b in zip(x[q][1], v, strict=True)) for i, v in x[:1200] if i != q}
        assert [got[q][k] for k in (1, 2, 3)] == sorted(score.items(), key=lambda s: (-s[1], s[0]))[:3]


def test_nearest_follows_its_sql_below_the_sixth_place(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = [(i, [0.5 + (i * 7 % 80) * 2.0**-24, 0.25, float(i % 3)], i % 4) for i in range(80)]
    x += [(100 + i, v, i % 5) for i, v in enumerate(np.repeat(rng.normal(size=(60, 3)), 4, axis=0).tolist())]
    x += [(75, [9.0, 0.0, 0.0], 7), (75, [0.0, 9.0, 0.0], 8), (7, [8.0, 1.0, 1.0], 9), (7, [-8.0, 1.0, 1.0], 10)]
    spark.createDataFrame(x, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    duckdb.execute(f"CREATE OR REPLACE TEMP VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = duckdb.execute(registry.oracle_sql()["j09_nearest"]).fetchall()
    got = registry.queries()["j09_nearest"](spark, str(tmp_path)).collect()
    assert len(want) == 7 and sorted((r.query_id, r.found, r.labels) for r in got) == sorted(want)


def test_label_log_probs_keep_the_sign_of_zero_and_skip_nulls(spark, tmp_path):
    x = [(i, i % 40 * 50, float(i % 13) * 31) for i in range(-60, 400)] + [(1000, None, 1.0), (1001, 5, None), (1002, None, None), (1003, 50000, 2.0), (1004, 35489, 2.0), (1005, 1, math.nan), (1006, 1, -0.0), (None, 1, 1.0)]
    events = spark.createDataFrame(x, "event_id long, user_id long, value double").selectExpr("*", "'a' AS event_type", "timestamp_ntz'2024-01-01' AS ts")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    duckdb.execute(f"CREATE OR REPLACE TEMP VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = duckdb.execute(registry.oracle_sql()["n01_label_log_probs"]).fetchall()
    got = registry.queries()["n01_label_log_probs"](spark, str(tmp_path)).collect()
    as_text = lambda rows: sorted(map(str, map(tuple, rows)))
    assert any(str(v) == "-0.0" for _, v in want) and any(str(v) == "0.0" for _, v in want)
    assert as_text(got) == as_text(want)


def test_trajectory_numbers_over_blocks(spark):
    values = [None, None, 1, 1, 1, 1, 2, 2, 1, None, 3, 3, 3, 3, 3, 3, 3]
    df = spark.createDataFrame(list(enumerate(values)), "k int, g int")
    want, n = [], 0
    for i, v in enumerate(values):
        n = n + 1 if i and v == values[i - 1] else 0
        want.append(n)
    for block in (2, 3, 100):
        assert [r.rollout_n for r in B.trajectory_numbers(df, "g", ["k"], block=block).orderBy("k").collect()] == want


def test_majority_takes_the_first_seen(spark):
    df = spark.createDataFrame([(1, "B", 0.1, 0), (1, "A", 0.9, 1), (1, "A", 0.5, 2), (1, "B", 0.2, 3)], "uid int, pred string, val double, ord int")
    assert tuple(groups.majority(df, ["uid"], "pred", "val", "ord").first()) == (1, "B", 0.1, 2)


def test_bootstrap_near_the_closed_form(spark):
    df = spark.createDataFrame([("g", float(x)) for x in range(1, 6)], "g string, v double")
    near = metrics.bootstrap(df, "g", "v", 3, n=4000).first().mean
    assert near == pytest.approx(metrics.expected_extremes(df, ["g"], "v", [3]).first().best, abs=0.1)


@pytest.mark.parametrize("method", ["karmarkar_karp", "greedy"])
@pytest.mark.parametrize("equal", [False, True])
def test_parts_are_complete(method, equal):
    loads = [(i * 7919) % 101 + 1 for i in range(64)]
    parts = partition.METHODS[method](loads, 8, equal)
    assert sorted(i for p in parts for i in p) == list(range(64))
    if equal:
        assert {len(p) for p in parts} == {8}
    sums = [sum(loads[i] for i in p) for p in parts]
    if method == "karmarkar_karp" or not equal:
        assert max(sums) - min(sums) <= max(loads)


def test_runs_are_not_split(spark):
    df = spark.createDataFrame([(0, u, u * 10 + i, 5 + (u * i) % 9) for u in range(12) for i in range(4)], "batch int, uid long, k long, n long")
    out = partition.group_balanced(df, "uid", "k", "batch", "n", 3)
    assert out.groupBy("uid").agg(F.countDistinct("part").alias("c")).filter("c > 1").count() == 0 and out.count() == 48


def test_readers_and_dumps(spark, tmp_path):
    d = str(tmp_path)
    df = spark.createDataFrame([(i, i % 2, f"t{i}") for i in range(10)], "i long, step int, t string")
    datasets.write_parquet(df, f"{d}/a.parquet")
    assert datasets.read(spark, f"{d}/a.parquet").count() == 10
    with pytest.raises(ValueError):
        datasets.read(spark, "x.csv")
    (tmp_path / "dumps").mkdir()
    (tmp_path / "dumps/3.jsonl").write_text('{"score": 1.0}\n{"score": 2.0}\n')
    assert {r.step for r in datasets.step_dumps(spark, f"{d}/dumps").collect()} == {3}
    calls = []
    make = lambda: (calls.append(1), df)[1]
    assert [datasets.cached(spark, f"{d}/c", make).count() for _ in range(2)] == [10, 10] and calls == [1]
    datasets.write_steps(df, f"{d}/steps")
    assert spark.read.json(f"{d}/steps").filter("step = 1").count() == 5
    raw = datasets.raw_corpus(df.withColumn("answer", F.lit(None).cast("string")))
    assert raw.first().answer == "-" and raw.columns == [c for c in datasets.RAW if c in raw.columns]


def test_stream_equals_batch(spark, tmp_path):
    d = str(tmp_path / "in")
    df = spark.createDataFrame([(q, q * 1000 + i) for q in range(3) for i in range(50)], "q long, k long")
    df.repartition(5).write.parquet(d)
    got = {r.q: (r.held, r.produced, r.dropped) for r in Z.run_latest(Z.bounded_queues(Z.read_stream(spark, d), "q", "k", 8), "q").collect()}
    assert {q: v[1:] for q, v in got.items()} == {q: (50, 42) for q in range(3)}
    appended = Z.run(Z.read_stream(spark, d).filter("k % 2 = 0"))
    assert appended.count() == 75
    assert Z.staleness_budget(32, 0.5, 4) == 192


def test_long_responses_are_scanned_in_linear_time(spark):
    import time

    from tessella.operators.advantage import gae

    n = 20_000
    tokens = spark.range(n).select(F.lit(1).alias("uid"), F.lit(1).alias("sample_id"), F.col("id").cast("int").alias("pos"), (F.col("id") % 7 / 7).alias("reward"), (F.col("id") % 5 / 5).alias("value"), F.when(F.col("id") % 11 == 0, 0).otherwise(1).alias("mask"))
    t = time.time()
    got = {r.pos: r.ret for r in gae(tokens, 0.99, 0.95).collect()}
    assert len(got) == n and time.time() - t < 60
    after = last = 0.0
    for i in range(n - 1, -1, -1):
        v, m = i % 5 / 5, 0 if i % 11 == 0 else 1
        last = (i % 7 / 7 + 0.99 * after - v + 0.99 * 0.95 * last) * m + (1 - m) * last
        after = v * m + (1 - m) * after
        assert abs(got[i] - last - v) < 1e-9
