"""Resampling draws, sketches and event-time operators on fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import metrics, partition, resample, sketches
from tessella.streaming import eventtime


def weighted(spark, weights):
    return spark.createDataFrame(list(enumerate(weights)), "id long, w double")


def test_draws_follow_weights(spark):
    rng = np.random.default_rng(3)
    w = rng.choice([0.0, 0.5, 1.0, 4.0], 400)
    n = 40_000
    got = {r.id: r.times for r in resample.draws(weighted(spark, w.tolist()), "id", "w", size=n).collect()}
    times = np.array([got.get(i, 0) for i in range(len(w))])
    assert times.sum() == n and times[w == 0].sum() == 0
    want = n * w / w.sum()
    chi = ((times - want)[w > 0] ** 2 / want[w > 0]).sum()
    k = (w > 0).sum() - 1
    assert abs(chi - k) < 4 * np.sqrt(2 * k)


def test_draws_repeat_and_have_the_tables_size(spark):
    df = weighted(spark, [1.0, 1e-8, 3.0, None, -2.0, 0.0] * 20)
    a, b = (sorted(map(tuple, resample.draws(df.repartition(k), "id", "w").collect())) for k in (1, 7))
    assert a == b and sum(t for _, t in a) == 120
    assert all(i % 6 in (0, 1, 2) for i, _ in a)
    assert a != sorted(map(tuple, resample.draws(df, "id", "w", seed="other").collect()))


def test_one_row_with_nearly_all_weight(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") == 1500, 1e6).otherwise(1e-8).alias("w"))
    got = resample.draws(df, "id", "w").collect()
    assert [(r.id, r.times) for r in got] == [(1500, 3000)]


def test_draws_without_weight(spark):
    assert resample.draws(weighted(spark, [0.0, None]), "id", "w").count() == 0
    assert resample.draws(weighted(spark, [1.0]).limit(0), "id", "w").count() == 0


def test_merged_sketches_are_as_good_as_one(spark):
    df = spark.range(200_000).select((F.col("id") % 50_000).alias("k"), F.sqrt("id").alias("v"), (F.col("id") % 16).alias("step"))
    whole = sketches.sketch(df, [], "k", "v")
    merged = sketches.merge(sketches.sketch(df, ["step"], "k", "v"), [])
    for s in (whole, merged):
        r = s.select("n", sketches.distinct(F.col("keys")).alias("d"), sketches.quantile(F.col("values"), 0.25).alias("q"), sketches.rank(F.col("values"), F.lit(200.0)).alias("r")).first()
        assert r.n == 200_000 and abs(r.d - 50_000) <= sketches.COUNT_ERROR * 50_000
        assert abs(r.q**2 / 200_000 - 0.25) <= sketches.RANK_ERROR and abs(r.r - 0.2) <= sketches.RANK_ERROR


def stamped(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, t string, v long").withColumn("t", F.to_timestamp("t"))


def test_sessions_close_and_late_rows_go(spark):
    parts = [
        stamped(spark, ("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:20:00", 2), ("b", "2024-01-01 05:00:00", 4)),
        stamped(spark, ("a", "2024-01-01 00:30:00", 8), ("b", "2024-01-01 04:40:00", 16), ("b", "2024-01-01 06:00:00", 32)),
        stamped(spark, ("z", "2024-02-01 00:00:00", 0)),
    ]
    out = eventtime.arrivals(spark, parts, lambda read: eventtime.sessions(read(), "k", "t", "30 minutes", "1 hour", total=F.sum("v")))
    assert sorted((r.k, r.total) for r in out.collect()) == [("a", 3), ("b", 20), ("b", 32)]


def test_repeated_deliveries(spark):
    parts = [
        stamped(spark, ("a", "2024-01-01 00:00:00", 1), ("b", "2024-01-01 00:50:00", 1)),
        stamped(spark, ("b", "2024-01-01 00:55:00", 2), ("c", "2024-01-01 09:00:00", 1)),
        stamped(spark, ("b", "2024-01-01 09:00:00", 3), ("d", "2024-01-01 01:00:00", 1)),
    ]
    out = eventtime.arrivals(spark, parts, lambda read: eventtime.first_deliveries(read(), ["k"], "t", "1 hour"))
    assert sorted((r.k, r.v) for r in out.collect()) == [("a", 1), ("b", 1), ("b", 3), ("c", 1)]


@pytest.mark.parametrize("split", [1, 2])
def test_follow_ups(spark, split):
    rows = [("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:30:00", -1), ("a", "2024-01-01 02:00:00", -2), ("b", "2024-01-01 00:10:00", 2), ("b", "2024-01-01 00:10:00", -3), ("b", "2024-01-01 00:09:59", -4)]
    parts = [stamped(spark, *rows[i::split]) for i in range(split)]
    out = eventtime.arrivals(spark, parts, lambda read: eventtime.follow_ups(read().filter("v > 0"), read().filter("v < 0"), "k", "t", "1 HOUR", "2 hours"))
    assert sorted((r.v, r.then_v) for r in out.collect()) == [(1, -1), (2, -3)]


def test_blocks_are_divided_and_joined(spark):
    rng = np.random.default_rng(1)
    rows = [("big", i, int(x)) for i, x in enumerate(rng.integers(1, 10_000, 5000))] + [("small", 10_000 + i, int(x)) for i, x in enumerate(rng.integers(1, 50, 40))] + [("few", 20_000, 7)]
    df = spark.createDataFrame(rows, "g string, key long, load long")
    got = partition.balanced_blocks(df, "g", "key", "load", 7, block_rows=300).collect()
    assert sorted((r.g, r.key, r.load) for r in got) == sorted(rows)
    for g, most in (("big", 9_999), ("small", 49)):
        sums = [sum(r.load for r in got if r.g == g and r.part == p) for p in range(7)]
        assert min(sums) > 0 and max(sums) - min(sums) <= most
    one = {(r.key, r.load) for r in partition.balanced_blocks(df.filter("g = 'small'"), "g", "key", "load", 7).collect()}
    assert len(one) == 40 and partition.balanced_blocks(df.limit(0), "g", "key", "load", 7).count() == 0
    whole = partition.balanced(df.filter("g = 'small'"), "g", "key", "load", 7).groupBy("part").agg(F.sum("load").alias("s")).collect()
    blocks = partition.balanced_blocks(df.filter("g = 'small'"), "g", "key", "load", 7).groupBy("part").agg(F.sum("load").alias("s")).collect()
    assert sorted(r.s for r in whole) == sorted(r.s for r in blocks)


def test_bootstrap_against_closed_form(spark):
    rng = np.random.default_rng(2)
    rows = [("a" if i % 3 else "b", i, float(x)) for i, x in enumerate(rng.normal(size=600))]
    df = spark.createDataFrame(rows, "g string, key long, v double")
    drawn = {r.g: r for r in metrics.bootstrap_draws(df, "g", "key", "v", 8, n=2000).collect()}
    exact = {r.g: r for r in metrics.expected_extremes(df, ["g"], "v", [8]).collect()}
    for g in "ab":
        for mean, std, want in ((drawn[g].best_mean, drawn[g].best_std, exact[g].best), (drawn[g].worst_mean, drawn[g].worst_std, exact[g].worst)):
            assert abs(mean - want) < 4 * std / np.sqrt(2000)
        own = np.array([v for k, _, v in rows if k == g])
        assert drawn[g].average_std == pytest.approx(own.std() / np.sqrt(8), rel=0.1)
