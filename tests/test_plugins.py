"""Datasets as data sources, and the sink of metrics."""

import json
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.sources import plugin


def metrics(spark, steps):
    return spark.createDataFrame([(s, {"loss": s / 4, "none": None}) for s in steps], plugin.METRICS)


def read(spark, path, **options):
    return spark.read.format(plugin.metric_lines(spark)).options(**options).load(str(path))


def test_only_datasets_are_registered(spark):
    for wrong in (dict, 3, "MetricLines"):
        with pytest.raises(TypeError):
            plugin.register(spark, "wrong", wrong)


def test_versions_empty_batches_and_nulls(spark, tmp_path):
    assert read(spark, tmp_path).count() == 0
    plugin.log_metrics(metrics(spark, range(10)), str(tmp_path))
    plugin.log_metrics(metrics(spark, []), str(tmp_path))
    plugin.log_metrics(metrics(spark, [10, 10]), str(tmp_path))
    got = [(r.step, r.data) for r in read(spark, tmp_path).orderBy("step").collect()]
    assert got == [(s, {"loss": s / 4}) for s in [*range(11), 10]]
    assert read(spark, tmp_path, version=1).count() == read(spark, tmp_path, version=2).count() == 10
    odd = spark.createDataFrame([(1, {"a": float("nan"), "b": float("inf")})], plugin.METRICS)
    plugin.log_metrics(odd, str(tmp_path / "odd"))
    data = read(spark, tmp_path / "odd").first().data
    assert data["a"] != data["a"] and data["b"] == float("inf")
    with pytest.raises(Exception, match="no step"):
        plugin.log_metrics(spark.createDataFrame([(None, {"a": 1.0})], plugin.METRICS), str(tmp_path / "null"))
    assert read(spark, tmp_path / "null").count() == 0


def test_bounds_reach_the_source(spark, tmp_path):
    plugin.log_metrics(metrics(spark, range(0, 100)), str(tmp_path))
    plugin.log_metrics(metrics(spark, range(100, 200)), str(tmp_path))
    whole = read(spark, tmp_path)
    assert read(spark, tmp_path, low=120, high=130).rdd.getNumPartitions() < whole.rdd.getNumPartitions()
    for bounds, want in [({"low": 7, "high": 7}, [7]), ({"low": 198}, [198, 199]), ({"high": 1}, [0, 1]), ({"low": 1000}, []), ({"low": 9, "high": 8}, [])]:
        assert [r.step for r in read(spark, tmp_path, **bounds).orderBy("step").collect()] == want, bounds


def test_scans_of_one_dataframe_do_not_share_filters(spark, tmp_path):
    plugin.log_metrics(metrics(spark, range(200)), str(tmp_path))
    whole = read(spark, tmp_path)
    assert [whole.count(), whole.filter("step < 5").count(), whole.count()] == [200, 5, 200]
    assert whole.filter("step < 5").union(whole.filter("step >= 190")).count() == 15


def test_a_stream_is_written_once(spark, tmp_path):
    """A commit that is repeated after its manifest was written adds nothing."""
    metrics(spark, range(20)).write.parquet(str(tmp_path / "in"))
    name = plugin.metric_lines(spark)
    stream = spark.readStream.schema(plugin.METRICS).parquet(str(tmp_path / "in"))
    start = lambda: stream.writeStream.format(name).option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    start()
    for f in (tmp_path / "state" / "commits").iterdir():
        f.unlink()  # as if the driver was lost between the sink's commit and the stream's
    start()
    assert read(spark, tmp_path / "out").count() == 20


def test_tasks_that_fail_after_writing_leave_no_rows(tmp_path):
    """Every task fails once in the middle of its rows; another session, as this one does not retry tasks."""
    code = """
    import sys
    from pyspark import TaskContext
    from tessella.session import build_session
    from tessella.sources import plugin
    spark = build_session("local[2,4]", partitions=3, memory="1g")
    path = sys.argv[1]
    def twice(batches):
        for b in batches:
            yield b.slice(0, 1)
            if TaskContext.get().attemptNumber() == 0:
                raise OSError("lost")
            yield b.slice(1)
    rows = spark.range(0, 60, 1, 3).selectExpr("id AS step", "map('x', double(id)) AS data")
    failing = rows.mapInArrow(twice, plugin.METRICS)
    failing.write.format(plugin.metric_lines(spark)).option("path", path).mode("append").save()
    print(sorted(r.step for r in spark.read.format("metric_lines").load(path).collect()) == list(range(60)))
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code), str(tmp_path / "m")], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=240)
    assert done.stdout.strip().endswith("True"), done.stderr[-2000:]
    listed = [f["name"] for m in (tmp_path / "m" / "manifests").iterdir() for f in json.loads(m.read_text())["files"]]
    written = list((tmp_path / "m" / "files").iterdir())
    assert len(listed) == 3 and len(written) >= 3


def test_another_dataset(spark):
    class Squares(plugin.Dataset):
        schema, key = "n long, square long", "n"

        def versions(self):
            return 1

        def parts(self, after, upto):
            size = int(self.options["size"])
            return [plugin.Part(str(k), 1, k, min(k + 9, size - 1)) for k in range(0, size, 10)] if after < 1 <= upto else []

        def rows(self, part):
            return ((n, n * n) for n in range(part.low, part.high + 1))

    plugin.register(spark, "squares", Squares)
    df = spark.read.format("squares").option("size", "95").load()
    assert df.count() == 95 and df.rdd.getNumPartitions() == 10
    assert spark.read.format("squares").options(size="95", low="90").load().rdd.getNumPartitions() == 1
    assert df.agg(F.sum("square")).first()[0] == sum(n * n for n in range(95))
