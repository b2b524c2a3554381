"""Growing datasets and verification of copies."""

import shutil

import pytest
from pyspark.sql import functions as F

from tessella.sources import copies
from tessella.sources.growth import GrowingDataset


def numbers(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def test_snapshots_stay_as_they_are(spark, tmp_path):
    data = GrowingDataset(spark, str(tmp_path / "d"), numbers(spark).schema, keep=lambda rows: rows.filter("id < 100"))
    assert data.last() == 0 and data.snapshot().count() == 0
    assert data.append(numbers(spark, 1, 2, 500)) == 1
    first = data.snapshot()
    assert data.on_batch_end(lambda rows: rows.select((F.col("id") * 10).alias("id"))) == 2
    assert data.on_batch_end(lambda rows: rows.select((F.col("id") * 10).alias("id")), version=1) == 3
    assert sorted(r.id for r in first.collect()) == [1, 2]
    assert sorted(r.id for r in data.snapshot().collect()) == [1, 2, 10, 10, 20, 20]
    assert [(r.version, r.n_rows) for r in data.versions().orderBy("version").collect()] == [(1, 2), (2, 2), (3, 2)]


def test_a_taken_version_is_not_overwritten(spark, tmp_path, monkeypatch):
    a = GrowingDataset(spark, str(tmp_path / "d"), numbers(spark).schema)
    b = GrowingDataset(spark, str(tmp_path / "d"), numbers(spark).schema)
    a.append(numbers(spark, 1))
    monkeypatch.setattr(b, "last", lambda: 0)  # b has looked before a wrote
    assert b.append(numbers(spark, 2)) == 2
    assert sorted(r.id for r in a.snapshot(2).collect()) == [1, 2]


def test_a_part_without_its_entry_is_in_no_version(spark, tmp_path):
    data = GrowingDataset(spark, str(tmp_path / "d"), numbers(spark).schema)
    data.append(numbers(spark, 1))
    numbers(spark, 2).write.parquet(str(tmp_path / "d/data/lost"))
    assert [r.id for r in data.snapshot().collect()] == [1]


@pytest.fixture
def folders(tmp_path):
    for name in ("x/one.txt", "x/two.txt", "x/deep/three.txt", "y/four.txt", "five.txt"):
        f = tmp_path / "a" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(name)
    shutil.copytree(tmp_path / "a", tmp_path / "b")
    return tmp_path


def test_copies(spark, folders):
    a, b = (copies.listing(spark, str(folders / n)) for n in "ab")
    assert copies.same(a, b) and copies.differences(a, b).count() == 0
    assert {(r.directory, r.files) for r in copies.tree(a).collect()} == {("", 5), ("x", 3), ("x/deep", 1), ("y", 1)}
    (folders / "b/x/deep/three.txt").write_text("longer than before")
    (folders / "b/y/four.txt").unlink()
    (folders / "b/y/six.txt").write_text("6")
    (folders / "b/x/one.txt").write_text("")
    b = copies.listing(spark, str(folders / "b"))
    assert not copies.same(a, b)
    assert {(r.path, r.what) for r in copies.differences(a, b).collect()} == {("x/deep/three.txt", "size"), ("y/four.txt", "missing"), ("y/six.txt", "extra"), ("x/one.txt", "missing")}
