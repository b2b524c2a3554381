"""Datasets and metric sinks as Spark data sources written in Python.

A dataset is a subclass of :class:`Dataset`: it lists its parts with the range of keys that each holds, and reads one
part's rows. ``register`` makes a data source of it, so ``spark.read.format(name)`` and ``spark.readStream.format(name)``
work as for any other. Each part is a task of its own. The options ``low`` and ``high`` (both included) bound the key:
parts out of range are not listed as tasks at all, and rows out of range are not handed to Spark. They are options
of a read, and not filters that the source takes from Spark, because all scans of one DataFrame share what was last
pushed into a source in Python: with Spark 4.1.2, ``df.count()`` after ``df.filter(...).count()`` counted the filtered
rows. A stream's offset is the number of versions that it has read; parts of later versions are its next batch.

``metric_lines`` is a sink of such a dataset, lines ``{"step": s, "data": {...}}``. A task writes a file that nobody
reads yet and reports its name, its rows and its steps; the commit writes one manifest that lists the files of the
attempts that succeeded. Files of failed or repeated attempts are in no manifest, so each row is there once. A commit has
a name (``batch``; in streams the number of the micro-batch), and one that exists already is not made again.

Defined cases: no manifest is an empty dataset; an empty batch is a version without parts; null metrics are left out of a line; a null step is an error;
one job commits to a folder at a time, as numbers of versions are taken in turn.
Folders are those that ``pyarrow.fs`` opens (local, shared mounts, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import math
import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

METRICS = "step long, data map<string,double>"


@dataclass
class Part(ds.InputPartition):
    """What one task reads: a name, the version that added it, and the least and greatest key in it."""

    name: str
    version: int
    low: object
    high: object


class Dataset(ABC):
    """What ``register`` takes: the schema, the column that parts are ranges of, the parts, and the rows of one."""

    schema: str
    key: str

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    @abstractmethod
    def versions(self) -> int:
        """How many versions there are; it only grows."""

    @abstractmethod
    def parts(self, after: int, upto: int) -> list[Part]:
        """The parts of versions after ``after`` and not after ``upto``."""

    @abstractmethod
    def rows(self, part: Part) -> Iterator[tuple]:
        """The rows of a part, in the order of ``schema``."""


def _within(options: dict[str, str], low, high) -> bool:
    """Whether keys from ``low`` to ``high`` meet the bounds of a read; a null key meets none."""
    if "low" not in options and "high" not in options:
        return True
    if low is None or high is None:
        return False
    kind = type(low)
    return ("low" not in options or high >= kind(options["low"])) and ("high" not in options or low <= kind(options["high"]))


def register(spark: SparkSession, name: str, dataset: type[Dataset]) -> None:
    """Make ``dataset`` readable by ``name``, in batches and streams; anything but a subclass of Dataset is an error."""
    if not (isinstance(dataset, type) and issubclass(dataset, Dataset)):
        raise TypeError(f"the dataset of {name} must be a subclass of Dataset")
    fields = spark.createDataFrame([], dataset.schema).columns
    at = fields.index(dataset.key)

    class Reader(ds.DataSourceReader):
        def __init__(self, data: Dataset):
            self.data = data

        def partitions(self):
            upto = int(self.data.options.get("version", self.data.versions()))
            return [p for p in self.data.parts(0, upto) if _within(self.data.options, p.low, p.high)]

        def read(self, part):
            # Spark asks for a read without a part where there are none
            return (r for r in self.data.rows(part) if _within(self.data.options, r[at], r[at])) if part is not None else iter(())

    class StreamReader(ds.DataSourceStreamReader):
        def __init__(self, data: Dataset):
            self.data = data

        def initialOffset(self):
            return {"version": 0}

        def latestOffset(self):
            return {"version": self.data.versions()}

        def partitions(self, start, end):
            return self.data.parts(start["version"], end["version"])

        def read(self, part):
            return self.data.rows(part)

    class Source(ds.DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return dataset.schema

        def reader(self, schema):
            return Reader(dataset(self.options))

        def streamReader(self, schema):
            return StreamReader(dataset(self.options))

        def writer(self, schema, overwrite):
            if overwrite:
                raise ValueError("versions are only added")
            return dataset.writer(self.options)

        def streamWriter(self, schema, overwrite):
            return dataset.stream_writer(self.options)

    spark.dataSource.register(Source)


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder.rstrip("/"))


@dataclass
class Written(ds.WriterCommitMessage):
    name: str
    rows: int
    low: int | None
    high: int | None


class _LineWriter:
    """The work of one attempt, and the manifest."""

    def __init__(self, options):
        self.folder, self.batch = options["path"], options.get("batch")

    def write(self, rows) -> Written:
        fs, root = _open(self.folder)
        name, n, low, high = f"files/{uuid.uuid4().hex}.jsonl", 0, None, None
        fs.create_dir(f"{root}/files", recursive=True)
        with fs.open_output_stream(f"{root}/{name}") as out:
            for step, data in ((r[0], r[1]) for r in rows):
                if step is None:
                    raise ValueError("a row of metrics has no step")
                data = {k: v if math.isfinite(v) else repr(v) for k, v in (data or {}).items() if v is not None}
                out.write((json.dumps({"step": step, "data": data}) + "\n").encode())
                n, low, high = n + 1, step if low is None else min(low, step), step if high is None else max(high, step)
        return Written(name, n, low, high)

    def publish(self, messages, batch: str | None) -> None:
        fs, root = _open(self.folder)
        known = _manifests(fs, root)
        if batch is not None and any(m["batch"] == batch for _, m in known):
            return self.discard(messages)
        files = [vars(m) for m in messages if m is not None and m.rows]
        place = f"{root}/manifests/{len(known) + 1:09d}.json"
        fs.create_dir(f"{root}/manifests", recursive=True)
        with fs.open_output_stream(place + ".new") as out:
            out.write(json.dumps({"batch": batch, "files": files}).encode())
        fs.move(place + ".new", place)

    def discard(self, messages) -> None:
        fs, root = _open(self.folder)
        for m in messages:
            if m is not None and fs.get_file_info(f"{root}/{m.name}").type != pyarrow.fs.FileType.NotFound:
                fs.delete_file(f"{root}/{m.name}")


def _manifests(fs: pyarrow.fs.FileSystem, root: str) -> list[tuple[int, dict]]:
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/manifests", allow_not_found=True))
    out = []
    for f in sorted(x.path for x in found if x.path.endswith(".json")):
        with fs.open_input_stream(f) as data:
            out.append((int(f.rsplit("/", 1)[1][:-5]), json.loads(data.read())))
    return out


class _Batch(ds.DataSourceWriter):
    def __init__(self, options):
        self.lines = _LineWriter(options)

    def write(self, iterator):
        return self.lines.write(iterator)

    def commit(self, messages):
        self.lines.publish(messages, self.lines.batch)

    def abort(self, messages):
        self.lines.discard(messages)


class _Stream(ds.DataSourceStreamWriter):
    def __init__(self, options):
        self.lines = _LineWriter(options)

    def write(self, iterator):
        return self.lines.write(iterator)

    def commit(self, messages, batchId):
        self.lines.publish(messages, f"stream-{batchId}")

    def abort(self, messages, batchId):
        self.lines.discard(messages)


class MetricLines(Dataset):
    """Metrics as lines of JSON below the option ``path``; parts are the files of the manifests."""

    schema, key = METRICS, "step"
    writer, stream_writer = _Batch, _Stream

    def versions(self) -> int:
        return len(_manifests(*_open(self.options["path"])))

    def parts(self, after: int, upto: int) -> list[Part]:
        return [Part(f["name"], v, f["low"], f["high"]) for v, m in _manifests(*_open(self.options["path"])) if after < v <= upto for f in m["files"]]

    def rows(self, part: Part) -> Iterator[tuple]:
        fs, root = _open(self.options["path"])
        with fs.open_input_stream(f"{root}/{part.name}") as data:
            rest = b""
            while block := data.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    one = json.loads(line)
                    yield one["step"], {k: float(v) for k, v in one["data"].items()}


def metric_lines(spark: SparkSession) -> str:
    """The name of the source and sink of metrics, registered with this session."""
    register(spark, "metric_lines", MetricLines)
    return "metric_lines"


def log_metrics(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Add ``rows(step, data)`` as one version; files are ranges of steps, so readers of a few steps open few of them."""
    out = rows.select("step", "data").repartitionByRange("step").write.format(metric_lines(rows.sparkSession)).option("path", path)
    (out.option("batch", batch) if batch is not None else out).mode("append").save()
