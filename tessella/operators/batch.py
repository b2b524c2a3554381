"""Batch algebra over DataFrames: projection, row selection, repetition, chunks, padding.

Rows of a DataFrame have no order, so operators that depend on one take ``order``, the columns of a unique key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def select(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns by name; a missing one is an error."""
    if missing := [k for k in keys if k not in df.columns]:
        raise KeyError(f"no such columns: {missing}")
    return df.select(*keys)


def pop(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(the columns ``keys``, the others)."""
    return select(df, keys), df.drop(*keys)


def rename(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError(f"{len(old)} old and {len(new)} new names")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def with_ordinal(df: DataFrame, order: Sequence[str | Column], name: str = "rn") -> DataFrame:
    """Ordinals from 0 in the order of a key, without bringing all rows to one task.

    Rows are dealt by ranges of the key and sorted in their partitions, ties by all columns, so that a partition that is
    made again has the same order; its ordinals begin where the counts of the partitions before it end, a table of one
    row a partition.
    """
    plain = [c for c, k in df.dtypes if "map<" not in k and "variant" not in k]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order, F.xxhash64(*plain)).withColumn("_m", F.monotonically_increasing_id()).persist()
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", before.alias("_before"))
    return dealt.join(F.broadcast(offsets), part == F.col("_p")).withColumn(name, (place + F.col("_before")).cast("long")).drop("_m", "_p", "_before")


def pick(df: DataFrame, order: Sequence[str], indices: Sequence[int], name: str = "ord") -> DataFrame:
    """Rows by ordinal, repeated and in the order of ``indices``, which column ``name`` carries."""
    wanted = df.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(indices)], f"{name} long, _rn long")
    return with_ordinal(df, order, "_o").join(wanted, F.col("_o") == F.col("_rn")).drop("_o", "_rn")


def reorder(df: DataFrame, order: Sequence[str], permutation: DataFrame, name: str = "ord") -> DataFrame:
    """All rows in the order of a permutation, which column ``name`` carries: row ``ord`` of the result is the row with
    ordinal ``rn`` (columns of ``permutation``). One that does not name every ordinal once is an error."""
    rows = with_ordinal(df, order, "_rn")
    to = permutation.select(F.col("rn").cast("long").alias("_to"), F.col("ord").cast("long").alias(name))
    n = df.count()
    named = permutation.filter(F.col("rn").between(0, n - 1) & F.col("ord").between(0, n - 1)).agg(F.count("*"), F.countDistinct("rn"), F.countDistinct("ord"))
    if tuple(named.first()) != (n, n, n) or permutation.count() != n:
        raise ValueError(f"not a permutation of {n} rows")
    return rows.join(to, F.col("_rn") == F.col("_to")).drop("_rn", "_to")


def where(df: DataFrame, mask: Column) -> DataFrame:
    """Rows for which a boolean mask is true."""
    return df.filter(mask)


def slice_rows(df: DataFrame, order: Sequence[str], start: int = 0, stop: int | None = None, step: int = 1, name: str = "rn") -> DataFrame:
    """Rows ``start:stop:step`` by ordinal."""
    rows = with_ordinal(df, order, name).filter(F.col(name) >= start)
    if stop is not None:
        rows = rows.filter(F.col(name) < stop)
    return rows.filter((F.col(name) - start) % step == 0)


def get_item(df: DataFrame, order: Sequence[str], item) -> DataFrame:
    """``[]``: an int, a slice, a list of ints or a boolean Column."""
    if isinstance(item, slice):
        return slice_rows(df, order, item.start or 0, item.stop, item.step or 1)
    if isinstance(item, Column):
        return where(df, item)
    return pick(df, order, [item] if isinstance(item, int) else item)


def union_columns(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Columns of both sides of equal rows; columns on both sides must be deep-equal (NaN equals NaN), else an error."""
    shared = [c for c in right.columns if c in left.columns and c not in key]
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in shared})
    both = left.join(r, list(key), "inner")
    if shared:
        same = F.lit(True)
        for c in shared:
            same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        first = shared[0]
        kept = F.when(same, F.col(first)).otherwise(F.raise_error(F.lit(f"columns {shared} differ between the sides")).cast(left.schema[first].dataType))
        both = both.withColumn(first, kept)
    return both.drop(*[f"_r_{c}" for c in shared])


def repeat(df: DataFrame, times: int, interleave: bool = True, order: Sequence[str] = (), name: str = "rep") -> DataFrame:
    """Each row ``times`` times; ``name`` is the copy's number. Sorting by (order, name) interleaves, (name, order) tiles."""
    out = df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else df.withColumn(name, F.lit(0)).limit(0)
    return out.orderBy(*order, name) if order and interleave else out.orderBy(name, *order) if order else out


def repeat_each(df: DataFrame, counts: str, name: str = "rep") -> DataFrame:
    """Each row as often as its column ``counts`` says; none for 0."""
    return df.select("*", F.posexplode(F.array_repeat(F.lit(1), F.col(counts).cast("int"))).alias(name, "_one")).drop("_one")


def chunk(df: DataFrame, order: Sequence[str], chunks: int, pad: bool = False, name: str = "chunk") -> DataFrame:
    """Contiguous pieces of ceil(n / chunks) rows; without ``pad``, a count that does not divide is an error."""
    n = df.count()
    if n % chunks and not pad:
        raise ValueError(f"{n} rows do not divide into {chunks} chunks")
    size = max(1, -(-n // chunks))
    return with_ordinal(df, order, "_o").withColumn(name, F.floor(F.col("_o") / size).cast("int")).drop("_o")


def split(df: DataFrame, order: Sequence[str], size: int, name: str = "part") -> DataFrame:
    """Contiguous pieces of ``size`` rows, the last one shorter."""
    return with_ordinal(df, order, "_o").withColumn(name, F.floor(F.col("_o") / size).cast("int")).drop("_o")


def batches(df: DataFrame, order: Sequence[str], size: int, drop_last: bool = True, name: str = "batch") -> DataFrame:
    """Batch numbers; an incomplete last batch goes with ``drop_last``."""
    n = df.count()
    out = split(df, order, size, name)
    return out.filter(F.col(name) < n // size) if drop_last else out


def pad_to_divisor(df: DataFrame, order: Sequence[str], divisor: int) -> DataFrame:
    """Rows from the head again, cycling, until the count divides; ``is_pad`` marks them, ``rn`` goes on counting."""
    n = df.count()
    rows = with_ordinal(df, order, "rn")
    missing = -n % divisor if n else 0
    if not missing:
        return rows.withColumn("is_pad", F.lit(False))
    again = -(-missing // n)
    copies = rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(again)))).withColumn("rn", F.col("rn") + F.col("_k") * n).drop("_k")
    return rows.withColumn("is_pad", F.lit(False)).unionByName(copies.filter(F.col("rn") < n + missing).withColumn("is_pad", F.lit(True)))


def unpad(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_pad")).drop("is_pad")


def pad_with_edge(df: DataFrame, order: Sequence[str], rows: int, candidate: str = "last") -> DataFrame:
    """``rows`` copies of the first row, or for any other candidate of the last one."""
    edge = df.orderBy(*[c if candidate == "first" else F.desc(c) for c in order]).limit(1)
    return df.withColumn("is_pad", F.lit(False)).unionByName(repeat(edge, rows).drop("rep").withColumn("is_pad", F.lit(True)))


def fold(df: DataFrame, order: Sequence[str], size: int, columns: Sequence[str], name: str = "fold") -> DataFrame:
    """``size`` rows become one: arrays of their columns in order."""
    rows = with_ordinal(df, order, "_o").withColumn(name, F.floor(F.col("_o") / size).cast("int"))
    packed = rows.groupBy(name).agg(F.array_sort(F.collect_list(F.struct("_o", *columns))).alias("_s"))
    return packed.select(name, *[F.col("_s").getField(c).alias(c) for c in columns])


def unfold(df: DataFrame, columns: Sequence[str], name: str = "k") -> DataFrame:
    """The inverse of ``fold``: one row for each place of the arrays."""
    zipped = F.arrays_zip(*columns)
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.posexplode(zipped).alias(name, "_z")).select(*others, name, *[F.col(f"_z.{c}").alias(c) for c in columns])


def unfold_chunks(df: DataFrame, columns: Sequence[str], pieces: int, name: str = "piece") -> DataFrame:
    """Array columns cut into ``pieces`` equal parts, a row each; other columns are repeated."""
    out = df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    size = lambda c: F.floor(F.size(c) / pieces).cast("int")
    return out.withColumns({c: F.slice(c, F.col(name) * size(c) + 1, size(c)) for c in columns})


def trajectory_numbers(df: DataFrame, index: str, order: Sequence[str], name: str = "rollout_n", block: int = 1 << 16) -> DataFrame:
    """Run-length counter over consecutive equal values of ``index``, from 0.

    Ordinals are dealt to blocks. In a block a row's run begins at the last change before it; where there is none, at
    the last change of the blocks before, which is a running maximum over a table of one row a block.
    """
    rows = with_ordinal(df, order, "_o").withColumn("_b", F.floor(F.col("_o") / block))
    ends = rows.groupBy("_b").agg(F.max_by(F.struct(index), "_o").alias("_end"))
    rows = rows.join(ends.select((F.col("_b") + 1).alias("_b"), F.col("_end")[index].alias("_end")), "_b", "left")
    w = W.partitionBy("_b").orderBy("_o")
    before = F.when(F.row_number().over(w) == 1, F.col("_end")).otherwise(F.lag(index).over(w))
    begins = F.when((F.col("_o") == 0) | ~before.eqNullSafe(F.col(index)), F.col("_o"))
    rows = rows.withColumn("_s", begins)
    last = rows.groupBy("_b").agg(F.max("_s").alias("_m"))
    carried = F.max("_m").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.join(last.select("_b", carried.alias("_c")), "_b")
    here = F.last("_s", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn(name, F.col("_o") - F.coalesce(here, F.col("_c"))).drop("_o", "_b", "_end", "_s", "_c")


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """Column names with ``prefix/``, unless they begin with it."""
    return df.withColumnsRenamed({c: f"{prefix}/{c}" for c in df.columns if not c.startswith(f"{prefix}/")})


def unite(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; columns that one lacks are null there. Structs of one name must have the same fields."""
    out = frames[0]
    for f in frames[1:]:
        for c in set(out.columns) & set(f.columns):
            x, y = (d.schema[c].dataType for d in (out, f))
            if isinstance(x, StructType) and isinstance(y, StructType) and set(x.names) != set(y.names):
                raise ValueError(f"fields of {c} differ: {sorted(x.names)} and {sorted(y.names)}")
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def outer_merge(left: DataFrame, right: DataFrame, key: str, values: str) -> DataFrame:
    """``key, values``: the arrays of both sides one after the other; a key that a side lacks is empty there."""
    r = right.select(key, F.col(values).alias("_right"))
    kind = left.schema[values].dataType
    both = F.concat(*[F.coalesce(c, F.array().cast(kind)) for c in (values, "_right")])
    return left.select(key, values).join(r, key, "full").select(key, both.alias(values))


def inverse(permutation: DataFrame) -> DataFrame:
    """The permutation ``rn, ord`` that takes ``permutation``'s result back."""
    return permutation.select(F.col("ord").alias("rn"), F.col("rn").alias("ord"))


def transpose(df: DataFrame, order: str, column: str) -> DataFrame:
    """``key, values``: an array for each key of a map column, in order of rows; rows with other keys are an error."""
    keys = F.array_sort(F.map_keys(column))
    first = df.select(order, keys.alias("_k")).agg(F.min_by("_k", order).alias("_k"))
    ok = F.when(keys == F.col("_k"), F.col(column)).otherwise(F.raise_error(F.lit("rows have different keys")).cast(df.schema[column].dataType))
    rows = df.crossJoin(F.broadcast(first)).select(order, F.explode(ok).alias("key", "_v"))
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), "_v")))
    return rows.groupBy("key").agg(F.transform(packed, lambda s: s["_v"]).alias("values"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, with ``side``; of repeated rows as many as are too many. Empty for equal batches."""
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError(f"columns differ: {sorted(left.columns)} and {sorted(right.columns)}")
    right = right.select(*left.columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def row_range(df: DataFrame, order: Sequence[str], start: int, rows: int, name: str = "rn") -> DataFrame:
    """``rows`` rows from ordinal ``start``, or as many as there are."""
    return slice_rows(df, order, start, start + rows, 1, name)


def sampled_order(df: DataFrame, key: str, kind: str = "sequential", seed: int = 0, weight: str | None = None, name: str = "place") -> DataFrame:
    """``name``: the place of each row in an epoch: by key, shuffled by a digest of seed and key, or heaviest first."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    orders = {"sequential": [F.col(key)], "random": [digest, F.col(key)], "curriculum": [F.desc(weight or key), F.col(key)]}
    if kind not in orders:
        raise ValueError(f"no such sampler: {kind}")
    return with_ordinal(df, orders[kind], name)


def feedback(weights: DataFrame, batch: DataFrame, key: str, score: str, rate: float = 0.5) -> DataFrame:
    """A curriculum's ``key, weight`` after a batch: rows that scored low weigh more next time."""
    per = batch.groupBy(key).agg(F.avg(score).alias("_s"))
    moved = F.col("weight") + rate * (1.0 - F.col("_s") - F.col("weight"))
    return weights.join(per, key, "left").select(key, F.coalesce(moved, F.col("weight")).alias("weight"))


def mesh(df: DataFrame, order: Sequence[str], shards: int, replicas: int) -> DataFrame:
    """Rows for each rank of a mesh: a shard's rows go to all its ``replicas``; ``collects`` marks the one that answers."""
    rows = chunk(df, order, shards, pad=True, name="shard").withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    return rows.withColumn("rank", F.col("shard") * replicas + F.col("replica")).withColumn("collects", F.col("replica") == 0)


def all_gather(df: DataFrame, ranks: int) -> DataFrame:
    """Every row on every rank."""
    return df.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))


def info(df: DataFrame) -> DataFrame:
    """``column, type, nullable``."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema], "column string, type string, nullable boolean")
