"""Balancing rows over workers by their workload.

The balancing itself is sequential, so it runs in one task for each ``group`` (a batch), whose size the user sets;
groups are independent. Batches of more than MAX_BATCH rows are an error, not a silent bottleneck; ``balanced_blocks``
takes groups of any size, in two levels.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.streaming.rollouts import state_folder

MAX_BATCH = 1_000_000


def workload(length: Column) -> Column:
    """Linear plus quadratic cost of a sequence."""
    return 24576 * length + length * length


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def round_up(n: int, divisor: int) -> int:
    return ceil_div(n, divisor) * divisor


def karmarkar_karp(loads: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """k parts by largest differencing: the two states of widest spread are joined, heaviest part to lightest.

    With ``equal_size`` the items enter k at a time, so that every part gets one of each.
    """
    if equal_size and len(loads) % k:
        raise ValueError(f"{len(loads)} items do not divide into {k} equal parts")
    order = sorted(range(len(loads)), key=lambda i: (loads[i], i))
    firsts = [order[i : i + k] for i in range(0, len(order), k)] if equal_size else [[i] for i in order]
    heap = []
    for n, items in enumerate(firsts):
        parts = sorted([(loads[i], [i]) for i in items] + [(0, [])] * (k - len(items)), key=lambda p: -p[0])
        heapq.heappush(heap, (-(parts[0][0] - parts[-1][0]), n, parts))
    n = len(firsts)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        parts = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda p: (-p[0], min(p[1], default=-1)))
        heapq.heappush(heap, (-(parts[0][0] - parts[-1][0]), n, parts))
        n += 1
    return [sorted(p[1]) for p in heap[0][2]] if heap else [[] for _ in range(k)]


def greedy(loads: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Items in order, each to the least loaded part, the first of equals; ``equal_size`` adds a load that outweighs all."""
    bias = sum(loads) + 1 if equal_size else 0
    if equal_size and len(loads) % k:
        raise ValueError(f"{len(loads)} items do not divide into {k} equal parts")
    sums, parts = [0] * k, [[] for _ in range(k)]
    for i, x in enumerate(loads):
        j = min(range(k), key=sums.__getitem__)
        parts[j].append(i)
        sums[j] += x + bias
    return parts


METHODS = {"karmarkar_karp": karmarkar_karp, "greedy": greedy}


def balanced(df: DataFrame, group: str, key: str, load: str, k: int, method: str = "karmarkar_karp", equal_size: bool = False) -> DataFrame:
    """``group, key, load, part``: no part is empty, which needs k rows a group at least."""
    divide = METHODS[method]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < k:
            raise ValueError(f"{len(pdf)} rows for {k} parts")
        if len(pdf) > MAX_BATCH:
            raise ValueError(f"a batch of {len(pdf)} rows; the most is {MAX_BATCH}")
        pdf = pdf.sort_values(key, ignore_index=True)
        part = pd.Series(-1, index=pdf.index)
        for j, rows in enumerate(divide([int(x) for x in pdf[load]], k, equal_size)):
            part.iloc[rows] = j
        if part.nunique() != k or (part < 0).any():
            raise ValueError("a part is empty or a row is left out")
        return pdf.assign(part=part.astype("int32"))

    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, key, load)}
    return df.select(group, key, load).groupBy(group).applyInPandas(one, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", part int")


def _joined_blocks(blocks: dict[int, list[int]], k: int) -> dict[int, list[int]]:
    """For each block the part that each of its k sums goes to. ``blocks`` has sums in descending order.

    The two states of widest spread are joined, heaviest to lightest, which never widens the wider one.
    """
    heap = [(sums[-1] - sums[0], b, sums, [(b, list(range(k)))]) for b, sums in blocks.items()]
    heapq.heapify(heap)
    number = max(blocks) + 1
    while len(heap) > 1:
        (_, _, x, of_x), (_, _, y, of_y) = heapq.heappop(heap), heapq.heappop(heap)
        sums = [p + q for p, q in zip(x, reversed(y), strict=True)]
        order = sorted(range(k), key=lambda j: -sums[j])
        place = [0] * k
        for new, old in enumerate(order):
            place[old] = new
        to = [(b, [place[j] for j in at]) for b, at in of_x] + [(b, [place[k - 1 - j] for j in at]) for b, at in of_y]
        sums = [sums[j] for j in order]
        heapq.heappush(heap, (sums[-1] - sums[0], number, sums, to))
        number += 1
    return dict(heap[0][3])


def balanced_blocks(df: DataFrame, group: str, key: str, load: str, k: int, block_rows: int = 65_536) -> DataFrame:
    """``group, key, load, part`` for groups of any size, by largest differencing in two levels.

    Rows are dealt to blocks of about ``block_rows`` by the hash of their key, and each block is divided into k parts.
    A group's blocks then meet as k sums each and are joined by the same rule. Joining never widens a spread, so the
    parts of a group differ by no more than those of its worst block, hence by no more than its largest load. A task
    holds one block, or k numbers for each block of a group. A group of one block is divided as by ``balanced``; a part
    is empty if the group has fewer than k rows.
    """
    counts = df.groupBy(F.col(group).alias("_g")).agg(F.ceil(F.count("*") / block_rows).cast("long").alias("_blocks"))
    dealt = df.select(group, key, load).join(counts, F.col(group) == F.col("_g")).withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks"))).drop("_g", "_blocks")

    def divide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, ignore_index=True)
        loads = [int(x) for x in pdf[load]]
        parts = sorted(karmarkar_karp(loads, k), key=lambda rows: -sum(loads[i] for i in rows))
        own = pd.Series(-1, index=pdf.index)
        for j, rows in enumerate(parts):
            own.iloc[rows] = j
        return pdf.assign(_own=own.astype("int32"))

    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, key, load)}
    own = dealt.groupBy(group, "_block").applyInPandas(divide, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", _block long, _own int")
    where = f"{state_folder(df.sparkSession)}/blocks"
    own.write.parquet(where)
    own = df.sparkSession.read.parquet(where)
    sums = own.groupBy(group, "_block", "_own").agg(F.sum(F.col(load).cast("long")).alias("_sum"))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks: dict[int, list[int]] = {}
        for b, j, x in zip(pdf["_block"], pdf["_own"], pdf["_sum"], strict=True):
            blocks.setdefault(int(b), [0] * k)[int(j)] = int(x)
        rows = [(pdf[group].iloc[0], b, j, part) for b, to in _joined_blocks(blocks, k).items() for j, part in enumerate(to)]
        return pd.DataFrame(rows, columns=["_g", "_b", "_j", "part"])

    parts = sums.groupBy(group).applyInPandas(join, f"_g {kinds[group]}, _b long, _j int, part int")
    return own.join(parts, (F.col(group) == F.col("_g")) & (F.col("_block") == F.col("_b")) & (F.col("_own") == F.col("_j"))).select(group, key, load, "part")


def micro_batches(df: DataFrame, group: str, key: str, length: str, max_tokens: int, least: int = 1, divisor: int = 1) -> DataFrame:
    """``group, key, length, part``: parts by workload, as many as the tokens need, smaller ones at both ends."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_BATCH:
            raise ValueError(f"a batch of {len(pdf)} rows; the most is {MAX_BATCH}")
        pdf = pdf.sort_values(key, ignore_index=True)
        n = max(least, min(len(pdf), math.ceil(pdf[length].sum() / max_tokens)))
        n = min(round_up(n, divisor), len(pdf))
        loads = [24576 * int(x) + int(x) ** 2 for x in pdf[length]]
        parts = sorted((p for p in karmarkar_karp(loads, n) if p), key=lambda p: -sum(loads[i] for i in p))
        parts = parts[::2][::-1] + parts[1::2]
        part = pd.Series(-1, index=pdf.index)
        for j, rows in enumerate(parts):
            part.iloc[rows] = j
        return pdf.assign(part=part.astype("int32"))

    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, key, length)}
    return df.select(group, key, length).groupBy(group).applyInPandas(one, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", part int")


def token_budget_parts(df: DataFrame, group: str, length: str, max_tokens: int, least: int = 1) -> DataFrame:
    """``group, n_parts``: how many micro-batches the tokens of a group need."""
    need = F.greatest(F.lit(least), F.least(F.count("*"), F.ceil(F.sum(length) / max_tokens)))
    return df.groupBy(group).agg(need.cast("long").alias("n_parts"))


def imbalance(df: DataFrame, part: str, load: str) -> DataFrame:
    """``min, max, diff, mean`` of the parts' loads."""
    per = df.groupBy(part).agg(F.sum(load).alias("_s"))
    return per.agg(F.min("_s").alias("min"), F.max("_s").alias("max"), (F.max("_s") - F.min("_s")).alias("diff"), F.avg("_s").alias("mean"))


def group_runs(df: DataFrame, uid: str, order: str, batch: str) -> DataFrame:
    """``run``: the number of a row's run of equal ``uid`` within its batch; a run is balanced as one item."""
    w = W.partitionBy(batch).orderBy(order)
    new = F.when(F.lag(uid).over(w).eqNullSafe(F.col(uid)), 0).otherwise(1)
    return df.withColumn("run", F.sum(new).over(w.rowsBetween(W.unboundedPreceding, 0)))


def group_balanced(df: DataFrame, uid: str, order: str, batch: str, length: str, k: int) -> DataFrame:
    """Parts that never split a run of one ``uid``."""
    runs = group_runs(df, uid, order, batch)
    loads = runs.groupBy(batch, "run").agg(F.sum(workload(F.col(length))).cast("long").alias("load"))
    return runs.join(balanced(loads, batch, "run", "load", k).select(batch, "run", "part"), [batch, "run"])


def snake_order(df: DataFrame, part: str, load: str, key: str, name: str = "place") -> DataFrame:
    """Places in a part with the small rows at both ends: every other row of the sorted ones, then the rest backwards."""
    w = W.partitionBy(part)
    i = F.row_number().over(w.orderBy(load, key)) - 1
    n = F.count("*").over(w)
    return df.withColumn("_i", i).withColumn("_n", n).withColumn(name, F.when(F.col("_i") % 2 == 0, F.col("_i") / 2).otherwise(F.col("_n") - 1 - (F.col("_i") - 1) / 2).cast("int")).drop("_i", "_n")
