"""Union-find over a distributed table of links: the smallest id that each id reaches.

Alternating large-star and small-star rounds, each a hash aggregate and a join that deals out the links of a hub, so
neither a component nor the links ever meet in one task. Every round is written to the shared folder; the round before
it is then deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import scratch


SMALL = 50_000


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _with_least(links: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
    """(``links(u, v)`` with the least ``v`` of each ``u`` as ``m``, the table of these); ``small`` ones are broadcast."""
    low = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w"))
    if small:
        return links.join(F.broadcast(low), "u"), low
    low = scratch.save(low, "low")
    return scratch.join_keyed(links, low, "u", "w", small=SMALL), low


def _large_star(links: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
    """Every larger neighbour of a node is linked with the smallest of the node and its neighbours."""
    both, low = _with_least(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), small)
    return both.filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), low


def _small_star(links: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
    """Every smaller-or-equal neighbour of a node, and the node, is linked with the smallest of them."""
    both, low = _with_least(links, small)
    moved = both.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), low


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every id in ``links(a, b)`` that is not the smallest of its component."""
    start = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.save(start, "links")
    mark = _mark(now)
    while mark[0]:
        small = 2 * mark[0] <= SMALL  # the links of a round are at most those of the one before
        large, low = _large_star(now, small)
        large = large if small else scratch.save(large, "large")
        fewer, low2 = _small_star(large, small)
        after = scratch.save(fewer, "links")
        for done in (now, low, large, low2):
            scratch.drop(done)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
