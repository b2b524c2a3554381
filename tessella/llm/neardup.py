"""Near-duplicates by SuperMinHash signatures, banding, verification on full shingle sets, and union-find.

1. One pass over the texts makes each document's set of 5-word shingles (64-bit hashes) and its SuperMinHash signature.
   Element d ranks the 128 slots by a random permutation, level by level: at level j it offers ``(j, random rank)`` to
   the j-th slot of its permutation, and a slot keeps the least offer. Levels go on only until every slot is filled, so
   a long text costs one level. Slots share one permutation an element, which lowers the estimate's variance.
2. Documents with equal sets form a class; only the class goes on, so copies cost one row each.
3. A signature is 32 bands of 4 slots: a pair at the threshold of 0.75 shares no band with probability 5e-6.
   In a bucket every class is held against the first one, so a bucket of n members gives n - 1 pairs.
4. Pairs are verified on full sets, and union-find gives components.
5. Buckets whose members are still in several components are gone through in blocks of at most about 256 members, those
   of a bucket's largest component apart. Every pair of blocks, but for two of that component, is one cell, which holds
   members of different components against each other by signature, each
   pair in the first band that it shares. Members with any partner that may be similar come back with their sets; the
   task verifies all such pairs, and passes on only links that join what it has not joined yet. Thus no pair of a
   bucket is left out, no bucket has to fit in a task, and no group gives all its pairs as rows.

Defined cases: a text that is null, empty or white space only has an empty set and no links; a text of fewer than five
words is one shingle; rows with a null id stand alone (null component, kept); rows that repeat an id are documents of
their own, in the same component where their texts are; ``keep_one`` goes by rows, not by ids. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import scratch
from tessella.llm.components import components
from tessella.llm.textvec import mix, shingle_sets

SHINGLE = 5
PERCENT = 75
SLOTS, ROWS = 128, 4
BANDS = SLOTS // ROWS
BLOCK = 256
#: Signatures' estimates from which a pair of different components is verified: five standard errors below 0.75.
MAYBE = 0.75 - 5 * (0.75 * 0.25 / SLOTS) ** 0.5
_RANK_BITS = np.uint64(57)
_RANK = (np.uint64(1) << _RANK_BITS) - np.uint64(1)


def super_minhash(items: np.ndarray) -> np.ndarray:
    """128 values ``level << 57 | rank`` of a set of distinct, scrambled 64-bit hashes."""
    key = np.sort(mix(items, 10_000))  # the upper 7 bits are the slot at level 0, the lower ones the rank
    low = np.arange(SLOTS, dtype=np.uint64) << _RANK_BITS
    at = np.searchsorted(key, low)
    found = key[np.minimum(at, len(key) - 1)]
    full = (at < len(key)) & ((found >> _RANK_BITS) == np.arange(SLOTS, dtype=np.uint64))
    out = np.where(full, found & _RANK, np.uint64(2**64 - 1))
    if full.all():
        return out
    every = np.arange(len(items))
    order = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(items), 1))
    k = (mix(items, 10_000) >> _RANK_BITS).astype(np.int64)
    order[every, k] = order[:, 0]
    for level in range(1, SLOTS):
        draw = mix(items, 10_000 + level)
        k = level + (((draw >> np.uint64(32)) * np.uint64(SLOTS - level)) >> np.uint64(32)).astype(np.int64)
        slot = order[every, k]
        order[every, k] = order[:, level]
        new = ~full[slot]
        if new.any():
            s = slot[new]
            np.minimum.at(out, s, (np.uint64(level) << _RANK_BITS) | (mix(draw[new], 3) & _RANK))
            full[s] = True
            if full.all():
                break
    return out


def pack(signature: np.ndarray) -> np.ndarray:
    """Bands of four 16-bit fingerprints, a long each."""
    return (mix(signature, 5) >> np.uint64(48)).astype(np.uint16).view(np.int64)


SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        size, keys, sig = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64), np.zeros((n, BANDS), np.int64)
        for i, items in shingle_sets(batch.column(1), SHINGLE):
            size[i] = len(items)
            if len(items):
                keys[i] = _keys(items)
                sig[i] = pack(super_minhash(items))
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(sig.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64)), bands], ["doc_id", "n_shingles", "k1", "k2", "bands"])


def _keys(items: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two fingerprints of a set, which with its size tell classes of equal sets apart."""
    return mix(items, 1).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(items, 2))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the texts that belong to their class; of a class's repeated rows a task gives one."""
    seen: set[int] = set()
    for batch in batches:
        found, of = [], []
        cid, k1, k2 = (batch.column(c).to_numpy() for c in (1, 2, 3))
        for i, items in shingle_sets(batch.column(0), SHINGLE):
            if len(items) and int(cid[i]) not in seen and tuple(x.view(np.int64) for x in _keys(items)) == (k1[i], k2[i]):
                seen.add(int(cid[i]))
                of.append(int(cid[i]))
                found.append(items.view(np.int64))
        ends = np.cumsum([0, *map(len, found)], dtype=np.int64)
        values = np.concatenate(found) if found else np.zeros(0, np.int64)
        column = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(values)).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), column], ["cid", "items"])


def _sets_of(ids: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """``cid, items`` for every class in ``ids(_w)``, saved. A class's set is that of its smallest id's text of that class."""
    wanted = reps.join(ids.distinct(), F.col("cid") == F.col("_w")).select("cid", F.col("rep").alias("_rep"), "k1", "k2")
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("_text")).join(wanted.hint("shuffle_hash"), F.col("_doc") == F.col("_rep"))
    return scratch.save(texts.select("_text", "cid", "k1", "k2").mapInArrow(_sets, "cid long, items array<long>").dropDuplicates(["cid"]), "sets")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` that are links: 100 * intersection >= 75 * union, on full sets."""
    if pairs.isEmpty():
        return pairs
    sets = _sets_of(pairs.select(F.col("a").alias("_w")).unionByName(pairs.select(F.col("b").alias("_w"))), reps, docs)
    a = sets.select(F.col("cid").alias("a"), F.col("items").alias("x"))
    b = sets.select(F.col("cid").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - both
    links = scratch.save(pairs.join(a, "a").join(b, "b").filter(both * 100 >= union * PERCENT).select("a", "b"), "verified")
    scratch.drop(sets)
    return links


class _Cell:
    """Members of a pair of blocks of a bucket (``side`` 0 and 1; with ``own`` the two are one block)."""

    def __init__(self, table: pa.Table):
        self.cid, self.comp, self.n = (table[c].to_numpy() for c in ("cid", "comp", "n"))
        self.bands = np.concatenate([c.flatten().to_numpy() for c in table["bands"].chunks]).reshape(len(self.cid), BANDS)
        self.slots, self.band = np.ascontiguousarray(self.bands).view(np.uint16), table["band"][0].as_py()
        side, self.own = table["side"].to_numpy(), table["own"][0].as_py()
        self.left, self.right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)

    def partners(self) -> Iterator[tuple[int, np.ndarray]]:
        """(member, members of other components that may be similar), each pair once in the whole operator."""
        for i in self.left:
            j = self.left[self.left > i] if self.own else self.right
            j = j[(self.comp[j] != self.comp[i]) & (100 * np.minimum(self.n[j], self.n[i]) >= PERCENT * np.maximum(self.n[j], self.n[i]))]
            j = j[~(self.bands[j, : self.band] == self.bands[i, : self.band]).any(axis=1)]
            j = j[(self.slots[j] == self.slots[i]).mean(axis=1) >= MAYBE]
            if len(j):
                yield i, j


def _active(table: pa.Table) -> pa.Table:
    """The members that have a partner."""
    cell, found = _Cell(table), set()
    for i, j in cell.partners():
        found.add(int(i))
        found.update(j.tolist())
    return table.take(pa.array(sorted(found), pa.int64())).drop_columns(["n", "comp", "bands"])


def _links(table: pa.Table) -> pa.Table:
    """Links between components, verified on full sets; pairs that earlier links of this task join are passed over."""
    cell = _Cell(table)
    items = [c.values.to_numpy()[c.offsets[k].as_py() : c.offsets[k + 1].as_py()] for c in table["items"].chunks for k in range(len(c))]
    parent = {int(c): int(c) for c in cell.comp}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = []
    for i, j in cell.partners():
        j = [k for k in j if root(int(cell.comp[k])) != root(int(cell.comp[i]))]
        if not j:
            continue
        own, flat = items[i], np.concatenate([items[k] for k in j])
        own = np.sort(own)
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        both = np.add.reduceat(hit, np.cumsum([0, *(len(items[k]) for k in j[:-1])]), dtype=np.int64)
        for k, n in zip(j, both, strict=True):
            if 100 * n >= PERCENT * (len(own) + len(items[k]) - n):
                x, y = root(int(cell.comp[i])), root(int(cell.comp[k]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((min(cell.cid[i], cell.cid[k]), max(cell.cid[i], cell.cid[k])))
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _dealt(members: DataFrame, known: DataFrame) -> DataFrame:
    """Members of open buckets, once for each pair of blocks that they are in: ``bucket, lo, hi, side, own, ...``.

    A bucket's largest component has blocks of its own, which never meet each other; those of the others meet each
    other and all of its. So a bucket gives rows in proportion to its members where few are outside that component.
    """
    placed = members.join(known.select("cid", "comp"), "cid")
    of = placed.groupBy("bucket", "comp").agg(F.count("*").alias("m"))
    largest = of.groupBy("bucket").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("members")).filter("members > top.m")
    largest = scratch.save(largest.select("bucket", F.col("top.comp").alias("top"), "members", F.ceil((F.col("members") - F.col("top.m")) / BLOCK).cast("int").alias("few"), F.ceil(F.col("top.m") / BLOCK).cast("int").alias("many")), "open")
    rest = scratch.join_keyed(placed, largest, "bucket", "members")
    own = F.col("comp") == F.col("top")
    rest = rest.withColumn("block", F.when(own, F.col("few")).otherwise(0) + F.pmod(F.xxhash64("cid", F.lit(1)), F.when(own, F.col("many")).otherwise(F.col("few"))).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("few") - 1 + F.when(own, 0).otherwise(F.col("many")))))
    order = [F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).cast("int").alias("side"), (F.col("block") == F.col("other")).alias("own")]
    return rest.select("bucket", "band", *order, "cid", "comp", "n")


def _across(members: DataFrame, reps: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Links ``a, b`` between members of a bucket that are in different components; None if no pair may be one."""
    known = scratch.save(reps.join(found, F.col("cid") == F.col("id"), "left").select("cid", F.coalesce("component", "cid").alias("comp"), "bands"), "known")
    bands = known.select(F.col("cid").alias("_c"), "bands")
    dealt = _dealt(members.select("bucket", "band", "cid", "n"), known).join(bands, F.col("cid") == F.col("_c")).drop("_c")
    active = scratch.save(dealt.groupBy("bucket", "lo", "hi").applyInArrow(_active, "bucket long, band int, lo int, hi int, side int, own boolean, cid long"), "active")
    links = None
    if not active.isEmpty():
        sets = _sets_of(active.select(F.col("cid").alias("_w")), reps, docs)
        full = active.join(known.withColumnRenamed("cid", "_c"), F.col("cid") == F.col("_c")).drop("_c").join(sets.withColumnRenamed("cid", "_s"), F.col("cid") == F.col("_s")).drop("_s").withColumn("n", F.size("items").cast("long"))
        links = scratch.save(full.groupBy("bucket", "lo", "hi").applyInArrow(_links, "a long, b long").distinct(), "across")
        scratch.drop(sets)
    scratch.drop(active)
    scratch.drop(known)
    return links


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signed documents, classes of equal sets: ``cid, k1, k2, n, rep, bands``), both saved.

    A class has a number of its own, as its smallest id may be that of another text and class too.
    """
    signed = scratch.save(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sign, SIGNED), "signed")
    some = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = some.groupBy("k1", "k2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep"))
    known = some.select(F.col("doc_id").alias("_d"), F.col("k1").alias("_1"), F.col("k2").alias("_2"), "bands")
    with_bands = reps.join(known, (F.col("rep") == F.col("_d")) & (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2"))).dropDuplicates(["k1", "k2", "n", "rep"])
    return signed, scratch.save(with_bands.select(F.monotonically_increasing_id().alias("cid"), "k1", "k2", "n", "rep", "bands"), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row for each row of ``docs(doc_id, text)``."""
    signed, reps = classes(docs)
    banded = reps.select("cid", "n", F.posexplode("bands").alias("band", "value")).select("cid", "n", "band", F.xxhash64("band", "value").alias("bucket"))
    leaders = scratch.save(banded.groupBy("bucket").agg(F.min(F.struct("cid", "n")).alias("lead"), F.count("*").alias("members")).filter("members > 1"), "leaders")
    members = scratch.save(scratch.join_keyed(banded, leaders, "bucket", "members"), "members")
    near = F.least("n", "lead.n") * 100 >= F.greatest("n", "lead.n") * PERCENT
    stars = scratch.save(members.filter((F.col("cid") > F.col("lead.cid")) & near).select(F.col("lead.cid").alias("a"), F.col("cid").alias("b")).distinct(), "stars")
    links = _verified(stars, reps, docs)
    final = scratch.save(components(links), "components")
    more = _across(members, reps, final, docs)
    if more is not None:
        final = scratch.save(components(links.unionByName(more)), "components")
    for done in (leaders, members, stars):
        scratch.drop(done)

    rooted = reps.join(final, F.col("cid") == F.col("id"), "left").select("k1", "k2", "n", "rep", F.coalesce("component", "cid").alias("root"))
    least = scratch.save(rooted.groupBy("root").agg(F.min("rep").alias("_c"), F.count("*").alias("w")), "least")
    of_class = scratch.join_keyed(rooted, least, "root", "w").select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), F.col("n").alias("_n"), "_c")
    same = (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")) & (F.col("n_shingles") == F.col("_n")) & F.col("doc_id").isNotNull()
    out = signed.join(of_class, same, "left").withColumn("component_id", F.coalesce("_c", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of rows: that with the smallest id (null after all others), and of equal
    ids any one. Where ids repeat or are null, rows are numbered and their numbers take the place of ids."""
    again = docs.groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.count("*").alias("_rows")).filter("_doc IS NULL OR _rows > 1")
    if again.isEmpty():
        gone = near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias("_gone"))
        return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    at = "_at" + "_" * max(len(c) for c in docs.columns)  # no column's name
    numbered = scratch.save(docs.withColumn(at, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered.select(F.col(at).alias("doc_id"), "text")).select(F.col("doc_id").alias(at), F.col("component_id").alias("_c"))
    ids = numbered.select(at, F.col("doc_id").cast("long").alias("_doc"))
    least = F.min(F.struct(F.col("_doc").isNull(), "_doc", at)).alias("_first")
    first = ids.join(found, at).groupBy("_c").agg(least).select(F.col("_first")[at].alias(at))
    return numbered.join(first, at, "left_semi").select(*docs.columns)
