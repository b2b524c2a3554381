"""Interaction of text filters: what each filter removes at each place of each order in which they can run.

Every document gets a bit for each filter that it fails. Documents with the same bits of a part are one cell, so at most
32 cells of a part are left, whatever the size of the table. The cells are unpivoted against all orders and steps: a row
for each step says whether the cell fails that step's filter, a running bit-or over the steps before says whether it
failed one of those, and conditional sums of cells give the counts. A window over all orders of a filter gives the
Shapley sum.

Failure conditions of a text (words are maximal runs of characters other than ASCII white space, case-sensitive):

- A: under 200 words.
- B: 100 * distinct words < 50 * words.
- C: 100 * capital letters A-Z > 3 * code points.
- D: holds any of ``#$%&*|``.
- E: identical to the text of a document with a smaller id, anywhere in the table.

E never brings two documents of one text together: copies collapse to a row for each text, part and label before they
meet, with the smallest id and how often it occurs. Texts are compared by their SHA-256.

Defined cases: a null text is empty, and equals an empty one; a null language is the empty part; rows that repeat an id
are documents of their own, and a row is no earlier copy of another one with its id; a document without id is no copy
and has none; a document is good (or toxic) if any of its label rows says 1; label rows without a document count
nowhere; an empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
MIN_WORDS = 200
MIN_DISTINCT_PCT = 50
MAX_CAPITALS_PCT = 3
MARKS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = "\t\n\x0b\x0c\r"


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def text_failures(text: Column) -> Column:
    """The bits of A to D for a text that is not null."""
    words = F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    few = F.element_at(F.transform(sizes, lambda s: F.when(s["n"] < MIN_WORDS, _bit("A")).otherwise(0) + F.when(100 * s["d"] < MIN_DISTINCT_PCT * s["n"], _bit("B")).otherwise(0)), 1)
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    loud = F.when(100 * capitals.cast("long") > MAX_CAPITALS_PCT * F.length(text).cast("long"), _bit("C")).otherwise(0)
    return few + loud + F.when(text.rlike(MARKS), _bit("D")).otherwise(0)


def _labels(labels: DataFrame) -> DataFrame:
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    return labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("l_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: how many documents of a part fail just the filters of ``mask``, and how many of them have a label 1."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text_failures(text).alias("mask"))
    rows = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    rows = rows.join(_labels(labels), F.col("doc_id") == F.col("l_id"), "left")
    known = F.col("doc_id").isNotNull()
    texts = rows.groupBy("digest", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("nameless"),
        F.min(F.when(known, F.struct("doc_id", "n"))).alias("least"),
    )
    first = F.min("least.doc_id").over(W.partitionBy("digest"))
    texts = texts.withColumn("fresh", F.col("nameless") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    split = F.explode(F.array(F.struct("mask", F.col("fresh").alias("n")), F.struct((F.col("mask") + _bit("E")).alias("mask"), (F.col("n") - F.col("fresh")).alias("n"))))
    both = texts.select("part", "good", "toxic", split.alias("c")).filter("c.n > 0")
    total = lambda c: F.sum(F.col("c.n") * F.col(c))
    return both.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), total("good").alias("good"), total("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``."""
    long = cells(docs, labels).withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in ORDERS])))
    long = long.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    long = long.withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    own = F.element_at(F.array(*[F.lit(_bit(f)) for f in FILTERS]), F.expr(f"instr('{FILTERS}', filter)"))
    long = long.withColumn("own", own).withColumn("cell", F.col("mask").bitwiseAND(F.col("own")))
    before = W.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    long = long.withColumn("gone", F.coalesce(F.bit_or("cell").over(before), F.lit(0)) != 0).withColumn("fails", F.col("cell") != 0)
    here = F.col("fails") & ~F.col("gone")
    count = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(F.lit(0))).cast("long")
    out = long.groupBy("part", "filter_order", "step", "filter").agg(
        count(~F.col("fails") & ~F.col("gone")).alias("kept"),
        count(here).alias("removed"),
        count(F.col("fails") & F.col("gone")).alias("redundant"),
        count(F.col("mask") == F.col("own")).alias("unique_fails"),
        count(here, "good").alias("good_lost"),
        count(here, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "filter")))


def sql() -> str:
    """Every document against every order: its step of removal is the first whose filter it fails."""
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '{word}') AS w FROM texts),
least AS (SELECT t, min(doc_id) AS first_id FROM texts GROUP BY t),
flags AS (SELECT doc_id, part, (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '{MARKS}') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > first_id THEN 'E' ELSE '' END) AS bad FROM worded JOIN least USING (t)),
said AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
docs AS (SELECT part, bad, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM flags LEFT JOIN said USING (doc_id)),
one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM one a, one b, one c, one d, one e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step, filter_order[step:step] AS filter, filter_order[1:step - 1] AS earlier FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
seen AS (SELECT part, filter_order, step, filter, bad, good, toxic, contains(bad, filter) AS fails, length(translate(bad, earlier, '')) < length(bad) AS gone FROM docs, steps),
counts AS (SELECT part, filter_order, step, filter,
  count(*) FILTER (NOT fails AND NOT gone) AS kept, count(*) FILTER (fails AND NOT gone) AS removed, count(*) FILTER (fails AND gone) AS redundant,
  count(*) FILTER (bad = filter) AS unique_fails, count(*) FILTER (fails AND NOT gone AND good = 1) AS good_lost, count(*) FILTER (fails AND NOT gone AND toxic = 1) AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM counts"""
