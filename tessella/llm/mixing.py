"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target is its share of all words, at most ``max_epochs`` times its own words; the excess goes to the other
sources by weight. Within a source a document's expected copies fall with its length, halving with every fourfold of its
words (by powers of four), so that a few very long documents do not fill a source; they are at most ``max_epochs``, and
the source's level makes the expected words meet the target. Whole expected copies are certain. What is left of them is
the document's inclusion probability in a sample without replacement: it draws a uniform number from its id's digest and
gets the rank ``odds(u) / odds(inclusion)``; documents of a source are taken by rank, whatever their length, until the
words are used up.

The cut is found without ordering a whole source: ranks fall into bins of about ``BIN`` documents, sums of bins show
the bin in which the target ends, and only its documents are ordered. There the documents that no longer fit are
passed over twice, so that one very long document at the cut does not leave a gap of its own length. Rows with equal id,
source and size draw equal numbers; at the cut they are one unit, of which as many rows are taken as fit.

Defined cases: a null text has size 0; a null source is a source, the last one; a document of size 0 is taken with
0 words; an empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BIN = 1024
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """In (0, 1), from 52 bits of an MD5 digest: the same on every run and on every engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, n_docs, target`` of ``sized(source, size)``. One row a source, so its windows are small.

    With sources ordered by cap / weight, those to be capped come first: a source is capped if its cap is below its
    share of what the capped ones before it leave.
    """
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    own = own.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place + 1).cast("int")))
    own = own.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    everything, before = W.partitionBy(), W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything)).withColumn("all_w", F.sum("w").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    own = own.withColumn("capped", F.col("cap") / F.col("w") < level)
    kept = lambda c: F.sum(F.when(F.col("capped"), F.col(c)).otherwise(0.0)).over(everything)
    own = own.withColumn("level", F.try_divide(F.col("total") - kept("cap"), F.col("all_w") - kept("w")))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w")))
    return own.select("source", "source_size", "n_docs", F.coalesce(target, F.lit(0.0)).alias("target"))


def _step(size: Column) -> Column:
    """0 for sizes below 4, 1 below 16, 2 below 64 and so on."""
    return F.floor((F.length(F.bin(size)) - 1) / 2).cast("int")


def _classes(sized: DataFrame, targets: DataFrame, max_epochs: int) -> DataFrame:
    """``c_source, c_step, source_size, target, n_docs, whole, chance, rest``: a row for each class of sizes of a source.

    Shorter classes expect more copies, so those that reach ``max_epochs`` come first, as sources do among targets.
    """
    own = sized.groupBy("source", _step(F.col("size")).alias("step")).agg(F.sum("size").alias("words")).join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    own = own.withColumn("g", F.pow(F.lit(2.0), -F.col("step"))).withColumn("gw", F.col("g") * F.col("words"))
    w = W.partitionBy("source")
    before, on = w.orderBy("step").rowsBetween(W.unboundedPreceding, -1), w.orderBy("step").rowsBetween(0, W.unboundedFollowing)
    cap = float(max_epochs)
    level = F.try_divide(F.col("target") - cap * F.coalesce(F.sum("words").over(before), F.lit(0)), F.sum("gw").over(on))
    own = own.withColumn("full", F.coalesce(level * F.col("g") >= cap, F.lit(False)))
    part = lambda c, full: F.sum(F.when(F.col("full") == full, F.col(c)).otherwise(F.lit(0))).over(w)
    own = own.withColumn("level", F.try_divide(F.col("target") - cap * part("words", True), part("gw", False)))
    copies = F.when(F.col("full"), cap).otherwise(F.least(F.lit(cap), F.greatest(F.lit(0.0), F.coalesce(F.col("level") * F.col("g"), F.lit(0.0)))))
    own = own.withColumn("copies", copies).withColumn("whole", F.floor("copies").cast("int")).withColumn("chance", F.col("copies") - F.col("whole"))
    own = own.withColumn("rest", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(w))
    return own.select(F.col("source").alias("c_source"), F.col("step").alias("c_step"), "source_size", "target", "n_docs", "whole", "chance", "rest")


def _ranked(rows: DataFrame, classes: DataFrame, seed: str) -> DataFrame:
    """``rows(doc_id, source, size)`` with their class's columns, ``rank`` and ``bin``; both null where nothing is drawn."""
    rows = rows.join(classes, F.col("source").eqNullSafe(F.col("c_source")) & (_step(F.col("size")) == F.col("c_step"))).drop("c_source", "c_step")
    odds = lambda x: x / (1.0 - x)
    rows = rows.withColumn("rank", F.when((F.col("chance") > 0) & (F.col("rest") > 0), odds(uniform(F.col("doc_id"), seed)) / odds(F.col("chance"))))
    return rows.withColumn("bin", F.floor(F.col("rank") / (1.0 + F.col("rank")) * F.ceil(F.col("n_docs") / float(BIN))))


def _cut_units(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``c_source, c_bin``: where each source's words end; ``u_source, u_rank, u_doc, u_size, m, took`` of those bins)."""
    bins = ranked.filter("bin IS NOT NULL").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    up_to = F.sum("words").over(W.partitionBy("source").orderBy("bin"))
    cut = bins.withColumn("up_to", up_to).filter(F.col("up_to") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bin", (F.col("up_to") - F.col("words")).alias("below"))).alias("c"))
    cut = scratch.broadcast_if_small(scratch.save(cut.select(F.col("source").alias("c_source"), F.col("c.bin").alias("c_bin"), F.col("c.below").alias("below")), "cut"))
    here = ranked.join(cut, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bin") == F.col("c_bin")))
    units = here.groupBy("source", "rank", "doc_id", "size").agg(F.count("*").alias("m"), F.max(F.col("rest") - F.col("below")).alias("gap"))
    units = units.withColumn("took", F.lit(0).cast("long"))
    source = W.partitionBy("source")
    order = source.orderBy("rank", "doc_id", "size")
    for _ in range(3):
        fits = (F.col("took") == 0) & (F.col("size") * F.col("m") <= F.col("gap"))
        units = units.withColumn("sum", F.sum(F.when(fits, F.col("size") * F.col("m")).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
        units = units.withColumn("now", fits & (F.col("sum") <= F.col("gap")))
        units = units.withColumn("gap", F.col("gap") - F.sum(F.when(F.col("now"), F.col("size") * F.col("m")).otherwise(0)).over(source))
        units = units.withColumn("took", F.when(F.col("now"), F.col("m")).otherwise(F.col("took")))
    some = (F.col("took") == 0) & (F.col("m") > 1) & (F.col("size") > 0) & (F.col("size") <= F.col("gap"))
    units = units.withColumn("nth", F.sum(F.when(some, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    took = F.when(some & (F.col("nth") == 1), F.floor(F.col("gap") / F.col("size")).cast("long")).otherwise(F.col("took"))
    units = units.select(F.col("source").alias("u_source"), F.col("rank").alias("u_rank"), F.col("doc_id").alias("u_doc"), F.col("size").alias("u_size"), "m", took.alias("took"))
    return cut.select("c_source", "c_bin"), scratch.save(units, "units")


def _some_of(rows: DataFrame, spread: int = 256) -> DataFrame:
    """``extra`` for rows of units of which a part is taken, without bringing a unit to one task: its rows are dealt to
    ``spread`` shares, and a share's quota is what the shares before it leave."""
    rows = scratch.save(rows.withColumn("_r", F.monotonically_increasing_id()), "partly")
    unit = ["u_source", "u_rank", "u_doc", "u_size"]
    rows = rows.withColumn("_share", F.pmod(F.xxhash64("_r"), F.lit(spread)).cast("int"))
    shares = rows.groupBy(*unit, "_share").agg(F.count("*").alias("_n"), F.max("took").alias("_took"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*unit).orderBy("_share").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shares = shares.select(*[F.col(c).alias(f"_{c}") for c in (*unit, "_share")], (F.col("_took") - before).alias("_quota"))
    same = F.lit(True)
    for c in (*unit, "_share"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    nth = F.row_number().over(W.partitionBy(*unit, "_share").orderBy("_r"))
    out = rows.withColumn("_nth", nth).join(shares, same)
    return out.withColumn("extra", F.when(F.col("_nth") <= F.col("_quota"), 1).otherwise(0)).drop("_r", "_nth", "_quota", "_share", *[f"_{c}" for c in (*unit, "_share")])


def _decided(rows: DataFrame, weights, max_epochs: int, seed: str) -> DataFrame:
    """``rows(doc_id, source, size, ...)`` with ``source_size, target, copies``. Only narrow tables are shuffled."""
    sized = scratch.save(rows.select("doc_id", "source", "size"), "sized")
    rows = sized if rows.columns == sized.columns else rows
    targets = scratch.broadcast_if_small(scratch.save(source_targets(sized, weights, max_epochs), "targets"))
    classes = scratch.broadcast_if_small(scratch.save(_classes(sized, targets, max_epochs), "classes"))
    cut, units = _cut_units(_ranked(sized, classes, seed))
    out = _ranked(rows, classes, seed).join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source")
    mine = (F.col("source").eqNullSafe(F.col("u_source"))) & (F.col("rank") == F.col("u_rank")) & (F.col("doc_id").eqNullSafe(F.col("u_doc"))) & (F.col("size") == F.col("u_size"))
    out = out.join(scratch.broadcast_if_small(units), mine, "left")
    extra = F.when(F.col("bin").isNull(), 0).when(F.col("c_bin").isNull() | (F.col("bin") < F.col("c_bin")), 1).when(F.col("bin") > F.col("c_bin"), 0).otherwise((F.col("took") == F.col("m")).cast("int"))
    out = out.withColumn("extra", extra)
    if not units.filter("took > 0 AND took < m").isEmpty():
        partly = F.coalesce((F.col("took") > 0) & (F.col("took") < F.col("m")), F.lit(False))
        out = out.filter(~partly).unionByName(_some_of(out.filter(partly).drop("extra")))
    return out.withColumn("copies", (F.col("whole") + F.col("extra")).cast("int"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source, copies``, one row for each row of ``docs``."""
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    out = _decided(rows, weights, max_epochs, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies")


def apply_mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as it is taken. Texts stay where they are."""
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.struct(*docs.columns).alias("_row"))
    out = _decided(rows, weights, max_epochs, seed).filter("copies > 0")
    return out.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_copy")).select("_row.*")


def sql(documents: str = "documents") -> str:
    """The same rows in DuckDB's SQL, over any relation with doc_id, text and source."""
    weight = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(WEIGHTS))
    cap, order = float(MAX_EPOCHS), "PARTITION BY source ORDER BY rank, doc_id NULLS FIRST, size"
    passes = ""
    for i in range(3):
        fits = "took = 0 AND size * m <= gap"
        passes += f""",
f{i} AS (SELECT *, sum(CASE WHEN {fits} THEN size * m ELSE 0 END) OVER ({order} ROWS UNBOUNDED PRECEDING) AS s FROM e{i}),
g{i} AS (SELECT *, ({fits} AND s <= gap) AS now FROM f{i}),
e{i + 1} AS (SELECT source, rank, doc_id, size, m, gap - sum(CASE WHEN now THEN size * m ELSE 0 END) OVER (PARTITION BY source) AS gap, CASE WHEN now THEN m ELSE took END AS took FROM g{i})"""
    some = "took = 0 AND m > 1 AND size > 0 AND size <= gap"
    return rf"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM {documents}),
own AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs, CAST(sum(size) * {MAX_EPOCHS} AS DOUBLE) AS cap FROM sized GROUP BY source),
w1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {weight} END AS w FROM own),
w2 AS (SELECT *, sum(CAST(source_size AS DOUBLE)) OVER () AS total, sum(w) OVER () AS all_w,
  coalesce(sum(cap) OVER b, 0) AS cap_b, coalesce(sum(w) OVER b, 0) AS w_b FROM w1
  WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w3 AS (SELECT *, cap / w < (total - cap_b) / (all_w - w_b) AS capped FROM w2),
w4 AS (SELECT *, (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / nullif(all_w - sum(CASE WHEN capped THEN w ELSE 0 END) OVER (), 0) AS level FROM w3),
targets AS (SELECT source AS t_source, source_size, n_docs, coalesce(CASE WHEN capped THEN cap ELSE least(cap, level * w) END, 0.0) AS target FROM w4),
c1 AS (SELECT source, (length(bin(size)) - 1) // 2 AS step, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY 1, 2),
c2 AS (SELECT *, pow(2.0, -step) AS g, pow(2.0, -step) * words AS gw FROM c1 JOIN targets ON source IS NOT DISTINCT FROM t_source),
c3 AS (SELECT *, coalesce((target - {cap} * coalesce(sum(words) OVER b, 0)) / nullif(sum(gw) OVER o, 0) * g >= {cap}, false) AS filled FROM c2
  WINDOW b AS (PARTITION BY source ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o AS (PARTITION BY source ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c4 AS (SELECT *, (target - {cap} * sum(CASE WHEN filled THEN words ELSE 0 END) OVER p) / nullif(sum(CASE WHEN filled THEN 0 ELSE gw END) OVER p, 0) AS lv FROM c3 WINDOW p AS (PARTITION BY source)),
c5 AS (SELECT *, CASE WHEN filled THEN {cap} ELSE least({cap}, greatest(0.0, coalesce(lv * g, 0.0))) END AS n FROM c4),
classes AS (SELECT source AS c_source, step AS c_step, source_size, n_docs, target, CAST(floor(n) AS INTEGER) AS whole, n - floor(n) AS chance, target - sum(floor(n) * words) OVER (PARTITION BY source) AS rest FROM c5),
r1 AS (SELECT doc_id, source, size, source_size, n_docs, target, whole, chance, rest, (CAST(CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / {float(2**52)} AS u
  FROM sized JOIN classes ON source IS NOT DISTINCT FROM c_source AND (length(bin(size)) - 1) // 2 = c_step),
r3 AS (SELECT *, CASE WHEN chance > 0 AND rest > 0 THEN (u / (1.0 - u)) / (chance / (1.0 - chance)) END AS rank FROM r1),
r4 AS (SELECT *, CAST(floor(rank / (1.0 + rank) * ceil(n_docs / {float(BIN)})) AS BIGINT) AS bin FROM r3),
b1 AS (SELECT source, bin, sum(size) AS words, max(rest) AS rest FROM r4 WHERE bin IS NOT NULL GROUP BY source, bin),
b2 AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY bin) AS up_to FROM b1),
b3 AS (SELECT source AS c_source, bin AS c_bin, up_to - words AS below, row_number() OVER (PARTITION BY source ORDER BY bin) AS k FROM b2 WHERE up_to > rest),
r5 AS (SELECT r4.*, c_bin, below FROM r4 LEFT JOIN (SELECT * FROM b3 WHERE k = 1) ON source IS NOT DISTINCT FROM c_source),
e0 AS (SELECT source, rank, doc_id, size, count(*) AS m, max(rest - below) AS gap, CAST(0 AS BIGINT) AS took FROM r5 WHERE bin = c_bin GROUP BY 1, 2, 3, 4){passes},
u1 AS (SELECT *, sum(CASE WHEN {some} THEN 1 ELSE 0 END) OVER ({order} ROWS UNBOUNDED PRECEDING) AS nth FROM e3),
units AS (SELECT source AS u_source, rank AS u_rank, doc_id AS u_doc, size AS u_size, CASE WHEN {some} AND nth = 1 THEN CAST(floor(gap / size) AS BIGINT) ELSE took END AS took FROM u1),
r6 AS (SELECT *, row_number() OVER (PARTITION BY source, rank, doc_id, size) AS k FROM r5),
o AS (SELECT r6.*, CASE WHEN bin IS NULL THEN 0 WHEN c_bin IS NULL OR bin < c_bin THEN 1 WHEN bin > c_bin THEN 0 WHEN k <= took THEN 1 ELSE 0 END AS extra
  FROM r6 LEFT JOIN units ON source IS NOT DISTINCT FROM u_source AND rank = u_rank AND doc_id IS NOT DISTINCT FROM u_doc AND size = u_size)
SELECT doc_id, size, source_size, target, CAST(size * (whole + extra) AS BIGINT) AS taken, source, CAST(whole + extra AS INTEGER) AS copies FROM o"""
