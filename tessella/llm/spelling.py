"""Spelling variants of a corpus, grouped by a symmetric-delete join.

Words are counted over the whole table. Each word emits itself and its distinct single deletions; words that share a key
meet in an equi-join, and a pair is kept if its edit distance is exactly one. A word's form is its near word that occurs
most, if at least twice as often as itself; forms of forms are followed to the root by joins that double the distance
each time.

Two near words share exactly one key, so each link is found once and needs no deduplication: a word and the same word
with one more character share only the shorter one; words that differ in one character share only what is left without
it. A key of k characters has at most 1 + (k + 1) * a words for an alphabet of a characters (here about 90), so the join
has no key whose rows grow with the corpus, and all links are kept.

All joins are sort-merge joins by hint: Spark takes the compressed size of a saved table for its size, and for that of its
deletions too, about ten rows a word, so it would send them through the driver.

Counting is one aggregation with partial sums, so a word that holds a third of all tokens costs each task one row.

Noise: a token whose ``crc32("<doc_id>:<token>")`` is divisible by NOISE loses one character, the same for all rows of
that id; a null id is an empty string there. NOISE None reads texts as they are.

Defined cases: a null or empty text has no words; rows that repeat an id count each for themselves; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"
NOISE = 97
MIN_LENGTH, MIN_COUNT = 5, 3
#: A form occurs at least so many times as often as its variant.
RATIO = 2


def _without(word: Column, i: Column) -> Column:
    """``word`` without its i-th character, from 0."""
    return F.concat(F.substring(word, F.lit(1), i), F.substring(word, i + 2, F.length(word)))


def word_counts(docs: DataFrame, noise: int | None = NOISE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of all words that are long and frequent enough."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= min_length)
    word = F.col("run")
    if noise:
        runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary")))
        word = F.when(F.col("h") % noise == 0, _without(word, (F.col("h") % F.length("run")).cast("int"))).otherwise(word)
    return runs.select(word.alias("word")).filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def deletions(words: DataFrame) -> DataFrame:
    """``key, word, n``: each word with itself and its distinct single deletions."""
    places = F.sequence(F.lit(0), F.length("word") - 1)
    keys = F.array_distinct(F.concat(F.array("word"), F.transform(places, lambda i: _without(F.col("word"), i))))
    return words.select(F.explode(keys).alias("key"), "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: a row for each word and each word at distance one from it."""
    keyed = deletions(words)
    meet = keyed.alias("a").join(keyed.alias("b").hint("merge"), "key").filter(F.col("a.word") != F.col("b.word"))
    meet = meet.filter(F.levenshtein("a.word", "b.word", 1) == 1)
    return meet.select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n`` for all ``words(word, n)``."""
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("near"))).alias("best"))
    out = words.join(best.hint("merge"), "word", "left")
    taken = -F.col("best.rank") >= ratio * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.rank")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form. Forms grow in frequency, so there are no circles, and a chain of k
    forms ends after about log2 k joins."""
    now = scratch.save(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        then = now.select(F.col("word").alias("_via"), F.col("root").alias("_next"))
        moved = scratch.save(now.join(then.hint("merge"), F.col("root") == F.col("_via"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        scratch.drop(now)
        now = moved
        if not moved.filter("moved").limit(1).count():
            return now.select("word", "root")


def variants(docs: DataFrame, noise: int | None = NOISE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: a row for each word."""
    words = scratch.save(word_counts(docs, noise, min_length, min_count), "words")
    formed = scratch.save(forms(words, ratio), "forms")
    scratch.drop(words)
    out = formed.join(roots(formed).hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def sql() -> str:
    """Near words by a hole at the place where they differ; the checksum bit by bit, from its definition."""
    table = "list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    crc = "xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(hx), 2), lambda i: CAST('0x' || hx[i:i + 1] AS BIGINT))), lambda c, b: xor(c >> 8, crc_table[1 + (xor(c, b) & 255)])), 4294967295)"
    return rf"""
WITH RECURSIVE tabled AS MATERIALIZED (SELECT {table} AS crc_table),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
once AS (SELECT doc_id, run, count(*) AS m, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS hx FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS (SELECT run, m, {crc} AS h FROM once, tabled),
read AS (SELECT CASE WHEN h % {NOISE} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, m FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM read WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(m) >= {MIN_COUNT}),
places AS MATERIALIZED (SELECT word, n, unnest(range(length(word))) AS i FROM words),
cut AS MATERIALIZED (SELECT word, n, left(word, i) || substr(word, i + 2) AS less, left(word, i) || '*' || substr(word, i + 2) AS hole FROM places),
shorter AS (SELECT DISTINCT c.word, c.n, w.word AS near, w.n AS near_n FROM cut c JOIN words w ON w.word = c.less),
near AS (SELECT * FROM shorter UNION SELECT near, near_n, word, n FROM shorter
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN cut b ON a.hole = b.hole AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * w.n THEN near END AS form, CASE WHEN near_n >= {RATIO} * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
walk AS (SELECT word, form AS reached FROM formed WHERE form IS NOT NULL UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.reached WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, walk.reached FROM walk JOIN formed f ON f.word = walk.reached WHERE f.form IS NULL)
SELECT formed.word, form, coalesce(reached, formed.word) AS root, n, n_near, form_n FROM formed LEFT JOIN ends ON ends.word = formed.word"""
