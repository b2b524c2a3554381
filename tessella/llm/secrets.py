"""Secret scans with multipart credential linking, in DataFrame operations only.

Base spans: ``assign`` (a named value), ``access`` (a key id), ``hex`` (a long hex run). The method adds weak parts:
``ident`` (a named account), ``key`` (an opaque run of 40+ characters with upper and lower case letters and digits) and
``endpoint`` (an address with a scheme). A weak part counts for nothing by itself. It is reported only where its
complements are in scope, that is at most SCOPE characters away in the same text: an ident needs a secret (assign, hex
or key), a key needs an identifier (access or ident), an endpoint needs both.

The link is an interval join: parts are dealt to bins of SCOPE characters by row and bin, complements are summed up to
the first start and the last end of each class in a bin (which decide whether any is in reach), and every weak part
looks into the bins it covers and one on each side. So a text with many parts gives rows in proportion to them.

Positions are code points, ends exclusive. A match's place follows from the lengths of matches and of the pieces
between them, which one regular expression gives as two arrays.

Defined cases: a null or empty text has no spans; rows that repeat an id are scanned alike, each for itself; columns
other than doc_id and text are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import scratch

# The patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENT = r"""(?i)(client_id|access_key_id|access_key|account|username|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]+)"""
KEY = r"[A-Za-z0-9+/]{40,}"
ENDPOINT = r"""(https?|ftp|jdbc|postgres|mysql|mongodb|redis|amqp|ssh)://[^\x20\x09-\x0D"'<>]+"""
MIN_VALUE, MIN_IDENT = 6, 4
KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
SCOPE = 200
EMPTY = "array<struct<start:int,kind:int,end:int>>"


def _places(text: Column, pattern: str, kind: int, good=None, group: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches for which ``good(group's text)`` holds."""
    parts = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.split(text, pattern, -1).alias("g"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"),
    )
    parts = F.filter(parts, lambda x: x["m"].isNotNull())

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        own = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), (F.concat(s["out"], own) if good is None else F.when(good(x["v"]), F.concat(s["out"], own)).otherwise(s["out"])).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(EMPTY).alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(parts, zero, step, lambda s: s["out"])).otherwise(F.array().cast(EMPTY))


def _mixed(v: Column) -> Column:
    return v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def _found(docs: DataFrame, scope: int) -> DataFrame:
    """``doc_id, text_key, assign, access, hex, linked``: spans as arrays, one row for each row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parsed = docs.select(
        F.col("doc_id"),
        F.xxhash64(text).alias("text_key"),
        _places(text, ASSIGN, 0, lambda v: F.length(v) >= MIN_VALUE, 2).alias("assign"),
        _places(text, ACCESS, 1).alias("access"),
        _places(text, HEX, 2).alias("hex"),
        F.concat(_places(text, IDENT, 3, lambda v: F.length(v) >= MIN_IDENT, 2), _places(text, KEY, 4, _mixed), _places(text, ENDPOINT, 5)).alias("weak"),
    )
    parsed = scratch.save(parsed.withColumn("row", F.monotonically_increasing_id()), "parsed")

    bin_of = lambda p: F.floor(p / scope).cast("int")
    some = parsed.filter(F.size("weak") > 0)
    part = some.select("row", F.explode(F.concat("assign", "access", "hex", "weak")).alias("p")).select("row", "p.*")
    part = part.withColumn("class", F.when(F.col("kind").isin(0, 2, 4), "s").when(F.col("kind").isin(1, 3), "i"))
    dealt = part.filter("class IS NOT NULL").withColumn("bin", F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.col("end") - 1))))
    ends = [f(F.when(F.col("class") == c, F.col(p))).alias(f"{c}_{p}") for c in "si" for f, p in ((F.min, "start"), (F.max, "end"))]
    near = dealt.groupBy("row", "bin").agg(*ends)
    weak = part.filter("kind >= 3").withColumn("bin", F.explode(F.sequence(bin_of(F.col("start")) - 1, bin_of(F.col("end") - 1) + 1)))
    reach = lambda c: F.coalesce((F.col(f"{c}_start") - F.col("w.end") <= scope) & (F.col("w.start") - F.col(f"{c}_end") <= scope), F.lit(False))
    joined = weak.alias("w").join(near.alias("n"), (F.col("w.row") == F.col("n.row")) & (F.col("w.bin") == F.col("n.bin")))
    seen = joined.groupBy("w.row", "w.start", "w.kind", "w.end").agg(F.max(reach("s")).alias("secret"), F.max(reach("i")).alias("identifier"))
    linked = seen.filter(((F.col("kind") == 3) & F.col("secret")) | ((F.col("kind") == 4) & F.col("identifier")) | ((F.col("kind") == 5) & F.col("secret") & F.col("identifier")))
    linked = linked.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))

    out = parsed.join(linked, F.col("row") == F.col("_row"), "left")
    return out.select("doc_id", "text_key", "assign", "access", "hex", F.coalesce(F.col("linked"), F.array().cast(EMPTY)).alias("linked"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked``, one row for each row of ``docs``."""
    base = F.concat("assign", "access", "hex")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    digest = F.sha2(_joined(base).cast("binary"), 256)
    return _found(docs, scope).select("doc_id", *counts, digest.alias("base_sha256"), _joined(F.concat(base, "linked")).alias("spans"), F.size("linked").cast("long").alias("n_linked"))


def without_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` with every base span and every linked part replaced by ``[secret]``, and n_chars, if there, set anew.

    All rows and other columns stay. Spans are found once and come back by id and text.
    """
    every = F.concat("assign", "access", "hex", "linked")
    found = _found(docs, scope).filter(F.size(every) > 0).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.first(F.array_sort(every)).alias("_spans"))
    found = scratch.save(found, "spans")
    text = docs["text"]

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(fresh, F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("[secret]"))).otherwise(s["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(found["_spans"], zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(F.coalesce(text, F.lit(""))) == found["_key"]), "left")
    columns = {c: docs[c] for c in docs.columns}
    columns["text"] = F.when(found["_spans"].isNull(), text).otherwise(clean)
    if "n_chars" in columns:
        columns["n_chars"] = F.when(found["_spans"].isNull(), docs["n_chars"]).otherwise(F.length(clean)).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[v.alias(c) for c, v in columns.items()])


def sql(documents: str = "documents", scope: int = SCOPE) -> str:
    """The same rows in DuckDB's SQL. Case folding is spelt out, as that engine also folds letters beyond ASCII."""
    fold = lambda p: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in p)
    tail = r"""["'']?\x20*[:=]\x20*["'']?"""
    assign = "(" + "|".join(fold(w) for w in ("password", "passwd", "secret", "token")) + "|" + fold("api") + "_?" + fold("key") + ")" + tail + "([A-Za-z0-9+/_.=-]+)"
    ident = "(" + "|".join(fold(w) for w in ("client_id", "access_key_id", "access_key", "account", "username", "user", "login")) + ")" + tail + "([A-Za-z0-9@+/_.-]+)"
    patterns = (assign, ACCESS, HEX, ident, KEY, ENDPOINT.replace("'", "''"))
    good = (f"length(v) >= {MIN_VALUE}", "true", "true", f"length(v) >= {MIN_IDENT}", "regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')", "true")
    parts = "\nUNION ALL ".join(
        f"SELECT row, {k} AS kind, unnest(regexp_extract_all(x, '{p}', 0)) AS m, unnest(regexp_extract_all(x, '{p}', {2 if k in (0, 3) else 0})) AS v, "
        f"unnest(string_split_regex(x, '{p}')[:len(regexp_extract_all(x, '{p}', 0))]) AS g, unnest(range(len(regexp_extract_all(x, '{p}', 0)))) AS i FROM d"
        for k, p in enumerate(patterns)
    )
    checks = " OR ".join(f"(kind = {k} AND {g})" for k, g in enumerate(good))
    near = lambda c, kinds: f"exists(SELECT 1 FROM spans o WHERE o.row = w.row AND o.kind IN ({kinds}) AND o.s - w.e <= {scope} AND w.s - o.e <= {scope})"
    name = " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(KINDS))
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS x FROM {documents}),
raw AS ({parts}),
placed AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY row, kind ORDER BY i) AS e FROM raw),
spans AS (SELECT row, kind, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed WHERE {checks}),
linked AS (SELECT * FROM spans w WHERE (kind = 3 AND {near("s", "0, 2, 4")}) OR (kind = 4 AND {near("i", "1, 3")}) OR (kind = 5 AND {near("s", "0, 2, 4")} AND {near("i", "1, 3")})),
told AS (SELECT row, kind, s, (CASE kind {name} END) || ':' || s || ':' || e AS t FROM (SELECT * FROM spans WHERE kind < 3 UNION ALL SELECT * FROM linked)),
per AS (SELECT row, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, count(*) FILTER (kind > 2) AS n3,
  string_agg(t, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(t, ',' ORDER BY s, kind) AS everything FROM told GROUP BY row)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(everything, '') AS spans, coalesce(n3, 0) AS n_linked FROM d LEFT JOIN per USING (row)"""
