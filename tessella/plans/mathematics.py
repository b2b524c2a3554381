"""Answer normalisation and graders, over texts that meet each of their rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import scoring as S
from tessella.functions import texts as T
from tessella.functions.symbolic import graded_equal
from tessella.session import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: Answers that meet the rules of normalisation one by one; @ stands for a number.
ANSWERS = (
    *(f"@ {w}" if w[:1].isalpha() else f"@{w}" for w in S.REMOVED),
    "x = @", "an @", "a @", "@.$", "\\$@", "\\ @", "mbox{@}", "1,\\text{and}@", "1\\text{and}@", "@\\text{m}", "$@$", "so $x=@$ here", "it is $@$ now", "\\text{ab @}", "\\textbf{@}",
    "\\overline{@}", "\\boxed{\\frac{@}{2}}", "\\frac1@", "\\frac{1}{@}", "\\frac12", "\\sqrt3", "\\sqrt34@", "\\sqrt{@}", "1,234,@", "(1,@)", " @\t", "-@", "@,5 hours", "",
)


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def answers(spark, d):
    text = F.element_at(F.array(*[F.lit(a) for a in ANSWERS]), (F.col("o_orderkey") % len(ANSWERS) + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.replace(text, F.lit("@"), F.col("o_custkey").cast("string")).alias("x"))


RAW = f"a AS (SELECT o_orderkey, replace([{', '.join(map(quoted, ANSWERS))}][CAST(o_orderkey % {len(ANSWERS)} + 1 AS INTEGER)], '@', CAST(o_custkey AS VARCHAR)) AS x FROM orders)"


def normal_sql(x: str) -> str:
    x = f"string_split({x}, '=')[-1]"
    for old, new in (*S.SUBSTITUTIONS, *((w, "") for w in S.REMOVED)):
        x = f"replace({x}, {quoted(old)}, {quoted(new)})"
    for pattern, new in S.TEX:
        new = "".join(f"\\{c}" if c.isdigit() else c for c in new.replace("\\$", "\0").replace("$", "")).replace("\0", "$")
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(new)}, 'g')"
    return f"replace({x}, '$', '')"


NORMAL = rf"{RAW}, b AS (SELECT *, {normal_sql('x')} AS y FROM a), n AS (SELECT o_orderkey, x, regexp_replace(CASE WHEN regexp_full_match(replace(y, ',', ''), '[0-9]+') THEN replace(y, ',', '') ELSE y END, '^\s+|\s+$', '', 'g') AS answer FROM b)"


@query("x07_minerva_normal", f"WITH {NORMAL} SELECT o_orderkey, answer FROM n")
def x07(spark, d):
    return answers(spark, d).select("o_orderkey", S.minerva_normal(F.col("x")).alias("answer"))


@query("n13_dapo_score", rf"WITH {NORMAL}, t AS (SELECT *, right('Answer: 0' || chr(10) || 'answer : ' || x, 300) AS said FROM n) SELECT o_orderkey, CASE WHEN regexp_matches(said, '(?i)answer\s*:\s*[^\n]+$') AND answer = CAST(o_orderkey AS VARCHAR) THEN 1.0 WHEN x = '' AND o_orderkey = 0 THEN 1.0 ELSE -1.0 END AS score FROM t")
def n13(spark, d):
    said = F.concat(F.lit("Answer: 0\nanswer : "), F.col("x"))
    return answers(spark, d).select("o_orderkey", S.dapo_score(said, F.col("o_orderkey").cast("string")).alias("score"))


TRUTH = "CAST(o_custkey AS VARCHAR)"
#: Endings of responses, and the answer that a strict reading finds in each; null for none.
BOXES = "CASE o_orderkey % 5 WHEN 0 THEN 'so \\boxed{' || o_custkey || '}' WHEN 1 THEN 'so \\boxed{' || o_custkey || '} and then ' || repeat('x', 100) WHEN 2 THEN '\\boxed{1} or \\boxed{\\frac{' || o_custkey || '}{2}}.' WHEN 3 THEN 'open \\boxed{' || o_custkey ELSE 'none ' || o_custkey END"
FOUND = f"CASE o_orderkey % 5 WHEN 0 THEN {TRUTH} WHEN 2 THEN '\\frac{{' || o_custkey || '}}{{2}}' END"


def boxes(spark, d):
    n = F.col("o_custkey").cast("string")
    said = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, said("so \\boxed{", n, "}")).when(k == 1, said("so \\boxed{", n, "} and then " + "x" * 100)).when(k == 2, said("\\boxed{1} or \\boxed{\\frac{", n, "}{2}}.")).when(k == 3, said("open \\boxed{", n)).otherwise(said("none ", n))
    return table(spark, d, "orders").select("o_orderkey", n.alias("truth"), text.alias("x"))


@query("x09_strict_box", f"SELECT o_orderkey, {FOUND} AS answer, CASE WHEN {FOUND} = {TRUTH} THEN 1.0 ELSE -1.0 END AS score FROM orders")
def x09(spark, d):
    return boxes(spark, d).select("o_orderkey", S.strict_box(F.col("x")).alias("answer"), S.strict_box_score(F.col("x"), F.col("truth")).alias("score"))


@query("x10_math_feedback", f"""WITH b AS (SELECT o_orderkey, o_orderkey % 7 = 0 AS cut, {TRUTH} AS truth, right({BOXES}, 100) AS x, {FOUND} AS found FROM orders),
p AS (SELECT *, CASE WHEN contains(x, '\\boxed{{') THEN coalesce(found, '') END AS pred FROM b), q AS (SELECT *, coalesce(pred, '') = '' AS bad, coalesce(pred = truth, false) AS ok FROM p)
SELECT o_orderkey, CASE WHEN ok THEN 1.0 ELSE 0.0 END AS score, pred, CAST(bad AS INTEGER) AS incorrect_format, CAST(bad AND cut AS INTEGER) AS truncated_and_missing_answer,
CASE WHEN bad AND NOT cut THEN 'format' WHEN cut THEN 'truncated' WHEN NOT ok THEN 'incorrect' ELSE '' END AS told FROM q""")
def x10(spark, d):
    s = S.math_feedback(F.col("x"), F.col("truth"), F.col("o_orderkey") % 7 == 0, tell_answer=True)
    told = F.regexp_extract("s.feedback", "(format|truncated|incorrect)", 1)
    return boxes(spark, d).withColumn("s", s).select("o_orderkey", "s.score", "s.pred", "s.incorrect_format", "s.truncated_and_missing_answer", told.alias("told"))


@query("x05_remove_boxed", f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN {TRUTH} WHEN o_orderkey % 3 = 1 THEN '{{' || o_custkey || '}}' END AS inner_text FROM orders")
def x05(spark, d):
    n = F.col("o_custkey").cast("string")
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.concat(F.lit("\\boxed{"), n, F.lit("}"))).when(k == 1, F.concat(F.lit("\\boxed{{"), n, F.lit("}}"))).otherwise(F.concat(F.lit("so \\boxed{"), n, F.lit("}")))
    return table(spark, d, "orders").select("o_orderkey", S.remove_boxed(text).alias("inner_text"))


@query("x17_answers_equal", """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey AS a, l_suppkey AS b, l_quantity AS q, l_linenumber % 8 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, a, b, q, CASE k WHEN 0 THEN a = b OR abs(a - b) <= 1e-4 * greatest(a, b) OR abs(a - b * 100) <= 1e-4 * greatest(a, b * 100) OR abs(a - b / 100) <= 1e-4 * greatest(a, b / 100)
  WHEN 1 THEN true WHEN 2 THEN a % 10 = b % 10 OR (a % 10 = 0 AND b % 10 = 0) WHEN 3 THEN true WHEN 4 THEN a % 2 = b % 2 WHEN 5 THEN true WHEN 6 THEN false ELSE q = 7 END AS same FROM p""")
def x17(spark, d):
    n = lambda c: F.col(c).cast("string")
    said = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    k, rest = F.col("l_linenumber") % 8, lambda c, m: (F.col(c) % m).cast("string")
    first = F.when(k == 0, n("a")).when(k == 1, said(n("a"), "%")).when(k == 2, said("(1, ", rest("a", 10), ")")).when(k == 3, said("[", n("a"), "]")).when(k == 4, said("x, ", rest("a", 2))).when(k == 5, said("A ", n("a"))).when(k == 6, said("(", n("a"), ", 2)")).otherwise(F.col("q").cast("int").cast("string"))
    second = F.when(k == 0, n("b")).when(k == 1, (F.col("a") / 100).cast("string")).when(k == 2, said("(1.00001,", rest("b", 10), ")")).when(k == 3, said("{", n("a"), "}")).when(k == 4, said(" X ,", rest("b", 2))).when(k == 5, said("A", n("a"))).when(k == 6, said("(", n("a"), ", 2, 3)")).otherwise(F.lit("7"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_quantity").alias("q"))
    return rows.select("l_orderkey", "l_linenumber", "a", "b", "q", S.answers_equal(first, second).alias("same"))


@query("n12_math_score", f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 WHEN o_custkey % 10 = 3 THEN 1.0 ELSE 0.0 END AS score FROM orders")
def n12(spark, d):
    n = F.col("o_custkey").cast("string")
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("\\boxed{\\dfrac{"), n, F.lit("}{7}}"))).otherwise(F.concat(F.lit("\\boxed{\\frac3"), (F.col("o_custkey") % 10).cast("string"), F.lit("}")))
    truth = F.when(F.col("o_orderkey") % 2 == 0, F.concat(n, F.lit("/7"))).otherwise("3/3")
    return table(spark, d, "orders").select("o_orderkey", S.math_score(said, truth).alias("score"))


@query("x12_mmlu_choice", "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '' ELSE substr('ABCDEFGHIJ', CAST(n_chars % 10 + 1 AS INTEGER), 1) END AS choice FROM documents")
def x12(spark, d):
    letter = F.substring(F.lit("ABCDEFGHIJ"), (F.col("n_chars") % 10 + 1).cast("int"), F.lit(1))
    k = F.col("doc_id") % 4
    text = F.when(k == 0, F.concat(F.lit("Answer: B, no: the answer is ("), letter, F.lit(")"))).when(k == 1, F.concat(F.lit("Answer: E then answer: "), letter, F.lit(" not K or C"))).when(k == 2, F.concat(F.lit("C or "), letter, F.lit(".?"))).otherwise(F.lit("no idea"))
    return table(spark, d, "documents").select("doc_id", S.mmlu_choice(text).alias("choice"))


@query("x13_gpqa_choice", "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN upper('maybe ' || source) ELSE substr('ABCD', CAST(n_chars % 4 + 1 AS INTEGER), 1) END AS choice FROM documents")
def x13(spark, d):
    letter = F.substring(F.lit("abcd"), (F.col("n_chars") % 4 + 1).cast("int"), F.lit(1))
    k = F.col("doc_id") % 3
    text = F.when(k == 0, F.concat(F.lit("B? no, ("), letter, F.lit(") e"))).when(k == 1, letter).otherwise(F.concat(F.lit(" maybe "), "source", F.lit(" ")))
    return table(spark, d, "documents").select("doc_id", S.gpqa_choice(text).alias("choice"))


@query("x33_docstring", "SELECT item_id, 'Solves task ' || item_id AS text FROM benchmark")
def x33(spark, d):
    source = F.concat(F.lit('def f(x):\n    """Solves task '), F.col("item_id").cast("string"), F.lit('\n    >>> f(1)\n    2\n    """\n    """more"""'))
    return table(spark, d, "benchmark").select("item_id", F.regexp_replace(T.docstring(source), r"\s+$", "").alias("text"))


@query("x41_step_of_path", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id AS INTEGER) END AS step FROM events")
def x41(spark, d):
    path = F.when(F.col("event_id") % 3 == 0, F.lit("/a/latest")).otherwise(F.concat(F.lit("/a/global_step_"), F.col("user_id").cast("string"), F.lit("/actor")))
    return table(spark, d, "events").select("event_id", T.step_of_path(path).alias("step"))


#: Pairs of answers from the numbers of an order, as one expression for Spark and SQL, and whether their values are equal.
N_, M_, OFF = "(o_custkey % 23 + 1)", "(o_orderkey % 17 + 1)", "(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END)"
T_ = lambda x: f"CAST({x} AS STRING)"
BS = "chr(92)"
FORMS = (
    (f"'(x+' || {T_(N_)} || ')(x+' || {T_(M_)} || ')'", f"'x^2+' || {T_(f'({N_} + {M_} + {OFF})')} || 'x+' || {T_(f'({N_} * {M_})')}", f"{OFF} = 0"),
    (f"{BS} || 'frac{{' || {T_(N_)} || '}}{{' || {T_(M_)} || 'y}}'", f"{T_(f'({N_} * 3)')} || '/(' || {T_(f'({M_} * 3 + {OFF})')} || '*y)'", f"{N_} * ({M_} * 3 + {OFF}) = {M_} * ({N_} * 3)"),
    (f"{BS} || 'sqrt{{' || {T_(f'({N_} * {N_} * {M_})')} || '}}'", f"{T_(f'({N_} + {OFF})')} || {BS} || 'sqrt{{' || {T_(M_)} || '}}'", f"{OFF} = 0"),
    (f"{BS} || 'begin{{pmatrix}}' || {T_(N_)} || '&' || {T_(M_)} || {BS} || {BS} || ' 0 & x^2' || {BS} || 'end{{pmatrix}}'", f"'[[' || {T_(f'({N_} + {OFF})')} || ',' || {T_(f'(2 * {M_})')} || '/2],[1-1, x*x]]'", f"{OFF} = 0"),
    (f"'y=' || {T_(N_)} || 'x-' || {T_(M_)}", f"{T_(f'(2 * {N_})')} || 'x-2y=' || {T_(f'(2 * {M_} + {OFF})')}", f"{OFF} = 0"),
    (f"'(' || {T_(N_)} || ', ' || {BS} || 'frac{{1}}{{' || {T_(M_)} || '}}z]'", f"'(' || {T_(f'({N_} + {OFF})')} || '.0,z/' || {T_(M_)} || ']'", f"{OFF} = 0"),
    (f"'(a+' || {T_(N_)} || ')^3'", f"'a^3+' || {T_(f'(3 * {N_})')} || 'a^2+' || {T_(f'(3 * {N_} * {N_})')} || 'a+' || {T_(f'({N_} * {N_} * {N_} + {OFF})')}", f"{OFF} = 0"),
    (f"{BS} || 'sin^2 t+' || {T_(N_)} || '+' || {BS} || 'cos^2 t'", T_(f"({N_} + 1 + {OFF})"), f"{OFF} = 0"),
    (f"'(' || {T_(N_)}", f"'((' || {T_(N_)}", "true"),
    (f"'[' || {T_(N_)} || ',x+'", f"'[' || {T_(M_)} || ',x*'", "false"),
)
FORM = [f"CASE o_orderkey % {len(FORMS)} " + " ".join(f"WHEN {i} THEN {f[at]}" for i, f in enumerate(FORMS)) + " END" for at in range(3)]


@query("x17_symbolic", f"SELECT o_orderkey, {FORM[2]} AS same FROM orders")
def x17_symbolic(spark, d):
    pairs = table(spark, d, "orders").select("o_orderkey", F.expr(FORM[0]).alias("a"), F.expr(FORM[1]).alias("b"))
    return pairs.select("o_orderkey", graded_equal(F.col("a"), F.col("b")).alias("same"))
