"""Symbolic equality against exact polynomial arithmetic, and its rules."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessella.functions import scoring, symbolic


def times(p, q):
    out = {}
    for a, x in p.items():
        for b, y in q.items():
            k = tuple(i + j for i, j in zip(a, b, strict=True))
            out[k] = out.get(k, 0) + x * y
    return {k: v for k, v in out.items() if v}


def plus(p, q):
    out = dict(p)
    for k, v in q.items():
        out[k] = out.get(k, 0) + v
    return {k: v for k, v in out.items() if v}


def shown(p, rng):
    """A polynomial in x and y as LaTeX, its terms and their notation in any order."""
    terms = []
    for (i, j), c in p.items():
        number = str(c) if c.denominator == 1 else rng.choice([rf"\frac{{{c.numerator}}}{{{c.denominator}}}", f"{c.numerator}/{c.denominator}"])
        letters = [f"{v}^{{{n}}}" if n > 1 else v for v, n in (("x", i), ("y", j)) if n]
        rng.shuffle(letters)
        terms.append(rng.choice(["({})", r"\left({}\right)"]).format(number) + rng.choice(["", r"\cdot ", "*"]) .join(["", *letters]))
    rng.shuffle(terms)
    return "+".join(terms) or "0"


def factor(rng):
    p = {(1, 0): Fraction(rng.randint(1, 4), rng.randint(1, 3)), (0, 1): Fraction(rng.randint(-3, 3)), (0, 0): Fraction(rng.randint(-4, 4), rng.randint(1, 2))}
    return {k: v for k, v in p.items() if v}


def test_three_hundred_pairs():
    rng, seen = random.Random(11), [0, 0]
    for _ in range(300):
        f, g, h = factor(rng), factor(rng), factor(rng)
        product = plus(times(f, g), h)
        left = f"({shown(f, rng)})({shown(g, rng)})+{shown(h, rng)}"
        other = plus(product, rng.choice([{}, {}, {(0, 0): Fraction(1, 7)}, {(1, 1): Fraction(1)}, {(2, 0): Fraction(-1, 2)}]))
        assert symbolic.equal(left, shown(other, rng)) is (other == product), (left, other)
        seen[other == product] += 1
    assert min(seen) > 80


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        (r"\frac12", "0.5", True), (r"2\sqrt{2}", r"\sqrt8", True), (r"\sqrt[3]{27}", "3", True), (r"\sin^2 x+\cos^2 x", "1", True), (r"e^{i\pi}", "-1", True), ("3!", "6", True), ("-x^2", "(-x)^2", False),
        (r"\begin{pmatrix}1&2\\3&4\end{pmatrix}", "[[1,2],[3,8/2]]", True), (r"\begin{bmatrix}1&2\end{bmatrix}", r"\begin{bmatrix}1\\2\end{bmatrix}", False), ("y=2x+1", "4x-2y=-2", True), ("y=2x+1", "2x-y=1", False),
        ("y=x", "x", False), ("(1,2]", r"\left(1, \frac{4}{2}\right]", True), ("(1,2)", "[1,2)", False), ("1,2", "2,1", False), (r"\{1,x\}", r"\{1.0,x\}", True), (r"\frac{x^2-1}{x-1}", "x+1", True), ("9^9^9^9", "1", False),
        ("x_1+x_{2}", "x_2+x_1", True), ("1/0", "1/0", False), ("(" * 500, "(" * 500, False), ("1/3", "0.33333", True), ("1/3", "0.333", False), ("x" * 3000, "x" * 3000, False), ("", "", False),
    ],
)
def test_values(a, b, same):
    assert symbolic.equal(a, b) is same and symbolic.equal(b, a) is same


def test_column(spark):
    rows = [("x+x", "2x", True), ("x", "y", False), (None, "x", False), ("1,000", "1000", True)]
    df = spark.createDataFrame(rows, "a string, b string, w boolean")
    assert all(r.w == r.g for r in df.select("w", symbolic.graded_equal(F.col("a"), F.col("b")).alias("g")).collect())


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        (r"\frac1{72}", r"\frac{1}{72}", True), (r"\frac1b", r"\frac{1}{b}", True), (r"\\left(1\right)", "(1)", True), ("5$", "5", False), (r"\frac{72}1", r"\frac{72}{1}", False), ("k = 5", "5", True), (r"3\text{ cm}", "3", True),
        (r"3\text{ a}\text{ b}", "3", False), (".5", r"\frac{1}{2}", True), (r"\sqrt2", r"\sqrt{2}", True), ("-1/2", r"\frac{-1}{2}", True), ("01/2", r"\frac{1}{2}", False), (r"\frac", r"\frac", True), (None, "", False), (None, None, True),
    ],
)
def test_canonical_form(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(scoring.math_equal(F.col("a"), F.col("b")).alias("g")).first().g is same


ONE = '[{"Action": "search", "Action_Input": "{\\"q\\": \\"x\\"}"}]'


@pytest.mark.parametrize(
    ("text", "truth", "score"),
    [
        ('Action: search\nAction Input: {"q": "x"}', ONE, 1.0), ('Action: search\nAction Input: {"q": "wrong"}', ONE, 0.0), ('Action: search\nAction Input: {"q": 1}\nAction Input: {"q": "x"}', ONE, 1.0),
        ('Action: search\nAction Input: {bad}\nAction Input: {"q":"x"}', ONE, 1.0), ("Action: search", ONE, 0.0), ("Action: s", '[{"Action": "s", "Action_Input": "no json"}]', 1.0), ("Action: s", '[{"Action": "s"}]', 1.0),
        ('Action: s\nAction Input: {"a": 1.0}', '[{"Action": "s", "Action_Input": {"a": 1}}]', 1.0), ('Action: s\nAction Input: {"a": "1"}', '[{"Action": "s", "Action_Input": {"a": 1}}]', 0.0), (None, ONE, 0.0), ("Action: s", "oops", 0.0), ("Action: s", None, 0.0),
        ('Action: a\nAction Input: {"x": 1}\nAction: a', '[{"Action": "a", "Action_Input": {"x": 1}}]', 0.0),
    ],
)
def test_tool_use(spark, text, truth, score):
    df = spark.createDataFrame([(text, truth)], "a string, b string")
    assert df.select(scoring.tool_score(F.col("a"), F.col("b")).alias("g")).first().g == score


def test_calls_in_channels(spark):
    call = "<|start|>assistant<|channel|>commentary to=functions.{} <|constrain|>json<|message|>{}<|call|>"
    hidden = "<|channel|>analysis<|message|>a" + call.format("no", "{}") + "<|end|>"
    rows = [
        (hidden + call.format("find", '{"a":\n1}') + "<|pad|>" + call.format("open", "no json") + "bye", "bye", [("find", '{"a":\n1}'), ("open", "no json")]),
        ("<|start|>assistant" + hidden + "just text<|pad|>", "just text", []),
        ("", "", []),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "t string, c string")
    for r, (_, content, calls) in zip(df.select(scoring.channel_calls(F.col("t"), "<|pad|>").alias("x")).collect(), rows, strict=True):
        assert r.x.content == content and [tuple(c) for c in r.x.calls] == calls
