r"""Symbolic equality of answers: the last tier of comparison, for pairs that no rule on their texts has made equal.

An answer is parsed into a tree (numbers, letters, ``\frac``, ``\sqrt``, powers, functions, implicit products), and two
trees are equal if they agree at points drawn from the names of their variables. Sums, products, quotients and whole
powers are rational numbers throughout, so polynomials and rational functions are compared exactly (an identity that
fails holds at a point by chance only); roots, logarithms and the like are complex floats, compared to 1e-9. Answers
without variables may differ by the tolerance of numeric answers. Tuples, intervals, sets and matrices are compared
element by element, equations up to a constant factor of their difference.

Nothing is evaluated as code. What cannot be parsed, is longer than MAX_CHARS or cannot be evaluated is unequal.
"""

from __future__ import annotations

import cmath
import math
import re
import zlib
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tessella.functions import scoring

MAX_CHARS = 2000
MAX_POWER = 256
POINTS, NEEDED = 8, 4
TOLERANCE = 1e-4
FUNCTIONS = {
    "sqrt": cmath.sqrt, "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan,
    "asin": cmath.asin, "acos": cmath.acos, "atan": cmath.atan, "sinh": cmath.sinh, "cosh": cmath.cosh, "tanh": cmath.tanh, "exp": cmath.exp,
    "ln": cmath.log, "log": cmath.log, "cot": lambda x: 1 / cmath.tan(x), "sec": lambda x: 1 / cmath.cos(x), "csc": lambda x: 1 / cmath.sin(x),
}
GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi rho sigma tau phi chi psi omega".split()
CONSTANTS = {"pi": math.pi, "e": math.e, "i": 1j}
TOKEN = re.compile(r"\s+|(?P<number>\d+(?:\.\d+)?|\.\d+)|(?P<command>\\[A-Za-z]+|\\.)|(?P<word>[A-Za-z]+)|(?P<mark>\*\*|.)", re.S)
#: Marks that mean the same, and commands that mean nothing.
SAME = {"\\cdot": "*", "\\times": "*", "\\div": "/", "**": "^", "\\{": "{set", "\\}": "set}", "\\lvert": "|", "\\rvert": "|", "\\dfrac": "\\frac", "\\tfrac": "\\frac", "−": "-"}
SILENT = {"\\left", "\\right", "\\,", "\\;", "\\!", "\\:", "\\ ", "$", "\\$", "\\quad", "\\displaystyle"}
MATRIX = re.compile(r"^\s*\\begin\{([pbvBV]?matrix|array)\}(?:\{[lcr|]*\})?(.*)\\end\{\1\}\s*$", re.S)


class _Parser:
    """Sums of products of powers; a tree is ``(operation, operands...)``, with Fractions and names as leaves."""

    def __init__(self, text: str):
        self.tokens, self.at = [], 0
        for m in TOKEN.finditer(text):
            t = SAME.get(m.group(), m.group())
            if m.lastgroup and t not in SILENT:
                words = [t] if m.lastgroup != "word" or t in FUNCTIONS or t == "pi" else list(t)
                self.tokens += [(m.lastgroup, w) for w in words]

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self, expected: str = "") -> str:
        t = self.peek()
        if not t or (expected and t != expected):
            raise ValueError(f"{expected or 'more'} expected")
        self.at += 1
        return t

    def whole(self):
        tree = self.sum()
        if self.peek():
            raise ValueError(f"unexpected {self.peek()}")
        return tree

    def sum(self):
        tree = self.product()
        while self.peek() in ("+", "-"):
            tree = (self.take(), tree, self.product())
        return tree

    def product(self):
        if self.peek() in ("+", "-"):
            return ("-", Fraction(0), self.product()) if self.take() == "-" else self.product()
        tree = self.power()
        while self.peek() and self.peek() not in ("+", "-", ")", "]", "}", "|", "&", ",", "=", "set}"):
            if self.peek() in ("*", "/"):
                tree = (self.take(), tree, self.signed())
            else:
                tree = ("*", tree, self.power())
        return tree

    def signed(self):
        if self.peek() in ("+", "-"):
            return ("-", Fraction(0), self.signed()) if self.take() == "-" else self.signed()
        return self.power()

    def power(self):
        tree = self.atom()
        while self.peek() == "!":
            tree = (self.take(), tree)
        if self.peek() == "^":
            self.take()
            tree = ("^", tree, self.signed() if self.peek() == "-" else self.argument())
        return tree

    def argument(self):
        """What a command or ``^`` takes without braces: a group, one digit or one letter."""
        if self.peek() == "{":
            return self.group("{", "}")
        kind, t = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind == "number" and len(t) > 1 and self.at and self.tokens[self.at - 1][1].startswith("\\"):
            self.tokens[self.at : self.at + 1] = [("number", t[0]), ("number", t[1:])]
        return self.power() if self.peek() != "(" else self.atom()

    def group(self, opening: str, closing: str):
        self.take(opening)
        tree = self.sum()
        self.take(closing)
        return tree

    def atom(self):
        kind, t = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if t in ("(", "[", "{"):
            return self.group(t, {"(": ")", "[": "]", "{": "}"}[t])
        if t == "|":
            return ("abs", self.group("|", "|"))
        self.take()
        if kind == "number":
            return Fraction(t)
        name = t.lstrip("\\")
        if t == "\\frac":
            return ("/", self.argument(), self.argument())
        if t == "\\sqrt" and self.peek() == "[":
            root = self.group("[", "]")
            return ("^", self.argument(), ("/", Fraction(1), root))
        if name in FUNCTIONS:
            if self.peek() == "^":  # sin^2 x
                self.take()
                power = self.argument()
                return ("^", (name, self.argument()), power)
            return (name, self.argument())
        if kind == "command" and name in ("text", "mathrm", "mathbf", "operatorname"):
            return self.argument()
        if kind == "word" or name in GREEK or name == "pi":
            if self.peek() == "_":
                self.take()
                below = self.at
                self.argument()
                name += "_" + "".join(x for _, x in self.tokens[below : self.at] if x not in "{}")
            return name
        raise ValueError(f"unexpected {t}")


def _names(tree) -> set[str]:
    if isinstance(tree, str):
        return set() if tree in CONSTANTS else {tree}
    return set().union(*map(_names, tree[1:])) if isinstance(tree, tuple) else set()


def _value(tree, at: dict):
    if isinstance(tree, Fraction):
        return tree
    if isinstance(tree, str):
        return CONSTANTS[tree] if tree in CONSTANTS else at[tree]
    op, *parts = tree
    x = [_value(p, at) for p in parts]
    exact = all(isinstance(v, Fraction) for v in x)
    if not exact:
        x = [complex(v) for v in x]
    if op == "+":
        return x[0] + x[1]
    if op == "-":
        return x[0] - x[1]
    if op == "*":
        return x[0] * x[1]
    if op == "/":
        return x[0] / x[1]
    if op == "abs":
        return abs(x[0]) if exact else complex(abs(x[0]))
    if op == "!":
        if not exact or x[0].denominator != 1 or not 0 <= x[0] <= MAX_POWER:
            raise ValueError("no factorial")
        return Fraction(math.factorial(int(x[0])))
    if op == "^":
        if exact and x[1].denominator == 1 and abs(x[1]) <= MAX_POWER and max(x[0].numerator.bit_length(), x[0].denominator.bit_length()) * abs(x[1]) < 1 << 16:
            return x[0] ** int(x[1])
        return complex(x[0]) ** complex(x[1])
    if op == "sqrt" and exact and x[0] >= 0:
        a, b = math.isqrt(x[0].numerator), math.isqrt(x[0].denominator)
        if a * a == x[0].numerator and b * b == x[0].denominator:
            return Fraction(a, b)
    return FUNCTIONS[op](complex(x[0]))


def _close(a, b, tolerance: float) -> bool:
    if isinstance(a, Fraction) and isinstance(b, Fraction) and not tolerance:
        return a == b
    a, b = complex(a), complex(b)
    return abs(a - b) <= (tolerance or 1e-9) * max(abs(a), abs(b), 0.0 if tolerance else 1e-3)


def _points(*trees):
    """Values of the trees at points that follow from the names of their variables."""
    names = sorted(set().union(*map(_names, trees)))
    for p in range(POINTS if names else 1):
        at = {n: Fraction(2 + (h := zlib.crc32(f"{n}:{p}".encode())) % 97, 1 + (h >> 8) % 13) for n in names}
        try:
            yield [_value(t, at) for t in trees]
        except (ArithmeticError, ValueError):
            continue


def _same(a, b) -> bool:
    names = _names(a) | _names(b)
    found = [_close(x, y, 0.0 if names else TOLERANCE) for x, y in _points(a, b)]
    return len(found) >= (NEEDED if names else 1) and all(found)


def _same_equation(a, b) -> bool:
    ratios = [x / y for x, y in _points(a, b) if y != 0]
    return len(ratios) >= NEEDED and ratios[0] != 0 and all(_close(r, ratios[0], 0.0) for r in ratios)


def _split(text: str, marks: str = ",") -> list[str]:
    """Parts between marks that stand outside all brackets."""
    parts, depth, first = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if c in marks and depth == 0:
            parts.append(text[first:i])
            first = i + 1
    return [*parts, text[first:]]


def _rows(text: str) -> list[list[str]] | None:
    """The cells of a matrix: a LaTeX environment, or brackets of brackets."""
    if m := MATRIX.match(text):
        return [row.split("&") for row in re.split(r"\\\\(?:\[.*?\])?|\\cr\b", m.group(2)) if row.strip()]
    inner = re.fullmatch(r"\s*(?:Matrix\s*\(\s*)?\[\s*(\[.*\])\s*\]\s*\)?\s*", text, re.S)
    if inner:
        return [_split(r.strip()[1:-1]) for r in _split(inner.group(1))]
    return None


def _plain(text: str) -> str:
    return re.sub(r"\\left(?![a-z])|\\right(?![a-z])", "", text).strip().strip("$").strip()


def equal(a: str, b: str) -> bool:
    """Whether two answers have the same value."""
    if max(len(a), len(b)) > MAX_CHARS:
        return False
    a, b = _plain(a), _plain(b)
    rows = _rows(a), _rows(b)
    if any(rows):
        return all(rows) and list(map(len, rows[0])) == list(map(len, rows[1])) and all(equal(x, y) for r, s in zip(*rows, strict=True) for x, y in zip(r, s, strict=True))
    lists = []
    for t in (a, b):
        m = re.fullmatch(r"(\\\{|[(\[])(.*)(\\\}|[)\]])", t, re.S)
        inside = _split(m.group(2)) if m else []
        lists.append((m.group(1), m.group(3), inside) if len(inside) > 1 else ("", "", parts) if len(parts := _split(t)) > 1 else None)
    if any(lists):
        x, y = lists
        return bool(x and y) and x[:2] == y[:2] and len(x[2]) == len(y[2]) and all(equal(p, q) for p, q in zip(x[2], y[2], strict=True))
    try:
        sides = [[_Parser(s).whole() for s in t.split("=")] for t in (a, b)]
        if [len(s) for s in sides] == [2, 2]:
            return _same_equation(*(("-", *s) for s in sides))
        return [len(s) for s in sides] == [1, 1] and _same(sides[0][0], sides[1][0])
    except (ValueError, ArithmeticError, RecursionError):
        return False


@F.pandas_udf(BooleanType())
def _equal(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x is not None and y is not None and equal(x, y) for x, y in zip(a, b, strict=True)])


def symbolic_equal(a: Column, b: Column) -> Column:
    """True for equal values, false for others and for nulls."""
    return _equal(a.cast("string"), b.cast("string"))


def graded_equal(a: Column, b: Column) -> Column:
    """Equal by the rules on texts and numbers, else by value. Pairs that the rules decide are not parsed."""
    by_rules = scoring.answers_equal(a, b)
    return by_rules | symbolic_equal(F.when(~by_rules, a), b)
