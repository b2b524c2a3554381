"""Answer extraction from response texts, as column expressions.

Every function takes and returns a Column and stays inside the JVM. A null text gives a null answer unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the answer formats.
HASH_ANSWER = r"#### (-?[0-9.,]+)"
NUMBER = r"(-?[0-9.,]+)"
TAIL = 300


def tail(text: Column, n: int = TAIL) -> Column:
    """The last ``n`` characters."""
    return F.right(text, F.lit(n))


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the last match, null if there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def hash_answer(text: Column) -> Column:
    """Strict form: the number after the last ``####`` in the text's tail, without commas and dollar signs."""
    return F.translate(last_match(tail(text), HASH_ANSWER), ",$", "")


def last_number(text: Column) -> Column:
    """Flexible form: the last numeric token that is neither empty nor a full stop; if all are such, the first one."""
    found = F.regexp_extract_all(tail(text), F.lit(NUMBER), F.lit(1))
    good = F.filter(found, lambda x: ~x.isin("", "."))
    return F.coalesce(F.try_element_at(good, F.lit(-1)), F.try_element_at(found, F.lit(1)))


def equals_score(answer: Column, truth: Column, right: float = 1.0, wrong: float = 0.0) -> Column:
    """``right`` where the answer equals the truth, else ``wrong``; a missing answer is wrong."""
    return F.when(answer == truth, F.lit(right)).otherwise(F.lit(wrong))
