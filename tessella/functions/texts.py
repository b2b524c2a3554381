"""Smaller text and array functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def description(statement: Column) -> Column:
    """The text before the first dashed line, without a last line that ends in a dash; under 10 characters, empty."""
    head = F.element_at(F.split(statement, r"(?m)^-----.*$", 2), 1)
    text = F.regexp_replace(F.regexp_replace(head, r"\s+$", ""), r"\n[^\n]*-$", "")
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.length(text) < 10, "").otherwise(text)


def docstring(source: Column) -> Column:
    """Between the first pair of triple double quotes, cut at the first prompt of an example."""
    inside = F.coalesce(F.get(F.split(source, '"""'), F.lit(1)), F.lit(""))
    return F.trim(F.element_at(F.split(inside, ">>>"), 1))


def function_name(source: Column) -> Column:
    """The name after the first ``def``; empty without one."""
    return F.regexp_extract(source, r"def\s+(\w+)\s*\(", 1)


def step_of_path(path: Column) -> Column:
    return F.regexp_extract(path, r"global_step_(\d+)", 1).try_cast("int")


def remove_self(text: Column, source: Column, only: str) -> Column:
    """One data source writes methods; its signatures lose ``self``."""
    return F.when(source == only, F.replace(F.replace(text, F.lit("(self, "), F.lit("(")), F.lit("(self)"), F.lit("()"))).otherwise(text)


def reprompt(prompt: Column, solution: Column, feedback: Column, feedback_only_without_solution: bool = True) -> Column:
    """The prompt with a worked solution and feedback, where there are any."""
    solved = F.when(solution.isNotNull(), F.concat(F.lit("\nCorrect solution:\n"), solution)).otherwise("")
    useful = F.length(F.trim(F.coalesce(feedback, F.lit("")))) > 0
    shown = useful & solution.isNull() if feedback_only_without_solution else useful
    return F.concat(prompt, solved, F.when(shown, F.concat(F.lit("\nFeedback:\n"), feedback)).otherwise(""))


def single_turn_mask(length: Column, prompt: Column) -> Column:
    """1 for places whose next token is of the response: not before ``prompt - 1`` and not the last."""
    last = length - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.when((i >= prompt - 1) & (i < last), 1).otherwise(0))


def without_padding(ids: Column, mask: Column) -> Column:
    kept = F.filter(F.zip_with(ids, mask, lambda i, m: F.struct(i.alias("i"), m.alias("m"))), lambda s: s["m"] == 1)
    return F.transform(kept, lambda s: s["i"])


def test_feedback(results: Column, most: int = 2, width: int = 250) -> Column:
    """Lines for failing tests of ``array<struct<input, want, got>>``: the first one that gave nothing, else ``most``,
    the shortest by input and output first; fields are cut."""
    cut = lambda x: F.when(F.length(x) > width, F.concat(F.left(x, F.lit(width)), F.lit("..."))).otherwise(x)
    failing = F.filter(results, lambda r: F.coalesce(r["got"] != r["want"], F.lit(True)))
    broken = F.slice(F.filter(failing, lambda r: r["got"].isNull()), 1, 1)
    placed = F.transform(failing, lambda r, i: F.struct((F.length(r["input"]) + F.length(r["got"])).alias("n"), i.alias("i"), r.alias("r")))
    shortest = F.slice(F.transform(F.array_sort(placed), lambda s: s["r"]), 1, most)
    shown = F.when(F.size(broken) > 0, broken).otherwise(shortest)
    return F.array_join(F.transform(shown, lambda r: F.concat(F.lit("input "), cut(r["input"]), F.lit(": want "), cut(r["want"]), F.lit(", got "), F.coalesce(cut(r["got"]), F.lit("nothing")))), "\n")


def mixed_number(text: Column) -> Column:
    """``7 3/4`` as ``7+3/4``, without commas between digits."""
    plain = F.regexp_replace(text, r"(?<=\d),(?=\d{3})", "")
    return F.regexp_replace(plain, r"([0-9]) +([0-9]+/[0-9]+)", "$1+$2")


def canonical_json(text: Column, schema: str) -> Column:
    """JSON with the schema's fields in its order, for comparison."""
    return F.to_json(F.from_json(text, schema))


def shuffled_choices(options: Column, right: Column, key: Column, seed: str = "0") -> Column:
    """``struct<options, right>``: options in the order of a digest of seed, key and place, and the right one's letter."""
    drawn = lambda x, i: F.struct(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"), i.cast("string")).cast("binary")).alias("h"), i.alias("i"), x.alias("x"))
    order = F.array_sort(F.transform(options, drawn))
    place = F.array_position(F.transform(order, lambda s: s["i"]), right.cast("int"))
    return F.struct(F.transform(order, lambda s: s["x"]).alias("options"), F.char(place + 64).alias("right"))


def with_temperature(logits: Column, temperature: float) -> Column:
    return F.transform(logits, lambda x: x / temperature)


def clip_by(values: Column, low: Column, high: Column) -> Column:
    """Each value held between the bounds at its place; the upper one wins where they cross."""
    return F.zip_with(F.zip_with(values, low, lambda x, a: F.greatest(x, a)), high, lambda x, b: F.least(x, b))


def test_cases(text: Column) -> Column:
    """Test cases in one form, as JSON ``inputs, outputs, testtype, fn_name, time_limit``.

    Read are objects with lists of inputs and outputs, and lists of ``{"input", "output"}``.
    """
    both = F.from_json(text, "inputs array<string>, outputs array<string>, fn_name string, time_limit double")
    pairs = F.from_json(text, "array<struct<input:string,output:string>>")
    listed = F.ltrim(text).startswith("[")
    fn = F.when(~listed, both["fn_name"])
    return F.to_json(
        F.struct(
            F.when(listed, F.transform(pairs, lambda p: p["input"])).otherwise(both["inputs"]).alias("inputs"),
            F.when(listed, F.transform(pairs, lambda p: p["output"])).otherwise(both["outputs"]).alias("outputs"),
            F.when(F.coalesce(fn, F.lit("")) != "", "functional").otherwise("stdin").alias("testtype"),
            F.coalesce(fn, F.lit("")).alias("fn_name"),
            F.when(~listed, both["time_limit"]).alias("time_limit"),
        )
    )
