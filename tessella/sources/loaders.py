"""Dataset builders: a raw frame in, the corpus or training schema out. Registered by name, used by ``build``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import scoring
from tessella.sources.datasets import messages, raw_corpus

BUILDERS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    def add(f):
        BUILDERS[name] = f
        return f

    return add


def build(name: str, df: DataFrame, **how) -> DataFrame:
    if name not in BUILDERS:
        raise ValueError(f"no such dataset: {name}; there are {sorted(BUILDERS)}")
    return BUILDERS[name](df, **how)


def choices(options: Column, mark: str = ". ") -> Column:
    """``A. first`` and so on, a line each."""
    return F.array_join(F.transform(options, lambda x, i: F.concat(F.char(i + 65), F.lit(mark), x)), "\n")


def record(source: Column, question: Column, truth: Column, index: Column, split: str, ability: str, /, style: str = "rule", **extra: Column) -> list[Column]:
    """Columns of the training schema."""
    info = [F.lit(split).alias("split"), index.alias("index"), *[v.alias(k) for k, v in extra.items()]]
    return [
        source.alias("data_source"),
        messages(question).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct(*info).alias("extra_info"),
    ]


@register("train")
def train(df: DataFrame, kind: str | None = None, suffixes: dict[str, str] | None = None) -> DataFrame:
    """A verifiable corpus: one kind or all, with an instruction chosen by kind."""
    out = df.filter(F.col("kind") == kind) if kind else df
    told = F.lit("")
    for k, text in (suffixes or {}).items():
        told = F.when(F.col("kind") == k, F.lit(text)).otherwise(told)
    return raw_corpus(out.withColumn("prompt", F.concat("prompt", told)))


@register("choices")
def multiple_choice(df: DataFrame, category: str | None = None, step_by_step: bool = False) -> DataFrame:
    """``question, options, answer, category`` to a corpus row; an underscore in a category stands for a blank."""
    named = F.replace(F.col("category"), F.lit("_"), F.lit(" "))
    out = df.filter(named == category.replace("_", " ")) if category else df
    told = F.lit("\nThink step by step and finish with: the answer is (X)." if step_by_step else "\nGive the letter only.")
    return raw_corpus(out.withColumns({"prompt": F.concat("question", F.lit("\n"), choices(F.col("options")), told), "kind": F.lit("mcq"), "dataset": F.col("category"), "elo": F.lit("1500")}))


@register("gsm8k")
def gsm8k(df: DataFrame, split: str = "train", instruction: str = " Let's think step by step and output the final answer after \"####\".") -> DataFrame:
    """``question, answer, idx``: the number after ``####`` without commas is the truth; a missing one is an error."""
    found = F.regexp_extract("answer", r"#### (\-?[0-9\.\,]+)", 1)
    truth = F.when(found != "", F.replace(found, F.lit(","), F.lit(""))).otherwise(F.raise_error(F.lit("no answer")).cast("string"))
    return df.select(*record(F.lit("openai/gsm8k"), F.concat("question", F.lit(instruction)), truth, F.col("idx"), split, "math", answer=F.col("answer"), question=F.col("question")))


@register("math")
def mathematics(df: DataFrame, split: str = "train") -> DataFrame:
    told = F.concat("problem", F.lit(" Let's think step by step and output the final answer within \\boxed{}."))
    return df.select(*record(F.lit("lighteval/MATH"), told, scoring.last_boxed(F.col("solution")), F.col("idx"), split, "math"))


@register("hellaswag")
def endings(df: DataFrame, split: str = "train") -> DataFrame:
    """``ctx_a, ctx_b, activity, endings, label, idx``; rows without a label go."""
    context = scoring.clean_wiki(F.concat(F.col("activity"), F.lit(": "), F.col("ctx_a"), F.lit(" "), scoring.capitalise(F.col("ctx_b"))))
    rows = df.filter(F.length("label") > 0)
    info = F.struct(F.lit("model").alias("style"), F.col("label").cast("int").alias("ground_truth"))
    return rows.select(F.lit("hellaswag").alias("data_source"), messages(context).alias("prompt"), F.transform("endings", scoring.clean_wiki).alias("choices"), info.alias("reward_model"), F.struct(F.lit(split).alias("split"), F.col("idx").alias("index")).alias("extra_info"))


@register("preference_sft")
def preference_sft(df: DataFrame) -> DataFrame:
    """Two rows of each pair: the chosen answer, then the rejected one."""
    return df.select("prompt", F.posexplode(F.array("chosen", "rejected")).alias("place", "response"))


@register("preference_rm")
def preference_rm(df: DataFrame, order: str, part: str = "train", share: float = 0.75) -> DataFrame:
    """Pairs of the head (``train``) or the tail of the table."""
    from tessella.operators.batch import with_ordinal

    head = int(df.count() * share)
    rows = with_ordinal(df.select(order, "prompt", "chosen", "rejected"), [order], "_o")
    return rows.filter(F.col("_o") < head if part == "train" else F.col("_o") >= head).drop("_o")


@register("search_qa")
def search_qa(df: DataFrame, split: str = "train", prefix: str = "") -> DataFrame:
    """``question, golden_answers, ground_truth, data_source, idx``: the given truth, else the golden answers."""
    truth = F.coalesce("ground_truth", "golden_answers")
    source = F.concat(F.lit("searchR1_"), "data_source")
    return df.select(*record(source, F.concat(F.lit(prefix), F.col("question")), truth, F.col("idx"), split, "fact-reasoning", need_tools_kwargs=F.lit(True)))


@register("code")
def code(df: DataFrame, imports: str | None = None) -> DataFrame:
    """``statement, signature, inputs, outputs, rating``: tests as JSON, the description without its last dashed line."""
    tests = F.to_json(F.struct(F.col("inputs").alias("inputs"), F.col("outputs").alias("outputs"), F.lit("stdin").alias("testtype"), F.lit("").alias("fn_name"), F.lit(None).cast("double").alias("time_limit")))
    head = F.element_at(F.split("statement", r"(?m)^-----.*$", 2), 1)
    text = F.regexp_replace(head, r"^\s+|\s+$", "")
    told = F.when(F.col("signature").contains("def "), F.concat("statement", F.lit("\nUse this signature: "), "signature")).otherwise(F.col("statement"))
    out = df.withColumns({"kind": F.lit("code"), "prompt": told if imports is None else F.concat(F.lit(imports + "\n"), told), "tests": tests, "description": F.when(F.length(text) < 10, "").otherwise(text), "elo": F.coalesce(F.col("rating").cast("string"), F.lit("-"))})
    return raw_corpus(out)


@register("conversations")
def conversations(df: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row a conversation: its messages in order of turn."""
    packed = F.array_sort(F.collect_list(F.struct(turn, "role", F.col("text").alias("content"))))
    return df.groupBy(key).agg(F.transform(packed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def sample_tests(tests: Column, key: Column, share: float = 0.5, seed: str = "0") -> Column:
    """``max(1, floor(n * share))`` of an array of tests, drawn by a digest of key and place, in their old order."""
    n = F.size(tests)
    keep = F.greatest(F.lit(1), F.floor(n * share).cast("int"))
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"), i.cast("string")).cast("binary")).alias("h"), i.alias("i"))))
    chosen = F.array_sort(F.transform(F.slice(ranked, F.lit(1), keep), lambda s: s["i"]))
    return F.when(n > 0, F.transform(chosen, lambda i: F.element_at(tests, i + 1))).otherwise(tests)
