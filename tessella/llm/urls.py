"""URL filters: rules first, then words of the host and path in a multinomial naive Bayes model.

Host labels are often words run together. Each label is split where a unigram model makes the split most probable
(Viterbi): a known word has the probability of its count, an unknown run of letters one that falls tenfold with each
letter. The words of the host and of the path are the tokens.

Both models are learnt from the table of pages. What is a word comes from where words stand apart: the texts of the
pages, and paths and the last labels of hosts. It counts once for each page whose text has it and once for each
different host whose urls have it there. The other labels of hosts, which are to be split, are no evidence of
themselves, so a name that is only ever written together is split however often it is met. The counts are then refined by
expectation-maximisation: the different labels are split with the counts, a sum over all splits of each, and the expected
uses of a known word are added to its count, ROUNDS times. Words with at least LEAST_SHARE of all counts are known, so
there are at most 1 / LEAST_SHARE of them however large the table is; a word below it is split or unknown.

Naive Bayes learns from pages that a rule decides, with the rule's verdict as their label: about MAX_ROWS different ones
(a bound on the digest of host and path), whole, and none with crc32(page_id as text) mod 5 = 0, on which it can be
measured. Both verdicts count as equally probable before a token is seen, and a token that the model does not know says
nothing, so a page without known tokens is allowed.

Rules ``(host, path, verdict)`` hold for their host and its subdomains where the url's path starts with theirs; the
longest rule wins. The rule's verdict stands; without a rule the model's does, block where its odds are above even.

Defined cases: a null url or one without ``://`` has an empty host and path, no rule, and is allowed; a table without html learns
words from its urls alone; repeated rows are judged alike; columns other than page_id, url and html are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import scratch

# Rules, in the form of the report.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

LEAST_SHARE = 2.0**-20
ROUNDS = 2
MAX_ROWS = 20_000
MARKUP = r"(?s)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>"
_LETTERS = re.compile(r"[a-z]+")


class Segmenter:
    """The most probable split of a run of letters into words, from the words' counts."""

    def __init__(self, counts: dict[str, float]):
        total = sum(counts.values())
        self.cost = {w: -math.log(0.9 * n / total) for w, n in counts.items() if n > 0}
        self.lengths = sorted({len(w) for w in self.cost})
        self.unknown, self.letter = -math.log(0.1 / 26), math.log(10.0)

    def _words(self, run: str, i: int) -> Iterator[tuple[int, float]]:
        """(start, cost) of the known words that end at i."""
        for k in self.lengths:
            if k > i:
                return
            if (c := self.cost.get(run[i - k : i])) is not None:
                yield i - k, c

    def expected(self, run: str) -> dict[str, float]:
        """How often each known word is expected in the run, over all its splits, by forward and backward sums of logs."""
        n, add = len(run), lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)
        ends = [list(self._words(run, i)) for i in range(n + 1)]
        ahead, inside = [0.0] + [-math.inf] * n, [-math.inf] * (n + 1)  # inside: within an unknown word so far
        for i in range(1, n + 1):
            inside[i] = add(inside[i - 1], ahead[i - 1] - self.unknown) - self.letter
            ahead[i] = inside[i]
            for j, c in ends[i]:
                ahead[i] = add(ahead[i], ahead[j] - c)
        back, within = [-math.inf] * n + [0.0], [-math.inf] * (n + 1)
        out: dict[str, float] = {}
        for i in range(n, 0, -1):
            # an unknown word may end here or go on; the words that end here give their share to their starts
            within[i] = add(within[i], back[i])
            within[i - 1] = add(within[i - 1], within[i] - self.letter)
            back[i - 1] = add(back[i - 1], within[i] - self.letter - self.unknown)
            for j, c in ends[i]:
                back[j] = add(back[j], back[i] - c)
                w = run[j:i]
                out[w] = out.get(w, 0.0) + math.exp(min(0.0, ahead[j] - c + back[i] - ahead[n]))
        return out

    def split(self, run: str) -> list[str]:
        """An unknown part is one word however long it is, so time is linear in the length."""
        n = len(run)
        # best[i]: least cost of run[:i], where its last word starts, whether that word is unknown
        known: list[tuple[float, int]] = [(0.0, 0)] + [(math.inf, 0)] * n
        open_: list[tuple[float, int]] = [(math.inf, 0)] * (n + 1)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(math.inf, 0)] * n
        for i in range(1, n + 1):
            for j, c in self._words(run, i):
                if best[j][0] + c < known[i][0]:
                    known[i] = (best[j][0] + c, j)
            longer, fresh = open_[i - 1][0] + self.letter, best[i - 1][0] + self.unknown + self.letter
            open_[i] = (longer, open_[i - 1][1]) if longer <= fresh else (fresh, i - 1)
            best[i] = min(known[i], open_[i])
        out, i = [], n
        while i > 0:
            out.append(run[best[i][1] : i])
            i = best[i][1]
        return out[::-1]


def tokens(segmenter: Segmenter, host: str, path: str) -> list[str]:
    return [w for part in (host, path.lower()) for run in _LETTERS.findall(part) for w in segmenter.split(run)]


class Model:
    """Multinomial naive Bayes from how often each word is in rows of each verdict."""

    def __init__(self, counts: dict[str, dict[str, int]], segmenter: Segmenter, smooth: float = 0.5):
        self.segmenter = segmenter
        allow, block = counts.get("allow", {}), counts.get("block", {})
        words = set(allow) | set(block)
        more = smooth * len(words)
        self.weight = {}
        if allow and block:
            a, b = sum(allow.values()) + more, sum(block.values()) + more
            self.weight = {w: math.log((block.get(w, 0) + smooth) / b) - math.log((allow.get(w, 0) + smooth) / a) for w in words}

    def tokens(self, host: str, path: str) -> list[str]:
        return tokens(self.segmenter, host, path)

    def log_odds(self, tokens: list[str]) -> float:
        return sum(self.weight.get(w, 0.0) for w in tokens)


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), upper, upper.lower())
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, else null."""
    longest_first = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    return F.coalesce(*[F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in longest_first])


def _split(pages: DataFrame, rules) -> DataFrame:
    """``page_id, host, path, rule, by_rule``."""
    url = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("_url"))
    host, path = parts(F.col("_url"))
    split = url.select("page_id", host.alias("host"), path.alias("path"))
    split = split.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    return split.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("by_rule"))


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0))


def word_counts(pages: DataFrame, split: DataFrame) -> dict[str, float]:
    """The words that stand apart, with at least LEAST_SHARE of all counts: once a page's text, once a host's urls."""
    # everything before the last dot is names
    apart = F.concat_ws("/", F.regexp_extract("host", r"([^.]*)\.?\z", 1), F.lower("path"))
    words = split.select("host", F.explode(F.array_distinct(_runs(apart))).alias("w")).distinct().select("w")
    if "html" in pages.columns:
        shown = F.lower(F.regexp_replace(F.coalesce(F.col("html").cast("string"), F.lit("")), MARKUP, " "))
        words = words.unionByName(pages.select(F.explode(F.array_distinct(_runs(shown))).alias("w")))
    counts = scratch.save(words.groupBy("w").count(), "words")
    total = counts.agg(F.sum("count")).first()[0] or 0
    found = counts.filter(F.col("count") >= total * LEAST_SHARE).toArrow()
    scratch.drop(counts)
    return dict(zip(found["w"].to_pylist(), map(float, found["count"].to_pylist()), strict=True))


def refine(counts: dict[str, float], labels: DataFrame, rounds: int = ROUNDS) -> dict[str, float]:
    """``counts`` and the expected uses of their words in the different ``labels(w, n)``; each label counts once."""
    now = counts
    for _ in range(rounds):
        segmenter = Segmenter(now)

        def apply(batches: Iterator[pa.RecordBatch], segmenter=segmenter) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums: dict[str, float] = {}
                for run in batch.column(0).to_pylist():
                    for w, n in segmenter.expected(run).items():
                        sums[w] = sums.get(w, 0.0) + n
                yield pa.RecordBatch.from_arrays([pa.array(sums, pa.string()), pa.array(sums.values(), pa.float64())], ["w", "n"])

        # whole units of 2^-20, so sums do not depend on their order
        used = labels.mapInArrow(apply, "w string, n double").groupBy("w").agg(F.sum(F.round(F.col("n") * 2**20).cast("long")).alias("n")).toArrow()
        more = dict(zip(used["w"].to_pylist(), used["n"].to_pylist(), strict=True))
        now = {w: n + more.get(w, 0) / 2**20 for w, n in counts.items()}
    return now


def held_out(page_id: Column) -> Column:
    return F.coalesce(F.crc32(page_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def segmenter(pages: DataFrame, rules=RULES) -> Segmenter:
    """The word model of ``pages(page_id, url)``, and of their html if they have it."""
    split = _split(pages, rules)
    counts = word_counts(pages, split)
    if not counts:
        return Segmenter(counts)
    names = split.select(F.explode(_runs(F.regexp_replace("host", r"[^.]*\.?\z", ""))).alias("w")).distinct()
    labels = scratch.save(names, "labels")
    found = Segmenter(refine(counts, labels))
    scratch.drop(labels)
    return found


def train(pages: DataFrame, rules=RULES, most: int = MAX_ROWS) -> Model:
    """The models of ``pages(page_id, url)``."""
    words = segmenter(pages, rules)
    known = _split(pages, rules).filter(F.col("by_rule").isNotNull() & ~held_out(F.col("page_id"))).select("by_rule", "host", "path")
    n = known.count()
    chosen = F.pmod(F.xxhash64("host", "path"), F.lit(1 << 30)) < int(min(1.0, most / max(n, 1)) * (1 << 30))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter((v, w) for v, h, p in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in tokens(words, h, p))
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in seen], pa.string()), pa.array([w for _, w in seen], pa.string()), pa.array(seen.values(), pa.int64())], ["verdict", "w", "n"])

    rows = known.filter(chosen).distinct().mapInArrow(apply, "verdict string, w string, n long").groupBy("verdict", "w").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for v, w, n in rows.collect():
        counts.setdefault(v, {})[w] = n
    return Model(counts, words)


def judge(pages: DataFrame, rules=RULES, model: Model | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_odds, words``, one row for each row of ``pages``."""
    model = model or train(pages, rules)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds, words = [], []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = model.tokens(host, path)
                odds.append(model.log_odds(found))
                words.append(" ".join(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odds, pa.float64()), pa.array(words, pa.string())], [*batch.schema.names, "block_odds", "words"])

    scored = _split(pages, rules).mapInArrow(apply, "page_id long, host string, path string, rule string, by_rule string, block_odds double, words string")
    verdict = F.coalesce("by_rule", F.when(F.col("block_odds") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_odds", "words")
