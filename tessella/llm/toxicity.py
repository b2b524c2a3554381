"""Toxicity by a chain of linear classifiers.

The categories follow each other: unfit texts (labelled of low quality), toxic ones among those, and toxic texts. Each
is a ridge logistic regression on the counts of telling tokens; from the second on it also sees the log-odds of the
categories before it. In training these come from models of the other folds, so that a later model never learns from a
probability that an earlier one gave to its own training row.

All that the chain knows comes from the table of labels. Tokens are words of letters, the first 4 to 8 characters of
longer words, which catch inflected forms, and runs of other marks. The telling ones of a category are in at least
MIN_DOCS of the labelled texts and have a likelihood-ratio statistic for it of at least MIN_G2, which chance alone gives
once in ten million tokens. Training texts that have the same tokens equally often count once, with the label that at
least half of them carry. A text is toxic if its last probability is at least THRESHOLD.

Training reads a sample of labelled documents of about MAX_LABELLED rows (a bound on the digest of the id, from the
number of labels), and of each its whole text. Tokens are counted and the telling ones chosen in Spark; the driver gets
those, and of each training text how often it holds them. Scoring reads every whole text.

Defined cases: a null or empty text has the base probabilities; labels that are null or of unknown documents are
ignored (a null quality counts as fair), and of several labels of a document the worst counts; without both kinds of
label, or any telling token, nothing is toxic; of several texts of one id the smallest trains; extra columns are carried by ``clean`` and ignored elsewhere, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import scratch
from tessella.llm.textvec import chunks, mix, tokens

#: Their labels are made of the columns quality and toxic of the table.
CATEGORIES = ("unfit", "toxic_unfit", "toxic")
MAX_LABELLED = 6_000
PREFIXES = (4, 5, 6, 7, 8)
MIN_DOCS, MIN_G2 = 4, 28.4
FOLDS, RIDGE, THRESHOLD = 5, 0.1, 0.5
SAMPLED = "toxic int, unfit int, tokens array<long>, counts array<int>, k1 long, k2 long"


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in chunks(batch.column(2)):
            rows = len(offsets) - 1
            h, of = tokens(data, offsets, PREFIXES, marks=True)
            order = np.lexsort((h, of))
            h, of = h[order], of[order]
            new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])))[: len(h)])
            n = np.diff(np.append(new, len(h)))
            h, of = h[new], of[new]
            each = mix(h ^ mix(n.astype(np.uint64), 3), 4)
            k1, k2 = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            np.add.at(k1, of, each)
            np.bitwise_xor.at(k2, of, mix(each, 5))
            at = pa.array(np.searchsorted(of, np.arange(rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (h.view(np.int64), n.astype(np.int32))]
            labels = [c.slice(first, rows) for c in batch.columns[:2]]
            yield pa.RecordBatch.from_arrays([*labels, *lists, pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))], ["toxic", "unfit", "tokens", "counts", "k1", "k2"])


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """A sample of about ``most`` labelled documents: ``k1, k2, toxic, unfit, tokens, counts``, a row for each set of
    tokens and counts, which k1 and k2 are fingerprints of."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_t"), (F.coalesce(F.col("quality").cast("int"), F.lit(1)) == 0).cast("int").alias("_u"))
    known = known.filter("_id IS NOT NULL AND _t IS NOT NULL").groupBy("_id").agg(F.max("_t").alias("_t"), F.max("_u").alias("_u"))
    n = known.count()
    share = min(1.0, most / max(n, 1))
    chosen = known.filter(F.pmod(F.xxhash64("_id", F.lit("toxicity")), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col("doc_id").cast("long").alias("_d"), F.col("text").cast("string").alias("_x")).join(F.broadcast(chosen), F.col("_d") == F.col("_id"))
    texts = texts.groupBy("_d").agg(F.min("_x").alias("_x"), F.max("_t").alias("_t"), F.max("_u").alias("_u"))  # so repeated rows do not exceed the bound
    rows = texts.select(F.col("_t").alias("toxic"), F.col("_u").alias("unfit"), F.col("_x").alias("text")).mapInArrow(_sample, SAMPLED)
    half = lambda c: (2 * F.sum(F.least(F.greatest(F.col(c), F.lit(0)), F.lit(1))) >= F.count("*")).cast("int").alias(c)
    return rows.groupBy("k1", "k2").agg(half("toxic"), half("unfit"), F.first("tokens").alias("tokens"), F.first("counts").alias("counts"))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights and, last, the intercept (not penalised), by Newton's method; one class only gives its smoothed log-odds."""
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -5.0
    if not len(y) or y.min() == y.max():
        return w
    a = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * penalty @ (w * w))

    now = loss(w)
    for _ in range(30):
        p = _sigmoid(a @ w)
        step = np.linalg.solve((a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        size = 1.0
        while (after := loss(w + size * step)) > now and size > 1e-6:  # a full step may overshoot
            size /= 2
        if after >= now - 1e-7 * (1 + now):
            break
        w, now = w + size * step, after
    return w


def predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _sigmoid(x @ w[:-1] + w[-1])


def _g2(both: Column, one: Column, n: float, n1: float) -> Column:
    """The likelihood-ratio statistic of a token in ``both`` of n texts, ``one`` of them among the n1 with the label 1."""

    def part(k: Column, e: Column) -> Column:
        return F.when((k > 0) & (e > 0), k * F.ln(k / e)).otherwise(0.0)

    return 2 * (part(one, both * n1 / n) + part(both - one, both * (n - n1) / n) + part(n1 - one, (n - both) * n1 / n) + part(n - both - n1 + one, (n - both) * (n - n1) / n))


def telling(sample: DataFrame) -> np.ndarray:
    """Sorted hashes of the tokens that point at the texts with the label 1 of a category."""
    labels = {c: F.col(c).cast("double") for c in ("unfit", "toxic")}
    labels["toxic_unfit"] = labels["unfit"] * labels["toxic"]
    sizes = sample.agg(F.count("*").alias("n"), *[F.sum(v).alias(c) for c, v in labels.items()]).first()
    if not sizes["n"]:
        return np.zeros(0, np.uint64)
    n = float(sizes["n"])
    counts = sample.select(F.explode("tokens").alias("h"), *[v.alias(c) for c, v in labels.items()]).groupBy("h").agg(F.count("*").cast("double").alias("both"), *[F.sum(c).alias(c) for c in labels])
    tells = [(F.col(c) * n > F.col("both") * sizes[c]) & (_g2(F.col("both"), F.col(c), n, sizes[c]) >= MIN_G2) for c in labels]
    found = counts.filter((F.col("both") >= MIN_DOCS) & (tells[0] | tells[1] | tells[2])).select("h").toArrow()
    return np.sort(found["h"].to_numpy().view(np.uint64))


class Chain:
    """``vocabulary`` (sorted hashes) and the weights of each category in turn; ``able`` if both labels were seen and a token tells."""

    def __init__(self, vocabulary: np.ndarray, weights: list[np.ndarray], able: bool):
        self.vocabulary, self.weights, self.able = vocabulary, weights, able

    def features(self, h: np.ndarray, of: np.ndarray, n: int, counts: np.ndarray | None = None) -> np.ndarray:
        k = len(self.vocabulary)
        if not k:
            return np.zeros((n, 0))
        place = np.minimum(np.searchsorted(self.vocabulary, h), k - 1)
        hit = np.flatnonzero(self.vocabulary[place] == h)
        found = np.bincount(of[hit] * k + place[hit], None if counts is None else counts[hit], n * k).reshape(n, k)
        return np.log1p(found)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for w in self.weights:
            out.append(predict(w, np.column_stack([x, *map(logit, out)])))
        return np.column_stack(out)

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities of the categories, whether each text is toxic)."""
        p = [np.zeros((0, len(self.weights)))]
        for _, data, offsets in chunks(column, most=1024):
            p.append(self.probabilities(self.features(*tokens(data, offsets, PREFIXES, marks=True), len(offsets) - 1)))
        p = np.concatenate(p)
        return p, (p[:, -1] >= THRESHOLD) & self.able


def train(sample: DataFrame) -> Chain:
    """Fit the chain on rows of ``labelled``; later categories learn from out-of-fold probabilities of earlier ones."""
    chain = Chain(telling(sample), [], False)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, counts = batch.column(4), batch.column(5)
            ends = h.offsets.to_numpy()
            h, counts = h.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64), counts.values.to_numpy()[ends[0] : ends[-1]]
            of = np.repeat(np.arange(len(batch)), np.diff(ends))
            hit = np.flatnonzero(np.isin(h, chain.vocabulary))
            at = pa.array(np.searchsorted(of[hit], np.arange(len(batch) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (h[hit].view(np.int64), counts[hit])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *lists], ["k1", "k2", "toxic", "unfit", "tokens", "counts"])

    kept = sample.select("k1", "k2", "toxic", "unfit", "tokens", "counts").mapInArrow(apply, "k1 long, k2 long, toxic int, unfit int, tokens array<long>, counts array<int>")
    rows = kept.toArrow().sort_by([("k1", "ascending"), ("k2", "ascending")])
    toxic, unfit = (rows[c].to_numpy().astype(float) for c in ("toxic", "unfit"))
    lists = [np.asarray(x, np.int64).view(np.uint64) for x in rows["tokens"].to_numpy()]
    counts = [np.asarray(x, float) for x in rows["counts"].to_numpy()]
    targets = dict(zip(CATEGORIES, (unfit, unfit * toxic, toxic), strict=True))
    of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    x = chain.features(np.concatenate([*lists, np.zeros(0, np.uint64)]), of, len(lists), np.concatenate([*counts, np.zeros(0)]))
    fold = np.arange(len(lists)) % FOLDS
    weights, before = [], np.zeros((len(lists), 0))
    for y in targets.values():
        a = np.column_stack([x, before])
        weights.append(fit(a, y))
        out = np.zeros(len(y))
        for f in range(FOLDS):
            out[fold == f] = predict(fit(a[fold != f], y[fold != f]), a[fold == f])
        before = np.column_stack([before, logit(out)])
    return Chain(chain.vocabulary, weights, len(chain.vocabulary) > 0 and 0 < toxic.sum() < len(toxic))


def model(docs: DataFrame, labels: DataFrame) -> Chain:
    sample = scratch.save(labelled(docs, labels), "labelled")
    chain = train(sample)
    scratch.drop(sample)
    return chain


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id, p_unfit, p_toxic_unfit, p_toxic, toxic``, one row for each row of ``docs``."""
    names = ["doc_id", *(f"p_{c}" for c in CATEGORIES), "toxic"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, flags = chain.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in p.T.copy()), pa.array(flags)], names)

    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(apply, schema)


def clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` without the toxic documents."""
    at = docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~chain.score(batch.column(at))[1]))

    return docs.mapInArrow(apply, docs.schema)
