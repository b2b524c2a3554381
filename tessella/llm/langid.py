"""Language identification in two steps: the family, then the language within it.

Features are hashed counts of byte pairs and triples of letters (other characters are one space), as square roots of
their shares. A one-against-rest linear support vector machine chooses the family. Within a family every pair of
languages has a linear support vector machine of its own; the language with most pairs wins, ties by summed margins.

Training uses about MAX_ROWS different labelled texts in all, or MIN_EACH of every language if that is more, chosen by a
digest of the text, which is a bound on what reaches the driver; prediction reads every whole text. Only text and lang of the rows for which
``learn`` holds are learnt from.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows with a null lang or id are not learnt
from, and are predicted like others (held_out false for a null id); with one language all texts with letters get it,
with none all are ``und``; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.textvec import chunks

# Families of languages, by ISO 639-1 codes. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk uz ky tt",
    "indic": "hi bn ur pa mr gu ne si",
    "iranian": "fa ps ku tg",
    "semitic": "ar he mt am",
    "malay": "id ms tl jv su",
    "chinese": "zh yue",
    "dravidian": "ta te kn ml",
}
WIDTH_BITS = 11
WIDTH = 1 << WIDTH_BITS
MAX_ROWS, MIN_EACH = 4_000, 20
NONE = "und"

_SHAPE = np.full(256, 32, np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_SHAPE[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_SHAPE[128:] = np.arange(128, 256)


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), lang)


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the first text, unit rows of a run of texts)."""
    for first, data, offsets in chunks(column, most=256):
        n = len(offsets) - 1
        b = _SHAPE[data].astype(np.uint32)
        of = np.repeat(np.arange(n), np.diff(offsets))
        out = np.zeros(n * WIDTH)
        for k in (2, 3):
            if len(b) < k:
                continue
            code = b[: len(b) - k + 1].copy()
            for i in range(1, k):
                code = code * np.uint32(256) + b[i : len(b) - k + 1 + i]
            cell = (code * np.uint32(2654435761) + np.uint32(k * 40503)) * np.uint32(2246822519) >> np.uint32(32 - WIDTH_BITS)
            inside = (of[: len(code)] == of[k - 1 :]) & ~((b[: len(code)] == 32) & (b[k - 1 :] == 32))
            out += np.bincount(of[: len(code)][inside] * WIDTH + cell[inside], minlength=n * WIDTH)
        x = np.sqrt(out.reshape(n, WIDTH))
        yield first, x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the intercept of a squared-hinge machine for labels -1 and 1, by dual coordinate descent."""
    a = np.column_stack([x, np.ones(len(x))])
    w, alpha, diagonal = np.zeros(a.shape[1]), np.zeros(len(y)), 0.5 / c
    q = (a * a).sum(axis=1) + diagonal
    rng = np.random.default_rng(5)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (a[i] @ w) - 1 + diagonal * alpha[i]
            new = max(alpha[i] - g / q[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * a[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w


def _margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


class Identifier:
    """Trained on rows ``x`` with labels ``langs``."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        y = np.array(langs, dtype=object)
        self.langs = sorted(set(langs))
        self.families = sorted({family(g) for g in self.langs})
        of = np.array([family(g) for g in langs], dtype=object)
        self.of = {f: [g for g in self.langs if family(g) == f] for f in self.families}
        several = len(self.families) > 1
        self.family_w = np.array([svm(x, np.where(of == f, 1.0, -1.0)) for f in self.families]) if several else None
        self.pair_w = {}
        for members in self.of.values():
            for a, b in combinations(members, 2):
                rows = (y == a) | (y == b)
                self.pair_w[a, b] = svm(x[rows], np.where(y[rows] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(languages, scores in (0, 1])."""
        n = len(x)
        share = np.ones((n, len(self.families)))
        if self.family_w is not None:
            z = np.exp(3 * np.clip(x @ self.family_w[:, :-1].T + self.family_w[:, -1], -8, 8))
            share = z / z.sum(axis=1, keepdims=True)
        chosen = share.argmax(axis=1)
        lang, score = np.empty(n, object), share.max(axis=1)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(chosen == k)
            members = self.of[f]
            if not len(rows):
                continue
            place = {g: i for i, g in enumerate(members)}
            votes, margins, sure = np.zeros((3, len(rows), len(members)))
            for a, b in combinations(members, 2):
                m = _margin(x[rows], self.pair_w[a, b])
                p = 1 / (1 + np.exp(-3 * np.clip(m, -8, 8)))
                for g, won, v, s in ((a, m >= 0, m, p), (b, m < 0, -m, 1 - p)):
                    votes[:, place[g]] += won
                    margins[:, place[g]] += v
                    sure[:, place[g]] += s
            best = np.lexsort((margins.T, votes.T), axis=0)[-1] if len(members) > 1 else np.zeros(len(rows), int)
            lang[rows] = np.array(members, dtype=object)[best]
            if len(members) > 1:
                score[rows] *= sure[np.arange(len(rows)), best] / (len(members) - 1)
        return lang, np.clip(score, 0, 1)


def held_out(doc_id: Column) -> Column:
    """Of every five ids, by their digest, one is not learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [x for _, x in features(batch.column(1))]
        flat = np.concatenate([*found, np.zeros((0, WIDTH))]).astype(np.float32)
        ends = np.arange(0, flat.size + 1, WIDTH, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))], ["lang", "x"])


def train(docs: DataFrame, learn: Column, most: int = MAX_ROWS) -> Identifier | None:
    """An identifier, or None if nothing can be learnt."""
    usable = docs.filter(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    texts = usable.select("lang", F.xxhash64("text").alias("t")).distinct()  # what is drawn from, so that copies don't thin a language out
    counts = {r[0]: r[1] for r in texts.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(MIN_EACH, most // len(counts))
    limits = F.create_map(*[F.lit(x) for g, n in sorted(counts.items()) for x in (g, min(1 << 30, int((1 << 30) * each / n)))])
    chosen = usable.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.element_at(limits, F.col("lang"))).distinct()  # copies once
    sample = chosen.mapInArrow(_rows, "lang string, x array<float>").toArrow()
    if not sample.num_rows:
        return None
    x = sample["x"].combine_chunks().values.to_numpy().reshape(-1, WIDTH).astype(float)
    langs = sample["lang"].to_pylist()
    order = sorted(range(len(langs)), key=lambda i: (langs[i], x[i].tobytes()))
    return Identifier(x[order], [langs[i] for i in order])


def identify(docs: DataFrame, learn: Column | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, one row for each row of ``docs``."""
    out = held_out(F.col("doc_id"))
    known = train(docs, ~out if learn is None else learn)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lang, score = np.full(n, NONE, object), np.zeros(n)
            letters = pc.match_substring_regex(batch.column(2), r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
            if known is not None:
                for first, x in features(batch.column(2)):
                    lang[first : first + len(x)], score[first : first + len(x)] = known.predict(x)
            lang[~letters], score[~letters] = NONE, 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    columns = docs.select(F.col("doc_id").cast("long"), out.alias("held_out"), F.col("text").cast("string"))
    return columns.mapInArrow(apply, "doc_id long, held_out boolean, lang_pred string, score double")
