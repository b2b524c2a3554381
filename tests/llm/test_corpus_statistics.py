"""Filter audit, spelling variants and language-model scores against plain Python, and their defined cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import audit, lm, queries, spelling
from tests.llm.test_edges import CLASHES, DOCS, ROWS

LABELS = "doc_id long, quality int, toxic int"
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES + ["mask", "n", "word", "run", "h", "key", "near", "chunk", "text_id", "good", "part", "step"])]).cache()


def random_docs(seed, n=120):
    """Texts of few words, so that they repeat, and with every mark that a filter looks for."""
    rng, words, rows = random.Random(seed), ["alpha", "alpine", "Beta", "betas", "GAMMA", "delta#", "x$", "word", "words", "wird", "wörd", "élan", "élans"], []
    for i in range(n):
        text = rng.choice([None, "", rows[-1][1] if rows else "", " ".join(rng.choices(words[: rng.randrange(2, len(words))], k=rng.choice([1, 3, 30, 250])))])
        rows.append((rng.choice([None, i, i, i, i // 2]), text, rng.choice(["en", "de", "", None]), "s", 0))
    return rows


# ---- audit ----


def fails(text, doc_id, least):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    out = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)) + "D" * bool(set("#$%&*|") & set(text))
    return out + "E" * (doc_id is not None and least.get(text, doc_id) < doc_id)


def brute_audit(rows, labels):
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    good, toxic = ({d for d, *v in labels if v[i] == 1 and d is not None} for i in (0, 1))
    out = defaultdict(lambda: [0] * 6)
    for d, t, lang, *_ in rows:
        bad = fails(t or "", d, least)
        for o in permutations("ABCDE"):
            for i, f in enumerate(o):
                r, gone = out[lang or "", "".join(o), i + 1], any(x in bad for x in o[:i])
                here = f in bad and not gone
                for at, x in enumerate((f not in bad and not gone, here, f in bad and gone, bad == f, here and d in good, here and d in toxic)):
                    r[at] += x
    shapley = Counter()
    for (part, o, i), r in out.items():
        shapley[part, o[i - 1]] += r[1]
    return {k: (*r, shapley[k[0], k[1][k[2] - 1]]) for k, r in out.items()}


def as_audit(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_against_every_order(spark):
    rows = random_docs(5)
    labels = [(i, random.Random(i).choice([0, 1, None]), i % 3 % 2) for i in range(0, 110, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    got = as_audit(audit.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)))
    assert got == brute_audit(rows, labels)
    assert len(got) == 3 * 600


def test_audit_defined_cases(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], LABELS).withColumns({"good": F.lit(1), "text": F.lit("x"), "l_id": F.lit(3)})
    assert as_audit(audit.audit(docs, labels)) == brute_audit(ROWS, [(1, 1, 0), (2, 1, 1)])
    assert audit.audit(docs.limit(0), labels).count() == 0
    alone = as_audit(audit.audit(docs, labels.limit(0)))
    assert alone.keys() == brute_audit(ROWS, []).keys() and not any(v[4] or v[5] for v in alone.values())


def test_audit_has_one_small_task_for_copies(spark):
    """A third of the rows are one text: they meet as one row for each part and label."""
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    got = {(r.mask, r.n) for r in audit.cells(d, spark.createDataFrame([], LABELS)).collect()}
    assert got == {(1, 2001), (17, 999)}


# ---- spelling ----


def brute_variants(rows, noise=97, min_count=3):
    n = Counter()
    for d, t, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if noise and h % noise == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w in n:
        close = sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v))
        form[w] = close[0] if close and n[close[0]] >= 2 * n[w] else None
        out[w] = len(close)
    for w, c in out.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], c, n.get(form[w]))
    return out


def as_variants(df):
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}
    assert len(out) == df.count()
    return out


@pytest.mark.parametrize("noise", [97, 3, None])
def test_variants_against_all_pairs(spark, noise):
    rng = random.Random(3)
    stems = ["aaaaa", "ababab", "bababa", "hello", "hällo", "straße", "xyxyxyx", "éèéèé"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(12):
            w = list(rng.choice(stems))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = rng.choice([[], ["a"], ["b"], ["x"], ["ä"]])
            words.append("".join(w))
        rows.append((rng.choice([i, None]), rng.choice([" ", "-", "1"]).join(words).title(), "en", "s", 0))
    want = brute_variants(rows, noise)
    assert len(want) > 50 and sum(v[0] is not None for v in want.values()) > 20
    assert as_variants(spelling.variants(spark.createDataFrame(rows, DOCS), noise=noise)) == want


def test_variant_chains_and_ties(spark):
    n = {"aaaaaa": 3, "aaaaab": 6, "aaaabb": 12, "aaabbb": 24, "aabbbb": 48, "abbbbb": 96, "bbbbbb": 192, "zzzzza": 8, "zzzzzb": 8, "zzzzzz": 4}
    d = spark.createDataFrame([(1, " ".join(f" {w}" * k for w, k in n.items()))], "doc_id long, text string")
    got = as_variants(spelling.variants(d, noise=None))
    assert {w: v[1] for w, v in got.items()} == {w: "bbbbbb" if w[0] != "z" else "zzzzza" if w == "zzzzzz" else w for w in n}
    assert got["zzzzzz"] == ("zzzzza", "zzzzza", 4, 2, 8) and got["zzzzza"][0] is None


def test_variant_defined_cases(spark, docs):
    assert as_variants(spelling.variants(docs)) == brute_variants(ROWS)
    assert spelling.variants(docs.limit(0)).count() == 0


def test_each_link_is_found_once(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("ab", k=rng.randrange(5, 9))) for _ in range(300)})
    pairs = spelling.near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).select("word", "near").collect()
    assert len(pairs) == len(set(pairs)) and {(b, a) for a, b in pairs} == set(map(tuple, pairs))


def test_variants_broadcast_nothing(spark, monkeypatch):
    """The size that Spark expects of a saved table says little of its deletions, so no join may go by it."""
    plans, save = [], spelling.scratch.save
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(spelling.scratch, "save", lambda df, *a, **b: plan(df) or save(df, *a, **b))
    d = spark.createDataFrame([(1, "aaaaaa " * 3 + "aaaaab " * 6 + "aaaabb " * 12)], "doc_id long, text string")
    plan(spelling.variants(d, noise=None))
    assert sum(p.count("SortMergeJoin") for p in plans) >= 4 and not any("Broadcast" in p for p in plans)


# ---- language model ----


def brute_scores(rows, order):
    kinds, texts = [], []
    for d, t, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        texts.append([w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + [None])
        kinds.append(zlib.crc32(("" if d is None else str(d)).encode()) % 7)

    def grams(text, k):  # (n-gram, its context) for each place, None where the context would begin before the boundary
        full = [None, *text]
        return [tuple(full[i + 2 - k : i + 2]) if i >= k - 2 else None for i in range(len(text))]

    def counted(of):
        c = [Counter(g for t, x in zip(texts, kinds, strict=True) if of(x) for g in grams(t, k) if g) for k in range(1, order + 1)]
        return c, sum(c[0].values()), sum(of(x) for x in kinds)

    everything, rest = counted(lambda x: x != 2), counted(lambda x: x not in (2, 3))
    v = len(everything[0][0])

    def steps(text, counts, n, n_texts, weights):
        """For each token: (estimate, bucket, probability of the lower order) by order, and the probability."""
        out, own = [], [grams(text, k) for k in range(1, order + 1)]
        for i in range(len(text)):
            p, rungs = 1 / (v + 1), []
            for k in range(1, order + 1):
                g = own[k - 1][i]
                context = n if k == 1 else 0 if g is None else n_texts if k == 2 and i == 0 else counts[k - 2][g[:-1]]
                f = counts[k - 1][g] / context if context else 0.0
                b = -1 if not context else 0 if k == 1 else int(math.log2(context))
                rungs.append((f, b, p))
                if k <= len(weights):
                    m = weights[k - 1][b] if b >= 0 else 0.0
                    p = m * f + (1 - m) * p
            out.append((rungs, p))
        return out

    weights = []
    for k in range(order):
        seen = defaultdict(list)
        for t, x in zip(texts, kinds, strict=True):
            if x == 3:
                for rungs, _ in steps(t, *rest, weights):
                    f, b, p = rungs[k]
                    if b >= 0:
                        seen[b].append(f / p)
        own, last = [], 0.5
        for b in range(64):
            if b in seen:
                last = 0.5
                for _ in range(500):
                    last = (0.5 + sum(last * r / (last * r + 1 - last) for r in seen[b])) / (1 + len(seen[b]))
            own.append(last)
        weights.append(own)
    c, n, n_texts = everything
    out = []
    for (d, *_), t, x in zip(rows, texts, kinds, strict=True):
        out.append((d, x == 2, len(t), sum(c[0][w,] > 0 for w in t), n, sum(math.log10((c[0][w,] + 1) / (n + v + 1)) for w in t), sum(math.log10(p) for _, p in steps(t, c, n, n_texts, weights))))
    return out, weights


def prose(seed, n):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words, w = [], "the"
        for _ in range(rng.choice([0, 1, 2, 20, 60])):
            w = rng.choice({"the": ["cat", "dog", "THE", "end."], "cat": ["sat", "ran"], "dog": ["sat"], "sat": ["on", "by"], "on": ["the"], "by": ["the"]}.get(w.lower(), ["the", f"w{rng.randrange(60)}"]))
            words.append(w)
        rows.append((rng.choice([i, i, i, None]), rng.choice([None, *["\t ".join(words)] * 6]), "en", "s", 0))
    return rows


@pytest.mark.parametrize("order,chunk_bytes", [(1, 1 << 20), (2, 1 << 20), (2, 700), (3, 2000)])
def test_scores_against_plain_loops(spark, order, chunk_bytes):
    rows = prose(order, 150)
    want, weights = brute_scores(rows, order)
    found = lm.resolved(spark.createDataFrame(rows, DOCS), order, chunk_bytes).cache()
    model = lm.learn(found, order)
    for a, b in zip(model.weights, weights, strict=True):
        assert np.abs(a - b).max() < 0.01  # EM has the mean of each 1/16 octave of ratios
    model.weights = [np.array(w) for w in weights]
    got = [tuple(r) for r in lm.scores(found, model, order).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_probabilities_sum_to_one(spark):
    """Over all training words, the end and one unknown word, after every context."""
    found = lm.resolved(spark.createDataFrame(prose(9, 100), DOCS), 2, 1 << 20).cache()
    model = lm.learn(found)
    texts = [(" ".join(t.lower().split()) if t else "").split() for _, t, *_ in prose(9, 100)]
    known = {w for d, t in zip(prose(9, 100), texts, strict=True) if zlib.crc32(("" if d[0] is None else str(d[0])).encode()) % 7 != 2 for w in t}
    assert model.types == len(known) + 1
    uni, bi = Counter(), Counter()
    for d, t in zip(prose(9, 100), texts, strict=True):
        if zlib.crc32(("" if d[0] is None else str(d[0])).encode()) % 7 != 2:
            uni.update([*t, None])
            bi.update(zip([None, *t], [*t, None], strict=True))
    for context in [*known, None]:
        words = [*known, None, "never seen"]
        p = []
        for w in words:  # as the second token of a text, or as its first
            counts = [np.array([uni[context], uni[w]]), np.array([0, bi[context, w]])] if context is not None else [np.array([uni[w]]), np.array([bi[None, w]])]
            p.append(model.probabilities(counts, np.array([len(counts[0])]))[-1])
        assert sum(p) == pytest.approx(1.0)


def test_packing(spark):
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 1000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        lowest, first = lm._slices(keys, 7)
        back = [lm._unpack_keys(lm._pack_keys(keys[first[i] : first[i + 1]], lowest[i]), lowest[i]) for i in range(7)]
        assert (np.concatenate(back) == keys).all()
        counts = rng.choice([0, 1, 254, 255, 256, 2**40], n)
        assert (lm._unpack_counts(lm._pack_counts(counts), n) == counts).all()


def test_score_defined_cases(spark, docs):
    want, _ = brute_scores(ROWS, 2)
    got = {(r.doc_id, r.n_tokens): r for r in lm.score_documents(docs).collect()}
    assert len(want) == lm.score_documents(docs, chunk_bytes=50_000).count() == len(ROWS)
    for d, held, n, known, total, base, _ in want:
        r = got[d, n]
        assert (r.held_out, r.n_known, r.train_tokens) == (held, known, total) and r.base_score == pytest.approx(base) and math.isfinite(r.score)
    assert lm.score_documents(docs.limit(0)).count() == 0
    only_held_out = docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")
    assert all(r.base_score == r.score == 0 for r in lm.score_documents(only_held_out).collect())


def test_scores_of_documents_not_learnt_from(spark):
    held = [r for r in queries.op13_lm_scoring(spark, SF).collect() if r.held_out]
    assert len(held) > 100 and sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)
    assert sum(r.score > r.base_score for r in held) > 0.9 * len(held)
