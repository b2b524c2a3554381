"""Language-model scores of documents by deleted interpolation.

The probability of a token after its context mixes maximum-likelihood estimates of all orders up to ``order``:

    P1(w) = m c(w) / N + (1 - m) / (V + 1)
    Pk(w | h) = m_b c(h w) / c(h) + (1 - m_b) P(k-1)(w | h without its first token)

where b is the bucket of the context's frequency, ``floor(log2 c(h))``; a context never seen has weight 0. A text is its
words and one end; its first token follows an end too, and longer contexts begin there. The last term of P1 is a word
that no training document holds, so probabilities sum to one.

The weights m are learnt on held-out counts: of the training documents, those with ``crc32(doc_id) mod 7 = DELETED`` are
set aside, counts of the others give the estimates, and expectation-maximisation finds the weights under which the set
aside texts are most likely, order by order. What EM needs of a token is its bucket and the ratio of its estimate to the
lower order's probability; Spark sums up tokens and ratios by bucket and step of 1/16 octave, a table of bounded size
for any corpus. Scores then use the counts of all training documents.

How counts reach the tokens: documents are dealt to chunks of about ``chunk_bytes`` of text by the hash of the row. A
chunk counts its own n-grams and sends them, in order and packed, to as many ranges of hashes as there are chunks. A
range adds up what all chunks sent it and returns each chunk's counts in the order in which they came. So a range has
about as many n-grams as a chunk, neither vocabulary nor n-grams are ever in one place, none is pruned, texts are
shuffled once, and a frequent word or passage costs each chunk one entry.

N-grams are compared as 64-bit hashes. Defined cases: a null text is empty, and scored as one end; a null id is hashed
as an empty string, so its document is learnt from; rows that repeat an id are documents of their own; without training
documents every token has probability 1, without set-aside ones every weight is 1/2; an empty table gives an empty
result. Other columns are ignored, whatever their names. Rows that agree in id and text share a chunk.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import scratch, textvec

FOLDS, HELD_OUT, DELETED = 7, 2, 3
ORDER = 2
CHUNK_BYTES = 12 << 20
MIN_PARTS = 32
#: Steps of an octave by which EM tells ratios apart; it counts ratios from 2^-RANGE to 2^RANGE.
STEPS, RANGE = 16, 80
UNSEEN = -1
MAX_ROUNDS, TOLERANCE = 500, 1e-9
END = np.uint64(0xA24BAED4963EE407)


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _tokens(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, ends included; number of tokens of each text)."""
    found, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part in column.chunks:
        for _, data, offsets in textvec.chunks(part):
            h, at = textvec.words(data, offsets)
            found.append(np.insert(h, at[1:], END))
            sizes.append(np.diff(at) + 1)
    return np.concatenate(found), np.concatenate(sizes)


def _places(sizes: np.ndarray) -> np.ndarray:
    """Each token's place in its text, from 0."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _grams(hashes: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the n-grams of order k, where they end). Below place k - 2 a token has no context of k - 1 tokens."""
    keys = textvec.shingles(np.concatenate([np.full(k - 1, END), hashes]), k)
    ends = np.flatnonzero(_places(sizes) >= k - 2)
    return keys[ends], ends


def _own(hashes: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(distinct keys in order, the key of each n-gram, where each ends)."""
    keys, ends = _grams(hashes, sizes, k)
    return *np.unique(keys, return_inverse=True), ends


def _slices(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(lowest key of each of ``parts`` equal ranges of hashes, index of its first key in ``keys``, and the end)."""
    lowest = np.array([i * 2**64 // parts for i in range(parts)], np.uint64)
    return lowest, np.append(np.searchsorted(keys, lowest), len(keys))


def _pack_keys(keys: np.ndarray, lowest: np.uint64) -> bytes:
    """Keys in order as their distances, in as many bytes as the largest needs."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=lowest)
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack_keys(packed: bytes, lowest: np.uint64) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.uint64)
    wide = np.zeros(((len(packed) - 1) // packed[0], 8), np.uint8)
    wide[:, : packed[0]] = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, packed[0])
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64) + lowest


def _pack_counts(counts: np.ndarray) -> bytes:
    """A byte a count; those from 255 on follow in full. Most are 0 or 1, so the whole is deflated."""
    return zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes(), 1)


def _unpack_counts(packed: bytes, n: int) -> np.ndarray:
    packed = zlib.decompress(packed)
    counts = np.frombuffer(packed, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(packed, "<i8", offset=n)
    return counts


COUNTED = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("rest", pa.binary()), ("aside", pa.binary())])
SUMMED = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("types", pa.int64()), ("rest", pa.binary()), ("aside", pa.binary())])


def _counter(order: int, parts: int):
    def count(chunk: pa.Table) -> pa.Table:
        """A chunk's n-grams and their counts by range of hashes: parts 0 to ``parts - 1`` for words, then for pairs and so on."""
        hashes, sizes = _tokens(chunk["text"])
        kind, number, rows = np.repeat(chunk["kind"].to_numpy(), sizes), chunk["chunk"][0].as_py(), []
        for k in range(1, order + 1):
            keys, which, ends = _own(hashes, sizes, k)
            rest, aside = (np.bincount(which[kind[ends] == i], minlength=len(keys)) for i in (0, 1))
            lowest, first = _slices(keys, parts)
            for i in range(parts):
                at = slice(first[i], first[i + 1])
                rows.append(((k - 1) * parts + i, number, _pack_keys(keys[at], lowest[i]), _pack_counts(rest[at]), _pack_counts(aside[at])))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), COUNTED, strict=True)], schema=COUNTED)

    return count


def _summer(parts: int):
    def add(part: pa.Table) -> pa.Table:
        """For each chunk the counts over all chunks, in the order of its own keys."""
        number = part["part"][0].as_py()
        lowest = np.uint64((number % parts) * 2**64 // parts)
        own = [_unpack_keys(x.as_py(), lowest) for x in part["keys"]]
        keys, which = np.unique(np.concatenate(own), return_inverse=True)
        first = np.cumsum([0, *map(len, own)])
        total = {}
        for name in ("rest", "aside"):
            each = np.concatenate([_unpack_counts(x.as_py(), len(k)) for x, k in zip(part[name], own, strict=True)])
            total[name] = np.zeros(len(keys), np.int64)
            np.add.at(total[name], which, each)
        types = int((total["rest"] + total["aside"] > 0).sum()) if number < parts else 0
        rows = []
        for i, chunk in enumerate(part["chunk"].to_pylist()):
            at = which[first[i] : first[i + 1]]
            rows.append((chunk, number, len(at), types if i == 0 else 0, _pack_counts(total["rest"][at]), _pack_counts(total["aside"][at])))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), SUMMED, strict=True)], schema=SUMMED)

    return add


def _pack_text(counts: np.ndarray) -> bytes:
    """The lowest bytes of all counts, then the next ones, as many as the largest needs."""
    width = max(1, -(-int(counts.max()).bit_length() // 8))
    return counts.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpack_texts(column: pa.Array, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros((int(sizes.sum()), 8), np.uint8)
    first = 0
    for packed, n in zip(column, sizes.tolist(), strict=True):
        planes = np.frombuffer(packed.as_buffer(), np.uint8).reshape(-1, n)
        out[first : first + n, : len(planes)] = planes.T
        first += n
    return out.view("<i8").ravel()


def _resolver(order: int, parts: int):
    def resolve(docs: pa.Table, summed: pa.Table) -> pa.Table:
        hashes, sizes = _tokens(docs["text"])
        kind = docs["kind"].to_numpy()
        summed = summed.sort_by("part")
        n = summed["n"].to_pylist()
        types = np.zeros(len(sizes), np.int64)
        types[:1] = sum(summed["types"].to_pylist())
        out = {"doc_id": docs["doc_id"], "held_out": pa.array(kind == 2), "aside": pa.array(kind == 1), "n_tokens": pa.array(sizes, pa.int64()), "types": pa.array(types)}
        first = np.concatenate([[0], np.cumsum(sizes)])
        for k in range(1, order + 1):
            keys, which, ends = _own(hashes, sizes, k)
            mine = range((k - 1) * parts, k * parts)
            rest, aside = (np.concatenate([_unpack_counts(summed[name][i].as_py(), n[i]) for i in mine]) for name in ("rest", "aside"))
            if len(rest) != len(keys):
                raise ValueError("a chunk's texts changed between two reads")
            both, without = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
            both[ends], without[ends] = (rest + aside)[which], rest[which]
            out[f"c{k}"] = pa.array([_pack_text(both[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
            out[f"r{k}"] = pa.array([_pack_text(without[a:b]) if own == 1 else None for a, b, own in zip(first[:-1], first[1:], kind, strict=True)], pa.binary())
        return pa.table(out)

    return resolve


def resolved(docs: DataFrame, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, held_out, aside, n_tokens, types, c1, r1, c2, r2 ...``, a row for each document.

    ``ck`` has, for each token, the count of the n-gram of order k that ends there in all training documents; ``rk`` the
    count without the set aside documents, and only for these; both are packed. ``types`` sums up to the distinct
    training tokens.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    parts = max(MIN_PARTS, chunks)
    rest = fold(F.col("doc_id"))
    kind = F.when(rest == HELD_OUT, 2).when(rest == DELETED, 1).otherwise(0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), kind.alias("kind"))
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).groupBy("chunk")
    counted = chunked.applyInArrow(_counter(order, parts), "part long, chunk long, keys binary, rest binary, aside binary")
    summed = counted.groupBy("part").applyInArrow(_summer(parts), "chunk long, part long, n long, types long, rest binary, aside binary")
    counts = ", ".join(f"c{k} binary, r{k} binary" for k in range(1, order + 1))
    return chunked.cogroup(summed.groupBy("chunk")).applyInArrow(_resolver(order, parts), f"doc_id long, held_out boolean, aside boolean, n_tokens long, types long, {counts}")


class Model:
    """Weights by order and bucket, and what estimates need besides counts: tokens, types and texts of the training documents."""

    def __init__(self, tokens: int, types: int, texts: int):
        self.tokens, self.types, self.texts, self.weights = tokens, types, texts, []

    def ladder(self, counts: list[np.ndarray], sizes: np.ndarray):
        """For each order: (estimates, buckets of contexts, -1 without one, the probability of the order below)."""
        place = _places(sizes)
        p = np.full(len(place), 1.0 / (self.types + 1))
        for k, c in enumerate(counts, 1):
            if k == 1:
                context = np.full(len(c), self.tokens)
            else:
                context = np.concatenate([[0], counts[k - 2][:-1]])
                context = np.where(place >= 1, np.where(place >= k - 2, context, 0), self.texts if k == 2 else 0)
            estimate = c / np.maximum(context, 1)
            bucket = np.where(context > 0, np.frexp(context.astype(float))[1] - 1 if k > 1 else 0, -1)
            yield estimate, bucket, p
            if k <= len(self.weights):
                m = np.append(self.weights[k - 1], 0.0)[bucket]
                p = m * estimate + (1 - m) * p

    def probabilities(self, counts: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        *_, (estimate, bucket, below) = self.ladder(counts, sizes)
        m = np.append(self.weights[len(counts) - 1], 0.0)[bucket]
        return m * estimate + (1 - m) * below


def weights(counted: list[tuple[int, int, int, float]]) -> np.ndarray:
    """Weights of buckets 0 to 63 by EM on (bucket, step of the ratio or UNSEEN, tokens, sum of their ratios' octaves). A bucket has one token of no
    opinion (half a success of two), and one without tokens takes the weight of the next lower bucket, or 1/2."""
    found = {}
    for b in {at for at, *_ in counted}:
        steps, n, octaves = np.array(sorted(x[1:] for x in counted if x[0] == b), float).T
        ratio = np.where(steps == UNSEEN, 0.0, np.exp2(octaves / n))
        m = 0.5
        for _ in range(MAX_ROUNDS):
            before, m = m, (0.5 + (n * (m * ratio / (m * ratio + 1 - m))).sum()) / (1 + n.sum())
            if abs(m - before) < TOLERANCE:
                break
        found[b] = m
    out, last = np.empty(64), 0.5
    for b in range(64):
        last = out[b] = found.get(b, last)
    return out


def _arrays(batch: pa.RecordBatch, prefix: str, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    at = batch.schema.get_field_index
    sizes = batch.column(at("n_tokens")).to_numpy()
    return [_unpack_texts(batch.column(at(f"{prefix}{k}")), sizes) for k in range(1, order + 1)], sizes


def _pieces(batches, rows: int = 512):
    """Batches of at most so many documents, as their counts are unpacked together."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def learn(found: DataFrame, order: int = ORDER) -> Model:
    """The model of a saved table of ``resolved``."""
    trained = ~F.col("held_out")
    aside = F.col("aside")
    n = found.agg(F.sum(F.when(trained, F.col("n_tokens"))), F.sum("types"), F.count(F.when(trained, 1)), F.sum(F.when(aside, F.col("n_tokens"))), F.count(F.when(aside, 1))).first()
    tokens, types, texts, tokens_aside, texts_aside = (x or 0 for x in n)
    model = Model(tokens, types, texts)
    part = Model(tokens - tokens_aside, types, texts - texts_aside)
    for k in range(1, order + 1):
        texts = found.filter(aside).select("n_tokens", *[f"r{i}" for i in range(1, k + 1)])
        seen = texts.mapInArrow(_ratios(part, k), "bucket int, step int, n long, octaves double").groupBy("bucket", "step").agg(F.sum("n").alias("n"), F.sum("octaves").alias("octaves")).collect()
        part.weights.append(weights([tuple(r) for r in seen]))
    model.weights = part.weights
    return model


def _ratios(part: Model, k: int):
    def count(batches):
        for batch in _pieces(batches):
            counts, sizes = _arrays(batch, "r", k)
            *_, (estimate, bucket, below) = part.ladder(counts, sizes)
            estimate, below, bucket = (x[bucket >= 0] for x in (estimate, below, bucket))
            octaves = np.log2(np.where(estimate > 0, estimate / below, 1.0))
            step = np.where(estimate > 0, np.clip(np.floor((octaves + RANGE) * STEPS), 0, 2 * RANGE * STEPS - 1), UNSEEN).astype(np.int64)
            cells, which, n = np.unique(bucket * (4 * RANGE * STEPS) + step, return_inverse=True, return_counts=True)
            cells = cells - UNSEEN  # so that the unseen of a bucket come first in it
            columns = cells // (4 * RANGE * STEPS), cells % (4 * RANGE * STEPS) + UNSEEN, n, np.bincount(which, octaves)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["bucket", "step", "n", "octaves"])

    return count


def scores(found: DataFrame, model: Model, order: int = ORDER) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` from a table of ``resolved``."""

    def apply(batches):
        for batch in _pieces(batches):
            counts, sizes = _arrays(batch, "c", order)
            first = np.cumsum(sizes) - sizes
            known, base = counts[0] > 0, np.log10((counts[0] + 1) / (model.tokens + model.types + 1))
            score = np.log10(model.probabilities(counts, sizes))
            total = lambda x: pa.array(np.add.reduceat(x, first) if len(first) else x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), total(known.astype(np.int64)), pa.array(np.full(len(sizes), model.tokens), pa.int64()), total(base), total(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    columns = found.select("doc_id", "held_out", "n_tokens", *[f"c{k}" for k in range(1, order + 1)])
    return columns.mapInArrow(apply, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    found = scratch.save(resolved(docs, order, chunk_bytes), "resolved", compression="zstd")
    return scores(found, learn(found, order), order)
