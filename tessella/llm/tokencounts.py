"""Token counts that follow edits.

A text is cut into pre-tokens by the tokenizer's pattern, and byte-pair merges never cross their borders. Each
document keeps a segment tree: leaves are pre-tokens (length, tokens), in buckets; inner nodes hold the sums of characters
and tokens below them. An edit re-encodes only what it touches: cutting starts at a border at least CONTEXT characters
and one pre-token before the edit, and stops at the first border behind the edit that the old text had as well, since
from equal borders before equal texts the pattern goes on alike. The new leaves replace the old ones, and sums are
renewed on the paths above them. Several edits of a text are made in one walk over its leaves, in time linear in the
text and in the edits.

``keep`` writes the leaves of every document as a table, from which ``follow`` makes the trees again, so a batch of edits
re-encodes the regions that it touches and not the corpus; ``count`` does both in one pass.

Vocabularies are files of public tokenizers, named by path; they are read once a Python worker.

Defined cases: a null or empty text has no pre-tokens and 0 tokens; edits that overlap an earlier one, or lie outside
the text, are not applied; a replacement that is null is empty; rows that repeat an id are counted alike, each for
itself; columns other than doc_id, text (and edits) are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that the pattern looks at beyond a pre-token, and leaves a bucket.
CONTEXT, BUCKET = 4, 64
CACHED = 1 << 17


class Tokenizer:
    """Counts tokens of pre-tokens, remembering up to CACHED of them."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= CACHED:
                self.known.clear()
            n = len(self.encoding.encode_ordinary(piece))
            if len(piece) <= 64:
                self.known[piece] = n
        return n

    def full(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


class DocumentTree:
    """The segment tree of one text; ``tokens`` and ``leaves`` are its root's sums."""

    def __init__(self, tokenizer: Tokenizer, text: str, leaves: tuple[list[int], list[int]] | None = None):
        """``leaves``: lengths and counts of the text's pre-tokens, if they are known."""
        self.tokenizer, self.text, self.encoded = tokenizer, text, 0
        if leaves is None:
            pieces = tokenizer.pattern.findall(text)
            leaves = list(map(len, pieces)), list(map(tokenizer.count, pieces))
        self._deal(*leaves)

    def _deal(self, lengths: list[int], counts: list[int]) -> None:
        self.buckets = [(lengths[i : i + BUCKET], counts[i : i + BUCKET]) for i in range(0, len(lengths), BUCKET)]
        self._build()

    def all_leaves(self) -> tuple[list[int], list[int]]:
        return [n for b in self.buckets for n in b[0]], [n for b in self.buckets for n in b[1]]

    def _build(self) -> None:
        self.width = 1 << max(0, len(self.buckets) - 1).bit_length()
        self.nodes = [(0, 0, 0)] * (2 * self.width)
        for i, b in enumerate(self.buckets):
            self.nodes[self.width + i] = self._sums(b)
        for i in range(self.width - 1, 0, -1):
            self.nodes[i] = tuple(map(sum, zip(self.nodes[2 * i], self.nodes[2 * i + 1], strict=True)))

    @staticmethod
    def _sums(bucket: tuple[list[int], list[int]]) -> tuple[int, int, int]:
        return sum(bucket[0]), sum(bucket[1]), len(bucket[0])

    def _renew(self, i: int) -> None:
        at = self.width + i
        self.nodes[at] = self._sums(self.buckets[i])
        while at > 1:
            at //= 2
            self.nodes[at] = tuple(map(sum, zip(self.nodes[2 * at], self.nodes[2 * at + 1], strict=True)))

    @property
    def tokens(self) -> int:
        return self.nodes[1][1]

    @property
    def leaves(self) -> int:
        return self.nodes[1][2]

    def _find(self, at: int) -> tuple[int, int, int]:
        """(bucket, place in it, start) of the leaf that holds character ``at``, by descending through the sums."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.nodes[node][0]:
                start += self.nodes[node][0]
                node += 1
        bucket = min(node - self.width, len(self.buckets) - 1)
        for k, n in enumerate(self.buckets[bucket][0]):
            if at < start + n:
                return bucket, k, start
            start += n
        return bucket, len(self.buckets[bucket][0]), start

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace ``text[start:end]``."""
        shift = len(replacement) - (end - start)
        text = self.text = self.text[:start] + replacement + self.text[end:]
        if not self.buckets:
            self.buckets = [([], [])]
            first, place, border = 0, 0, 0
        else:
            first, place, border = self._find(max(0, start - CONTEXT))
            if place:
                place -= 1
                border -= self.buckets[first][0][place]
            elif (before := next((b for b in range(first - 1, -1, -1) if self.buckets[b][0]), None)) is not None:
                first, place = before, len(self.buckets[before][0]) - 1
                border -= self.buckets[first][0][place]
        # walk over the old leaves and the new cuts side by side
        bucket, k, old_end = first, place, border
        lengths, counts, found = [], [], False
        for m in self.tokenizer.pattern.finditer(text, border):
            lengths.append(m.end() - m.start())
            counts.append(self.tokenizer.count(m.group()))
            if m.end() < start + len(replacement):
                continue
            while old_end < m.end() - shift:
                while k == len(self.buckets[bucket][0]):
                    bucket, k = bucket + 1, 0
                old_end += self.buckets[bucket][0][k]
                k += 1
            if old_end == m.end() - shift and old_end >= end:
                found = True
                break
        if not found:  # the text's end
            bucket, k = len(self.buckets) - 1, len(self.buckets[-1][0])
        self.encoded += len(lengths)
        if bucket == first:
            self.buckets[first][0][place:k] = lengths
            self.buckets[first][1][place:k] = counts
        else:
            self.buckets[first][0][place:] = lengths
            self.buckets[first][1][place:] = counts
            for b in range(first + 1, bucket):
                self.buckets[b] = ([], [])
                self._renew(b)
            self.buckets[bucket] = (self.buckets[bucket][0][k:], self.buckets[bucket][1][k:])
            self._renew(bucket)
        if len(self.buckets[first][0]) > 4 * BUCKET:
            lengths, counts = self.buckets[first]
            self.buckets[first : first + 1] = [(lengths[i : i + BUCKET], counts[i : i + BUCKET]) for i in range(0, len(lengths), BUCKET)]
            self._build()
        else:
            self._renew(first)


    def edit_all(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace several parts, given in order of place in the old text and not overlapping."""
        if len(edits) < 2:
            for e in edits:
                self.edit(*e)
            return
        parts, places, at, moved = [], [], 0, 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            places.append((a + moved, a + moved + len(new)))  # in the new text
            moved += len(new) - (b - a)
            at = b
        text = self.text = "".join([*parts, self.text[at:]])
        lengths, counts = self.all_leaves()
        out_n, out_c = [], []
        k = border = shift = i = 0  # the next old leaf and where it begins, new minus old places, the next edit
        while i < len(edits):
            first, start = k, max(0, edits[i][0] - CONTEXT)
            while k < len(lengths) and border + lengths[k] <= start:
                border += lengths[k]
                k += 1
            if k > first:  # one pre-token more; those before an earlier edit's end are cut anew already
                k -= 1
                border -= lengths[k]
            out_n += lengths[first:k]
            out_c += counts[first:k]
            j, found = i, False
            for m in self.tokenizer.pattern.finditer(text, border + shift):
                out_n.append(m.end() - m.start())
                out_c.append(self.tokenizer.count(m.group()))
                self.encoded += 1
                while j < len(edits) and places[j][1] <= m.end():
                    shift += len(edits[j][2]) - (edits[j][1] - edits[j][0])
                    j += 1
                if j < len(edits) and places[j][0] < m.end():
                    continue  # ends inside a replacement
                while k < len(lengths) and border < m.end() - shift:
                    border += lengths[k]
                    k += 1
                if j > i and border == m.end() - shift:
                    found = True
                    break
            i, k = (j, k) if found else (len(edits), len(lengths))
        self._deal(out_n + lengths[k:], out_c + counts[k:])


def mask_addresses(text: str) -> list[tuple[int, int, str]]:
    """Edits that put ``[mail]`` in place of e-mail addresses, in order."""
    out, at, word = [], text.find("@"), "._%+-"
    while at >= 0:
        a, b = at, at + 1
        while a and (text[a - 1].isalnum() or text[a - 1] in word):
            a -= 1
        while b < len(text) and (text[b].isalnum() or text[b] in ".-"):
            b += 1
        while b > at + 1 and text[b - 1] in ".-":
            b -= 1
        if a < at and "." in text[at:b] and (not out or a >= out[-1][1]):
            out.append((a, b, "[mail]"))
        at = text.find("@", at + 1)
    return out


def applicable(edits: list[tuple[int, int, str]], n: int) -> list[tuple[int, int, str]]:
    """In order of place, without those that overlap an earlier one or lie outside a text of n characters."""
    out, reach = [], 0
    for a, b, new in sorted((e for e in edits if e[0] is not None and e[1] is not None), key=lambda e: (e[0], e[1])):
        if reach <= a <= b <= n:
            out.append((a, b, new or ""))
            reach = b
    return out


_loaded: dict[str, Tokenizer] = {}


def _tokenizer(path: str) -> Tokenizer:
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


RESULT = "doc_id long, n_pretokens long, n_tokens long, n_edits long, n_pretokens_after long, n_tokens_after long, n_reencoded long"


def count(docs: DataFrame, edits: Callable[[str], list] | str = mask_addresses, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of every text before and after its edits, one row for each row of ``docs``.

    ``edits`` is a function of the text, or the name of a column ``array<struct<start, end, text>>`` with positions in
    the text as it was. ``n_reencoded`` is how many pre-tokens the edits had encoded again.
    """
    names = [f.split()[0] for f in RESULT.split(", ")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary)
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                tree = DocumentTree(tokenizer, text)
                own = edits(text) if callable(edits) else [tuple(e.values()) for e in batch.column(2)[i].as_py() or [] if e]
                own = applicable(own, len(text))
                before = tree.leaves, tree.tokens
                tree.edit_all(own)
                rows.append((*before, len(own), tree.leaves, tree.tokens, tree.encoded))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names)

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if not callable(edits):
        columns.append(F.col(edits).alias("edits"))
    return docs.select(*columns).mapInArrow(apply, RESULT)


KEPT = "doc_id long, text string, lengths array<int>, counts array<int>"


def _trees(batches: Iterator[pa.RecordBatch], vocabulary: str, edited: bool) -> Iterator[pa.RecordBatch]:
    tokenizer = _tokenizer(vocabulary)
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py() or ""
            leaves = (batch.column(2)[i].as_py(), batch.column(3)[i].as_py()) if edited else None
            tree = DocumentTree(tokenizer, text, leaves)
            if edited:
                tree.edit_all(applicable([tuple(e.values()) for e in batch.column(4)[i].as_py() or [] if e], len(text)))
            rows.append((tree.text, *tree.all_leaves(), tree.tokens, tree.encoded))
        text, lengths, counts, tokens, encoded = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64())
        columns = [pa.array(c, k) for c, k in zip((text, lengths, counts, tokens, encoded), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "text", "lengths", "counts", "n_tokens", "n_reencoded"])


def keep(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, text, lengths, counts, n_tokens, n_reencoded``: the leaves of every document's tree, to be written as a table."""
    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return columns.mapInArrow(lambda b: _trees(b, vocabulary, False), KEPT + ", n_tokens long, n_reencoded long")


def follow(kept: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``kept`` after a batch of edits ``doc_id, edits`` (one row a document): only the regions touched are encoded again."""
    new = edits.select(F.col("doc_id").alias("_id"), F.col("edits").alias("_edits"))
    rows = kept.join(new, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "lengths", "counts", "_edits")
    return rows.mapInArrow(lambda b: _trees(b, vocabulary, True), KEPT + ", n_tokens long, n_reencoded long")
