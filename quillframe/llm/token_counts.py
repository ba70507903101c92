"""Token counts that follow edits.

A document's pre-tokens are grouped into leaves; a segment tree over the leaves holds characters and tokens per
subtree. An edit re-encodes the leaves it touches, further ones to the left where it lies within a few characters of a
leaf's start (no pre-token decision looks further), and as many to the right as it takes for pre-token boundaries to
fall where they fell before; then the sums above are updated. Counts equal those of encoding the edited text anew.
All scripts are treated so; only a text that holds an added token's string, or a tokenizer that is not a byte-level BPE,
is counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import without
from quillframe.llm.encoding import GROUP_CHARS, Encoder, encoder

LEAF = 64
CONTEXT = 3


class CountTree:
    """Segment tree of one document: leaves of whole pre-tokens, sums of characters and of tokens."""

    def __init__(self, enc: Encoder, text: str, leaf: int = LEAF, known: tuple[list[str], np.ndarray] | None = None):
        """``known``: the text's pre-tokens and their counts, where they are at hand."""
        self.enc, self.leaf, self.encoded = enc, leaf, 0
        self.context = max([CONTEXT, *map(len, enc.added)])
        self.pieced = known is not None or enc.pieced(text)
        self.whole = None if self.pieced else text
        self._build(text, known)

    def _build(self, text: str, known: tuple[list[str], np.ndarray] | None = None) -> None:
        if not self.pieced:
            self.whole, self.texts = text, []
            self.chars = self.tokens = np.zeros(2, np.int64)
            self.size, self.whole_tokens = 1, len(self.enc.encode(text)) // self.enc.dtype.itemsize
            self.encoded += len(text)
            return
        if known is None:
            words = self.enc.split(text)
            sizes = self.enc.counts(words)
        else:
            words, sizes = known
        self.texts = ["".join(words[i : i + self.leaf]) for i in range(0, len(words), self.leaf)]
        n = max(1, len(self.texts))
        self.size = 1 << (n - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        if words:
            self.chars[self.size : self.size + n] = [len(t) for t in self.texts]
            self.tokens[self.size : self.size + n] = np.add.reduceat(sizes, np.arange(0, len(words), self.leaf))
        level = self.size
        while level > 1:  # parents of one level from the pairs below
            half = level // 2
            for tree in (self.chars, self.tokens):
                tree[half:level] = tree[level : 2 * level : 2] + tree[level + 1 : 2 * level : 2]
            level = half

    @property
    def total(self) -> int:
        return int(self.tokens[1]) if self.pieced else self.whole_tokens

    @property
    def text(self) -> str:
        return "".join(self.texts) if self.pieced else self.whole

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and that leaf's first character."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at >= before + self.chars[node]:
                before += int(self.chars[node])
                node += 1
        return min(node - self.size, max(len(self.texts) - 1, 0)), before

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        node = leaf + self.size
        self.chars[node], self.tokens[node] = len(text), tokens
        node //= 2
        while node:
            for tree in (self.chars, self.tokens):
                tree[node] = tree[2 * node] + tree[2 * node + 1]
            node //= 2

    def edit(self, start: int, end: int, replacement: str) -> int:
        """Replace characters [start, end) (clipped to the text); returns the new count."""
        size = int(self.chars[1]) if self.pieced else len(self.whole)
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        if not self.pieced or not self.texts:
            return self._anew(self.text[:start] + replacement + self.text[end:])
        first, base = self._find(min(start, size - 1))
        last, before = self._find(min(end, size - 1))
        while first and start - base < self.context:
            first -= 1
            base -= len(self.texts[first])
        while last + 1 < len(self.texts) and before + len(self.texts[last]) - end < self.context:
            before += len(self.texts[last])
            last += 1
        old = "".join(self.texts[first : last + 1])
        new = old[: start - base] + replacement + old[end - base :]
        if not self.enc.pieced(new):
            return self._anew(self.text[:start] + replacement + self.text[end:])
        while True:
            ahead = self.texts[last + 1] if last + 1 < len(self.texts) else ""
            words, at, kept = self.enc.split(new + ahead), 0, []
            for w in words:
                if at >= len(new):
                    break
                kept.append(w)
                at += len(w)
            if at == len(new) or not ahead:
                break
            last += 1
            new += ahead
        self.encoded += len(new)
        if len(kept) > 8 * self.leaf * (last - first + 1):  # leaves grew out of measure: build the tree anew
            self._build("".join(self.texts[:first]) + new + "".join(self.texts[last + 1 :]))
            return self.total
        per = -(-len(kept) // (last - first + 1)) or 1
        sizes = self.enc.counts(kept)
        for i in range(first, last + 1):
            a, z = (i - first) * per, (i - first + 1) * per
            self._set(i, "".join(kept[a:z]), int(sizes[a:z].sum()))
        return self.total

    def _anew(self, text: str) -> int:
        self.pieced = self.enc.pieced(text)
        if self.pieced:
            self.encoded += len(text)
        self._build(text)
        return self.total

    def _start(self, leaf: int) -> int:
        node, before = leaf + self.size, 0
        while node > 1:
            if node & 1:
                before += int(self.chars[node - 1])
            node //= 2
        return before


def _trees(enc: Encoder, texts: list[str]) -> Iterator[CountTree]:
    """The texts' trees; pre-tokens of about ``GROUP_CHARS`` characters are counted together."""
    held: list[tuple[str, list[str] | None]] = []
    chars = 0

    def built() -> Iterator[CountTree]:
        sizes = enc.counts([w for _, words in held for w in words or ()])
        at = 0
        for text, words in held:
            n = len(words or ())
            yield CountTree(enc, text, known=None if words is None else (words, sizes[at : at + n]))
            at += n

    for text in texts:
        held.append((text, enc.split(text) if enc.pieced(text) else None))
        chars += len(text)
        if chars > GROUP_CHARS:
            yield from built()
            held, chars = [], 0
    yield from built()


def _run(vocabulary: str, text_at: int, edits_at: int, keep: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            before, after, again = [], [], []
            texts = [t or "" for t in batch.column(text_at).to_pylist()]
            for tree, edits in zip(_trees(enc, texts), batch.column(edits_at), strict=True):
                before.append(tree.total)
                tree.encoded = 0
                for e in edits.as_py() or []:
                    if e is not None:
                        tree.edit(e["start"] or 0, e["end"] or 0, e["replacement"] or "")
                after.append(tree.total)
                again.append(tree.encoded)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(keep)], *[pa.array(x, pa.int64()) for x in (before, after, again)]], names=[*names, "n_tokens", "n_tokens_edited", "chars_reencoded"])

    return run


def count_edited(docs: DataFrame, edits, *, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` less its text, with ``n_tokens``, ``n_tokens_edited`` and ``chars_reencoded``.

    ``edits`` is a column, array<struct<start: int, end: int, replacement: string>>, applied in order; places are
    characters of the text as edited so far, clipped to it. Defined cases: a null text is empty, a null array is no
    edit, null fields are 0 or empty; texts that hold an added token's string are encoded whole; an empty table gives no
    rows; input columns named like an added column are replaced.
    """
    docs = without(docs, "n_tokens", "n_tokens_edited", "chars_reencoded", "__qf_edits")
    kept = [c for c in docs.columns if c != text_col]
    sent = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("__qf_text"), edits.alias("__qf_edits"))
    schema = sent.schema[: len(kept)].add("n_tokens", "long").add("n_tokens_edited", "long").add("chars_reencoded", "long")
    return sent.mapInArrow(_run(vocabulary, len(kept), len(kept) + 1, len(kept), kept), schema)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts of every document, before and after three edits: a cut near its start, a replacement in its middle and
    an addition at its end."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    half = (F.length("text") / 2).cast("int")
    edit = lambda a, b, text: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), text.alias("replacement"))
    edits = F.array(
        edit(F.lit(2), F.lit(9), F.lit("")),
        edit(half, half + 12, F.concat(F.lit("ly, "), F.coalesce("lang", F.lit("")))),
        edit(F.length("text") + 100, F.length("text") + 100, F.lit("\nEnd of text.")),
    )
    return count_edited(docs.select("doc_id", "text", "lang"), edits, vocabulary=public_tokenizers.path("byte_bpe_50k.json")).drop("lang")
