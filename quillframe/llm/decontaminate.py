"""Benchmark decontamination: passages within a small edit distance of a benchmark item.

* A q-gram count, which loses nothing, marks stretches of a document that can hold an item.
* Item-sized windows at word starts there are embedded by CGK random walks, which turn edit distance into Hamming
  distance; bit-sampling LSH over the embeddings, repeated with fresh walks, retains a window if it meets its item in
  any table. With the defaults (24 walks of 4 tables of 4 samples) recall is over 0.99 at the largest distance.
* Retained windows are verified by exact edit distance, free at both ends of a stretch somewhat larger than the item.
* Items under 32 folded bytes are looked up as they stand, at word boundaries.

Texts are compared in lower-cased ASCII with white space runs as one blank.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import MIX_A, MIX_B, column_bytes, mix64, utf8

GRAM = 8
WALKS, TABLES, SAMPLES = 24, 4, 4
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_FILTER_BITS = 22
#: Letters of scripts without blanks between words: Thai, Lao, Myanmar, Khmer, Chinese, Japanese.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u312f\u31a0-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normalised(data: np.ndarray) -> np.ndarray:
    b = _FOLD[data]
    if len(b) < 2:
        return b
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    return b[keep]


def _grams(b: np.ndarray) -> np.ndarray:
    n = len(b) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    return np.ndarray((n,), np.dtype("<u8"), padded.data, 0, (1,)) * MIX_A


def edit_distance_within(pattern: bytes, text: bytes, most: int) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any substring of ``text`` and that substring's end (bit-parallel);
    ``most + 1`` if none is within ``most``."""
    m = len(pattern)
    where: dict[int, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = ones, 0, m, most + 1, -1
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        x = eq | vn
        d0 = (((eq & vp) + vp) ^ vp) | x
        hp = vn | (ones & ~(d0 | vp))
        hn = vp & d0
        score += bool(hp & top) - bool(hn & top)
        hp, hn = (hp << 1) & ones, (hn << 1) & ones
        vp, vn = hn | (ones & ~(d0 | hp)), hp & d0
        if score < best:
            best, end = score, j + 1
    return best, end


_BITS: dict[tuple[int, int], np.ndarray] = {}


def _steps(walks: int, length: int) -> np.ndarray:
    """Bit per (step, walk, letter): whether the walk moves on after reading that letter. Made once per worker."""
    if (walks, length) not in _BITS:
        seed = mix64(np.arange(1, walks + 1, dtype=np.uint64) * MIX_B)[None, :, None]
        letter = np.arange(256, dtype=np.uint64)[None, None, :] * MIX_A
        step = mix64(np.arange(1, length + 1, dtype=np.uint64) * MIX_A)[:, None, None]
        _BITS[walks, length] = (mix64((seed + letter) ^ step) >> np.uint64(63)).astype(np.uint8)
    return _BITS[walks, length]


def cgk(windows: np.ndarray, sizes: np.ndarray, walks: int) -> np.ndarray:
    """Embeddings of padded byte rows, (rows, walks, 2 * width): that part of the 3 * width steps which is sampled.
    A walk past the row's end reads 0."""
    n, width = windows.shape
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint8)], 1)
    padded[np.arange(n), sizes] = 0
    bits = _steps(walks, 2 * width)
    at = np.zeros((n, walks), np.int64)
    row, each, last = np.arange(n)[:, None], np.arange(walks)[None, :], sizes[:, None]
    out = np.empty((2 * width, n, walks), np.uint8)
    for j in range(2 * width):
        c = padded[row, at]
        out[j] = c
        at += bits[j][each, c]
        np.minimum(at, last, out=at)
    return np.moveaxis(out, 0, 2)


def _samples(width: int, walks: int, tables: int, samples: int) -> np.ndarray:
    seed = np.arange(walks * tables * samples, dtype=np.uint64) + np.uint64(width << 20)
    return (mix64((seed + np.uint64(1)) * MIX_A) % np.uint64(2 * width)).astype(np.int64).reshape(walks, tables, samples)


class Items:
    """Benchmark items: folded bytes, allowed distances and the q-gram index."""

    def __init__(self, items: list[tuple[int, str]], ratio: float):
        folded = [(i, normalised(np.frombuffer(utf8(t).strip(), np.uint8))) for i, t in items]
        short = [(i, b) for i, b in folded if 0 < len(b) < 4 * GRAM]
        folded = [(i, b) for i, b in folded if len(b) >= 4 * GRAM]
        self.ids = [i for i, _ in folded]
        self.bytes = [b for _, b in folded]
        self.most = [int(ratio * len(b)) for b in self.bytes]
        self.need = np.array([max(1, len(b) - GRAM + 1 - GRAM * e) for b, e in zip(self.bytes, self.most, strict=True)] or [1])
        grams = [_grams(b) for b in self.bytes]
        key = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*[np.arange(len(g)) for g in grams], np.zeros(0, int)]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.place = key[order], item[order], place[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.key >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        # few width classes: the largest width and the smallest need of items of about one size
        self.spans: list[tuple[int, int]] = []
        sized = sorted((len(b) + e, int(n)) for b, e, n in zip(self.bytes, self.most, self.need[: len(self.bytes)], strict=True))
        while sized:
            inside = [x for x in sized if x[0] <= 1.3 * sized[0][0]]
            self.spans.append((inside[-1][0], min(n for _, n in inside)))
            sized = sized[len(inside) :]
        self._held: dict[int, np.ndarray] = {}
        # short items by their bytes, and the sizes to try at a place by the item's first bytes (8, or all it has)
        self.short: dict[bytes, list[int]] = {}
        self.sizes: dict[bytes, set[int]] = {}
        for i, b in short:
            self.short.setdefault(b.tobytes(), []).append(len(self.ids))
            self.sizes.setdefault(b[:GRAM].tobytes(), set()).add(len(b))
            self.ids.append(i)
            self.bytes.append(b)
            self.most.append(0)
        self.heads: dict[int, np.ndarray] = {}
        for size in {len(h) for h in self.sizes}:
            found = np.frombuffer(b"".join(h.ljust(GRAM, b"\0") for h in self.sizes if len(h) == size), "<u8") * MIX_A
            self.heads[size] = np.zeros(1 << _FILTER_BITS, bool)
            self.heads[size][(found >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def tables(self, k: int) -> np.ndarray:
        """The item's sampled symbols in each table, made once per worker."""
        if k not in self._held:
            self._held[k] = self.sampled(self.bytes[k][None, :], np.array([len(self.bytes[k])]))[0]
        return self._held[k]

    @staticmethod
    def sampled(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        width = rows.shape[1]
        at = _samples(width, WALKS, TABLES, SAMPLES)
        return cgk(rows, sizes, WALKS)[:, np.arange(WALKS)[:, None, None], at]


def stretches(items: Items, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Places (item, first possible start, last) where the q-gram count allows an item; none is left out."""
    g = _grams(b)
    if not len(g) or not len(items.key):
        return []
    hit = items.filter[(g >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
    if int(hit.sum()) < items.need.min():
        return []
    total = np.concatenate(([0], np.cumsum(hit)))
    alive = np.zeros(len(g), bool)
    for width, need in items.spans:
        w = min(width, len(g))
        enough = np.flatnonzero(total[w:] - total[:-w] >= need)
        if len(enough):
            mark = np.zeros(len(g) + 1, np.int64)
            np.add.at(mark, enough, 1)
            np.add.at(mark, enough + w, -1)
            alive |= np.cumsum(mark)[:-1] > 0
    at = np.flatnonzero(hit & alive)
    lo, hi = np.searchsorted(items.key, g[at], "left"), np.searchsorted(items.key, g[at], "right")
    n = hi - lo
    if not n.sum():
        return []
    entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    item, start = items.item[entry], np.repeat(at, n) - items.place[entry]
    order = np.lexsort((start, item))
    item, start, gram = item[order], start[order], np.repeat(at, n)[order]
    out = []
    cuts = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1], [True])))
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        k = int(item[a])
        if z - a < items.need[k]:
            continue
        s, e = start[a:z], items.most[k]
        far = np.searchsorted(s, s + 2 * e, "right") - np.arange(len(s))
        i = 0
        while i < len(s):
            if far[i] >= items.need[k] and len(np.unique(gram[a + i : a + i + far[i]])) >= items.need[k]:
                j = i + int(far[i]) - 1
                while j + 1 < len(s) and far[min(j, len(s) - 1)] >= items.need[k] and s[j + 1] - s[i] < len(items.bytes[k]):
                    j += 1
                out.append((k, int(s[i]), int(s[j])))
                i = j + 1
            else:
                i += 1
    return out


def _joined(a: str, b: str) -> bool:
    """Whether two neighbours are inside one word; scripts without blanks between words have no such bound."""
    return all(c and unicodedata.category(c)[0] in "LNM" and not _UNSPACED.match(c) for c in (a, b))


def _bounded(b: np.ndarray, start: int, end: int) -> bool:
    before, inside, after = (b[a:z].tobytes().decode("utf-8", "ignore") for a, z in ((max(0, start - 4), start), (start, end), (end, end + 4)))
    return not (_joined(before[-1:], inside[:1]) or _joined(inside[-1:], after[:1]))


def short_matches(items: Items, b: np.ndarray) -> list[tuple[int, int]]:
    """(item, end of its first occurrence) of the short items that stand in a text at word boundaries."""
    found: dict[int, int] = {}
    if not items.short or not len(b):
        return []
    padded = np.concatenate([b, np.zeros(GRAM, np.uint8)])
    grams = np.ndarray((len(b),), np.dtype("<u8"), padded.data, 0, (1,))
    text = b.tobytes()
    for size, heads in items.heads.items():
        g = (grams & np.uint64((1 << 8 * size) - 1)) * MIX_A
        for p in np.flatnonzero(heads[(g >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]).tolist():
            for n in items.sizes.get(text[p : p + size], ()):
                for k in items.short.get(text[p : p + n], ()):
                    if k not in found and _bounded(b, p, p + n):
                        found[k] = p + n
    return sorted(found.items())


def matches(items: Items, texts: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """(text, item, distance, end in the folded text) for each text and item within the item's distance: its best."""
    todo = [(t, k, a, z) for t, b in enumerate(texts) for k, a, z in stretches(items, b)]
    found: dict[tuple[int, int], tuple[int, int]] = {}
    by_item: dict[int, list] = {}
    for t, k, a, z in todo:
        by_item.setdefault(k, []).append((t, a, z))
    for k, places in by_item.items():
        m, e = len(items.bytes[k]), items.most[k]
        rows, owner, passed = [], [], set()
        pattern = items.bytes[k].tobytes()
        for p, (t, a, z) in enumerate(places):
            b = texts[t]
            if pattern in b[max(0, a - e) : z + m + e].tobytes():  # equal strings have equal embeddings
                passed.add(p)
                continue
            lo, hi = max(0, a - e), min(max(len(b) - m + e, 0), z + e)
            starts = {max(0, min(a, len(b) - 1)), max(0, min(z, len(b) - 1)), lo}
            starts |= {x + 1 for x in (np.flatnonzero(b[lo : hi + 1] == 32) + lo).tolist()}
            for s in sorted(starts):
                w = b[s : s + m]
                if len(w):
                    rows.append(w)
                    owner.append(p)
        own = items.tables(k) if rows else None
        for i in range(0, len(rows), 512):
            some = rows[i : i + 512]
            sizes = np.array([len(w) for w in some])
            grid = np.zeros((len(some), m), np.uint8)
            for r, w in enumerate(some):
                grid[r, : len(w)] = w
            met = (Items.sampled(grid, sizes) == own).all(-1).any((1, 2))
            passed |= {owner[i + r] for r in np.flatnonzero(met).tolist()}
        for p in sorted(passed):
            t, a, z = places[p]
            lo = max(0, a - 2 * e - 1)
            d, end = edit_distance_within(pattern, texts[t][lo : z + m + 2 * e + 1].tobytes(), e)
            if d <= e and (d, lo + end) < found.get((t, k), (e + 1, 0)):
                found[t, k] = (d, lo + end)
    found |= {(t, k): (0, end) for t, b in enumerate(texts) for k, end in short_matches(items, b)}
    return [(t, k, d, end) for (t, k), (d, end) in sorted(found.items())]


def _folded(column) -> list[np.ndarray]:
    data, offs = column_bytes(column)
    return [normalised(data[a:z]) for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]


def _find(blocks: list[tuple[int, str]], ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(blocks, ratio)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                got = matches(items, _folded(part.column(1)))
                ids = part.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[t] for t, *_ in got], pa.int64()), pa.array([items.ids[k] for _, k, _, _ in got], pa.int64()), pa.array([d for *_, d, _ in got], pa.int64()), pa.array([len(items.bytes[k]) for _, k, _, _ in got], pa.int64()), pa.array([e for *_, e in got], pa.int64())],
                    names=["doc_id", "item_id", "edit_distance", "item_bytes", "match_end"],
                )

    return run


def _drop(blocks: list[tuple[int, str]], ratio: float, text_at: int, keep: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(blocks, ratio)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                bad = {t for t, *_ in matches(items, _folded(part.column(text_at)))}
                left = part.take(pa.array([i for i in range(part.num_rows) if i not in bad], pa.int64()))
                yield pa.RecordBatch.from_arrays([left.column(i) for i in range(keep)], names=names)

    return run


def item_blocks(benchmark: DataFrame, *, block_bytes: int = 8 << 20, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about ``block_bytes`` (items are dealt by a hash), each small enough to send to all
    tasks; a larger benchmark means more passes over the documents, not larger blocks."""
    raw = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).where("t is not null")
    total = raw.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    n = int(total // block_bytes) + 1
    for k in range(n):
        yield sorted(((r["i"], r["t"]) for r in raw.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, ratio: float = 0.08, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, edit_distance, item_bytes, match_end`` (in the folded text), one row per document and item
    with a passage within ``ratio`` times the item's folded length.

    Defined cases: null texts and items match nothing; items under 32 folded bytes match only as they
    stand, between word boundaries (each end of the item that is part of a word ends that word in the text too, but for
    scripts without blanks); items of white space alone match nothing; repeated rows are reported each; empty tables give no rows.
    """
    raw = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "doc_id long, item_id long, edit_distance long, item_bytes long, match_end long"
    out = None
    for block in item_blocks(benchmark):
        found = raw.mapInArrow(_find(block, ratio), schema)
        out = found if out is None else out.union(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, ratio: float = 0.08, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any such passage, with all their columns."""
    at = docs.columns.index(text_col)
    for block in item_blocks(benchmark):
        docs = docs.mapInArrow(_drop(block, ratio, at, len(docs.columns), docs.columns), docs.schema)
    return docs


def op8_benchmark_leaks(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
