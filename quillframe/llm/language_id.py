"""Language identification in two levels: a family first, then one-versus-one linear SVMs among its languages.

Features are shares of hashed byte trigrams of the lower-cased text (everything but letters is one blank), so texts
of any length are compared alike. The SVMs (squared hinge, L2) are fitted on the driver to a bounded sample of
labelled rows, chosen by a hash: every label has the same share of ``sample_rows``, up to ``per_language`` and at least 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import column_bytes

BITS = 13
#: Families of ISO 639-1 codes; a label without an entry is a family of its own.
FAMILIES = {
    "romance": "fr es it pt ro ca gl oc",
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "slavic": "ru uk pl cs sk bg sr hr sl mk be bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tt",
    "indic": "hi bn mr gu pa ne ur",
    "semitic": "ar he am mt",
    "sinitic": "zh",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def histograms(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Shares of hashed trigrams, one row a text (zero for texts under three bytes)."""
    b = _FOLD[data].astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:] if len(b) > 2 else np.zeros(0, np.uint32)
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    out = np.zeros((len(offs) - 1, 1 << BITS), np.float32)
    for i, (a, z) in enumerate(zip(offs[:-1].tolist(), (offs[1:] - 2).tolist(), strict=True)):
        if z > a:
            out[i] = np.bincount(code[a:z], minlength=1 << BITS)
            out[i] *= 16.0 / (z - a)
    return out


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            rows = histograms(*column_bytes(part.column(1)))
            keep = [np.flatnonzero(r).astype("<u2") for r in rows]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([k.tobytes() for k in keep]), pa.array([r[k].tobytes() for r, k in zip(rows, keep, strict=True)])], names=["lang", "at", "share"])


def linear_svm(x: np.ndarray, y: np.ndarray, *, c: float = 50.0, rounds: int = 60) -> np.ndarray:
    """Weights (bias last) of a squared-hinge SVM, by Nesterov steps over the whole sample."""
    n = np.where(y > 0, 1.0 / max((y > 0).sum(), 1), 1.0 / max((y < 0).sum(), 1)).astype(np.float32)
    step = np.float32(1.0 / (1.0 + 2 * c * float((n * (np.einsum("ij,ij->i", x, x) + 1)).sum())))
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    for t in range(1, rounds * 5):
        pull = 2 * np.float32(c) * n * y * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        new = v - step * (v - np.append(pull @ x, pull.sum()))
        v = new + (t - 1) / (t + 2) * (new - w)
        w = new
    return w


def train(labels: list[str], x: np.ndarray) -> dict:
    """Families, a one-versus-rest SVM for each, and an SVM for each pair of languages within a family."""
    langs = sorted(set(labels))
    number = {name: i for i, name in enumerate(langs)}
    lang = np.array([number[name] for name in labels], int)
    groups: dict[str, list[int]] = {}
    for i, name in enumerate(langs):
        groups.setdefault(_FAMILY.get(name.lower().split("-")[0], f"own:{name}"), []).append(i)
    families = sorted(groups)
    weights, pairs = [], []
    for f in families if len(families) > 1 else []:
        weights.append(linear_svm(x, np.where(np.isin(lang, groups[f]), 1.0, -1.0).astype(np.float32)))
    for k, f in enumerate(families):
        for i, a in enumerate(groups[f]):
            for b in groups[f][i + 1 :]:
                rows = np.flatnonzero((lang == a) | (lang == b))
                weights.append(linear_svm(x[rows], np.where(lang[rows] == a, 1.0, -1.0).astype(np.float32)))
                pairs.append((k, a, b))
    w = np.stack(weights) if weights else np.zeros((0, (1 << BITS) + 1), np.float32)
    return {"langs": langs, "families": [groups[f] for f in families], "pairs": pairs, "w": w}


def predict(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language index and score of each row: family by largest margin, language by most pairs won in it."""
    n, families = len(x), model["families"]
    margins = x @ model["w"][:, :-1].T + model["w"][:, -1] if len(model["w"]) else np.zeros((n, 0), np.float32)
    squash = lambda m: 1 / (1 + np.exp(-4.0 * np.clip(m, -20, 20)))
    nf = len(families) if len(families) > 1 else 0
    family = margins[:, :nf].argmax(1) if nf else np.zeros(n, int)
    sure = squash(margins[:, :nf].max(1)) if nf else np.ones(n)
    wins = np.zeros((n, len(model["langs"])), np.float64)
    for j, (_, a, b) in enumerate(model["pairs"]):
        m = margins[:, nf + j]
        p = squash(m)
        wins[:, a] += (m > 0) + 1e-3 * p
        wins[:, b] += (m <= 0) + 1e-3 * (1 - p)
    member = np.zeros((len(families), len(model["langs"])), bool)
    for k, g in enumerate(families):
        member[k, g] = True
    wins[~member[family]] = -1
    best = wins.argmax(1)
    lowest = np.ones(n)
    for j, (k, a, b) in enumerate(model["pairs"]):
        p = squash(margins[:, nf + j])
        lowest = np.where((best == a) & (family == k), np.minimum(lowest, p), np.where((best == b) & (family == k), np.minimum(lowest, 1 - p), lowest))
    return best, sure * lowest


def _identify(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model["langs"], "und"], object)
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 128):
                part = batch.slice(at, 128)
                if not part.num_rows:
                    continue
                spelled = np.array([t is not None and any(map(str.isalpha, t)) for t in part.column(1).to_pylist()], bool)
                if model["langs"]:
                    best, sure = predict(model, histograms(*column_bytes(part.column(1))))
                else:
                    best, sure, spelled = np.zeros(len(spelled), int), np.zeros(len(spelled)), np.zeros(len(spelled), bool)
                best = np.where(spelled, best, len(names) - 1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(names[best].tolist(), pa.string()), pa.array(np.where(spelled, sure, 0.0))], names=["id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, *, learn_from, per_language: int = 1000, sample_rows: int = 16_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: ``id_col, held_out, lang_pred, score``; ``learn_from`` is a boolean column, true on rows to learn from.

    Predictions see the text alone. The driver holds the sample as one matrix of 32 KB a row: 512 MB for ``sample_rows``,
    which are shared among all labels (each keeps one at least).
    Defined cases: a null text or one without a letter (``str.isalpha``) is ``und`` with score 0; rows
    without a label are not learnt from; with no labelled row everything is ``und``; with one language learnt every
    spelled text is that; repeated rows are predicted alike.
    """
    spark = docs.sparkSession
    raw = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.coalesce(learn_from, F.lit(False)).alias("learn"))
    usable = raw.where("learn and lang is not null and text is not null")
    counts = [(r["lang"], r["count"]) for r in usable.groupBy("lang").count().collect()]
    most = max(1, min(per_language, sample_rows // max(1, len(counts))))
    # a hash thins each label to about twice its share and some first, so that only the sample's texts are shuffled and
    # no label is left without a row
    bounds = spark.createDataFrame([(name, min(1 << 40, (2 * most + 32 << 40) // n)) for name, n in counts], "lang string, below long")
    drawn = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 40))
    thin = usable.join(F.broadcast(bounds), "lang").where(drawn < F.col("below"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(7)), F.xxhash64("text"))
    chosen = thin.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    rows = chosen.select("lang", "text").mapInArrow(_sampled, "lang string, at binary, share binary").collect() if counts else []
    x = np.zeros((len(rows), 1 << BITS), np.float32)
    for own, row in zip(x, rows, strict=True):
        own[np.frombuffer(row["at"], "<u2")] = np.frombuffer(row["share"], np.float32)
    labels = [row["lang"] for row in rows]
    del rows
    model = train(labels, x)
    del x
    out = raw.select("id", "text", (~F.col("learn")).alias("held_out")).mapInArrow(_identify(model), docs.select(F.col(f"`{id_col}`").alias("id")).schema.add("held_out", "boolean").add("lang_pred", "string").add("score", "double"))
    return out.withColumnRenamed("id", id_col)


def op6_language_family(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return identify(docs, learn_from=(number % 4) != 2)
