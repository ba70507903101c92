"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of documents. Every window of ``length`` tokens is filled source by source: a source earns its
target share of the window, spends what it has earned on tokens of its queue, and carries the rest (its deficit) to
the next window. All tokens are placed; shares of exhausted sources go to the others.

Packing tasks do not go by the partitions as read. A task packs one run of windows of the whole mixture, and takes from
each source's queue, which runs over all partitions, the tokens that lie in that run by the targets (``apportioned``).
So every task holds every source until that is used up everywhere, however the documents lie.
"""

from __future__ import annotations

import itertools
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import column_bytes, materialise, with_sums_before, work_dir
from quillframe.llm.encoding import encoder
from quillframe.llm.files import create, fresh, opened

_TOKENS = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("ids", pa.large_binary())])
_PARTS = "part long, batch long, path string, source string, n_tokens long"
_DEALT = "task long, path string, batch long, source string, before long"
_BATCH_TOKENS = 1 << 17
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, padded_length long"


def _tokenise(directory: str, vocabulary: str, end_id: int, file_tokens: int):
    """Files of about ``file_tokens`` ids whose record batches hold one source each; a row for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(vocabulary), TaskContext.get().partitionId()
        k, held, n = 0, {}, 0

        def written() -> pa.RecordBatch:
            path, totals = fresh(directory, f"ids-{task:08d}-{k:06d}", ".arrow"), []
            with create(path) as out, pa.ipc.new_file(out, _TOKENS.with_metadata({"ids": enc.dtype.str})) as writer:
                for s, docs in held.items():
                    sizes = np.array([len(x) for _, x in docs])
                    group = (np.cumsum(sizes) - sizes) // _BATCH_TOKENS
                    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(docs)]
                    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                        ends = np.concatenate(([0], np.cumsum(sizes[a:z]))) * enc.dtype.itemsize
                        ids = pa.Array.from_buffers(pa.large_binary(), z - a, [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate([x for _, x in docs[a:z]]))])
                        writer.write_batch(pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs[a:z]], pa.int64()), pa.array([s] * (z - a), pa.string()), ids], schema=_TOKENS))
                        totals.append((s, int(sizes[a:z].sum())))
            m = len(totals)
            return pa.RecordBatch.from_arrays([pa.array([task << 20 | k] * m, pa.int64()), pa.array(range(m), pa.int64()), pa.array([path] * m), pa.array([s for s, _ in totals], pa.string()), pa.array([t for _, t in totals], pa.int64())], names=["part", "batch", "path", "source", "n_tokens"])

        for batch in batches:
            docs, sources = batch.column(0).cast(pa.int64()).to_pylist(), batch.column(2).to_pylist()
            for i, s, x in zip(docs, sources, enc.encode_all(batch.column(1).to_pylist(), end_id), strict=True):
                held.setdefault(s, []).append((i, x))
                n += len(x)
                if n >= file_tokens:
                    yield written()
                    k, held, n = k + 1, {}, 0
        if held:
            yield written()

    return run


def apportioned(totals: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """How many of the first ``n`` tokens of the mixture are each source's: token t of a source stands at
    (t + 1/2) / weight, and the n first are taken, so that counts add up to ``n`` and never fall as ``n`` grows."""
    if n >= totals.sum():
        return totals.copy()
    ends = totals / weights
    order = np.argsort(ends, kind="stable")
    t, w = totals[order], weights[order]
    done, alive = np.cumsum(t) - t, np.cumsum(w[::-1])[::-1]
    k = min(int(np.searchsorted(done + alive * ends[order], n)), len(t) - 1)
    got = np.minimum(totals, np.floor(weights * ((n - done[k]) / alive[k]) + 0.5).astype(np.int64))
    while True:  # rounding is off by a few tokens
        after = np.where(got < totals, (got + 0.5) / weights, np.inf)
        last = np.where(got > 0, (got - 0.5) / weights, -np.inf)
        i, j, off = int(after.argmin()), len(last) - 1 - int(last[::-1].argmax()), n - int(got.sum())
        if off < 0 or (off == 0 and (after[i], i) < (last[j], j)):
            got[j] -= 1
        if off > 0 or (off == 0 and (after[i], i) < (last[j], j)):
            got[i] += 1
        elif off == 0:
            return got


def _dealt(sources: list, totals: np.ndarray, weights: np.ndarray, span: int):
    """Sends each batch to every task of ``span`` tokens that may take some of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {s: k for k, s in enumerate(sources)}
        most = max(0, int(totals.sum()) - 1) // span

        def place(s: str | None, t: int) -> float:
            return float(np.minimum(totals, weights * ((t + 0.5) / weights[at[s]])).sum())

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                a, z = place(r["source"], r["before"]), place(r["source"], r["before"] + r["n_tokens"] - 1)
                slack = len(sources) + 2 + 1e-9 * z  # what rounding may shift a token by; tasks cut exactly
                for task in range(max(0, int((a - slack) // span)), min(most, int((z + slack) // span)) + 1):
                    rows.append((task, r["path"], r["batch"], r["source"], r["before"]))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["task", "path", "batch", "source", "before"])

    return run


def deal(queues: dict, weights: dict, deficits: dict, length: int, quantum: int) -> Iterator[tuple]:
    """Deficit round-robin over ``queues`` (source -> deque of token counts with a label): yields
    ``(source, label, start, size, window, offset)``. ``weights`` and ``deficits`` are per source; deficits are updated.
    """
    ring = deque(s for s in sorted(queues, key=lambda s: (s is None, s)) if queues[s])
    left = {s: sum(n for _, n in queues[s]) for s in ring}
    begun = dict.fromkeys(ring, 0)
    share = sum(weights[s] for s in ring)
    window = 0
    space = length
    for s in ring:
        deficits[s] += weights[s] / share * length
    while ring:
        for _ in range(len(ring)):
            s = ring[0]
            if deficits[s] >= min(quantum, left[s], space):
                break
            ring.rotate(-1)
        else:  # nobody has earned enough: the one that is owed most goes on credit
            s = max(ring, key=deficits.get)
            ring.rotate(-ring.index(s))
        label, n = queues[s][0]
        take = min(space, n - begun[s], max(int(deficits[s]), min(quantum, left[s], space)))
        yield s, label, begun[s], take, window, length - space
        begun[s] += take
        left[s] -= take
        deficits[s] -= take
        space -= take
        if begun[s] == n:
            queues[s].popleft()
            begun[s] = 0
            if not queues[s]:
                ring.popleft()
                share = sum(weights[x] for x in ring)
        if not space and ring:
            window, space = window + 1, length
            for x in ring:
                deficits[x] += weights[x] / share * length


def _queued(batches: list[dict], low: dict, high: dict) -> tuple[dict, list]:
    """Queues of ``(document, tokens)`` for ``deal`` of each source's tokens from ``low`` to ``high``, and the documents:
    ``(doc_id, first token here, all its tokens, ids here as 32-bit bytes)``. Ids are copied, so that one file is open at
    a time."""
    found: dict = {}
    for path, group in itertools.groupby(sorted(batches, key=lambda x: (x["path"], x["batch"])), key=lambda x: x["path"]):
        with opened(path) as f:
            reader = pa.ipc.open_file(f)
            kind = np.dtype(reader.schema.metadata[b"ids"].decode())
            for x in group:
                s, at = x["source"], x["before"]
                if at >= high[s]:
                    continue
                table = reader.get_batch(x["batch"])
                flat, ends = column_bytes(table.column(2))
                flat, ends = flat.view(kind), ends // kind.itemsize
                first, stop = int(np.searchsorted(ends[1:], low[s] - at, "right")), int(np.searchsorted(ends[:-1], high[s] - at, "left"))
                idents = table.column(0).slice(first, max(0, stop - first)).to_pylist()
                for i, a, z in zip(idents, ends[first:stop].tolist(), ends[first + 1 : stop + 1].tolist(), strict=True):
                    lo, hi = max(low[s] - at, a), min(high[s] - at, z)
                    if lo < hi:
                        found.setdefault(s, []).append((at + lo, (i, lo - a, z - a, flat[lo:hi].astype("<u4").tobytes())))
                del table, flat
            del reader
    queues, docs = {}, []
    for s, some in found.items():
        some.sort(key=lambda x: x[0])
        queues[s] = deque((len(docs) + k, len(d[3]) // 4) for k, (_, d) in enumerate(some))
        docs += [d for _, d in some]
    return queues, docs


def _pack(sources: list, totals: np.ndarray, weights: np.ndarray, windows: int, length: int, quantum: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = dict(zip(sources, weights.tolist(), strict=True))
        for batch in batches:
            for row in batch.to_pylist():
                low, high = (dict(zip(sources, apportioned(totals, weights, n * windows * length).tolist(), strict=True)) for n in (row["task"], row["task"] + 1))
                queues, docs = _queued(row["batches"], low, high)
                cols, names, last = [array("q") for _ in range(7)], [], (-1, 0)
                for s, i, start, size, window, offset in deal(queues, share, dict.fromkeys(queues, 0.0), length, quantum):
                    _, first, whole, ids = docs[i]
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + size)])
                    for c, v in zip(cols, (i, first + start, size, crc, whole, window, offset), strict=True):
                        c.append(v)
                    names.append(s)
                    last = (window, offset + size)
                i, start, size, crc, total, window, offset = (np.frombuffer(c, np.int64) for c in cols)
                full = last[1] if last[1] & (last[1] - 1) == 0 else length
                padded = np.where(window == last[0], full, length)
                ident = pa.array([d[0] for d in docs], pa.int64()).take(pa.array(i))
                for a in range(0, len(i), 1 << 16):
                    z = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays(
                        [ident[z], *[pa.array(v[z]) for v in (start, size, crc, total)], pa.array(window[z] + row["task"] * windows), pa.array(offset[z]), pa.array(names[z], pa.string()), pa.array(padded[z])],
                        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "padded_length"],
                    )

    return run


def pack(docs: DataFrame, *, vocabulary: str, end_id: int = 0, length: int = 1024, quantum: int = 128, shares: dict | None = None, file_tokens: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, then ``source`` and
    ``padded_length`` (what its sequence is padded to: ``length``, or its own size where that is a power of two).

    ``shares`` gives target weights per source (others weigh nothing until those are used up); by default a source's
    target is its share of all tokens. A source is served once it has earned ``quantum`` tokens, or what its queue or
    the window still holds. Defined cases: a null text is its end id alone; a null source is a source of its own; null
    ids stay null; rows that share an id are documents of their own; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{source_col}`").cast("string").alias("source"))
    parts = materialise(slim.mapInArrow(_tokenise(work_dir(spark, "pack-ids"), vocabulary, end_id, file_tokens), _PARTS), "pack-parts")
    rows = sorted(((r["source"], r["all"]) for r in parts.groupBy("source").agg(F.sum("n_tokens").alias("all")).collect()), key=lambda r: (r[0] is not None, r[0]))
    sources, totals = [s for s, _ in rows], np.array([t for _, t in rows], np.int64)
    weights = totals.astype(float) if shares is None else np.array([float(shares.get(s or "", 0.0)) + 1e-9 for s in sources])
    weights = weights / weights.sum() if rows else weights
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    windows = max(1, min(file_tokens // length, max(64, -(-int(totals.sum()) // (3 * n * length)))))
    placed = with_sums_before(parts, ["source"], F.shiftright("part", 30), ["part", "batch"], "n_tokens", "before")  # runs of 1024 tasks
    dealt = placed.mapInArrow(_dealt(sources, totals, weights, windows * length), _DEALT)
    plan = dealt.repartition(n, "task").groupBy("task").agg(F.collect_list(F.struct("path", "batch", "source", "before")).alias("batches"))
    return plan.mapInArrow(_pack(sources, totals, weights, windows, length, quantum), PIECES)


def op10_mixture_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"), vocabulary=public_tokenizers.path("byte_bpe_50k.json"))
