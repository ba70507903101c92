"""Token ids in Arrow files of equal-length sequences.

Each file holds record batches of two fixed-size lists, ``ids`` and ``mask`` (true where an id is real); sequence k lies
at a computable place, so a reader maps the file and takes it without copying. The last sequence of a file is padded.
A second Arrow file beside it lists each document's place. Documents lie in ascending id order over all files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import materialise, parts_for, text_bytes, with_sums_before, work_dir
from quillframe.llm.encoding import encoder
from quillframe.llm.files import create, fresh, opened

SEQUENCE = 1024
BATCH = 256
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_MANIFEST = "part long, path string, docs_path string, n_docs long, n_tokens long"


class SequenceWriter:
    """Appends runs of ids; full batches of sequences go to the file at once."""

    def __init__(self, uri: str, dtype: np.dtype, length: int):
        self.dtype, self.length, self.held, self.size, self.total = dtype, length, [], 0, 0
        value = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = create(uri)
        self.writer = pa.ipc.new_file(self.out, self.schema)

    def _emit(self, flat: np.ndarray, real: int) -> None:
        mask = np.zeros(len(flat), bool)
        mask[:real] = True
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= self.length * BATCH:
            flat = np.concatenate(self.held)
            full = len(flat) - len(flat) % (self.length * BATCH)
            for i in range(0, full, self.length * BATCH):
                self._emit(flat[i : i + self.length * BATCH], self.length * BATCH)
            self.held, self.size = [flat[full:].copy()], len(flat) - full

    def close(self) -> None:
        flat = np.concatenate([*self.held, np.zeros(0, self.dtype)])
        if len(flat):
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.dtype)
            padded[: len(flat)] = flat
            self._emit(padded, len(flat))
        self.writer.close()
        self.out.close()


def _write(directory: str, vocabulary: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        path = fresh(directory, f"tokens-{part:08d}", ".arrow")
        docs_path = path.removesuffix(".arrow") + ".docs.arrow"
        writer, index, n = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                writer, side = SequenceWriter(path, enc.dtype, length), create(docs_path)
                index = pa.ipc.new_file(side, _DOCS)
            start, size = [], []
            for ids in enc.encode_all(batch.column(1).to_pylist(), end_id):
                start.append(writer.total)
                size.append(len(ids))
                writer.append(ids)
            index.write_batch(pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int64())], schema=_DOCS))
            n += batch.num_rows
        if writer is not None:
            writer.close()
            index.close()
            side.close()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([path]), pa.array([docs_path]), pa.array([n]), pa.array([writer.total])], names=["part", "path", "docs_path", "n_docs", "n_tokens"])

    return run


def write_tokens(docs: DataFrame, *, vocabulary: str, end_id: int, length: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 16 << 20) -> DataFrame:
    """Write all texts' ids, each followed by ``end_id``; returns the manifest, one row per file, in ``part`` order.

    Defined cases: a null or empty text is its end id alone; null ids come first; rows that share an id lie beside
    each other, in the order of a hash of their texts; an empty table writes no file.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    keys = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    dealt = slim.repartitionByRange(parts_for(spark, text_bytes(slim), part_bytes), *keys).sortWithinPartitions(*keys)
    return materialise(dealt.mapInArrow(_write(work_dir(spark, "token-files"), vocabulary, end_id, length), _MANIFEST), "token-manifest")


def sequence(path: str, k: int) -> tuple[pa.Array, pa.Array]:
    """Sequence ``k`` of a token file and its mask (one bit an id): two Arrow views into the mapped file."""
    with pa.ipc.open_file(opened(path)) as reader:
        batch = reader.get_batch(k // BATCH)
        length = batch.schema.field("ids").type.list_size
        at = k % BATCH * length
        return tuple(batch.column(c).flatten().slice(at, length) for c in range(2))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            reader, index = pa.ipc.open_file(opened(row["path"])), pa.ipc.open_file(opened(row["docs_path"]))
            got, tail, base = 0, np.zeros(0, np.uint32), 0
            for d in range(index.num_record_batches):
                docs = index.get_batch(d)
                starts, sizes = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                crc = []
                for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
                    while base + len(tail) < s + n:
                        b = reader.get_batch(got)
                        ids, mask = (b.column(c).flatten() for c in range(2))
                        more = ids.to_numpy()[: mask.true_count].astype("<u4")
                        tail, base = np.concatenate((tail[s - base :], more)), s
                        got += 1
                    crc.append(zlib.crc32(tail[s - base : s - base + n]))
                yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts + row["start"]), docs.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start`` (ids before it in all files), ``n_tokens``, ``ids_crc32``."""
    placed = with_sums_before(manifest, [], F.shiftright("part", 12), ["part"], "n_tokens", "start")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, "part").select("path", "docs_path", "start").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_documents(write_tokens(docs, vocabulary=public_tokenizers.path("byte_bpe_50k.json"), end_id=2))
