"""WARC archives with segmented records: writing, and reading back with reassembly.

A record's block (HTTP headers and a chunked body) that exceeds ``segment_bytes`` is written as a first segment and
continuation records. Reading groups segments by origin identifier, orders them by segment number, verifies the total
length and only then decodes the chunked framing. Records are gzip members of their own; archives are cut by size.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import materialise, utf8, work_dir
from quillframe.llm.files import create, fresh, opened

#: Fixed by the format.
_VERSION = b"WARC/1.1\r\n"
_VERSIONS = (b"WARC/1.0\r\n", _VERSION)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:x-page:"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, origin string, segment int, total long, block binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = 8192) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(kind: str, ident: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{ident}>"), ("WARC-Date", "2026-01-01T00:00:00Z"), *fields, ("Content-Length", str(len(block)))]
    raw = _VERSION + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def records(page_id: int | None, uri: str, payload: bytes, refers_to: int | None, segment_bytes: int) -> Iterator[bytes]:
    """The gzip members of one page: a revisit, a response, or a response in segments."""
    ident = _PAGE + (str(page_id) if page_id is not None else f"null:{uuid.uuid4().hex}")
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    common = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha1:" + digest_of(payload)), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        yield _record("revisit", ident, [*common, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{_PAGE}{refers_to}>")], head)
        return
    block = head + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record("response", ident, common, block)
        return
    last = (len(block) - 1) // segment_bytes
    yield _record("response", ident, [*common, ("WARC-Segment-Number", "1")], block[:segment_bytes])
    for k in range(1, last + 1):
        fields = [("WARC-Segment-Origin-ID", f"<{ident}>"), ("WARC-Segment-Number", str(k + 1)), ("WARC-Target-URI", uri)]
        if k == last:
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record("continuation", f"{ident}:segment:{k + 1}", fields, block[k * segment_bytes : (k + 1) * segment_bytes])


def _write(directory: str, segment_bytes: int, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, path, size = TaskContext.get().partitionId(), None, None, 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], names=["path", "bytes"])
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                uri = "".join(c if c > " " else "%20" for c in (url.as_py() or "about:blank"))
                for member in records(page_id.as_py(), uri, utf8(html.as_py()), refers_to.as_py(), segment_bytes):
                    if out is None:
                        path, size = fresh(directory, f"pages-{task:06d}", ".warc.gz"), 0
                        out = create(path)
                    out.write(member)
                    size += len(member)
                    if size >= archive_bytes:
                        out.close()
                        yield done()
                        out = None
        if out is not None:
            out.close()
            yield done()

    return run


def write_archives(pages: DataFrame, *, segment_bytes: int = 32 << 10, archive_bytes: int = 16 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per page; returns the manifest ``path, bytes``.

    Of pages with equal payloads that with the largest id is the response and those with smaller ids revisit it.
    Defined cases: a null payload is empty, a null url is ``about:blank`` and white space in urls is escaped; a page with
    a null id is a response of its own; repeated rows of the largest id are all responses; an empty table writes nothing.
    """
    raw = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    raw = raw.withColumn("key", F.sha1(F.col("html")))
    several = raw.groupBy("key").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "top")
    # a written table on this side, so that a payload which very many pages share can be split over tasks
    judged = raw.join(materialise(several, "warc-payloads"), "key", "left").select("page_id", "url", "html", F.when(F.col("page_id") < F.col("top"), F.col("top")).alias("refers_to"))
    return materialise(judged.mapInArrow(_write(work_dir(pages.sparkSession, "warc"), segment_bytes, archive_bytes), "path string, bytes long"), "warc-manifest")


def members(stream, step: int = 1 << 16) -> Iterator[bytes]:
    """The decompressed gzip members of an archive, one at a time."""
    held = b""
    while True:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not held:
                held = stream.read(step)
                if not held:
                    if parts:
                        raise ValueError("archive ends inside a record")
                    return
            parts.append(z.decompress(held))
            held = z.unused_data
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    if not raw.startswith(_VERSIONS):
        raise ValueError("not a WARC record")
    head, _, rest = raw[len(_VERSION) :].partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n"):
        name, _, value = line.partition(":")
        fields[name.lower()] = value.strip()
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size]


def _page(ident: str) -> int | None:
    text = ident.strip("<>").removeprefix(_PAGE)
    return int(text) if text.lstrip("-").isdigit() else None


def _checked(block: bytes, digest: str | None) -> tuple[int, str]:
    """A payload's length and digest; a stated digest must be met, by the payload or (as some writers do) by the body
    before its transfer coding is undone."""
    payload = payload_of(block)
    own = digest_of(payload)
    if digest and digest not in (own, digest_of(block.partition(b"\r\n\r\n")[2])):
        raise ValueError("a payload does not meet its digest")
    return len(payload), own


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows, held = [], 0
            with opened(path) as f:
                for raw in members(f):
                    h, block = parse(raw)
                    digest = h.get("warc-payload-digest", "")
                    digest = digest.removeprefix("sha1:") if digest.startswith("sha1:") else None  # no other is checked
                    kind = h["warc-type"]
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    if "warc-segment-number" in h:
                        origin = h.get("warc-segment-origin-id", h["warc-record-id"])
                        total = h.get("warc-segment-total-length")
                        rows.append((_page(origin), None, digest, None, None, origin, int(h["warc-segment-number"]), int(total) if total else None, block))
                        held += len(block)
                    elif kind == "revisit":
                        rows.append((_page(h["warc-record-id"]), None, digest, "revisit", _page(h.get("warc-refers-to", "")), None, None, None, None))
                    else:
                        rows.append((_page(h["warc-record-id"]), *_checked(block, digest), "response", None, None, None, None, None))
                    if len(rows) >= 2000 or held > 1 << 22:
                        yield _rows(rows)
                        rows, held = [], 0
            if rows:
                yield _rows(rows)


_DONE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _assemble(table: pa.Table) -> pa.Table:
    """All segments of one origin: in order, complete, of the stated length; several identical runs stand for repeats."""
    parts = sorted(table.select(["segment", "total", "block", "payload_digest", "page_id"]).to_pylist(), key=lambda r: r["segment"])
    copies = sum(r["segment"] == 1 for r in parts)
    runs = parts[::copies] if copies else []
    totals = {r["total"] for r in parts if r["total"] is not None}
    block = b"".join(r["block"] for r in runs)
    if not copies or [r["segment"] for r in runs] != list(range(1, len(runs) + 1)) or totals != {len(block)}:
        raise ValueError("a segmented record is incomplete")
    n, digest = _checked(block, runs[0]["payload_digest"])
    row = {"page_id": runs[0]["page_id"], "payload_bytes": n, "payload_digest": digest, "record_type": "response", "refers_to": None}
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    return pa.Table.from_pylist([row] * copies, schema=kinds)


def read_archives(manifest: DataFrame) -> DataFrame:
    """Per response or revisit: ``page_id, payload_bytes, payload_digest, record_type, refers_to``; revisits take their
    length from the response they refer to, null where it is not among the archives. Damaged framing, lengths, segments or
    SHA-1 digests raise an error. Records of other types are passed over; a response without a digest gets its own; a
    record whose identifier is not one of ours has a null id."""
    spark = manifest.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = materialise(manifest.select("path").repartition(n, "path").mapInArrow(_read, _READ), "warc-records")
    whole = read.where("segment is null").select(*[c.split()[0] for c in _DONE.split(", ")])
    joined = read.where("segment is not null").select("page_id", "payload_digest", "origin", "segment", "total", "block").groupBy("origin").applyInArrow(_assemble, _DONE)
    responses = whole.where("record_type = 'response'").union(materialise(joined, "warc-joined"))
    sizes = materialise(responses.where("page_id is not null").groupBy(F.col("page_id").alias("refers_to")).agg(F.max("payload_bytes").alias("n")), "warc-sizes")
    visits = whole.where("record_type = 'revisit'").join(sizes, "refers_to", "left").select("page_id", F.col("n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return responses.union(visits)


def op4_warc_segments(spark, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))


OP4_SQL = r"""
with bits as (
  select page_id, coalesce(html, '') as body,
    array_to_string(list_transform(string_split(sha1(coalesce(html, '')), ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', c)]), '') as b
  from pages),
named as (
  select page_id, octet_length(encode(body)) as n, b,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + 16 * cast(substr(b, 5 * i + 1, 1) as int) + 8 * cast(substr(b, 5 * i + 2, 1) as int) + 4 * cast(substr(b, 5 * i + 3, 1) as int) + 2 * cast(substr(b, 5 * i + 4, 1) as int) + cast(substr(b, 5 * i + 5, 1) as int), 1)), '') as digest
  from bits)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
  case when page_id = max(page_id) over (partition by digest) then 'response' else 'revisit' end as record_type,
  case when page_id < max(page_id) over (partition by digest) then max(page_id) over (partition by digest) end as refers_to
from named
"""
