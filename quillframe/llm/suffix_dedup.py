"""Substring deduplication over a sparse suffix array.

A byte goes if a ``min_len``-byte string over it also starts in a document with a smaller id.

* Each window of ``min_len`` bytes elects one anchor inside it (the smallest hashed 16-gram, leftmost on
  ties), so equal windows elect the same relative place: only anchors need comparing, one in 18 positions.
* Pass one sends four bytes per distinct anchor to a hash bucket and learns which anchors occur in two
  documents or more. Pass two sends the bytes around only those anchors.
* In each bucket the anchors' suffixes (and reversed prefixes) are ordered by deep-shallow sorting: multikey
  quicksort on eight-byte symbols to a shallow depth, then blind tries for groups with longer common prefixes.
  The LCP array of that order gives, at each offset, the windows that are equal and their smallest document.

Copies inside one chunk of documents are resolved there before anything is sent, so a passage that a third of
all documents share costs one record per chunk. An anchor at the edge of such a passage has another context in
nearly every document: pass one counts the contexts of each anchor, and the records of an anchor with more than
``CROWD`` of them are taken apart into their windows, which are dealt to buckets by the hash of their own bytes and
cost one record per chunk each. Nothing is collected to the driver but one total of bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillframe.llm.common import MIX_A, MIX_B, MIX_C, column_bytes, mix64, parts_for, text_bytes, without

GRAM = 16
SHALLOW = 24
BLOCK = 1 << 18
CROWD = 4096
CHUNKS, LEAST_CHUNK, MOST_CHUNK = 1 << 12, 8 << 20, 128 << 20
_POS_BITS = np.uint64(22)
_POS_MASK = np.uint64((1 << 22) - 1)
_LAST = np.int64(np.iinfo(np.int64).max)
_SENT = T.StructType([T.StructField("__qf_to", T.IntegerType()), T.StructField("__qf_blob", T.BinaryType())])
_SENT_ARROW = pa.schema([("__qf_to", pa.int32()), ("__qf_blob", pa.binary())])


# ---------------------------------------------------------------- anchors


def _words_at(buf: np.ndarray, n: int, shift: int) -> np.ndarray:
    return np.ndarray((n,), np.dtype("<u8"), buf.data, shift, (1,))


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_len: int):
    """Anchors of one block. Returns arrays: document index, anchor place, first and last window start, 64-bit key."""
    n = len(data)
    buf = np.zeros(n + 64, np.uint8)
    buf[:n] = data
    h = _words_at(buf, n, 0) * MIX_A
    h ^= h >> np.uint64(29)
    h += _words_at(buf, n, 8)
    h *= MIX_B
    h ^= h >> np.uint64(32)
    h *= MIX_C
    key = (h & ~_POS_MASK) | np.arange(n, dtype=np.uint64)
    span, low, have = min_len - GRAM + 1, key, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    count = np.maximum(ends - starts - min_len + 1, 0)
    total = int(count.sum())
    if not total:
        e = np.zeros(0, np.int64)
        return e, e, e, e, np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(starts)), count)
    at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
    chosen = (low[at] & _POS_MASK).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    last = np.concatenate((first[1:], [total])) - 1
    place = chosen[first]
    return doc[first], place, at[first], at[last], mix64(h[place] ^ MIX_A)


def _blocks(starts: np.ndarray, ends: np.ndarray, min_len: int):
    """Deal pieces of documents into blocks; long documents are cut so that each window start is in one piece."""
    docs, lo, hi, held = [], [], [], 0
    for d, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if b - a < min_len:
            continue
        step = BLOCK * 4
        for s in range(a, b - min_len + 1, step):
            e = min(b, s + step + min_len - 1)
            if held and held + e - s > BLOCK:
                yield docs, lo, hi
                docs, lo, hi, held = [], [], [], 0
            docs.append(d)
            lo.append(s)
            hi.append(e)
            held += e - s
    if docs:
        yield docs, lo, hi


def chunk_anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_len: int):
    """Anchors of all documents of a chunk: document, place, first and last window start (all in ``data``), key."""
    got = []
    for docs, lo, hi in _blocks(starts, ends, min_len):
        base, top = lo[0], hi[-1]
        if top - base <= 6 * BLOCK:
            block, a = data[base:top], np.array(lo) - base
            back = None
        else:
            sizes = np.array(hi) - np.array(lo)
            block = np.concatenate([data[x:y] for x, y in zip(lo, hi, strict=True)])
            a = np.cumsum(sizes) - sizes
            back = np.array(lo) - a
        d, p, s, e, k = anchors(block, a, a + np.array(hi) - np.array(lo), min_len)
        move = base if back is None else back[d]
        got.append((np.array(docs)[d], p + move, s + move, e + move, k))
    if not got:
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


# ---------------------------------------------------------------- deep-shallow sorting


def _blind_trie(strings: list[bytes]) -> list[int]:
    """Order of ``strings`` (of equal length) by a blind trie: its nodes keep only the depth at which strings part."""
    places: dict[bytes, list[int]] = {}
    for i, s in enumerate(strings):
        places.setdefault(s, []).append(i)
    distinct = list(places)
    root: list = [-1, None, 0]  # a leaf is [-1, None, index]; a node is [depth, {byte: child}, any index below]
    for i in range(1, len(distinct)):
        s, at = distinct[i], root
        while at[0] >= 0:  # blind descent: only branching bytes are looked at
            at = at[1].get(s[at[0]]) or [-1, None, at[2]]
        other, lo, hi = distinct[at[2]], 0, len(s) - 1
        while lo < hi:  # the one full comparison: where does s part from that string
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if s[:mid] == other[:mid] else (lo, mid - 1)
        depth, parent, at = lo, None, root
        while 0 <= at[0] < depth:
            parent, at = at, at[1][s[at[0]]]
        if at[0] == depth:
            at[1][s[depth]] = [-1, None, i]
            continue
        node = [depth, {other[depth]: at, s[depth]: [-1, None, i]}, i]
        if parent is None:
            root = node
        else:
            parent[1][s[parent[0]]] = node
    out, stack = [], [root]
    while stack:
        depth, children, i = stack.pop()
        if depth < 0:
            out.extend(places[distinct[i]])
        else:
            stack.extend(children[b] for b in sorted(children, reverse=True))
    return out


def _multikey(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Multikey quicksort of rows of symbols down to ``depth`` symbols: their order, and the groups ``(first, size)``
    that are equal so far. Every round splits all open groups at once, each at its own depth, into what is less than,
    equal to and greater than its pivot (the median of three); equal ones go one symbol deeper. Settled rows are not
    touched again."""
    order, tied = np.arange(len(symbols)), []
    first, size, level = np.zeros(1, np.int64), np.array([len(symbols)]), np.zeros(1, np.int64)
    while len(first):
        group = np.repeat(np.arange(len(first)), size)
        at = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size) + first[group]
        rows = order[at]
        key = symbols[rows, level[group]]
        low = np.cumsum(size) - size
        a, b, c = key[low], key[low + size // 2], key[low + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[group]
        sides = [key < pivot, key == pivot, key > pivot]
        counts = np.stack([np.add.reduceat(s.astype(np.int64), low) for s in sides])
        begins = first + np.concatenate((np.zeros((1, len(first)), np.int64), np.cumsum(counts, 0)[:2]))
        for side, begin, count in zip(sides, begins, counts, strict=True):
            own = group[side]
            order[begin[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)] = rows[side]
        first, size, level = begins.ravel(), counts.ravel(), np.concatenate((level, level + 1, level))
        many = size > 1
        first, size, level = first[many], size[many], level[many]
        done = level >= depth
        tied += zip(first[done].tolist(), size[done].tolist(), strict=True)
        first, size, level = first[~done], size[~done], level[~done]
    return order, tied


def deep_shallow(rows: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of fixed-width byte rows and the LCP of each with the one before it.

    Multikey quicksort on eight-byte symbols runs to ``shallow`` bytes; groups that are still tied are ordered
    by blind tries over their remaining bytes.
    """
    n, width = rows.shape
    symbols = rows.view(">u8").astype(np.uint64)
    depth = min(shallow // 8, symbols.shape[1])
    order, tied = _multikey(symbols, depth) if n > 1 else (np.arange(n), [])
    step = width - 8 * depth
    for f, m in tied if step else ():
        ids = order[f : f + m]
        tail = rows[ids, 8 * depth :].tobytes()
        order[f : f + m] = ids[_blind_trie([tail[i * step : (i + 1) * step] for i in range(m)])]
    lcp = np.zeros(n, np.int64)
    if n > 1:
        differ = rows[order[1:]] != rows[order[:-1]]
        lcp[1:] = np.where(differ.any(1), differ.argmax(1), width)
    return order, lcp


# ---------------------------------------------------------------- records between chunks and buckets

_HEAD = np.dtype([("doc_id", "<i8"), ("ref", "<u4"), ("start", "<u4"), ("left", "u1"), ("windows", "u1")])


def _pack(head: np.ndarray, body: bytes) -> bytes:
    columns = b"".join(np.ascontiguousarray(head[c]).tobytes() for c in head.dtype.names)
    raw = np.array([len(head), len(columns) + len(body)], "<u4").tobytes() + columns + body
    return raw[:8] + pa.compress(raw[8:], codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size = np.frombuffer(blob, "<u4", 2).tolist()
    raw = pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True)
    head, at = np.zeros(n, _HEAD), 0
    for c in _HEAD.names:
        kind = _HEAD.fields[c][0]
        head[c] = np.frombuffer(raw, kind, n, at)
        at += n * kind.itemsize
    return head, np.frombuffer(raw, np.uint8, offset=at)


def _take_ranges(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.uint8)
    return data[np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)]


def _padded(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int, backwards: bool = False) -> np.ndarray:
    """Rows of ``width`` bytes from ranges of ``data``, zero-filled; backwards reads each range from its end."""
    out = np.zeros((len(starts), width), np.uint8)
    if len(data):
        step = np.arange(width)
        at = (starts + sizes - 1)[:, None] - step if backwards else starts[:, None] + step
        inside = step < sizes[:, None]
        out[inside] = data[np.clip(at, 0, len(data) - 1)][inside]
    return out


def _row_hash(rows: np.ndarray, *more: np.ndarray) -> np.ndarray:
    words = rows.view("<u8")
    h = np.zeros(len(rows), np.uint64)
    for w in range(words.shape[1]):
        h = mix64((h ^ words[:, w]) * MIX_A)
    for x in more:
        h = mix64((h ^ x.astype(np.uint64)) * MIX_A)
    return h


def _leaders(rows: np.ndarray, left: np.ndarray, windows: np.ndarray, doc_id: np.ndarray):
    """Class of each record by whole context, and each class's smallest document; equal hashes are compared in full."""
    h = _row_hash(rows, left, windows)
    order = np.lexsort((doc_id, h))
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        a, b = order[1:], order[:-1]
        same[1:] = (h[a] == h[b]) & (rows[a] == rows[b]).all(1) & (left[a] == left[b]) & (windows[a] == windows[b])
    cls_sorted = np.cumsum(~same) - 1
    first = order[~same]
    low = np.minimum.reduceat(doc_id[order], np.flatnonzero(~same)) if len(order) else doc_id
    cls = np.empty(len(order), np.int64)
    cls[order] = cls_sorted
    return cls, first, low


def resolve(doc_id: np.ndarray, left: np.ndarray, windows: np.ndarray, starts: np.ndarray, data: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of which records also start in a smaller document: record, first and last+1 window (relative).

    Records are anchors with the bytes their windows cover; ``left`` bytes of those stand before the anchor.
    """
    n = len(doc_id)
    left, windows = left.astype(np.int64), windows.astype(np.int64)
    sizes = windows + min_len - 1
    width = (2 * min_len - GRAM + 7) // 8 * 8
    whole = _padded(data, starts, sizes, width)
    cls, first, low = _leaders(whole, left, windows, doc_id)
    full = low[cls] < doc_id
    rec = np.flatnonzero(full)
    out = [(rec, np.zeros(len(rec), np.int64), windows[rec])]
    # what is left: one record of each distinct context (those with its smallest document share its answer)
    d, lf, wn = low, left[first], windows[first]
    right_w, left_w = (min_len + 7) // 8 * 8, (min_len - GRAM + 7) // 8 * 8
    right = _padded(data, starts[first] + lf, np.minimum(sizes[first] - lf, min_len), right_w)
    back = _padded(data, starts[first], lf, left_w, backwards=True)
    gram = _row_hash(np.ascontiguousarray(right[:, :GRAM]))
    _, inv, cnt = np.unique(gram, return_inverse=True, return_counts=True)
    open_ = np.flatnonzero(cnt[inv] > 1)
    if len(open_):
        r_order, r_lcp = deep_shallow(np.ascontiguousarray(right[open_]))
        l_order, l_lcp = deep_shallow(np.ascontiguousarray(back[open_]))
        d, lf, wn = d[open_], lf[open_], wn[open_]
        dup = np.zeros((len(open_), min_len - GRAM + 1), bool)
        r_class, l_class = np.empty(len(open_), np.int64), np.empty(len(open_), np.int64)
        for off in range(min_len - GRAM + 1):
            live = np.flatnonzero((off <= lf) & (lf - off < wn))
            if len(live) < 2:
                continue
            r_class[r_order] = np.cumsum(r_lcp < min_len - off)
            l_class[l_order] = np.cumsum(l_lcp < off)
            key = r_class[live] * (len(open_) + 1) + l_class[live]
            order = np.argsort(key, kind="stable")
            cut = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
            least = np.minimum.reduceat(d[live][order], cut)
            size = np.diff(np.concatenate((cut, [len(live)])))
            dup[live[order], off] = np.repeat(least, size) < d[live][order]
        spread = np.full(len(first), -1)
        spread[open_] = np.arange(len(open_))
        rest = np.flatnonzero(~full)
        rest = rest[spread[cls[rest]] >= 0]
        flags = dup[spread[cls[rest]]]
        keep = flags.any(1)
        rest, flags = rest[keep], flags[keep]
        edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        who, a = np.nonzero(edge == 1)
        _, b = np.nonzero(edge == -1)
        out.append((rest[who], left[rest[who]] - b + 1, left[rest[who]] - a + 1))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if n else (np.zeros(0, np.int64),) * 3


# ---------------------------------------------------------------- the passes


def _open(docs: pa.Table, id_at: int, text_at: int):
    data, offs = column_bytes(docs.column(text_at))
    ids = docs.column(id_at).cast(pa.int64()).fill_null(int(_LAST)).to_numpy()
    th = docs.column("__qf_th").to_numpy()
    keys = np.rec.fromarrays([ids, th])
    _, ref = np.unique(keys, return_inverse=True)
    return data, offs[:-1], offs[1:], ids, ref.reshape(-1)


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _split(by: np.ndarray):
    if not len(by):
        return
    order = np.argsort(by, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], by[order][1:] != by[order][:-1])))
    for a, b in zip(cut, [*cut[1:], len(by)], strict=True):
        yield int(by[order[a]]), order[a:b]


def _sent(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_SENT_ARROW)


def _announce(min_len: int, buckets: int, id_at: int, text_at: int):
    def run(docs: pa.Table) -> pa.Table:
        chunk = docs.column("__qf_chunk")[0].as_py()
        data, starts, ends, ids, _ = _open(docs, id_at, text_at)
        doc, place, lo, hi, key = chunk_anchors(data, starts, ends, min_len)
        order = np.argsort(key, kind="stable")
        k, d = key[order], ids[doc[order]]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
        several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first) if len(k) else np.zeros(0, bool)
        further = np.zeros(len(first), np.int64)  # contexts of an anchor in this chunk, beyond one
        run_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(k))))
        again = np.flatnonzero(several[run_of])
        if len(again):
            at = order[again]
            h = _context_hash(data, lo[at], place[at] - lo[at], hi[at] - lo[at] + 1, min_len)
            own = run_of[again]
            by = np.lexsort((h, own))
            own, h = own[by], h[by]
            np.add.at(further, own[1:][(own[1:] == own[:-1]) & (h[1:] != h[:-1])], 1)
        further = np.minimum(further, 0xFFFF)
        k = k[first]
        rows = []
        for b, at in _split(_bucket(k, buckets)):
            fp = (k[at] & np.uint64(0xFFFFFFFF)).astype("<u4")
            more = further[at]
            bits = np.packbits(several[at]).tobytes() + np.packbits(more > 0).tobytes()
            rows.append((b, np.array([chunk, len(at)], "<u4").tobytes() + fp.tobytes() + bits + more[more > 0].astype("<u2").tobytes()))
        return _sent(rows)

    return run


def _answer(crowd: int):
    """In a bucket: which announced fingerprints occur in two documents or more, told to each chunk that has them, and
    which of those have more than ``crowd`` contexts beyond one per chunk."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("__qf_to")[0].as_py()
        chunks, prints, several, contexts = [], [], [], []
        for blob in table.column("__qf_blob").to_pylist():
            chunk, n = np.frombuffer(blob, "<u4", 2).tolist()
            prints.append(np.frombuffer(blob, "<u4", n, 8))
            at, size = 8 + 4 * n, (n + 7) // 8
            several.append(np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=n).astype(bool))
            varied = np.unpackbits(np.frombuffer(blob, np.uint8, size, at + size), count=n).astype(bool)
            further = np.zeros(n, np.int64)
            further[varied] = np.frombuffer(blob, "<u2", offset=at + 2 * size)
            contexts.append(further)
            chunks.append(np.full(n, chunk, np.int64))
        fp, more, chunk, further = (np.concatenate(x) for x in (prints, several, chunks, contexts))
        order = np.argsort(fp, kind="stable")
        fp, more, chunk, further = fp[order], more[order], chunk[order], further[order]
        equal = fp[1:] == fp[:-1]
        more[1:] |= equal
        more[:-1] |= equal
        fp, chunk, further = fp[more], chunk[more], further[more]
        first = np.flatnonzero(np.append(True, fp[1:] != fp[:-1])) if len(fp) else np.zeros(0, np.int64)
        crowded = np.repeat(np.add.reduceat(further, first) > crowd, np.diff(np.append(first, len(fp)))) if len(fp) else np.zeros(0, bool)
        return _sent([(c // 2, np.array([bucket, c % 2], "<u4").tobytes() + fp[at].tobytes()) for c, at in _split(2 * chunk + crowded)])

    return run


def _context_hash(data: np.ndarray, lo: np.ndarray, left: np.ndarray, windows: np.ndarray, min_len: int) -> np.ndarray:
    width, step = (2 * min_len - GRAM + 7) // 8 * 8, 1 << 16
    parts = [slice(i, i + step) for i in range(0, len(lo), step)]
    return np.concatenate([_row_hash(_padded(data, lo[p], windows[p] + min_len - 1, width), left[p], windows[p]) for p in parts] or [np.zeros(0, np.uint64)])


def _settle(data: np.ndarray, doc_id: np.ndarray, lo: np.ndarray, left: np.ndarray, windows: np.ndarray, h: np.ndarray, min_len: int) -> np.ndarray:
    """Which records of a chunk have the bytes and the place of a record of a smaller document; equal hashes are compared
    in full."""
    width, step = (2 * min_len - GRAM + 7) // 8 * 8, 1 << 16
    order = np.lexsort((doc_id, h))
    gone = np.zeros(len(order), bool)
    if not len(order):
        return gone
    new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    for i in range(0, len(order), step):
        a, b = order[i : i + step], lead[i : i + step]
        same = (left[a] == left[b]) & (windows[a] == windows[b]) & (doc_id[a] > doc_id[b])
        a, b = a[same], b[same]
        equal = (_padded(data, lo[a], windows[a] + min_len - 1, width) == _padded(data, lo[b], windows[b] + min_len - 1, width)).all(1)
        gone[a[equal]] = True
    return gone


def _contexts(min_len: int, buckets: int, id_at: int, text_at: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows or not told.num_rows:
            return _sent([])
        chunk = docs.column("__qf_chunk")[0].as_py()
        data, starts, ends, ids, ref = _open(docs, id_at, text_at)
        doc, place, lo, hi, key = chunk_anchors(data, starts, ends, min_len)
        shared, crowded = [], []
        for blob in told.column("__qf_blob").to_pylist():
            v = np.frombuffer(blob, "<u4")
            shared.append((np.uint64(v[0]) << np.uint64(32)) | v[2:].astype(np.uint64))
            crowded.append(np.full(len(v) - 2, v[1] == 1))
        shared, crowded = np.concatenate(shared), np.concatenate(crowded)
        order = np.argsort(shared, kind="stable")
        shared, crowded = shared[order], crowded[order]
        bucket = _bucket(key, buckets)
        mine = (bucket.astype(np.uint64) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))
        at = np.minimum(np.searchsorted(shared, mine), len(shared) - 1)
        pick = np.flatnonzero(shared[at] == mine)
        doc, lo, bucket, crowded = doc[pick], lo[pick], bucket[pick], crowded[at[pick]]
        left, windows = place[pick] - lo, hi[pick] - lo + 1
        # records of one chunk with equal bytes: the smallest document speaks, larger ones are settled here
        gone = _settle(data, ids[doc], lo, left, windows, _context_hash(data, lo, left, windows, min_len), min_len)
        done = [(doc[gone], lo[gone], windows[gone])]
        apart = np.flatnonzero(crowded & ~gone)
        rest = np.flatnonzero(~crowded & ~gone)
        if len(apart):  # windows of crowded anchors go by their own bytes, again one record each per chunk
            many = windows[apart]
            w_doc = np.repeat(doc[apart], many)
            w_lo = np.arange(len(w_doc)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[apart], many)
            w_left, one = np.repeat(left[apart] + lo[apart], many) - w_lo, np.ones(len(w_doc), np.int64)
            h = _context_hash(data, w_lo, w_left, one, min_len)
            gone = _settle(data, ids[w_doc], w_lo, w_left, one, h, min_len)
            done.append((w_doc[gone], w_lo[gone], one[gone]))
            own = [w_doc[~gone], w_lo[~gone], w_left[~gone], one[~gone], _bucket(mix64(h[~gone] ^ MIX_C), buckets)]
            doc, lo, left, windows, bucket = (np.concatenate((x[rest], y)) for x, y in zip((doc, lo, left, windows, bucket), own, strict=True))
        else:
            doc, lo, left, windows, bucket = doc[rest], lo[rest], left[rest], windows[rest], bucket[rest]
        rows = []
        d, a, n = (np.concatenate(x) for x in zip(*done, strict=True))
        if len(d):
            rows.append((-1 - chunk, _spans_blob(*_merged(ref[d], a - starts[d], a + n + min_len - 1 - starts[d]))))
        for b, at in _split(bucket):
            head = np.zeros(len(at), _HEAD)
            head["doc_id"], head["ref"], head["start"] = ids[doc[at]], ref[doc[at]], lo[at] - starts[doc[at]]
            head["left"], head["windows"] = left[at], windows[at]
            body = _take_ranges(data, lo[at], windows[at] + min_len - 1)
            rows.append((b, np.array([chunk], "<u4").tobytes() + _pack(head, body.tobytes())))
        return _sent(rows)

    return run


def _spans_blob(ref: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    raw = ref.astype("<u4").tobytes() + start.astype("<u4").tobytes() + end.astype("<u4").tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True) + np.array([len(ref)], "<u4").tobytes()


def _judge(min_len: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("__qf_to")[0].as_py()
        if bucket < 0:  # settled inside its own chunk
            return _sent([(-1 - bucket, blob) for blob in table.column("__qf_blob").to_pylist()])
        heads, bodies, chunks = [], [], []
        for blob in table.column("__qf_blob").to_pylist():
            head, body = _unpack(blob[4:])
            heads.append(head)
            bodies.append(body)
            chunks.append(np.full(len(head), np.frombuffer(blob, "<u4", 1)[0], np.int64))
        head, data, chunk = np.concatenate(heads), np.concatenate(bodies), np.concatenate(chunks)
        sizes = head["windows"].astype(np.int64) + min_len - 1
        starts = np.cumsum(sizes) - sizes
        rec, a, b = resolve(head["doc_id"], head["left"], head["windows"], starts, data, min_len)
        at = head["start"][rec].astype(np.int64)
        return _sent([(c, _spans_blob(head["ref"][rec[i]], at[i] + a[i], at[i] + b[i] + min_len - 1)) for c, i in _split(chunk[rec])])

    return run


def _merged(ref: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of byte ranges per document; ranges that touch become one."""
    order = np.lexsort((start, ref))
    ref, start, end = ref[order], start[order], end[order]
    if not len(ref):
        return ref, start, end
    wide = np.int64(1) << np.int64(33)
    reach = np.maximum.accumulate(ref * wide + end)
    new = np.concatenate(([True], (ref[1:] != ref[:-1]) | (ref[1:] * wide + start[1:] > reach[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(ref)])) - 1
    return ref[first], start[first], reach[last] - ref[first] * wide


def _whole_characters(raw: bytes, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The cuts, widened to whole UTF-8 characters."""
    out = []
    for a, b in cuts:
        while 0 < a < len(raw) and raw[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(raw) and raw[b] & 0xC0 == 0x80:
            b += 1
        a = max(a, out[-1][1]) if out else a
        out.append((a, b))
    return out


def _cut(id_at: int, text_at: int, keep: int, schema: pa.Schema, in_text: bool):
    """Adds what stays and the spans, or with ``in_text`` puts what stays (whole characters) in the text's place."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        data, starts, ends, _, ref = _open(docs, id_at, text_at)
        refs, froms, tos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for blob in told.column("__qf_blob").to_pylist():
            n = int(np.frombuffer(blob[-4:], "<u4")[0])
            v = np.frombuffer(pa.decompress(blob[:-4], decompressed_size=12 * n, codec="zstd"), "<u4").astype(np.int64)
            refs.append(v[:n])
            froms.append(v[n : 2 * n])
            tos.append(v[2 * n :])
        r, a, b = _merged(np.concatenate(refs), np.concatenate(froms), np.concatenate(tos))
        lo, hi = np.searchsorted(r, ref, "left"), np.searchsorted(r, ref, "right")
        kept, spans, raw = [], [], data.tobytes()
        for i, (s, e, x, y) in enumerate(zip(starts.tolist(), ends.tolist(), lo.tolist(), hi.tolist(), strict=True)):
            if x == y:
                kept.append(raw[s:e])
                spans.append([])
                continue
            cuts = list(zip(a[x:y].tolist(), b[x:y].tolist(), strict=True))
            if in_text:
                cuts = _whole_characters(raw[s:e], cuts)
            edges = [0, *[v for c in cuts for v in c], e - s]
            kept.append(b"".join(raw[s + edges[j] : s + edges[j + 1]] for j in range(0, len(edges), 2)))
            spans.append([{"start": p, "end": q} for p, q in cuts])
        columns = [docs.column(i) for i in range(keep)]
        if in_text:
            there = columns[text_at].is_valid().to_pylist()
            columns[text_at] = pa.array([k if v else None for k, v in zip(kept, there, strict=True)], pa.binary()).cast(schema.field(text_at).type)
            return pa.Table.from_arrays(columns, schema=schema)
        return pa.Table.from_arrays([*columns, pa.array(kept, pa.binary()), pa.array(spans, schema.field(keep + 1).type)], names=schema.names)

    return run


def _judged(docs: DataFrame, min_len: int, id_col: str, text_col: str, chunk_bytes: int | None, bucket_bytes: int | None, crowd: int) -> tuple[DataFrame, DataFrame]:
    """The documents dealt in chunks, and the removed ranges sent back to each chunk."""
    if min_len < GRAM + 8 or min_len > 128:
        raise ValueError(f"min_len must be from {GRAM + 8} to 128")
    spark, names = docs.sparkSession, docs.columns
    id_at, text_at = names.index(id_col), names.index(text_col)
    total = text_bytes(docs, text_col)
    chunk_bytes = chunk_bytes or min(max(total // CHUNKS, LEAST_CHUNK), MOST_CHUNK)
    bucket_bytes = bucket_bytes or chunk_bytes // 2
    n_chunks, n_buckets = max(1, total // chunk_bytes + 1), max(1, total // bucket_bytes + 1)
    parts = parts_for(spark, total, 4 * chunk_bytes if chunk_bytes <= LEAST_CHUNK else chunk_bytes)
    dealt = docs.select(
        *[F.col(f"`{c}`") for c in names],
        F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(n_chunks)).cast("int").alias("__qf_chunk"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("__qf_th"),
    ).repartition(parts, "__qf_chunk")
    announced = dealt.groupBy("__qf_chunk").applyInArrow(_announce(min_len, n_buckets, id_at, text_at), _SENT)
    told = announced.groupBy("__qf_to").applyInArrow(_answer(crowd), _SENT)
    sent = dealt.groupBy("__qf_chunk").cogroup(told.groupBy("__qf_to")).applyInArrow(_contexts(min_len, n_buckets, id_at, text_at), _SENT)
    return dealt, sent.groupBy("__qf_to").applyInArrow(_judge(min_len), _SENT)


def cut_repeats(docs: DataFrame, *, min_len: int = 50, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int | None = None, bucket_bytes: int | None = None, crowd: int = CROWD) -> DataFrame:
    """Every row of ``docs``, with all its columns, its text without the bytes that ``remove_repeats`` removes; a character
    that would lose some of its bytes goes whole, so that every text is valid. Defined cases are those of
    ``remove_repeats``, but a null text stays null, and columns of any name pass unchanged."""
    names = docs.columns
    dealt, judged = _judged(docs, min_len, id_col, text_col, chunk_bytes, bucket_bytes, crowd)
    cut = _cut(names.index(id_col), names.index(text_col), len(names), to_arrow_schema(docs.schema), True)
    return dealt.groupBy("__qf_chunk").cogroup(judged.groupBy("__qf_to")).applyInArrow(cut, docs.schema)


def remove_repeats(docs: DataFrame, *, min_len: int = 50, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int | None = None, bucket_bytes: int | None = None, crowd: int = CROWD) -> DataFrame:
    """Every row of ``docs`` with ``kept_bytes`` (what stays of its text) and ``spans`` (the byte ranges removed).

    A byte is removed if some ``min_len``-byte string over it also starts in a row with a smaller id; strings are
    judged on the input. Defined cases: a null text is empty; texts under ``min_len`` bytes stay whole; rows with
    one id do not remove each other's bytes; a null id counts as larger than all ids; an empty table gives an empty
    table; input columns named like an added column are replaced. ``chunk_bytes`` and ``bucket_bytes`` are the text
    a task holds when it scans documents and the text whose anchors meet in one bucket; they follow from the total
    unless given: 8 MB a chunk up to 32 GB of text, then a 4096th of it up to 128 MB, so that blobs stay few and large. ``crowd`` is the number of contexts
    from which an anchor's records are split by window; it changes no result.
    """
    docs = without(docs, "kept_bytes", "spans")
    names = docs.columns
    id_at, text_at = names.index(id_col), names.index(text_col)
    dealt, judged = _judged(docs, min_len, id_col, text_col, chunk_bytes, bucket_bytes, crowd)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = T.StructType([*docs.schema.fields, T.StructField("kept_bytes", T.BinaryType()), T.StructField("spans", span)])
    arrow = to_arrow_schema(out)
    return dealt.groupBy("__qf_chunk").cogroup(judged.groupBy("__qf_to")).applyInArrow(_cut(id_at, text_at, len(names), arrow, False), out)


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = remove_repeats(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.col("kept_bytes"), 256).alias("kept_sha256"),
    )
