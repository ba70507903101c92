"""Every operator against brute force on the small tables, and on odd rows: nulls, empty and long texts, ties, repeated
rows, empty tables, extra columns whose names clash."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillframe.llm import decontaminate, language_id, minhash_dedup, packing, quality_rules, suffix_dedup, token_counts, token_files, url_filters, warc
from quillframe.llm.components import components
from quillframe.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import brute
from tests.oracle import connection, differences

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i % 7000} and{i % 13}" for i in range(40_000))
ODD = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two"), (5, "One TWO"), (6, "é" * 60), (7, "é" * 60), (8, LONG), (9, LONG), (10, "#" * 200), (11, LONG[:5000]), (12, "\x00\x01 tail")]


@pytest.fixture(scope="module")
def docs(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with columns named like what operators add, in other cases too."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, "x", 1, True, [1]) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, Kept_Bytes string, n_tokens int, kept boolean, spans array<int>")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def run(spark, name):
    return [tuple(r) for r in QUERIES[name](spark, SF).collect()]


def test_sql_oracles(spark):
    con = connection(SF)
    for name, sql in ORACLE_SQL.items():
        assert not differences(spark, SF, QUERIES[name], sql, con), name


def test_suffix_dedup(spark, docs, odd, none):
    assert {r[0]: r for r in run(spark, "op2_suffix_array_dedup")} == brute.repeats(docs)
    got = suffix_dedup.remove_repeats(odd, chunk_bytes=20_000, bucket_bytes=10_000).collect()
    want = brute.repeats([r for r in ODD])
    assert {r.doc_id: hashlib.sha256(bytes(r.kept_bytes)).hexdigest() for r in got} == {i: w[4] for i, w in want.items()}
    assert suffix_dedup.remove_repeats(none).count() == 0
    twice = spark.createDataFrame([(1, "a" * 80), (1, "a" * 80), (None, "a" * 80), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id is None, len(r.kept_bytes)) for r in suffix_dedup.remove_repeats(twice).collect()) == [(False, 0), (False, 80), (False, 80), (True, 0)]


def test_suffix_dedup_on_few_letters(spark):
    rnd = random.Random(3)
    base = "".join(rnd.choice("ab") for _ in range(300))
    rows = []
    for i in range(100):
        a = rnd.randrange(200)
        rows.append((i, "".join(rnd.choice("abc") for _ in range(rnd.randrange(60))) + base[a : a + rnd.randrange(30, 120)] + "a" * rnd.choice([0, 0, 90])))
    want = brute.repeats(rows)
    for crowd in (0, 5, suffix_dedup.CROWD):
        got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=1500, bucket_bytes=700, crowd=crowd).collect()
        assert len(got) == len(rows)
        assert all((hashlib.sha256(bytes(r.kept_bytes)).hexdigest(), len(r.spans)) == (want[r.doc_id][4], want[r.doc_id][3]) for r in got)


def test_suffix_dedup_splits_the_edges_of_common_passages(spark):
    """A passage in every document, each time in another context: no bucket holds many records of one anchor."""
    rnd = random.Random(9)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(120))
    rows = [(i, "".join(rnd.choice("abcdefgh ") for _ in range(40)) + passage + "".join(rnd.choice("abcdefgh ") for _ in range(40))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.repeats(rows)
    columns = {"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "__qf_th": [r[0] for r in rows]}
    table = pa.table(columns).append_column("__qf_chunk", pa.array([0] * len(rows), pa.int32()))
    told = suffix_dedup._announce(50, 4096, 0, 1)(table)
    largest = []
    for crowd in (10, suffix_dedup.CROWD):
        got = suffix_dedup.remove_repeats(df, chunk_bytes=6000, bucket_bytes=3000, crowd=crowd).collect()
        assert {r.doc_id: hashlib.sha256(bytes(r.kept_bytes)).hexdigest() for r in got} == {i: w[4] for i, w in want.items()}
        answers = [suffix_dedup._answer(crowd)(told.filter(pa.compute.equal(told["__qf_to"], b))) for b in told["__qf_to"].unique()]
        sent = suffix_dedup._contexts(50, 4096, 0, 1)(table, pa.concat_tables(answers))
        largest.append(max(len(suffix_dedup._unpack(x[4:])[0]) for b, x in zip(sent["__qf_to"].to_pylist(), sent["__qf_blob"].to_pylist(), strict=True) if b >= 0))
    assert largest[0] < 30 and largest[1] > 250, largest


def test_cut_repeats_keeps_whole_characters(spark, odd, none):
    """Cuts fall inside of characters; the input's own U+FFFD and columns named like the operator's stay."""
    tail = "é" * 40 + " \ufffd same words at the end of both texts, over fifty bytes long"
    rows = [(1, "a" + tail, "mine"), (2, "\ufffd b\ufffd 漢" + tail[1:], "mine"), (3, None, None), (4, "\ufffd", "x"), (None, "a" + tail, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: (r.text, r.spans) for r in suffix_dedup.cut_repeats(df).collect()}
    assert got == {1: rows[0][1:], 2: ("\ufffd b\ufffd 漢", "mine"), 3: (None, None), 4: ("\ufffd", "x"), None: ("", "y")}
    assert suffix_dedup.cut_repeats(odd).columns == odd.columns and suffix_dedup.cut_repeats(none).count() == 0
    rnd = random.Random(11)
    base = [rnd.choice("aé漢🙂 ") for _ in range(200)]
    rows = [(i, "".join(base[(a := rnd.randrange(150)) : a + rnd.randrange(10, 50)]) + rnd.choice("aé漢🙂") * rnd.randrange(3)) for i in range(60)]
    want = {}
    for i, t, *_ in ((i, t) for i, t in rows):
        raw, seen = t.encode(), [u.encode() for j, u in rows if j < i]
        gone = set()
        for p in range(len(raw) - 49):
            if any(raw[p : p + 50] in u for u in seen):
                gone |= set(range(p, p + 50))
        kept, at = "", 0
        for c in t:
            size = len(c.encode())
            kept += "" if gone & set(range(at, at + size)) else c
            at += size
        want[i] = kept
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in suffix_dedup.cut_repeats(df, chunk_bytes=900, bucket_bytes=400).collect()} == want


def test_deep_shallow_orders_like_sorting():
    rnd = random.Random(4)
    for n in (0, 1, 2, 700):
        wide = np.array([[rnd.choice([0, 1, 2, 255]) for _ in range(24)] for _ in range(n)], np.uint8).reshape(n, 24)
        order, _ = suffix_dedup.deep_shallow(wide, 16)
        assert [bytes(wide[i]) for i in order] == sorted(bytes(r) for r in wide)
    rows = [bytes(rnd.choice(b"ab") for _ in range(8)) * 3 + bytes(rnd.choice(b"ab\0") for _ in range(16)) for _ in range(500)]
    order, lcp = suffix_dedup.deep_shallow(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 40).copy())
    assert [rows[i] for i in order] == sorted(rows)
    for a, b, n in zip(order[:-1], order[1:], lcp[1:], strict=True):
        assert rows[a][:n] == rows[b][:n] and (n == 40 or rows[a][n] != rows[b][n])


def test_minhash(spark, docs, odd, none):
    assert {r[0]: r for r in run(spark, "op5_minhash_near_dedup")} == brute.near_duplicates(docs, 2)
    assert {r[0]: tuple(r) for r in minhash_dedup.near_duplicates(odd, words=2).collect()} == brute.near_duplicates(ODD, 2)
    assert minhash_dedup.near_duplicates(none).count() == 0
    kept = minhash_dedup.keep_first_of_each(odd)
    assert kept.columns == odd.columns and 9 not in {r.doc_id for r in kept.collect()}


def test_minhash_crowds(spark):
    """Many edited copies of few texts: lists longer than ``short_list`` go the way of the shingles."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for size in (6, 40, 120):
        base = [rnd.choice(words) for _ in range(size)]
        for _ in range(60):
            w = list(base)
            for _ in range(rnd.randrange(0, max(2, size // 6))):
                w[rnd.randrange(size)] = rnd.choice(words)
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: tuple(r) for r in minhash_dedup.near_duplicates(df, words=2, short_list=4).collect()} == brute.near_duplicates(rows, 2)


def test_components(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if n != r}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_quality(spark, docs, odd, none):
    texts = dict(docs)
    for r in run(spark, "op3_quality_rules"):
        assert r[1:7] == brute.figures(texts[r[0]])
        assert not (r[6] and r[7])
    assert {r.doc_id: tuple(r)[1:7] for r in quality_rules.score(odd).collect()} == {i: brute.figures(t) for i, t in ODD}
    assert quality_rules.score(none).count() == 0 and quality_rules.keep_good(none).count() == 0
    assert quality_rules.keep_good(odd).columns == odd.columns
    clean = "Some plain sentences about nothing in particular, with words of common lengths, one after another. " * 1
    rows = [(i, " ".join(f"{w}{'' if k else i}" for k, w in enumerate((clean * 8).split()) if hash((i, k)) % 3)) for i in range(40)] + [(100, " ".join(f"x{i}%%%" for i in range(100)))]
    kept = {r.doc_id for r in quality_rules.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.kept}
    assert 100 not in kept


def test_warc(spark, none):
    def want(rows):
        top = collections.defaultdict(int)
        for i, h in rows:
            top[h or ""] = max(top[h or ""], i)
        out = []
        for i, h in rows:
            b = (h or "").encode()
            last = top[h or ""]
            out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if last == i else "revisit", None if last == i else last))
        return sorted(out, key=str)

    pages = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    assert sorted(run(spark, "op4_warc_segments"), key=str) == want(pages)
    rows = [(1, "x"), (2, "x"), (3, None), (4, ""), (5, "é" * 90_000), (6, "é" * 90_000), (7, "abc" * 30_000), (8, "0\r\n\r\n")]
    df = spark.createDataFrame([(i, None if i == 3 else f"http://a/ {i}", h) for i, h in rows], "page_id long, url string, html string")
    assert sorted((tuple(r) for r in warc.read_archives(warc.write_archives(df, archive_bytes=1000)).collect()), key=str) == want(rows)
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0
    loose = spark.createDataFrame([(None, "u", "a" * 70_000), (9, "u", "b" * 70_000), (9, "u", "b" * 70_000)], "page_id long, url string, html string")
    assert sorted((r.page_id is None, r.payload_bytes, r.record_type) for r in warc.read_archives(warc.write_archives(loose)).collect()) == [(False, 70_000, "response")] * 2 + [(True, 70_000, "response")]


def test_warc_reads_other_writers(spark, tmp_path):
    """Version 1.0, records of other types, no digest, a digest of the coded body, foreign identifiers."""
    body = warc.chunked(b"<p>text</p>", 4)
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    made = [warc._record("warcinfo", "urn:uuid:1", [], b"software: x\r\n"), warc._record("request", "urn:uuid:2", [], b"GET / HTTP/1.1\r\n\r\n")]
    made += [warc._record("response", "urn:uuid:3", [("WARC-Payload-Digest", "sha1:" + warc.digest_of(body))], http + body)]
    made += [warc._record("response", "urn:uuid:4", [], b"HTTP/1.1 200 OK\r\n\r\nplain"), warc._record("revisit", "urn:uuid:5", [], http), warc._record("metadata", "urn:uuid:6", [], b"a: b")]
    old = b"".join(zlib.compress(zlib.decompress(m, 31).replace(b"WARC/1.1", b"WARC/1.0"), wbits=31) for m in made)
    (tmp_path / "x.warc.gz").write_bytes(old)
    manifest = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", 1)], "path string, bytes long")
    got = sorted((r.record_type, r.payload_bytes, r.payload_digest) for r in warc.read_archives(manifest).collect() if r.record_type == "response")
    assert got == [("response", 5, warc.digest_of(b"plain")), ("response", 11, warc.digest_of(b"<p>text</p>"))]
    (tmp_path / "bad.warc.gz").write_bytes(warc._record("response", "urn:uuid:7", [("WARC-Payload-Digest", "sha1:" + "A" * 32)], http + body))
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/bad.warc.gz", 1)], "path string, bytes long")).collect()


def test_warc_rejects_incomplete_segments():
    parts = [{"page_id": 1, "payload_digest": "D", "origin": "o", "segment": k, "total": None, "block": b"x"} for k in (1, 3)]
    with pytest.raises(ValueError):
        warc._assemble(pa.Table.from_pylist(parts))


def test_language(spark, odd, none):
    lang = {r[0]: r[1] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op6_language_family"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(lang) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    pred = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(odd, learn_from=F.lit(True)).collect()}
    assert pred[0] == pred[1] == pred[2] == pred[10] == ("und", 0.0) and pred[3][0] == "en"
    assert language_id.identify(none, learn_from=F.lit(True)).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, learn_from=F.lit(False)).collect()} == {"und"}


def test_urls(spark):
    urls = ["http://A.example.com/en/7x?q", "https://example.com/en/8", "noscheme.com/en/", None, "http://net/de/9", "http://www.example.net/de/81#z", "x://a.net/de/", "http://notexample.com/en/7", "http://h", "", "http://org/es/"]
    rows = [(i, u) for i, u in enumerate(urls)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[1][2:] == ("com/en/", "block") and got[2][:3] == ("", "", None) and got[3][:3] == ("", "", None)
    assert got[4][2:] == ("net/de/", "allow") and got[5][2:] == ("example.net/de/8", "block") and got[6][2:] == ("net/de/", "allow")
    assert got[7][2:] == ("com/en/", "block") and got[8][:3] == ("h", "", None) and got[10][2:] == ("org/es/", "block")
    assert url_filters.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    bad = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.xyz/{i}") for i in range(200)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "page_id long, bad int")
    verdicts = {(r.host, r.verdict) for r in url_filters.judge_urls(bad, labels).collect()}
    assert verdicts == {("bad.xyz", "block"), ("good.xyz", "allow")}


def test_decontamination(spark, docs, odd, none):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r[0], r[1]) for r in bench.select("item_id", "text").collect()]
    held = decontaminate.Items(items, 0.08)
    folded = {i: decontaminate.normalised(np.frombuffer((t or "").encode(), np.uint8)).tobytes() for i, t in docs}
    want = {(i, held.ids[k]) for i, b in folded.items() for k, p in enumerate(held.bytes) if decontaminate.edit_distance_within(p.tobytes(), b, held.most[k])[0] <= held.most[k]}
    assert {r[:2] for r in run(spark, "op8_benchmark_leaks")} == want and want
    assert decontaminate.find_leaks(odd, bench).count() == 0 and decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.find_leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.drop_leaks(odd, bench).columns == odd.columns


def test_decontamination_recall_at_the_largest_distance(docs):
    rnd = random.Random(7)
    items = [(i, " ".join(rnd.choice("alpha beta gamma delta river stone cloud under over seven eight".split()) + str(rnd.randrange(99)) for _ in range(rnd.randrange(15, 40)))) for i in range(12)]
    held = decontaminate.Items(items, 0.08)
    texts, truth = [], []
    for n in range(150):
        k = rnd.randrange(12)
        x = list(items[k][1])
        for _ in range(held.most[k]):
            p = rnd.randrange(len(x))
            x[p : p + rnd.randrange(2)] = rnd.choice(["q", "", "zz"])
        t = decontaminate.normalised(np.frombuffer(("some text before " + "".join(x) + " and after").encode(), np.uint8))
        texts.append(t)
        if decontaminate.edit_distance_within(held.bytes[k].tobytes(), t.tobytes(), held.most[k])[0] <= held.most[k]:
            truth.append((n, k))
    found = {(t, k) for t, k, _, _ in decontaminate.matches(held, texts)}
    assert len(truth) > 50 and sum(x in found for x in truth) >= 0.99 * len(truth)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_counts(spark, odd, none, tokenizer):
    edits = F.array(F.struct(F.lit(1).alias("start"), F.lit(4).alias("end"), F.lit("new ").alias("replacement")))
    got = {r.doc_id: (r.n_tokens, r.n_tokens_edited) for r in token_counts.count_edited(odd, edits, vocabulary=VOCABULARY).collect()}
    for i, t in ODD:
        t = t or ""
        assert got[i] == (len(ids_of(tokenizer, t, 0)) - 1, len(ids_of(tokenizer, t[:1] + "new " + t[4:], 0)) - 1)
    assert token_counts.count_edited(none, edits, vocabulary=VOCABULARY).count() == 0


def test_token_files(spark, docs, odd, none, tokenizer):
    for rows, got in ((docs, run(spark, "op9_token_files")), (ODD, [tuple(r) for r in token_files.read_documents(token_files.write_tokens(odd, vocabulary=VOCABULARY, end_id=2)).collect()])):
        at, want = 0, {}
        for i, t in sorted(rows):
            x = ids_of(tokenizer, t, 2)
            want[i] = (i, at, len(x), zlib.crc32(x.tobytes()))
            at += len(x)
        assert {r[0]: r for r in got} == want
    manifest = token_files.write_tokens(odd, vocabulary=VOCABULARY, end_id=2, length=64)
    first = manifest.orderBy("part").first()
    ids, mask = token_files.sequence(first["path"], 0)
    assert len(ids) == len(mask) == 64 and ids[0].as_py() == 2
    assert token_files.read_documents(token_files.write_tokens(none, vocabulary=VOCABULARY, end_id=2)).count() == 0


def test_packing(spark, docs, odd, none, tokenizer):
    for rows, pieces in ((docs, QUERIES["op10_mixture_packing"](spark, SF).collect()), (ODD, packing.pack(odd, vocabulary=VOCABULARY, file_tokens=20_000).collect())):
        by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
        for r in pieces:
            by_doc[r.doc_id].append(r)
            by_seq[r.sequence_id].append(r)
        for i, t in rows:
            x, at = ids_of(tokenizer, t, 0), 0
            for r in sorted(by_doc[i], key=lambda r: r.start):
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(x), zlib.crc32(x[at : at + r.length].tobytes()))
                at += r.length
            assert at == len(x)
        for seq in by_seq.values():
            at = 0
            for r in sorted(seq, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 1024 and {r.padded_length for r in seq} == {at if at & (at - 1) == 0 else 1024}
        assert len(by_seq) <= sum(r.length for r in pieces) // 1024 + 10
    assert packing.pack(none, vocabulary=VOCABULARY).count() == 0


def test_packing_keeps_proportions():
    queues = {s: collections.deque((k, 500) for k in range(n)) for s, n in (("a", 60), ("b", 30), ("c", 10))}
    weights = {"a": 0.6, "b": 0.3, "c": 0.1}
    held = collections.defaultdict(collections.Counter)
    for s, _, _, size, window, _ in packing.deal(queues, weights, dict.fromkeys(weights, 0.0), 1000, 50):
        held[window][s] += size
    assert sum(sum(c.values()) for c in held.values()) == 50_000
    for w in range(40):
        assert abs(held[w]["a"] - 600) <= 150 and abs(held[w]["c"] - 100) <= 100
    assert all(sum(held[w].values()) == 1000 for w in range(49))


def test_packing_keeps_proportions_on_documents_stored_by_source(spark):
    """Each source in partitions of its own, one with a third of all rows."""
    rows = [(i, f"some words of {s} number {i} " * (5 + i % 7), s) for i, s in enumerate(sorted("aaaabbbbccdd" * 100))]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 6), "doc_id long, text string, source string")

    def windows(**shares):
        held, seen = collections.defaultdict(collections.Counter), collections.Counter()
        for r in packing.pack(df, vocabulary=VOCABULARY, file_tokens=16_000, **shares).collect():
            held[r.sequence_id][r.source] += r.length
            seen[r.doc_id] += r.length
            assert r.start + r.length <= r.doc_tokens
        assert len(seen) == len(rows)
        assert all(sum(held[w].values()) == 1024 for w in sorted(held)[:-1])
        return [held[w] for w in sorted(held)]

    mixed = windows()
    total = sum(mixed, collections.Counter())
    assert len(mixed) > 30
    for w in mixed[:-1]:
        assert all(abs(w[s] - 1024 * n / total.total()) <= 256 for s, n in total.items())
    given = windows(shares={"c": 0.5, "a": 0.5})  # c is used up first, then a, and only then come b and d
    assert sum(given, collections.Counter()) == total
    both = 2 * total["c"] // 1024 - 2
    assert all(abs(w["c"] - 512) <= 256 and w["b"] + w["d"] <= 2 for w in given[:both])
    assert all(w["b"] + w["d"] <= 2 for w in given[: (total["a"] + total["c"]) // 1024 - 1])


def test_apportioning_is_exact_and_monotone():
    totals, weights = np.array([50_000, 7, 1, 20_011, 3000]), np.array([0.3, 0.2, 1e-9, 0.4, 0.1])
    rows = [packing.apportioned(totals, weights, n) for n in range(0, 73_100, 37)]
    assert all(r.sum() == min(37 * k, totals.sum()) for k, r in enumerate(rows))
    assert (np.diff(np.stack(rows), axis=0) >= 0).all() and (rows[-1] == totals).all()


def test_decontamination_finds_short_items(spark):
    items = spark.createDataFrame([(1, " What is the  capital of Peru?"), (2, "Lima"), (3, "秘鲁的首都"), (4, " "), (5, "what is the capital of peru?"), (6, None)], "item_id long, text string")
    texts = ["Asked: “what IS the\ncapital of Peru?” Yes.", "What is the capital of Perugia?", "limas and dilima", "é, lima.", "问秘鲁的首都在哪里", "", None, "Élima", "in Lima, lima"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.edit_distance, r.item_bytes) for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {(0, 1, 0, 28), (0, 5, 0, 28), (3, 2, 0, 4), (4, 3, 0, 15), (8, 2, 0, 4)}
    ends = {(r.doc_id, r.item_id): r.match_end for r in decontaminate.find_leaks(docs, items).collect()}
    assert ends[8, 2] == 7 and ends[3, 2] == 8
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, items).collect()} == {1, 2, 5, 6, 7}


def test_language_of_numerals_is_undetermined(spark):
    rows = [(1, "le chat et la souris", "fr"), (2, "the cat and the mouse", "en"), (3, "½", None), (4, "² ²", None), (5, "٣ 四", None), (6, "Ⅷ _", None), (7, "½ a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df, learn_from=F.lit(True)).collect()}
    assert got[3] == got[4] == got[6] == ("und", 0.0) and got[7][0] != "und" and got[5][0] != "und"  # 四 is a letter


def test_language_learns_every_label(spark):
    """70 labels, each with words of its own."""
    rnd = random.Random(8)
    words = {f"x{k:02d}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(6)] for k in range(70)}
    rows = [(70 * n + k, " ".join(rnd.choices(words[name], k=20)), name) for n in range(4) for k, name in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for more in ({}, {"sample_rows": 150}):
        got = {r.doc_id: r.lang_pred for r in language_id.identify(df, learn_from=F.col("doc_id") < 210, **more).collect()}
        assert set(got.values()) == set(words)
        assert sum(got[i] == name for i, _, name in rows) >= 0.97 * len(rows)


def test_quality_verdicts_follow_an_independent_fit(spark):
    """``kept`` and the estimated accuracies against a plain row-by-row expectation-maximisation."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    measured = quality_rules.figures(rows, "text", [F.col("doc_id")])
    names = list(quality_rules.RULES)
    votes = {r[0]: [r[k] for k in names] for r in measured.select("doc_id", *[rule().alias(k) for k, rule in quality_rules.RULES.items()]).collect()}
    prior = np.array(quality_rules.PRIOR)
    cast = np.array([[[v == 0, v == 1, v is None] for v in vs] for vs in votes.values()], float)
    share, table = 0.9, np.repeat((prior / prior.sum(1, keepdims=True))[None], len(names), 0)
    for _ in range(200):
        odds = np.log(share / (1 - share)) + (cast[:, :, :2] * np.log(table[:, 0] / table[:, 1])[None, :, :2]).sum((1, 2))
        p = 1 / (1 + np.exp(-odds))
        share = (9 + p.sum()) / (10 + len(p))
        tally = np.stack([(cast * p[:, None, None]).sum(0), (cast * (1 - p)[:, None, None]).sum(0)], 1) + prior
        table = tally / tally.sum(2, keepdims=True)
    odds = np.log(share / (1 - share)) + (cast[:, :, :2] * np.log(table[:, 0] / table[:, 1])[None, :, :2]).sum((1, 2))
    want = dict(zip(votes, 1 / (1 + np.exp(-odds)), strict=True))
    for r in quality_rules.score(rows).collect():
        assert abs(r.p_good - want[r.doc_id]) < 1e-6 and r.kept == (not r.base_failed and want[r.doc_id] >= 0.5)


def test_quality_of_a_very_long_text(spark):
    """Repeats at places past 2 ** 22: one three-word window stands twice there."""
    n = 4_200_000
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.hex(i)), F.lit("one two three over one two three"))
    got = quality_rules.figures(spark.range(1).select(text.alias("text"))).first()
    assert (got.n_words, got.n_repeat_words) == (n + 7, 6)
