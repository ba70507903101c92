"""Rows that operators' docstrings define: null and shared ids, repeated rows, clashing columns, null items, no rows; and the
share of links that signatures lose."""

import random
import shutil
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from quillframe.llm import decontaminate, minhash_dedup, packing, token_files, url_filters, warc
from quillframe.llm.common import mix64, with_sums_before

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORDS = " ".join(f"w{i}" for i in range(60))


def test_near_duplicates_of_null_and_shared_ids(spark):
    rows = [(4, WORDS), (None, WORDS), (7, WORDS + " more"), (7, "other words than those of any row"), (None, "a text of its own here"), (None, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x"))
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(4, 4, True), (None, 4, False), (7, 4, False), (7, 4, False), (None, None, True), (None, None, True), (9, 9, True)], key=str)
    assert minhash_dedup.keep_first_of_each(df).columns == df.columns


def test_signatures_keep_links_at_the_threshold():
    """Pairs of 100 shingles of which 80 are shared: all have the 14 common coordinates."""
    rnd = np.random.default_rng(5)
    a, b = minhash_dedup._coordinates(32)
    low = []
    for _ in range(4000):
        s = mix64(rnd.integers(1, 1 << 62, 100).astype(np.uint64))
        low.append(((s[:90, None] * a + b).min(0) == (s[10:, None] * a + b).min(0)).sum())
    assert min(low) >= 14 and abs(np.mean(low) - 25.6) < 0.2


def test_sums_before_in_runs(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, "a", "b"]), k, rnd.randrange(50)) for k in range(300)]
    got = with_sums_before(spark.createDataFrame(rows, "s string, k long, n long"), ["s"], F.shiftright("k", 4), ["k"], "n", "before")
    assert {(r.s, r.k): r.before for r in got.collect()} == {(s, k): sum(n for t, j, n in rows if t == s and j < k) for s, k, _ in rows}
    got = with_sums_before(spark.createDataFrame(rows, "s string, k long, n long"), [], F.shiftright("k", 4), ["k"], "n", "before")
    assert [r.before for r in got.orderBy("k").collect()] == [sum(n for _, _, n in rows[:k]) for k in range(300)]


def test_token_files_and_packing_of_null_and_shared_ids(spark):
    rows = [(5, "some text", "a"), (5, "other text here", None), (5, "some text", "a"), (None, "no id", "a"), (None, None, None), (1, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_tokens", F.lit("x")).withColumn("path", F.lit(1))
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(VOCABULARY)
    ids = lambda t, end: np.array([*whole.encode(t or "", add_special_tokens=False).ids, end], "<u4")
    crc = lambda end: sorted(((i, len(ids(t, end)), zlib.crc32(ids(t, end).tobytes())) for i, t, _ in rows), key=str)
    got = token_files.read_documents(token_files.write_tokens(df, vocabulary=VOCABULARY, end_id=2)).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == crc(2)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, None, 1, 5, 5, 5]
    pieces = packing.pack(df, vocabulary=VOCABULARY).collect()
    assert sorted(((r.doc_id, r.doc_tokens, r.ids_crc32) for r in pieces), key=str) == crc(0)


def test_urls_of_null_ids_repeated_pages_and_suffixes(spark):
    rows = [(1, "http://a.org/x"), (1, "http://a.org/x"), (None, "http://a.org/y"), (None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("bound", F.lit("x"))
    labels = spark.createDataFrame([(1, 1), (None, 1), (77, 1), (1, 0)], "page_id long, bad int")
    got = url_filters.judge_urls(df, labels, rules=[]).collect()
    assert sorted(str(r.page_id) + r.host for r in got) == ["1a.org", "1a.org", "None", "Nonea.org"]
    assert len({(r.verdict, r.bound) for r in got if r.host}) == 1
    hosts = [("www.bad.co.uk", "co.uk", "bad.co.uk"), ("co.uk", "co.uk", "co.uk"), ("a.b.c.com", "com", "c.com"), ("x.y.k12.ny.us", "k12.ny.us", "y.k12.ny.us"), ("h", "h", "h")]
    df = spark.createDataFrame(hosts, "host string, suffix string, domain string")
    suffixes = ("co.uk", "k12.ny.us")
    assert df.where((url_filters.suffix_of(F.col("host"), suffixes) == F.col("suffix")) & (url_filters.registered_of(F.col("host"), suffixes) == F.col("domain"))).count() == len(hosts)
    pages = [(i, f"http://{'bad' if i % 2 else 'good'}.co.uk/{i}") for i in range(100)] + [(200, "http://new.bad.co.uk/"), (201, "http://new.good.co.uk/")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "page_id long, bad int")
    judged = {r.page_id: r.verdict for r in url_filters.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), labels, suffixes=suffixes).collect()}
    assert (judged[200], judged[201]) == ("block", "allow")


def test_archives_of_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("refers_to", F.lit("z"))
    assert sorted((r.page_id, r.refers_to) for r in warc.read_archives(warc.write_archives(df)).collect()) == [(1, 2), (2, None)]


def test_leaks_of_null_items_and_inside_words(spark):
    item = " ".join(f"question{i} about rivers" for i in range(8))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, None)], "item_id long, text string")
    rows = [(1, "clean " * 50), (2, f"before{item}after and more"), (3, "x" * 37 + item[3:]), (4, None), (5, ""), (None, item)]
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("z")), bench)
    assert {r[0] for r in found.collect()} >= {2, 3} and not {r[0] for r in found.collect()} & {1, 4, 5}


def test_pipeline_of_odd_rows_and_of_none(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = docs.limit(3).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))
    bare = docs.limit(2).withColumn("text", F.lit(None).cast("string"))
    empty = docs.limit(2).withColumn("text", F.lit("")).withColumn("source", F.lit(None).cast("string"))
    every = docs.union(odd).union(bare).union(empty).union(docs.limit(5))
    every = every.withColumn("Spans", F.lit("mine")).withColumn("kept", F.lit(7)).withColumn("part", F.lit(1.5))
    for name, some in (("odd", every), ("none", every.limit(0))):
        some.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        shutil.copy(f"{SF}/benchmark.parquet", f"{tmp_path}/{name}/benchmark.parquet")
        now = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for stage, step in corpus_pipeline.STAGES:
            now = corpus_pipeline.materialise(step(spark, now, f"{tmp_path}/{name}"), stage)
            if stage != "packing":
                assert now.columns == every.columns
                assert now.where("Spans <> 'mine' or kept <> 7 or part <> 1.5").count() == 0
        assert (now.count() > 0) == (name == "odd")
