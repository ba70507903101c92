import corpus_pipeline
from quillframe.llm.common import materialise
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, SF), name)
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns and docs.schema == before.schema
    before, after = ([(r.doc_id, r.text) for r in x.collect()] for x in seen["near_dedup"])
    assert {i for i, _ in after} == {i for i, w in brute.near_duplicates(before, 5).items() if w[3]}
    before, after = seen["quality"]
    kept = {r.doc_id for r in after.collect()}
    assert all(r.doc_id not in kept or not brute.figures(r.text)[5] for r in before.collect())
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in seen["substring_dedup"])
    want = brute.repeats(list(before.items()))
    assert all(len(after.get(i, "").encode()) == w[1] - w[2] for i, w in want.items() if before[i].isascii())
    assert corpus_pipeline.run(spark, SF).count() > 0
