import corpus_pipeline
from quernel.llm import exact_dedup, packing, quality, simhash, toxicity

SF = "/root/testdata/sf0.01"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    docs = docs.select(*columns)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "exact dedup", "near dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        assert 0 < len(kept) < len(before) and kept < before
        if name == "quality":
            assert kept == {r.doc_id for r in quality.score(docs, labels).where("predicted = 1").collect()}
        elif name == "toxicity":
            assert kept == {r.doc_id for r in toxicity.score(docs, labels).where("predicted = 0").collect()}
        elif name == "exact dedup":
            assert kept == {r.doc_id for r in exact_dedup.mark(docs).where("kept").collect()}
        else:
            assert kept == {r.component_id for r in simhash.groups(docs).collect()}
        docs = spark.createDataFrame(out.collect(), out.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    ran = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, packed)) == sorted(map(key, ran))
    assert len({r.sequence_id for r in packed}) == sum(n for n, _ in packing.plan(_counts(packed)))


def _counts(rows):
    out = {}
    for r in rows:
        out[r.length] = out.get(r.length, 0) + 1
    return out
