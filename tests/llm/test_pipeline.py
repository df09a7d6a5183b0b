import corpus_pipeline
from test_near_copies import plain_groups

from sameas.llm import byte_bpe, mixing

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if name != "tokenize":
            assert docs.columns == columns
    before, after = seen["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert after.count() < before.count()
    assert after.join(labels.filter("quality = 1"), "doc_id").count() >= 0.95 * before.join(labels.filter("quality = 1"), "doc_id").count()
    before, after = seen["near_copies"]
    groups = plain_groups({r["doc_id"]: r["text"] for r in before.select("doc_id", "text").collect()})
    assert sorted(r[0] for r in after.select("doc_id").collect()) == sorted(set(groups.values()))
    before, after = seen["mix"]
    order = mixing.mix_sources(before).orderBy("mix_slot", "mix_row").select("doc_id").collect()
    files = sorted((tmp_path / "mix").glob("*.parquet"))
    read = [r[0] for f in files for r in spark.read.parquet(str(f)).select("doc_id").collect()]
    assert read == [r[0] for r in order]
    before, after = seen["tokenize"]
    text = {r[0]: r[1] for r in before.select("doc_id", "text").collect()}
    assert {r["doc_id"]: bytes(r["text"]).decode() for r in byte_bpe.decode(after).collect()} == text
    assert corpus_pipeline.run(spark, SF).count() == after.count()


def test_stages_on_odd_tables(spark):
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, Score int, mix_slot string, bad int"
    rows = [(1, "good text here", "en", "a", 14, 1, "x", 1), (2, None, None, None, None, None, None, None), (3, "", "en", "a", 0, 1, "x", 1),
            (None, "good text here", "en", "a", 14, 1, "x", 1), (1, "good text here", "en", "a", 14, 1, "x", 1)]
    for docs in (spark.createDataFrame(rows, kinds), spark.createDataFrame([], kinds)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= docs.count()
            if name != "tokenize":
                assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
