import corpus_pipeline
from cases import LONG, documents
from gablework.llm.queries import ORACLES, QUERIES


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_stages_keep_the_columns_and_their_decisions(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns and kept.schema == docs.schema
        kept.write.parquet(str(tmp_path / str(id(stage))))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(id(stage))))
        assert 0 < docs.count() <= before.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").select("doc_id").distinct().count() == docs.count()


def test_stages_take_odd_rows(spark):
    rows = [(1, "A river of words that goes on and on to the sea."), (2, None), (3, ""), (None, "Another quiet text of its own."), (4, LONG)]
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001").count()
        # One labelled row makes a narrow model; the other stages keep all texts that differ.
        assert out >= (1 if name == "language_id" else 3), name
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
