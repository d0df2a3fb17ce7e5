import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import queries
from tests.compare import same_as_sql
from tests.llm.test_scans import base_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, sf_dir, duck, name):
    same_as_sql(queries.queries()[name](spark, sf_dir), duck, queries.oracle_sql()[name])


def test_stages(spark, sf_dir):
    """Each stage on what the one before it kept, with rows no stage should trip over, a text of millions of signs among them."""
    from millrace.llm.storage import materialise

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs.first()
    prose = docs.where("lang = 'en' and n_chars > 400").orderBy("doc_id").first()["text"]
    long = " ".join(f"{prose} part{i}" for i in range(4000))
    odd = [(9004, long, "en", "s", len(long)), (9005, long + " end", "en", "s", len(long) + 4), (None, None, None, None, None), (9001, "", "en", "s", 0), (9002, None, "en", "s", None), tuple(first), (9003, first["text"], "en", "s", first["n_chars"])]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("__note", F.lit("keep"))
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "encoding"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, sf_dir), name)
        assert out.columns == docs.columns and {r["__note"] for r in out.select("__note").distinct().collect()} == {"keep"}
        assert out.count() <= docs.count()
        docs = out
    rows = docs.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    texts = [r["text"] for r in rows if r["text"]]
    assert len(long) > 1_500_000 and [r["doc_id"] for r in rows if r["text"] and len(r["text"]) > 1_000_000] == [9004]
    assert len(set(texts)) == len(texts)
    for r in rows:
        if base_spans(seen[r["doc_id"]]):
            assert "[secret]" in r["text"]
        else:
            assert r["text"] == seen[r["doc_id"]]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == len(rows)
    assert corpus_pipeline.STAGES[1][1](spark, docs.where("1 = 0"), sf_dir).count() == 0


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and 50 < out.count() < 200
