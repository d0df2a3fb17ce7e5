"""Input columns that are called as the operators' own come back unchanged."""

import pytest
from pyspark.sql import functions as F

from millrace.llm import secrets, simhash

ODD = ["__text", "__id", "__OF", "__cuts", "__Tail", "Score", "rid", "kind", "set", "component_id"]
MINE = {c: f"mine {c}" for c in ODD}


@pytest.fixture
def docs(spark):
    texts = [(1, "password = 'abcdefgh12345678' and more words here to read"), (2, None), (3, ""), (4, "one two three four five six"), (5, "one two three four five six")]
    return spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(v) for c, v in MINE.items()})


def mine(rows):
    return all(r[c] == v for r in rows for c, v in MINE.items())


def test_redact(docs):
    got = secrets.redact(docs)
    rows = got.collect()
    assert got.columns == docs.columns and mine(rows) and len(rows) == 5
    assert {r["doc_id"]: r["text"] for r in rows}[1].startswith("[secret]")


def test_distinct_documents(docs):
    got = simhash.distinct_documents(docs)
    rows = got.collect()
    assert got.columns == docs.columns and mine(rows) and sorted(r["doc_id"] for r in rows) == [1, 2, 4]


def test_pairs_leave_in_parts(monkeypatch, spark):
    """However many pairs a posting has, a task holds a bounded number of them."""
    monkeypatch.setattr(simhash, "MOST_PAIRS", 50)
    rows = [(7, k, 10, 0, 60, 1000 + k) for k in range(60)]
    postings = spark.createDataFrame(rows, "key long, set long, n int, pos int, count long, group long")
    got = {tuple(r) for r in simhash._candidates(postings, True, 16).collect()}
    assert got == {(a, b) for a in range(60) for b in range(a + 1, 60)}
