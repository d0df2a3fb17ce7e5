import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from millrace.llm import lines
from millrace.llm.oracle import op11
from tests.compare import same_as_sql


def brute(rows, min_docs, min_chars):
    found = Counter()
    for _, text in rows:
        found.update({lines.key_of(x) for x in (text or "").encode().split(b"\n")})
    out = []
    for i, text in rows:
        own = (text or "").encode().split(b"\n")
        kept = [x for x in own if len((k := lines.key_of(x)).decode()) < min_chars or found[k] < min_docs]
        out.append((str(i), len(own), len(own) - len(kept), b"\n".join(kept).decode()))
    return sorted(out)


def got(df):
    return sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect())


@pytest.fixture
def small(monkeypatch):
    """Many bundles, shards and requests on few lines."""
    monkeypatch.setattr(lines, "BUNDLE_LINES", 20)
    monkeypatch.setattr(lines, "SHARD_KEYS", 8)
    monkeypatch.setattr(lines, "REQUEST_KEYS", 3)


ODD = [None, "", "\n", " \t", "x", "X \r", "\x0bx\x0c\n\n", "é\nÉ", " x", "same\nSAME\n same", "a\x00b", "漢字\n漢字 "]


@pytest.mark.parametrize("min_docs,min_chars", [(1, 0), (2, 1), (3, 1), (5, 2), (300, 1)])
def test_against_brute_force(spark, small, min_docs, min_chars):
    rng = random.Random(min_docs)
    rows = [(i, "\n".join(rng.choice(["common", " Common ", f"own {i}", f"few {i % 40}", "", "é", "zz"]) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    rows += [(200 + i, x) for i, x in enumerate(ODD)] + [(None, "zz\nlast"), (0, rows[0][1]), (0, rows[0][1])]
    rows += [(500 + i, "copy\nof many\nlines") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df = df.withColumns({c: lines.F.lit("clash") for c in ("first", "dropped", "n_lines", "shard")})
    assert got(lines.without_repeated_lines(df, min_docs, min_chars)) == brute(rows, min_docs, min_chars)


def test_empty_table_and_one_long_text(spark):
    df = spark.createDataFrame([(1, "a\n" * 300_000 + "b" * 1_000_000), (2, "a"), (3, "b")], "doc_id long, text string")
    assert lines.without_repeated_lines(df.where("1 = 0")).count() == 0
    out = {r["doc_id"]: (r["n_lines"], r["n_dropped"], len(r["text"])) for r in lines.without_repeated_lines(df, min_docs=2).collect()}
    assert out == {1: (300_001, 300_000, 1_000_000), 2: (1, 1, 0), 3: (1, 0, 1)}


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 3000), st.integers(0, 6), st.randoms())
def test_perfect_hash_numbers_each_key_once(n, levels, rng):
    keys = list({(rng.getrandbits(64), rng.getrandbits(3)) for _ in range(n)})
    x, y = np.array(keys, np.uint64).reshape(-1, 2).T
    for k, most in ((len(x), None), (min(len(x), 200), levels)):
        made = lines.PerfectHash.of(x[:k], y[:k], most)
        assert sorted(made.number(x[:k], y[:k]).tolist()) == list(range(k))


def test_outsiders_are_told_by_fingerprint(spark, small):
    """Keys that a shard was not made of find no frequent line."""
    rows = [(i, "known") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    binary = lambda d: d.select(lines.F.col("text").cast("binary").alias("text"), *lines._names(lines.F.col("text")))
    index = lines._index(lines._bundles(binary(df), 1), 4, 10)
    others = spark.createDataFrame([(i, f"line {i}") for i in range(500)] + [(900, "known")], "doc_id long, text string").repartition(3)
    bundles = lines.materialise(lines._bundles(binary(others), 1), "bundles")
    answers = lines._answers(bundles, index, 4, 10)
    assert lines._decisions(bundles, answers).count() == 1


def test_same_as_sql(spark, sf_dir, duck):
    same_as_sql(lines.op11_lines(spark, sf_dir), duck, op11())
