import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from millrace.llm import pieces, topk


def brute(rows, k):
    out = set()
    for q, v in rows:
        if q % 5 == 0:
            other = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(other[:k])}
    return out


@pytest.mark.parametrize("cells", [64, 1 << 20])
def test_search_against_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(topk, "BLOCK_CELLS", cells)
    monkeypatch.setattr(topk, "CHUNK_CELLS", cells)
    rng = random.Random(8)
    vectors = [(i, [rng.uniform(-2, 2) for _ in range(6)]) for i in range(150)]
    vectors += [(150 + i, [0.5, 0.25, -0.5, 0.0, 1.0, -1.0]) for i in range(30)]  # ties
    vectors += [(200 + i, [1.0, -2.0]) for i in range(4)]
    odd = [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (305, [math.nan] * 6), (310, [math.inf] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v) for i, v in vectors + odd], "vec_id long, embedding array<double>").withColumn("rank", topk.F.lit("x")).withColumn("block", topk.F.lit("x"))
    got = {tuple(r) for r in topk.search(df, topk.F.col("vec_id") % 5 == 0, k=7).collect()}
    assert got == brute([(i, [math.floor(64 * x) for x in v]) for i, v in vectors], 7)


def test_repeated_rows_and_large_components(spark):
    rows = [(0, [1.0, 1.0]), (1, [2e6, 1.0]), (2, [1e30, 0.0]), (3, [1e30, 1e29]), (4, [-1e300, 3.0]), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (6, [1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk.search(df, topk.F.col("vec_id") == 0).collect())
    most = (1 << 63) - 1
    assert got == [(1, 6, most), (2, 3, most), (3, 2, most), (4, 1, 64 * (128_000_000 + 64)), (5, 5, 8192), (6, 5, 8192), (7, 4, -most)]
    twice = topk.search(df, topk.F.col("vec_id") == 5).where("vec_id = 0")
    assert twice.count() == 2


def test_search_without_queries(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert topk.search(df, topk.F.col("vec_id") > 5).count() == 0
    assert topk.search(df.where("1 = 0"), topk.F.lit(True)).count() == 0
    got = topk.search(df, topk.F.lit(True), k=20).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2, 64 * 128), (2, 1, 1, 64 * 128)]


@settings(deadline=None, max_examples=40)
@given(st.integers(1, 200), st.integers(0, 5), st.integers(1, 30), st.randoms())
def test_sums_of_slices(n, width, k, rng):
    values = np.array([[rng.randint(-40, 40) for _ in range(width)] for _ in range(n)], np.int64).reshape(n, width)
    weights = [rng.randint(-40, 40) for _ in range(width)]
    ids = np.arange(n) * 2
    index = topk.slices_of(values) if width else (np.empty((0, 1, 0), np.uint64), [], n)
    got = sorted((-s, i) for _, i, s in topk.search_block(ids, index, [(1, weights)], k))
    want = sorted((-int(v @ np.array(weights, np.int64)) if width else 0, int(i)) for i, v in zip(ids, values))
    assert got == want[:k]


@pytest.fixture(scope="module")
def model():
    with open(pieces.MODEL, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


ODD = ["", " ", "  a  b ", "\n\n x\ty", "a" * 300, "é漢字 ▁ x", "▁▁a", "<s>hello</s> <0x41>", "😀😀 ok", " " * 40 + "x", "x" + " " * 33, "don't stop... 12,345.67!!", "https://www.example.com/?a=b&c=d", "\x00\x01 z", "a​b"]


@settings(deadline=None, max_examples=150)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="the onaid. ▁\n", max_size=80)))
def test_ids_equal_the_library(text):
    with open(pieces.MODEL, "rb") as f:
        data = f.read()
    machine = pieces.compiled(data)
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    ids = machine.encode(text)
    assert ids == own.encode(text)
    assert machine.decode(ids) == own.decode(ids)
    assert machine.decode(ids) == text.replace("▁", " ")


def test_repeated_words_are_not_looked_up_one_by_one(model):
    import sys

    machine = pieces.Transducer(model)
    texts, calls = [" ".join(["the quick, brown fox; jumps over 12 lazy dogs."] * 100)] * 100, 0

    def count(frame, event, of):
        nonlocal calls
        calls += event in ("call", "c_call")

    run = getattr(machine, "encode_all", lambda of: [machine.encode(t) for t in of])
    sys.setprofile(count)
    try:
        run(texts)
    finally:
        sys.setprofile(None)
    assert calls < 10_000  # of 90,000 words


@pytest.mark.parametrize("signs", [1, 7, 1 << 20])
def test_batches_of_texts(model, library, monkeypatch, signs):
    monkeypatch.setattr(pieces, "_SIGNS", signs)
    machine = pieces.Transducer(model)
    texts = [None, *ODD, "", None, "\U0001f600" * 5 + "\n", *ODD[::-1]]
    ends, ids = machine.encode_all(texts)
    want = [library.encode(t or "") for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
    assert machine.decode_all(ends, ids).to_pylist() == [machine.decode(w) for w in want]
    batch = pieces.pa.record_batch({"i": list(range(len(texts))), "t": pieces.pa.array(texts, pieces.pa.string())})
    assert [t for part in pieces._parts(batch) for t in part.column(1).to_pylist()] == texts


def test_bounded_tables_change_nothing(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "_KEPT", 10)
    machine = pieces.Transducer(model)
    rng = random.Random(0)
    for _ in range(200):
        text = " ".join("".join(rng.choice("thonander.*é") for _ in range(rng.randint(1, 12))) for _ in range(30))
        assert machine.encode(text) == library.encode(text)


def test_encode_table(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (None, "x"), (0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", pieces.F.lit("clash"))
    got = pieces.encode(docs, pieces.MODEL).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 50:
            assert r["ids"] == library.encode(ODD[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["decoded"] == ODD[r["doc_id"]].replace("▁", " ")
    assert pieces.encode(docs.where("1 = 0"), pieces.MODEL).count() == 0


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_normalisers_equal_the_library(model, rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    spec.ParseFromString(model)
    rules = proto.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    spec.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    spec.normalizer_spec.remove_extra_whitespaces = True
    changed = spec.SerializeToString()
    own, machine = sentencepiece.SentencePieceProcessor(model_proto=changed), pieces.Transducer(changed)
    rng = random.Random(4)
    texts = [*ODD, "\uff21\uff22\uff23  \ufb01n \u2460\u3000x", "Stra\u00dfe \u0130 \u1e9e", "e\u0301 \u00bd \ufdfa", "\u00a8 a", " \t lead", "trail  "]
    texts += ["".join(rng.choice(" \tabAB\u00e9e\u0301\uff21\ufb01\u00bd\u3000\u2460\u00df\u00a8\u2581") for _ in range(rng.randint(0, 25))) for _ in range(400)]
    for text in texts:
        assert machine.encode(text) == own.encode(text), text


def test_very_long_texts(model, library):
    import time

    machine = pieces.Transducer(model)
    rng = random.Random(2)
    for text in ("a" * 1_000_000, "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(300_000)), "\u2581 " * 200_000):
        began = time.time()
        ids = machine.encode(text)
        assert time.time() - began < 20
        assert machine.decode(ids) == text.replace("\u2581", " ")
    assert machine.encode("a" * 5000) == library.encode("a" * 5000)
