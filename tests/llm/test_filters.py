import random
import re

import pytest

from millrace.llm import decontaminate, quality


def words(rng, n):
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def benchmark_rows():
    rng = random.Random(2)
    return [(i, words(rng, 40).capitalize() + ".") for i in range(12)] + [(98, "too short"), (99, None), (None, words(rng, 30))]


def test_leaks_are_found_and_clean_texts_stay(spark, benchmark_rows):
    rng = random.Random(4)
    rows, leaked = [], {}
    for i in range(60):
        text = words(rng, rng.randint(50, 300))
        if i % 3 == 0:
            item = i // 3 % 12
            passage = benchmark_rows[item][1]
            if i % 2:  # one sign wrong, other case, other white space and marks between
                k = len(passage) // 2
                passage = passage[:k].upper() + "x" + passage[k + 1 :].replace(" ", "*** \n")
            text = text[: len(text) // 2] + " " + passage + " " + text[len(text) // 2 :]
            leaked[i] = item
        rows.append((i, text, "t", 1.5))
    leaked[102] = 98
    rows += [(100, None, "t", None), (101, "", None, 0.0), (102, "too short", "t", 0.0), (0, rows[0][1], "t", 1.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits string, regions double")
    benchmark = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    found = decontaminate.leaks(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == set(leaked.items())
    assert len(found) == len(leaked) + 1
    rows_of = {r[0]: r[1] for r in rows}
    fold = lambda t: re.sub(r"[\W_]", "", t).lower()
    for r in found:
        span = fold(rows_of[r["doc_id"]][r["first_char"] : r["end_char"]])
        item = {i: t for i, t in benchmark_rows}[r["item_id"]]
        assert span[:8] in fold(item) or span[-8:] in fold(item)
    clean = decontaminate.without_leaks(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r[0] for r in rows if r[0] not in leaked)


def test_blocks_give_the_same(spark, benchmark_rows, monkeypatch):
    docs = spark.createDataFrame([(i, "xx " + t) for i, t in benchmark_rows if i is not None and t], "doc_id long, text string")
    benchmark = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    one = sorted(map(tuple, decontaminate.leaks(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_REGIONS", 40)
    assert sorted(map(tuple, decontaminate.leaks(docs, benchmark).collect())) == one and len(one) == 13
    assert decontaminate.leaks(docs, benchmark.where("1 = 0")).count() == 0
    assert decontaminate.leaks(docs.where("1 = 0"), benchmark).count() == 0


def needles_of(*items):
    rows = []
    for i, t in items:
        signs = decontaminate.fold(t)[0]
        rows += [(signs[a:b].tobytes(), i) for a, b in decontaminate.regions_of(signs)]
    return decontaminate.Needles(rows)


def test_bound_of_the_lemma_against_brute_force():
    """Whatever is within the edit budget is found, in a long text and at its ends."""
    rng = random.Random(9)
    for n in (60, 4, 6, 9):
        item = words(rng, n)
        needles = needles_of((5, item))
        signs = decontaminate.fold(item)[0]
        for start, end in decontaminate.regions_of(signs):
            for _ in range(20):
                text = [chr(c) for c in signs[start:end]]
                for _ in range(decontaminate.edits_allowed(end - start)):
                    at = rng.randrange(len(text))
                    text[at : at + 1] = rng.choice([["q"], [], [text[at], "q"]])
                prefix = words(rng, rng.randint(0, 30))
                assert needles.find(prefix + "".join(text))


def least_edits(pattern, text):
    """Of all parts of a text, by the whole table."""
    last = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(last[j - 1] + (x != y), last[j] + 1, new[j - 1] + 1))
        last = new
    return min(last)


def test_leaks_against_brute_force(spark):
    rng = random.Random(12)
    items = [(i, words(rng, rng.choice((3, 8, 25)))) for i in range(6)]
    docs = []
    for i in range(40):
        part = list(rng.choice(items)[1])
        part = part[rng.randint(0, len(part) // 2) :]
        for _ in range(rng.randint(0, max(1, len(part) // 8))):
            part[rng.randrange(len(part))] = rng.choice("qzx ")
        docs.append((i, words(rng, rng.randint(0, 12)) + " " + "".join(part) + " " + words(rng, rng.randint(0, 12))))
    fold = lambda t: decontaminate.fold(t)[0].tolist()
    want = set()
    for d, text in docs:
        for i, item in items:
            signs = fold(item)
            regions = [signs[a:b] for a, b in decontaminate.regions_of(decontaminate.fold(item)[0])]
            if any(least_edits(r, fold(text)) <= decontaminate.edits_allowed(len(r)) for r in regions):
                want.add((d, i))
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want and 10 < len(want) < 40


def test_quotes_and_short_items():
    rng = random.Random(3)
    item = words(rng, 60)
    signs = "".join(map(chr, decontaminate.fold(item)[0]))
    needles = needles_of((1, item), (2, "forty2"), (None, "Gr\u00fc\u00dfe"))
    for a in range(0, len(signs) - 60, 7):
        assert [f[0] for f in needles.find("zzz " + signs[a : a + 60] + " zzz")] == [1]
    assert [f[0] for f in needles.find("it is FORTY2.")] == [2] and not needles.find("forty25 aforty2")
    assert [f[0] for f in needles.find("Viele gr\u00fc\u00dfe!")] == [None]
    replaced = item.split()
    for k in range(6, len(replaced), 26):
        replaced[k] = "q" * len(replaced[k])
    assert needles.find(" ".join(replaced))


def test_repetitive_texts_take_little_memory():
    import time
    import tracemalloc

    needles = needles_of((1, "a" * 1000), (2, "abc" * 2000))
    assert len(needles.signs) == 4
    tracemalloc.start()
    began = time.time()
    assert {f[0] for f in needles.find("a" * 1_000_000)} == {1}
    assert needles.find("ab" * 500_000) == []
    assert time.time() - began < 40 and tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()


def test_banded_edits_against_full_table():
    rng = random.Random(0)
    for _ in range(200):
        p = [rng.randrange(4) for _ in range(rng.randint(1, 15))]
        t = [rng.randrange(4) for _ in range(rng.randint(0, 25))]
        last = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(last[j - 1] + (x != y), last[j] + 1, new[j - 1] + 1))
            last = new
        import numpy as np

        assert decontaminate.banded_edits(np.array(p, np.uint32), np.array(t, np.uint32), 20) == min(min(last), 21)


def noisy(rng, n):
    return " ".join(w + rng.choice(["***", "$$$", "&&&"]) for w in words(rng, n).split())


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(6)
    docs = [(i, noisy(rng, 60) if i % 2 else words(rng, 60)) for i in range(300)]
    return docs, [(i, 1 - i % 2) for i, _ in docs]


def test_held_out_accuracy(spark, labelled):
    docs, labels = labelled
    extra = [(900, None), (901, ""), (902, "x" * 200_000), (None, "and so on"), (0, docs[0][1])]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string").withColumn("score", quality.F.lit("mine"))
    lab = spark.createDataFrame(labels + [(5, None), (None, 1), (7, 9), (1, 0)], "doc_id long, quality int")
    weights = quality.train(d, lab)
    got = quality.score(d, weights).withColumn("out", quality.held_out()).collect()
    assert len(got) == len(docs) + len(extra)
    assert all(0 <= r["score"] <= 1 for r in got)
    judged = [(r["score"] >= 0.5) == (r["doc_id"] % 2 == 0) for r in got if r["out"] and r["doc_id"] < 300]
    assert len(judged) > 50 and sum(judged) / len(judged) > 0.95
    kept = quality.accepted(d, lab)
    assert kept.columns == d.columns and {r["score"] for r in kept.collect()} == {"mine"}


def test_held_out_labels_teach_nothing(spark, labelled):
    docs, labels = labelled
    import zlib

    out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    d = spark.createDataFrame(docs, "doc_id long, text string")
    a = quality.train(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    b = quality.train(d, spark.createDataFrame([(i, 1 - q if out(i) else q) for i, q in labels], "doc_id long, quality int"))
    assert (a == b).all()


def test_no_labels(spark, labelled):
    d = spark.createDataFrame(labelled[0][:5], "doc_id long, text string")
    weights = quality.train(d, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(d, weights).collect()} == {0.5}
    assert quality.score(d.where("1 = 0"), weights).count() == 0


def test_shards_against_plain_ftrl():
    """Each coordinate by the published update, one at a time."""
    import math

    import numpy as np

    rng = random.Random(1)
    rows = []
    for _ in range(40):
        bucket = sorted(rng.sample(range(30), 5))
        rows.append((np.array(bucket), np.array([rng.random() for _ in bucket]), rng.randint(0, 1)))
    z, n = [0.0] * (quality.BUCKETS + 1), [0.0] * (quality.BUCKETS + 1)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for bucket, value, label in rows:
            x = [*zip(bucket.tolist(), value.tolist()), (quality.BUCKETS, 1.0)]
            w = {i: weight(i) for i, _ in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x)))
            for i, v in x:
                g = (p - label) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    got = quality.fit_shard(rows)
    assert np.allclose(got[:30], [weight(i) for i in range(30)]) and abs(got[quality.BUCKETS] - weight(quality.BUCKETS)) < 1e-9


def test_long_and_repeated_rows_in_training(spark, labelled):
    docs, labels = labelled
    d = spark.createDataFrame(docs + [docs[0]] * 50 + [(2, "y " * 300_000)], "doc_id long, text string").withColumn("quality", quality.F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int").withColumn("text", quality.F.lit("clash"))
    once = quality.train(spark.createDataFrame(docs, "doc_id long, text string"), lab)
    again = quality.train(d, lab)
    assert once.shape == again.shape and (again != 0).any()
    scored = {r["doc_id"]: r["score"] for r in quality.score(d.select("doc_id", "text").where("doc_id < 5"), again).collect()}
    assert scored.keys() == {0, 1, 2, 3, 4}
