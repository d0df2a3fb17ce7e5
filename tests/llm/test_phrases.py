import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from millrace.llm import phrases as p
from millrace.llm.oracle import op13
from tests.compare import same_as_sql


def brute(docs, most_words=3, least=10, inside=50, most=2000):
    found, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", folded):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, most_words + 1):
                found[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in found.items():
        scored = {}
        for x, a in count.items():
            if len(x) > 1 and a >= least:
                scored[x] = (a, *min((1000000 * a * a // (count[x[:k]] * count[x[k:]]), k, count[x[:k]], count[x[k:]]) for k in range(1, len(x))))
        gone = {x[i : i + m] for x in scored for m in range(2, len(x)) for i in range(len(x) - m + 1) if 100 * scored[x][0] >= inside * scored.get(x[i : i + m], (1e99,))[0]}
        rows = sorted((-s[1], -s[0], " ".join(x).encode(), s) for x, s in scored.items() if x not in gone)
        out += [(lang, rank, x.decode(), s[0], s[3], s[4], n[lang], s[1]) for rank, (_, _, x, s) in enumerate(rows[:most], 1)]
    return sorted(out)


@pytest.fixture
def small(monkeypatch):
    """Full buckets, short stretches and many hand-overs on a few texts."""
    for name, value in (("BUCKETS", 256), ("CHUNK", 64), ("STRETCH", 40), ("MOST_WORDS", 12), ("MOST_PHRASES", 15), ("RANKED", 8)):
        monkeypatch.setattr(p, name, value)


@pytest.mark.parametrize("tight", [True, False])
@pytest.mark.parametrize("most_words,least,inside,most", [(3, 10, 50, 2000), (2, 3, 50, 7), (5, 4, 80, 10), (3, 1, 30, 5)])
def test_against_brute_force(spark, request, tight, most_words, least, inside, most):
    if tight:
        request.getfixturevalue("small")
    rng = random.Random(least)
    words = ["The", "cat", "sat", "on", "mat", "é", "É", "x.y", "new", "york", "city", "a\x00b", "漢字", "\x1c"]

    def text():
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r", "!"]) for _ in range(rng.randint(0, 40)))

    docs = [(rng.choice(["en", "de", "und", None, ""]), text()) for _ in range(80)]
    docs += [("en", "new york city hall. " * 30), ("en", None), ("fr", ""), (None, "one word here"), ("de", ",;.")] + [("en", "same text again")] * 12
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    df = df.withColumns({c: p.F.lit("clash") for c in ("phrase", "f", "chunk", "rank", "n")})
    assert sorted(map(tuple, p.collocations(df, most_words, least, inside, most).collect())) == brute(docs, most_words, least, inside, most)


def test_empty_table_and_long_text(spark):
    docs = [("en", "ab cd " * 700_000 + "x" * 5_000_000)]  # over several stretches
    df = spark.createDataFrame(docs, "lang string, text string")
    assert p.collocations(df.where("1 = 0")).count() == 0
    got = {r["phrase"]: (r["a"], r["l"], r["r"], r["n"]) for r in p.collocations(df, most_words=2).collect()}
    assert got == {"ab cd": (700_000, 700_000, 700_000, 1_400_001), "cd ab": (699_999, 700_000, 700_000, 1_400_001)}


@settings(deadline=None, max_examples=80)
@given(st.lists(st.text(alphabet="ab .\t,C", max_size=60), max_size=5), st.integers(1, 30))
def test_stretches_keep_every_word(texts, most):
    column = pa.array([t.encode() for t in texts], pa.binary())
    parts = list(p._stretches(column, list(range(len(texts))), most))
    plain = b"".join(t.encode().translate(p._FOLD) + b"." for t in texts)
    assert b"".join(parts) == plain
    apart = [w for x in parts for w in x.replace(b".", b" . ").split()]
    assert apart == plain.replace(b".", b" . ").split()


def test_counts_of_many_words_are_exact(spark):
    """Scores whose products pass 64 bits."""
    counts = spark.createDataFrame([("en", "a b", 2, 3_000_000_000_000), ("en", "a", 1, 4_000_000_000_000), ("en", "b", 1, 5_000_000_000_001)], "lang string, phrase string, words int, f long")
    words = spark.createDataFrame([("en", 10**13)], "lang string, n long")
    (row,) = p.scored(counts, words, 50, 10).collect()
    assert row["score"] == 10**6 * 3_000_000_000_000**2 // (4_000_000_000_000 * 5_000_000_000_001)


def test_same_as_sql(spark, sf_dir, duck):
    same_as_sql(p.op13_phrases(spark, sf_dir), duck, op13())
