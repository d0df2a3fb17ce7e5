import itertools
import random

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash
from millrace.llm.components import connected_components


def reference_print(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def test_every_four_bytes_hold_a_triple():
    assert len(simhash.TRIPLES) == 20
    for four in itertools.combinations(range(8), 4):
        assert any(set(t) <= set(four) for t in simhash.TRIPLES)


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé ñ".replace(" ", "")) for _ in range(4))
    out = [None, "", "  \t ", "one", "ONE", "one two three", "one two three four"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 400))]
        out.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            out.append("\n".join(copy) if rng.random() < 0.3 else " ".join(copy))
    return out


def test_same_as_brute_force(spark):
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts())]
    prints = {i: reference_print(t) for i, t in rows}
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").withColumn("fp", simhash.F.lit("x"))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 3
    want = components(prints)
    for r in got:
        assert r["fp"] & (1 << 64) - 1 == prints[r["doc_id"]]
        assert r["component_id"] == want[r["doc_id"]]


@pytest.mark.parametrize("chunk", [3, 4096])
def test_links_keep_large_groups_connected(spark, chunk):
    rng = random.Random(1)
    centre = rng.getrandbits(63)
    prints = {i: centre ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for i in range(120)} | {200 + i: rng.getrandbits(63) for i in range(60)}
    rows = list({p: (i, p) for i, p in prints.items()}.values())
    classes = spark.createDataFrame(rows, "node long, fp long")
    found = connected_components(simhash.links(classes, chunk=chunk))
    got = {r["node"]: r["component"] for r in found.collect()}
    want = components(dict(rows))
    assert {i: got.get(i, i) for i, _ in rows} == want


def test_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (None, "zz yy")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(docs).collect() if r["component_id"])
    assert got == [(0, 7), (7, 7)]
    assert simhash.near_duplicates(docs.where("1 = 0")).count() == 0


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 51), (51, 51), (60, 61), (61, 60)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[51] == 50 and got[61] == 60
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_distinct_documents_against_shingle_sets(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, groups = [], []
    for _ in range(8):
        base = [word() for _ in range(200)]
        group = []
        for changes in (0, 0, 1, 3):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(200)] = word()
            group.append(len(rows))
            rows.append((len(rows), " ".join(copy), len(rows)))
        groups.append(group)
    other = [(100 + i, " ".join(word() for _ in range(50)), 1) for i in range(20)]
    odd = [(200, None, 0), (201, "", 0), (None, None, 0), (None, "only me", 0), (100, other[0][1], 1)]
    docs = spark.createDataFrame(rows + other + odd, "doc_id long, text string, __n int").withColumn("component_id", simhash.F.lit(1))
    kept = simhash.distinct_documents(docs)
    assert kept.columns == docs.columns
    got = [r["doc_id"] for r in kept.collect()]
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    for group in groups:
        first = sets(rows[group[0]][1])
        near = [i for i in group if len(first & sets(rows[i][1])) / len(first | sets(rows[i][1])) >= 0.8]
        assert group[0] in got and not set(near[1:]) & set(got)
    assert {100 + i for i in range(20)} <= set(got) and got.count(100) == 1
    assert got.count(None) == 1 and 200 in got and 201 not in got
    assert np.isscalar(kept.count())


def test_distinct_documents_of_appended_and_replaced_passages(spark):
    """Pairs just at or under 0.8, which prints of words or shingles cannot tell, against their shingle sets."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, want = [], set()
    for k in range(90):
        n = rng.choice((40, 100, 400))
        base = [word() for _ in range(n)]
        more = (n - 4) // 4 + k % 2
        changed = (n - 4) // 9 - 4 + k % 2
        copy = base + [word() for _ in range(more)] if k % 3 else base[:9] + [word() for _ in range(changed)] + base[9 + changed :]
        x, y = sets(base), sets(copy)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        want |= {2 * k} if 5 * len(x & y) >= 4 * len(x | y) else {2 * k, 2 * k + 1}
    assert 20 < len(rows) - len(want) < 70
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.distinct_documents(docs).collect()} == want


@pytest.mark.parametrize("chunk", [20, 4096])
def test_near_copies_of_a_large_group(spark, chunk):
    """A posting longer than SHORT: copies of one text that are near it but mostly not near each other, with and
    without the text itself, connect as all pairs do."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    texts = []
    for with_base in (True, False):
        base = [word() for _ in range(120)]
        texts += [base] * with_base
        for _ in range(70):
            copy = list(base)
            for _ in range(rng.randint(1, 3)):
                copy[rng.randrange(120)] = word()
            texts.append(copy)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in enumerate(texts)}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    docs = spark.createDataFrame([(i, i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, __text long, text string")
    known = simhash.described(docs).cache()
    number = {r["set"]: r["doc_id"] for r in known.collect()}
    assert len(number) == len(texts)
    found = connected_components(simhash.near_copies(known, docs, chunk=chunk))
    least = {}
    rows = [(number[r["node"]], r["component"]) for r in found.collect()]
    for i, c in rows:
        least[c] = min(i, least.get(c, i))
    got = {i: least[c] for i, c in rows}
    assert {i: got.get(i, i) for i in sets} == {i: find(i) for i in sets}


@pytest.mark.parametrize("n", [500, 2000, 4000])
def test_links_per_node_do_not_grow_with_a_group(spark, n):
    """Prints within four bits of a centre, each in some long posting."""
    rng = random.Random(n)
    centre = rng.getrandbits(63)
    prints = set()
    while len(prints) < n:
        x = centre
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(63)
        prints.add(x)
    classes = spark.createDataFrame([(i, p) for i, p in enumerate(sorted(prints))], "node long, fp long")
    assert simhash.links(classes).count() < 22 * n
    assert simhash.links(classes, chunk=256).count() < 60 * n


def test_a_spanning_forest_joins_what_all_links_join():
    rng = np.random.default_rng(0)
    for n, m in ((1, 0), (5, 4), (60, 40), (300, 2000)):
        i, j = rng.integers(0, n, m), rng.integers(0, n, m)
        kept = simhash.spanning(i, j, n)

        def parts(i, j):
            parent = list(range(n))

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in zip(i.tolist(), j.tolist()):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
            return [find(x) for x in range(n)]

        assert parts(i, j) == parts(i[kept], j[kept])
        assert kept.sum() == n - len(set(parts(i, j)))


def test_very_long_texts():
    text = "a b c " * 400_000
    assert simhash.fingerprint(simhash.shingle_hashes(text, 4)) & (1 << 64) - 1 == reference_print("a b c " * 4)
    assert len(simhash.shingle_set(text)) == 3
    assert len(simhash.shingle_hashes("x" * 5_000_000, 4)) == 1


def test_bitmaps_never_differ_in_more_than_the_sets(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdef") * rng.randint(1, 3) for _ in range(rng.randint(0, 200))) for _ in range(30)]
    rows = simhash.described(spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, __text long, text string")).collect()
    for x, y in itertools.combinations(rows, 2):
        sets = [set(simhash.shingle_set(texts[r["doc_id"]]).tolist()) for r in (x, y)]
        differ = sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(x["bits"], y["bits"]))
        assert differ <= len(sets[0] ^ sets[1]) and x["n"] == len(sets[0])
