import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from millrace.llm import clusters as c
from millrace.llm.oracle import op12
from tests.compare import same_as_sql

MOST = (1 << 63) - 1


def brute(rows, k, rounds, scale):
    """Plain k-means over exact integers, every distance worked out."""
    kept = [(i, [math.floor(scale * x) if abs(x) < 1e290 else scale * int(x) for x in v]) for i, v in rows]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), n) for n, m in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = {n: sum(d for _, d, o in found if o == n) for n in range(k)}
    name = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in centroids]
    least = lambda x: min(x, MOST)
    if any(d > MOST for _, d, _ in found):  # sums are of distances that a long holds
        total = {n: sum(least(d) for _, d, o in found if o == n) for n in range(k)}
    return sorted((i, o, least(d), least(total[o]), least(sum(total.values())), name[o]) for i, d, o in found)


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("k,rounds", [(1, 2), (5, 0), (8, 4), (40, 3)])
def test_against_brute_force(spark, k, rounds):
    rng = random.Random(k)
    rows = [(i, [rng.choice([-1, 0, 1]) + rng.choice([0.0, 0.25]) for _ in range(4)]) for i in range(300)]  # many ties and repeats
    rows += [(1000 + i, [5.0, -0.01, 0.0, 0.015625]) for i in range(60)] + [(7, [0.0] * 4)] * 3
    odd = [(2000, None), (2001, [1.0]), (2002, [1.0, None, 0.0, 0.0]), (2003, [math.nan] * 4), (2004, [math.inf] * 4), (2005, []), (None, [0.0] * 4)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(3)
    df = df.withColumns({n: c.F.lit("clash") for n in ("v", "cluster", "upper", "lower", "worked")})
    worked = []
    assert got(c.clusters(df, k=k, rounds=rounds, width=4, state_of_rounds=worked)) == brute(rows, k, rounds, 64)
    if k == 40:  # the bounds do prune, the more the fewer centroids move
        assert worked[0] < len(rows) * k * 0.9 and worked[-1] < worked[0] / 2


def test_components_of_any_size(spark):
    rows = [(i, [s * 10.0**e, 1.5 * i]) for i, (s, e) in enumerate((s, e) for s in (1, -1, 3) for e in (0, 5, 9, 18, 19, 30, 120, 307))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(c.clusters(df, k=4, rounds=3, width=2)) == brute(rows, 4, 3, 64)


def test_few_rows_and_none(spark):
    rows = [(3, [1.0, 2.0]), (4, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(c.clusters(df, k=16, width=2)) == brute(rows, 16, 3, 64)
    none = c.clusters(df.where("1 = 0"), width=2)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 1 << 62))
def test_roots_err_on_the_safe_side(square):
    exact = np.array([square], np.int64)
    for values in (exact, exact.astype(object), np.array([square * square], object)):
        low, high = c.roots(values, False)[0], c.roots(values, True)[0]
        n = int(values[0])
        as_square = lambda x: (int(x * 2.0**60) ** 2) if x < 2.0**900 else 0
        assert as_square(low) <= n << 120 and (as_square(high) >= n << 120)


def test_same_as_sql(spark, sf_dir, duck):
    same_as_sql(c.op12_clusters(spark, sf_dir), duck, op12())
