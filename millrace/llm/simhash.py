"""SimHash near-duplicates through an inverted index on fingerprint bytes.

A print is eight positional bytes. Two fingerprints that differ in at most four bits share at least four of
the eight, so every linked pair meets in one of the twenty byte triples of ``TRIPLES``, a family that has a member
inside every set of four positions. A posting is a mask of positions and the print's bits under it; a pair that meets
there has its shared positional bytes tallied, is kept on reaching the guaranteed minimum, and is then verified bit by
bit.

Copies collapse to one class before the index. A posting longer than ``chunk`` is divided by a fourth byte, which a
linked pair must share as well, and then by a fifth of the bits that are left, one of which four differing bits leave
whole. Each posting gives a spanning forest of its links that starts from its smallest node, so links per node don't
grow with a group, and the forests of one group's postings mostly name the same links.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.components import connected_components
from millrace.llm.storage import discard, free, materialise

SEED = 42
_PART = 1 << 16


def _triples() -> list[tuple[int, int, int]]:
    """All triples of eight points within one of the groups {0,1,2}, {3,4,5}, {6,7}, or with two points in a group
    and one in the next: every four points contain one of them."""
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    found = []
    for t in itertools.combinations(range(8), 3):
        g = [group[p] for p in t]
        twice = [x for x in set(g) if g.count(x) == 2]
        if len(set(g)) == 1 or twice and next(x for x in g if x != twice[0]) == (twice[0] + 1) % 3:
            found.append(t)
    return found


TRIPLES = _triples()


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words; of the whole sequence if it is shorter; nothing if there is none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(found) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
    return np.array(hashes, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The signed 64-bit fingerprint. A bit is 1 if set in over half the hashes; no hash: all zero."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), _PART):
        h = hashes[a : a + _PART].astype(">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, fp)`` of every row's whole text, of its shingles of ``words`` words, repeats included; a null text
    counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(shingle_hashes(t.as_py(), words)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _mask(positions: Iterable[int], bits: Iterable[int] = ()) -> int:
    """The signed mask of whole bytes and single bits."""
    out = sum(255 << 8 * p for p in positions) | sum(1 << b for b in bits)
    return out - (1 << 64) if out >> 63 else out


def _divisions() -> list[dict[int, list[int]]]:
    """The masks that divide a long posting, by its mask: first each further byte, then each fifth of what is left."""
    first = {_mask(t): [_mask((*t, p)) for p in range(8) if p not in t] for t in TRIPLES}
    second = {}
    for four in itertools.combinations(range(8), 4):
        left = [8 * p + b for p in range(8) if p not in four for b in range(8)]
        second[_mask(four)] = [_mask(four, left[i::5]) for i in range(5)]
    return [first, second]


def _keyed(rows: DataFrame, masks: Column) -> DataFrame:
    """``(key, node, fp, mask)``: a row for each mask; the key stands for the mask and the bits under it."""
    rows = rows.select("node", "fp", F.explode(masks).alias("mask"))
    return rows.withColumn("key", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _postings(classes: DataFrame, chunk: int) -> DataFrame:
    """``(key, block, node, fp)`` of ``classes(node, fp)``; what two divisions leave long is dealt to pairs of chunks."""
    whole = F.lit(0).cast("long").alias("block")
    rows = _keyed(classes, _longs([_mask(t) for t in TRIPLES]))
    short = []
    for masks in _divisions():
        long_ones = materialise(rows.groupBy("key").count().where(F.col("count") > chunk).select("key"), "long")
        if long_ones.isEmpty():
            break
        short.append(rows.join(long_ones, "key", "left_anti").select("key", whole, "node", "fp"))
        parts = F.create_map(*[x for mask, those in masks.items() for x in (F.lit(mask).cast("long"), _longs(those))])
        rows = _keyed(rows.join(long_ones, "key", "left_semi"), parts[F.col("mask")]).distinct()
    else:
        rows = _spread(rows, chunk)
    out = rows.select("key", F.col("block") if "block" in rows.columns else whole, "node", "fp")
    for other in short:
        out = out.union(other)
    return out


def _spread(postings: DataFrame, chunk: int) -> DataFrame:
    """Give long postings blocks: their members fall into chunks, and each pair of chunks is a block of its own."""
    long_ones = postings.groupBy("key").count().where(F.col("count") > chunk)
    long_ones = long_ones.select("key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    dealt = postings.join(long_ones, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("node"), F.col("chunks"))
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    block = F.least("mine", "other") * F.col("chunks") + F.greatest("mine", "other")
    return dealt.withColumn("block", block.cast("long")).drop("chunks", "mine", "other")


def _near(x: np.ndarray, bits: int, shared: int) -> np.ndarray:
    """Which xors of two prints are links. Counting comes first: under ``shared`` equal bytes there is no link."""
    tally = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1)
    return (tally >= shared) & (np.bitwise_count(x) <= bits)


def _forest(fps: np.ndarray, bits: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one posting's links: each member, once reached, is compared with those not reached."""
    left = np.arange(len(fps))
    found: list[tuple[int, int]] = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop(0)
            near = _near(fps[left] ^ fps[at], bits, shared)
            reached = left[near]
            found += [(at, int(x)) for x in reached]
            queue += reached.tolist()
            left = left[~near]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def spanning(i: np.ndarray, j: np.ndarray, members: int) -> np.ndarray:
    """Which of the links (i, j) make a spanning forest: in each round every part keeps its first link that leads out
    of it (Boruvka), so a link stays only if it joins two parts."""
    part, kept, left = np.arange(members), np.zeros(len(i), bool), np.arange(len(i))
    while True:
        ends = np.stack([part[i[left]], part[j[left]]], axis=1)
        out = ends[:, 0] != ends[:, 1]
        left, ends = left[out], ends[out]
        if not len(left):
            return kept
        flat, other = ends.ravel(), ends[:, ::-1].ravel()
        first = np.full(members, -1)
        first[flat[::-1]] = np.arange(len(flat))[::-1]
        who = np.flatnonzero(first >= 0)
        kept[left[first[who] // 2]] = True
        up = np.arange(members)
        up[who] = other[first[who]]
        mutual = who[(up[up[who]] == who) & (who < up[who])]
        up[mutual] = mutual
        while (up[up] != up).any():
            up = up[up]
        part = up[part]


def _links_of_sorted(key: np.ndarray, node: np.ndarray, fps: np.ndarray, bits: int, shared: int) -> np.ndarray:
    """A spanning forest of the links within each run of equal key. Short runs are compared by distance within the run,
    all at once; long ones one by one."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(edge, len(key)))
    out = [np.empty((0, 2), np.int64)]
    for a, n in zip(edge[size > 48].tolist(), size[size > 48].tolist()):
        i, j = _forest(fps[a : a + n], bits, shared)
        out.append(np.stack([node[a + i], node[a + j]], axis=1))
    short = np.repeat(size <= 48, size)
    left = np.repeat(edge + size, size)  # where each run ends
    at = np.flatnonzero(short)
    step, pairs = 1, []
    while len(at := at[at + step < left[at]]):
        near = at[_near(fps[at] ^ fps[at + step], bits, shared)]
        pairs.append(np.stack([near, near + step]))
        step += 1
    if pairs:
        i, j = np.concatenate(pairs, axis=1)
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        keep = spanning(i, j, len(key))
        out.append(np.stack([node[i[keep]], node[j[keep]]], axis=1))
    return np.concatenate(out)


def links(classes: DataFrame, bits: int = 4, shared: int = 4, chunk: int = 4096) -> DataFrame:
    """Links ``(a, b)`` that connect ``classes(node, fp)`` as all pairs within ``bits`` would. ``shared``: the least
    number of equal bytes of such a pair, 8 - bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def emit(key: np.ndarray, _: np.ndarray, node: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            found = _links_of_sorted(key, node, fps.view(np.uint64), bits, shared)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for batch in batches:
            of = [c.to_numpy() for c in batch.columns]
            # a run is a posting's block: both numbers make the run's key
            of[0] = of[0] ^ (of[1] << np.int64(36))
            if held is not None:
                of = [np.concatenate(x) for x in zip(held, of)]
            key = of[0]
            if not len(key):
                continue
            cut = int(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[-1])
            held = [x[cut:] for x in of]
            if cut:
                yield emit(*(x[:cut] for x in of))
        if held is not None:
            yield emit(*held)

    rows = _postings(classes, chunk).repartition("key", "block").sortWithinPartitions("key", "block", "node")
    return rows.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, words: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)``, a row per row of ``docs(doc_id, text)``, over links of at most four differing
    bits, every one of which is found.

    component_id is the smallest doc_id reachable, itself included. Null and empty texts have print zero and link
    like any other; long texts are read whole; repeated rows each keep their row and share a component. Rows with a null
    doc_id take part; a group with no other id has a null component. An empty table gives no rows; further columns,
    whatever their names, are not read.
    """
    known = materialise(fingerprints(docs, words), "prints")
    classes = materialise(known.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "classes")
    found = connected_components(links(classes))
    named = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    # written first: a print that a third of the rows have is then a skewed join that adaptive execution splits
    return known.join(materialise(named, "named"), "fp", "left").select("doc_id", "fp", "component_id")


#: Near copies of whole documents share 4/5 or more of their distinct shingles of this many words.
SHINGLE_WORDS = 5
#: Postings up to this length give all their pairs at once; longer ones first the pairs with this many members.
SHORT, REPRESENTATIVES = 32, 4
#: Shingles seen often in one class of ``SAMPLE`` come last in the order, at most so many.
SAMPLE, COMMON = 16, 20_000


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of the whole text, as hashes in rising order."""
    return np.unique(shingle_hashes(text, SHINGLE_WORDS))


#: Words of 64 bits of a set's bitmap: bit i is the parity of the shingles that fall on it, so bits that differ between two
#: sets are never more than the shingles that do.
BITMAP = 16


def _common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample holds more than once, in rising order, and how often. Any order of the shingles finds the
    same pairs; rare ones first make short postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py()).view(np.int64))], ["key"])

    sample = docs.where(F.pmod("__text", F.lit(SAMPLE)) == 0).select(F.col("text").cast("string"))
    counts = sample.mapInArrow(run, "key long").groupBy("key").count().where("count > 1")
    rows = counts.orderBy(F.desc("count"), "key").limit(COMMON).collect()
    keys = np.array([r["key"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r["count"] for r in rows], np.int64)[order]


def described(docs: DataFrame) -> DataFrame:
    """``(doc_id, __text, set, fp, n, bits, prefix)`` of ``docs(doc_id, __text, text)``: a hash of the set of shingles, its
    fingerprint, its size, its bitmap, and its first n - ceil(4n/5) + 1 shingles in one order for all. Two sets with 4/5
    in common share one of these, since neither can miss more of the other than its prefix holds."""
    common, times = _common_shingles(docs)

    def row(text: str | None) -> tuple:
        h = shingle_set(text)
        n = len(h)
        often = np.zeros(n, np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, h), len(common) - 1)
            often = np.where(common[at] == h, times[at], 0)
        head = h[np.lexsort((h, often))][: n - (4 * n + 4) // 5 + 1]
        odd = np.bincount((h & np.uint64(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP) & 1
        bits = np.packbits(odd.astype(np.uint8)).view(np.int64)
        name = xxhash.xxh3_64_intdigest(h.tobytes())
        return name - (1 << 64) if name >> 63 else name, fingerprint(h), n, bits, head.view(np.int64)

    names = ["doc_id", "__text", "set", "fp", "n", "bits", "prefix"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                columns = zip(*[row(t.as_py()) for t in batch.column(2)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c, k) for c, k in zip(columns, kinds)]], names)

    rows = docs.select(F.col("doc_id").cast("long"), "__text", F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, __text long, set long, fp long, n int, bits array<long>, prefix array<long>")


#: Pairs that a task holds before it hands them on.
MOST_PAIRS = 1 << 20


def _meeting(of: dict[str, np.ndarray], every: bool) -> Iterator[np.ndarray]:
    """The pairs of one posting that can reach 4/5, a member at a time: after their first common shingle no more can
    follow than either has left. Of a long posting, unless ``every`` is set, only those with the members that have least
    before it."""
    n, left, group = of["n"], of["n"] - of["pos"], of["group"]
    order = np.argsort(of["pos"], kind="stable")
    for k, i in enumerate(order if every or len(order) <= SHORT else order[:REPRESENTATIVES]):
        j = order[k + 1 :]
        j = j[(9 * np.minimum(left[i], left[j]) >= 4 * (n[i] + n[j])) & (group[i] != group[j])]
        yield np.stack([np.full(len(j), i), j])


def _candidates(postings: DataFrame, every: bool, chunk: int) -> DataFrame:
    """Distinct pairs ``(a, b)`` of ``postings(key, set, n, pos, count, group)`` whose groups differ, by ``_meeting``."""
    names = ["key", "block", "set", "n", "pos", "group"]
    most = MOST_PAIRS

    def told(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.unique(np.concatenate([np.empty((2, 0), np.int64), *found], axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    def pairs(of: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        moved = (of["key"][1:] != of["key"][:-1]) | (of["block"][1:] != of["block"][:-1])
        edges = [0, *(np.flatnonzero(moved) + 1).tolist(), len(of["key"])]
        found, size = [], 0
        for a, b in zip(edges, edges[1:]):
            for met in _meeting({k: v[a:b] for k, v in of.items()}, every):
                x, y = of["set"][a + met]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
                size += len(x)
                if size >= most:
                    yield told(found)
                    found, size = [], 0
        yield told(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            of = {k: batch.column(i).to_numpy().astype(np.int64) for i, k in enumerate(names)}
            if held is not None:
                of = {k: np.concatenate((held[k], of[k])) for k in names}
            if not len(of["key"]):
                continue
            last = (of["key"] != of["key"][-1]) | (of["block"] != of["block"][-1])
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            held = {k: v[cut:] for k, v in of.items()}
            if cut:
                yield from pairs({k: v[:cut] for k, v in of.items()})
        if held is not None:
            yield from pairs(held)

    chunks = F.ceil(F.col("count") / chunk).cast("int")
    dealt = postings.withColumn("chunks", chunks).withColumn("mine", F.pmod(F.xxhash64("set"), "chunks"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    block = F.least("mine", "other") * F.col("chunks") + F.greatest("mine", "other")
    rows = dealt.withColumn("block", block.cast("long")).select(*names)
    rows = rows.repartition("key", "block").sortWithinPartitions("key", "block")
    return rows.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose whole sets of shingles have a Jaccard similarity of 4/5 or more, counted exactly: sets that similar
    differ in at most a ninth of their shingles together. Pairs whose bitmaps differ in more go first; only the texts
    of the others are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = [(None, None), (None, None)]
        for batch in batches:
            keep = []
            names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(batch.num_rows):
                for side in (0, 1):
                    if last[side][0] != names[side][k]:
                        last[side] = names[side][k], shingle_set(batch.column(2 + side)[k].as_py())
                x, y = last[0][1], last[1][1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(9 * both >= 4 * (len(x) + len(y)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def bitmap(side: str) -> DataFrame:
        return classes.select(F.col("set").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}"))

    differing = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = pairs.join(bitmap("a"), "a").join(bitmap("b"), "b").where(9 * differing <= F.col("n_a") + F.col("n_b"))
    near = materialise(near.select("a", "b"), "near")
    members = materialise(near.select(F.col("a").alias("set")).union(near.select("b")).distinct(), "members")
    named = materialise(classes.select("set", "doc_id", "__text").join(members, "set", "left_semi"), "named")
    whole = texts.select(F.col("doc_id").cast("long"), "__text", F.col("text").cast("string")).join(named, ["doc_id", "__text"])
    whole = materialise(whole.select("set", "text").dropDuplicates(["set"]), "texts")
    text = lambda side: whole.select(F.col("set").alias(side), F.col("text").alias(f"text_{side}"))
    rows = near.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b")
    found = materialise(rows.mapInArrow(run, "a long, b long"), "links")
    discard(pairs, near, members, named, whole)
    return found


def _grouped(links: DataFrame) -> DataFrame:
    """``(set, group)`` of every set that has a link."""
    found = connected_components(links)
    return materialise(found.select(F.col("node").alias("set"), F.col("component").alias("group")), "components")


def near_copies(classes: DataFrame, texts: DataFrame, chunk: int = 4096) -> DataFrame:
    """Links ``(a, b)`` between the sets of ``classes(set, fp, n, bits, prefix, doc_id, __text)`` that connect them as all
    pairs with 4/5 or more of their shingles in common would, and only such pairs. ``texts(doc_id, __text, text)`` has the
    text of every class.

    The byte index gives the pairs whose prints are within four bits, which is most near copies and no guarantee: sets
    at 4/5 have prints some ten bits apart. What it does not connect is looked for by prefixes of the sets, which miss
    nothing; long postings there first give the pairs with a few members, then all pairs that are still apart. Every
    pair is decided by its whole sets.
    """
    met = materialise(links(classes.select(F.col("set").alias("node"), "fp"), chunk=chunk), "met")
    near = _verified(met, classes, texts)
    groups = _grouped(near)

    def apart(postings: DataFrame, groups: DataFrame) -> DataFrame:
        return postings.drop("group").join(groups, "set", "left").withColumn("group", F.coalesce("group", "set"))

    prefixes = classes.select("set", "n", F.posexplode("prefix").alias("pos", "key"))
    counts = materialise(prefixes.groupBy("key").count().where("count > 1"), "counts")
    postings = materialise(apart(prefixes.join(counts, "key"), groups), "postings")
    more = _verified(materialise(_candidates(postings, False, chunk), "pairs"), classes, texts)
    long_ones = postings.where(F.col("count") > SHORT)
    if not long_ones.isEmpty():
        joined = materialise(near.union(more), "links")
        discard(near, more, groups)
        near, groups = joined, _grouped(joined)
        more = _verified(materialise(_candidates(apart(long_ones, groups), True, chunk), "pairs"), classes, texts)
    discard(postings, counts, groups)
    return near.union(more)


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, columns unchanged, that stand for their group of copies and near copies: of each group
    the one with the smallest doc_id, of repeated rows one.

    Near copies share 0.8 or more of their distinct five-word shingles. Every such pair counts and no other. Texts
    without words, null and empty ones too, are copies of each other; long texts are compared whole. A row without an id
    stays unless a row with an id is its copy. An empty table gives an empty one; further columns pass through, whatever
    their names.
    """
    name = F.xxhash64(F.col("text").cast("string"))
    marked = docs.select("doc_id", "text", name.alias("__text"))
    known = materialise(described(marked), "sets")
    first = {c: F.first(c).alias(c) for c in ("fp", "n", "bits", "prefix")}
    classes = known.where("doc_id is not null").groupBy("set").agg(F.min(F.struct("doc_id", "__text")).alias("least"), *first.values())
    classes = materialise(classes.select("set", "least.*", *first), "classes")
    nodes = classes.select("set", F.col("doc_id").alias("node"))
    ends = [nodes.select(F.col("set").alias(x), F.col("node").alias(f"node_{x}")) for x in ("a", "b")]
    near = near_copies(classes, marked).join(ends[0], "a").join(ends[1], "b")
    found = connected_components(near.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    named = nodes.join(found, "node", "left").select("set", F.coalesce("component", "node").alias("component_id"))
    # written first: a set that a third of the rows have is then a skewed join that adaptive execution splits
    found = known.join(materialise(named, "named"), "set", "left")
    of, key, own = (free(n, docs.columns) for n in ("__text", "__id", "__of"))
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(key), F.col("__text").alias(own)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(of) == F.col(own))
    return docs.withColumn(of, name).join(kept, same, "left_semi").dropDuplicates(["doc_id", of]).select(*docs.columns)


def fingerprint_hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
    return found.select("doc_id", fingerprint_hex("fp").alias("fingerprint"), "component_id")
