"""Benchmark decontamination by the q-gram lemma.

Texts are reduced to lower-case letters, digits and marks. A benchmark item is cut into regions of ``REGION`` signs, one
every ``STRIDE`` signs, so that any quote of ``REGION + STRIDE`` signs covers one; an item shorter than a region is one.
A region of m signs that occurs in a text with at most k edits shares at least m + 1 - q - k q of its q-grams with it,
all on diagonals (place in the text less place in the region) within k of each other. So the scan counts shared q-grams
in bands of diagonals, each 2 k + 2 wide and overlapping the next by half, keeps the regions that reach the bound, and
verifies those by alignment within the band. Items with fewer than q signs are looked for as whole words.

Equal regions are looked for once, so neither repetitive items nor passages that many items share multiply the hits. The
regions go to the executors in blocks of about ``BLOCK_REGIONS``, one pass over the documents for each block, so a
benchmark, or an item, of any size is handled with a fixed broadcast. A text is taken in stretches that hold at most
``MOST_HITS`` hits and overlap by more than a region can span, so that memory does not grow with it.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.storage import materialise

Q = 8
REGION, STRIDE = 50, 10
#: Edits allowed, as a share of a region's length; fewer where the bound would fall below one shared q-gram.
EDITS = 0.08
#: Regions of a block in the mean; a region has at most REGION + 1 - Q q-grams of some 16 bytes each on the executors.
BLOCK_REGIONS = 100_000
#: Signs of text that are hashed at a time, and hits that are held at a time.
_PIECE, MOST_HITS = 1 << 20, 1 << 20
_MASK_BITS = 22


@cache
def _fold() -> np.ndarray:
    """For each code point its lower-case form if that is one letter or digit, else 0."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalnum():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
        elif unicodedata.category(ch)[0] == "M":
            out[c] = c
    return out


def fold(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The letters, digits and marks of a text, lower-cased, and their places in it."""
    signs = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _fold()[signs]
    at = np.flatnonzero(low)
    return low[at], at


def qgram_hashes(signs: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash at every place where ``q`` signs follow, by doubling and a remainder."""
    if len(signs) < q:
        return np.empty(0, np.uint64)
    b = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        h = signs.astype(np.uint64) + np.uint64(0x51ED27)
        one, n = h, 1
        while 2 * n <= q:
            h = h[: len(h) - n] * np.uint64(pow(b, n, 1 << 64)) + h[n:]
            n *= 2
        while n < q:
            h = h[:-1] * np.uint64(b) + one[n:]
            n += 1
        return h ^ (h >> np.uint64(29))


def edits_allowed(signs: int) -> int:
    return max(0, min(int(EDITS * signs), (signs - Q) // Q))


def banded_edits(pattern: np.ndarray, text: np.ndarray, most: int) -> int:
    """Least edits that turn ``pattern`` into some part of ``text``, or most + 1. The text is the stretch of the
    band: places further than its width from the pattern's diagonal are never reached."""
    width = len(text) - len(pattern)
    last = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, p in enumerate(pattern.tolist(), 1):
        new = np.empty_like(last)
        new[0] = i
        new[1:] = np.minimum(last[:-1] + (text != p), last[1:] + 1)
        new = np.minimum.accumulate(new - steps) + steps  # insertions, left to right
        outside = (steps < i - most) | (steps > i + width + most)
        new[outside] = most + 1
        if new.min() > most:
            return most + 1
        last = new
    return int(min(last.min(), most + 1))


class Needles:
    """The regions of a block, each with the items that hold it; their q-grams sorted by hash behind a bit mask."""

    def __init__(self, rows: list[tuple[bytes, int | None]]):
        owners: dict[bytes, set] = {}
        for region, item in rows:
            owners.setdefault(region, set()).add(item)
        self.owners = list(owners.values())
        self.signs = [np.frombuffer(r, np.uint32) for r in owners]
        lengths = np.array([len(s) for s in self.signs], np.int64)
        self.most = np.array([edits_allowed(n) for n in lengths], np.int64)
        self.least = np.maximum(1, lengths + 1 - Q - self.most * Q)
        hashes = [qgram_hashes(s) for s in self.signs]
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        region = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes]).astype(np.int64)
        place = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.region, self.place = region[order].astype(np.int32), place[order].astype(np.int16)
        self.hash, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.mask = np.zeros(1 << _MASK_BITS, bool)
        self.mask[self._slot(self.hash)] = True
        #: regions of fewer signs than a q-gram, by length and hash
        self.words: dict[int, dict[int, list[int]]] = {}
        for r in np.flatnonzero(lengths < Q).tolist():
            n = int(lengths[r])
            self.words.setdefault(n, {}).setdefault(int(qgram_hashes(self.signs[r], n)[0]), []).append(r)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _MASK_BITS)).astype(np.int64)

    def _places(self, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the text whose q-gram some region has, and which q-gram that is."""
        at, gram = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a in range(0, len(signs) if len(self.hash) else 0, _PIECE):
            h = qgram_hashes(signs[a : a + _PIECE + Q - 1])
            near = np.flatnonzero(self.mask[self._slot(h)])
            k = np.searchsorted(self.hash, h[near])
            k[k == len(self.hash)] = 0
            hit = self.hash[k] == h[near]
            at.append(near[hit] + a)
            gram.append(k[hit])
        return np.concatenate(at), np.concatenate(gram)

    def _stretches(self, at: np.ndarray, gram: np.ndarray) -> Iterator[tuple[int, int]]:
        """Slices of the places found, of some ``MOST_HITS`` hits each; whatever spans ``over`` signs lies whole in one."""
        over = 2 * REGION
        hits = np.concatenate(([0], np.cumsum(self.count[gram])))
        a = 0
        while a < len(at):
            b = int(np.searchsorted(hits, hits[a] + MOST_HITS))
            b = min(len(at), max(b, int(np.searchsorted(at, at[a] + 2 * over))))
            yield a, b
            if b == len(at):
                return
            a = max(a + 1, int(np.searchsorted(at, at[b] - over)))

    def found(self, signs: np.ndarray, places: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """Region to (first place, end place, edits) of one occurrence. ``places``: of the signs in the whole text."""
        hit: dict[int, tuple[int, int, int]] = {}
        at, gram = self._places(signs)
        for a, b in self._stretches(at, gram):
            self._bands(signs, at[a:b], gram[a:b], hit)
        for n, known in self.words.items():
            h = qgram_hashes(signs, n)
            for i in np.flatnonzero(np.isin(h, np.array(list(known), np.uint64))).tolist():
                whole = (i == 0 or places[i - 1] + 1 < places[i]) and (i + n == len(signs) or places[i + n - 1] + 1 < places[i + n])
                for r in known[int(h[i])] if whole else ():
                    if r not in hit and (signs[i : i + n] == self.signs[r]).all():
                        hit[r] = (i, i + n, 0)
        return hit

    def _bands(self, signs: np.ndarray, at: np.ndarray, gram: np.ndarray, hit: dict[int, tuple[int, int, int]]) -> None:
        n = self.count[gram]
        row = np.repeat(self.first[gram] + n - np.cumsum(n), n) + np.arange(n.sum())
        often = np.bincount(self.region[row], minlength=len(self.signs)) >= self.least
        keep = often[self.region[row]]
        if not keep.any():
            return
        row, at = row[keep], np.repeat(at, n)[keep]
        region, place = self.region[row].astype(np.int64), self.place[row].astype(np.int64)
        half = self.most[region] + 1
        low = (at - place) // half + 1  # a diagonal may be -REGION, its band at least -REGION - 1
        key = (region << 40) + low + REGION
        # each hit is in two bands; counting hits instead of places is never too low
        bands, of, count = np.unique(np.concatenate((key, key - 1)), return_inverse=True, return_counts=True)
        good = count >= self.least[bands >> 40]
        if not good.any():
            return
        which = np.flatnonzero(good[of])
        which = which[np.argsort(of[which], kind="stable")]
        edge = np.flatnonzero(np.concatenate(([True], np.diff(of[which]) != 0, [True])))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            mine = which[a:b] % len(key)
            r, band = int(bands[of[which[a]]] >> 40), int(bands[of[which[a]]] & ((1 << 40) - 1)) - REGION - 1
            if r in hit or len(np.unique(place[mine])) < self.least[r]:
                continue
            most, pattern = int(self.most[r]), self.signs[r]
            start = max(0, band * (most + 1) - most)
            end = min(len(signs), len(pattern) + (band + 2) * (most + 1) + most)
            edits = self._verify(pattern, signs[start:end], most)
            if edits <= most:
                hit[r] = (int(at[mine].min()), int(at[mine].max()) + Q, edits)

    @staticmethod
    def _verify(pattern: np.ndarray, text: np.ndarray, most: int) -> int:
        if text.tobytes().find(pattern.tobytes()) >= 0:
            return 0
        return banded_edits(pattern, text, most)

    def find(self, text: str | None) -> list[tuple[int | None, int, int, int, int]]:
        """(item, regions found, first place, end place, least edits) for each item that the text leaks."""
        signs, places = fold(text)
        items: dict[int | None, list[int]] = {}
        for r, (first, end, edits) in self.found(signs, places).items():
            start, stop = int(places[first]), int(places[end - 1]) + 1
            for item in self.owners[r]:
                n, a, b, e = items.get(item, (0, start, stop, edits))
                items[item] = n + 1, min(a, start), max(b, stop), min(e, edits)
        return [(item, *found) for item, found in items.items()]


def regions_of(signs: np.ndarray) -> list[tuple[int, int]]:
    """Where an item's regions start and end."""
    n = len(signs)
    if n <= REGION:
        return [(0, n)] if n else []
    return [(s, s + REGION) for s in [*range(0, n - REGION, STRIDE), n - REGION]]


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark's regions ``(region, item_id)`` in as many parts as their number needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1)):
                signs, _ = fold(text.as_py())
                found = [signs[a:b].tobytes() for a, b in regions_of(signs)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([item.as_py()] * len(found), pa.int64())], ["region", "item_id"])

    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    regions = materialise(items.mapInArrow(run, "region binary, item_id long").distinct(), "regions")
    parts = -(-regions.count() // BLOCK_REGIONS)
    return [regions.where(F.pmod(F.xxhash64("region", "item_id"), F.lit(parts)) == i) for i in range(parts)]


def _needles(block: DataFrame) -> Needles:
    return Needles([(bytes(r["region"]), r["item_id"]) for r in block.collect()])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row ``(doc_id, item_id, regions, first_char, end_char, edits)`` for each document and item it leaks.

    ``regions``: how many different regions of the item were found; the places are code points of the text, the end
    exclusive; ``edits``: of the best region. Null and empty texts leak nothing, texts of any length are read whole.
    Items with a null text or without letters and digits are nowhere; items that share an id, null included, are one.
    Repeated rows each give their rows, two equal items with different ids both are found. An empty table on either
    side gives no rows; further columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    names = ["row", "doc_id", "item_id", "regions", "first_char", "end_char", "edits"]
    schema = "row long, doc_id long, item_id long, regions int, first_char long, end_char long, edits int"
    out = spark.createDataFrame([], schema)
    blocks = _blocks(benchmark)
    for block in blocks:
        shared = spark.sparkContext.broadcast(_needles(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            needles = shared.value
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
            for batch in batches:
                rows = []
                for row, doc_id, text in zip(*batch.columns):
                    rows += [(row.as_py(), doc_id.as_py(), *found) for found in needles.find(text.as_py())]
                columns = list(zip(*rows)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        out = out.union(texts.mapInArrow(run, schema))
    if len(blocks) > 1:  # an item's regions may lie in several blocks
        merged = [F.sum("regions").cast("int").alias("regions"), F.min("first_char").alias("first_char"), F.max("end_char").alias("end_char"), F.min("edits").alias("edits")]
        out = out.groupBy("row", "doc_id", "item_id").agg(*merged)
    return out.drop("row")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, columns unchanged, whose text leaks no benchmark item, as ``leaks`` finds them. Nothing is
    shuffled but the benchmark's regions."""
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(_needles(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            needles = shared.value
            for batch in batches:
                clean = [not needles.find(t.as_py()) for t in batch.column("text")]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
