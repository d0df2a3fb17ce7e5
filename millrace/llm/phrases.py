"""Collocations by level-wise counting with hashed buckets (Park, Chen and Yu's PCY and DHP).

The pass that counts n-grams exactly also counts, for n + 1, how many fall in each of ``BUCKETS`` buckets; counts stop at the
least that is asked, so a bucket takes a byte. A bucket under that holds no frequent phrase. The next pass counts an
n-gram only if its bucket is frequent and, by Apriori, both phrases that are one word shorter are: their exact counts are
known by then. Both are told by bitmaps of ``BUCKETS`` bits, which is all that is broadcast, however large the corpus;
they may let a rare phrase through but never hold back a frequent one, and what they let through is counted exactly.

A task numbers the words it meets, so n-grams are rows of integers, sorts and adds them up in bounded memory, and hands
Spark one row for each distinct phrase of its part. Scores come from joins of the counted phrases with themselves.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from millrace.llm.storage import discard, materialise

#: Buckets of n-grams, and how many share a row when tasks' counts are added up.
BUCKETS, CHUNK = 1 << 24, 1 << 14
#: Bytes of text that are taken apart at once; words and distinct phrases that a task holds before it hands them on.
STRETCH, MOST_WORDS, MOST_PHRASES = 1 << 21, 1 << 18, 1 << 19
#: Rows of one window when phrases are ranked.
RANKED = 1 << 13
#: What ends a piece becomes the mark, what parts words a space, and A-Z becomes a-z.
_MARK = b"."
_FOLD = bytes(ord(".") if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_END = re.compile(rb"[ .]")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _chained(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase that goes on with a word."""
    with np.errstate(over="ignore"):
        z = (h + _PRIME) * np.uint64(0xBF58476D1CE4E5B9) ^ word
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(32))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h % np.uint64(buckets)).astype(np.int64)


def _set(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes fall in buckets whose bits are set."""
    bucket = _bucket(h, 8 * len(bits))
    return (bits[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1


class _Words:
    """The words of one language that a task has met: their numbers, hashes and whether they are frequent. Number 0 is the
    mark between pieces."""

    def __init__(self, lang: bytes, frequent: np.ndarray | None):
        self.seed = np.uint64(xxhash.xxh3_64_intdigest(lang))
        self.frequent = frequent
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[_MARK]
        self.hashes, self.often = np.zeros(1, np.uint64), np.zeros(1, bool)
        self.found: list[bytes] = [_MARK]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if len(self.number) > len(self.found):
            new = list(self.number)[len(self.found) :]
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))
            often = np.ones(len(new), bool) if self.frequent is None else _set(self.frequent, self.start(hashes))
            self.found += new
            self.hashes, self.often = np.append(self.hashes, hashes), np.append(self.often, often)
        return out

    def start(self, hashes: np.ndarray) -> np.ndarray:
        return _chained(np.full(len(hashes), self.seed), hashes)


def _cut(text: bytes, most: int) -> Iterator[bytes]:
    """A folded text in parts of ``most`` bytes or little more, cut where a word ends."""
    at = 0
    while len(text) - at > most and (end := _END.search(text, at + most)):
        yield text[at : end.start()]
        at = end.start()
    yield text[at:]


def _stretches(column: pa.Array, rows: list[int], most: int) -> Iterator[bytes]:
    """Some rows' texts, folded, each with a mark at its end, some ``most`` bytes at a time."""
    held, size = [], 0
    for r in rows:
        for part in _cut(column[r].as_py().translate(_FOLD) + _MARK, most):
            held.append(part)
            size += len(part)
            if size >= most:
                yield b"".join(held)
                held, size = [], 0
    if held:
        yield b"".join(held)


class _Counter:
    """Counts the phrases of n words of one language and hashes those of n + 1 into buckets."""

    def __init__(self, words: _Words, n: int, shorter: list[np.ndarray], buckets: np.ndarray | None):
        self.words, self.n, self.shorter, self.buckets = words, n, shorter, buckets
        self.carried = np.zeros(0, np.int64)
        self.rows = [np.empty((0, n), np.int64)]
        self.counts = [np.empty(0, np.int64)]
        self.size = 0

    def take(self, stretch: bytes) -> None:
        n = self.n
        new = self.words.numbers(stretch.replace(_MARK, b" . ").split())
        ids = np.concatenate((self.carried, new))
        old, self.carried = len(self.carried), ids[max(0, len(ids) - n) :]
        # of phrases of m words those that end in this stretch: ``whole[m]`` tells by their first word which have no mark
        whole = {1: ids > 0}
        hashed = {1: self.words.start(self.words.hashes[ids])}
        for m in range(2, n + 2):
            rest = max(0, len(ids) - m + 1)
            whole[m] = whole[m - 1][:rest] & (ids[m - 1 :] > 0)[:rest]
            hashed[m] = _chained(hashed[m - 1][:rest], self.words.hashes[ids[m - 1 :][:rest]])
        keep = whole[n].copy()
        if n == 2:
            often = self.words.often[ids]
            keep &= often[:-1] & often[1:] if len(ids) > 1 else keep
        if n > 1:
            # both phrases one word shorter; that without the first word has a hash of its own
            tail = self.words.start(self.words.hashes[ids[1:]])
            for m in range(2, n):
                rest = max(0, len(ids) - m)
                tail = _chained(tail[:rest], self.words.hashes[ids[m:][:rest]])
            at = np.flatnonzero(keep)
            exact, hot = self.shorter
            at = at[_set(hot, hashed[n][at])]
            if n > 2:
                at = at[_set(exact, hashed[n - 1][at])]
                at = at[_set(exact, tail[at])]
        else:
            at = np.flatnonzero(keep)
        if self.buckets is not None:
            longer = whole[n + 1].copy()
            if n > 1:  # only of phrases that go on in both directions
                ok = np.zeros(len(ids), bool)
                ok[at] = True
                longer &= (ok[:-1] & ok[1:])[: len(longer)] if len(ids) > 1 else longer
            ends = np.arange(len(longer)) + n
            bucket, more = np.unique(_bucket(hashed[n + 1][longer & (ends >= old)], len(self.buckets)), return_counts=True)
            self.buckets[bucket] = np.minimum(self.buckets[bucket] + more, 255)
        at = at[at + n - 1 >= old]
        rows = np.stack([ids[at + i] for i in range(n)], axis=1)
        self._add(*self._grouped(rows, np.ones(len(rows), np.int64)))

    def _grouped(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(rows):
            return rows, counts
        # numbers of words are bounded, so up to three fit a 64-bit key
        bits = max(1, int(len(self.words.found)).bit_length())
        if bits * self.n > 63:
            order = np.lexsort(rows.T[::-1])
            rows, counts = rows[order], counts[order]
            first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1))))
            return rows[first], np.add.reduceat(counts, first)
        key = rows[:, 0]
        for i in range(1, self.n):
            key = key << bits | rows[:, i]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        return rows[order[first]], np.add.reduceat(counts[order], first)

    def _add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        self.rows.append(rows)
        self.counts.append(counts)
        self.size += len(rows)

    def merge(self) -> int:
        rows, counts = self._grouped(np.concatenate(self.rows), np.concatenate(self.counts))
        self.rows, self.counts, self.size = [rows], [counts], len(rows)
        return self.size

    def goes_on(self, words: _Words) -> _Counter:
        """A counter with words of its own that takes up the text where this one is."""
        out = _Counter(words, self.n, self.shorter, self.buckets)
        out.carried = words.numbers([self.words.found[i] for i in self.carried.tolist()])
        return out

    def phrases(self) -> Iterator[tuple[list[bytes], np.ndarray]]:
        self.merge()
        word = self.words.found.__getitem__
        for a in range(0, self.size, 50_000):
            rows = self.rows[0][a : a + 50_000].tolist()
            yield [b" ".join(map(word, r)) for r in rows], self.counts[0][a : a + 50_000]


_COUNTED = "lang string, phrase binary, f long, chunk int, buckets binary"


def _counted(docs: DataFrame, n: int, bitmaps: list[bytes], last: bool, least: int) -> DataFrame:
    """Rows of two kinds: ``(lang, phrase, f)`` of the phrases of n words in a task's part, and unless ``last`` is set
    ``(chunk, buckets)`` with how many longer ones fell in each bucket of a chunk, up to ``least``."""
    names = [x.split()[0] for x in _COUNTED.split(", ")]
    kinds = [pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, *shorter = [np.frombuffer(b, np.uint8) for b in bitmaps] or [None]
        buckets = None if last else np.zeros(BUCKETS, np.uint8)
        counters: dict[str, _Counter] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, counter in counters.items():
                for phrases, f in counter.phrases():
                    size = len(phrases)
                    columns = [[lang] * size, phrases, f, [None] * size, [None] * size]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            counters.clear()

        for batch in batches:
            by: dict[str, list[int]] = {}
            for r, lang in enumerate(batch.column(0).to_pylist()):
                by.setdefault(lang, []).append(r)
            for lang, of in by.items():
                for stretch in _stretches(batch.column(1), of, STRETCH):
                    if lang not in counters:
                        counters[lang] = _Counter(_Words(lang.encode(), frequent), n, shorter, buckets)
                    counter = counters[lang]
                    counter.take(stretch)
                    many = sum(len(c.words.found) for c in counters.values()) > MOST_WORDS
                    if not many and sum(c.size for c in counters.values()) > 2 * MOST_PHRASES:
                        many = sum(c.merge() for c in counters.values()) > MOST_PHRASES
                    if many:
                        yield from told()
                        counters[lang] = counter.goes_on(_Words(lang.encode(), frequent))
        yield from told()
        if not last:
            for c in range(0, BUCKETS, CHUNK):
                part = buckets[c : c + CHUNK]
                if part.any():
                    row = [None, None, None, c // CHUNK, np.minimum(part, np.uint8(least)).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

    return docs.mapInArrow(run, _COUNTED)


def _bitmap(chunks: DataFrame, least: int) -> bytes:
    """The bits of the buckets whose counts in ``chunks(chunk, buckets)`` reach ``least``, ``BUCKETS`` in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = sums.setdefault(chunk, np.zeros(CHUNK, np.uint16))
                np.minimum(held + np.frombuffer(counts.as_py(), np.uint8), least, out=held)
        for chunk, counts in sums.items():
            bits = np.packbits(counts >= least, bitorder="little")
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([bits.tobytes()])], ["chunk", "bits"])

    rows = chunks.select("chunk", "buckets").repartition("chunk").mapInArrow(run, "chunk int, bits binary").collect()
    out = np.zeros(BUCKETS // 8, np.uint8)
    for r in rows:
        out[r["chunk"] * CHUNK // 8 :][: CHUNK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def _known(frequent: DataFrame) -> bytes:
    """The bitmap of the buckets of ``frequent(lang, phrase)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, bool)
        hashes = lambda words: np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        for batch in batches:
            h = hashes([lang.encode() for lang in batch.column(0).to_pylist()])
            for words in zip(*[phrase.split(b" ") for phrase in batch.column(1).to_pylist()]):  # all have as many
                h = _chained(h, hashes(words))
            held[_bucket(h, BUCKETS)] = batch.num_rows > 0
        for c in range(0, BUCKETS, CHUNK):
            if held[c : c + CHUNK].any():
                of = [pa.array([c // CHUNK], pa.int32()), pa.array([held[c : c + CHUNK].astype(np.uint8).tobytes()])]
                yield pa.RecordBatch.from_arrays(of, ["chunk", "buckets"])

    return _bitmap(frequent.select("lang", F.col("phrase").cast("binary")).mapInArrow(run, "chunk int, buckets binary"), 1)


def phrase_counts(docs: DataFrame, most_words: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, words, f)`` of every phrase of up to ``most_words`` words that a language has ``least`` times, and
    ``(lang, n)`` of all words of ``docs(lang, text)``. A least over 255 is bucketed as 255."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    cap = max(1, min(least, 255))
    bitmaps: list[bytes] = []
    found = words = None
    for n in range(1, most_words + 1):
        last = n == most_words
        part = materialise(_counted(rows, n, bitmaps, last, cap), f"phrases-{n}")
        sums = part.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        if n == 1:
            sums = materialise(sums, "words")
            words = materialise(sums.groupBy("lang").agg(F.sum("f").alias("n")), "languages")
        often = materialise(sums.where(F.col("f") >= least).select("lang", F.col("phrase").cast("string").alias("phrase"), F.lit(n).alias("words"), "f"), f"frequent-{n}")
        if not last:
            known, hot = _known(often), _bitmap(part.where("buckets is not null"), cap)
            bitmaps = [known if n == 1 else bitmaps[0], known, hot]
        discard(part, *([sums] if n == 1 else []))
        found = often if found is None else found.union(often)
    return found, words


def _best(rows: DataFrame, by: str, order: list, most: int) -> DataFrame:
    """Each group's first rows with their rank. Groups of any size: while one is larger than a window may be, groups are
    dealt to windows of that size, of which the first rows stay."""
    largest = lambda of: of.groupBy(by).count().agg(F.max("count")).first()[0] or 0
    size = largest(rows)
    while size > max(RANKED, 2 * most):
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(-(-size // max(RANKED, 2 * most)))))
        place = F.row_number().over(Window.partitionBy(by, "salt").orderBy(*order))
        rows = materialise(dealt.withColumn("rank", place).where(F.col("rank") <= most).drop("salt", "rank"), "ranked")
        size = largest(rows)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def scored(counts: DataFrame, words: DataFrame, inside: int, most: int) -> DataFrame:
    """The first phrases of each language from what ``phrase_counts`` returns."""
    phrases = counts.where("words > 1").withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    part = lambda name, phrase: counts.select("lang", F.col("phrase").alias(phrase), F.col("f").alias(name))
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "words", "k", F.expr("substring_index(phrase, ' ', k)").alias("head"), F.expr("substring_index(phrase, ' ', k - words)").alias("tail"))
    cuts = cuts.join(part("l", "head"), ["lang", "head"]).join(part("r", "tail"), ["lang", "tail"])
    exact = F.expr("(CAST(1000000 AS DECIMAL(7, 0)) * (CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0)))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    lowest = F.min(F.struct(exact.cast("long").alias("score"), "k", "l", "r")).alias("cut")
    rated = materialise(cuts.groupBy("lang", "phrase", "a", "words").agg(lowest).select("lang", "phrase", "a", "words", "cut.score", "cut.l", "cut.r"), "scored")
    # every run of two or more words inside a longer phrase
    runs = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    longer = rated.where("words > 2").select("lang", F.explode(runs).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = rated.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    kept = materialise(kept.select("lang", "phrase", "a", "l", "r", "score"), "collocations")
    first = _best(kept, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], most)
    return first.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, inside: int = 50, most: int = 2000) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: of each language of ``docs(lang, text)`` its first phrases of two to
    ``most_words`` words that it has ``least`` times or more.

    A phrase's words stand together in a piece; pieces end at ``.,;:!?`` and line ends, words at blanks and tabs. a is its
    count, n the language's words. Cut in two parts with the counts l and r it scores floor(10^6 a a / (l r)), exactly;
    the lowest cut counts, ties to the shorter first part. A phrase goes if a longer one that has it inside comes to ``inside``
    percent of its count, whether that goes itself or not. Ties in rank go to the higher a, then to the phrase in byte order.

    A null lang is ``und``, a null text empty. Repeated rows count each, rows with a null id too; texts of any length are read
    whole. An empty table gives an empty one; further columns, whatever their names, are not read.
    """
    return scored(*phrase_counts(docs, most_words, least), inside, most)


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"), most_words=3, least=10, inside=50, most=2000)
