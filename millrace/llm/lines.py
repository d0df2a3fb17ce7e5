"""Line deduplication through a sharded minimal perfect hash over distinct line hashes.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; its hash has 128 bits. Texts fall into bundles
of a bounded number of lines, written once without the texts: each distinct key of a bundle, how many of its documents
have it, and which key each line has. The keys of all bundles are dealt to shards of a bounded number of keys. A shard
is a minimal perfect hash (levels of bit arrays: a level takes the keys that no other one meets there, the rest go to the
next) over two arrays, a fingerprint and a saturated count of documents for each key: some five bytes a key.

Documents don't meet lines in a join. A bundle sends its keys, each once, to their shards, where they are looked up in
the arrays as they stream by; the shard answers with the places of those that are frequent. So nothing that grows with
the corpus is broadcast, and a line that every document has costs one key a bundle. Equal texts have equal answers, which
come back as a bitmap over the lines; the text itself moves once, to meet it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.storage import discard, materialise

#: What a key is stripped of.
BLANK = b" \t\n\x0b\x0c\r"
#: Lines of a bundle (one text may have more), keys of a shard, keys of one request.
BUNDLE_LINES, SHARD_KEYS, REQUEST_KEYS = 1 << 16, 1 << 14, 256
#: Bits of a level for each key that it is tried with; levels at most, after which keys are listed.
GAMMA, LEVELS = 2, 48


def _mixed(x: np.ndarray, y: np.ndarray, level: int) -> np.ndarray:
    """64 bits of a key's two halves that are new for each level."""
    with np.errstate(over="ignore"):
        z = x ^ (y * np.uint64(2 * level + 1) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash: every key that it was made of has a number of its own below their number.

    ``sizes``: the levels' lengths in 64-bit words, ``words``: their bits one after the other, ``rest``: keys that no
    level took, as pairs of halves.
    """

    def __init__(self, sizes: list[int], words: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.rest = sizes, words, rest
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, levels: int | None = None) -> PerfectHash:
        """Of distinct keys given by their halves (uint64)."""
        sizes, words = [], [np.empty(0, np.uint64)]
        left = np.arange(len(x))
        while len(left) and len(sizes) < (LEVELS if levels is None else levels):
            size = -(-GAMMA * len(left) // 64)
            at = _mixed(x[left], y[left], len(sizes)) % np.uint64(64 * size)
            alone = np.bincount(at.astype(np.int64), minlength=64 * size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(words), np.stack([x[left], y[left]], axis=1))

    def number(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The keys' numbers. A key that it was not made of gets any number or -1."""
        out = np.full(len(x), -1, np.int64)
        left, first = np.arange(len(x)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                return out
            at = _mixed(x[left], y[left], level) % np.uint64(64 * size)
            word, bit = first + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = self.words[word]
            there = (held >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[there]] = self.before[word[there]] + below[there]
            left, first = left[~there], first + size
        for k, (a, b) in enumerate(self.rest.tolist()):
            out[left[(x[left] == a) & (y[left] == b)]] = int(self.before[-1]) + k
        return out


def key_of(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def _counts(key: bytes, least: int) -> bool:
    """Whether a key has ``least`` code points."""
    return len(key) >= 4 * least or len(key) >= least and len(key.decode("utf-8", "replace")) >= least


_BUNDLE = "bundle long, n_keys long, one binary, two binary, docs binary, first binary, second binary, lines binary, places binary"


def _bundles(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row a bundle of ``docs(text binary, first, second)``. Of each distinct text, named by two hashes: its lines'
    number. Of each line: the place of its key among the bundle's, -1 if it is too short to count."""
    names = [x.split()[0] for x in _BUNDLE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, made = TaskContext.get().partitionId() << 32, 0
        texts: dict[tuple[int, int], int] = {}
        copies: list[int] = []
        held: list[list[int]] = []
        keys: dict[bytes, int] = {}
        n_lines = 0

        def emit() -> pa.RecordBatch:
            digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.uint64).reshape(-1, 2)
            docs = np.zeros(len(keys), np.int64)
            for n, places in zip(copies, held):
                own = np.unique(places)
                docs[own[own >= 0]] += n
            first, second = np.array(list(texts), np.int64).reshape(-1, 2).T
            lines = np.fromiter(map(len, held), np.int32, len(held))
            places = np.fromiter((p for x in held for p in x), np.int32, n_lines)
            of = [digests[:, 0], digests[:, 1], docs, first, second, lines, places]
            return pa.RecordBatch.from_arrays([pa.array([at + made]), pa.array([len(keys)]), *[pa.array([x.tobytes()]) for x in of]], names)

        for batch in batches:
            columns = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for k, text in enumerate(batch.column(0)):
                name = columns[0][k], columns[1][k]
                if name in texts:
                    copies[texts[name]] += 1
                    continue
                lines = text.as_py().split(b"\n")
                if held and n_lines + len(lines) > BUNDLE_LINES:
                    yield emit()
                    made, n_lines = made + 1, 0
                    texts, copies, held, keys = {}, [], [], {}
                texts[name] = len(held)
                copies.append(1)
                found = map(key_of, lines)
                held.append([keys.setdefault(x, len(keys)) if _counts(x, min_chars) else -1 for x in found])
                n_lines += len(lines)
        if held:
            yield emit()

    return docs.mapInArrow(run, _BUNDLE)


_SHARD = "shard int, sizes array<int>, words binary, rest binary, prints binary, counts binary"


def _index(bundles: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """A row a shard of all keys: the perfect hash, the fingerprints and the counts, which stop at what ``min_docs`` asks."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one, two, docs = (np.frombuffer(batch.column(c)[r].as_py(), np.int64) for c in range(3))
                for a in range(0, len(one), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 10_000]) for x in (one, two, docs)], ["one", "two", "docs"])

    kind = np.min_scalar_type(max(min_docs, 1))
    names = [x.split()[0] for x in _SHARD.split(", ")]

    def build(table: pa.Table) -> pa.Table:
        one, two = (table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("one", "two"))
        made = PerfectHash.of(one, two)
        number = made.number(one, two)
        prints, counts = np.empty(len(one), np.uint32), np.empty(len(one), kind)
        prints[number] = two.astype(np.uint32)
        counts[number] = np.minimum(table.column("docs").to_numpy(), min_docs)
        row = [table.column("shard")[0].as_py(), made.sizes, *[x.tobytes() for x in (made.words, made.rest, prints, counts)]]
        kinds = [pa.int32(), pa.list_(pa.int32()), *[pa.binary()] * 4]
        return pa.Table.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

    keys = bundles.select("one", "two", "docs").mapInArrow(flat, "one long, two long, docs long")
    keys = keys.withColumn("shard", F.pmod("one", F.lit(shards)).cast("int"))
    # dealt by shard, which the sums and the groups then keep; a bundle has added up its documents already
    keys = keys.repartition("shard").groupBy("shard", "one", "two").agg(F.sum("docs").alias("docs"))
    return keys.groupBy("shard").applyInArrow(build, _SHARD)


def _answers(bundles: DataFrame, index: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """``(bundle, found)``: places of a bundle's keys that ``min_docs`` documents or more have, as they come from the
    shards. A shard's arrays come before the requests, which are looked up one after the other."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                bundle = batch.column(0)[r].as_py()
                one, two = (np.frombuffer(batch.column(c)[r].as_py(), np.int64) for c in (1, 2))
                shard = one % shards  # of a positive divisor: not below zero, as pmod
                order = np.argsort(shard, kind="stable")
                edges = np.flatnonzero(np.diff(shard[order])) + 1
                parts = [p[a : a + REQUEST_KEYS] for p in np.split(order, edges) for a in range(0, len(p), REQUEST_KEYS)]
                for a in range(0, len(parts), 1000):
                    of = parts[a : a + 1000]
                    columns = [pa.array([int(shard[p[0]]) for p in of], pa.int32()), pa.array([bundle] * len(of))]
                    columns += [pa.array([x.tobytes() for x in xs]) for xs in ([one[p] for p in of], [two[p] for p in of], [p.astype(np.int32) for p in of])]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "bundle", "one", "two", "at"])

    kind = np.min_scalar_type(max(min_docs, 1))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = made = prints = counts = None
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            bundle, found = [], []
            for r in range(batch.num_rows):
                take = lambda name, kind: np.frombuffer(column[name][r].as_py(), kind)  # noqa: B023, E731
                if column["bundle"][r].as_py() is None:
                    shard = column["shard"][r].as_py()
                    made = PerfectHash(column["sizes"][r].as_py(), take("words", np.uint64), take("rest", np.uint64).reshape(-1, 2))
                    prints, counts = take("prints", np.uint32), take("counts", kind)
                    continue
                if shard != column["shard"][r].as_py():
                    continue  # no shard has these keys
                one, two = take("one", np.uint64), take("two", np.uint64)
                number = made.number(one, two)
                known = number >= 0
                known[known] = prints[number[known]] == two[known].astype(np.uint32)
                known[known] = counts[number[known]] >= min_docs
                if known.any():
                    bundle.append(column["bundle"][r].as_py())
                    found.append(take("at", np.int32)[known].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bundle, pa.int64()), pa.array(found, pa.binary())], ["bundle", "found"])

    requests = bundles.select("bundle", "one", "two").mapInArrow(asked, "shard int, bundle long, one binary, two binary, at binary")
    rows = index.unionByName(requests, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", F.col("bundle").asc_nulls_first())
    return rows.mapInArrow(answer, "bundle long, found binary")


def _decisions(bundles: DataFrame, answers: DataFrame) -> DataFrame:
    """``(first, second, dropped)`` of every text that loses a line: a bitmap over its lines, in words of 64 bits."""
    names = ["first", "second", "dropped"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                n_keys = batch.column(0)[r].as_py()
                first, second = (np.frombuffer(batch.column(c)[r].as_py(), np.int64) for c in (1, 2))
                lines, places = (np.frombuffer(batch.column(c)[r].as_py(), np.int32) for c in (3, 4))
                goes = np.zeros(n_keys + 1, bool)  # the last is what -1 points to
                for part in batch.column(5)[r].as_py():
                    goes[np.frombuffer(part, np.int32)] = True
                ends = np.cumsum(lines)
                dropped = goes[places]
                out = []
                for k, (a, b) in enumerate(zip((ends - lines).tolist(), ends.tolist())):
                    if dropped[a:b].any():
                        words = np.packbits(np.append(dropped[a:b], np.zeros(-(b - a) % 64, bool)), bitorder="little")
                        out.append((first[k], second[k], words.view(np.int64)))
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names)

    met = bundles.select("bundle", "n_keys", "first", "second", "lines", "places").join(answers.groupBy("bundle").agg(F.collect_list("found").alias("found")), "bundle")
    rows = met.drop("bundle").mapInArrow(run, "first long, second long, dropped array<long>")
    return rows.groupBy("first", "second").agg(F.first("dropped").alias("dropped"))


def _names(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), text).alias(name) for seed, name in ((1, "first"), (2, "second"))]


def without_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, text)``, a row per row of ``docs(doc_id, text)``: lines whose key has ``min_chars``
    code points and is found in ``min_docs`` documents are dropped from every document, the others stay, joined by
    ``\\n``. n_lines counts before dropping.

    A document counts once for a key however often it has it; repeated rows are documents of their own. A null text is one
    empty line, as an empty one is, and comes back empty. Rows with a null doc_id count like any other. Texts are read
    whole at any length. An empty table gives an empty one; further columns, whatever their names, are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    bundles = materialise(_bundles(rows.select(F.col("text").cast("binary").alias("text"), *_names(F.col("text"))), min_chars), "bundles")
    keys = bundles.agg(F.sum("n_keys")).first()[0] or 0
    shards = max(1, -(-keys // SHARD_KEYS))
    index = materialise(_index(bundles, shards, min_docs), "line-index")
    answers = materialise(_answers(bundles, index, shards, min_docs), "answers")
    found = materialise(_decisions(bundles, answers), "dropped-lines")
    discard(bundles, index, answers)
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda _, i: F.getbit(F.get("dropped", F.shiftright(i, 6)), i.bitwiseAND(F.lit(63))) == 0)
    met = rows.select("*", *_names(F.col("text"))).join(found, ["first", "second"], "left")
    return met.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("dropped", F.lit(0), lambda n, x: n + F.bit_count(x)), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )


def op11_lines(spark, sf_dir: str) -> DataFrame:
    found = without_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
