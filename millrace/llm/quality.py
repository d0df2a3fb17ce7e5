"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader (FTRL-proximal,
McMahan et al., "Ad Click Prediction", 2013), scored as sparse dot products.

Training reads at most ``rows`` labelled documents. They are dealt to shards of bounded size; each shard fits its
own model in one task and the models are averaged by bucket in Spark (parameter mixing). What reaches the driver is
one weight per non-zero bucket, at most ``BUCKETS`` of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

#: Buckets of the hashed n-grams; the last weight is the bias.
BUCKETS = 1 << 18
#: The bound of the training sample, in documents, and how many of them each averaged model gets at most.
TRAIN_ROWS = 20_000
SHARD_ROWS = 2_500
#: FTRL: learning rate, its smoothing, and both regularisers; passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 5.0, 1.0, 0.2, 0.0, 4

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
_CACHE: dict[bytes, int] = {}
_CACHE_SIZE = 100_000
#: Documents whose features are held at a time.
_ROWS = 250


def _word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word and each run of other signs."""
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass"))
    known = _CACHE
    if len(known) > _CACHE_SIZE:
        known.clear()
    out = []
    for w in found:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w, 7)
        out.append(h)
    return np.array(out, np.uint64)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the text's 1- and 2-grams and their weights, a unit vector of damped counts."""
    h = _word_hashes(text)
    if not len(h):
        return np.empty(0, np.int64), np.empty(0)
    with np.errstate(over="ignore"):
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + np.uint64(0x632BE59BD9B4E019))
        grams = np.concatenate((h, pairs)) * np.uint64(0xD6E8FEB86659FD93)
    bucket, count = np.unique((grams >> np.uint64(46)).astype(np.int64), return_counts=True)
    value = np.log1p(count)
    return bucket, value / np.sqrt((value * value).sum())


def fit_shard(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights of one FTRL model after ``EPOCHS`` passes in the given order."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        zi = z[i]
        shrunk = np.sign(zi) * L1 - zi
        return np.where(np.abs(zi) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for bucket, value, label in rows:
            i, x = np.append(bucket, BUCKETS), np.append(value, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            squared = g * g
            sigma = (np.sqrt(n[i] + squared) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += squared
    return weights(slice(None))


def held_out(doc_id: str = "doc_id") -> Column:
    """A null id has no remainder and is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """The averaged weights, learnt from labelled rows that are not held out, at most about ``rows`` of them.

    Labels other than 0 and 1 are ignored, an id with both counts as 1. No usable label: all weights are zero and
    every score is one half. Of rows that repeat an id one text is learnt from, the least; so the sample is bounded
    in rows too. Null texts count as empty, long ones are read whole, empty tables teach nothing, and further columns,
    whatever their names, are not read.
    """
    usable = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    usable = usable.where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    there = usable.count()
    share = min(1.0, rows / max(there, 1))
    parts = max(1, -(-min(there, rows) // SHARD_ROWS))
    scale = 1 << 30
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(share * scale))
    # about ``rows`` ids of 12 bytes: a fixed bound, whatever the size of the corpus
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.int32()]
        for whole in batches:
            for a in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(a, _ROWS)
                texts = [t.as_py() for t in batch.column(0)]
                got = [features(t) for t in texts]
                order = [xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass"), 3) >> 1 for t in texts]
                columns = [order, [g[0].astype(np.int32) for g in got], [g[1].astype(np.float32) for g in got], batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["ord", "bucket", "value", "label"])
        _CACHE.clear()

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord", kind="stable")
        w = fit_shard(list(zip(frame["bucket"], (v.astype(float) for v in frame["value"]), frame["label"])))
        at = np.flatnonzero(w)
        return pd.DataFrame({"bucket": at, "w": w[at]})

    schema = "ord long, bucket array<int>, value array<float>, label int"
    rows_of = texts.select("text", F.col("quality").cast("int")).mapInArrow(featurise, schema)
    shards = rows_of.groupBy(F.pmod("ord", F.lit(parts)).alias("shard"))
    fitted = shards.applyInPandas(fit, "bucket int, w double")
    mixed = fitted.groupBy("bucket").agg((F.sum("w") / parts).alias("w")).toPandas()
    weights = np.zeros(BUCKETS + 1)
    weights[mixed["bucket"].to_numpy(np.int64)] = mixed["w"].to_numpy()
    return weights


def score_text(weights: np.ndarray, text: str | None) -> float:
    bucket, value = features(text)
    s = float(weights[bucket] @ value) + float(weights[BUCKETS])
    return float(1 / (1 + np.exp(-min(35.0, max(-35.0, s)))))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with a column ``score``, 0 to 1, of every whole text; a null text counts as empty.

    An input column of that name is replaced; other columns stay. Repeated rows each keep their row, an empty table
    stays empty, texts of any length are read whole. A score of exactly one half predicts 1.
    """
    kept = [c for c in docs.columns if c != "score"]
    docs = docs.select(*kept)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2 MB, fixed by BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            scores = [score_text(w, t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*kept, "score"])
        _CACHE.clear()

    return docs.mapInArrow(run, docs.selectExpr("*", "cast(0 as double) as score").schema)


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text scores ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            good = [score_text(w, t.as_py()) >= least for t in batch.column("text")]
            yield batch.filter(pa.array(good, pa.bool_()))
        _CACHE.clear()

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", F.col("text").cast("string")), weights)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
