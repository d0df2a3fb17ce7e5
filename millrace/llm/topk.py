"""Exact top-k inner products on a bit-sliced index.

Components are quantised to integers. Rows fall into blocks; in a block every attribute is kept as bit slices, each a
bitmap over the block's rows, of the value less the attribute's least value. For a query, the slices are added with
bitmap arithmetic (full adders on whole bitmaps, shifted by the weight's bits; a negative weight takes the inverse
slice), which gives the slices of all rows' scores less a constant. The top rows are then read from the most
significant slice downward: rows surely in, rows still tied; what is tied at the end goes to the smaller ids, exactly.

The stated queries run against every block: a task holds one chunk of queries and one block, both of a bounded number of
cells, so a block moves once for each chunk and a chunk once for each block. Each pair gives ``k`` rows a query at most,
and a window over those picks the final ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.storage import materialise

#: Cells (rows times components) of a block and of a chunk of queries at most, and the chunks that few queries still make.
BLOCK_CELLS, CHUNK_CELLS, LEAST_CHUNKS = 1 << 22, 1 << 20, 6
#: Tasks of the search at most.
MOST_TASKS = 20_000
_MOST = (1 << 63) - 1


def quantised(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: 64-bit integers, or Python's own where one is too large for sums of those."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * float(scale))
    if (np.abs(scaled) < float(1 << 61)).all():
        return scaled.astype(np.int64)
    # what is so large has no fraction, so it can be scaled as an integer
    exact = [[int(y) if abs(y) < 2.0**53 else int(x) * scale for x, y in zip(xs, ys)] for xs, ys in zip(vectors.tolist(), scaled.tolist())]
    return np.array(exact, object).reshape(vectors.shape)


def slices_of(values: np.ndarray) -> tuple[np.ndarray, list[int], int]:
    """Bitmaps [attribute, bit, word], each attribute's least value, and the rows' number."""
    rows, width = values.shape
    least = values.min(axis=0)
    moved = values - least
    bits = max(1, int(moved.max(initial=0)).bit_length())
    words = -(-rows // 64)
    out = np.zeros((width, bits, words * 64), np.uint8)
    for b in range(bits):
        out[:, b, :rows] = ((moved >> b) & 1).T
    packed = np.packbits(out.reshape(width * bits, -1), axis=1, bitorder="little")
    return packed.view(np.uint64).reshape(width, bits, words), least.tolist(), rows


def summed(slices: np.ndarray, inverse: np.ndarray, least: list[int], weights: list[int]) -> tuple[list, int]:
    """Slices of every row's inner product with ``weights``, least significant first, less a constant; and that."""
    bits = slices.shape[1]
    full = (1 << bits) - 1
    columns: list[list[np.ndarray]] = [[]]
    constant = 0
    for d, w in enumerate(weights):
        constant += w * least[d]
        if w < 0:
            constant += w * full
        planes = inverse[d] if w < 0 else slices[d]
        size, shift = abs(w), 0
        while size:
            if size & 1:
                while len(columns) < shift + bits:
                    columns.append([])
                for i in range(bits):
                    columns[shift + i].append(planes[i])
            size >>= 1
            shift += 1
    out = []
    i = 0
    while i < len(columns):
        column = columns[i]
        if len(column) > 1 and i + 1 == len(columns):
            columns.append([])
        while len(column) > 2:
            a, b, c = column.pop(), column.pop(), column.pop()
            t = a ^ b
            columns[i + 1].append((a & b) | (t & c))
            column.append(t ^ c)
        if len(column) == 2:
            a, b = column
            columns[i + 1].append(a & b)
            column[:] = [a ^ b]
        out.append(column[0] if column else np.zeros(slices.shape[2], np.uint64))
        i += 1
    return out, constant


def _rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_rows(score: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """The k allowed rows of the highest scores, ties to the smaller row; all, if there are no more."""
    count = lambda x: int(np.bitwise_count(x).sum())
    if count(allowed) <= k:
        return _rows_of(allowed)
    sure, tied = np.zeros_like(allowed), allowed
    for plane in reversed(score):
        high = tied & plane
        n = count(sure) + count(high)
        if n > k:
            tied = high
        else:
            sure = sure | high
            tied = tied & ~plane
            if n == k:
                return _rows_of(sure)
    rows = _rows_of(sure)
    return np.concatenate((rows, _rows_of(tied)[: k - len(rows)]))


def search_block(ids: np.ndarray, index: tuple, queries: list[tuple[int, list[int]]], k: int) -> Iterator[tuple[int, int, int]]:
    """(query's place, vec_id, score) of each query's best rows of a block whose rows are sorted by id."""
    slices, least, rows = index
    inverse = ~slices
    words = slices.shape[2] if len(slices) else -(-rows // 64)
    every = np.packbits((np.arange(words * 64) < rows).astype(np.uint8), bitorder="little").view(np.uint64)
    for place, (query_id, weights) in enumerate(queries):
        score, constant = summed(slices, inverse, least, weights) if len(slices) else ([], 0)
        allowed = every.copy()
        lo, hi = np.searchsorted(ids, (query_id, query_id + 1))
        for row in range(lo, hi):
            allowed[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        best = top_rows(score, allowed, k)
        narrow = len(score) < 62 and abs(constant) < 1 << 62
        total = np.full(len(best), constant, np.int64 if narrow else object)
        for i, plane in enumerate(score):
            bit = ((plane[best >> 6] >> (best & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            total += bit << i if narrow else bit.astype(object) * (1 << i)
        for row, s in zip(best.tolist(), total.tolist()):
            yield place, int(ids[row]), s


def _order(score: int) -> bytes | None:
    """Bytes that sort as the scores do, of those that no long holds."""
    if abs(score) < _MOST:
        return None
    size = abs(score).to_bytes(-(-abs(score).bit_length() // 8), "big")
    up = len(size).to_bytes(3, "big") + size
    return b"\1" + up if score > 0 else b"\0" + bytes(255 - x for x in up)


def search(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``vectors(vec_id, embedding)`` that ``queries`` selects
    its k highest integer inner products with rows of other ids and as many components, ties to the smaller vec_id.

    Rows with a null id, or a vector that is null or holds a null or non-finite component, take no part; an empty vector
    scores zero with the others. Repeated rows are candidates of their own and queries of their own; rows that share
    the query's id count as its own. Components of any size are exact, and so are the ranks; a score that no long
    holds is returned as the nearest one. No queries or an empty table give no rows; further columns, whatever their
    names, are not read.
    """
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine).withColumn("width", F.size("v"))
    rows = materialise(rows, "vectors")
    cells = F.greatest("width", F.lit(1))
    sizes = rows.groupBy("width").agg(F.count("*").alias("n"), F.count_if("asks").alias("asking")).where("asking > 0")
    most = F.greatest(F.lit(64), F.least(F.ceil(F.col("asking") / LEAST_CHUNKS), F.floor(F.lit(CHUNK_CELLS) / cells)))
    sizes = sizes.select(
        "width",
        F.ceil(F.col("n") / F.greatest(F.lit(64), F.floor(F.lit(BLOCK_CELLS) / cells))).cast("int").alias("blocks"),
        F.ceil(F.col("asking") / most).cast("int").alias("chunks"),
    )
    sizes = materialise(sizes, "sizes")
    pairs = sizes.agg(F.sum(F.col("blocks").cast("long") * F.col("chunks"))).first()[0] or 0
    dealt = rows.join(sizes, "width")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        width, n = int(frame["width"].iloc[0]), len(frame)
        values = quantised(np.array(frame["v"].tolist(), np.float64).reshape(n, width), scale)
        slices, least, _ = slices_of(values) if width else (np.empty((0, 1, 0), np.uint64), [], n)
        ids = frame["vec_id"].to_numpy(np.int64)
        least = [str(x) for x in least]
        return pd.DataFrame({"width": [width], "block": [int(frame["block"].iloc[0])], "n": [n], "bits": [slices.shape[1]], "ids": [ids.tobytes()], "least": [least], "slices": [slices.tobytes()]})

    blocked = dealt.select("width", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), "vec_id", "v")
    index = blocked.groupBy("width", "block").applyInPandas(build, "width int, block int, n int, bits int, ids binary, least array<string>, slices binary")
    asked = dealt.where("asks").withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v"), F.col("chunks")).cast("int"))
    asked = asked.groupBy("width", "chunk", "blocks").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("asked"))
    asked = materialise(asked, "asked").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = index.join(asked, ["width", "block"])
    # a pair of block and chunk is a task's work, however few bytes it has: the number given is kept as it is
    met = met.repartition(max(1, min(3 * pairs, MOST_TASKS)), "width", "block", "chunk")
    met = met.select("width", "n", "bits", "ids", "least", "slices", "asked", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                width, n, bits, ids, least, slices = (batch.column(i)[r].as_py() for i in range(6))
                asked = batch.column(6)[r].as_py()
                weights = quantised(np.array([a["v"] for a in asked], np.float64).reshape(len(asked), width), scale)
                of = [(a["vec_id"], w.tolist()) for a, w in zip(asked, weights)]
                index = np.frombuffer(slices, np.uint64).reshape(width, bits, -1) if width else np.empty((0, 1, 0), np.uint64)
                found = list(search_block(np.frombuffer(ids, np.int64), (index, [int(x) for x in least], n), of, k))
                at = np.array([f[0] for f in found], np.int64)
                own = np.array([a["vec_id"] for a in asked], np.int64)[at]
                scores = [f[2] for f in found]
                columns = [own, np.full(len(at), width), np.full(len(at), batch.column(7)[r].as_py()), at, np.array([f[1] for f in found], np.int64)]
                columns = [pa.array(c, pa.int64()) for c in columns]
                columns += [pa.array([max(-_MOST, min(_MOST, s)) for s in scores], pa.int64()), pa.array([_order(s) for s in scores], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "width", "chunk", "nth", "vec_id", "score", "beyond"])

    best = met.mapInArrow(run, "query_id long, width long, chunk long, nth long, vec_id long, score long, beyond binary")
    by = Window.partitionBy("query_id", "width", "chunk", "nth").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20, scale=64)
