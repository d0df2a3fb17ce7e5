"""Order over data of any size: ranks without one task for all rows, and the row before without one task for a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.sources.scratch import written


def numbered(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place from 1 in an order without ties.

    Rows are dealt to ranges of the order and written with their range, since ranges are sampled anew whenever they are
    planned; a place is the rows of all ranges before, of which there are as many counts as partitions, and the place
    within the range.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    placed = dealt.withColumn("__within", within).join(F.broadcast(starts), "__part")
    return placed.withColumn(name, (F.col("__before") + F.col("__within")).cast("long")).drop("__part", "__before", "__within")


def with_before(rows: DataFrame, by: str, order: list[str], take: list[str], unit: str = "hour") -> DataFrame:
    """``rows`` with ``before_c`` for each column c of ``take``: its value in the row before of the same ``by``, null in the
    first one. ``order`` begins with a timestamp.

    A window holds one slice of time of one key, however long the key's history is. The last row of each slice is found
    by an aggregate and goes to the head of the key's next slice that has rows.
    """
    sliced = rows.withColumn("__slice", F.date_trunc(unit, order[0]))
    last = sliced.groupBy(by, "__slice").agg(F.max_by(F.struct(*take), F.struct(*order)).alias("__last"))
    # a row for each slice: the history in slices, not in rows
    follows = Window.partitionBy(by).orderBy("__slice")
    heads = last.withColumn("__last", F.lag("__last").over(follows)).where("__last is not null")
    heads = heads.select(by, "__slice", *[F.col("__last")[c].alias(c) for c in take], F.lit(True).alias("__head"))
    every = sliced.withColumn("__head", F.lit(False)).unionByName(heads, allowMissingColumns=True)
    within = Window.partitionBy(by, "__slice").orderBy(F.desc("__head"), *order)
    told = every.select("*", *[F.lag(c).over(within).alias(f"before_{c}") for c in take])
    return told.where(~F.col("__head")).drop("__head", "__slice")


def first_of(rows: DataFrame, by: str, order: list[str], most: int, deal: int = 64) -> DataFrame:
    """The first ``most`` rows of each key with their ``nth``. Keys are dealt to several windows first, of which few rows stay,
    so no task sorts a key as a whole."""
    dealt = rows.withColumn("__deal", F.pmod(F.xxhash64(*order), F.lit(deal)))
    some = dealt.withColumn("nth", F.row_number().over(Window.partitionBy(by, "__deal").orderBy(*order))).where(F.col("nth") <= most)
    return some.drop("__deal").withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("nth") <= most)
