"""License scans by diagonal voting, in DataFrame functions only.

Every run of k words of a text is hashed and joined to the places of the same runs in the templates: k is three for the
licences' notices and two for the phrases, the shortest of which has two words. A hit votes for a diagonal, its place in
the text less its place in the template. Diagonals within ``GAP`` of each other are merged to a span, and a span is
verified: it must cover enough of its template's runs, in the template's order, and not be much longer than it. The words
themselves are compared along with the hashes, and only hits are shuffled: the template table is a fixed value of this
module, so its broadcast has a fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.storage import materialise

# The phrases asked for, found only as they stand, then public licences' own wording.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this work is licensed under a creative commons attribution international license", "cc-by"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
#: A notice stands if its span covers this share of its runs, as many of them in order, and is at most so many times as
#: long; diagonals this close are one span.
COVER, LONGEST, GAP = 0.6, 1.5, 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates() -> list[tuple[int, str, int, int, str, str, str | None, int, int]]:
    """(template, label, exact, place, first, second and third word of the run, runs and words of the template)."""
    rows = []
    for t, (phrase, label) in enumerate(PHRASES + NOTICES):
        words = phrase.split()
        exact = int(t < len(PHRASES))
        thirds = [None] * len(words) if exact else words[2:]
        runs = list(zip(words, words[1:], thirds))
        rows += [(t, label, exact, i, *run, len(runs), len(words)) for i, run in enumerate(runs)]
    return rows


def words_of(text: Column) -> Column:
    """A-Z are folded by lower(); that it folds other letters too changes no word's bounds, and turns no other
    word into one of the phrases'."""
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


_TEMPLATE = "t int, label string, exact int, place int, a string, b string, c string, runs int, length int"
_HIT = ("t", "label", "exact", "place", "runs", "length")


def _votes(docs: DataFrame) -> DataFrame:
    """``(rid, doc_id, n_words, at, template columns)``: a row per hit, and the first word's row of each text."""
    table = docs.sparkSession.createDataFrame(templates(), _TEMPLATE)
    table = table.withColumn("h", F.when(F.col("c").isNull(), F.xxhash64("a", "b")).otherwise(F.xxhash64("a", "b", "c")))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words_of(F.col("text")).alias("w"))
    runs = F.arrays_zip(F.col("w").alias("x"), F.expr("slice(w, 2, size(w))").alias("y"), F.expr("slice(w, 3, size(w))").alias("z"))
    flat = rows.select("rid", "doc_id", F.size("w").cast("long").alias("n_words"), F.posexplode_outer(runs).alias("at", "run"))
    flat = flat.select("rid", "doc_id", "n_words", "at", "run.*")
    both = F.array(F.when(F.col("y").isNotNull(), F.xxhash64("x", "y")), F.when(F.col("z").isNotNull(), F.xxhash64("x", "y", "z")))
    met = flat.select("*", F.posexplode(both).alias("k", "h")).join(F.broadcast(table), "h", "left")
    sure = (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")) & (F.col("c").isNull() | (F.col("c") == F.col("z")))
    sure = F.coalesce(sure, F.lit(False))
    met = met.where(sure | (F.col("k") == 0) & (F.coalesce("at", F.lit(0)) == 0))
    return met.select("rid", "doc_id", "n_words", "at", *[F.when(sure, F.col(c)).alias(c) for c in _HIT])


def found(docs: DataFrame) -> DataFrame:
    """``(rid, doc_id, n_words, label, exact, first, end, score)`` of every span that stands, in words from 0, the
    end exclusive, and one row with a null label per input row."""
    votes = materialise(_votes(docs), "votes")
    own = ["rid", "doc_id", "n_words"]
    every = votes.groupBy(*own).agg(F.max(F.lit(None).cast("string")).alias("label"))
    cast = {"exact": "int", "first": "long", "end": "long", "score": "double"}
    every = every.select("*", *[F.lit(None).cast(k).alias(c) for c, k in cast.items()])
    hits = votes.where("t is not null").withColumn("diagonal", F.col("at") - F.col("place"))
    lines = hits.where("exact = 1").groupBy(*own, "t", "label", "exact", "runs", "diagonal").agg(F.count("*").alias("n"))
    phrase = lines.where("n = runs").select(*own, "label", "exact", F.col("diagonal").cast("long").alias("first"), (F.col("diagonal") + F.col("runs") + 1).cast("long").alias("end"), F.lit(1.0).alias("score"))
    by = Window.partitionBy("rid", "t").orderBy("diagonal", "at")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > GAP).cast("int"), F.lit(0))
    merged = hits.where("exact = 0").withColumn("new", new).withColumn("region", F.sum("new").over(by))
    onward = F.coalesce(F.col("place") > F.lag("place").over(Window.partitionBy("rid", "t", "region").orderBy("at", "place")), F.lit(True))
    spans = merged.withColumn("onward", onward).groupBy(*own, "t", "label", "exact", "runs", "length", "region").agg(
        F.size(F.collect_set("place")).alias("n"),
        F.count_if("onward").alias("in_order"),
        F.min("at").cast("long").alias("first"),
        (F.max("at") + 3).cast("long").alias("end"),
    )
    spans = spans.withColumn("score", F.col("n") / F.col("runs")).where(F.col("score") >= COVER)
    spans = spans.where((F.col("in_order") >= COVER * F.col("runs")) & (F.col("end") - F.col("first") <= LONGEST * F.col("length")))
    return every.union(phrase).union(spans.select(*own, "label", "exact", "first", "end", "score"))


def report(docs: DataFrame) -> DataFrame:
    """A row per input row. Null texts count as empty, long ones are scanned whole; repeated rows and ids stay apart by
    rid. Two templates found at one place both count. An empty table gives no rows; further columns, whatever their
    names, are not read."""
    base = F.col("exact") == 1
    labels = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    out = found(docs).groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        labels(F.when(base, F.col("label"))).alias("base_labels"),
        labels(F.col("label")).alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
    )
    return out.drop("rid")


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
