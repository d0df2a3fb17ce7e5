"""Secret scans by multipart credential linking, in DataFrame functions only.

Every text is split at the matches of each pattern, which gives their places as running sums of piece lengths.
Spans of the base kinds (assign, access, hex) always stand. Weaker parts - identifiers, short secrets, endpoints -
are reported only where complementary parts lie within ``SCOPE`` code points. That interval join runs on bins as
wide as the scope, each reduced to its first and last part of a role: a part's neighbours are then within three
bins, and the first and last decide exactly whether any is near enough, so no pair list grows within a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.storage import free, materialise

SCOPE = 300

# The base patterns and the least length of group 2, or of the match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA)([A-Z0-9]+)"
HEX = r"()([0-9a-f]{16,})"
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
#: A short assignment is a weak part from this length on.
WEAK_LEAST = 6
# Own patterns of the weaker parts; group 2 is the value.
WEAK = r"""(?i:\b(pass|passphrase|pwd|auth|credentials?))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})"""
IDENTIFIER = r"""(?i:\b(user|username|user_name|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})"""
ENDPOINT = r"""(?i:\b(https?|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp|ssh|ftp))(://[^\s"'<>]+)"""

#: Order of kinds at the same start, and each kind's role in a credential.
KINDS = ["assign", "access", "hex", "weak", "identifier", "endpoint"]
ROLES = {"assign": "secret", "hex": "secret", "weak": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "weak": WEAK, "identifier": IDENTIFIER, "endpoint": ENDPOINT}


def _any_of(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _worth(kind: str, text: Column, low: Column) -> Column:
    """A cheap test that texts without a match of the kind rarely pass, and texts with one always."""
    assigns = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    return {
        "assign": assigns & _any_of(low, ["password", "passwd", "secret", "token", "apikey", "api_key"]),
        "access": F.contains(text, F.lit("AKIA")),
        "hex": text.rlike("[0-9a-f]{16}"),
        "weak": assigns & _any_of(low, ["pass", "pwd", "auth", "credential"]),
        "identifier": assigns & _any_of(low, ["user", "login", "account", "client", "access"]),
        "endpoint": F.contains(text, F.lit("://")),
    }[kind]


def _found(kind: str, text: Column, low: Column) -> Column:
    """All matches of a kind in a text: (kind, place in the row of matches, code points before it since the last
    one, its length, the length of its value)."""
    pattern = PATTERNS[kind]
    before = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    value = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda x: F.length(x))
    at = F.transform(whole, lambda x, i: i)
    zipped = F.arrays_zip(at.alias("at"), before.alias("before"), whole.alias("whole"), value.alias("value"))
    some = F.filter(zipped, lambda z: z["whole"].isNotNull())  # the piece after the last match has none
    rows = F.transform(
        some,
        lambda z: F.struct(F.lit(kind).alias("kind"), z["at"].alias("at"), z["before"].alias("before"), z["whole"].alias("whole"), z["value"].alias("value")),
    )
    return F.when(_worth(kind, text, low), rows).otherwise(F.array().cast("array<struct<kind:string,at:int,before:int,whole:int,value:int>>"))


def _parts(docs: DataFrame, *carried: str) -> DataFrame:
    """``(rid, doc_id, ..., kind, start, end)``: a row per match, and one with a null kind for a text without any.

    ``rid`` stands for the input row, so that repeated ids stay apart; it is fixed as the table is written once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = ["rid", "doc_id", *carried]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *carried, text.alias("text"))
    rows = rows.select(*own, "text", F.lower("text").alias("low"))
    found = F.concat(*[_found(k, F.col("text"), F.col("low")) for k in KINDS])
    flat = rows.select(*own, F.explode_outer(found).alias("m")).select(*own, "m.*")
    running = F.expr("sum(before + whole) over (partition by rid, kind order by at)")
    placed = flat.withColumn("end", running).withColumn("start", F.col("end") - F.col("whole"))
    length = F.when(F.col("kind") == "assign", F.col("value")).otherwise(F.col("whole"))
    kind = (
        F.when(F.col("kind") == "assign", F.when(length >= ASSIGN_LEAST, "assign").when(length >= WEAK_LEAST, "weak"))
        .when(F.col("kind") == "access", F.when(length >= ACCESS_LEAST, "access"))
        .otherwise(F.col("kind"))
    )
    return placed.select(*own, kind.alias("kind"), "start", "end")


def _linked(parts: DataFrame) -> DataFrame:
    """The weaker parts near complementary ones."""
    role = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[F.col("kind")]
    known = parts.where("kind is not null").withColumn("role", role).withColumn("bin", F.floor(F.col("start") / SCOPE))
    bins = known.groupBy("rid", "bin", "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    asking = known.where(F.col("kind").isin("weak", "identifier", "endpoint"))
    asking = asking.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    met = asking.join(bins.withColumnRenamed("role", "other"), ["rid", "bin"])
    met = met.where((F.col("last") >= F.col("start") - SCOPE) & (F.col("first") <= F.col("start") + SCOPE))
    has = {r: F.bool_or(F.col("other") == r).alias(r) for r in ("secret", "identifier", "endpoint")}
    own = parts.columns
    judged = met.groupBy(*own).agg(has["secret"].alias("s"), has["identifier"].alias("i"), has["endpoint"].alias("e"))
    keep = (
        F.when(F.col("kind") == "weak", F.col("i") | F.col("e"))
        .when(F.col("kind") == "identifier", F.col("s"))
        .otherwise(F.col("s") & F.col("i"))
    )
    return judged.where(keep).select(*own)


def spans(docs: DataFrame, *carried: str) -> DataFrame:
    """``(rid, doc_id, ..., kind, start, end)`` of every reported span, and one row with a null kind per input row.

    Places are code points, the end exclusive. Null texts count as empty, long ones are scanned whole; repeated rows and
    ids stay apart by rid; parts at the same place are all kept. An empty table gives no rows; further columns of
    ``docs``, whatever their names, are not read.
    ``carried``: further columns of ``docs`` to keep.
    """
    parts = materialise(_parts(docs, *carried), "parts")
    base = parts.where(F.col("kind").isin("assign", "access", "hex"))
    every = parts.groupBy("rid", "doc_id", *carried).agg(F.max("kind").alias("kind"))
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("kind", "string"), ("start", "long"), ("end", "long"))]
    return every.select("rid", "doc_id", *carried, *nothing).union(base).union(_linked(parts))


def _joined(kinds: list[str]) -> Column:
    """kind:start:end of the given kinds by start, then kind as listed."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])[F.col("kind")]
    row = F.when(F.col("kind").isin(*kinds), F.struct("start", order.alias("nth"), "kind", "end"))
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(F.sort_array(F.collect_list(row)), line), ",")


def report(docs: DataFrame) -> DataFrame:
    """A row per input row: counts of the base kinds, the digest of their spans, and all spans."""
    n = {k: F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("assign", "access", "hex")}
    base = _joined(["assign", "access", "hex"])
    found = spans(docs).groupBy("rid").agg(F.first("doc_id").alias("doc_id"), *n.values(), F.sha2(base, 256).alias("base_sha256"), _joined(KINDS).alias("spans"))
    return found.drop("rid")


#: Pieces of a text that are cut from one part of it: a cut from the whole walks the text from its start.
_TOGETHER = 64


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs``, columns unchanged, with each reported secret replaced by ``mark`` and n_chars, if there, set anew.

    Overlapping spans are replaced together. Spans go back to their rows by id and text, so repeated ids with other
    texts keep theirs, and repeated rows are treated alike; identifiers and endpoints stay, as do null and empty texts.
    An empty table stays empty; further columns pass through, whatever their names.
    """
    of, key, own, cuts_in, tail = (free(n, docs.columns) for n in ("__text", "__id", "__of", "__cuts", "__tail"))
    name = F.xxhash64(F.col("text").cast("string"))
    marked = docs.withColumn(of, name)
    hidden = spans(docs.select("doc_id", "text", name.alias("__text")), "__text")
    hidden = hidden.where(F.col("kind").isin("assign", "access", "hex", "weak"))
    before = F.expr("coalesce(max(`end`) over (partition by doc_id, __text order by start, `end` rows between unbounded preceding and 1 preceding), 0)")
    cuts = hidden.select(F.col("doc_id").alias(key), F.col("__text").alias(own), before.alias("from"), "start", "end").where("`end` > `from`")
    piece = F.when(F.col("start") >= F.col("from"), F.struct(F.col("from").cast("int").alias("from"), F.col("start").cast("int").alias("to")))
    wide = cuts.groupBy(key, own).agg(F.sort_array(F.collect_list(piece)).alias(cuts_in), F.max("end").cast("int").alias(tail))
    joined = marked.join(wide, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(of) == F.col(own)), "left")
    text = F.col("text").cast("string")

    def part(nth: Column) -> Column:
        those = F.slice(cuts_in, nth * _TOGETHER + 1, _TOGETHER)
        first = F.element_at(those, 1)["from"]
        return F.struct(those.alias("cuts"), first.alias("first"), F.substr(text, first + 1, F.element_at(those, -1)["to"] - first).alias("text"))

    def cut(whole: Column) -> Column:
        pieces = F.transform(whole["cuts"], lambda c: F.concat(F.substr(whole["text"], c["from"] - whole["first"] + 1, c["to"] - c["from"]), F.lit(mark)))
        return F.array_join(pieces, "")

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(cuts_in) - 1) / _TOGETHER).cast("int")), part)
    clean = F.concat(F.array_join(F.transform(parts, cut), ""), F.substr(text, F.col(tail) + 1))
    done = joined.withColumn("text", F.when(F.col(cuts_in).isNull(), text).otherwise(clean))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
