"""URL filters: host and path rules, then association rules mined by FP-growth, in DataFrame functions only.

A page that a host rule fits is judged by it, and is a labelled example: its URL's tokens and its verdict are one
transaction. FP-growth counts the frequent token combinations with and without a verdict; a combination is a rule
where enough examples hold it (support) and enough of those share the verdict (confidence). Every other page is
matched through the rules' inverted index, token to rule: a rule fits where all its tokens are met, the most
confident one wins. No rule fits: allow.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.storage import materialise

# The rules, longest match wins.
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
#: Least share of the examples, and least share of those that agree. A URL has at most seven tokens, so there are at
#: most 127 / MIN_SUPPORT frequent combinations, whatever the number of pages: the rules' broadcast is bounded.
MIN_SUPPORT, MIN_CONFIDENCE = 0.02, 0.9


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null. The rules are a fixed list."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        site, slash, rest = rule.partition("/")
        fits = ((host == site) | F.endswith(host, F.lit("." + site))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """At most seven: top domain, last two parts of the host, its first part, first folder of the path, the path's
    extension, first name of the query, scheme."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    parts = F.split(host, r"\.")
    query = F.regexp_extract(whole, r"(?s)^[^#]*?\?([^=&#]+)", 1)
    found = F.array(
        F.concat(F.lit("top="), F.element_at(parts, -1)),
        F.concat(F.lit("site="), F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), 2), ".")),
        F.concat(F.lit("first="), F.element_at(parts, 1)),
        F.concat(F.lit("folder="), F.regexp_extract(path, r"(?s)^/([^/]*)/", 1)),
        F.concat(F.lit("type="), F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)),
        F.concat(F.lit("query="), query),
        F.concat(F.lit("scheme="), F.lower(F.regexp_extract(whole, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
    )
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: ~t.rlike("^[a-z]+=$"))))


def mined(examples: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``(tokens, verdict, n_both, n_tokens)`` of every rule, from ``examples(tokens, verdict)``."""
    schema = "tokens array<string>, verdict string, n_both long, n_tokens long"
    if examples.isEmpty():
        return examples.sparkSession.createDataFrame([], schema)
    items = examples.select(F.array_append("tokens", F.concat(F.lit("verdict="), "verdict")).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=support, minConfidence=0.0).fit(items).freqItemsets
    verdict = lambda t: F.startswith(t, F.lit("verdict="))
    split = sets.select(
        F.array_sort(F.filter("items", lambda t: ~verdict(t))).alias("tokens"),
        F.try_element_at(F.filter("items", verdict), F.lit(1)).alias("verdict"),
        F.col("freq").alias("n"),
    )
    split = materialise(split, "itemsets")
    both = split.where("verdict is not null and size(tokens) > 0").withColumnRenamed("n", "n_both")
    alone = split.where("verdict is null").select("tokens", F.col("n").alias("n_tokens"))
    rules = both.join(alone, "tokens").where(F.col("n_both") / F.col("n_tokens") >= confidence)
    return rules.select("tokens", F.substr("verdict", F.lit(9)).alias("verdict"), "n_both", "n_tokens")


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, a row per input row.

    A null url, or one without ``://``, has an empty host and path; it fits no host rule, and its tokens are few or
    none. No example, or no rule that fits, leaves the verdict at allow. Repeated rows each keep their row. Of host rules
    the longest wins; of mined ones the most confident, then the one with more examples, more tokens, and the last name.
    Long urls are read whole; an empty table gives no rows; further columns, whatever their names, are not read.
    """
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "url")
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for rule in rules for x in rule])
    rows = rows.withColumn("base", F.when(F.col("rule").isNotNull(), verdicts[F.col("rule")]))
    rows = rows.withColumn("tokens", tokens_of(url, F.col("host"), F.col("path"))).drop("url")
    learnt = mined(rows.where("base is not null").select("tokens", F.col("base").alias("verdict")), support, confidence)
    learnt = materialise(learnt.withColumn("name", F.array_join("tokens", " ")), "rules")
    postings = learnt.select(F.explode("tokens").alias("token"), "name", F.size("tokens").alias("size"), "verdict", "n_both", "n_tokens")
    # what the method decides depends on the tokens alone: it is worked out once for each set of tokens
    open_sets = rows.where("base is null").select("tokens").distinct()
    met = open_sets.select("tokens", F.explode("tokens").alias("token")).join(F.broadcast(postings), "token")
    fits = met.groupBy("tokens", "name", "verdict", "size", "n_both", "n_tokens").count().where("count = size")
    rank = F.struct(F.col("n_both") / F.col("n_tokens"), "n_both", "size", "name")
    best = fits.groupBy("tokens").agg(F.max_by("verdict", rank).alias("mined"))
    # written first, so that a very common set of tokens is a skewed join that adaptive execution splits
    out = rows.join(materialise(best, "verdicts"), "tokens", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("base", "mined", F.lit("allow")).alias("verdict"))


def op7_urls(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
