"""Patterns on the JVM as RE2 reads them: a letter beyond ASCII ends a word."""

import re

import pytest
from pyspark.sql import functions as F

from millrace.functions.rules import as_re2
from millrace.operators.diffs import _indexed, _searched

TEXTS = ["zu denü", "üzu den", "zu den", "xzu den", "zu den zu denä zu den"]
COUNTS = [1, 1, 1, 0, 3]


@pytest.mark.parametrize("pattern, texts", [(r"(?i)\bzu\s+den\b", TEXTS), (r"\\b", [r"a\b c"]), (r"\Bn\b", ["den n", "denü"]), (r"\\\bx", [r"\x", r"\ü"])])
def test_word_boundaries(spark, duck, pattern, texts):
    rows = spark.createDataFrame([(t, pattern) for t in texts], "t string, p string")
    got = rows.select("t", F.regexp_count("t", as_re2(F.col("p"))).alias("a"), F.regexp_count("t", F.lit(as_re2(pattern))).alias("b")).collect()
    for r in got:
        (want,) = duck.execute("SELECT len(regexp_extract_all(?, ?))", [r["t"], pattern]).fetchone()
        assert r["a"] == r["b"] == want == len(re.findall(pattern, r["t"], re.ASCII))


def test_users_rules_on_words_beside_other_letters(spark):
    files = spark.createDataFrame([("r", str(i), t) for i, t in enumerate(TEXTS)], "repo string, path string, content string")
    rule = [(1, "n", r"(?i)\bzu\s+den\b", "low")]
    schema = "user_id int, name string, pattern string, severity string"
    want = {str(i): n for i, n in enumerate(COUNTS) if n}
    rules = spark.createDataFrame(rule, schema)
    assert {r["path"]: r["n"] for r in _indexed(rules, files).collect()} == want
    assert {r["path"]: r["n"] for r in _searched(rules.collect(), files).collect()} == want
