from pyspark.sql import functions as F

from galleyproof.functions import text as X


def test_trim_space_and_words(spark):
    rows = ["", " ", "\u3000\u00a0 a\u2009b \t\n\u2028", "x", "\u200bx ", None, "the", "a THE.", "other", "the1", "\nx\n\n"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, c string")
    got = df.orderBy("k").select(X.trim_space(F.col("c")).alias("t"), F.regexp_replace("c", r"(?U)^\s+|\s+$", "").alias("want"), X.has_word(F.col("c"), "the").alias("h"), F.array_contains(X.words(F.col("c")), "the").alias("hw"), X.has_word(F.col("c"), "a b").alias("none")).collect()
    assert [r.t for r in got] == [r.want for r in got]
    assert [r.h for r in got] == [r.hw for r in got]
    assert {r.none for r in got} == {False, None}
