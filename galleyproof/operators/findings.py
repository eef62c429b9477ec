"""Operators on the findings table: order, adjacent dedupe, rules, counts, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galleyproof import dims


def ordered(findings: DataFrame) -> DataFrame:
    """Severity from above, file, line; ties keep emission order, which ``seq`` holds."""
    return findings.orderBy(F.desc("severity"), "file", "line", "seq")


def dedupe_adjacent(findings: DataFrame) -> DataFrame:
    """Drop a row that equals the one before it, in findings order, on analyzer, file, line and message, whatever their severities.

    Windowed by (severity, file, line), so no global order is needed for it; the first row of a severity is compared with the last of
    the one above, a row or two for each severity.
    """
    order = W.partitionBy("severity", "file", "line").orderBy("seq")
    same = F.struct("analyzer_id", "message")
    marked = findings.withColumn("before", F.lag(same).over(order))
    key, whole = F.struct("file", "line", "seq"), F.struct("analyzer_id", "file", "line", "message")
    ends = findings.groupBy("severity").agg(F.min_by(whole, key).alias("first"), F.max_by(whole, key).alias("last"))
    above = ends.withColumn("above", F.lag("last").over(W.orderBy(F.desc("severity")))).filter("first = above")
    again = F.broadcast(above.select("severity", F.col("first.file").alias("file"), F.col("first.line").alias("line"), F.lit(True).alias("again")))
    kept = marked.filter(~F.col("before").eqNullSafe(same)).join(again, ["severity", "file", "line"], "left")
    return kept.filter("again is null or before is not null").select(*findings.columns)


def inject_rules(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Fill rule_id and rule_summary from the analyzer's rule; values that are there stay. ``rules``: id, summary."""
    spark = findings.sparkSession
    mapped = findings.join(F.broadcast(dims.rule_names(spark)), "analyzer_id", "left")
    lint = F.when(F.col("analyzer_id").startswith("golangci-lint/"), "code-smells")
    found = F.coalesce(F.nullif("rule_id", F.lit("")), "mapped_rule", lint, F.lit(""))
    out = mapped.withColumn("rule_id", found).drop("mapped_rule")
    known = F.broadcast(rules.select(F.col("id").alias("rule_id"), F.col("summary")))
    return out.join(known, "rule_id", "left").withColumn("rule_summary", F.coalesce(F.nullif("rule_summary", F.lit("")), "summary", F.lit(""))).drop("summary")


def severity_override(findings: DataFrame, config: DataFrame) -> DataFrame:
    """Severity replaced where the analyzer's own parameters name one. ``config``: analyzer_id, severity_param."""
    from galleyproof.functions.text import param_severity

    out = findings.join(F.broadcast(config), "analyzer_id", "left")
    return out.withColumn("severity", param_severity(F.col("severity_param"), F.col("severity"))).drop("severity_param")


def severity_counts(findings: DataFrame) -> DataFrame:
    """errors, warnings, infos, exit_code."""
    count = lambda k: F.count_if(F.col("severity") == k)
    counted = findings.agg(count(dims.ERROR).alias("errors"), count(dims.WARNING).alias("warnings"), count(dims.INFO).alias("infos"))
    return counted.withColumn("exit_code", F.when(F.col("errors") > 0, 1).otherwise(0))


def formatted(findings: DataFrame) -> DataFrame:
    """``text``: [SEV] id: message (file:line), then the suggestion and the rule's first sentence on lines of their own."""
    from galleyproof.functions.text import first_sentence

    label = F.when(F.col("severity") == dims.ERROR, "ERROR").when(F.col("severity") == dims.WARNING, "WARNING").otherwise("INFO")
    place = F.when(F.col("file") == "", "").when(F.col("line") == 0, F.concat(F.lit(" ("), "file", F.lit(")"))).otherwise(F.concat(F.lit(" ("), "file", F.lit(":"), "line", F.lit(")")))
    head = F.concat(F.lit("["), label, F.lit("] "), "analyzer_id", F.lit(": "), "message", place)
    tip = F.when(F.col("suggestion") != "", F.concat(F.lit("\n  \u2192 "), "suggestion")).otherwise("")
    rule = F.when(F.col("rule_summary") != "", F.concat(F.lit("\n  rule: "), first_sentence(F.col("rule_summary")))).otherwise("")
    return findings.withColumn("text", F.concat(head, tip, rule))
