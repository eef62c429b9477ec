"""Hook events: session gates in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAYLOAD = "struct<session_id:string,tool_name:string,tool_input:struct<file_path:string,pattern:string,glob:string,path:string,command:string>>"


def payload(rows: DataFrame, column: str = "json") -> DataFrame:
    """session_id, tool_name and tool_input's fields; malformed or absent parts are empty."""
    p = F.from_json(column, PAYLOAD)
    blank = lambda c: F.coalesce(c, F.lit(""))
    fields = {f: blank(p["tool_input"][f]) for f in ("file_path", "pattern", "glob", "path", "command")}
    return rows.withColumns({"session_id": blank(p["session_id"]), "tool_name": blank(p["tool_name"]), **fields})


def response(event, context) -> F.Column:
    return F.to_json(F.struct(F.struct(event.alias("hookEventName"), context.alias("additionalContext")).alias("hookSpecificOutput")))


def sessions(events: DataFrame) -> DataFrame:
    """Default session name, and the epoch of a session: ended sessions start anew."""
    named = events.withColumn("session_id", F.coalesce(F.nullif("session_id", F.lit("")), F.lit("nosession")))
    before = W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return named.withColumn("epoch", F.coalesce(F.count_if(F.col("mode") == "session-end").over(before), F.lit(0)))


def once_per_session(events: DataFrame, *key: str) -> DataFrame:
    """First event of each session epoch and key (the mode by default)."""
    order = W.partitionBy("session_id", "epoch", *(key or ("mode",))).orderBy("seq")
    return sessions(events).filter(F.col("mode") != "session-end").withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def first_emission(events: DataFrame) -> DataFrame:
    """``emitted``: whether an event's content differs from the last one of its session epoch and mode."""
    order = W.partitionBy("session_id", "epoch", "mode").orderBy("seq")
    digest = F.sha2("content", 256)
    rows = sessions(events).filter(F.col("mode") != "session-end")
    return rows.withColumn("emitted", ~F.lag(digest).over(order).eqNullSafe(digest))


def per_file_gate(events: DataFrame, path: str = "file_path") -> DataFrame:
    return once_per_session(events.withColumn("gate", F.concat(F.lit("pre-edit-file-"), F.substring(F.sha2(path, 256), 1, 32))), "gate")


def searches_source(rows: DataFrame) -> DataFrame:
    """``searches``: whether a tool call looks at Go files."""
    names = F.exists(F.array("pattern", "glob", "path"), lambda x: F.lower(x).contains(".go"))
    head = F.regexp_extract("command", r"^\s*(?:\S*/)?([^\s/]+)(?:\s|$)", 1)
    return rows.withColumn("searches", names | ((F.col("tool_name") == "Bash") & head.isin("grep", "rg", "ag", "find")))


def tail_by_bytes(log: DataFrame, cap: int) -> DataFrame:
    """Keep the end of a log (name, seq, line) larger than ``cap``: lines that start behind the last half of ``cap``.

    Without a line break in that half everything stays; a log at or under the cap is left alone.
    """
    back = W.partitionBy("name").orderBy(F.desc("seq"))
    size = F.octet_length("line") + 1
    rows = log.withColumns({"bytes": F.sum(size).over(back.rowsBetween(W.unboundedPreceding, 0)), "total": F.sum(size).over(W.partitionBy("name"))})
    rows = rows.withColumn("inside", F.col("bytes") < cap // 2)
    # a half without a line's start, but with a line's end before it, is left whole
    rows = rows.withColumn("some", F.max(F.col("bytes") - size < cap // 2).over(W.partitionBy("name")))
    return rows.filter((F.col("total") <= cap) | F.col("inside") | ~F.col("some")).drop("bytes", "total", "inside", "some")


def carry_headers(rows: DataFrame) -> DataFrame:
    """Group header lines carried forward to the lines below them; header and other comment lines drop. (name, line_no, line)."""
    head = F.nullif(F.regexp_extract("line", r"^# group: (.*)$", 1), F.lit(""))
    order = W.partitionBy("name").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("grp", F.last(head, ignorenulls=True).over(order)).filter(~F.col("line").startswith("#"))
