"""Turns of a session: what each hook event shows, from the session's gates and the tables of the project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galleyproof.operators.hooks import sessions

# The event each mode answers; modes without one are silent.
EVENT_OF_MODE = {
    "session-start": "SessionStart", "pre-edit": "PreToolUse", "post-edit": "PostToolUse", "pre-search": "PreToolUse", "user-prompt": "UserPromptSubmit", "stop": "Stop",
    "subagent-start": "SubagentStart", "subagent-stop": "", "session-end": "",
}
# Events wired to modes, with the tools that they match.
REGISTRATIONS = (
    ("SessionStart", "", "session-start"), ("PreToolUse", "Write|Edit|MultiEdit", "pre-edit"), ("PreToolUse", "Grep|Glob|Bash", "pre-search"),
    ("PostToolUse", "Write|Edit|MultiEdit", "post-edit"), ("UserPromptSubmit", "", "user-prompt"), ("SubagentStart", "", "subagent-start"), ("Stop", "", "stop"), ("SessionEnd", "", "session-end"),
)
# What to check for each kind of changed file, in order.
CHECKLIST = (
    (".go", "gofmt -l clean; go vet ./... and go test -race ./... green"), (".go", "no package docstrings; no doc comments on unexported symbols"),
    (".sql", "migrations reversible and reviewed; no raw SQL in handlers"), (".yaml", "validate passes"), (".md", "every Markdown file ends with a trailing newline"),
)


def dispatch(events: DataFrame) -> DataFrame:
    """``event`` that a mode answers, empty where it is silent; unknown modes are silent too and never fail."""
    known = F.create_map(*(F.lit(x) for pair in EVENT_OF_MODE.items() for x in pair))
    return events.withColumn("event", F.coalesce(F.try_element_at(known, F.col("mode")), F.lit("")))


def grouped_registrations(rows: DataFrame) -> DataFrame:
    """event, place, registrations: rows (ord, event, matcher, mode) by event, events in order of first sight."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "matcher", "mode")))
    groups = rows.groupBy("event").agg(F.min("ord").alias("first"), listed.alias("registrations"))
    # eight events: one small group
    return groups.select("event", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("first")).alias("place"), F.transform("registrations", lambda r: F.struct(r["matcher"].alias("matcher"), r["mode"].alias("mode"))).alias("registrations"))


def extensions(changes: DataFrame) -> DataFrame:
    """Distinct extensions of each repository's changes, sorted."""
    return changes.groupBy("repo").agg(F.array_sort(F.collect_set("ext")).alias("exts"))


def checklist(changes: DataFrame) -> DataFrame:
    """repo, text: points for the kinds of changed files, in fixed order; repositories without any have no row."""
    points = changes.sparkSession.createDataFrame([(k, e, t) for k, (e, t) in enumerate(CHECKLIST)], "k int, ext string, point string")
    hit = changes.select("repo", "ext").distinct().join(F.broadcast(points), "ext")
    once = hit.groupBy("repo", "point").agg(F.min("k").alias("k"))
    listed = F.array_sort(F.collect_list(F.struct("k", F.concat(F.lit("  - "), "point").alias("line"))))
    return once.groupBy("repo").agg(F.array_join(F.transform(listed, lambda s: s["line"]), "\n").alias("text"))


def gated(events: DataFrame, key: str, content: str, always: Column | None = None) -> DataFrame:
    """Events whose content differs from the last one of their session epoch and key, and those that ``always`` says."""
    order = W.partitionBy("session_id", "epoch", key).orderBy("seq")
    digest = F.sha2(F.col(content), 256)
    new = ~F.lag(digest).over(order).eqNullSafe(digest)
    rows = sessions(events).filter((F.col("mode") != "session-end") & F.col(content).isNotNull()).withColumn("new", new)
    return rows.filter(F.col("new") if always is None else F.col("new") | always).drop("new")


def stop_reports(events: DataFrame, reports: DataFrame, heading: str) -> DataFrame:
    """session_id, seq, text of the stops that say something.

    reports: session_id, seq, block (findings), points (checklist), status; a clean tree (no status) or no findings is silent, and so is
    a text the session has just been shown.
    """
    shown = F.when((F.coalesce("status", F.lit("")) != "") & (F.coalesce("block", F.lit("")) != ""), F.concat(
        F.lit(heading), F.lit("\n"), "block", F.when(F.coalesce("points", F.lit("")) == "", "").otherwise(F.concat(F.lit("\n"), "points")), F.lit("\n\nUncommitted changes:\n"), "status",
    ))
    rows = events.join(reports, ["session_id", "seq"], "left").withColumn("text", shown)
    # ends of sessions stay in: they open a new epoch
    rows = rows.filter(F.col("mode").isin("stop", "session-end"))
    return gated(rows, "mode", "text").select("session_id", "seq", "text")


def edit_checklist(path: Column, skills: Column) -> Column:
    """Text after an edit: skills to load, the point for Go files, the closing check."""
    name = F.element_at(F.split(path, "/"), -1)
    loads = F.array_join(F.transform(skills, lambda s: F.concat(F.lit("  - load skill `"), s, F.lit("` and run its Validation checklist\n"))), "")
    go = F.when(F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)) == ".go", "  - no package docstrings; no doc comments on unexported symbols\n").otherwise("")
    return F.concat(F.lit("Post-edit checklist for "), name, F.lit(":\n"), loads, go, F.lit("Then verify: go build ./... && go test -race ./..."))


def post_edits(events: DataFrame, fallback: str) -> DataFrame:
    """session_id, seq, text of edits (file_path, routed, installed arrays of skills, notice of a cleaned file).

    No routed skill: the notice alone, if any. None of them installed: the fixed text, at every edit, without the notice. Else the
    checklist, when it is new to the session or there is a notice, which then stands first.
    """
    kept = F.array_intersect("routed", "installed")
    notice = F.coalesce("notice", F.lit(""))
    shape = F.when(F.size("routed") == 0, F.when(notice != "", "notice")).when(F.size(kept) == 0, "fixed").otherwise("list")
    rows = events.filter(F.col("mode").isin("post-edit", "session-end")).withColumns({"notice": notice, "shape": shape})
    rows = rows.withColumn("body", F.when(F.col("shape") == "notice", F.col("notice")).when(F.col("shape") == "fixed", F.lit(fallback)).when(F.col("shape") == "list", edit_checklist(F.col("file_path"), kept)))
    shown = gated(rows, "shape", "body", (F.col("shape") != "list") | (F.col("notice") != ""))
    both = (F.col("shape") == "list") & (F.col("notice") != "")
    return shown.select("session_id", "seq", F.when(both, F.concat("notice", F.lit("\n\n"), "body")).otherwise(F.col("body")).alias("text"))


def clean_notice(acted: DataFrame, by: str = "The cleaner") -> DataFrame:
    """path, text of cleaned files from the marks acted on (path, line, byte_offset, code_point, mark_class, mark_name)."""
    verb = F.when(F.col("mark_class") == 1, "replaced with a space").otherwise("removed")
    line = F.concat(F.lit("  line "), F.col("line").cast("string"), F.lit("  U+"), F.format_string("%04X", "code_point"), F.lit(" "), "mark_name", F.lit(" ("), verb, F.lit(")\n"))
    listed = F.array_sort(F.collect_list(F.struct("line", "byte_offset", line.alias("text"))))
    body = F.array_join(F.transform(listed, lambda s: s["text"]), "")
    head = F.concat(F.lit(f"{by} removed "), F.count("*").cast("string"), F.lit(" invisible marker(s) from "), "path", F.lit(":\n"))
    return acted.groupBy("path").agg(F.concat(head, body, F.lit("The file on disk changed AFTER your write. Re-read it before your next edit.")).alias("text"))


def drift(embedded: DataFrame, on_disk: DataFrame) -> DataFrame:
    """project, state of knowledge trees (project, fingerprint): ``drift`` where both are and differ, ``unverifiable`` where one's hash is null."""
    both = on_disk.select("project", F.col("fingerprint").alias("b")).join(embedded.select("project", F.col("fingerprint").alias("a")), "project", "left")
    state = F.when(F.col("a").isNull() | F.col("b").isNull(), "unverifiable").when(F.col("a") != F.col("b"), "drift")
    return both.select("project", state.alias("state")).filter("state is not null")


def telemetry(runs: DataFrame) -> DataFrame:
    """One record a dispatch (mode, session_id, started_ms, ended_ms, findings, error) as event, session_id, duration_ms, findings, ok, error."""
    return runs.select(
        F.col("mode").alias("event"), F.coalesce(F.nullif("session_id", F.lit("")), F.lit("nosession")).alias("session_id"), (F.col("ended_ms") - F.col("started_ms")).alias("duration_ms"),
        F.coalesce(F.col("findings").cast("long"), F.lit(0)).alias("findings"), F.col("error").isNull().alias("ok"), F.col("error"),
    )
