"""Knowledge-base operators: references, overlays, composition, routing, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galleyproof.functions import text as X


def dangling(holders: DataFrame, ids_col: str, targets: DataFrame, kind: str) -> DataFrame:
    """kind, holder, ord, ref of references (an array column of ``holders``: id) that name no target (id)."""
    refs = holders.select(F.col("id").alias("holder"), F.posexplode(ids_col).alias("ord", "ref"))
    return refs.join(targets.select(F.col("id").alias("ref")), "ref", "left_anti").select(F.lit(kind).alias("kind"), "holder", "ord", "ref")


def without_body(holders: DataFrame, ids_col: str, bodies: DataFrame) -> DataFrame:
    """References whose target (id, body) has no text."""
    return dangling(holders, ids_col, bodies.filter(X.trim_space(F.col("body")) != ""), "body")


def duplicates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of a key from its second on."""
    return rows.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("n > 1").drop("n")


def overlay(base: DataFrame, profile: DataFrame, *columns: str) -> DataFrame:
    """Override lists by id where the profile has one; an empty list counts, null does not."""
    over = F.broadcast(profile.select("id", *(F.col(c).alias(f"new_{c}") for c in columns)))
    return base.join(over, "id", "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in columns}).drop(*(f"new_{c}" for c in columns))


def preset_overlay(config: DataFrame, preset: DataFrame) -> DataFrame:
    """Analyzer entries (analyzer_id, enabled, params): an entry of the preset replaces the whole one; its others are added."""
    a = config.select("analyzer_id", F.struct("enabled", "params").alias("base"))
    b = preset.select("analyzer_id", F.struct("enabled", "params").alias("top"))
    return a.join(b, "analyzer_id", "full").select("analyzer_id", F.coalesce("top", "base").alias("e")).select("analyzer_id", "e.enabled", "e.params")


def default_params(config: DataFrame, defaults: DataFrame) -> DataFrame:
    """Add default parameters (analyzer_id, defaults map) under explicit ones; a new entry is enabled."""
    empty = F.create_map().cast("map<string,string>")
    joined = config.join(defaults, "analyzer_id", "full")
    have, add = F.coalesce("params", empty), F.coalesce("defaults", empty)
    merged = F.map_concat(F.map_filter(add, lambda k, _: ~F.map_contains_key(have, k)), have)
    return joined.select("analyzer_id", F.coalesce("enabled", F.lit(True)).alias("enabled"), merged.alias("params"))


def ordered_distinct(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """First occurrence of each value in its group."""
    return rows.withColumn("n", F.row_number().over(W.partitionBy(group, value).orderBy(order))).filter("n = 1").drop("n")


def transclude(holders: DataFrame, ids_col: str, bodies: DataFrame) -> DataFrame:
    """id, text: the bodies of the composed ids, in order, a blank line between; absent ones are left out."""
    refs = holders.select("id", F.posexplode(ids_col).alias("ord", "ref"))
    joined = refs.join(bodies.select(F.col("id").alias("ref"), "body"), "ref")
    parts = F.array_sort(F.collect_list(F.struct("ord", "body")))
    return joined.groupBy("id").agg(F.array_join(F.transform(parts, lambda p: p["body"]), "\n\n").alias("text"))


def route(files: DataFrame, baseline: DataFrame, triggers: DataFrame, dispatch: DataFrame) -> DataFrame:
    """path, ord, skill: baseline skills for .go, skills whose trigger text has the extension, test-file dispatch; first source wins.

    The look-up tables are small dimension tables and are broadcast.
    """
    base = files.filter("ext = '.go'").crossJoin(F.broadcast(baseline.select("ord", "skill"))).select("path", F.lit(0).alias("src"), "ord", "skill")
    by_text = files.join(F.broadcast(triggers), F.expr("ext <> '' and contains(trigger, ext)")).select("path", F.lit(1).alias("src"), "ord", "skill")
    tests = files.filter(F.col("path").endswith("_test.go")).crossJoin(F.broadcast(dispatch.filter(X.has_word(F.col("signal"), "test")))).select("path", F.lit(2).alias("src"), "ord", "skill")
    rows = base.unionByName(by_text).unionByName(tests)
    return rows.withColumn("n", F.row_number().over(W.partitionBy("path", "skill").orderBy("src", "ord"))).filter("n = 1").drop("n")


def sections(text: Column) -> Column:
    """Defines of a text as an array of (key, body)."""
    found = F.regexp_extract_all(text, F.lit(r'(?s)\{\{\s*define "[^"]*"\s*\}\}.*?\{\{\s*end\s*\}\}'), 0)
    return F.transform(found, lambda s: F.struct(F.regexp_extract(s, r'define "([^"]*)"', 1).alias("key"), F.regexp_extract(s, r"(?s)\}\}(.*)\{\{\s*end", 1).alias("body")))


def clauses(body: Column) -> Column:
    """Lines that state a duty: NEVER, MUST, MANDATORY, or a leading No after a list mark."""
    return F.filter(F.transform(F.split(body, "\n"), X.trim_space), lambda x: x.rlike(r"\b(NEVER|MUST|MANDATORY)\b") | x.rlike(r"^([-*]|[0-9]+\.)?\s*No "))


def grade(scenarios: DataFrame, artifacts: DataFrame) -> DataFrame:
    """scenario, artifact, passed, machine, judge: machine checks of every scenario against every artifact (a small broadcast table).

    ``scenarios``: id, checks array of (kind, type, pattern). Patterns that do not compile are false, and so pass where absence is asked.
    """
    kind, pattern, text = F.col("c.type"), F.col("c.pattern"), F.col("text")
    seen = F.coalesce(F.regexp_like(text, F.when(kind.startswith("regex"), pattern).otherwise(F.lit("x"))), F.lit(False))
    ok = F.when(kind == "contains", text.contains(pattern)).when(kind == "not_contains", ~text.contains(pattern)).when(kind == "regex_match", seen).when(kind == "regex_absent", ~seen).otherwise(False)
    rows = artifacts.crossJoin(F.broadcast(scenarios.select(F.col("id").alias("scenario"), F.explode("checks").alias("c"))))
    machine = F.col("c.kind") == "machine"
    return rows.groupBy("artifact", "scenario").agg(F.count_if(machine & ok).alias("passed"), F.count_if(machine).alias("machine"), F.count_if(~machine).alias("judge"))


def compilable(scenarios: list[dict]) -> list[dict]:
    """Scenario rows with patterns that do not compile replaced by one that never matches; checked on the driver, where the rows come from."""
    import re

    for s in scenarios:
        for c in s["checks"]:
            if c["type"].startswith("regex"):
                try:
                    re.compile(c["pattern"])
                except re.error:
                    c["pattern"] = r"(?!)"
    return scenarios


def scenario_problems(scenarios: DataFrame, skills: DataFrame) -> DataFrame:
    """id, problem: unknown skill, duplicate id, blank prompt or trap, no assertions, kind and check that do not fit."""
    named = scenarios.join(F.broadcast(skills.select(F.col("id").alias("skill"), F.lit(True).alias("known"))), "skill", "left")
    twice = F.row_number().over(W.partitionBy("skill", "id").orderBy("ord")) > 1
    flag = lambda c, name: F.when(c, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    misfit = F.exists("assertions", lambda a: (a["kind"] == "machine") != a["has_check"])
    found = F.concat(
        flag(F.col("known").isNull(), "unknown skill"), flag(F.col("twice"), "duplicate id"), flag(X.trim_space(F.col("prompt")) == "", "blank prompt"),
        flag(X.trim_space(F.col("trap")) == "", "blank trap"), flag(F.size("assertions") == 0, "no assertions"), flag(misfit, "kind and check differ"),
    )
    return named.withColumn("twice", twice).select("skill", "id", "ord", F.explode(found).alias("problem"))


LINT = "struct<Issues:array<struct<FromLinter:string,Text:string,Severity:string,Pos:struct<Filename:string,Line:int>>>>"


def lint_issues(rows: DataFrame, out: str = "stdout") -> DataFrame:
    """Issues of a linter's output (its outermost braces), with severity; those outside the root are counted in one row of their own."""
    body = F.from_json(F.regexp_extract(out, r"(?s)(\{.*\})", 1), LINT)
    issue = rows.select(*rows.columns, F.explode(body["Issues"]).alias("i"))
    file = F.regexp_replace("i.Pos.Filename", r"^(\./)+", "")
    up = F.regexp_replace(file, r"[^/.]+/\.\./", "")
    outside = up.startswith("../")
    severity = F.when(F.lower("i.Severity").contains("error"), 2).otherwise(1)
    return issue.select(*rows.columns, F.concat(F.lit("golangci-lint/"), "i.FromLinter").alias("analyzer_id"), severity.alias("severity"), up.alias("file"), F.col("i.Pos.Line").cast("long").alias("line"), F.col("i.Text").alias("message"), outside.alias("escaped"))


# Linters that the run turns on whatever the configuration says, and exit codes that mean findings.
FORCED_LINTERS = ("nolintlint", "paralleltest", "tparallel", "thelper", "forcetypeassert", "nilerr")
LINT_EXITS = (1, 7)


def lint_findings(runs: DataFrame) -> DataFrame:
    """Findings of linter runs (run, exit_code, stdout, stderr): run, analyzer_id, severity, file, line, message.

    An exit code that does not mean findings, or output without readable JSON, gives one failure row. Issues outside the project are
    not findings but are counted in one row of their own.
    """
    bad = ~F.coalesce(F.col("exit_code"), F.lit(0)).isin(0, *LINT_EXITS)
    body = F.from_json(F.regexp_extract("stdout", r"(?s)(\{.*\})", 1), LINT)
    reason = F.when(bad, F.concat(F.lit("golangci-lint failed: "), F.coalesce("stderr", F.lit("")))).when(body.isNull(), "failed to parse golangci-lint output")
    rows = runs.withColumn("reason", reason)
    row = lambda severity, message: [F.lit("golangci-lint").alias("analyzer_id"), F.lit(severity).alias("severity"), F.lit("").alias("file"), F.lit(0).cast("long").alias("line"), message.alias("message")]
    failed = rows.filter("reason is not null").select("run", *row(2, F.col("reason")))
    issues = lint_issues(rows.filter("reason is null").select("run", "stdout"))
    out = issues.filter("escaped").groupBy("run").agg(F.count("*").alias("n"))
    gone = out.select("run", *row(1, F.concat(F.lit("dropped "), F.col("n").cast("string"), F.lit(" finding(s) naming files outside the analysed project"))))
    return issues.filter("not escaped").select("run", "analyzer_id", "severity", "file", "line", "message").unionByName(failed).unionByName(gone)


def disabled_forced(configs: DataFrame) -> DataFrame:
    """path, ord, linter: forced linters that a configuration (path, disable array) turns off."""
    return configs.select("path", F.posexplode("disable").alias("ord", "linter")).filter(F.col("linter").isin(*FORCED_LINTERS))


def flag_problems(flags: DataFrame) -> DataFrame:
    """flag, value, want of flags (flag, value) whose value is not of its kind; an empty severity, preset or type list is fine."""
    wants = {
        "severity": (r"^(error|info|warning)?$", "error|info|warning"), "extra-types": (r"^([a-z0-9-]+(,[a-z0-9-]+)*)?$", "a comma-separated list of lowercase names"),
        "scope": (r"^(full|changed|commit)$", "full|changed|commit"), "preset": (r"^(minimal|recommended|strict)?$", "minimal|recommended|strict"),
    }
    want = F.create_map(*(F.lit(x) for k, (_, text) in wants.items() for x in (k, text)))
    bad = F.lit(False)
    for flag, (pattern, _) in wants.items():
        bad = bad | ((F.col("flag") == flag) & ~F.coalesce("value", F.lit("")).rlike(pattern))
    return flags.filter(bad).select("flag", "value", want[F.col("flag")].alias("want"))


def id_problems(rows: DataFrame, order: str = "path") -> DataFrame:
    """kind, id, path, problem of documents (kind, id, path) with an empty id, or with one that an earlier document of the kind has."""
    blank = F.coalesce(F.col("id"), F.lit("")) == ""
    twice = F.row_number().over(W.partitionBy("kind", "id").orderBy(order)) > 1
    return rows.withColumn("twice", twice).select("kind", "id", "path", F.when(blank, "empty id").when(F.col("twice"), "duplicate id").alias("problem")).filter("problem is not null")


def unknown_overrides(profiles: DataFrame, skills: DataFrame) -> DataFrame:
    """profile, skill of overrides (profile, id) of skills (id) that there are not."""
    return profiles.join(skills.select("id"), "id", "left_anti").select("profile", F.col("id").alias("skill"))


def grade_totals(graded: DataFrame) -> DataFrame:
    """passed, machine, judge by artifact and scenario, by artifact, and over all (scenario, then artifact null)."""
    return graded.rollup("artifact", "scenario").agg(*(F.sum(c).alias(c) for c in ("passed", "machine", "judge")))


def list_selection(spec: str, size: int) -> list[int]:
    """Numbers of ``1,4,7-9`` or ``a`` (all); blank is none; each once, in order. Out of range is an error."""
    spec = spec.strip()
    if spec in ("a", "all"):
        return list(range(1, size + 1))
    out: list[int] = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        low, _, high = part.partition("-")
        a, b = int(low), int(high or low)
        if not 1 <= a <= b <= size:
            raise ValueError(f"{part} is out of range")
        out += [k for k in range(a, b + 1) if k not in out]
    return out
