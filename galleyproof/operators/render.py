"""Documents from a knowledge base: sections, composition, skills, workflows, the router, and the checks on them.

Tables: items (kind, id, name, body, linters, refs) for rules and patterns; skills (id, name, description, triggers, always_load, ord,
merged, compose_rules, compose_patterns, compose_workflows, compose_skills); workflows (id, name, description, steps, body,
compose_rules, compose_patterns). A reference may carry a ``#part``, which is cut. All groups are one document's, never a table's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galleyproof.functions import text as X
from galleyproof.operators.knowledge import sections

# Section names and their headings, in document order.
SECTIONS = (
    ("when", "When this applies"), ("catalog", "The catalog"), ("must", "Must"), ("recipe", "Recipe"), ("approved", "Approved patterns and where they appear"),
    ("rejected", "Rejected anti-patterns (and the rule each breaks)"), ("examples", "Examples"), ("forbidden", "Forbidden"),
    ("validation", "Validation checklist"), ("outputs", "Expected outputs"),
)
NORMATIVE = ("must", "forbidden", "validation")
ROUTER = "project-router"
MIN_PROSE_BYTES = 120
NOTICE = "<!-- Installed; run the installer again to update, do not edit by hand. -->"
_DEFINE = r'(?s)\{\{-?\s*define "[^"]*"\s*-?\}\}.*?\{\{-?\s*end\s*-?\}\}'


def _key(ref: Column) -> Column:
    return F.substring_index(ref, "#", 1)


def _lines(rows: DataFrame, by: list[str], order: Column, line: Column, name: str) -> DataFrame:
    """One text for each group: ``line`` by ``order``, joined by nothing."""
    listed = F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("line"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(listed, lambda s: s["line"]), "").alias(name))


def _ticked(values: Column, sep: str = ", ") -> Column:
    return F.array_join(F.transform(values, lambda v: F.concat(F.lit("`"), v, F.lit("`"))), sep)


def canonical(spark) -> DataFrame:
    return spark.createDataFrame([(k, name, heading) for k, (name, heading) in enumerate(SECTIONS)], "place int, key string, heading string")


def item_sections(items: DataFrame) -> DataFrame:
    """kind, id, place, key, heading, text of the sections with text; of two defines of one name the later stands."""
    found = items.select("kind", "id", F.posexplode(sections(F.col("body"))).alias("pos", "s"))
    last = found.groupBy("kind", "id", F.col("s.key").alias("key")).agg(F.max_by(X.trim_space(F.col("s.body")), "pos").alias("text"))
    return last.filter("text <> ''").join(F.broadcast(canonical(items.sparkSession)), "key").select("kind", "id", "place", "key", "heading", "text")


def odd_sections(items: DataFrame) -> DataFrame:
    """kind, id, key of defines whose name is no section's."""
    found = items.select("kind", "id", F.explode(sections(F.col("body"))).alias("s")).select("kind", "id", "s.key").distinct()
    return found.filter(~F.col("key").isin(*(k for k, _ in SECTIONS)))


def whole_bodies(items: DataFrame) -> DataFrame:
    """kind, id, text: what stands outside the defines, then each section under its heading."""
    head = items.select("kind", "id", X.trim_space(F.regexp_replace("body", _DEFINE, "")).alias("head"))
    line = F.concat(F.lit("\n\n## "), "heading", F.lit("\n\n"), "text")
    rest = _lines(item_sections(items), ["kind", "id"], F.col("place"), line, "rest")
    return head.join(rest, ["kind", "id"], "left").select("kind", "id", F.concat("head", F.coalesce("rest", F.lit(""))).alias("text"))


def composed(holders: DataFrame, items: DataFrame) -> DataFrame:
    """holder, src (place: rules, then patterns), kind, ref, and the item's name, linters and refs; name is null of an unknown one."""
    n = F.size(F.coalesce("compose_rules", F.array().cast("array<string>")))
    rules = holders.select(F.col("id").alias("holder"), F.posexplode("compose_rules").alias("src", "ref")).withColumn("kind", F.lit("rules"))
    patterns = holders.select(F.col("id").alias("holder"), n.alias("n"), F.posexplode("compose_patterns").alias("p", "ref"))
    patterns = patterns.select("holder", (F.col("n") + F.col("p")).alias("src"), "ref", F.lit("patterns").alias("kind"))
    refs = rules.unionByName(patterns).withColumn("ref", _key(F.col("ref")))
    return refs.join(items.select("kind", F.col("id").alias("ref"), "name", "linters", "refs"), ["kind", "ref"], "left")


def unknown_compositions(holders: DataFrame, items: DataFrame) -> DataFrame:
    """holder, kind, ref of compositions that name nothing; a document is rendered without them."""
    return composed(holders, items).filter("name is null").select("holder", "kind", "ref")


def composed_values(holders: DataFrame, items: DataFrame, column: str) -> DataFrame:
    """holder, ord, value: ``linters`` or ``refs`` of the composed items, each once, in order of first sight."""
    rows = composed(holders, items).select("holder", "src", F.posexplode(column).alias("k", "value"))
    first = rows.groupBy("holder", "value").agg(F.min(F.struct("src", "k")).alias("at"))
    return first.select("holder", (F.row_number().over(W.partitionBy("holder").orderBy("at")) - 1).alias("ord"), "value")


def without_duty(skills: DataFrame, items: DataFrame) -> DataFrame:
    """Ids of skills none of whose composed items has a normative section; the router and skills of unknown items are left out."""
    held = composed(skills.filter(F.col("id") != ROUTER), items)
    duty = item_sections(items).filter(F.col("key").isin(*NORMATIVE)).select("kind", F.col("id").alias("ref")).distinct()
    fine = held.join(duty, ["kind", "ref"], "left_semi").select("holder").unionByName(held.filter("name is null").select("holder"))
    return skills.filter(F.col("id") != ROUTER).select("id").join(fine.select(F.col("holder").alias("id")), "id", "left_anti")


def prose_bytes(body: Column) -> Column:
    """Bytes of a sidecar's trimmed lines, without blank ones and those that point to "the composed" item."""
    lines = F.filter(F.transform(F.split(body, "\n"), X.trim_space), lambda x: (x != "") & ~x.contains("the composed"))
    return F.octet_length(F.array_join(lines, ""))


def sidecar_problems(skills: DataFrame, sidecars: DataFrame) -> DataFrame:
    """id, problem of skills without a sidecar (id, body) or with one that says too little."""
    rows = skills.filter(F.col("id") != ROUTER).select("id").join(sidecars.select("id", "body"), "id", "left")
    gone = F.coalesce(F.col("body"), F.lit("")) == ""
    return rows.select("id", F.when(gone, "no sidecar").when(prose_bytes(F.col("body")) < MIN_PROSE_BYTES, "no orientation").alias("problem")).filter("problem is not null")


def unknown_analyzers(rules: DataFrame, analyzers: DataFrame) -> DataFrame:
    """rule, ord, analyzer of references (an array ``analyzers`` of rules: id) to no registered check (analyzer_id)."""
    refs = rules.select(F.col("id").alias("rule"), F.posexplode("analyzers").alias("ord", "analyzer"))
    return refs.join(analyzers.select(F.col("analyzer_id").alias("analyzer")), "analyzer", "left_anti").select("rule", "ord", "analyzer")


def off_catalog(themes: DataFrame, catalog: DataFrame) -> DataFrame:
    """area, ord, name of a theme's (keywords, names) emoji that the catalog (name) lacks."""
    rows = themes.select(F.col("keywords")[0].alias("area"), F.posexplode("names").alias("ord", "name"))
    return rows.join(catalog.select("name"), "name", "left_anti").select("area", "ord", "name")


def anchors(themes: DataFrame) -> DataFrame:
    """area, text of each theme: its first keyword, its emoji in brackets."""
    names = F.array_join(F.transform("names", lambda n: F.concat(F.lit("`:"), n, F.lit(":`"))), ", ")
    return themes.select(F.col("keywords")[0].alias("area"), F.concat(F.col("keywords")[0], F.lit(" ("), names, F.lit(")")).alias("text"))


def installed_only(rows: DataFrame, installed: DataFrame | None, column: str = "id") -> DataFrame:
    """Rows whose id is installed (id); None keeps all, as an installation that names none has all."""
    return rows if installed is None else rows.join(installed.select(F.col("id").alias(column)).distinct(), column, "left_semi").select(*rows.columns)


def skill_list(skills: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """id, place, summary of the chosen skills without the router, by order and id: the first sentence of each description."""
    rows = installed_only(skills.filter(F.col("id") != ROUTER), chosen)
    return rows.select("id", F.struct("ord", "id").alias("place"), X.first_sentence(F.col("description")).alias("summary"))


def surviving(rows: DataFrame, installed: DataFrame | None) -> DataFrame:
    """Router rows (ord, skills array, any others) with their installed skills, in order; those left with none drop."""
    if installed is None:
        return rows.filter(F.size("skills") > 0)
    each = rows.select("ord", F.posexplode("skills").alias("k", "id")).join(installed.select("id").distinct(), "id", "left_semi")
    kept = each.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda s: s["id"]).alias("skills"))
    return rows.drop("skills").join(kept, "ord").select(*rows.columns)


def _front(notice: str) -> list:
    return [F.lit("---\nname: "), F.col("id"), F.lit("\ndescription: "), F.col("description"), F.lit("\n---\n\n# "), F.col("name"), F.lit(f"\n\n{notice}\n\n"), F.col("description")]


def _bullets(values: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.concat(F.lit("\n- "), v)), "")


def rule_blocks(skills: DataFrame, items: DataFrame) -> DataFrame:
    """id, text of a skill's composed sections: by section where it merges, by source where it does not."""
    held = composed(skills, items).filter("name is not null").join(skills.select(F.col("id").alias("holder"), F.coalesce("merged", F.lit(True)).alias("merged")), "holder")
    parts = held.join(item_sections(items).withColumnRenamed("id", "ref"), ["kind", "ref"])
    line = lambda name: F.concat(F.lit("\n\n#### "), name, F.lit("\n\n"), "text")
    by_section = _lines(parts.filter("merged"), ["holder", "place", "heading"], F.col("src"), line("name"), "block")
    by_section = by_section.select("holder", "place", "heading", "block")
    by_source = _lines(parts.filter("not merged"), ["holder", "src"], F.col("place"), line("heading"), "block")
    sources = held.filter("not merged").select("holder", "src", "name").join(by_source, ["holder", "src"], "left")
    blocks = by_section.unionByName(sources.select("holder", F.col("src").alias("place"), F.col("name").alias("heading"), F.coalesce("block", F.lit("")).alias("block")))
    return _lines(blocks, ["holder"], F.col("place"), F.concat(F.lit("\n\n### "), "heading", "block"), "text").withColumnRenamed("holder", "id")


def skill_documents(skills: DataFrame, items: DataFrame, workflows: DataFrame, references: DataFrame, sidecars: DataFrame, notice: str = NOTICE) -> DataFrame:
    """id, ord, text: one document for each skill but the router. references: id, title, url, note; sidecars: id, body."""
    rows = skills.filter(F.col("id") != ROUTER)
    flows = rows.select("id", F.posexplode("compose_workflows").alias("k", "ref")).join(workflows.select(F.col("id").alias("ref"), "name", "body"), "ref")
    flows = _lines(flows, ["id"], F.col("k"), F.concat(F.lit("\n\n### "), "name", F.lit("\n\n"), X.strip_heading(F.col("body"))), "flows")
    cited = composed_values(rows, items, "refs").join(references.select(F.col("id").alias("value"), "title", "url", "note"), "value")
    note = F.when(F.coalesce("note", F.lit("")) == "", "").otherwise(F.concat(F.lit(" - "), "note"))
    cited = _lines(cited, ["holder"], F.col("ord"), F.concat(F.lit("\n- ["), "title", F.lit("]("), "url", F.lit(")"), note), "cited").withColumnRenamed("holder", "id")
    lint = composed_values(rows, items, "linters")
    lint = lint.groupBy(F.col("holder").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda s: s["value"]).alias("lint"))
    side = sidecars.select("id", X.trim_space(F.col("body")).alias("side"))
    joined = rows.join(side, "id", "left").join(rule_blocks(rows, items).withColumnRenamed("text", "rules"), "id", "left").join(flows, "id", "left").join(cited, "id", "left").join(lint, "id", "left")
    some = lambda c, head, value: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), value)).otherwise("")
    listed = lambda c, head: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.concat(F.lit(head), _ticked(F.col(c)))).otherwise("")
    text = F.concat(
        *_front(notice), F.lit("\n\n## Activation conditions"), _bullets(F.col("triggers")), some("side", "\n\n", F.col("side")),
        some("rules", "\n\n## Applicable rules and patterns\n", F.col("rules")), some("flows", "\n\n## Workflows", F.col("flows")),
        some("cited", "\n\n## References", F.col("cited")), F.lit("\n\n## Composition\n- Always load: "), F.col("always_load").cast("string"),
        F.lit("\n- Order: "), F.col("ord").cast("string"), listed("compose_skills", "\n- Compose with: "), listed("lint", "\n- Linters: "), F.lit("\n"),
    )
    return joined.select("id", "ord", text.alias("text"))


def workflow_documents(workflows: DataFrame, items: DataFrame, notice: str = NOTICE) -> DataFrame:
    """id, text: steps, body, and each composed rule and pattern whole, without its own heading."""
    held = composed(workflows, items).filter("name is not null").join(whole_bodies(items).withColumnRenamed("id", "ref"), ["kind", "ref"])
    line = F.concat(F.lit("\n\n### "), "name", F.lit("\n\n"), X.strip_heading(F.col("text")))
    out = workflows
    for kind in ("rules", "patterns"):
        part = _lines(held.filter(F.col("kind") == kind), ["holder"], F.col("src"), line, kind).withColumnRenamed("holder", "id")
        out = out.join(part, "id", "left")
    some = lambda c, head: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), F.col(c))).otherwise("")
    text = F.concat(*_front(notice), F.lit("\n\n## Steps"), _bullets(F.col("steps")), some("body", "\n\n"), some("rules", "\n\n## Applicable rules"), some("patterns", "\n\n## Applicable patterns"), F.lit("\n"))
    return out.select("id", text.alias("text"))


def router_lines(baseline: DataFrame, dispatch: DataFrame, order: DataFrame, skills: DataFrame, installed: DataFrame | None = None) -> DataFrame:
    """part, place, line of the router's four lists, for the installed skills.

    baseline: part (always, commit_last, conditional), ord, skill, note; dispatch: ord, signal, skills, note; order: ord, skills, note. Steps
    are numbered over those that stay.
    """
    base = installed_only(baseline, installed, "skill").select("part", F.col("ord").cast("long").alias("place"), F.concat(F.lit("- `"), "skill", F.lit("` - "), "note").alias("line"))
    note = F.when(F.coalesce("note", F.lit("")) == "", "").otherwise(F.concat(F.lit(" ("), "note", F.lit(")")))
    table = surviving(dispatch, installed).select(F.lit("dispatch").alias("part"), F.col("ord").cast("long").alias("place"), F.concat(F.lit("| "), "signal", F.lit(" | "), _ticked(F.col("skills")), note, F.lit(" |")).alias("line"))
    steps = surviving(order, installed).withColumn("n", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("ord")))
    steps = steps.select(F.lit("order").alias("part"), F.col("n").cast("long").alias("place"), F.concat(F.col("n").cast("string"), F.lit(". "), _ticked(F.col("skills"), " / "), F.lit(" - "), "note").alias("line"))
    listed = skill_list(skills, installed).withColumn("n", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("place")))
    listed = listed.select(F.lit("skills").alias("part"), F.col("n").cast("long").alias("place"), F.concat(F.lit("- `"), "id", F.lit("` - "), "summary").alias("line"))
    return base.unionByName(table).unionByName(steps).unionByName(listed)


def router_document(lines: DataFrame, frame: list[tuple[str, str]]) -> DataFrame:
    """text: the caller's ``frame`` of (fixed text, part); each text is followed by the lines of its part."""
    parts = _lines(lines, ["part"], F.col("place"), F.concat(F.lit("\n"), "line"), "block")
    around = lines.sparkSession.createDataFrame([(k, t, p) for k, (t, p) in enumerate(frame)], "k int, fixed string, part string")
    whole = F.array_sort(F.collect_list(F.struct("k", F.concat("fixed", F.coalesce("block", F.lit(""))).alias("t"))))
    return around.join(parts, "part", "left").agg(F.concat(F.array_join(F.transform(whole, lambda s: s["t"]), ""), F.lit("\n")).alias("text"))
