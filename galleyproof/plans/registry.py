"""The table of checks: which there are, in which scope they run, and the one plan that runs those selected.

Pruning is done on the plan: a check that scope, preset or configuration leaves out adds nothing to it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleyproof.operators import files as O
from galleyproof.operators import findings as N
from galleyproof.operators import gochecks as C
from galleyproof.operators.graph import cut
from galleyproof.sources.gofacts import go_facts

FULL, CHANGED, COMMIT = "full", "changed", "commit"
# Checks that presets switch off or tighten.
PRESETS: dict[str, dict[str, dict]] = {
    "recommended": {},
    "minimal": {a: {"enabled": False} for a in ("naming", "complexity", "big-comment", "file-size", "control-flow", "shadowing", "vacuous-doc")},
    "strict": {"file-size": {"enabled": True, "params": {"max_lines": "150"}}, "big-comment": {"enabled": True, "params": {"max_lines": "4"}}},
}


@dataclass(frozen=True)
class Spec:
    """One row of the table: id, stage, scopes, and a builder from (files or their Go facts, params) to findings."""

    id: str
    stage: int
    scopes: tuple[str, ...]
    build: Callable[[DataFrame, dict[str, str]], DataFrame]
    on_facts: bool = False


def positive(params: dict[str, str], key: str, fallback: int) -> int:
    """A positive whole number, or the fallback."""
    try:
        value = int(float(params[key])) if "." in str(params[key]) else int(params[key])
    except (KeyError, ValueError):
        return fallback
    return value if value > 0 else fallback


def _file_only(df: DataFrame, analyzer: str, severity: int, message: str) -> DataFrame:
    return df.select(F.lit(analyzer).alias("analyzer_id"), F.lit(severity).alias("severity"), F.lit("syntax").alias("category"), "file", "line", (F.col("message") if "message" in df.columns else F.lit(message)).alias("message"), F.lit("").alias("suggestion"))


def _sized(files: DataFrame, params: dict[str, str]) -> DataFrame:
    return _file_only(O.file_size(files, positive(params, "max_lines", 180)), "file-size", 1, "")


def _go(found: DataFrame, severity: int, category: str = "ast") -> DataFrame:
    return found.select("analyzer_id", F.lit(severity).alias("severity"), F.lit(category).alias("category"), "file", "line", "message", F.lit("").alias("suggestion"))


STATIC, AST = 1, 2
ALL = (FULL, CHANGED, COMMIT)
# In the order in which findings of equal place are emitted.
SPECS = [
    Spec("file-size", STATIC, ALL, _sized),
    Spec("text-markers", STATIC, ALL, lambda f, p: O.mark_findings(f)),
    Spec("typographic-markers", STATIC, ALL, lambda f, p: O.typographic_findings(f)),
    Spec("ai-frontmatter", STATIC, ALL, lambda f, p: _file_only(O.frontmatter_findings(f), "ai-frontmatter", 2, "provenance key in frontmatter")),
    Spec("import-groups", STATIC, ALL, lambda f, p: _go(C.import_groups(f, p.get("module", "")), 2, "syntax"), True),
    Spec("naming", STATIC, ALL, lambda f, p: _go(C.naming(f), 1, "syntax"), True),
    Spec("top-of-file", STATIC, ALL, lambda f, p: _file_only(O.top_of_file(f), "top-of-file", 2, "file starts with a comment before the package declaration")),
    Spec("big-comment", STATIC, ALL, lambda f, p: _file_only(O.big_comment(f, positive(p, "max_lines", 5)), "big-comment", 1, "")),
    Spec("simplification-path", STATIC, ALL, lambda f, p: _file_only(O.simplification_path(f), "simplification-path", 1, "simplification comment names no upgrade path")),
    Spec("control-flow", AST, ALL, lambda f, p: _go(C.control_flow(f, positive(p, "max_depth", C.MAX_NESTING)), 1), True),
    Spec("shadowing", AST, ALL, lambda f, p: _go(C.shadowing(f), 1), True),
    Spec("complexity", AST, ALL, lambda f, p: _go(C.complexity(f), 1).unionByName(_go(C.magic_numbers(f), 0)), True),
    Spec("named-returns", AST, ALL, lambda f, p: _go(C.named_returns(f), 1), True),
    Spec("vacuous-doc", AST, ALL, lambda f, p: _go(C.vacuous_doc(f), 1), True),
    Spec("time-discipline", AST, ALL, lambda f, p: _go(C.time_discipline(f), 1), True),
]


def effective(preset: str, explicit: dict[str, dict] | None = None) -> dict[str, dict]:
    """Configuration by analyzer: a preset's entry replaces a whole one, explicit entries come last; an unknown preset changes nothing."""
    return {**PRESETS.get(preset, {}), **(explicit or {})}


def selected(scope: str, config: dict[str, dict]) -> list[Spec]:
    return [s for s in SPECS if scope in s.scopes and config.get(s.id, {}).get("enabled", True)]


def run(
    files: DataFrame, scope: str = FULL, preset: str = "recommended", config: dict[str, dict] | None = None, include_generated: bool = False, rules: DataFrame | None = None
) -> DataFrame:
    """Findings of the selected checks over a files table, in order, adjacent repeats dropped, with ``suppressed``.

    ``seq`` holds stage, check and place in the file, so that rows of one line keep their order. A check's ``severity`` parameter replaces
    its own; with ``rules`` (id, summary) each finding gets rule_id and rule_summary.
    """
    spark = files.sparkSession
    settings = effective(preset, config)
    chosen = selected(scope, settings)
    # Go files are parsed once for all checks
    facts = cut(go_facts(files)) if any(s.on_facts for s in chosen) else None
    parts = []
    for k, spec in enumerate(chosen):
        found = spec.build(facts if spec.on_facts else files, settings.get(spec.id, {}).get("params", {}))
        place = F.col("byte_offset") if "byte_offset" in found.columns else F.col("line")
        parts.append(found.withColumn("seq", F.lit((spec.stage * 1000 + k) << 40) + place.cast("long")).drop("byte_offset"))
    if not parts:
        empty = spark.createDataFrame([], "analyzer_id string, severity int, category string, file string, line long, message string, suggestion string, seq long, suppressed boolean")
        return empty if rules is None else empty.selectExpr("*", "'' as rule_id", "'' as rule_summary")
    merged = reduce(DataFrame.unionByName, parts)
    own = [(s.id, str(settings[s.id]["params"]["severity"])) for s in chosen if "severity" in settings.get(s.id, {}).get("params", {})]
    if own:
        merged = N.severity_override(merged, spark.createDataFrame(own, "analyzer_id string, severity_param string"))
    found = O.suppress_generated(N.dedupe_adjacent(merged), files, include_generated)
    if rules is not None:
        found = N.inject_rules(found.withColumns({"rule_id": F.lit(""), "rule_summary": F.lit("")}), rules)
    return N.ordered(found)
