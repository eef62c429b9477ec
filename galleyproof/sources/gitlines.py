"""Version-control output as rows: status lines, rename lines, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _extension(path):
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def changes(status: DataFrame, line: str = "line") -> DataFrame:
    """Porcelain lines (XY path, renames as ``old -> new``) to path, old_path, ext, is_test, staging, worktree, staged; short lines drop."""
    rows = status.filter(F.char_length(line) > 3)
    rest = F.substring(line, 4, 1 << 30)
    renamed = rest.contains(" -> ")
    path = F.when(renamed, F.regexp_replace(rest, r"(?s)^.*? -> ", "")).otherwise(rest)
    return rows.withColumns({
        "staging": F.substring(line, 1, 1), "worktree": F.substring(line, 2, 1), "path": path,
        "old_path": F.when(renamed, F.regexp_extract(rest, r"(?s)^(.*?) -> ", 1)).otherwise(F.lit("")),
        "ext": _extension(path), "is_test": path.endswith("_test.go"), "staged": ~F.substring(line, 1, 1).isin(" ", "?"),
    })


def renames(rows: DataFrame, line: str = "line") -> DataFrame:
    """Name-status lines of three tab-separated fields that start with R and a score."""
    f = F.split(line, "\t")
    kept = rows.filter((F.size(f) == 3) & f[0].rlike("^R[0-9]+$"))
    return kept.withColumns({"score": F.substring(f[0], 2, 9).cast("int"), "old_path": f[1], "new_path": f[2]})


def module_name(content) -> F.Column:
    """Path of the first module line of a module file."""
    return F.regexp_extract(content, r"(?m)^module[ \t]+(\S+)", 1)


def workspace_uses(content) -> F.Column:
    """Folders of single-line use directives."""
    return F.regexp_extract_all(content, F.lit(r"(?m)^use[ \t]+([^(\s]\S*)"), 1)
