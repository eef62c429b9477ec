"""Queries of the Go checks over one source file for each part, whose shape follows from its key."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleyproof.operators import gochecks as C
from galleyproof.operators.graph import cut
from galleyproof.plans.carriers import table
from galleyproof.sources.gofacts import go_facts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# Lines of a file; the line numbers below count them.
LINES = (
    "package a", "", "import (", "\t\"fmt\"", "\t\"{imp}\"", "\t\"os\"", ")", "",
    "type Clock struct {", "\t{field} func() time.Time", "}", "",
    "// {doc}", "func (c Clock) Name() string {", "\treturn c.name", "}", "",
    "func Two(a, b int, {flag} bool) ({results}) {", "\t{num}1 := a", "\t{num}2 := b", "\tif {local} := a; b > 1 {", "\t\t{inner} := {number}", "\t}",
    "\tif a > 1 {", "\t\tfor range b {", "\t\t\tif b > a {", "\t\t\t\tfor range a {", "\t\t\t\t\tif a == b {", "\t\t\t\t\t}", "\t\t\t\t}", "\t\t\t}", "\t\t}", "\t} else {", "\t\t{exit}", "\t}",
    "\t{call}(1)", "\ta, z := 1, 2", "\treturn a, b", "}", "", "var {noise} = 1", "",
)
# How each blank is filled: by key modulo the number of choices.
CHOICES = {
    "imp": ("example.com/mod/x", "example.com/other", "io"), "field": ("now", "Now"), "doc": ("Name returns the name.", "why: it is kept. So there.", "One. Two. Three."),
    "flag": ("flag", "fallback"), "results": ("int, int", "x, y int", "int, string"), "num": ("v", "strVal"), "local": ("t", "len", "s"), "inner": ("t", "a", "ok", "u"),
    "number": ("7", "1024", "0o644", "2", "99"), "exit": ("return 1, 2", "a = 2"), "call": ("time.Sleep", "fmt.Sleep"), "noise": ("data", "Util", "X", "plain"),
}


def _sources(spark, sf_dir):
    k, body = F.col("p_partkey"), F.lit("\n".join(LINES))
    for name, values in CHOICES.items():
        body = F.replace(body, F.lit("{" + name + "}"), F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int")))
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("src/"), k, F.lit(".go")).alias("path"), F.lit(".go").alias("ext"), body.alias("content"))
    # parsed once for all forms of a check
    return cut(go_facts(files))


def _rows(*found: tuple[int, str, str]) -> str:
    """SQL of rows (line, message, condition on k)."""
    return " union all ".join(f"select 'src/' || k || '.go' as file, {line}::bigint as line, {message} as message from (select p_partkey as k from part) where {when}" for line, message, when in found)


def check(name: str, build, *found: tuple[int, str, str]) -> None:
    def run(spark, sf_dir):
        return build(_sources(spark, sf_dir)).select("file", "line", "message")

    run.__name__, run.__doc__ = name, build.__doc__
    QUERIES[name], ORACLE_SQL[name] = run, _rows(*found)


check("go_import_groups", lambda f: C.import_groups(f, "example.com/mod"), (6, "'import groups out of order'", "k % 3 < 2"))
check(
    "go_naming", C.naming, (19, "'numbered name v1'", "k % 2 = 0"), (20, "'numbered name v2'", "k % 2 = 0"), (19, "'numbered name strVal1'", "k % 2 = 1"), (20, "'numbered name strVal2'", "k % 2 = 1"),
    (19, "'type prefix in strVal1'", "k % 2 = 1"), (20, "'type prefix in strVal2'", "k % 2 = 1"),
    (41, "'noise word data'", "k % 4 = 0"), (41, "'noise word Util'", "k % 4 = 1"), (41, "'single-letter exported name X'", "k % 4 = 2"),
)
check("go_magic_numbers", C.magic_numbers, (22, "'magic number 7'", "k % 5 = 0"), (22, "'magic number 99'", "k % 5 = 4"))
check("go_complexity", C.complexity, (18, "'flag argument flag'", "k % 2 = 0"))
check("go_control_flow", C.control_flow, (18, "'nesting depth 5'", "true"), (34, "'return in an else block'", "k % 2 = 0"))
check("go_named_returns", C.named_returns, (18, "'Two repeats an unnamed result type'", "k % 3 = 0"))
check("go_vacuous_doc", C.vacuous_doc, (14, "'doc on Name restates it'", "k % 3 = 0"))
check("go_time_discipline", C.time_discipline, (10, "'clock injected as a function field'", "true"), (36, "'time.Sleep waits on the clock'", "k % 2 = 0"))
check(
    "go_shadowing", C.shadowing, (21, "'\"len\" shadows an outer builtin'", "k % 3 = 1"), (22, "'\"a\" shadows an outer variable'", "k % 4 = 1"),
    (22, "'\"t\" shadows an outer variable'", "k % 4 = 0 and k % 3 = 0"), (37, "'\"a\" is reassigned by := in the block that declares it'", "true"),
)


def go_limits(spark, sf_dir):
    """Length and parameter count of one function for each part; test files may be longer."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("int")
    params = F.array_join(F.transform(F.sequence(F.lit(0), size % 9), lambda i: F.concat(F.lit("p"), i)), ", ")
    body = F.concat(F.lit("package a\nfunc F("), params, F.lit(" int) {\n"), F.repeat(F.lit("x()\n"), size * 4), F.lit("}\n"))
    path = F.concat(F.lit("src/"), k, F.when(k % 2 == 0, "_test.go").otherwise(".go"))
    return C.complexity(cut(go_facts(table(spark, sf_dir, "part").select(path.alias("path"), F.lit(".go").alias("ext"), body.alias("content"))))).select("file", "line", "message")


QUERIES["go_limits"] = go_limits
ORACLE_SQL["go_limits"] = """with f as (select 'src/' || p_partkey || case when p_partkey % 2 = 0 then '_test.go' else '.go' end as file, p_size * 4 + 2 as n, p_size % 9 + 1 as p, case when p_partkey % 2 = 0 then 120 else 80 end as most from part)
 select file, 2::bigint as line, 'F is ' || n || ' lines' as message from f where n > most union all select file, 2::bigint, 'F has ' || p || ' parameters' from f where p > 5"""
