"""Checks on Go facts: relational forms over ``go_facts`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words of the naming checks and limits.
NOISE_WORDS = ("data", "info", "temp", "tmp", "helper", "util", "misc", "stuff", "thing", "manager", "common", "dummy")
HUNGARIAN_PREFIXES = ("lpstr", "lpsz", "psz", "str", "pfn", "ull", "dw", "sz", "ll", "ul", "us", "ui", "h", "u", "n", "b", "w", "l", "i")
PLAIN_NUMBERS = ("0", "1", "-1", "0.0", "1.0", "2", "10", "60", "100", "1000", "3600", "86400", "255", "256", "1024", "1025")
# Names every scope lies in, and the one that may be declared anew.
BUILTINS = (
    "true", "false", "nil", "int", "int8", "int16", "int32", "int64", "uint", "uint8", "uint16", "uint32", "uint64", "uintptr", "float32", "float64", "complex64", "complex128", "string", "bool",
    "byte", "rune", "error", "any", "comparable", "make", "new", "len", "cap", "append", "copy", "delete", "close", "panic", "recover", "print", "println", "real", "imag", "complex", "iota",
)
FREE_NAMES = ("ok",)
MAX_CYCLOMATIC, MAX_FUNC_LINES, TEST_FACTOR, MAX_PARAMS, MAX_NESTING = 15, 80, 1.5, 5, 4


def _row(df: DataFrame, analyzer: str, message) -> DataFrame:
    return df.select(F.lit(analyzer).alias("analyzer_id"), F.col("path").alias("file"), F.col("line").cast("long").alias("line"), message.alias("message"))


def import_groups(facts: DataFrame, module: str) -> DataFrame:
    """First place in a file where an import's group (standard 0, external 1, own 2) falls below the one before it."""
    if not module:
        return _row(facts.limit(0), "import-groups", F.lit(""))
    own = (F.col("name") == module) | F.col("name").startswith(module + "/")
    group = F.when(own, 2).when(F.split("name", "/")[0].contains("."), 1).otherwise(0)
    rows = facts.filter("kind = 'import'").withColumn("grp", group)
    rows = rows.withColumn("down", F.col("grp") < F.lag("grp").over(W.partitionBy("path").orderBy("ord"))).filter("down")
    return _row(rows.groupBy("path").agg(F.min_by("line", "ord").alias("line")), "import-groups", F.lit("import groups out of order"))


def naming(facts: DataFrame) -> DataFrame:
    """Single-letter exported names, numbered siblings in a file, type prefixes, and noise words (unless a name is its own type's)."""
    names = facts.filter("kind in ('func', 'param', 'result', 'short', 'var', 'const', 'type') and name not in ('', '_')")
    single = names.filter((F.octet_length("name") == 1) & F.col("name").rlike(r"^\p{Lu}"))
    pattern = r"^(.*[^\p{Lu}0-9])([0-9]{1,9})$"
    numbered = names.withColumn("stem", F.regexp_extract("name", pattern, 1)).filter((F.col("stem") != "") & (F.regexp_extract("name", pattern, 2).try_cast("int") <= 7))
    plain = names.select("path", F.col("name").alias("stem")).distinct()
    kin = numbered.select("path", "stem", "name").distinct().groupBy("path", "stem").agg(F.count("*").alias("n")).filter("n > 1").select("path", "stem")
    twins = numbered.join(plain.union(kin).distinct(), ["path", "stem"], "left_semi")
    prefixed = names.filter(F.col("name").rlike("^(" + "|".join(HUNGARIAN_PREFIXES) + r")\p{Lu}"))
    own_type = F.lower(F.regexp_extract(F.coalesce(F.col("attrs")["type"], F.lit("")), r"(\w+)\W*$", 1))
    noise = names.filter(F.lower("name").isin(*NOISE_WORDS) & (F.lower("name") != own_type))
    out = _row(single, "naming", F.concat(F.lit("single-letter exported name "), "name"))
    for rows, text in ((twins, "numbered name "), (prefixed, "type prefix in "), (noise, "noise word ")):
        out = out.unionByName(_row(rows, "naming", F.concat(F.lit(text), "name")))
    return out


def magic_numbers(facts: DataFrame) -> DataFrame:
    """Number literals of functions outside constants that are not plain, octal modes or bit sizes; test files are free."""
    rows = facts.filter("kind = 'number' and owner <> ''").filter(~F.col("path").endswith("_test.go"))
    odd = rows.filter(~F.col("name").isin(*PLAIN_NUMBERS) & ~F.col("name").rlike("^0[oO]") & ~F.col("name").endswith("i") & ~F.coalesce(F.col("attrs")["exempt"] == "True", F.lit(False)))
    return _row(odd, "complexity", F.concat(F.lit("magic number "), "name"))


def complexity(facts: DataFrame) -> DataFrame:
    """Cyclomatic number, length, parameter count and flag arguments of functions."""
    branches = facts.filter("kind = 'branch'").groupBy("path", "owner").agg(F.count("*").alias("b"))
    params = facts.filter("kind = 'param'").groupBy("path", "owner").agg(F.count("*").alias("p"))
    f = facts.filter("kind = 'func'").join(branches, ["path", "owner"], "left").join(params, ["path", "owner"], "left")
    c, n = F.coalesce("b", F.lit(0)) + 1, F.col("attrs")["close"].cast("int") - F.col("attrs")["open"].cast("int") + 1
    limit = F.when(F.col("path").endswith("_test.go"), round(MAX_FUNC_LINES * TEST_FACTOR)).otherwise(MAX_FUNC_LINES)
    out = _row(f.filter(c > MAX_CYCLOMATIC), "complexity", F.concat("name", F.lit(" has cyclomatic complexity "), c))
    out = out.unionByName(_row(f.filter(n > limit), "complexity", F.concat("name", F.lit(" is "), n, F.lit(" lines"))))
    out = out.unionByName(_row(f.filter(F.col("p") > MAX_PARAMS), "complexity", F.concat("name", F.lit(" has "), "p", F.lit(" parameters"))))
    flags = facts.filter("kind = 'param' and attrs['type'] = 'bool' and name not in ('fallback', 'def', 'defaultValue')")
    return out.unionByName(_row(flags, "complexity", F.concat(F.lit("flag argument "), "name")))


def control_flow(facts: DataFrame, max_depth: int = MAX_NESTING) -> DataFrame:
    deep = facts.filter((F.col("kind") == "depth") & (F.col("name").cast("int") > max_depth))
    out = _row(deep, "control-flow", F.concat(F.lit("nesting depth "), "name"))
    return out.unionByName(_row(facts.filter("kind = 'else'"), "control-flow", F.concat("name", F.lit(" in an else block"))))


def named_returns(facts: DataFrame) -> DataFrame:
    """Functions of two or more unnamed results with a repeated type."""
    r = facts.filter("kind = 'result'").groupBy("path", "owner").agg(F.min("line").alias("line"), F.count("*").alias("n"), F.count_distinct(F.col("attrs")["type"]).alias("types"), F.max("name").alias("named"))
    return _row(r.filter("n >= 2 and types < n and named = ''"), "named-returns", F.concat("owner", F.lit(" repeats an unnamed result type")))


def vacuous_doc(facts: DataFrame) -> DataFrame:
    """Docs of at most a sentence on functions that return one plain value."""
    doc = F.col("attrs")["doc"]
    hit = facts.filter((F.col("kind") == "func") & (F.col("attrs")["plain"] == "True") & (doc != "") & (F.regexp_count(doc, F.lit(r"\.(?=\s|$)")) <= 1) & ~F.lower(doc).rlike("why:|simplification:"))
    return _row(hit, "vacuous-doc", F.concat(F.lit("doc on "), "name", F.lit(" restates it")))


def time_discipline(facts: DataFrame) -> DataFrame:
    hit = facts.filter("(kind = 'call' and name = 'time.Sleep') or kind = 'field'")
    return _row(hit, "time-discipline", F.when(F.col("kind") == "call", "time.Sleep waits on the clock").otherwise("clock injected as a function field"))


def shadowing(facts: DataFrame) -> DataFrame:
    """Local names that hide one of an enclosing scope, and parameters or results that ``:=`` assigns anew in the function's own block.

    Scopes nest, so an earlier declaration encloses a later one just where its scope has not ended: a running maximum of scope ends over
    the declarations of a name in a function finds it, without comparing pairs.
    """
    attr = lambda name: F.col("attrs")[name].cast("long")
    rows = facts.filter("kind = 'local'").withColumns({"fn": attr("fn"), "pos": attr("pos"), "scope": attr("scope"), "until": attr("until")})
    signed = facts.filter("kind = 'signature'").select("path", attr("fn").alias("fn"), "name").distinct().withColumn("signed", F.lit(True))
    rows = rows.join(signed, ["path", "fn", "name"], "left").withColumn("signed", F.coalesce("signed", F.lit(False)))
    own = W.partitionBy("path", "fn", "name").orderBy("pos")
    top = F.col("scope") == F.col("fn")
    again = rows.filter(top & F.col("signed")).withColumn("n", F.row_number().over(own)).filter("n = 1")
    first = rows.filter(~(top & F.col("signed"))).withColumn("n", F.row_number().over(W.partitionBy("path", "fn", "name", "scope").orderBy("pos"))).filter("n = 1")
    first = first.withColumn("open", F.max("until").over(own.rowsBetween(W.unboundedPreceding, -1)))
    builtin = F.col("name").isin(*BUILTINS)
    outer = F.col("signed") | (F.col("open") >= F.col("pos")) | (F.element_at(F.split("owner", r"\."), -1) == F.col("name"))
    hidden = first.filter(~F.col("name").isin(*FREE_NAMES) & (builtin | outer))
    out = _row(hidden, "shadowing", F.concat(F.lit('"'), "name", F.lit('" shadows an outer '), F.when(builtin, "builtin").otherwise("variable")))
    return out.unionByName(_row(again, "short-decl-reuse", F.concat(F.lit('"'), "name", F.lit('" is reassigned by := in the block that declares it'))))
