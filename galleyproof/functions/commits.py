"""Commit messages as one struct of parts, by staged extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyproof import dims
from galleyproof.functions.text import trim_space

PREFIX = r"^[ \t]*((?::[\p{Ll}\p{Nd}_]{1,33}: *)*)"


def footer(line: Column) -> Column:
    """(key, value) at the first ``: ``, else at the first `` #``; null where neither is inside the line."""

    def at(sep: str):
        cut = F.instr(line, sep)
        return cut > 1, F.struct(trim_space(F.substring(line, F.lit(1), cut - 1)).alias("key"), trim_space(F.substring(line, cut + len(sep), F.lit(1 << 30))).alias("value"))

    (colon, by_colon), (mark, by_mark) = at(": "), at(" #")
    return F.when(colon, by_colon).when(mark, by_mark)


PARTS = ("emojis", "type", "scope", "breaking", "description", "body", "footers", "is_merge", "is_initial", "is_wip")
HEADER = r"^[^(:!\n ]+(?:\(([^)\n]*)\)?)?(!?)(?::[ ]?)?([^\n]*)"


def parse(messages: DataFrame, raw: str) -> DataFrame:
    """``messages`` with PARTS: columns emojis, type, scope, breaking, description, body, footers, is_merge, is_initial, is_wip.

    Stage by stage, so that each extraction is computed once: a projection whose dear columns are read more than once is not merged
    with the next one.
    """
    keep, c = messages.columns, lambda n: F.col(f"_{n}")
    rest_of = F.lit(1 << 30)

    def stage(df: DataFrame, **made: Column) -> DataFrame:
        return df.withColumns({f"_{k}": v for k, v in made.items()})

    df = stage(messages, text=F.regexp_replace(F.col(f"`{raw}`"), r"^[ \t]+", ""))
    df = stage(df, prefix=F.regexp_extract(c("text"), PREFIX, 1), lead=F.regexp_extract(c("text"), PREFIX, 0))
    df = stage(df, emojis=F.regexp_extract_all(c("prefix"), F.lit(r":([\p{Ll}\p{Nd}_]{1,33}):"), 1), rest=F.substring(c("text"), F.char_length(c("lead")) + 1, rest_of))
    df = stage(df, left=trim_space(c("rest")), word=F.regexp_extract(c("rest"), r"^([^(:!\n ]*)", 1), head=F.regexp_extract(c("rest"), HEADER, 0), title=F.regexp_extract(c("rest"), HEADER, 3))
    first_emoji = F.get(c("emojis"), F.lit(0))
    df = stage(df, initial=F.coalesce((F.size(c("emojis")) == 1) & (first_emoji == "ghost") & c("left").rlike("^Initial [Cc]ommit"), F.lit(False)))
    df = stage(df, merge=F.coalesce(~c("initial") & (F.size(c("emojis")) >= 1) & (first_emoji == "volcano") & c("left").startswith("Merge "), F.lit(False)))
    df = stage(df, special=c("initial") | c("merge"), typed=(c("word") != "") & c("rest").rlike(r"^[^(:!\n ]+[(:!]"))
    df = stage(df, ok=~c("special") & c("typed"))
    desc = F.when(c("special"), c("left")).when(c("typed"), trim_space(c("title"))).otherwise(F.when(c("word") == "", F.lit("")).otherwise(c("left")))
    # without a type the parser stands still at the word's end: no body is read
    tail = F.when(c("ok"), F.substring(c("rest"), F.char_length(c("head")) + 1, rest_of)).otherwise(F.lit(""))
    df = stage(df, desc=desc, tail=tail)
    df = stage(df, lines=F.when(c("tail").startswith("\n\n"), F.split(F.substring(c("tail"), 3, 1 << 30), "\n")).otherwise(F.array().cast("array<string>")))
    starts = "^(" + "|".join(dims.FOOTER_STARTS) + ")"
    first = F.aggregate(F.transform(c("lines"), lambda x, i: F.when(x.rlike(starts), i)), F.lit(None).cast("int"), lambda a, x: F.coalesce(a, x))
    df = stage(df, stop=F.coalesce(first, F.size(c("lines"))))
    rest_lines = F.filter(F.slice(c("lines"), c("stop") + 1, F.greatest(F.size(c("lines")) - c("stop"), F.lit(0))), lambda x: x != "")
    df = stage(df, notes=F.transform(rest_lines, footer), written=trim_space(F.array_join(F.filter(F.slice(c("lines"), F.lit(1), c("stop")), lambda x: x != ""), "\n")))
    blank, no = F.lit(""), F.lit(False)
    parts = {
        "emojis": c("emojis"),
        "type": F.when(c("ok"), c("word")).otherwise(blank),
        "scope": F.when(c("ok"), F.regexp_extract(c("rest"), HEADER, 1)).otherwise(blank),
        "breaking": F.when(c("ok"), F.regexp_extract(c("rest"), HEADER, 2) == "!").otherwise(no),
        "description": c("desc"),
        "body": c("written"),
        "footers": F.filter(c("notes"), lambda f: f.isNotNull() & (f["key"] != "")),
        "is_merge": c("merge"),
        "is_initial": c("initial"),
        "is_wip": F.when(c("ok"), c("title").rlike(r"^(?U:\s)*(\[wip\]|\[WIP\])")).otherwise(no),
    }
    return df.select(*(F.col(f"`{k}`") for k in keep if k not in parts), *(v.alias(k) for k, v in parts.items()))


def tool_trailer(raw: Column, footers: Column) -> Column:
    """The key of a forbidden footer, else the marker that the raw text holds, else empty."""
    keys = F.filter(footers, lambda f: F.lower(f["key"]).isin(*dims.TRAILER_KEYS))
    low = F.lower(raw)
    found = F.when(F.size(keys) > 0, F.get(keys, F.lit(0))["key"])
    for marker in dims.TRAILER_MARKERS:
        found = found.when(low.contains(marker), F.lit(marker))
    return found.otherwise(F.lit(""))


def rule_findings(raw: Column, m: dict[str, Column]) -> Column:
    """Array of (rule, message): one scan of a message, no union."""

    def hit(condition: Column, rule: str, message) -> Column:
        return F.when(condition, F.array(F.struct(F.lit(rule).alias("rule"), (F.lit(message) if isinstance(message, str) else message).alias("message")))).otherwise(F.array().cast("array<struct<rule:string,message:string>>"))

    n = F.size(m["emojis"])
    # one look each at what follows the prefix, without making it
    body = trim_space(raw)
    is_initial, is_merge = body.rlike(f"{PREFIX}(?U:\\s)*Initial [Cc]ommit"), body.rlike(f"{PREFIX}(?U:\\s)*Merge ")
    first = F.get(m["emojis"], F.lit(0))
    initial = hit(F.coalesce((n != 1) | (first != "ghost"), F.lit(True)), "commit-initial", "initial commit must be :ghost: Initial Commit")
    merge = hit(F.coalesce((n < 1) | (first != "volcano"), F.lit(True)), "commit-merge", "merge commit must start with :volcano:")
    desc, length = m["description"], F.char_length(m["description"])
    body_lines = F.when(m["body"] == "", F.array().cast("array<string>")).otherwise(F.split(m["body"], "\n"))
    long_lines = F.filter(
        F.transform(body_lines, lambda x, i: F.struct(F.lit("commit-body-length").alias("rule"), F.concat(F.lit("body line "), i + 1, F.lit(" is "), F.char_length(x), F.lit(f" chars, max {dims.MAX_BODY_LINE}")).alias("message"))),
        lambda f: F.regexp_extract(f["message"], " is ([0-9]+) ", 1).cast("int") > dims.MAX_BODY_LINE,
    )
    total = F.char_length(m["body"])
    trailer = tool_trailer(raw, m["footers"])
    usual = F.concat(
        hit(n == 0, "commit-emoji-required", "commit message must start with an emoji (:shortcode:)"),
        hit(n > dims.MAX_EMOJIS, "commit-emoji-count", f"too many leading emojis (max {dims.MAX_EMOJIS})"),
        hit(m["type"] == "", "commit-type-required", "commit message must have a Conventional Commit type"),
        hit((m["type"] != "") & ~m["type"].isin(*dims.ALLOWED_TYPES), "commit-type-enum", F.concat(F.lit("type '"), m["type"], F.lit("' is not allowed; use one of: " + ", ".join(dims.ALLOWED_TYPES)))),
        hit((m["scope"] != "") & ~m["scope"].rlike(r"\A[A-Za-z0-9_-]*\z"), "commit-scope-charset", "scope must be ASCII alphanumeric with - or _ separators only"),
        hit(desc == "", "commit-desc-required", "commit message must have a description"),
        hit(length > dims.MAX_SUBJECT, "commit-desc-length", F.concat(F.lit("subject is "), length, F.lit(f" chars, max {dims.MAX_SUBJECT}"))),
        hit((desc != "") & ~desc.rlike(r"^\p{Lu}") & ~m["is_wip"], "commit-desc-capitalize", "description must start with a capital letter"),
        hit(desc.endswith("."), "commit-desc-no-period", "description must not end with a period"),
        long_lines,
        hit(total > dims.MAX_BODY, "commit-body-total-length", F.concat(F.lit("body is "), total, F.lit(f" chars, max {dims.MAX_BODY}; keep it short or use a subject-only commit"))),
        hit(trailer != "", "commit-no-coauthor", F.concat(F.lit("tool-attribution trailer '"), trailer, F.lit("' is not allowed; remove it before committing"))),
    )
    return F.when(is_initial, initial).when(is_merge, merge).otherwise(usual)


def leading_emoji(subject: Column) -> Column:
    return F.regexp_extract(trim_space(subject), r"^:([^: \t]+):", 1)


def branch_problem(branch: Column, extra: tuple[str, ...] = ()) -> Column:
    """Null where a branch name is exempt or fine, else what is wrong."""
    types = sorted({*dims.ALLOWED_TYPES, *dims.GITFLOW_TYPES, *extra})
    kind = F.regexp_extract(branch, r"(?s)^([^/(]*)(?:\([^/]*\))?/.+$", 1)
    return F.when(branch.isin("", "main", "master", "develop") | branch.isNull(), F.lit(None).cast("string")).when(kind == "", F.lit("shape")).when(~kind.isin(*types), F.lit("type"))
