"""Checks over a ``files`` table: path, ext, is_test, content.

Each is DataFrame -> DataFrame of rows keyed by path. Only rows that a regex prefilter admits are exploded, and only small hit rows are
windowed (partitioned by path, so a repository or folder of any size stays spread).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galleyproof import dims
from galleyproof.functions import text as X

FINDING = ["analyzer_id", "severity", "category", "file", "line", "message", "suggestion"]


def eligible(files: DataFrame, *extensions: str) -> DataFrame:
    """Readable files out of testdata folders, of the given extensions (all by default)."""
    kept = files.filter(F.col("content").isNotNull() & ~F.array_contains(F.split("path", "/"), "testdata"))
    return kept.filter(F.lower("ext").isin(*extensions)) if extensions else kept


def walk_filter(files: DataFrame) -> DataFrame:
    """Files below none of the skipped folders, extension lower-cased."""
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    return files.filter(~F.arrays_overlap(folders, F.array(*map(F.lit, dims.SKIPPED_FOLDERS)))).withColumn("ext", F.lower("ext"))


def lines(files: DataFrame) -> DataFrame:
    """path, line_no (from 1), line; a text that ends with a line break has an empty last line."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def mark_scan(files: DataFrame) -> DataFrame:
    """path, code_point, mark_class, mark_name, byte_offset, line of every flagged code point."""
    spark = files.sparkSession
    # possessive and anchored at the last match: linear, also in a long text behind the last mark
    segments = F.regexp_extract_all("content", F.lit(f"\\G({X.NO_MARK}*+)({X.MARK})"), 0)
    marked = files.filter(F.col("content").rlike(X.MARK)).select("path", "content", segments.alias("segments"))
    tail = F.expr("substring(content, aggregate(segments, 1, (a, x) -> a + char_length(x)), 1)")
    hit = marked.select("path", F.posexplode("segments").alias("ord", "segment"), tail.alias("tail"))
    mark = F.substring("segment", -1, 1)
    hit = hit.select("path", "ord", "tail", mark.alias("mark"), F.octet_length("segment").alias("bytes"), X.newlines(F.col("segment")).alias("breaks"), F.substring("segment", 1, 1).alias("head"), F.when(F.char_length("segment") > 1, F.substring("segment", -2, 1)).alias("before"))
    order = W.partitionBy("path").orderBy("ord")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    hit = hit.select(
        "path",
        "mark",
        F.expr("ascii(mark)").alias("code_point"),
        (F.sum("bytes").over(so_far) - F.octet_length("mark")).cast("long").alias("byte_offset"),
        (F.sum("breaks").over(so_far) + 1).cast("long").alias("line"),
        F.coalesce("before", F.lag("mark").over(order)).alias("before"),
        F.coalesce(F.lead("head").over(order), F.nullif("tail", F.lit(""))).alias("after"),
    )
    named = hit.join(F.broadcast(dims.mark_names(spark)), "code_point", "left")
    within = lambda ranges: F.expr(" or ".join(f"code_point between {a} and {b}" for a, b in ranges))
    joined = F.col("code_point").isin(*dims.JOINERS) & F.coalesce(F.expr("ascii(before) < 127 and ascii(after) < 127"), F.lit(False))
    ranged = within(dims.TAG_RANGES) | within(dims.PRIVATE_RANGES) | within(dims.SELECTOR_RANGES)
    kind = F.when(joined, dims.STRIP).otherwise(F.coalesce("named_class", F.when(ranged, dims.CONTEXTUAL).otherwise(dims.STRIP)))
    name = F.when(within(dims.TAG_RANGES), "tag character").when(within(dims.PRIVATE_RANGES), "private use character").when(within(dims.SELECTOR_RANGES), "variation selector").otherwise("unnamed format character")
    return named.select("path", "code_point", kind.cast("int").alias("mark_class"), F.coalesce("mark_name", name).alias("mark_name"), "byte_offset", "line")


def _mark_message():
    return F.format_string("%s (U+%04X)", "mark_name", "code_point")


def mark_findings(files: DataFrame) -> DataFrame:
    """Carriers (errors) and contextual marks (warnings) of .go and .md files."""
    marks = mark_scan(eligible(files, ".go", ".md")).filter(F.col("mark_class") != dims.TYPOGRAPHIC)
    soft = F.col("mark_class") == dims.CONTEXTUAL
    advice = F.when(soft, "it may be load-bearing here; judge it, then remove it by hand").otherwise("run the clean sink with write, which removes this class")
    return marks.select(F.lit("text-markers").alias("analyzer_id"), F.when(soft, dims.WARNING).otherwise(dims.ERROR).alias("severity"), F.lit("syntax").alias("category"), F.col("path").alias("file"), "line", _mark_message().alias("message"), advice.alias("suggestion"), "byte_offset")


#: A fenced block, a run of lines without backticks, or one other line; laid end to end they are the whole text.
PIECE = (
    r"[ \t]*+(`{3,}+|~{3,}+)[^\n]*+(?:\n(?![ \t]*+\1)[^\n]*+)*+(?:\n[ \t]*+\1[^\n]*+)?+\n?"
    r"|(?:(?![ \t]*+~{3})[^\n`]*+\n)++|[^\n]++\n?"
)


def code_regions(files: DataFrame) -> DataFrame:
    """path, start, end (bytes): fenced blocks and inline code spans of markdown.

    A fence is three or more backticks or tildes; its like, as long or longer, closes it; an unclosed one runs to the end.
    """
    pieces = F.regexp_extract_all("content", F.lit(PIECE), 0)
    rows = files.select("path", F.posexplode(pieces).alias("pos", "line")).withColumn("bytes", F.octet_length("line").cast("long"))
    before = W.partitionBy("path").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    found = rows.withColumns({"at": F.coalesce(F.sum("bytes").over(before), F.lit(0)), "fenced": F.col("line").rlike(r"\A[ \t]*(`{3}|~{3})")}).filter(F.col("fenced") | F.col("line").contains("`"))
    fenced = found.filter("fenced").select("path", F.col("at").alias("start"), (F.col("at") + F.col("bytes")).alias("end"))
    spans = F.regexp_extract_all("line", F.lit(r"((?:.*?)(?<!`))(`+)(?!`)(.*?)(?<!`)\2(?!`)"), 0)
    inline = found.filter("not fenced").select("path", "at", F.posexplode(spans).alias("ord", "part"))
    inline = inline.withColumn("stop", F.sum(F.octet_length("part")).over(W.partitionBy("path", "at").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)))
    code = F.regexp_extract("part", r"^(?:.*?)(?<!`)((`+)(?!`)(.*?)(?<!`)\2)(?!`)$", 1)
    return fenced.unionByName(inline.select("path", (F.col("at") + F.col("stop") - F.octet_length(code)).alias("start"), (F.col("at") + F.col("stop")).alias("end")))


def typographic_findings(files: DataFrame) -> DataFrame:
    """Typographic marks, in markdown only those outside code."""
    marks = mark_scan(eligible(files, ".go", ".md")).filter(F.col("mark_class") == dims.TYPOGRAPHIC)
    code = code_regions(eligible(files, ".md")).withColumnRenamed("path", "md")
    outside = marks.join(code, (F.col("path") == F.col("md")) & (F.col("byte_offset") >= F.col("start")) & (F.col("byte_offset") < F.col("end")), "left_anti")
    return outside.select(F.lit("typographic-markers").alias("analyzer_id"), F.lit(dims.ERROR).alias("severity"), F.lit("syntax").alias("category"), F.col("path").alias("file"), "line", _mark_message().alias("message"), F.lit("replace it with the ASCII form by hand").alias("suggestion"), "byte_offset")


def frontmatter_findings(files: DataFrame) -> DataFrame:
    """Top-level frontmatter keys of markdown that name a generating machine."""
    rows = eligible(files, ".md").select("path", X.frontmatter(F.col("content")).alias("block")).filter("block is not null")
    rows = rows.select("path", F.posexplode(F.split(F.regexp_replace("block", r"\n\z", ""), "\n")).alias("k", "entry"))
    key = F.lower(X.trim_space(F.regexp_extract("entry", r"^([^:\s-][^:]*):", 1)))
    hit = rows.select("path", (F.col("k") + 2).cast("long").alias("line"), key.alias("key")).filter(F.col("key").isin(*dims.PROVENANCE_KEYS))
    return hit.select(F.lit("ai-frontmatter").alias("analyzer_id"), F.lit(dims.ERROR).alias("severity"), F.lit("syntax").alias("category"), F.col("path").alias("file"), "line", "key")


def file_size(files: DataFrame, max_lines: int = dims.MAX_LINES) -> DataFrame:
    limit = F.when(F.col("is_test"), round(max_lines * dims.TEST_LINE_FACTOR)).otherwise(max_lines)
    sized = eligible(files, ".go").select("path", X.newlines(F.col("content")).alias("lines"), limit.alias("limit")).filter("lines > limit")
    return sized.select(F.lit("file-size").alias("analyzer_id"), F.lit(dims.WARNING).alias("severity"), F.lit("project").alias("category"), F.col("path").alias("file"), F.lit(0).cast("long").alias("line"), F.format_string("file is %d lines, max %d", "lines", "limit").alias("message"))


def top_of_file(files: DataFrame, *extensions: str) -> DataFrame:
    """Files whose first line that is not blank is a comment, and not an exempt header."""
    first = F.expr("filter(transform(split(content, '\\n'), (x, i) -> named_struct('line', x, 'line_no', i + 1L)), s -> not s.line rlike '^(?U:\\\\s)*$')[0]")
    rows = eligible(files, *(extensions or (".go",))).select("path", first.alias("f")).filter("f is not null")
    return rows.filter(X.is_comment(F.col("f.line")) & ~X.is_exempt_header(F.col("f.line"))).select(F.col("path").alias("file"), F.col("f.line_no").alias("line"))


def _runs(rows: DataFrame, test) -> DataFrame:
    """Lines that pass the test, with the number of their run: gaps and islands."""
    hit = rows.filter(test)
    return hit.withColumn("run", F.col("line_no") - F.row_number().over(W.partitionBy("path").orderBy("line_no")))


def big_comment(files: DataFrame, max_lines: int = dims.MAX_COMMENT_LINES, *extensions: str) -> DataFrame:
    """Comment runs longer than the limit; a run that starts with an exempt header is free."""
    runs = _runs(lines(eligible(files, *(extensions or (".go",)))), X.is_comment(F.col("line")))
    blocks = runs.groupBy("path", "run").agg(F.min("line_no").cast("long").alias("line"), F.count("*").alias("n"), F.min_by(X.is_exempt_header(F.col("line")), "line_no").alias("exempt"))
    return blocks.filter((F.col("n") > max_lines) & ~F.col("exempt")).select(F.col("path").alias("file"), "line", F.concat(F.lit("comment block is "), "n", F.lit(f" lines, max {max_lines}")).alias("message"))


def simplification_path(files: DataFrame) -> DataFrame:
    """Comment runs with a simplification marker whose rest names no way back; later markers of a run count as its rest."""
    comment = X.trim_space(F.regexp_replace(X.trim_space(F.col("line")), "^//", ""))
    runs = _runs(lines(eligible(files, ".go")), X.trim_space(F.col("line")).startswith("//"))
    runs = runs.select("path", "run", "line_no", comment.alias("comment"))
    marker = F.when(F.col("comment").startswith("simplification:"), F.col("line_no"))
    runs = runs.withColumn("first", F.min(marker).over(W.partitionBy("path", "run"))).filter("line_no >= first")
    text = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "comment"))), lambda s: s["comment"]), " "))
    blocks = runs.groupBy("path", "run").agg(F.min("first").cast("long").alias("line"), text.alias("block"))
    return blocks.filter(~F.col("block").contains("upgrade path:") & ~F.col("block").contains("revisit when")).select(F.col("path").alias("file"), "line")


def suppress_generated(findings: DataFrame, files: DataFrame, include: bool = False) -> DataFrame:
    """``findings`` with a column ``suppressed``: those in generated files, unless these are included."""
    if include:
        return findings.withColumn("suppressed", F.lit(False))
    made = files.filter(X.is_generated(F.col("content"))).select(F.col("path").alias("file"), F.lit(True).alias("suppressed"))
    return findings.join(made, "file", "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))


def clean_files(files: DataFrame) -> DataFrame:
    """path, skip_reason (null where cleaned), cleaned, n_acted, n_remaining."""
    cap = dims.CLEAN_BYTES
    reason = (
        F.when(~F.lower("ext").isin(".go", ".md"), "extension")
        .when(F.array_contains(F.split("path", "/"), "testdata"), "testdata")
        .when(F.col("content").isNull(), "unreadable")
        .when(F.octet_length("content") > cap, "too large")
    )
    removable = f"({X.FLANKED_JOINER}|{X.STRIPPED}|{X.SPACED})"
    any_mark = F.regexp_count("content", F.lit(X.MARK))
    acted = F.regexp_count("content", F.lit(removable))
    out = files.select("path", reason.alias("skip_reason"), "content")
    use = F.col("skip_reason").isNull()
    return out.select("path", "skip_reason", F.when(use, X.clean(F.col("content"))).alias("cleaned"), F.when(use, acted).otherwise(0).cast("long").alias("n_acted"), F.when(use, any_mark - acted).otherwise(0).cast("long").alias("n_remaining"))
