"""Queries on files and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleyproof import dims
from galleyproof.functions import text as X
from galleyproof.operators import files as O
from galleyproof.operators import findings as N
from galleyproof.plans.carriers import DOC_CODE, DOC_FILES, doc_code, doc_files, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


_ANY = X.ANY_MARK
_NAMES = "(values " + ", ".join(f"({c}, {k}, '{n}')" for c, k, n in dims.named_marks()) + ") as names(code_point, named_class, named)"
_R = lambda ranges: "(" + " or ".join(f"u between {a} and {b}" for a, b in ranges) + ")"
#: Marks of doc_files: one row for each code point that counts.
MARKS = f"""segs as (select path, ext, is_test, content, unnest(regexp_extract_all(content, '(?s)[^{_ANY}]*[{_ANY}]')) as seg,
 generate_subscripts(regexp_extract_all(content, '(?s)[^{_ANY}]*[{_ANY}]'), 1) as ord from doc_files),
chars as (select path, ord, seg, seg[-1] as mark, unicode(seg[-1]) as u, case when length(seg) > 1 then seg[-2] else lag(seg[-1]) over w end as before,
 coalesce(lead(seg[1]) over w, nullif(regexp_extract(content, '[^{_ANY}]*$'), '')[1]) as after,
 sum(strlen(seg)) over (w rows between unbounded preceding and current row) - strlen(seg[-1]) as byte_offset,
 sum(length(seg) - length(replace(seg, chr(10), ''))) over (w rows between unbounded preceding and current row) + 1 as line
 from segs window w as (partition by path order by ord)),
marks as (select path, u::int as code_point, (case when u in (8204, 8205) and coalesce(unicode(before) < 127 and unicode(after) < 127, false) then 0
 else coalesce(named_class, case when {_R(dims.TAG_RANGES + dims.PRIVATE_RANGES + dims.SELECTOR_RANGES)} then 2 else 0 end) end)::int as mark_class,
 coalesce(named, case when {_R(dims.TAG_RANGES)} then 'tag character' when {_R(dims.PRIVATE_RANGES)} then 'private use character'
 when {_R(dims.SELECTOR_RANGES)} then 'variation selector' else 'unnamed format character' end) as mark_name, byte_offset::bigint as byte_offset, line::bigint as line
 from chars left join {_NAMES} on u = code_point)"""


@query(f"with {DOC_FILES}, {MARKS} select path, code_point, mark_class, mark_name, byte_offset, line from marks")
def mark_scan(spark, sf_dir):
    return O.mark_scan(doc_files(spark, sf_dir))


_FIND = """findings as (select 'text-markers' as analyzer_id, case mark_class when 2 then 1 else 2 end as severity, path as file, line,
 mark_name || printf(' (U+%04X)', code_point) as message, byte_offset from marks where mark_class <> 3 and not list_contains(string_split(path, '/'), 'testdata'))"""


@query(f"with {DOC_FILES}, {MARKS}, {_FIND} select * from findings")
def mark_findings(spark, sf_dir):
    return O.mark_findings(doc_files(spark, sf_dir)).select("analyzer_id", "severity", "file", "line", "message", "byte_offset")


def _findings(spark, sf_dir):
    found = O.mark_findings(doc_files(spark, sf_dir))
    # ties keep the order of emission
    return found.withColumn("seq", F.col("byte_offset")).drop("byte_offset")


@query(
    f"""with {DOC_FILES}, {MARKS}, {_FIND}, seen as (select *, lag(row(analyzer_id, file, line, message)) over (order by severity desc, file, line, byte_offset) as before from findings)
 select severity, file, line, message, byte_offset as seq from seen where before is distinct from row(analyzer_id, file, line, message)"""
)
def findings_ordered_deduped(spark, sf_dir):
    return N.ordered(N.dedupe_adjacent(_findings(spark, sf_dir))).select("severity", "file", "line", "message", "seq")


@query(f"with {DOC_FILES}, {MARKS}, {_FIND} select count(*) filter (severity = 2) as errors, count(*) filter (severity = 1) as warnings, count(*) filter (severity = 0) as infos, case when count(*) filter (severity = 2) > 0 then 1 else 0 end as exit_code from findings")
def severity_counts(spark, sf_dir):
    return N.severity_counts(_findings(spark, sf_dir))


_RULES = [("effective-go", "Write it plainly. Then stop e.g. here."), ("commits", "One change per commit.")]


def _injected(spark, sf_dir):
    found = _findings(spark, sf_dir).withColumn("rule_id", F.when(F.col("seq") % 3 == 0, "commits").otherwise("")).withColumn("rule_summary", F.when(F.col("seq") % 6 == 0, "own").otherwise(""))
    return N.inject_rules(found, spark.createDataFrame(_RULES, "id string, summary string"))


_INJECT = """injected as (select *, byte_offset as seq, case when byte_offset % 3 = 0 then 'commits' else 'effective-go' end as rule_id,
 case when byte_offset % 6 = 0 then 'own' when byte_offset % 3 = 0 then 'One change per commit.' else 'Write it plainly. Then stop e.g. here.' end as rule_summary from findings)"""


@query(f"with {DOC_FILES}, {MARKS}, {_FIND}, {_INJECT} select file, line, seq, rule_id, rule_summary from injected")
def rule_injection(spark, sf_dir):
    return _injected(spark, sf_dir).select("file", "line", "seq", "rule_id", "rule_summary")


@query(
    f"""with {DOC_FILES}, {MARKS}, {_FIND}, {_INJECT} select file, line, seq, '[' || case severity when 2 then 'ERROR' else 'WARNING' end || '] ' || analyzer_id || ': ' || message || ' (' || file || ':' || line || ')' ||
 chr(10) || '  ' || chr(8594) || ' ' || case severity when 1 then 'it may be load-bearing here; judge it, then remove it by hand' else 'run the clean sink with write, which removes this class' end ||
 chr(10) || '  rule: ' || case rule_summary when 'own' then 'own' when 'One change per commit.' then rule_summary else 'Write it plainly.' end as text from injected"""
)
def formatted_findings(spark, sf_dir):
    return N.formatted(_injected(spark, sf_dir)).select("file", "line", "seq", "text")


_STRIP = "".join(f"\\x{{{c:X}}}" for c in dims.STRIP_MARKS)
_SPACES = "".join(f"\\x{{{c:X}}}" for c in dims.SPACE_MARKS)
# the oracle has no look-around: a joiner between ASCII neighbours is found by its neighbours
_JOINER = "regexp_replace({}, '([\\x00-\\x7E])[\\x{{200C}}\\x{{200D}}]([\\x00-\\x7E])', '\\1\\2', 'g')"
# twice, as a match takes its neighbours with it
_CLEANED = f"regexp_replace(regexp_replace({_JOINER.format(_JOINER.format('content'))}, '[{_STRIP}]', '', 'g'), '[{_SPACES}]', ' ', 'g')"


@query(f"with {DOC_FILES} select path, sha256({_CLEANED}) as cleaned_sha256 from doc_files")
def mark_clean(spark, sf_dir):
    return doc_files(spark, sf_dir).select("path", F.sha2(X.clean(F.col("content")), 256).alias("cleaned_sha256"))


@query(
    f"""with {DOC_FILES}, {MARKS}, acted as (select path, count(*) filter (mark_class < 2) as a, count(*) filter (mark_class >= 2) as r from marks group by path)
 select sum(coalesce(a, 0))::bigint as acted, sum(coalesce(r, 0))::bigint as remaining, count(*) as files from doc_files left join acted using (path)"""
)
def clean_totals(spark, sf_dir):
    return O.clean_files(doc_files(spark, sf_dir)).agg(F.sum("n_acted").alias("acted"), F.sum("n_remaining").alias("remaining"), F.count("*").alias("files"))


@query(
    f"""with {DOC_FILES}, odd as (select case when doc_id % 9 = 0 then replace(path, '/', '/testdata/') else path end as path, case when doc_id % 8 = 0 then '.txt' else ext end as ext,
 case when doc_id % 7 = 0 then repeat('x', 1048577) when doc_id % 11 = 0 then null else content end as content from doc_files)
 select path, case when ext not in ('.go', '.md') then 'extension' when list_contains(string_split(path, '/'), 'testdata') then 'testdata' when content is null then 'unreadable'
 when strlen(content) > 1048576 then 'too large' end as skip_reason from odd"""
)
def clean_skip_reason(spark, sf_dir):
    f, k = doc_files(spark, sf_dir), F.col("doc_id")
    odd = f.withColumn("path", F.when(k % 9 == 0, F.replace("path", F.lit("/"), F.lit("/testdata/"))).otherwise(F.col("path"))).withColumn("ext", F.when(k % 8 == 0, ".txt").otherwise(F.col("ext")))
    odd = odd.withColumn("content", F.when(k % 7 == 0, F.repeat(F.lit("x"), 1048577)).when(k % 11 == 0, F.lit(None)).otherwise(F.col("content")))
    return O.clean_files(odd).select("path", "skip_reason")


@query(
    f"""with {DOC_CODE} select 'file-size' as analyzer_id, path as file, printf('file is %d lines, max %d', n, lim) as message from
 (select path, length(content) - length(replace(content, chr(10), '')) as n, case when is_test then 8 else 3 end as lim from doc_code where ext = '.go') where n > lim"""
)
def file_size(spark, sf_dir):
    return O.file_size(doc_code(spark, sf_dir), 3).select("analyzer_id", "file", "message")


_LINES = """lines as (select path, ext, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as line_no from doc_code)"""
_EXEMPT = "(regexp_full_match(trim(line), '// Code generated .* DO NOT EDIT\\.') or trim(line) like '//go:build%' or trim(line) like '// +build%')"
_COMMENT = "regexp_matches(line, '^\\s*(//|/\\*|\\*)')"


@query(
    f"""with {DOC_CODE}, {_LINES}, first as (select path, arg_min(line, line_no) as line, min(line_no) as line_no from lines where ext = '.go' and not regexp_full_match(line, '\\s*') group by path)
 select path as file, line_no::bigint as line from first where {_COMMENT} and not {_EXEMPT}"""
)
def top_of_file(spark, sf_dir):
    return O.top_of_file(doc_code(spark, sf_dir))


@query(
    f"""with {DOC_CODE}, {_LINES}, hit as (select *, line_no - row_number() over (partition by path order by line_no) as run, {_EXEMPT} as ex from lines where ext = '.go' and {_COMMENT})
 select path as file, min(line_no)::bigint as line, 'comment block is ' || count(*) || ' lines, max 5' as message from hit group by path, run having count(*) > 5 and not arg_min(ex, line_no)"""
)
def big_comment(spark, sf_dir):
    return O.big_comment(doc_code(spark, sf_dir))


@query(
    f"""with {DOC_CODE}, {_LINES}, hit as (select path, line_no, trim(substr(trim(line), 3)) as c, line_no - row_number() over (partition by path order by line_no) as run from lines where ext = '.go' and trim(line) like '//%'),
 m as (select *, min(case when starts_with(c, 'simplification:') then line_no end) over (partition by path, run) as f from hit),
 b as (select path, min(f) as f, lower(string_agg(c, ' ' order by line_no)) as block from m where line_no >= f group by path, run)
 select path as file, f::bigint as line from b where not contains(block, 'upgrade path:') and not contains(block, 'revisit when')"""
)
def simplification_path(spark, sf_dir):
    return O.simplification_path(doc_code(spark, sf_dir))


@query(
    f"""with {DOC_CODE} select count(*) filter (gen) as suppressed, count(*) filter (not gen) as kept from (select d.doc_id % 6 = 0 as gen from doc_code d
 where d.ext = '.go' and length(content) - length(replace(content, chr(10), '')) > case when is_test then 8 else 3 end)"""
)
def generated_suppression(spark, sf_dir):
    code = doc_code(spark, sf_dir)
    out = O.suppress_generated(O.file_size(code, 3), code)
    return out.agg(F.count_if("suppressed").alias("suppressed"), F.count_if(~F.col("suppressed")).alias("kept"))


@query(f"with {DOC_FILES} select path as file, 2::bigint as line, 'generator' as key from doc_files where ext = '.md' and doc_id % 5 = 0")
def frontmatter_keys(spark, sf_dir):
    return O.frontmatter_findings(doc_files(spark, sf_dir)).select("file", "line", "key")


@query("select doc_id, sha256(coalesce(nullif(regexp_extract(text, '(?s)^(.*?\\.)(\\s|$)', 1), ''), text)) as sentence_sha256 from documents")
def first_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.first_sentence(F.col("text")), 256).alias("sentence_sha256"))


@query(
    f"""with {DOC_CODE}, {_LINES}, q as (select path, line_no, trim(substr(trim(line), 2)) as t, line_no - row_number() over (partition by path order by line_no) as run from lines where trim(line) like '>%'),
 f as (select *, min(run) over (partition by path) as r0 from q) select d.path, coalesce(b.quote, '') as quote from doc_code d left join
 (select path, string_agg(t, ' ' order by line_no) filter (t <> '') as quote from f where run = r0 group by path) b using (path)"""
)
def first_blockquote(spark, sf_dir):
    return doc_code(spark, sf_dir).select("path", X.first_blockquote(F.col("content")).alias("quote"))


@query("select doc_id, list_has_any(string_split_regex(lower(text), '[^a-z0-9]+'), ['the', 'und']) as has_word, len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: starts_with(w, 'inten') or starts_with(w, 'lich'))) > 0 as starts from documents")
def theme_match(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", (X.has_word(c, "the") | X.has_word(c, "und")).alias("has_word"), (X.starts_any(c, F.lit("inten")) | X.starts_any(c, F.lit("lich"))).alias("starts"))


# The made lines hold their code at fixed places: of three dashes one is prose, that at byte 10. Fences are all of one length.
@query(
    f"""with {DOC_CODE}, {MARKS.replace("doc_files", "doc_code")}, lines as (select path, ext, unnest(string_split(content, chr(10))) as t, generate_subscripts(string_split(content, chr(10)), 1) as line from doc_code),
 placed as (select *, coalesce(sum(strlen(t) + 1) over w, 0) as start, count(*) filter (t = '```') over w % 2 = 1 as inside from lines window w as (partition by path order by line rows between unbounded preceding and 1 preceding))
 select m.path as file, m.line, mark_name || printf(' (U+%04X)', code_point) as message, byte_offset from marks m join placed p on p.path = m.path and p.line = m.line
 where mark_class = 3 and (ext = '.go' or (not inside and t <> '```' and (t <> 'a `b' || chr(8212) || 'c` ' || chr(8212) || ' ``d`' || chr(8212) || '`` e' or byte_offset - start = 10)))"""
)
def typographic_outside_code(spark, sf_dir):
    return O.typographic_findings(doc_code(spark, sf_dir)).select("file", "line", "message", "byte_offset")


@query(
    f"""with {DOC_CODE}, diffs as (select path, '--- a' || chr(10) || '+++ b' || chr(10) || case doc_id % 4 when 0 then '+import "fmt"' || chr(10) || '-)' when 1 then '+package a' || chr(10) || ' kept' when 2 then '+x := 1' else '' end as diff, doc_id from doc_code)
 select path, doc_id % 4 <> 2 as import_only from diffs"""
)
def import_only_diff(spark, sf_dir):
    k = F.col("doc_id")
    body = F.when(k % 4 == 0, '+import "fmt"\n-)').when(k % 4 == 1, "+package a\n kept").when(k % 4 == 2, "+x := 1").otherwise("")
    return doc_code(spark, sf_dir).select("path", X.import_only(F.concat(F.lit("--- a\n+++ b\n"), body)).alias("import_only"))


@query(f"with {DOC_FILES} select sha256(string_agg(path || chr(0) || sha256(content) || chr(10), '' order by string_split(path, '/'))) as fingerprint, count(*) as files from doc_files")
def fingerprint(spark, sf_dir):
    from galleyproof.sources.trees import fingerprint as make

    return make(doc_files(spark, sf_dir))


@query(
    """with p as (select props, regexp_extract(props, '[0-9]+') as v, event_id from events), q as (select event_id, case event_id % 6 when 0 then v when 1 then v || '.75' when 2 then '-' || v when 3 then ' ' || v when 4 then 'eight' else '+' || v end as raw from p)
 select event_id, case when regexp_full_match(raw, '[+-]?[0-9]+(\\.[0-9]+)?') and trunc(raw::double) > 0 then trunc(raw::double)::bigint else 180 end as as_int from q"""
)
def param_coercion(spark, sf_dir):
    k, v = F.col("event_id"), F.regexp_extract("props", "[0-9]+", 0)
    raw = F.when(k % 6 == 0, v).when(k % 6 == 1, F.concat(v, F.lit(".75"))).when(k % 6 == 2, F.concat(F.lit("-"), v)).when(k % 6 == 3, F.concat(F.lit(" "), v)).when(k % 6 == 4, "eight").otherwise(F.concat(F.lit("+"), v))
    return table(spark, sf_dir, "events").select("event_id", X.param_int(raw, 180).alias("as_int"))
