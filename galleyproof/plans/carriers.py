"""Reference-shaped tables made from the driver's tables, in Spark and as DuckDB views' text.

Marks, comments, fences and messages are put in by the same rule on both sides, so that no check passes on an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = (
        F.when(F.col("doc_id") % 4 == 0, F.replace("text", F.lit(". "), F.lit(". ")))
        .when(F.col("doc_id") % 4 == 1, F.replace("text", F.lit(" the "), F.lit(" th​e ")))
        .when(F.col("doc_id") % 4 == 2, F.replace(F.replace("text", F.lit(" of "), F.lit("—")), F.lit(" de "), F.lit(" d‍e‍ ")))
        .otherwise(F.col("text"))
    )
    content = F.concat(F.when(F.col("doc_id") % 5 == 0, "---\ngenerator: x\ntitle: y\n---\n").otherwise(""), content, F.when(F.col("doc_id") % 3 == 0, "️⁪\U000e0041 end").otherwise(""))
    ext = F.when(F.col("lang") == "en", ".md").otherwise(".go")
    path = F.concat(F.lit("docs/"), "source", F.lit("/"), "doc_id", ext)
    return docs.select("doc_id", path.alias("path"), ext.alias("ext"), (F.col("doc_id") % 10 == 0).alias("is_test"), content.alias("content"))


DOC_FILES = """doc_files as (select doc_id, 'docs/' || source || '/' || doc_id || case when lang = 'en' then '.md' else '.go' end as path,
 case when lang = 'en' then '.md' else '.go' end as ext, doc_id % 10 = 0 as is_test,
 case when doc_id % 5 = 0 then '---' || chr(10) || 'generator: x' || chr(10) || 'title: y' || chr(10) || '---' || chr(10) else '' end ||
 case doc_id % 4 when 0 then replace(text, '. ', '.' || chr(160)) when 1 then replace(text, ' the ', ' th' || chr(8203) || 'e ')
 when 2 then replace(replace(text, ' of ', chr(8212)), ' de ', ' d' || chr(8205) || 'e' || chr(8205) || ' ') else text end ||
 case when doc_id % 3 = 0 then chr(57344) || chr(65039) || chr(8298) || chr(917569) || ' end' else '' end as content from documents)"""


def doc_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source: comment runs by line number, markers, generated headers, fences and inline code."""
    docs = table(spark, sf_dir, "documents")
    body = F.expr(
        """transform(split(text, '\\n'), (x, i) -> case
        when (i + doc_id) % 11 = 3 then '// simplification: short'
        when (i + doc_id) % 11 = 5 and doc_id % 2 = 0 then '// Upgrade path: later'
        when (i + doc_id) % 11 between 1 and 7 then '// ' || x
        when (i + doc_id) % 13 = 9 then '```'
        when (i + doc_id) % 17 = 12 then 'a `b—c` — ``d`—`` e'
        when (i + doc_id) % 19 = 4 then '> ' || x
        else x end)"""
    )
    head = F.when(F.col("doc_id") % 6 == 0, "// Code generated by x. DO NOT EDIT.\n").when(F.col("doc_id") % 6 == 1, "/*\n// Code generated by x. DO NOT EDIT.\n*/\n").when(F.col("doc_id") % 6 == 2, "\n//go:build linux\n").otherwise("")
    ext = F.when(F.col("doc_id") % 2 == 0, ".go").otherwise(".md")
    return docs.select("doc_id", F.concat(F.lit("src/"), "source", F.lit("/"), "doc_id", ext).alias("path"), ext.alias("ext"), (F.col("doc_id") % 10 == 0).alias("is_test"), F.concat(head, F.array_join(body, "\n")).alias("content"))


DOC_CODE = """doc_code as (select doc_id, 'src/' || source || '/' || doc_id || case when doc_id % 2 = 0 then '.go' else '.md' end as path,
 case when doc_id % 2 = 0 then '.go' else '.md' end as ext, doc_id % 10 = 0 as is_test,
 case doc_id % 6 when 0 then '// Code generated by x. DO NOT EDIT.' || chr(10) when 1 then '/*' || chr(10) || '// Code generated by x. DO NOT EDIT.' || chr(10) || '*/' || chr(10)
 when 2 then chr(10) || '//go:build linux' || chr(10) else '' end ||
 array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: case
 when (i - 1 + doc_id) % 11 = 3 then '// simplification: short'
 when (i - 1 + doc_id) % 11 = 5 and doc_id % 2 = 0 then '// Upgrade path: later'
 when (i - 1 + doc_id) % 11 between 1 and 7 then '// ' || x
 when (i - 1 + doc_id) % 13 = 9 then '```'
 when (i - 1 + doc_id) % 17 = 12 then 'a `b' || chr(8212) || 'c` ' || chr(8212) || ' ``d`' || chr(8212) || '`` e'
 when (i - 1 + doc_id) % 19 = 4 then '> ' || x else x end), chr(10)) as content from documents)"""

TYPES = ("feat", "fix", "Docs", "chore", "zap", "")
EMOJIS = ("bug", "wrench", "robot", "test_tube", "unknown_one", "fire", "", "ghost", "volcano")


def commit_msgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commits: repo, seq, subject (with body)."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    emoji = F.element_at(F.array(*map(F.lit, EMOJIS)), (F.col("event_id") * 7 % len(EMOJIS) + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("event_id") * 5 % len(TYPES) + 1).cast("int"))
    one = F.when(emoji == "", "").otherwise(F.concat(F.lit(":"), emoji, F.lit(": ")))
    prefix = F.when(F.col("event_id") % 23 == 0, F.concat(one, F.lit(":a::b: :c: "))).otherwise(one)
    scope = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("("), "event_type", F.lit(")"))).when(F.col("event_id") % 3 == 1, "").otherwise("(a b)")
    bang = F.when(F.col("event_id") % 5 == 0, "!").otherwise("")
    desc = F.when(F.col("event_id") % 4 == 0, F.initcap("event_type")).when(F.col("event_id") % 4 == 1, F.concat("event_type", F.lit("."))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("[wip] "), "event_type")).otherwise(F.repeat(F.lit("Long text "), 9))
    body = (
        F.when(F.col("event_id") % 6 == 0, "\n\nA body line\n\nmore of it\nCo-Authored-By: Some One <x@y.z>\nSecond #12")
        .when(F.col("event_id") % 6 == 1, F.concat(F.lit("\n\n"), F.repeat(F.lit("wide "), 35), F.lit("\nCloses: #4")))
        .when(F.col("event_id") % 6 == 2, "\nno blank line")
        .otherwise("")
    )
    raw = F.when(F.col("event_id") % 29 == 0, F.concat(one, F.lit("Merge branch x"))).when(F.col("event_id") % 31 == 0, F.concat(one, F.lit("Initial commit"))).otherwise(F.concat(prefix, kind, scope, bang, F.lit(": "), desc, body))
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("event_id", F.col("user_id").alias("repo"), F.row_number().over(order).alias("seq"), raw.alias("subject"))


def _pick(values, expr):
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({expr} % {len(values)} + 1)::int]"


COMMITS = f"""commit_parts as (select *, {_pick(EMOJIS, 'event_id * 7')} as em, {_pick(TYPES, 'event_id * 5')} as kind from events),
commit_msgs as (select event_id, user_id as repo, row_number() over (partition by user_id order by ts, event_id) as seq,
 case when event_id % 29 = 0 then one || 'Merge branch x' when event_id % 31 = 0 then one || 'Initial commit' else
 case when event_id % 23 = 0 then one || ':a::b: :c: ' else one end || kind ||
 case event_id % 3 when 0 then '(' || event_type || ')' when 1 then '' else '(a b)' end || case when event_id % 5 = 0 then '!' else '' end || ': ' ||
 case event_id % 4 when 0 then upper(event_type[1]) || lower(event_type[2:]) when 1 then event_type || '.' when 2 then '[wip] ' || event_type else repeat('Long text ', 9) end ||
 case event_id % 6 when 0 then chr(10) || chr(10) || 'A body line' || chr(10) || chr(10) || 'more of it' || chr(10) || 'Co-Authored-By: Some One <x@y.z>' || chr(10) || 'Second #12'
 when 1 then chr(10) || chr(10) || repeat('wide ', 35) || chr(10) || 'Closes: #4' when 2 then chr(10) || 'no blank line' else '' end end as subject
 from (select *, case when em = '' then '' else ':' || em || ': ' end as one from commit_parts))"""


def hook_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    mode = F.when(F.col("event_type") == "signup", "session-end").otherwise("prompt-submit")
    return e.select(F.when(F.col("user_id") % 7 == 0, "").otherwise(F.col("user_id").cast("string")).alias("session_id"), F.col("event_id").alias("seq"), mode.alias("mode"), F.col("event_type").alias("content"))


HOOKS = """hook_events as (select case when user_id % 7 = 0 then '' else user_id::varchar end as session_id, event_id as seq,
 case when event_type = 'signup' then 'session-end' else 'prompt-submit' end as mode, event_type as content from events)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package graph on nations: i -> (i * i + 3) % 25, and a chord."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("i"))
    return n.select(F.col("i").alias("src"), ((F.col("i") * F.col("i") + 3) % 25).alias("dst")).union(n.filter("i % 4 = 1").select("i", (F.col("i") + 7) % 25))


EDGES = """edges as (select n_nationkey::bigint as src, ((n_nationkey::bigint * n_nationkey + 3) % 25)::bigint as dst from nation
 union all select n_nationkey::bigint, ((n_nationkey + 7) % 25)::bigint from nation where n_nationkey % 4 = 1)"""
