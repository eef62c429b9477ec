"""Queries on composition, references, routing, evaluation and linter output."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleyproof.operators import knowledge as K
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


def _composed(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey"))), lambda s: s["l_partkey"])
    return li.groupBy(F.col("l_suppkey").alias("id")).agg(ids.alias("refs"))


_REFS = "refs as (select l_suppkey as holder, (row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) - 1)::int as ord, l_partkey as ref from lineitem)"


@query(f"with {_REFS} select holder, ord, ref from refs where ref not in (select p_partkey from part where p_size > 5)")
def dangling_refs(spark, sf_dir):
    parts = table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("id"))
    return K.dangling(_composed(spark, sf_dir), "refs", parts, "part").select("holder", "ord", "ref")


@query(f"with {_REFS} select holder as id, sha256(string_agg(p_name, chr(10) || chr(10) order by ord)) as text_sha256 from refs join part on ref = p_partkey where p_size > 5 group by holder")
def transclusion(spark, sf_dir):
    bodies = table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("body"))
    return K.transclude(_composed(spark, sf_dir), "refs", bodies).select("id", F.sha2("text", 256).alias("text_sha256"))


@query(f"with {_REFS} select holder, ref, min(ord) as ord from refs group by holder, ref")
def ordered_distinct(spark, sf_dir):
    rows = _composed(spark, sf_dir).select(F.col("id").alias("holder"), F.posexplode("refs").alias("ord", "ref"))
    return K.ordered_distinct(rows, "holder", "ref", "ord").select("holder", "ref", "ord")


@query("select p_partkey, p_name from part qualify row_number() over (partition by p_name order by p_partkey) > 1")
def duplicate_ids(spark, sf_dir):
    return K.duplicates(table(spark, sf_dir, "part"), "p_name", "p_partkey").select("p_partkey", "p_name")


@query("select s_suppkey as id, case s_suppkey % 3 when 0 then '' when 1 then 'x,y' else 'base' end as refs from supplier")
def profile_overlay(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    base = s.select(k.alias("id"), F.array(F.lit("base")).alias("refs"))
    profile = s.filter(k % 3 < 2).select(k.alias("id"), F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"), F.lit("y"))).alias("refs"))
    return K.overlay(base, profile.unionByName(s.filter(k % 3 == 2).select(k.alias("id"), F.lit(None).cast("array<string>").alias("refs"))), "refs").select("id", F.array_join("refs", ",").alias("refs"))


@query("select s_suppkey::varchar as analyzer_id, case when s_suppkey % 2 = 0 then false else true end as enabled, case when s_suppkey % 2 = 0 then 'preset' else 'base' end as v, s_suppkey % 2 = 1 as has_default from supplier")
def preset_overlay(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").withColumn("analyzer_id", k.cast("string"))
    base = s.select("analyzer_id", F.lit(True).alias("enabled"), F.create_map(F.lit("v"), F.lit("base"), F.lit("w"), F.lit("1")).alias("params"))
    preset = s.filter(k % 2 == 0).select("analyzer_id", F.lit(False).alias("enabled"), F.create_map(F.lit("v"), F.lit("preset"), F.lit("d"), F.lit("own")).alias("params"))
    defaults = s.select("analyzer_id", F.create_map(F.lit("d"), F.lit("default"), F.lit("v"), F.lit("default")).alias("defaults"))
    out = K.default_params(K.preset_overlay(base, preset), defaults)
    return out.select("analyzer_id", "enabled", F.col("params")["v"].alias("v"), (F.col("params")["d"] == "default").alias("has_default"))


@query(
    f"""with {DOC_FILES}, f as (select case when doc_id % 9 = 0 then 'x/' || doc_id || '_test.go' else path end as path, case when doc_id % 9 = 0 then '.go' else ext end as ext from doc_files),
 r as (select path, 0 as src, 1 as ord, 'go-core' as skill from f where ext = '.go' union all select path, 1, o, s from f join (values (1, '*.md files', 'writing'), (2, 'edit .go or .md', 'go-core'), (3, '.sql', 'db')) t(o, trig, s) on contains(trig, ext)
 union all select path, 2, 1, 'testing' from f where path like '%\\_test.go' escape '\\')
 select path, src, ord, skill from r qualify row_number() over (partition by path, skill order by src, ord) = 1"""
)
def file_routing(spark, sf_dir):
    f = doc_files(spark, sf_dir)
    odd = F.col("doc_id") % 9 == 0
    f = f.select(F.when(odd, F.concat(F.lit("x/"), "doc_id", F.lit("_test.go"))).otherwise(F.col("path")).alias("path"), F.when(odd, ".go").otherwise(F.col("ext")).alias("ext"))
    base = spark.createDataFrame([(1, "go-core")], "ord int, skill string")
    trig = spark.createDataFrame([(1, "*.md files", "writing"), (2, "edit .go or .md", "go-core"), (3, ".sql", "db")], "ord int, trigger string, skill string")
    disp = spark.createDataFrame([(1, "a test file", "testing"), (2, "latest thing", "none")], "ord int, signal string, skill string")
    return K.route(f, base, trig, disp)


_CHECKS = [
    {"id": "s1", "checks": [{"kind": "machine", "type": "contains", "pattern": "the"}, {"kind": "machine", "type": "regex_absent", "pattern": "[0-9]{2}"}, {"kind": "judge", "type": "", "pattern": ""}]},
    {"id": "s2", "checks": [{"kind": "machine", "type": "regex_match", "pattern": "^[A-Z]"}, {"kind": "machine", "type": "regex_match", "pattern": "(("}, {"kind": "machine", "type": "regex_absent", "pattern": "(("}, {"kind": "machine", "type": "odd", "pattern": "x"}, {"kind": "machine", "type": "not_contains", "pattern": "zz"}]},
]


@query(
    """with a as (select item_id as artifact, text from benchmark)
 select artifact, 's1' as scenario, (contains(text, 'the')::int + (not regexp_matches(text, '[0-9]{2}'))::int)::bigint as passed, 2::bigint as machine, 1::bigint as judge from a
 union all select artifact, 's2', (regexp_matches(text, '^[A-Z]')::int + 1 + (not contains(text, 'zz'))::int)::bigint, 5::bigint, 0::bigint from a"""
)
def eval_grade(spark, sf_dir):
    import copy

    checks = spark.createDataFrame(K.compilable(copy.deepcopy(_CHECKS)), "id string, checks array<struct<kind:string,type:string,pattern:string>>")
    return K.grade(checks, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("artifact"), "text"))


@query(
    """with s as (select c_custkey as ord, 'k' || c_custkey % 7 as skill, 'i' || c_custkey % 1000 as id, c_custkey % 4 = 0 as bp, c_custkey % 5 = 0 as bt, c_custkey % 6 as a from customer)
 select skill, id, ord, unnest(list_filter([case when skill in ('k5', 'k6') then 'unknown skill' end, case when row_number() over (partition by skill, id order by ord) > 1 then 'duplicate id' end, case when bp then 'blank prompt' end,
 case when bt then 'blank trap' end, case when a = 0 then 'no assertions' end, case when a = 1 then 'kind and check differ' end], lambda x: x is not null)) as problem from s"""
)
def scenario_validate(spark, sf_dir):
    k = F.col("c_custkey")
    one = lambda kind, has: F.array(F.struct(F.lit(kind).alias("kind"), F.lit(has).alias("has_check")))
    none = F.array().cast("array<struct<kind:string,has_check:boolean>>")
    assertions = F.when(k % 6 == 0, none).when(k % 6 == 1, one("machine", False)).otherwise(one("judge", False))
    s = table(spark, sf_dir, "customer").select(k.alias("ord"), F.concat(F.lit("k"), k % 7).alias("skill"), F.concat(F.lit("i"), k % 1000).alias("id"), F.when(k % 4 == 0, "  ").otherwise("p").alias("prompt"), F.when(k % 5 == 0, "").otherwise("t").alias("trap"), assertions.alias("assertions"))
    return K.scenario_problems(s, spark.createDataFrame([(f"k{i}",) for i in range(5)], "id string"))


@query(
    """select event_id, 'golangci-lint/' || event_type as analyzer_id, case when event_id % 3 = 0 then 2 else 1 end as severity, case when event_id % 5 = 0 then '../x.go' else 'p/x.go' end as file, (event_id % 50)::bigint as line, props as message, event_id % 5 = 0 as escaped
 from events where event_id % 7 <> 0"""
)
def lint_json(spark, sf_dir):
    k = F.col("event_id")
    issue = F.struct(F.col("event_type").alias("FromLinter"), F.col("props").alias("Text"), F.when(k % 3 == 0, "Error!").otherwise("warn").alias("Severity"), F.struct(F.when(k % 5 == 0, "a/../../x.go").otherwise("./p/x.go").alias("Filename"), (k % 50).alias("Line")).alias("Pos"))
    out = F.when(k % 7 == 0, "no output").otherwise(F.concat(F.lit("level=warn noise\n"), F.to_json(F.struct(F.array(issue).alias("Issues"))), F.lit("\n1 issue")))
    return K.lint_issues(table(spark, sf_dir, "events").select("event_id", out.alias("stdout"))).drop("stdout")


@query(f"with {DOC_CODE} select path, 'must' as key, sha256('x' || chr(10) || 'MUST do' || doc_id || chr(10) || '- No more' || chr(10)) as body_sha256, 2 as n_clauses from doc_code")
def normative_sections(spark, sf_dir):
    text = F.concat(F.lit('{{define "must"}}x\nMUST do'), "doc_id", F.lit("\n- No more\n{{end}} rest"))
    rows = doc_code(spark, sf_dir).select("path", F.explode(K.sections(text)).alias("s"))
    return rows.select("path", "s.key", F.sha2("s.body", 256).alias("body_sha256"), F.size(K.clauses(F.col("s.body"))).alias("n_clauses"))
