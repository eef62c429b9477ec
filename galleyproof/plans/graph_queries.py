"""Queries on graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleyproof.operators import graph as G
from galleyproof.plans.carriers import EDGES, edges, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


_REACH = f"with recursive {EDGES}, reach as (select distinct src, dst from edges union select r.src, e.dst from reach r join edges e on r.dst = e.src)"


@query(f"{_REACH} select src, dst from reach")
def dependency_closure(spark, sf_dir):
    return G.closure(edges(spark, sf_dir))


@query(f"{_REACH} select src as node from reach where src = dst")
def cycle_members(spark, sf_dir):
    return G.cycle_members(edges(spark, sf_dir))


# A depth-first walk, one step a row: the stack, what is finished, the edges not yet taken, and the cycle a back edge closes.
@query(
    f"""with recursive {EDGES}, g as (select list_sort(list(distinct [src::varchar, dst::varchar])) as e, list_sort(list(distinct src::varchar)) as roots from edges),
 walk as (select 0 as step, [e[1][1]][:0] as stack, [e[1][1]][:0] as fin, e as rest, roots, [e[1][1]][:0] as cyc, false as over from g union all
 select step + 1,
  case when len(stack) = 0 then case when root is null then stack else [root] end when nx is null then stack[:-2] when list_contains(stack, nx[2]) or list_contains(fin, nx[2]) then stack else list_append(stack, nx[2]) end,
  case when len(stack) > 0 and nx is null then list_append(fin, stack[-1]) else fin end,
  case when nx is null then rest else list_filter(rest, lambda x: x <> nx) end, roots,
  case when len(stack) > 0 and nx is not null and list_contains(stack, nx[2]) then stack[list_position(stack, nx[2]):] else stack[:0] end, len(stack) = 0 and root is null
 from (select *, list_filter(rest, lambda x: x[1] = stack[-1])[1] as nx, list_filter(roots, lambda r: not list_contains(fin, r))[1] as root from walk where not over)),
 least as (select cyc, list_min(cyc) as m, list_position(cyc, list_min(cyc)) as k from walk where len(cyc) > 0)
 select distinct 'r' as repo, array_to_string(list_concat(list_concat(cyc[k:], case when k > 1 then cyc[:k - 1] else cyc[:0] end), [m]), ' → ') as cycle from least"""
)
def cycle_listing(spark, sf_dir):
    return G.cycle_listing(edges(spark, sf_dir).withColumn("repo", F.lit("r")))


def _packages(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem")
    heads = F.array(*map(F.lit, ("cmd", "rest", "infra", "domain", "misc")))
    name = lambda k: F.concat(F.element_at(heads, (k % 5 + 1).cast("int")), F.lit("/p"), k % 40)
    return s.select(F.lit(1).alias("repo"), name(F.col("l_suppkey")).alias("pkg"), F.concat(F.lit("f"), F.col("l_orderkey") % 3, F.lit(".go")).alias("path"), F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("other/"), name(F.col("l_partkey")))).otherwise(F.concat(F.lit("mod/"), name(F.col("l_partkey")))).alias("import_path"))


_PK = """imports as (select ['cmd', 'rest', 'infra', 'domain', 'misc'][l_suppkey % 5 + 1] || '/p' || l_suppkey % 40 as pkg, 'f' || l_orderkey % 3 || '.go' as path,
 case when l_partkey % 4 = 0 then 'other/' else 'mod/' end || ['cmd', 'rest', 'infra', 'domain', 'misc'][l_partkey % 5 + 1] || '/p' || l_partkey % 40 as import_path from lineitem),
 e as (select distinct pkg as src, substr(import_path, 5) as dst from imports i where path = (select min(path) from imports j where j.pkg = i.pkg) and import_path like 'mod/%')"""


@query(f"with {_PK}, r as (select src, dst, list_position(['cmd', 'rest', 'infra', 'domain'], split_part(src, '/', 1)) as a, list_position(['cmd', 'rest', 'infra', 'domain'], split_part(dst, '/', 1)) as b from e) select src, dst from r where a > b and b > 0")
def layer_boundaries(spark, sf_dir):
    return G.boundary_violations(G.package_edges(_packages(spark, sf_dir), "mod"))


@query(
    """with recursive n as (select count(*) as n from supplier), s as (select s_suppkey as id, s_suppkey % 50 = 0 as always_load, [(s_suppkey * 3 + 1) % n, (s_suppkey * 7 + 2) % n] as c from supplier, n),
 e as (select id as src, unnest(c) as dst from s where id <> 7), reach as (select id from s where always_load union select e.dst from reach r join e on e.src = r.id) select id from reach"""
)
def skill_closure(spark, sf_dir):
    k = F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier")
    n = F.lit(suppliers.count())
    s = suppliers.select(k.cast("string").alias("id"), (k % 50 == 0).alias("always_load"), F.array(((k * 3 + 1) % n).cast("string"), ((k * 7 + 2) % n).cast("string")).alias("compose_skills"))
    return G.pulled_skills(s, s.select("id").limit(0), router="7").select(F.col("id").cast("long").alias("id"))


@query("select 'src/' || p_partkey || '.go' as file, 2::bigint as line, 'F has cyclomatic complexity ' || (1 + 2 * (p_size % 9)) as message from part where p_size % 9 = 8")
def go_facts_metrics(spark, sf_dir):
    from galleyproof.operators.gochecks import complexity
    from galleyproof.sources.gofacts import go_facts

    body = F.concat(F.lit("package a\nfunc F() {\n"), F.repeat(F.lit("if a && b {\n}\n"), (F.col("p_size") % 9).cast("int")), F.lit("}\n"))
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("src/"), "p_partkey", F.lit(".go")).alias("path"), F.lit(".go").alias("ext"), body.alias("content"))
    return complexity(go_facts(files)).select("file", "line", "message")
