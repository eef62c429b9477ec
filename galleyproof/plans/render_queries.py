"""Queries on documents rendered from a knowledge base: skills from suppliers, items from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleyproof.operators import render as R
from galleyproof.plans.carriers import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _arr(*values):
    return F.array(*(v if not isinstance(v, str) else F.lit(v) for v in values))


def _none():
    return F.array().cast("array<string>")


def _items(spark, sf_dir):
    """Parts as rules (even keys) and patterns: a preamble, a must section, and one whose name follows from the key."""
    k = F.col("p_partkey")
    name = F.element_at(_arr("when", "outputs", "odd", "validation"), (k % 4 + 1).cast("int"))
    body = F.concat(F.lit("# Title\n\nLead "), k, F.lit('\n{{define "must"}}\n'), F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit("MUST "), k)), F.lit('\n{{end}}\n{{define "'), name, F.lit('"}}\nT '), k, F.lit("\n{{end}}\n"))
    linters = F.when(k % 5 == 0, _arr("errcheck", "lll")).when(k % 5 == 1, _arr("lll")).otherwise(_none())
    refs = F.when(k % 2 == 0, F.array(F.concat(F.lit("r"), k % 3))).otherwise(_none())
    return table(spark, sf_dir, "part").select(F.when(k % 2 == 0, "rules").otherwise("patterns").alias("kind"), k.cast("string").alias("id"), F.concat(F.lit("Item "), k).alias("name"), body.alias("body"), linters.alias("linters"), refs.alias("refs"))


_ITEMS = """items as (select case when p_partkey % 2 = 0 then 'rules' else 'patterns' end as kind, p_partkey as k, 'Item ' || p_partkey as name,
 case when p_partkey % 3 = 0 then '' else 'MUST ' || p_partkey end as must, ['when', 'outputs', 'odd', 'validation'][p_partkey % 4 + 1] as other, 'T ' || p_partkey as t,
 case p_partkey % 5 when 0 then ['errcheck', 'lll'] when 1 then ['lll'] else [] end as linters, case when p_partkey % 2 = 0 then ['r' || p_partkey % 3] else [] end as refs from part),
 secs as (select kind, k, name, 2 as place, 'Must' as heading, must as t from items where must <> '' union all
 select kind, k, name, case other when 'when' then 0 when 'validation' then 8 else 9 end, case other when 'when' then 'When this applies' when 'validation' then 'Validation checklist' else 'Expected outputs' end, t from items where other <> 'odd')"""


def _skills(spark, sf_dir):
    """Suppliers as skills that compose the rules 2k and 2k + 6, the pattern 2k + 1, and an unknown one at times."""
    k = F.col("s_suppkey")
    ref = lambda n: (k * 2 + n).cast("string")
    rules = F.when(k % 6 == 0, F.array(ref(0), F.lit("nothing"))).otherwise(F.array(F.concat(ref(0), F.lit("#part")), ref(6)))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), k).alias("id"), k.alias("k"), F.col("s_name").alias("name"), F.concat(F.lit("Does "), k, F.lit(". More.")).alias("description"), _arr("t1", "t2").alias("triggers"), (k % 2 == 0).alias("always_load"),
        (k % 4).alias("ord"), F.when(k % 3 == 0, False).otherwise(True).alias("merged"), rules.alias("compose_rules"), F.array(ref(1)).alias("compose_patterns"),
        F.when(k % 4 == 0, _arr("w1", "w0")).otherwise(_none()).alias("compose_workflows"), F.when(k % 5 == 0, _arr("s1", "s2")).otherwise(_none()).alias("compose_skills"),
    )


_SKILLS = """skills as (select 's' || s_suppkey as id, s_suppkey as k, s_name as name, 'Does ' || s_suppkey || '. More.' as description, s_suppkey % 3 <> 0 as merged from supplier),
 held as (select id as holder, s.k as hk, merged, src, i.* from skills s, range(3) r(src) join items i on i.k = s.k * 2 + [0, 6, 1][src + 1] where not (src = 1 and s.k % 6 = 0))"""


@query(f"with {_ITEMS} select kind, k::varchar as id, other as key from items where other = 'odd'")
def section_names(spark, sf_dir):
    return R.odd_sections(_items(spark, sf_dir))


@query(f"with {_ITEMS} select kind, k::varchar as id, place, heading, t as text from secs")
def section_extraction(spark, sf_dir):
    return R.item_sections(_items(spark, sf_dir)).select("kind", "id", "place", "heading", "text")


@query(f"""with {_ITEMS}, s as (select kind, k, string_agg(chr(10) || chr(10) || '## ' || heading || chr(10) || chr(10) || t, '' order by place) as t from secs group by 1, 2)
 select i.kind, i.k::varchar as id, '# Title' || chr(10) || chr(10) || 'Lead ' || i.k || coalesce(s.t, '') as text from items i left join s using (kind, k)""")
def whole_bodies(spark, sf_dir):
    return R.whole_bodies(_items(spark, sf_dir))


@query("""select 's' || s_suppkey as holder, 'rules' as kind, 'nothing' as ref from supplier where s_suppkey % 6 = 0
 union all select 's' || s_suppkey, case when n = 1 then 'patterns' else 'rules' end, (s_suppkey * 2 + n)::varchar from supplier, (values (0), (1), (6)) t(n) where not (n = 6 and s_suppkey % 6 = 0) and s_suppkey * 2 + n not in (select p_partkey from part)""")
def unknown_compositions(spark, sf_dir):
    return R.unknown_compositions(_skills(spark, sf_dir), _items(spark, sf_dir))


@query(f"""with {_ITEMS}, {_SKILLS}, v as (select holder, src, unnest(linters) as value, generate_subscripts(linters, 1) as j from held), f as (select holder, value, min(src * 10 + j) as o from v group by 1, 2)
 select holder, (row_number() over (partition by holder order by o) - 1)::int as ord, value from f""")
def composed_linters(spark, sf_dir):
    return R.composed_values(_skills(spark, sf_dir), _items(spark, sf_dir), "linters")


@query(f"""with {_ITEMS}, {_SKILLS}, have as (select holder, count(*) as n from held where src < 2 group by 1)
 select id from skills where k % 6 <> 0 and id not in (select holder from held where src < 2 and (must <> '' or other = 'validation')) and id in (select holder from have where n = 2)""")
def normative_presence(spark, sf_dir):
    return R.without_duty(_skills(spark, sf_dir).withColumn("compose_patterns", _none()), _items(spark, sf_dir))


@query("select 's' || s_suppkey as id, case when s_suppkey % 3 = 0 then 'no sidecar' else 'no orientation' end as problem from supplier where s_suppkey % 3 < 2 or s_suppkey % 2 = 0")
def sidecar_prose(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    # 120 bytes are enough, 119 are not; letters of two bytes count twice, lines that point elsewhere not at all
    text = F.when(k % 3 == 1, F.concat(F.lit("  see the composed rule, which is long enough by far, to be sure of that and of all that follows from it, in all its parts\n"), F.repeat(F.lit("x"), 119))).when(k % 2 == 0, F.concat(F.repeat(F.lit("é"), 59), F.lit(" \n\n  y"))).otherwise(F.repeat(F.lit("é"), 60))
    return R.sidecar_problems(s.select(F.concat(F.lit("s"), k).alias("id")), s.select(F.concat(F.lit("s"), k).alias("id"), F.when(k % 3 > 0, text).alias("body")))


@query("select s_suppkey as rule, 1 as ord, 'x' || s_suppkey as analyzer from supplier where s_suppkey % 4 <> 0")
def rule_analyzers(spark, sf_dir):
    from galleyproof import dims

    k = F.col("s_suppkey")
    rules = table(spark, sf_dir, "supplier").select(k.alias("rule"), k.alias("id"), F.array(F.lit("naming"), F.when(k % 4 == 0, "shadowing").otherwise(F.concat(F.lit("x"), k))).alias("analyzers"))
    return R.unknown_analyzers(rules, dims.rule_names(spark))


def _themes(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.array(F.concat(F.lit("k"), k), F.lit("also")).alias("keywords"), F.array(k.cast("string"), (k * 5).cast("string")).alias("names"))


@query("select 'k' || s_suppkey as area, n::int as ord, (s_suppkey * [1, 5][n + 1])::varchar as name from supplier, range(2) r(n) where s_suppkey * [1, 5][n + 1] not in (select p_partkey from part where p_size > 10)")
def theme_membership(spark, sf_dir):
    return R.off_catalog(_themes(spark, sf_dir), table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").cast("string").alias("name")))


@query("select 'k' || s_suppkey as area, 'k' || s_suppkey || ' (`:' || s_suppkey || ':`, `:' || s_suppkey * 5 || ':`)' as text from supplier")
def theme_anchors(spark, sf_dir):
    return R.anchors(_themes(spark, sf_dir))


_N = "chr(10)"


def _block(head: str, body: str) -> str:
    return f"{_N} || {_N} || '{head}' || {body}"


@query(
    f"""with {_ITEMS}, {_SKILLS}, hs as (select h.holder, h.src, h.merged, h.name, s.place, s.heading, s.t from held h left join secs s using (kind, k)),
 m as (select holder, place, {_block('### ', 'heading')} || string_agg({_block('#### ', f'name || {_N} || {_N} || t')}, '' order by src) as b from hs where merged and t is not null group by holder, place, heading),
 u as (select holder, src as place, {_block('### ', 'name')} || coalesce(string_agg({_block('#### ', f'heading || {_N} || {_N} || t')}, '' order by place) filter (t is not null), '') as b from hs where not merged group by holder, src, name),
 rules as (select holder, string_agg(b, '' order by place) as t from (select * from m union all select * from u) group by holder),
 c as (select holder, value, min(src * 10) as o from (select holder, src, unnest(refs) as value from held) group by 1, 2),
 cited as (select holder, string_agg({_N} || '- [Title ' || value || '](http://' || value || ')' || case when value = 'r0' then ' - noted' else '' end, '' order by o) as t from c where value <> 'r2' group by holder),
 lv as (select holder, value, min(src * 10 + j) as o from (select holder, src, unnest(linters) as value, generate_subscripts(linters, 1) as j from held) group by 1, 2),
 lint as (select holder, string_agg('`' || value || '`', ', ' order by o) as t from lv group by holder)
 select id, sha256('---' || {_N} || 'name: ' || id || {_N} || 'description: ' || description || {_N} || '---' || {_N} || {_N} || '# ' || name || {_N} || {_N} || '<!-- x -->' || {_N} || {_N} || description || {_block('## Activation conditions', f"{_N} || '- t1' || {_N} || '- t2'")}
 || case when k % 7 = 0 then '' else {_N} || {_N} || 'side ' || k end
 || coalesce({_block('## Applicable rules and patterns', f'{_N} || rules.t')}, '')
 || case when k % 4 = 0 then {_block('## Workflows', _block('### ', f"'W1' || {_N} || {_N} || 'body 1'") + ' || ' + _block('### ', f"'W0' || {_N} || {_N} || 'body 0'"))} else '' end
 || coalesce({_block('## References', 'cited.t')}, '') || {_block('## Composition', f"{_N} || '- Always load: ' || (k % 2 = 0) || {_N} || '- Order: ' || k % 4")}
 || case when k % 5 = 0 then {_N} || '- Compose with: `s1`, `s2`' else '' end || coalesce({_N} || '- Linters: ' || lint.t, '') || {_N}) as text_sha256
 from skills left join rules on rules.holder = id left join cited on cited.holder = id left join lint on lint.holder = id"""
)
def skill_documents(spark, sf_dir):
    skills = _skills(spark, sf_dir)
    flows = spark.createDataFrame([("w0", "W0", "# W\n\nbody 0"), ("w1", "W1", "# W\nbody 1")], "id string, name string, body string")
    refs = spark.createDataFrame([("r0", "Title r0", "http://r0", "noted"), ("r1", "Title r1", "http://r1", "")], "id string, title string, url string, note string")
    sidecars = skills.select("id", F.when(F.col("k") % 7 != 0, F.concat(F.lit("\nside "), "k", F.lit("\n"))).otherwise("\n").alias("body"))
    return R.skill_documents(skills, _items(spark, sf_dir), flows, refs, sidecars, "<!-- x -->").select("id", F.sha2("text", 256).alias("text_sha256"))


@query(
    f"""with {_ITEMS}, {_SKILLS}, w as (select kind, k, string_agg(chr(10) || chr(10) || '## ' || heading || chr(10) || chr(10) || t, '' order by place) as t from secs group by 1, 2),
 p as (select h.holder, h.kind, string_agg({_block('### ', f"h.name || {_N} || {_N} || 'Lead ' || h.k || coalesce(w.t, '')")}, '' order by src) as t from held h left join w using (kind, k) group by 1, 2)
 select id, sha256('---' || {_N} || 'name: ' || id || {_N} || 'description: ' || description || {_N} || '---' || {_N} || {_N} || '# ' || name || {_N} || {_N} || '<!-- x -->' || {_N} || {_N} || description || {_block('## Steps', f"{_N} || '- t1' || {_N} || '- t2'")}
 || case when s.k % 2 = 0 then {_N} || {_N} || 'flow ' || s.k else '' end || coalesce({_block('## Applicable rules', 'r.t')}, '') || coalesce({_block('## Applicable patterns', 'q.t')}, '') || {_N}) as text_sha256
 from skills s left join p r on r.holder = id and r.kind = 'rules' left join p q on q.holder = id and q.kind = 'patterns'"""
)
def workflow_documents(spark, sf_dir):
    flows = _skills(spark, sf_dir).withColumnRenamed("triggers", "steps").withColumn("body", F.when(F.col("k") % 2 == 0, F.concat(F.lit("flow "), "k")).otherwise(""))
    return R.workflow_documents(flows, _items(spark, sf_dir), "<!-- x -->").select("id", F.sha2("text", 256).alias("text_sha256"))


@query(
    """with d as (select s_suppkey as k, list_filter(['s' || s_suppkey, 's' || (s_suppkey + 1)], lambda x: substr(x, 2)::int % 3 = 0) as kept from supplier), on_ as (select s_suppkey as k from supplier where s_suppkey % 3 = 0)
 select 'always' as part, k as place, '- `s' || k || '` - note' as line from on_
 union all select 'dispatch', k, '| signal ' || k || ' | `' || kept[1] || '`' || case when k % 2 = 0 then ' (n)' else '' end || ' |' from d where len(kept) > 0
 union all select 'order', row_number() over (order by k), row_number() over (order by k) || '. `' || kept[1] || '` - step' from d where len(kept) > 0
 union all select 'skills', row_number() over (order by k % 4, 's' || k), '- `s' || k || '` - Does ' || k || '.' from on_"""
)
def router_lines(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    id_ = F.concat(F.lit("s"), k)
    installed = s.filter(k % 3 == 0).select(id_.alias("id")).unionByName(s.filter(k % 3 == 0).agg((F.max(k) + 3).alias("m")).select(F.concat(F.lit("s"), "m").alias("id")))
    pair = F.array(id_, F.concat(F.lit("s"), k + 1))
    base = s.select(F.lit("always").alias("part"), k.alias("ord"), id_.alias("skill"), F.lit("note").alias("note"))
    dispatch = s.select(k.alias("ord"), F.concat(F.lit("signal "), k).alias("signal"), pair.alias("skills"), F.when(k % 2 == 0, "n").otherwise("").alias("note"))
    return R.router_lines(base, dispatch, s.select(k.alias("ord"), pair.alias("skills"), F.lit("step").alias("note")), _skills(spark, sf_dir), installed)


@query("select 'Top' || chr(10) || '- `a` - n1' || chr(10) || '- `b` - n2' || chr(10) || chr(10) || '## Table' || chr(10) || chr(10) || 'End' || chr(10) as text")
def router_document(spark, sf_dir):
    rows = spark.createDataFrame([("always", 2, "- `b` - n2"), ("always", 1, "- `a` - n1")], "part string, place long, line string")
    return R.router_document(rows, [("Top", "always"), ("\n\n## Table", "dispatch"), ("\n\nEnd", "")])
