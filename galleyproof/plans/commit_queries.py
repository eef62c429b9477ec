"""Queries on commit messages, renames and emoji."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galleyproof.functions.commits import branch_problem
from galleyproof.operators import history as H
from galleyproof.plans.carriers import COMMITS, commit_msgs, table
from galleyproof.sources import gitlines as L

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


_N = "chr(10)"
#: Parts of the carrier's messages, taken from how they were made.
_PARTS = f"""parts as (select m.event_id, m.repo, m.seq, m.subject, p.*, m.event_id % 29 = 0 as mg, m.event_id % 29 <> 0 and m.event_id % 31 = 0 as ini,
 case when m.event_id % 29 <> 0 and m.event_id % 31 <> 0 and m.event_id % 23 = 0 then case when em = '' then ['a', 'b', 'c'] else [em, 'a', 'b', 'c'] end when em = '' then []::varchar[] else [em] end as emojis
 from commit_msgs m join (select event_id as eid, em, kind, event_type from commit_parts) p on m.event_id = eid),
parsed as (select event_id, repo, seq, subject, emojis, mg and em = 'volcano' as is_merge, ini and em = 'ghost' as is_initial,
 mg or ini as plain, case when mg or ini then '' else kind end as type, case when mg or ini or kind = '' then '' when event_id % 3 = 0 then event_type when event_id % 3 = 1 then '' else 'a b' end as scope,
 not (mg or ini) and kind <> '' and event_id % 5 = 0 as breaking, trim(case event_id % 4 when 0 then upper(event_type[1]) || lower(event_type[2:]) when 1 then event_type || '.' when 2 then '[wip] ' || event_type else repeat('Long text ', 9) end) as d,
 event_id % 6 as b, event_type from parts),
final as (select *, case when plain then case when mg2 then 'Merge branch x' else 'Initial commit' end when type = '' then
  case when event_id % 3 <> 1 or breaking2 or true then '' end else d end as description0 from (select *, event_id % 29 = 0 as mg2, event_id % 5 = 0 as breaking2 from parsed))"""


@query(
    f"""with {COMMITS}, {_PARTS} select event_id, array_to_string(emojis, ',') as emojis, type, scope, breaking, is_merge, is_initial,
 type <> '' and event_id % 4 = 2 as is_wip,
 case when type <> '' and b = 0 then 'A body line' || {_N} || 'more of it' when type <> '' and b = 1 then trim(repeat('wide ', 35)) else '' end as body,
 case when type <> '' and b = 0 then 'Second=12' else '' end as footers_after,
 case when plain then case when mg2 then 'Merge branch x' else 'Initial commit' end when type <> '' then d else '' end as description from final"""
)
def commit_parse(spark, sf_dir):
    p = H.parsed(commit_msgs(spark, sf_dir))
    later = F.filter("footers", lambda f: ~F.lower(f["key"]).isin("co-authored-by", "closes"))
    return p.select(
        "event_id", F.array_join("emojis", ",").alias("emojis"), "type", "scope", "breaking", "is_merge", "is_initial", "is_wip",
        "body", F.array_join(F.transform(later, lambda f: F.concat(f["key"], F.lit("="), f["value"])), ",").alias("footers_after"), "description",
    )


@query(
    f"""with {COMMITS}, {_PARTS}, r as (select event_id, unnest(list_filter([
 case when plain and not mg2 and (len(emojis) <> 1 or emojis[1] <> 'ghost') then 'commit-initial' end, case when plain and mg2 and (len(emojis) < 1 or emojis[1] <> 'volcano') then 'commit-merge' end,
 case when not plain and len(emojis) = 0 then 'commit-emoji-required' end, case when not plain and len(emojis) > 3 then 'commit-emoji-count' end,
 case when not plain and type = '' then 'commit-type-required' end, case when not plain and type <> '' and type not in ('feat', 'fix', 'chore') then 'commit-type-enum' end,
 case when not plain and scope = 'a b' then 'commit-scope-charset' end, case when not plain and type = '' then 'commit-desc-required' end,
 case when not plain and type <> '' and length(d) > 72 then 'commit-desc-length' end, case when not plain and type <> '' and event_id % 4 = 1 and d[1] = lower(d[1]) then 'commit-desc-capitalize' end,
 case when not plain and type <> '' and d like '%.' then 'commit-desc-no-period' end, case when not plain and type <> '' and b = 1 then 'commit-body-length' end,
 case when not plain and type <> '' and b = 1 then 'commit-body-total-length' end,
 case when not plain and b = 0 and type <> '' then 'commit-no-coauthor' end], lambda x: x is not null)) as rule from final)
 select event_id, rule from r"""
)
def commit_rules(spark, sf_dir):
    return H.commit_findings(commit_msgs(spark, sf_dir)).select("event_id", "rule")


@query(
    f"""with {COMMITS}, {_PARTS}, e as (select event_id, unnest(emojis) as name from final where not is_merge and not is_initial)
 select event_id, case when name in ('robot', 'test_tube') then 'commit-emoji-prohibited' else 'commit-emoji-catalog' end as rule,
 case name when 'robot' then 'emoji :robot: is prohibited by project convention' when 'test_tube' then 'emoji :test_tube: is prohibited by project convention; use :tea: instead'
 else 'emoji :' || name || ': is not in the commit emoji catalog; it may not render in the history view' end as message from e where name not in ('bug', 'wrench', 'fire', 'ghost', 'volcano')"""
)
def emoji_catalog_check(spark, sf_dir):
    known = spark.createDataFrame([(x,) for x in ("bug", "wrench", "fire", "ghost", "volcano")], "name string")
    return H.emoji_catalog_findings(commit_msgs(spark, sf_dir), known).select("event_id", "rule", "message")


@query(
    f"""with {COMMITS}, e as (select event_id, repo, seq, nullif(regexp_extract(subject, '^:([^: \\t]+):', 1), '') as emoji from commit_msgs),
 w as (select *, list(emoji) filter (emoji is not null) over (partition by repo order by seq rows between 5 preceding and 1 preceding) as near,
 list(emoji) filter (emoji is not null) over (partition by repo order by seq rows between 20 preceding and 1 preceding) as far from e)
 select event_id, emoji, case when list_contains(near, emoji) then 'commit-emoji-repeat' else 'commit-emoji-soft-repeat' end as rule from w where emoji is not null and (list_contains(near, emoji) or list_contains(far, emoji))"""
)
def emoji_window(spark, sf_dir):
    return H.emoji_window(commit_msgs(spark, sf_dir)).select("event_id", "emoji", "rule")


@query(
    f"""with {COMMITS}, {_PARTS}, e as (select type, unnest(emojis) as emoji from final)
 select type, emoji, count(*) as n, grouping(type)::int as all_types from e group by grouping sets ((emoji), (type, emoji))"""
)
def usage_by_type(spark, sf_dir):
    return H.usage(commit_msgs(spark, sf_dir)).select("type", "emoji", "n", "all_types")


@query("""with b as (select event_id, case event_id % 6 when 0 then 'feat/' || event_type when 1 then 'main' when 2 then 'zap/x' when 3 then 'hotfix(' || event_type || ')/a/b' when 4 then 'feature' else 'fix/' end as branch from events)
 select event_id, case event_id % 6 when 2 then 'type' when 4 then 'shape' when 5 then 'shape' end as problem from b""")
def branch_name(spark, sf_dir):
    k, t = F.col("event_id"), F.col("event_type")
    b = F.when(k % 6 == 0, F.concat(F.lit("feat/"), t)).when(k % 6 == 1, "main").when(k % 6 == 2, "zap/x").when(k % 6 == 3, F.concat(F.lit("hotfix("), t, F.lit(")/a/b"))).when(k % 6 == 4, "feature").otherwise("fix/")
    return table(spark, sf_dir, "events").select("event_id", branch_problem(b).alias("problem"))


@query(f"with {COMMITS} select repo, seq, subject from commit_msgs qualify row_number() over (partition by repo order by seq desc) <= 3")
def log_last_n(spark, sf_dir):
    return H.last_n(commit_msgs(spark, sf_dir), 3).select("repo", "seq", "subject")


@query(f"with {COMMITS} select repo, seq from commit_msgs qualify not (seq = max(seq) over (partition by repo) and subject = ':bug: Merge branch x')")
def head_replacement(spark, sf_dir):
    return H.without_replaced_head(commit_msgs(spark, sf_dir), ":bug: Merge branch x").select("repo", "seq")


def _renames(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    diff = F.when(k % 3 == 0, '+import "a"').when(k % 3 == 1, "+x := 1")
    return o.filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("repo"), F.concat(F.lit("a/"), k).alias("old_path"), F.concat(F.lit("b/"), k).alias("new_path"), (k % 101).alias("score"), diff.alias("diff"))


def _changes(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(F.col("o_custkey").alias("repo"), F.concat(F.when(k % 2 == 0, "b/").otherwise("c/"), k).alias("path"), (k % 5 != 0).alias("staged"), F.when(k % 7 == 0, '-import "b"').otherwise("+y = 2").alias("diff"))


@query(
    """with r as (select o_custkey as repo, o_orderkey as k, o_orderkey % 101 as score from orders where o_orderkey % 2 = 0),
 own as (select repo, 'b/' || k as file, case when score < 90 then score || '% similar' when k % 3 <> 0 then 'carries an edit' end as reason from r),
 e as (select o_custkey as repo, count(*) as edits from orders where o_orderkey % 2 = 1 and o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 group by 1), m as (select repo, count(*) as moves from r group by 1)
 select * from own where reason is not null union all select repo, '', printf('mixes %d rename(s) with %d edit(s)', moves, edits) from m join e using (repo)"""
)
def move_purity(spark, sf_dir):
    return H.move_findings(_renames(spark, sf_dir), _changes(spark, sf_dir))


@query(
    """with l as (select o_orderkey as k, case o_orderkey % 5 when 0 then 'R' || (o_orderkey % 101) || chr(9) || 'a/' || o_orderkey || chr(9) || 'b/' || o_orderkey when 1 then 'M' || chr(9) || 'x' when 2 then 'R' || chr(9) || 'a' || chr(9) || 'b' when 3 then 'R10' || chr(9) || 'only' else '' end as line from orders)
 select k, (k % 101)::int as score, 'a/' || k as old_path, 'b/' || k as new_path from l where k % 5 = 0"""
)
def rename_parse(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    line = F.when(k % 5 == 0, F.concat(F.lit("R"), k % 101, F.lit("\ta/"), k, F.lit("\tb/"), k)).when(k % 5 == 1, "M\tx").when(k % 5 == 2, "R\ta\tb").when(k % 5 == 3, "R10\tonly").otherwise("")
    return L.renames(o.select(k.alias("k"), line.alias("line"))).select("k", "score", "old_path", "new_path")


@query(
    """select o_orderkey as k, case o_orderkey % 4 when 0 then 'new/' || o_orderkey || '_test.go' else 'src/' || o_orderkey || '.go' end as path, case when o_orderkey % 4 = 0 then 'old/' || o_orderkey || '.go' else '' end as old_path,
 '.go' as ext, o_orderkey % 4 = 0 as is_test, ['R', ' ', 'M', '?'][o_orderkey % 4 + 1] as staging, [' ', 'M', ' ', '?'][o_orderkey % 4 + 1] as worktree, o_orderkey % 4 in (0, 2) as staged from orders where o_orderkey % 6 <> 5"""
)
def changed_files_parse(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    line = F.when(k % 6 == 5, "M ").when(k % 4 == 0, F.concat(F.lit("R  old/"), k, F.lit(".go -> new/"), k, F.lit("_test.go"))).when(k % 4 == 1, F.concat(F.lit(" M src/"), k, F.lit(".go"))).when(k % 4 == 2, F.concat(F.lit("M  src/"), k, F.lit(".go"))).otherwise(F.concat(F.lit("?? src/"), k, F.lit(".go")))
    return L.changes(o.select(k.alias("k"), line.alias("line"))).select("k", "path", "old_path", "ext", "is_test", "staging", "worktree", "staged")


def _catalog(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    groups = F.element_at(F.array(*map(F.lit, ("Objects", "Symbols", "Flags", "Activities"))), (k % 4 + 1).cast("int"))
    sub = F.element_at(F.array(*map(F.lit, ("warning", "arrow", "other"))), (k % 3 + 1).cast("int"))
    return p.select(F.concat(F.lit("e"), k).alias("name"), groups.alias("grp"), sub.alias("subgroup"), F.when(k % 5 == 0, F.col("p_size")).otherwise(0).alias("uses"))


_CATALOG = """cat as (select 'e' || p_partkey as name, ['Objects', 'Symbols', 'Flags', 'Activities'][p_partkey % 4 + 1] as grp, ['warning', 'arrow', 'other'][p_partkey % 3 + 1] as subgroup, case when p_partkey % 5 = 0 then p_size else 0 end as uses from part),
 pool as (select *, (row_number() over (order by uses desc, name))::int as rank from cat where uses > 0 or grp in ('Objects', 'Activities') or subgroup = 'warning')"""


@query(f"with {_CATALOG} select name, uses, rank from pool")
def pool_ranking(spark, sf_dir):
    return H.pool_ranking(_catalog(spark, sf_dir)).select("name", "uses", "rank")


_FNV = "list_reduce([2166136261::hugeint] || list_transform(range(1, strlen(s) + 1), lambda i: ascii(substr(s, i, 1))::hugeint), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"


@query(
    f"""with {_CATALOG}, r as (select grp, name, row_number() over (partition by grp order by uses desc, name) as rank, count(*) over (partition by grp) as n, grp as s from cat),
 b as (select *, greatest(n // 7, 1) as band, {_FNV} as h from r) select grp, name from b where n <= 7 or ((rank - 1) // band < 7 and (rank - 1) % band = h % band)"""
)
def banded_draw(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    ranked = c.withColumn("rank", F.row_number().over(W.partitionBy("grp").orderBy(F.desc("uses"), "name")))
    return H.banded_draw(ranked, 7, F.col("grp"), "grp").select("grp", "name")


def _tiers(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select((k % 10).alias("query"), F.when(k % 50 < 10, 0).when(k % 50 < 20, 1).when(k % 50 < 30, 2).otherwise(3).alias("tier"), F.col("p_size").alias("rank"), F.concat(F.lit("e"), F.floor(k / 20)).alias("name"))


@query(
    """with t as (select p_partkey % 10 as query, case when p_partkey % 50 < 10 then 0 when p_partkey % 50 < 20 then 1 when p_partkey % 50 < 30 then 2 else 3 end as tier, p_size as rank, 'e' || (p_partkey // 20) as name from part),
 f as (select query, tier, name, row_number() over (partition by query, tier order by rank, name) as rank, count(*) over (partition by query, tier) as n from (select *, min(tier) over (partition by query, name) as best from t) where tier = best),
 d0 as (select query, tier, rank, name from f where tier = 0 and (n <= 4 or ((rank - 1) // greatest(n // 4, 1) < 4 and (rank - 1) % greatest(n // 4, 1) = 84696383 % greatest(n // 4, 1)))),
 d1 as (select f.query, f.tier, f.rank, f.name from f left join (select query, count(*) as k from d0 group by 1) c using (query) where tier = 1 and 7 - coalesce(k, 0) > 0 and (n <= 7 - coalesce(k, 0) or ((rank - 1) // greatest(n // greatest(7 - coalesce(k, 0), 1), 1) < 7 - coalesce(k, 0) and (rank - 1) % greatest(n // greatest(7 - coalesce(k, 0), 1), 1) = 84696383 % greatest(n // greatest(7 - coalesce(k, 0), 1), 1)))),
 u1 as (select * from d0 union all select * from d1),
 d2 as (select f.query, f.tier, f.rank, f.name from f left join (select query, count(*) as k from u1 group by 1) c using (query) where tier = 2 and 7 - coalesce(k, 0) > 0 and (n <= 7 - coalesce(k, 0) or ((rank - 1) // greatest(n // greatest(7 - coalesce(k, 0), 1), 1) < 7 - coalesce(k, 0) and (rank - 1) % greatest(n // greatest(7 - coalesce(k, 0), 1), 1) = 84696383 % greatest(n // greatest(7 - coalesce(k, 0), 1), 1)))),
 u2 as (select * from u1 union all select * from d2),
 d3 as (select f.query, f.tier, f.rank, f.name from f left join (select query, count(*) as k from u2 group by 1) c using (query) where tier = 3 and 7 - coalesce(k, 0) > 0 and (n <= 7 - coalesce(k, 0) or ((rank - 1) // greatest(n // greatest(7 - coalesce(k, 0), 1), 1) < 7 - coalesce(k, 0) and (rank - 1) % greatest(n // greatest(7 - coalesce(k, 0), 1), 1) = 84696383 % greatest(n // greatest(7 - coalesce(k, 0), 1), 1))))
 select query, tier, name from u2 union all select query, tier, name from d3"""
)
def suggestion_tiers(spark, sf_dir):
    return H.suggest(_tiers(spark, sf_dir), 7, "scope desc").select("query", "tier", "name")


def _fnv(text: str) -> int:
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


ORACLE_SQL["suggestion_tiers"] = ORACLE_SQL["suggestion_tiers"].replace("84696383", str(_fnv("scope desc")))
