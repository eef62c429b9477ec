"""Queries on the turns of a session, linter runs, flags and change lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleyproof.operators import history as H
from galleyproof.operators import hooks as K
from galleyproof.operators import knowledge as N
from galleyproof.operators import turns as T
from galleyproof.plans.carriers import COMMITS, commit_msgs, table
from galleyproof.sources.sinks import status_text

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


MODES = ("stop", "post-edit", "session-end", "user-prompt", "odd")


def _turns(spark, sf_dir):
    """Events as turns: a session for each user, its mode by the event's number."""
    k = F.col("event_id")
    mode = F.element_at(F.array(*map(F.lit, MODES)), (k * 3 % 11 % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 7 == 0, "").otherwise(F.col("user_id").cast("string")).alias("session_id"), k.alias("seq"), mode.alias("mode"))


_TURNS = f"""turns as (select case when user_id % 7 = 0 then '' else user_id::varchar end as session_id, event_id as seq, {list(MODES)}[event_id * 3 % 11 % 5 + 1] as mode from events),
 named as (select case when session_id = '' then 'nosession' else session_id end as session_id, seq, mode from turns),
 ep as (select *, count(*) filter (mode = 'session-end') over (partition by session_id order by seq rows between unbounded preceding and 1 preceding) as epoch from named)"""


@query(f"with {_TURNS} select session_id, seq, case mode when 'stop' then 'Stop' when 'post-edit' then 'PostToolUse' when 'user-prompt' then 'UserPromptSubmit' else '' end as event from turns")
def dispatch_modes(spark, sf_dir):
    return T.dispatch(_turns(spark, sf_dir)).select("session_id", "seq", "event")


@query(
    f"""with {_TURNS}, said as (select *, 'Stop.' || chr(10) || 'block ' || (seq % 5) || case when seq % 3 = 0 then '' else chr(10) || '  - point' end || chr(10) || chr(10) || 'Uncommitted changes:' || chr(10) || 'M  x' || (seq % 2) as text
 from ep where mode = 'stop' and seq % 5 <> 0 and seq % 7 <> 0)
 select session_id, seq, text from said qualify lag(text) over (partition by session_id, epoch order by seq) is distinct from text"""
)
def stop_reports(spark, sf_dir):
    turns, k = _turns(spark, sf_dir), F.col("seq")
    block = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("block "), k % 5))
    reports = turns.select("session_id", "seq", block.alias("block"), F.when(k % 3 == 0, "").otherwise("  - point").alias("points"), F.when(k % 7 != 0, F.concat(F.lit("M  x"), k % 2)).alias("status"))
    return T.stop_reports(turns, reports, "Stop.")


@query(
    f"""with {_TURNS}, e as (select *, seq % 4 as shape, case when seq % 6 = 0 then 'cleaned ' || seq else '' end as notice, 'Post-edit checklist for f' || (seq % 3) || case when seq % 2 = 0 then '.go' else '.md' end || ':' || chr(10) ||
 '  - load skill `b` and run its Validation checklist' || chr(10) || case when seq % 2 = 0 then '  - no package docstrings; no doc comments on unexported symbols' || chr(10) else '' end || 'Then verify: go build ./... && go test -race ./...' as body from ep where mode = 'post-edit'),
 l as (select *, lag(body) over (partition by session_id, epoch order by seq) is distinct from body as new from e where shape > 1)
 select session_id, seq, notice as text from e where shape = 0 and notice <> '' union all select session_id, seq, 'fixed text' from e where shape = 1
 union all select session_id, seq, case when notice <> '' then notice || chr(10) || chr(10) else '' end || body from l where new or notice <> ''"""
)
def post_edits(spark, sf_dir):
    k = F.col("seq")
    none = F.array().cast("array<string>")
    routed = F.when(k % 4 == 0, none).otherwise(F.array(F.lit("a"), F.lit("b")))
    installed = F.when(k % 4 == 1, F.array(F.lit("z"))).otherwise(F.array(F.lit("b"), F.lit("c")))
    path = F.concat(F.lit("p/f"), k % 3, F.when(k % 2 == 0, ".go").otherwise(".md"))
    rows = _turns(spark, sf_dir).withColumns({"file_path": path, "routed": routed, "installed": installed, "notice": F.when(k % 6 == 0, F.concat(F.lit("cleaned "), k)).otherwise("")})
    return T.post_edits(rows, "fixed text")


@query(
    """select 'm' || (event_id % 3) as event, case when user_id % 7 = 0 then 'nosession' else user_id::varchar end as session_id, event_id % 1000 as duration_ms, coalesce(case when event_id % 4 > 0 then event_id % 4 end, 0) as findings,
 event_id % 5 > 0 as ok, case when event_id % 5 = 0 then 'failed' end as error from events"""
)
def telemetry(spark, sf_dir):
    k = F.col("event_id")
    session = F.when(F.col("user_id") % 7 == 0, "").otherwise(F.col("user_id").cast("string"))
    runs = table(spark, sf_dir, "events").select(F.concat(F.lit("m"), k % 3).alias("mode"), session.alias("session_id"), k.alias("started_ms"), (k + k % 1000).alias("ended_ms"), F.when(k % 4 > 0, k % 4).alias("findings"), F.when(k % 5 == 0, "failed").alias("error"))
    return T.telemetry(runs)


@query("select s_suppkey as project, case when s_suppkey % 5 in (2, 4) then 'unverifiable' else 'drift' end as state from supplier where s_suppkey % 5 in (1, 2, 4)")
def knowledge_drift(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("project"), "s_name")
    disk = s.select("project", F.when(F.col("project") % 5 == 1, "x").when(F.col("project") % 5 != 2, F.col("s_name")).alias("fingerprint"))
    return T.drift(s.select("project", F.when(F.col("project") % 5 != 4, F.col("s_name")).alias("fingerprint")), disk)


_EXTS = (".go", ".md", ".sql", ".yaml", ".txt")


def _changes(spark, sf_dir):
    k = F.col("o_orderkey")
    ext = F.element_at(F.array(*map(F.lit, _EXTS)), (k % 7 % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), k.alias("k"), F.concat(F.lit("p/"), k, ext).alias("path"), ext.alias("ext"), F.when(k % 3 == 0, F.concat(F.lit("q/"), k)).otherwise("").alias("old_path"), F.when(k % 3 == 0, "R").otherwise(" ").alias("staging"), F.when(k % 3 == 0, " ").otherwise("M").alias("worktree"))


_CHANGES = f"""ch as (select o_custkey as repo, o_orderkey as k, {list(_EXTS)}[o_orderkey % 7 % 5 + 1] as ext from orders)"""


@query(f"with {_CHANGES} select repo, array_to_string(list_sort(list(distinct ext)), ',') as exts from ch group by repo")
def changed_extensions(spark, sf_dir):
    return T.extensions(_changes(spark, sf_dir)).select("repo", F.array_join("exts", ",").alias("exts"))


@query(
    f"""with {_CHANGES}, p(k, ext, point) as (values (0, '.go', 'gofmt -l clean; go vet ./... and go test -race ./... green'), (1, '.go', 'no package docstrings; no doc comments on unexported symbols'),
 (2, '.sql', 'migrations reversible and reviewed; no raw SQL in handlers'), (3, '.yaml', 'validate passes'), (4, '.md', 'every Markdown file ends with a trailing newline'))
 select repo, string_agg('  - ' || point, chr(10) order by k) as text from (select distinct repo, ext from ch) join p using (ext) group by repo"""
)
def change_checklist(spark, sf_dir):
    return T.checklist(_changes(spark, sf_dir))


@query(f"with {_CHANGES} select repo, string_agg(case when k % 3 = 0 then 'R  q/' || k || ' -> p/' || k || ext else ' M p/' || k || ext end, chr(10) order by k) as text from ch group by repo")
def status_lines(spark, sf_dir):
    return status_text(_changes(spark, sf_dir), "k")


@query(
    """select * from (values ('SessionStart', 1, ':session-start'), ('PreToolUse', 2, 'Write|Edit|MultiEdit:pre-edit,Grep|Glob|Bash:pre-search'), ('PostToolUse', 3, 'Write|Edit|MultiEdit:post-edit'), ('UserPromptSubmit', 4, ':user-prompt'),
 ('SubagentStart', 5, ':subagent-start'), ('Stop', 6, ':stop'), ('SessionEnd', 7, ':session-end')) t(event, place, registrations)"""
)
def hook_registrations(spark, sf_dir):
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate(T.REGISTRATIONS)], "ord int, event string, matcher string, mode string")
    text = F.array_join(F.transform("registrations", lambda r: F.concat(r["matcher"], F.lit(":"), r["mode"])), ",")
    return T.grouped_registrations(rows).select("event", "place", text.alias("registrations"))


@query(
    """with a as (select event_id as k, event_id // 10 as path from events)
 select path, 'The cleaner removed ' || count(*) || ' invisible marker(s) from ' || path || ':' || chr(10) || string_agg('  line ' || k % 7 || '  U+' || case when k % 3 = 1 then '00A0 no-break space (replaced with a space)' else '200B zero width space (removed)' end || chr(10), '' order by k % 7, k)
 || 'The file on disk changed AFTER your write. Re-read it before your next edit.' as text from a group by path"""
)
def clean_notices(spark, sf_dir):
    k = F.col("event_id")
    space = k % 3 == 1
    acted = table(spark, sf_dir, "events").select(F.floor(k / 10).alias("path"), (k % 7).alias("line"), k.alias("byte_offset"), F.when(space, 0xA0).otherwise(0x200B).alias("code_point"), F.when(space, 1).otherwise(0).alias("mark_class"), F.when(space, "no-break space").otherwise("zero width space").alias("mark_name"))
    return T.clean_notice(acted)


@query(
    """with r as (select o_orderkey as run, o_orderkey % 11 as code, o_orderkey % 5 as shape from orders), x as (select *, code not in (0, 1, 7) as bad from r)
 select run, 'golangci-lint' as analyzer_id, 2 as severity, '' as file, 0::bigint as line, case when bad then 'golangci-lint failed: err ' || run else 'failed to parse golangci-lint output' end as message from x where bad or shape = 0
 union all select run, 'golangci-lint/nilerr', 1, 'p/a.go', 3::bigint, 'in' from x where not bad and shape > 0
 union all select run, 'golangci-lint', 1, '', 0::bigint, 'dropped ' || (shape - 1) || ' finding(s) naming files outside the analysed project' from x where not bad and shape > 1"""
)
def lint_findings(spark, sf_dir):
    k = F.col("o_orderkey")
    issue = lambda file, text: F.lit(f'{{"FromLinter":"nilerr","Text":"{text}","Severity":"warn","Pos":{{"Filename":"{file}","Line":3}}}}')
    listed = F.array_join(F.concat(F.array(issue("p/a.go", "in")), F.array_repeat(issue("../b.go", "out"), (k % 5 - 1).cast("int"))), ",")
    out = F.when(k % 5 == 0, "nothing here").otherwise(F.concat(F.lit('noise {"Issues":['), listed, F.lit("]}")))
    return N.lint_findings(table(spark, sf_dir, "orders").select(k.alias("run"), (k % 11).cast("int").alias("exit_code"), out.alias("stdout"), F.concat(F.lit("err "), k).alias("stderr")))


@query(
    """with c as (select s_suppkey as path, unnest([case when s_suppkey % 2 = 0 then 'nilerr' else 'errcheck' end, 'gofmt', case when s_suppkey % 3 = 0 then 'thelper' else 'lll' end]) as linter, unnest([0, 1, 2]) as ord from supplier)
 select path, ord, linter from c where linter in ('nilerr', 'thelper')"""
)
def forced_linters_disabled(spark, sf_dir):
    k = F.col("s_suppkey")
    listed = F.array(F.when(k % 2 == 0, "nilerr").otherwise("errcheck"), F.lit("gofmt"), F.when(k % 3 == 0, "thelper").otherwise("lll"))
    return N.disabled_forced(table(spark, sf_dir, "supplier").select(k.alias("path"), listed.alias("disable")))


_FLAGS = (("severity", "error"), ("severity", "fatal"), ("severity", ""), ("extra-types", "release,hot-fix"), ("extra-types", "a,,b"), ("extra-types", "Big"), ("scope", "changed"), ("scope", ""), ("preset", "strict"), ("preset", "loose"))


@query(
    """select p_partkey as k, * from part, (values ('severity', 'fatal', 'error|info|warning', 1), ('extra-types', 'a,,b', 'a comma-separated list of lowercase names', 4), ('extra-types', 'Big', 'a comma-separated list of lowercase names', 5),
 ('scope', '', 'full|changed|commit', 7), ('preset', 'loose', 'minimal|recommended|strict', 9)) t(flag, value, want, place) where p_partkey % 10 = place""".replace("select p_partkey as k, *", "select flag, value, want")
)
def flag_validation(spark, sf_dir):
    pick = F.element_at(F.array(*(F.struct(F.lit(a).alias("flag"), F.lit(b).alias("value")) for a, b in _FLAGS)), (F.col("p_partkey") % len(_FLAGS) + 1).cast("int"))
    return N.flag_problems(table(spark, sf_dir, "part").select(pick.alias("p")).select("p.*"))


@query(
    f"""with {COMMITS}, last as (select repo, seq, subject from commit_msgs qualify row_number() over (partition by repo order by seq desc) = 1)
 select repo, subject, seq * 10 as author_epoch from last"""
)
def head_lookup(spark, sf_dir):
    return H.heads(commit_msgs(spark, sf_dir).withColumn("author_epoch", F.col("seq") * 10)).select("repo", "subject", F.col("author_epoch").cast("long"))


@query(
    """with m as (select p_partkey as k, case p_partkey when 40 then 'robot' when 41 then 'clown_face' when 45 then 'beetle' else 'e' || p_partkey end as name from part)
 select name, (case when k % 5 = 0 then 12.0 else 0.6 end)::double as version, 'Objects' as grp, 'tool' as subgroup, case when k % 2 = 0 then k else 0 end::bigint as uses from m
 where k % 4 <> 3 and k % 7 <> 0 and name not in ('robot', 'clown_face') and (k % 5 <> 0 or name = 'beetle')"""
)
def catalog_admission(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.when(k == 40, "robot").when(k == 41, "clown_face").when(k == 45, "beetle").otherwise(F.concat(F.lit("e"), k))
    code = F.concat(F.lit("x"), k)
    # found as written, without its joiner, or with the selector behind; one in four is not known
    shortcodes = p.select(name.alias("name"), F.when(k % 3 == 1, F.concat(code, F.lit("-200d-1"))).otherwise(code).alias("code_points"))
    key = F.when(k % 4 == 3, "none").when(k % 3 == 0, code).when(k % 3 == 1, F.concat(code, F.lit("-1"))).otherwise(F.concat(code, F.lit("-fe0f")))
    sub = F.when(k % 7 == 0, "country-flag").otherwise("tool")
    meta = p.select(key.alias("code_points"), F.when(k % 5 == 0, 12.0).otherwise(0.6).cast("double").alias("version"), F.lit("Objects").alias("grp"), sub.alias("subgroup"))
    uses = p.select(name.alias("name"), F.when(k % 2 == 0, k).cast("long").alias("uses"))
    return H.admitted(shortcodes, meta, uses)


@query(
    f"""with {COMMITS}, lead as (select repo, regexp_extract(subject, '^:([a-z0-9_+-]+):', 1) as name from commit_msgs qualify row_number() over (partition by repo order by seq desc) <= 3),
 t as (select u.repo, n.name, n.rank from (select distinct repo from commit_msgs) u, (values ('bug', 1), ('wrench', 2), ('fire', 3), ('ghost', 4), ('volcano', 5)) n(name, rank))
 select repo, name from t where not exists (select 1 from lead l where l.repo = t.repo and l.name = t.name)"""
)
def suggestion_exclusion(spark, sf_dir):
    commits = commit_msgs(spark, sf_dir)
    names = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(r).alias("rank")) for n, r in (("bug", 1), ("wrench", 2), ("fire", 3), ("ghost", 4), ("volcano", 5)))))
    tiers = commits.select("repo").distinct().select("repo", names.alias("n")).select("repo", F.lit(1).alias("tier"), "n.rank", "n.name")
    return H.suggest(tiers, 7, "seed", "repo", exclude=H.in_use(commits, 3)).select("repo", "name")


@query(
    """with d as (select p_partkey as path, case when p_partkey % 50 = 0 then '' else 'i' || p_partkey % 900 end as id, 'k' || p_partkey % 2 as kind from part)
 select kind, id, path, case when id = '' then 'empty id' else 'duplicate id' end as problem from d qualify id = '' or row_number() over (partition by kind, id order by path) > 1"""
)
def document_ids(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("path"), F.when(k % 50 == 0, "").otherwise(F.concat(F.lit("i"), k % 900)).alias("id"), F.concat(F.lit("k"), k % 2).alias("kind"))
    return N.id_problems(rows)


@query("select c_custkey % 3 as profile, c_custkey as skill from customer where c_custkey not in (select s_suppkey from supplier)")
def override_ids(spark, sf_dir):
    return N.unknown_overrides(table(spark, sf_dir, "customer").select((F.col("c_custkey") % 3).alias("profile"), F.col("c_custkey").alias("id")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))


@query(
    """with g as (select s_suppkey as artifact, 's' || s as scenario, s_suppkey % 3 + s as passed, 4 as machine, s as judge from supplier, range(3) r(s))
 select artifact, scenario, sum(passed)::bigint as passed, sum(machine)::bigint as machine, sum(judge)::bigint as judge from g group by rollup (artifact, scenario)"""
)
def grade_totals(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("artifact"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("s"))
    return N.grade_totals(s.select("artifact", F.concat(F.lit("s"), "s").alias("scenario"), (F.col("artifact") % 3 + F.col("s")).alias("passed"), F.lit(4).alias("machine"), F.col("s").alias("judge")))


@query("""select event_id as k, event_id % 4 in (0, 1) as searches from events""")
def source_searches(spark, sf_dir):
    k = F.col("event_id")
    command = F.when(k % 4 == 0, "  /usr/bin/rg x").when(k % 4 == 2, "grepx y").otherwise("")
    rows = table(spark, sf_dir, "events").select(k.alias("k"), F.lit("Bash").alias("tool_name"), F.lit("").alias("pattern"), F.when(k % 4 == 1, "**/*.GO").otherwise("").alias("glob"), F.lit("p").alias("path"), command.alias("command"))
    return K.searches_source(rows).select("k", "searches")
