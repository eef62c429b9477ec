"""Queries on hook events and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleyproof.operators import hooks as K
from galleyproof.plans.carriers import HOOKS, hook_events, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


_EPOCH = f"""{HOOKS}, ep as (select case when session_id = '' then 'nosession' else session_id end as session_id, seq, mode, content from hook_events),
 eps as (select *, count(*) filter (mode = 'session-end') over (partition by session_id order by seq rows between unbounded preceding and 1 preceding) as epoch from ep)"""


@query(f"with {_EPOCH} select session_id, seq, content from eps where mode <> 'session-end' qualify row_number() over (partition by session_id, epoch, content order by seq) = 1")
def once_per_session(spark, sf_dir):
    return K.once_per_session(hook_events(spark, sf_dir), "content").select("session_id", "seq", "content")


_EMITTED = f"with {_EPOCH} select session_id, seq, lag(content) over (partition by session_id, epoch order by seq) is distinct from content as emitted from eps where mode <> 'session-end'"


@query(_EMITTED)
def first_emission(spark, sf_dir):
    return K.first_emission(hook_events(spark, sf_dir)).select("session_id", "seq", "emitted")


@query(_EMITTED)
def stream_first_emission(spark, sf_dir):
    """The streaming form over the same events, read as a stream of files and collected in memory."""
    import uuid

    from galleyproof.operators.graph import cut, shared_folder
    from galleyproof.streaming.emission import first_emission_stream

    events = hook_events(spark, sf_dir)
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{base}/in")
    done = first_emission_stream(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination()
    return cut(spark.read.schema("session_id string, seq long, mode string, content string, emitted boolean").parquet(f"{base}/out").select("session_id", "seq", "emitted"))


@query("""with j as (select event_id, case event_id % 4 when 0 then '{"session_id":"s' || user_id || '","tool_name":"Bash","tool_input":{"command":"rg x","file_path":"a/' || event_id || '.go"}}' when 1 then '{"session_id":"t"}' when 2 then '{bad' else '' end as json from events)
 select event_id, case event_id % 4 when 0 then json ->> '$.session_id' when 1 then 't' else '' end as session_id, case event_id % 4 when 0 then 'a/' || event_id || '.go' else '' end as file_path, event_id % 4 = 0 as searches from j""")
def hook_payload(spark, sf_dir):
    k = F.col("event_id")
    j = F.when(k % 4 == 0, F.concat(F.lit('{"session_id":"s'), "user_id", F.lit('","tool_name":"Bash","tool_input":{"command":"rg x","file_path":"a/'), k, F.lit('.go"}}'))).when(k % 4 == 1, '{"session_id":"t"}').when(k % 4 == 2, "{bad").otherwise("")
    return K.searches_source(K.payload(table(spark, sf_dir, "events").select("event_id", j.alias("json")))).select("event_id", "session_id", "file_path", "searches")


@query("""with l as (select event_type as name, event_id as seq, props || event_id as line from events), s as (select *, sum(strlen(line) + 1) over (partition by name order by seq desc) as back, sum(strlen(line) + 1) over (partition by name) as total from l)
 select name, seq from s where total <= 2000 or back < 1000""")
def log_tail(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("seq"), F.concat("props", "event_id").alias("line"))
    return K.tail_by_bytes(e, 2000).select("name", "seq")


@query("""with l as (select user_id as name, event_id as line_no, case when event_id % 9 = 0 then '# group: g' || event_id when event_id % 9 = 5 then '# other' else props end as line from events)
 select name, line_no, grp from (select *, last_value(case when line like '# group: %' then substr(line, 10) end ignore nulls) over (partition by name order by line_no rows between unbounded preceding and current row) as grp from l) where line not like '#%'""")
def header_carry_forward(spark, sf_dir):
    k = F.col("event_id")
    line = F.when(k % 9 == 0, F.concat(F.lit("# group: g"), k)).when(k % 9 == 5, "# other").otherwise(F.col("props"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("name"), k.alias("line_no"), line.alias("line"))
    return K.carry_headers(e).select("name", "line_no", "grp")
