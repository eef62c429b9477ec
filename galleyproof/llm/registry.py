"""The queries of this folder and, where SQL can express one, its oracle."""

from __future__ import annotations

from galleyproof.llm import decontam, htmltext, mjpeg, neardup, ngramtrie, repeats, spcodec, tokencounts, tokenfile, toxicity

QUERIES = {
    "op2_token_binary_output": tokenfile.op2_token_binary_output,
    "op8_token_counts": tokencounts.op8_token_counts,
    "op10_sentencepiece_codec": spcodec.op10_sentencepiece_codec,
    "op5_suffix_array_dedup": repeats.op5_suffix_array_dedup,
    "op1_html_extraction": htmltext.op1_html_extraction,
    "op7_toxicity": toxicity.op7_toxicity,
    "op3_lm_scoring": ngramtrie.op3_lm_scoring,
    "op4_ngram_jaccard_join": neardup.op4_ngram_jaccard_join,
    "op9_media_columns": mjpeg.op9_media_columns,
    "op6_decontamination": decontam.op6_decontamination,
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_FOLD}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

ORACLE_SQL: dict[str, str] = {
    "op5_suffix_array_dedup": """with d as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
 -- blocks first, as a window far into a long string is slow to cut
 blk as (select rid, doc_id, p0, substr(h, 2 * p0 + 1, 2 * (256 + 49)) as h from (select rid, doc_id, h, unnest(range(0, length(h) // 2, 256)) as p0 from d)),
 w as (select rid, doc_id, p0 + i as i, substr(h, 2 * i + 1, 100) as s from (select rid, doc_id, p0, h, unnest(range(0, length(h) // 2 - 49)) as i from blk where length(h) >= 100)),
 f as (select s, min(doc_id) as least_id from w group by s having count(*) > 1),
 hit as (select rid, i from w join f using (s) where least_id < doc_id),
 mark as (select rid, i, case when i > lag(i) over (partition by rid order by i) + 50 or lag(i) over (partition by rid order by i) is null then 1 else 0 end as fresh from hit),
 run as (select rid, i, sum(fresh) over (partition by rid order by i) as g from mark),
 span as (select rid, min(i) as a, max(i) + 50 as b from run group by rid, g),
 cut as (select rid, a, b, lag(b, 1, 0) over (partition by rid order by a) as before from span),
 kept as (select c.rid, string_agg(substr(d.h, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(any_value(d.h), 2 * max(b) + 1) as k, sum(b - a) as removed, count(*) as n from cut c join d using (rid) group by c.rid)
 select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256 from d left join kept using (rid)""",
    "op6_decontamination": f"""with d as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
 b as (select item_id::varchar as item, {_WORDS} as w from benchmark),
 win as (select distinct item, least(len(w), 10) as k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as s from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
 ks as (select distinct k from win),
 pos as (select rid, k, i, array_to_string(w[i:i + k - 1], ' ') as s from (select rid, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
 occ as (select distinct rid, i, k, item from pos join win using (k, s)),
 hits as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + k)) as p from occ) group by rid),
 items as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as l from (select distinct rid, item from occ) group by rid)
 select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
 from d left join hits using (rid) left join items using (rid)""",
}
