"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from .common import documents
from .decontaminate import op10_decontaminate
from .fingerprints import op6_fingerprints
from .lines import op1_line_dedup
from .packing import packed_pieces
from .secrets import secrets
from .simhash import op2_simhash
from .suffixes import op4_suffix_dedup
from .tokencount import counts
from .toxicity import op9_toxicity
from .warc import op3_warc


OP3 = """with p as (select page_id, encode(coalesce(html, '')) as b from pages),
 g as (select b, max(page_id) as top from p where page_id is not null and octet_length(b) >= 1000 group by b)
 select p.page_id, octet_length(p.b)::bigint as payload_bytes, sha1(p.b) as payload_digest,
 case when p.page_id < g.top then 'revisit' else 'response' end as record_type, case when p.page_id < g.top then g.top end as refers_to
 from p left join g on p.b = g.b"""
OP4 = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
 s as (select doc_id, h, length(h) // 2 as n from d),
 w as (select doc_id, p, substr(h, 2 * p + 1, 200) as x from (select doc_id, h, unnest(generate_series(0, n - 100)) as p from s where n >= 100)),
 r as (select doc_id, p from (select doc_id, p, row_number() over (partition by x order by doc_id, p) as k from w) where k > 1),
 i as (select doc_id, p, sum((before is null or p > before + 100)::int) over (partition by doc_id order by p) as g from (select doc_id, p, lag(p) over (partition by doc_id order by p) as before from r)),
 sp as (select doc_id, min(p) as a, max(p) + 100 as b from i group by doc_id, g),
 e as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as last from sp),
 k as (select s.doc_id, s.n, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' order by a) as head, coalesce(max(b), 0) as tail, coalesce(sum(b - a), 0) as gone, count(a) as spans, any_value(h) as h from s left join e using (doc_id) group by s.doc_id, s.n)
 select doc_id, n::bigint as n_bytes, gone::bigint as n_removed, spans::bigint as n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * tail + 1))) as kept_sha256 from k"""
LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP10 = f"""with d as (select doc_id, regexp_extract_all({LOW.format("coalesce(text, '')")}, '{WORD}') as w from documents),
 b as (select item_id::varchar as item, regexp_extract_all({LOW.format("coalesce(text, '')")}, '{WORD}') as w from benchmark),
 bw as (select distinct item, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as x from (select item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from b where len(w) > 0)),
 ns as (select distinct n from bw),
 dw as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as x from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d cross join ns where len(w) >= n)),
 m as (select doc_id, i, bw.n, item from dw join bw on dw.n = bw.n and dw.x = bw.x),
 h as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as j from m) group by 1),
 t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from m) group by 1)
 select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join h using (doc_id) left join t using (doc_id)"""
OP1 = f"""with l as (select doc_id, generate_subscripts(x, 1) - 1 as k, unnest(x) as line from (select doc_id, string_split(text, chr(10)) as x from documents where text is not null)),
 w as (select doc_id, k, line, list_sort(list_distinct(regexp_extract_all({LOW.format("line")}, '{WORD}'))) as w from l),
 s as (select w, len(w) as n, min((doc_id, k)) as place from w where len(w) > 0 group by w),
 t as (select place, n, unnest(w) as t from s),
 c as (select a.place, a.n, b.n as m, count(*) as c from t a join t b on a.t = b.t and b.place < a.place and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) group by a.place, b.place, a.n, b.n),
 near as (select distinct place from c where 5 * c >= 4 * (n + m - c)),
 r as (select w.doc_id, w.k, w.line, len(w.w) > 0 and ((w.doc_id, w.k) <> s.place or near.place is not null) as gone from w left join s on w.w = s.w left join near on near.place = s.place)
 select d.doc_id, count(k) as n_lines, coalesce(sum(gone::int), 0)::bigint as n_removed, sha256(coalesce(string_agg(line, chr(10) order by k) filter (not gone), '')) as kept_sha256 from documents d left join r using (doc_id) group by 1"""


def queries():
    read = lambda s, d, t: s.read.parquet(f"{d}/{t}.parquet")
    return {
        "op1_line_dedup": lambda s, d: op1_line_dedup(documents(s, d)),
        "op2_simhash": lambda s, d: op2_simhash(documents(s, d)),
        "op3_warc": lambda s, d: op3_warc(read(s, d, "pages")),
        "op4_suffix_dedup": lambda s, d: op4_suffix_dedup(documents(s, d)),
        "op5_packing": lambda s, d: packed_pieces(documents(s, d)),
        "op6_fingerprints": lambda s, d: op6_fingerprints(documents(s, d)),
        "op7_token_counts": lambda s, d: counts(documents(s, d)),
        "op8_secrets": lambda s, d: secrets(documents(s, d)),
        "op9_toxicity": lambda s, d: op9_toxicity(documents(s, d), read(s, d, "labels")),
        "op10_decontaminate": lambda s, d: op10_decontaminate(documents(s, d), read(s, d, "benchmark")),
    }


def oracle_sql():
    """What SQL can express; the others are tested against brute force, round trips and held-out accuracy."""
    return {"op1_line_dedup": OP1, "op3_warc": OP3, "op4_suffix_dedup": OP4, "op10_decontaminate": OP10}
