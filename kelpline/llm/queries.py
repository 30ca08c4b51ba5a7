"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kelpline.llm import decontaminate, language, minhash, packing, private, quality, ranked_search, secrets, simhash, suffixes, token_files, toxicity, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": suffixes.op1_suffix_array_dedup,
    "op2_token_output": token_files.op2_token_output,
    "op3_language_id": language.op3_language_id,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_private_data": private.op5_private_data,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op11_minhash_near_dedup": minhash.op11_minhash_near_dedup,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}
_OP1 = r"""
with d as (select doc_id, hex(encode(coalesce(text,''))) as h, octet_length(encode(coalesce(text,''))) as n from documents),
p as (select doc_id, i, md5(substr(h, 2*i+1, 100)) as w from (select doc_id, h, n, unnest(range(0, n-49)) as i from d where n>=50)),
s as (select doc_id, i, w, min(doc_id) over (partition by w) as least from p),
g as (select doc_id, i, case when i-50 <= lag(i) over (partition by doc_id order by i) then 0 else 1 end as new from s where least<doc_id),
r as (select doc_id, min(i) as a, max(i)+50 as b from (select doc_id, i, sum(new) over (partition by doc_id order by i rows unbounded preceding) as run from g) group by doc_id, run),
l as (select *, lag(b) over (partition by doc_id order by a) as before, row_number() over (partition by doc_id order by a desc) as last from r),
k as (select doc_id, count(*) as n_spans, sum(b-a) as n_removed, string_agg(substr(h, 2*coalesce(before,0)+1, 2*(a-coalesce(before,0)))||case when last=1 then substr(h, 2*b+1) else '' end, '' order by a) as kept from l join d using (doc_id) group by 1)
select d.doc_id, n as n_bytes, cast(coalesce(n_removed,0) as bigint) as n_removed, coalesce(n_spans,0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join k using (doc_id)
"""

_OP9 = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
bw as (select distinct item_id, least(len(ws),10) as n, list_slice(ws, i, i+least(len(ws),10)-1) as win from (select item_id, ws, unnest(range(1, greatest(len(ws)-9,1)+1)) as i from b where len(ws)>0)),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, list_slice(ws, i, i+n-1) as win from (select doc_id, ws, n, unnest(range(1, len(ws)-n+2)) as i from w cross join sizes where len(ws)>=n)),
h as (select doc_id, i, n, item_id from dw join bw using (n, win)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i+n)) as p from (select distinct doc_id, i, n from h)) group by 1),
it as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as items from (select distinct doc_id, cast(item_id as varchar) as s from h) group by 1)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit,0) as n_hit, coalesce(n_items,0) as n_items, sha256(coalesce(items,'')) as items_sha256, coalesce(n_hit,0)>0 as contaminated
from w left join hit using (doc_id) left join it using (doc_id)
"""

_LOWER = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"

_OP11 = rf"""
with recursive w as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as ws from documents),
s as materialized (select distinct r, hash(s) as s from (select r, unnest(case when len(ws)=1 then [ws[1]] else list_transform(range(1, len(ws)), lambda i: ws[i]||' '||ws[i+1]) end) as s from w where len(ws)>0)),
n as (select r, count(*) as n from s group by 1),
sized as materialized (select s.r, s.s, n.n from s join n using (r)),
links as materialized (select a.r as a, b.r as b from sized a join sized b on a.s=b.s and a.r<b.r and 5*least(a.n,b.n)>=4*greatest(a.n,b.n) group by a.r, b.r, a.n, b.n having 100*count(*)>=80*(a.n+b.n-count(*))),
pairs as materialized (select a, b from links union all select b, a from links),
reach(a, b) as (select r, r from n union select reach.a, pairs.b from reach join pairs on reach.b=pairs.a),
comp as (select reach.a as r, min(w.doc_id) as c from reach join w on w.r=reach.b group by 1)
select doc_id, coalesce(n,0) as n_shingles, case when n is null then doc_id else c end as component_id, doc_id is not distinct from (case when n is null then doc_id else c end) as kept from w left join n using (r) left join comp using (r)
"""


def _coded(codebook: str) -> str:
    """Of each part its squared distance to the nearest entry, times 256, plus that entry."""
    return f"(select r, p, min(d*256+i) as best from (select x.r, x.p, c.i, sum((x.v-c.v)*(x.v-c.v))::bigint as d from x join {codebook} c on x.p=c.p and x.j=c.j group by all) group by 1, 2)"


_ROUNDS = ",\n".join(
    f"a{k} as materialized {_coded(f'c{k}')},\n"
    f"m{k} as (select x.p, a.best%256 as i, x.j, sum(x.v)::bigint as s, count(*) as n from x join a{k} a using (r, p) group by all),\n"
    f"c{k + 1} as materialized (select c.p, c.i, c.j, coalesce((m.s-(m.s%m.n+m.n)%m.n)//m.n, c.v) as v from c{k} c left join m{k} m using (p, i, j))"
    for k in range(4)
)
_OP12 = rf"""
with v as (select row_number() over (order by vec_id, embedding) as r, vec_id, label, embedding as e from embeddings where embedding is not null and len(embedding)>0 and len(embedding)%4=0 and len(list_filter(embedding, lambda y: y is null or not isfinite(y)))=0),
x as materialized (select r, k*4//n as p, k%(n//4) as j, floor(1024*y::double)::bigint as v from (select r, len(e) as n, unnest(range(len(e))) as k, unnest(e) as y from v)),
c0 as materialized (select p, r-1 as i, j, v from x where r<=256),
{_ROUNDS},
a4 as materialized {_coded("c4")},
o as (select r, string_agg(printf('%02x', best%256), '' order by p) as code, sum(best//256)::bigint as error from a4 group by 1)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, (select sha256(string_agg(v::varchar, ',' order by p, i, j)) from c4) as codebooks_sha256 from o join v using (r)
"""

_OP13 = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
s as (select count(*) filter (len(ts)>0) as n_docs, sum(len(ts))::bigint as n_terms from d),
q as materialized (select distinct item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
p as materialized (select r, n, t, count(*) as tf from (select r, len(ts) as n, unnest(ts) as t from d) where t in (select t from q) group by all),
w as materialized (select t, floor(1000*ln((2*n_docs+2)/(2*count(*)+1)))::bigint as w from p, s group by t, n_docs),
g as (select item_id, r, sum(w*((1000000000*tf)//(1000*tf+20*(50+(50*n*n_docs)//n_terms))))::bigint as score from q join p using (t) join w using (t), s group by 1, 2)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from g join d using (r) where score>0 qualify rank<=50
"""


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of operator 7 that don't come from its model."""
    return quality.op7_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def private_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of operator 5."""
    return private.op5_private_data(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in private.BASE])


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of operator 10."""
    return secrets.op10_secret_scan(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in secrets.KINDS[:3]])


_QUALITY = r"""
with w as (select row_number() over () as r, doc_id, coalesce(text,'') as t, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select r, i, list_slice(ws, i, i+4) as g from (select r, ws, unnest(range(1, len(ws)-3)) as i from w where len(ws)>=5)),
h as (select r, count(distinct p) as n_repeat_words from (select r, unnest(range(i, i+5)) as p from (select *, count(*) over (partition by r, g) as c from g) where c>1) group by 1),
l as (select r, count(*)-count(distinct line) as n_dup_lines from (select r, unnest(string_split(t, chr(10))) as line from w) where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1)
select doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws,'')) as bigint) as word_chars, cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols, coalesce(n_dup_lines,0) as n_dup_lines,
 coalesce(n_repeat_words,0) as n_repeat_words, len(ws)<10 or 100*coalesce(n_repeat_words,0)>20*len(ws) as base_failed from w left join h using (r) left join l using (r)
"""

_DIGITS = "regexp_replace(m,'[^0-9]','','g')"
_PRIVATE = rf"""
with d as (select doc_id, coalesce(text,'') as t from documents)
select doc_id, cast(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) as bigint) as n_email,
 cast(len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda m: list_max(list_transform(string_split(m,'.'), lambda p: try_cast(p as double)))<=255)) as bigint) as n_ip,
 cast(len(list_filter(list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda m: reverse({_DIGITS})), lambda x: length(x) between 13 and 19
  and list_sum(list_transform(range(1, length(x)+1), lambda i: case when i%2=1 then cast(x[i] as int) when cast(x[i] as int)>4 then 2*cast(x[i] as int)-9 else 2*cast(x[i] as int) end))%10=0)) as bigint) as n_card,
 cast(len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda m: length({_DIGITS}) between 9 and 15)) as bigint) as n_phone from d
"""

_SECRET = r"""
with d as (select doc_id, coalesce(text,'') as t from documents)
select doc_id, cast(len(list_filter(regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda m: length(m)>=6)) as bigint) as n_assign,
 cast(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda m: length(m)>=20)) as bigint) as n_access, cast(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda m: length(m)>=24)) as bigint) as n_hex from d
"""

QUERIES |= {f.__name__: f for f in (quality_base, private_counts, secret_counts)}
#: The others need a tokenizer, XXH64, or a trained model, and are tested against plain versions; of some the columns that need none are queries of their own.
ORACLE: dict[str, str] = {"op1_suffix_array_dedup": _OP1, "op9_benchmark_decontamination": _OP9, "op11_minhash_near_dedup": _OP11, "op12_vector_codes": _OP12, "op13_ranked_search": _OP13, "quality_base": _QUALITY, "private_counts": _PRIVATE, "secret_counts": _SECRET}
