"""SQL that the numbered queries must equal, where SQL can say it."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op1_source_mixing"] = r"""
with d as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')) k,
    cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) size from documents),
s as (
  select source, cast(sum(size) as bigint) source_size,
    (row_number() over (order by source asc nulls last) - 1) % 3 class from d group by source),
w as (select *, [3.0::double, 1.0::double, 2.0::double][class + 1] weight, source_size * 2.0::double lim from s),
u as (
  select *, cast(sum(source_size) over () as bigint) * 1.5::double
      - coalesce(sum(lim) over (order by lim / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0) room,
    sum(weight) over ()
      - coalesce(sum(weight) over (order by lim / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0) open
  from w),
f as (select *, lim * open <= room * weight is_full from u),
l as (select *, arg_min(room / open, -open) filter (where not is_full) over () level from f),
t as (select source, class, source_size, case when is_full then lim else level * weight end target from l),
c as (
  select d.doc_id, d.size, t.class, t.source_size, t.target,
    sum(d.size) over (partition by t.source order by d.k, d.size rows between unbounded preceding and current row) - d.size start
  from d join t on d.source is not distinct from t.source),
x as (
  select *, greatest(0, least(size, floor(target) - start)) take0, greatest(0, least(size, floor(target) - start - source_size)) take1,
    start / target used
  from c),
p as (
  select *, case class when 0 then used * 3.0::double when 1 then used else used * 2.0::double end area,
    case class when 0 then 4.5::double when 1 then 0.5::double else 2.0::double end w0,
    case class when 0 then -6.0::double when 1 then 2.0::double else 0.0::double end slope
  from x)
select doc_id, size, source_size, target, cast(take0 + take1 as bigint) taken,
  case when take0 > 0 then round(case when area < case class when 0 then 3.0 when 1 then 1.0 else 2.0 end
    then area * 2.0 / (w0 + sqrt(greatest(0.0, w0 * w0 + slope * area))) else 1.0 end, 6) end "position"
from p"""

SQL["op4_chat_windows"] = r"""
with t as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
n as (
  select *, row_number() over c rn, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 tokens,
    length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 32 chars
  from t window c as (partition by conv_id order by turn nulls first, role, text)),
b as (
  select *, floor((sum(tokens) over u - tokens) / 128) room, tokens > 128 long, count(*) filter (where tokens > 128) over u
      - case when tokens > 128 then 1 else 0 end longs
  from n window u as (partition by conv_id order by rn rows between unbounded preceding and current row)),
f as (
  select conv_id, min(rn) first, 512 - sum(tokens) rest from b group by conv_id, room, longs, long having min(rn) > 1),
l as (
  select f.conv_id, f.first, case when s.tokens <= f.rest then s.chars else 0 end chars,
    f.rest - case when s.tokens <= f.rest then s.tokens else 0 end rest
  from f left join b s on s.conv_id is not distinct from f.conv_id and s.rn = 1 and s.role = 'system'),
h as (
  select l.conv_id, coalesce(l.chars, 0) + case when x.tokens <= l.rest then x.chars else 0 end
    + case when y.tokens + x.tokens <= l.rest then y.chars else 0 end chars
  from l
  left join b x on x.conv_id is not distinct from l.conv_id and x.rn = l.first - 1 and not (x.rn = 1 and x.role = 'system')
  left join b y on y.conv_id is not distinct from l.conv_id and y.rn = l.first - 2 and not (y.rn = 1 and y.role = 'system')),
r as (select conv_id, sum(chars) chars from h group by conv_id),
g as (
  select conv_id, cast(count(*) as bigint) n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by rn)) turns_sha256,
    coalesce(string_agg(text, '' order by rn) filter (where role = 'assistant'), '') loss, sum(chars) chars
  from b group by conv_id)
select g.conv_id, n_turns, turns_sha256, cast(length(loss) as bigint) loss_chars, sha256(loss) loss_sha256,
  cast(g.chars + coalesce(r.chars, 0) as bigint) formatted_chars
from g left join r on g.conv_id is not distinct from r.conv_id"""


SQL["op13_exact_duplicates"] = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) text_sha256 from documents)
select doc_id, min(doc_id) over (partition by text_sha256) keep_id, cast(count(*) over (partition by text_sha256) as bigint) group_size,
  row_number() over (partition by text_sha256 order by doc_id nulls last) = 1 kept, text_sha256 from d"""

SQL["op12_conversation_trie"] = r"""
with t as (
  select conv_id c, turn, coalesce(text, '') text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) m
  from conversations where conv_id is not null),
n as (select c, m, length(text) chars, row_number() over (partition by c order by turn nulls first, m) rn from t),
v as (
  select c, count(*) own, c - c % 100 lender, list_reduce(
    [4294967295::bigint] || list_transform(range(1, length(c::varchar) + 1), lambda i: ascii(substr(c::varchar, i, 1))::bigint),
    lambda r, x: list_reduce([xor(r, x)] || [k::bigint for k in range(8)],
      lambda y, k: case when y & 1 = 1 then xor(y >> 1, 3988292384) else y >> 1 end)) r from n group by c),
i as (
  select v.c, v.own, v.lender, xor(v.r, 4294967295) % 6 h, least(xor(v.r, 4294967295) % 6, coalesce(b.own, 0)) head
  from v left join v b on b.c = v.lender),
s as (
  select i.c, b.rn depth, b.m, b.chars from i join n b on b.c = i.lender and b.rn <= i.h
  union all select i.c, n.rn - i.h + i.head, n.m, n.chars from i join n on n.c = i.c and n.rn > i.h),
p as (
  select c, depth, chars, string_agg(m, '') over (partition by c order by depth) path from s
  union all select c, 0, 0, '' from i),
g as (
  select path, max(depth) depth, min(p.c) conv_id, count(*) n_convs, (count(*) - 1) * max(chars) saved,
    coalesce(string_agg(p.c::varchar, ',' order by p.c) filter (where depth = head + greatest(own - h, 0)), '') ends
  from p join i on p.c = i.c group by path),
k as (select left(path, length(path) - 32) path, count(*) n from g where depth > 0 group by 1),
a as (
  select left(path, 32 * d) path, sum(saved) saved, count(*) filter (where not exists (select 1 from k where k.path = g.path)) leaves
  from g, unnest(range(depth + 1)) u(d) group by 1)
select g.conv_id, cast(g.depth as bigint) depth, q.conv_id parent_conv_id, g.n_convs, coalesce(k.n, 0) n_children,
  a.leaves n_leaves, cast(a.saved as bigint) saved_tokens, sha256(g.ends) ends_sha256
from g join a on a.path = g.path left join k on k.path = g.path
left join g q on g.depth > 0 and q.path = left(g.path, length(g.path) - 32)"""

SQL["op11_hard_negatives"] = r"""
with v as (
  select vec_id id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end lab,
    list_transform(embedding, lambda x: floor(256 * x::double)) x, row_number() over () no
  from embeddings where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.no anchor, a.id anchor_id, b.id, b.lab = a.lab same, cast(list_dot_product(a.x, b.x) as bigint) score
  from v a join v b on a.no <> b.no and len(a.x) = len(b.x) where a.id % 100 = 0),
p as (
  select * from s where same
  qualify row_number() over (partition by anchor order by score desc, id nulls last) <= 5),
n as (
  select p.anchor_id, p.id positive_id, row_number() over (
      partition by p.anchor, p.id order by s.score desc, s.id nulls last) "rank",
    s.id negative_id, p.score positive_score, s.score negative_score
  from p join s on s.anchor = p.anchor and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, cast("rank" as int) "rank", negative_id, positive_score, negative_score from n where "rank" <= 10"""
