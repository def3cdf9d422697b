"""SQL of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JOIN = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') as ws from documents),
spot as (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) as i from w where len(ws) > 0),
s as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g from spot),
n as (select doc_id, count(*) as n from s group by 1),
link as (select a.doc_id as u, b.doc_id as v from s a join s b on a.g = b.g and a.doc_id <> b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by 1, 2 having 100 * count(*) >= 80 * (max(na.n) + max(nb.n) - count(*))),
reach as (select doc_id, doc_id as r from documents union select l.v, r from reach join link l on l.u = reach.doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id from documents d left join n using (doc_id) join (select doc_id, min(r) as component_id from reach group by 1) c using (doc_id)"""

PRODUCTS = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from p qualify rank <= 5"""

CHAT = """
with recursive u as (select conv_id, turn, text from conversations where role = 'user'),
lev as (select conv_id, turn, 0 as level from u where turn % 8 < 2 or not exists (select 1 from u b where b.conv_id = u.conv_id and b.turn = u.turn - 2)
  union all select u.conv_id, u.turn, level + 1 from lev join u on u.conv_id = lev.conv_id and u.turn = lev.turn + 2 where u.turn % 8 >= 2),
call as (select u.conv_id, u.turn, concat('c', u.conv_id, '-', u.turn) as id, level, case when u.turn % 4 < 2 then 'answer' else 'search' end as name,
  case when u.turn % 4 < 2 then concat('{"query":', to_json(text), case when u.turn % 7 <> 6 then concat(',"words":', len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) end, '}') else concat('{"limit":5,"query":', to_json(text), '}') end as arguments,
  case when u.turn % 4 < 2 and u.turn % 7 = 6 then 'words is missing' end as fault from u join lev using (conv_id, turn)),
result as (select conv_id, turn, concat('c', conv_id, '-', turn - 1) as id, text from conversations where role = 'assistant')
select c.conv_id, c.turn, 'call' as kind, c.id as call_id, level, name, fault, case when r.id is null then 'unanswered' else 'answered' end as status,
  case when c.turn % 8 >= 2 then concat('["c', c.conv_id, '-', c.turn - 2, '"]') end as after, concat('{"arguments":', arguments, ',"id":', to_json(c.id), ',"level":', level, ',"name":', to_json(name), ',"result":', coalesce(to_json(r.text)::varchar, 'null'), ',"status":"', case when r.id is null then 'unanswered' else 'answered' end, '"}') as json
from call c left join result r using (conv_id, id)
union all
select conv_id, turn, 'result', id, null, null, null, 'orphan', null, concat('{"id":', to_json(id), ',"level":null,"name":null,"result":', coalesce(to_json(text)::varchar, 'null'), ',"status":"orphan"}') from result r where not exists (select 1 from call c where c.conv_id = r.conv_id and c.id = r.id)
union all
select conv_id, turn, 'message', null, null, null, null, null, null, concat('{"content":', coalesce(to_json(text)::varchar, 'null'), ',"role":', to_json(role), '}') from conversations where role not in ('user', 'assistant')"""


def _shared_out(nodes: str, parents: str, me: str) -> str:
    """SQL of a level's budgets: nodes has cap, w, above; nodes fill up in the order of cap / w."""
    side = f"partition by {parents}" if parents else ""
    return f"""select * exclude (fore, rest, full_, used, free_), case when full_ then cap else (above - used) / free_ * w end as budget from (
  select *, coalesce(sum(cap) filter (full_) over ({side}), 0) as used, sum(w) filter (not full_) over ({side}) as free_ from (
    select *, cap * rest <= (above - fore) * w as full_ from (
      select *, coalesce(sum(cap) over ({side} order by cap / w, {me} rows between unbounded preceding and 1 preceding), 0) as fore, sum(w) over ({side} order by cap / w, {me} rows between current row and unbounded following) as rest from ({nodes}))))"""


_LEAVES = "select domain, lang, source, sum(tokens) as available, case lang when 'en' then 3.0::double when 'de' then 2.0 when 'fr' then 2.0 when 'es' then 2.0 else 1.0 end as w_lang from base group by 1, 2, 3"
MIXING = f"""
with base as (select doc_id, case when regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' then 'other' else concat('d', regexp_extract(source, '([0-9]{{1,9}})$', 1)::int % 4) end as domain,
  coalesce(lang, '') as lang, coalesce(source, '') as source, cast(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as bigint) as tokens, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::bigint as mark from documents),
leaves as ({_LEAVES}),
a as ({_shared_out("select domain, sum(available) * 3.0::double as cap, 1.0::double as w, (select sum(available) from leaves)::double as above from leaves group by 1", "", "domain")}),
b as ({_shared_out("select l.domain, lang, sum(available) * 3.0::double as cap, max(w_lang) as w, max(a.budget) as above from leaves l join a using (domain) group by 1, 2", "domain", "lang")}),
c as ({_shared_out("select l.domain, l.lang, source, sum(available) * 3.0::double as cap, 1.0::double as w, max(b.budget) as above from leaves l join b using (domain, lang) group by 1, 2, 3", "domain, lang", "source")}),
plan as (select domain, lang, source, cast(floor(budget + 1e-6) as bigint) as budget, cast(available as bigint) as available from c join leaves using (domain, lang, source)),
cut as (select *, case when available > 0 then budget // available else 0 end as epochs from plan),
placed as (select base.*, epochs, budget - epochs * available as rest, ('0x' || substr(md5(concat_ws('|', '17', epochs + 1, coalesce(doc_id::varchar, ''), mark)), 1, 15))::bigint as place from base join cut using (domain, lang, source) where tokens > 0),
run as (select *, sum(tokens) over (partition by domain, lang, source order by place, tokens rows unbounded preceding) - tokens as so_far from placed)
select doc_id, domain, lang, source, tokens, cast(epoch as int) as epoch, tokens as taken from (select *, unnest(generate_series(1, epochs)) as epoch from placed)
union all
select doc_id, domain, lang, source, tokens, cast(epochs + 1 as int), cast(least(tokens, rest - so_far) as bigint) from run where so_far < rest"""

#: crc32's table of 256 steps.
_CRC_STEPS = "steps as (select list(v order by i) as t from (select i, list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end) as v from range(256) r(i)))"

#: crc32 of bytes by that table; the published jump hash, shard by shard; slots by rank.
SHARDS = f"""
with recursive {_CRC_STEPS},
bytes as (select row_number() over () as r, doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint) as b from documents),
crc as (select r, doc_id, len(b) + 1 as size, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda a, y: xor(a // 256, t[1 + xor(a % 256, y)])), 4294967295) as text_crc32 from bytes cross join steps),
jump as (select doc_id, case when doc_id < 0 then doc_id::hugeint + 18446744073709551616 else doc_id::hugeint end as k, -1::bigint as b, 0::bigint as j from (select distinct doc_id from documents)
  union all select doc_id, (k * 2862933555777941757 + 1) % 18446744073709551616, j, floor((j + 1) * (2147483648.0::double / ((((k * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 + 1)::double)))::bigint from jump where j < 9),
place as (select doc_id, max(b) filter (b < 8) as shard, max(b) filter (b < 9) as grown_shard from jump group by 1)
select doc_id, cast(size as bigint) as size, text_crc32, 'key' as law, cast(shard as int) as shard, row_number() over (partition by shard order by doc_id, text_crc32, size) - 1 as slot, cast(grown_shard as int) as grown_shard from crc join place using (doc_id)"""

REPEATS = f"""
with w as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
word as (select r, unnest(ws) as x, unnest(generate_series(1, len(ws))) as j, len(ws) as n from w where len(ws) > 0),
spot as (select r, j, string_agg(x, ' ') over (partition by r order by j rows between current row and 34 following) as g from word where n >= 35 qualify j <= n - 34),
again as (select r, j from spot semi join (select g from spot group by g having count(*) > 1) using (g)),
gone as (select distinct r, unnest(generate_series(j, j + 34)) as j from again),
kept as (select r, count(*) as n, string_agg(x, ' ' order by j) as t from word anti join gone using (r, j) group by r)
select doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (r)"""


def _sha_leaf(text: str) -> str:
    parts = (f"case when {c} is null then '-' else concat(strlen({c}::varchar), ':', {c}::varchar) end" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256(concat({', '.join(parts)}))"


def _levels(name: str, depth: int) -> str:
    """SQL of a forest's levels over {name}0 (t, i, d, c: the tree's nodes): a level's runs, then the nodes over them; a tree of one node stays."""
    return ", ".join(
        f"""{name}_run{k} as (select t, i // 16 as p, list(d order by i) as run, max(c) as c from {name}{k} group by all),
{name}{k + 1} as (select t, p as i, case when c = 1 then run[1] else sha256(array_to_string(run, '')) end as d, (c + 15) // 16 as c from {name}_run{k})"""
        for k in range(depth)
    )


def _walk(walk: str, name: str, depth: int) -> str:
    """SQL that takes {walk}0 (r, t, i, f: the digest folded so far, s: the siblings so far) up through a forest's levels."""
    return ", ".join(
        f"""{walk}{k + 1} as (select r, t, p as i, case when c = 1 then f else sha256(concat(lo, f, hi)) end as f, case when c = 1 then s else concat(s, lo, hi) end as s
  from (select w.*, p, c, array_to_string(run[:i % 16], '') as lo, array_to_string(run[i % 16 + 2:], '') as hi from {walk}{k} w join {name}_run{k} n on w.t is not distinct from n.t and w.i // 16 = n.p))"""
        for k in range(depth)
    )


#: Trees of up to 16**5 rows a source and 16**3 sources.
MERKLE = f"""
with recursive {_CRC_STEPS},
doc as (select row_number() over () as r, doc_id, source as t, {_sha_leaf("text")} as leaf, {_sha_leaf("translate(text, '" + _UPPER + "', '" + _LOWER + "')")} as changed,
  xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(doc_id::varchar)), '..'), lambda h: ('0x' || h)::bigint)), lambda a, y: xor(a // 256, tab[1 + xor(a % 256, y)])), 4294967295) as crc from documents cross join (select t as tab from steps)),
placed as (select *, row_number() over (partition by t order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by t) as c from doc),
n0 as (select t, i, leaf as d, c from placed), {_levels("n", 5)},
root as (select t, d, row_number() over (order by t nulls first) - 1 as i, count(*) over () as c from n5),
m0 as (select 0 as t, i, d, c from root), {_levels("m", 3)},
a0 as (select r, t, i, case when crc % 5 = 0 then changed else leaf end as f, '' as s from placed), {_walk("a", "n", 5)},
b0 as (select a5.r, 0 as t, root.i, f, s from a5 join root on a5.t is not distinct from root.t), {_walk("b", "m", 3)}
select doc_id, leaf, root.d as subroot, m3.d as root, sha256(s) as proof_sha256, f as folded_root, f = m3.d as verified from doc join b3 using (r) join root on doc.t is not distinct from root.t cross join m3"""


ORACLE = {"op12_repeated_passages": REPEATS, "op13_merkle_manifest": MERKLE, "op8_jump_sharding": SHARDS, "op3_ngram_jaccard_join": JOIN, "op5_source_mixing": MIXING, "op6_top_inner_products": PRODUCTS, "op7_tool_calls": CHAT}
