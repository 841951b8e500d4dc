"""Check SQL of the Merkle manifest and the prefix trie, and what both share."""

from __future__ import annotations


def crc32(text: str) -> str:
    """SQL for the CRC-32 of an ASCII expression."""
    return f"""(xor(4294967295, list_reduce(list_transform(range(1, len({text}) + 1), lambda i: unicode(({text})[i])::bigint),
        lambda acc, b: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, xor(acc, b)), 4294967295::bigint)))"""


def _leaf(n_chars: str) -> str:
    fields = ", ".join(f"coalesce(strlen(({c})::varchar)::varchar || ':' || ({c})::varchar, '-')" for c in ("doc_id", "source", "lang", n_chars, "text"))
    return f"sha256(concat({fields}))"


MANIFEST = f"""
with recursive d as (
    select *, row_number() over (partition by part order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by part) as n from (
        select doc_id, coalesce('=' || lang, '') as part, {_leaf('n_chars')} as leaf,
               case when coalesce({crc32('doc_id::varchar')} % 7 = 0, false) then {_leaf('n_chars + 1')} else {_leaf('n_chars')} end as now from documents)),
node as (
    select part, 0 as level, pos as idx, leaf as digest, n from d
    union all
    select part, level + 1, idx // 2, sha256(string_agg(digest, '' order by idx)), (n + 1) // 2 from node where n > 1 group by part, level, idx // 2, n),
tops as (select part, digest as subroot, row_number() over (order by part) - 1 as pos, count(*) over () as n from node where n = 1),
upper as (
    select 0 as level, pos as idx, subroot as digest, n from tops
    union all
    select level + 1, idx // 2, sha256(string_agg(digest, '' order by idx)), (n + 1) // 2 from upper where n > 1 group by level, idx // 2, n),
low as (
    select d.part, d.pos, list((case when s.digest is null then 'N' when s.idx > d.pos >> a.level then 'R' else 'L' end) || coalesce(s.digest, '') order by a.level) as way
    from d join node a on a.part = d.part and a.idx = d.pos >> a.level and a.n > 1
    left join node s on s.part = a.part and s.level = a.level and s.idx = xor(a.idx, 1) group by d.part, d.pos),
high as (
    select t.part, list((case when s.digest is null then 'N' when s.idx > t.pos >> a.level then 'R' else 'L' end) || coalesce(s.digest, '') order by a.level) as way
    from tops t join upper a on a.idx = t.pos >> a.level and a.n > 1
    left join upper s on s.level = a.level and s.idx = xor(a.idx, 1) group by t.part),
whole as (
    select d.doc_id, d.leaf, d.now, tops.subroot, (select digest from upper where n = 1) as root, list_concat(coalesce(low.way, []::varchar[]), coalesce(high.way, []::varchar[])) as way
    from d join tops on tops.part = d.part left join low on low.part = d.part and low.pos = d.pos left join high on high.part = d.part)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda s: s[2:]), '')) as proof_sha256, folded_root, folded_root = root as verified
from (select *, list_reduce(way, lambda acc, s: sha256(case s[1] when 'L' then s[2:] || acc when 'R' then acc || s[2:] else acc end), now) as folded_root from whole)"""


TRIE = f"""
with t as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
           row_number() over (partition by conv_id order by turn nulls first, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) as i
    from conversations where conv_id is not null),
c as (select conv_id, count(*) as n, {crc32('conv_id::varchar')} % 9 as h, conv_id - conv_id % 5 as base from t group by conv_id),
turned as (
    select c.conv_id, i as d, role, text from c join t on t.conv_id = c.base where i <= h
    union all
    select t.conv_id, least(c.h, coalesce(b.n, 0)) + i - c.h, role, text from t join c using (conv_id) left join c b on b.conv_id = c.base where i > c.h),
hashed as (select conv_id, d, strlen(text) as size, sha256(concat(strlen(role), ':', role, text)) as s from turned),
path as (
    select conv_id, d, size, sha256(string_agg(s, '' order by d) over (partition by conv_id order by d)) as key from hashed
    union all select conv_id, 0, 0, '' from c),
linked as (select *, lag(key) over (partition by conv_id order by d) as up, d = max(d) over (partition by conv_id) as ends from path),
node as (
    select key, min(conv_id) as conv_id, any_value(d) as depth, any_value(size) as size, any_value(up) as up, count(*) as n_convs,
           sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256 from linked group by key),
kids as (select up as key, count(*) as n from node where up is not null group by up),
named as (select node.*, coalesce(kids.n, 0) as n_children from node left join kids using (key)),
total as (
    select path.key, count(*) filter (where n_children = 0) as n_leaves, sum((n_convs - 1) * named.size) as saved
    from named join path on path.conv_id = named.conv_id and path.d <= named.depth group by path.key)
select named.conv_id, named.depth::bigint as depth, p.conv_id as parent_conv_id, named.n_convs, named.n_children, n_leaves,
       saved::bigint as saved_tokens, named.ends_sha256
from named join total using (key) left join node p on p.key = named.up"""
