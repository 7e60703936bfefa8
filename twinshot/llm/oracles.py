"""The same queries in DuckDB SQL, where it can express them.

Compression, the forest, the tokenizer and the page parser can't be; their queries are tested against
brute force, exact round trips and held-out rows instead.
"""

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LOWER_WORDS = f"regexp_extract_all(coalesce({_LOWER}, ''), '[^\\x20\\x09-\\x0D]+')"


def _shingles(table: str, key: str, size: int) -> str:
    """Distinct (key, s) shingles; a shorter text is one."""
    return f"""
        select distinct {key}, array_to_string(ws[p : p + {size - 1}], ' ') as s
        from (select {key}, ws, unnest(range(1, greatest(len(ws) - {size - 1}, 1) + 1)) as p
              from (select {key}, {_LOWER_WORDS} as ws from {table}) where len(ws) > 0)"""


OP1 = f"""
with w as (select doc_id, {_WORDS} as ws from documents),
windows as (
    select doc_id, p, md5(array_to_string(ws[p : p + 34], ' ')) as h
    from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as p from w where len(ws) >= 35)),
repeated as (select doc_id, p from (select *, count(*) over (partition by h) as n from windows) where n > 1),
covered as (select distinct doc_id, unnest(range(p, p + 35)) as i from repeated),
words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from w),
kept as (
    select doc_id, count(*) as n, string_agg(word, ' ' order by i) as t
    from words anti join covered using (doc_id, i) group by doc_id)
select doc_id, len(ws)::bigint as n_words, len(ws)::bigint - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (doc_id)"""

OP7 = f"""
with d as ({_shingles("documents", "doc_id", 5)}), i as ({_shingles("benchmark", "item_id", 5)}),
sizes as (select item_id, count(*) as n_shingles from i group by item_id),
shared as (select doc_id, item_id, count(*) as n_shared from d join i using (s) group by doc_id, item_id)
select doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles::double as containment
from shared join sizes using (item_id) where 100 * n_shared >= 80 * n_shingles"""

OP9 = """
with u as (
    select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (
    select page_id,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
    from u),
r as (
    select *, case
        when ('.' || host) like '%.www.example.com' and starts_with(path, '/en/') then 'www.example.com/en/'
        when ('.' || host) like '%.example.com' and starts_with(path, '/en/') then 'example.com/en/'
        when ('.' || host) like '%.net' and starts_with(path, '/es/') then 'net/es/'
        when ('.' || host) like '%.net' and starts_with(path, '/fr/') then 'net/fr/'
        when ('.' || host) like '%.com' and starts_with(path, '/') then 'com/' end as rule
    from h)
select page_id, host, path, rule, case
    when rule in ('com/', 'www.example.com/en/') then 'allow'
    when rule is not null then 'block'
    when list_has_any(string_split_regex(host, '[.-]'),
        ['adult', 'ads', 'bet', 'bets', 'casino', 'escort', 'gambling', 'pills', 'poker', 'porn', 'sex', 'spam', 'xxx']) then 'block'
    else 'allow' end as verdict
from r"""

OP10 = f"""
with recursive d as ({_shingles("documents", "doc_id", 4)}),
n as (select doc_id, count(*) as n from d group by doc_id),
pairs as (
    select x.doc_id as a, y.doc_id as b, count(*) as c from d x join d y on x.s = y.s and x.doc_id < y.doc_id group by all),
links as (
    select a, b from pairs join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(doc_id, r) as (
    select doc_id, doc_id from documents
    union select b, r from reach join both_ways on a = reach.doc_id)
select doc_id, coalesce(max(n.n), 0)::bigint as n_shingles, min(r) as component_id, min(r) = doc_id as kept
from reach left join n using (doc_id) group by doc_id"""

_CODES = "list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)"
_CRC32 = f"""xor(4294967295, list_reduce(list_concat([4294967295::bigint], {_CODES}), lambda crc, b:
    list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
        lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)))"""

OP11 = f"""
with pieces as (
    select coalesce(lang, 'und') as lang,
        unnest(regexp_split_to_array(coalesce({_LOWER}, ''), '[.,;:!?\x0A-\x0D]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
sizes as (select lang, sum(len(ws)) as n from words group by lang),
grams as (
    select lang, m, array_to_string(ws[i : i + m - 1], ' ') as phrase
    from (select lang, ws, m, unnest(range(1, len(ws) - m + 2)) as i from words, range(1, 6) t(m) where len(ws) >= m)),
f as (select lang, m, phrase, count(*) as f from grams group by all having count(*) >= 100),
longer as (
    select distinct l.lang, unnest([array_to_string(string_split(l.phrase, ' ')[1 : m - 1], ' '),
        array_to_string(string_split(l.phrase, ' ')[2 : m], ' ')]) as phrase, l.f from f l where m > 2),
kept as (select * from f anti join longer using (lang, phrase, f) where m > 1),
cuts as (
    select c.lang, c.phrase, c.f as a, k, l.f as l, r.f as r, n,
        (1000::hugeint * c.f * n) // (l.f::hugeint * r.f) as score
    from (select *, unnest(range(1, m)) as k from kept) c join sizes using (lang)
    join f l on l.lang = c.lang and l.phrase = array_to_string(string_split(c.phrase, ' ')[1 : k], ' ')
    join f r on r.lang = c.lang and r.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1 : c.m], ' ')),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase::blob) as rank, phrase,
    a, l, r, n::bigint as n, score::bigint as score
from best qualify rank <= 2000"""

OP12 = f"""
with own as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
    from conversations where conv_id is not null),
convs as (select conv_id, conv_id - conv_id % 100 as base, {_CRC32} % 6 as h from (select distinct conv_id from own)),
head as (select c.conv_id, pos, role, text from convs c join own on own.conv_id = base where pos <= h),
sizes as (select conv_id, count(*) as n from head group by 1),
paths as (
    select * from head union all
    select conv_id, pos - h + coalesce(n, 0), role, text from own join convs using (conv_id) left join sizes using (conv_id) where pos > h),
prefixes as (
    select conv_id, pos as depth, length(text) as chars,
        string_agg(sha256(length(role) || ':' || role || text), '') over (partition by conv_id order by pos) as name from paths),
rows as (select * from prefixes union all select conv_id, 0, 0, '' from convs),
nodes as (select name, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(chars) as chars from rows group by name, depth),
kids as (select left(name, 64 * (depth - 1)) as name, count(*) as n from nodes where depth > 0 group by 1),
weighed as (select nodes.*, coalesce(kids.n, 0) as n_children, (n_convs - 1) * chars as saved from nodes left join kids using (name)),
above as (select left(name, 64 * unnest(range(0, depth + 1))) as name, n_children, saved from weighed),
totals as (select name, count(*) filter (n_children = 0) as n_leaves, sum(saved) as saved from above group by 1),
last as (select conv_id, max_by(name, depth) as name from rows group by 1),
ends as (select name, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as digest from last group by 1)
select w.conv_id, w.depth::bigint as depth, p.conv_id as parent_conv_id, w.n_convs, w.n_children, n_leaves,
    t.saved::bigint as saved_tokens, coalesce(digest, sha256('')) as ends_sha256
from weighed w join totals t using (name) left join nodes p on w.depth > 0 and p.name = left(w.name, 64 * (w.depth - 1))
left join ends on ends.name = w.name"""

OP13 = """
with ok as (
    select vec_id, embedding::double[] as v from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored as (
    select q.vec_id as query_id, c.vec_id, max(list_inner_product(q.v, c.v)) as score
    from ok q join ok c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0 group by 1, 2)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from scored qualify rank <= 20"""

ORACLES = {
    "op1_substring_dedup": OP1,
    "op7_benchmark_decontamination": OP7,
    "op9_url_filters": OP9,
    "op10_minhash_near_dedup": OP10,
    "op11_phrase_collocations": OP11,
    "op12_conversation_prefix_trie": OP12,
    "op13_nearest_neighbours": OP13,
}
