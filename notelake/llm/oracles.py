"""DuckDB SQL of the registered queries."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = rf"""
with d as (select doc_id, {_WORDS} as w from documents),
wins as (
  select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
firsts as (select h, min(doc_id) as first_id from wins group by h),
again as (select doc_id, i from wins join firsts using (h) where doc_id > first_id),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from again),
each as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from d),
kept as (
  select e.doc_id, count(g.p) as n_removed,
    coalesce(string_agg(word, ' ' order by e.p) filter (where g.p is null), '') as kept
  from each e left join gone g on e.doc_id = g.doc_id and e.p = g.p group by e.doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from d left join kept using (doc_id)
"""

NGRAM_JACCARD_JOIN = rf"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents),
grams as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from grams a join grams b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 75 * (p.n + q.n - c)),
reach(doc_id, other) as (
  select doc_id, doc_id from d union select r.doc_id, l.y from reach r join links l on l.x = r.other)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, m.component_id
from d left join sizes using (doc_id) join (select doc_id, min(other) as component_id from reach group by 1) m using (doc_id)
"""

SUFFIX_ARRAY_DEDUP = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, '')) as n from documents),
strings as (
  select doc_id, i, md5(substr(x, 2 * i - 1, 200)) as h
  from (select doc_id, x, unnest(range(1, n - 98)) as i from d where n >= 100)),
firsts as (select h, min((doc_id, i)) as f from strings group by h),
again as (select doc_id, i from strings join firsts using (h) where (doc_id, i) > f),
stepped as (select doc_id, i, i > lag(i, 1, -200) over (partition by doc_id order by i) + 100 as new from again),
numbered as (select doc_id, i, sum(new::int) over (partition by doc_id order by i) as s from stepped),
spans as (select doc_id, s, min(i) as a, max(i) + 99 as b from numbered group by doc_id, s),
gaps as (
  select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before,
    row_number() over (partition by doc_id order by a desc) = 1 as last from spans),
kept as (
  select doc_id, count(*) as n_spans, sum(b - a + 1) as n_removed,
    string_agg(substr(x, 2 * before + 1, 2 * (a - 1 - before)), '' order by a) || max(case when last then substr(x, 2 * b + 1) else '' end) as k
  from gaps join d using (doc_id) group by doc_id)
select d.doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(k, x))) as kept_sha256
from d left join kept using (doc_id)
"""

CHAT_FORMATTING = """
with t as (select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations),
v as (
  select t.*, speaker, role = speaker as mask,
    case when role = speaker then '<|assistant|>' when role = 'system' then '<|system|>' else '<|user:' || role || '|>' end || chr(10) as head
  from t join (select distinct conv_id, role as speaker from t where role <> 'system') s on t.conv_id is not distinct from s.conv_id),
placed as (
  select *, head || text || chr(10) as segment, row_number() over w - 1 as position, sum(length(head) + length(text) + 1) over w as till
  from v window w as (partition by conv_id, speaker order by turn nulls first, role, head || text || chr(10) rows unbounded preceding))
select conv_id, speaker, position::bigint as position, turn, role, segment, mask,
  (till - 1 - length(text))::bigint as text_start, (till - 1)::bigint as text_end
from placed
"""

# The crc32 of a list of bytes, bit by bit: each byte goes into the low end, then eight steps of shifting.
_CRC32 = """xor(4294967295, list_reduce({bytes},
    lambda crc, byte: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, step: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1), xor(crc, byte)),
    4294967295))"""


def _part(value: str) -> str:
    return f"coalesce(strlen({value}::varchar)::varchar || ':' || {value}::varchar, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


MERKLE_MANIFEST = f"""
with recursive crc as (
  select doc_id as crc_of, {_CRC32.format(bytes="[ord(x)::bigint for x in string_split(doc_id::varchar, '')]")} as c from documents where doc_id is not null),
leaves as (
  select doc_id, coalesce('=' || source, '') as tree, {_leaf('text')} as leaf,
    {_leaf("if(c % 2 = 0, replace(text, chr(10), ''), text)")} as shown
  from documents left join (select distinct * from crc) on crc_of = doc_id),
placed as (select *, row_number() over (partition by tree order by doc_id nulls last, leaf) - 1 as place from leaves),
low(level, tree, place, h) as (
  select 0, tree, place, leaf from placed
  union all
  select level + 1, tree, place // 3, sha256(string_agg(h, '' order by place))
  from (select *, count(*) over (partition by tree) as n from low) where n > 1 group by level, tree, place // 3),
subroots as (
  select tree, h as subroot, row_number() over (order by tree) - 1 as entry
  from (select *, max(level) over (partition by tree) as highest from low) where level = highest),
high(level, place, h) as (
  select 0, entry, subroot from subroots
  union all
  select level + 1, place // 3, sha256(string_agg(h, '' order by place))
  from (select *, count(*) over () as n from high) where n > 1 group by level, place // 3),
root as (select h as root from high where level = (select max(level) from high)),
runs as (
  select tree, level, place // 3 as run, list(place order by place) as places, list(h order by place) as hs
  from low group by tree, level, place // 3),
top_runs as (select level, place // 3 as run, list(place order by place) as places, list(h order by place) as hs from high group by level, place // 3),
lows as (select tree, max(level) as levels from low group by tree),
highs as (select max(level) as levels from high),
walk(doc_id, tree, leaf, step, spot, proof, fold) as (
  select doc_id, tree, leaf, 0, if(levels = 0, entry, place), '', shown from placed join lows using (tree) join subroots using (tree)
  union all
  select doc_id, tree, leaf, step + 1, if(step + 1 = levels, entry, spot // 3),
    proof || array_to_string([h for h, i in hs if places[i] <> spot], ''),
    sha256(array_to_string([if(places[i] = spot, fold, h) for h, i in hs], ''))
  from (
    select w.*, levels, entry, coalesce(r.places, t.places) as places, coalesce(r.hs, t.hs) as hs
    from walk w join lows using (tree) join subroots using (tree)
      left join runs r on step < levels and r.tree = w.tree and r.level = step and r.run = spot // 3
      left join top_runs t on step >= levels and t.level = step - levels and t.run = spot // 3
    where step < levels + (select levels from highs)))
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, fold as folded_root, fold = root as verified
from walk join lows using (tree) join subroots using (tree), root
where step = levels + (select levels from highs)
"""

SPELLING_GROUPS = """
with recursive crc as (
  select list(list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, step: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1), i) order by i) as step_of
  from range(256) r(i)),
each as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run
  from documents),
runs as (select doc_id, run, count(*) as n from each where length(run) >= 7 group by doc_id, run),
hashed as (
  select run, n, xor(4294967295, list_reduce(
    flatten([if(ord(x) < 128, [ord(x)::bigint], [195::bigint, ord(x)::bigint - 64]) for x in string_split(coalesce(doc_id::varchar, '') || ':' || run, '')]),
    lambda c, b: xor(step_of[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) as h
  from runs, crc),
noisy as (
  select n, if(h % 31 = 0, substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2), run) as word from hashed),
vocab as (select word, sum(n)::bigint as n from noisy where length(word) >= 7 group by word having sum(n) >= 2),
places as (select word, unnest(range(1, length(word) + 1)) as p from vocab),
masks as (select word, p, substr(word, 1, p - 1) || '*' || substr(word, p + 1) as m from places),
shorter as (select distinct word, substr(word, 1, p - 1) || substr(word, p + 1) as s from places),
pairs as (
  select a.word, b.word as near from masks a join masks b on a.m = b.m and a.word <> b.word
  union all select shorter.word, s from shorter join vocab v on v.word = s
  union all select s, shorter.word from shorter join vocab v on v.word = s),
best as (
  select p.word, count(*) over (partition by p.word) as n_near, near, v.n as near_n,
    row_number() over (partition by p.word order by v.n desc, near) as k
  from pairs p join vocab v on v.word = near),
formed as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, if(near_n >= 10 * v.n, near, null) as form, if(near_n >= 10 * v.n, near_n, null) as form_n
  from vocab v left join best b on b.word = v.word and k = 1),
walk(word, here) as (select word, word from formed union all select w.word, f.form from walk w join formed f on f.word = w.here where f.form is not null),
ends as (select w.word, here as root from walk w join formed f on f.word = here where f.form is null)
select word, form, root, n, n_near::bigint as n_near, form_n from formed join ends using (word)
"""
