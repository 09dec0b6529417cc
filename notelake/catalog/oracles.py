"""Independent SQL for the registered queries, written for DuckDB over the same Parquet tables."""

from __future__ import annotations

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_BREAK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}\-_,]+"


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _norm(text: str) -> str:
    return f"lower({_strip(text)})"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '{_BREAK}'), lambda w: length(w) >= 3)"


def _cos(a: str, b: str) -> str:
    return (
        f"(case when {_len(a)} = 0 or {_len(b)} = 0 then 0.0 "
        f"else list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]) end)"
    )


def _len(a: str) -> str:
    return f"list_sum(list_transform({a}::DOUBLE[], lambda x: x * x))"


_E1 = """E1 as (
 select d.doc_id as id, d.lang as role, d.source as category, d.text as text, e.embedding as embedding,
  case when l.doc_id is null then []::VARCHAR[] when l.toxic = 1 and l.quality = 1 then ['quality', 'toxic']
       when l.toxic = 1 then ['toxic'] when l.quality = 1 then ['quality'] else ['plain'] end as tags,
  cast(DATE '2024-01-01' + cast(d.doc_id % 90 as INTEGER) as VARCHAR) as created_at
 from documents d left join embeddings e on e.vec_id = d.doc_id left join labels l on l.doc_id = d.doc_id)"""

_E2 = _E1 + """, E2 as (
 select id, 'corpus' as role, role as category, text, embedding, tags, created_at from E1)"""

_E3 = """E3 as (
 select vec_id * 5 + k as id, 'vec' as role, 'c' || label as category, vec_id, k as copy_no,
  case when k = 1 then upper('vector item number ' || lpad(cast(vec_id as VARCHAR), 5, '0')) || chr(10)
       else 'vector item number ' || lpad(cast(vec_id as VARCHAR), 5, '0') end as text,
  list_transform(embedding, lambda x, i: case when i <= 4 * k then 0.0::FLOAT else x end) as embedding
 from embeddings, range(5) t(k))"""

_E3M = _E3 + """, E3M as (
 select id, role, category, vec_id, copy_no, text,
  case when copy_no = 4 and vec_id % 7 = 0 then null else embedding end as embedding from E3)"""

_Q = """Q as (
 select vec_id as query_id, 'vec' as role, 'c' || label as category,
  'unrelated ' || lpad(cast(vec_id as VARCHAR), 5, '0') as query,
  case when vec_id % 3 = 0 then embedding when vec_id % 3 = 1 then list_transform(embedding, lambda x: -x) end as embedding
 from embeddings)"""

_E5 = """E5 as (
 select event_id as id, event_type as role, 'u' || (user_id % 10) as category, props as text,
  cast(cast(ts as DATE) as VARCHAR) as created_at from events)"""

_E4 = """f as (select lang || '/' || source || '.md' as path, count(*) as n from documents group by 1),
 parts as (
  select path, 0 as part, 0 as seq, '# ' || path as line from f
  union all select path, 1, 0, '' from f
  union all select path, 2, 0, '## Learnings' from f
  union all select path, 3, k, '- [2024-01-0' || k || '] learning' from f, (values (1), (2)) x(k)
  union all select path, 4, 0, '## Session Log' from f
  union all select lang || '/' || source || '.md', 5, -doc_id, '- [2024-02-01] doc ' || doc_id from documents
  union all select path, 6, 0, '' from f
  union all select path, 7, 0, '## Notes' from f
  union all select path, 8, k, '- [x] note ' || k from f, range(2 * n) r(k)),
 E4 as (select path, cast(part as BIGINT) * 1000000000000 + 500000000000 + seq as line_no, line from parts)"""


def _region(lines: str) -> str:
    """Running flags over the ordered lines of a file."""
    return f"""started as (
  select *, max(case when starts_with(line, '## Session Log') then 1 else 0 end) over w as st
  from {lines} where line_no is not null
  window w as (partition by path order by line_no rows between unbounded preceding and current row)),
 ended as (
  select *, max(case when st = 1 and starts_with(line, '## ') and not starts_with(line, '## Session Log') then 1 else 0 end)
   over (partition by path order by line_no rows between unbounded preceding and current row) as en from started),
 region as (
  select path, line_no, line, st = 1 and en = 0 and not starts_with(line, '## Session Log') as in_region,
   st = 1 and en = 0 and starts_with(line, '- [') as is_entry from ended),
 counts as (
  select path, count(*) as lc, coalesce(sum(case when is_entry then 1 else 0 end), 0)::BIGINT as se from region group by path),
 ranks as (
  select *, sum(case when is_entry then 1 else 0 end) over (partition by path order by line_no) as r from region),
 plan as (
  select path, lc, se, least(se, 15) as se1,
   case when lc > 80 or se > 15 then
    case when lc - (se - least(se, 15)) > 80 then least(least(se, 15), greatest(15 - (lc - (se - least(se, 15)) - 80), 5))
         else least(se, 15) end else se end as keep from counts)"""


_CHECKED = """select path, list_extract(string_split(path, '/'), -1) as name, lc as line_count, se as session_entries,
 lc > 80 as over_limit, se > 15 as session_warn, case when lc > 80 then 'FAIL' else 'PASS' end as status from counts"""

_COUNTS = "count(*) as entries, count(embedding) as with_embeddings"
_RECORD = "id, role, category, text, created_at"
_TAGS = "array_to_string(tags, ',') as tags"
_SUM = "round(list_sum(embedding::DOUBLE[]), 4) as vector_sum"
_DIMS = "cast(len(embedding) as INTEGER) as dims"


def _greedy(rows: str, match: str) -> str:
    """Walk ``rows`` in id order per category over the pairs ``prs`` and give the kept ids ``kp``."""
    return f"""ed as materialized (select category, ib as id, list(ia order by ia) as nb from prs where {match} group by 1, 2),
 nr as materialized (select category, id, row_number() over (partition by category order by id) as rn from {rows}),
 gr as (select category, 0::BIGINT as rn, []::BIGINT[] as kept from nr group by category
  union all
  select gr.category, gr.rn + 1,
   case when list_has_any(gr.kept, coalesce(ed.nb, []::BIGINT[])) then gr.kept else list_append(gr.kept, nr.id) end
  from gr join nr on nr.category = gr.category and nr.rn = gr.rn + 1
   left join ed on ed.category = nr.category and ed.id = nr.id),
 kp as (select category, unnest(kept) as id
  from (select category, kept, row_number() over (partition by category order by rn desc) as r from gr) where r = 1)"""


def _pairs(rows: str) -> str:
    text_equal = f"{_norm('a.text')} = {_norm('b.text')}"
    return f"""prs as materialized (select a.category, a.id as ia, b.id as ib,
  case when a.embedding is not null and b.embedding is not null then {_cos('a.embedding', 'b.embedding')}
       when {text_equal} then 1.0 else 0.0 end as s
  from {rows} a join {rows} b on a.role = b.role and a.category = b.category and a.id < b.id)"""


_REMOVED = """rm as (select p.category, min(p.ia) as keep_id, p.ib as remove_id, min_by(p.s, p.ia) as s
  from prs p join kp on kp.category = p.category and kp.id = p.ia
   left join kp k2 on k2.category = p.category and k2.id = p.ib
  where {match} and k2.id is null group by p.category, p.ib)"""


def _dedup(base: str, rows: str, final: str, match: str = "s >= 0.92") -> str:
    return f"""with recursive {base}, {_pairs(rows)}, {_greedy(rows, match)},
 {_REMOVED.format(match=match)} {final}"""


_DUPLICATES = """select 'vec' as role, rm.category, rm.keep_id, rm.remove_id, round(rm.s, 4) as similarity,
 k.text as keep_text, r.text as remove_text
 from rm join {rows} k on k.id = rm.keep_id join {rows} r on r.id = rm.remove_id"""

_BARE_DUPLICATES = "select 'vec' as role, category, keep_id, remove_id, round(s, 4) as similarity from rm"


def _batch() -> str:
    """Hybrid search of Q over E3: semantic hits, or keyword hits where there are none."""
    return f"""with {_E3}, {_Q}, sem as (
  select q.query_id, e.id, {_cos('q.embedding', 'e.embedding')} as s
  from Q q join E3 e on e.role = q.role and e.category = q.category
  where q.embedding is not null),
 hit as (select * from sem where s > 0.75),
 kw as (
  select q.query_id, e.id, len(list_filter({_words('q.query')}, lambda w: contains(lower(e.text || ' '), w))) as score,
   len({_words('q.query')}) as n
  from Q q join E3 e on e.role = q.role and e.category = q.category
  where not exists (select 1 from hit where hit.query_id = q.query_id)),
 found as (
  select query_id, 'semantic' as mode, id, s, null::INTEGER as score,
   row_number() over (partition by query_id order by s desc, id) as rank from hit
  union all
  select query_id, 'keyword', id, null, score::INTEGER, row_number() over (partition by query_id order by id)
  from kw where n > 0 and score >= greatest((n + 1) // 2, 1))
"""


_HITS = "select query_id, mode, rank::INTEGER as rank, id, round(s, 4) as similarity, score from found"

_ADMISSION = f"""with recursive {_E3M},
 stored as (select * from E3M where copy_no = 0), inc as (select * from E3M where copy_no > 0),
 sv as (
  select i.id, min(s.id) as cid from inc i join stored s on s.role = i.role and s.category = i.category
  where i.embedding is not null and s.embedding is not null and {_cos('i.embedding', 's.embedding')} > 0.92 group by i.id),
 fresh as (select * from inc where embedding is not null and id not in (select id from sv)),
 {_pairs('fresh')}, {_greedy('fresh', 's > 0.92')},
 {_REMOVED.format(match='p.s > 0.92')},
 bare as (select *, {_norm('text')} as h from inc where embedding is null),
 holders as (
  select role, category, {_norm('text')} as h, id from fresh where id in (select id from kp)
  union all select role, category, h, id from bare),
 firsts as (select role, category, h, min(id) as b from holders group by 1, 2, 3),
 table_first as (select role, category, {_norm('text')} as h, min(id) as s from stored group by 1, 2, 3),
 conflict as (
  select id, 'stored' as src, cid from sv union all select remove_id, 'batch', keep_id from rm
  union all
  select bare.id, case when t.s is not null then 'stored' else 'batch' end, coalesce(t.s, f.b)
  from bare join firsts f using (role, category, h) left join table_first t using (role, category, h)
  where t.s is not null or f.b < bare.id)
 select i.id, i.category, c.id is null as admitted, case when c.id is not null then 'duplicate' end as reason,
  c.src as conflict_source, c.cid as conflict_id, e.text as conflict_text
 from inc i left join conflict c on c.id = i.id left join E3M e on e.id = c.cid"""

_LABELLED = f"""with {_E2}, stored as (select * from E2 where id in (select doc_id from labels)),
 firsts as (select *, row_number() over (partition by role, category, text order by id) as rn from E2),
 fresh as (select * from firsts f where rn = 1 and not exists (
  select 1 from stored s where s.role = f.role and s.category = f.category and s.text = f.text))"""

_MARKDOWN = f"""with {_E1},
 items as (select role, 1 as section, category, 2 as kind, created_at, id,
  '- **' || created_at || '**: ' || text || case when len(tags) > 0 then ' `[' || array_to_string(tags, ', ') || ']`' else '' end as line from E1),
 groups as (select distinct role, category from E1), roles as (select distinct role from E1)
 select * from items
 union all select role, 1, category, 0, '', 0, '## ' || category from groups
 union all select role, 1, category, 1, '', 0, '' from groups
 union all select role, 0, '', 0, '', 0, '# ' || role from roles
 union all select role, 0, '', 1, '', 0, '' from roles
 union all select role, 2, '', 1, '', 0, '' from roles"""

_BLANK_ROWS = """gaps as (select doc_id as id,
  case when lang = 'de' and source in ('src1', 'src2') then '  ' else lang end as role,
  case when lang = 'fr' and source in ('src1', 'src2') then null else source end as category,
  case when lang = 'es' and source in ('src1', 'src2') then '' else text end as text from documents)"""

_LINES = r"""docs as (select doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) as parts from documents),
 cut as (select doc_id, case when parts[-1] = '' then parts[:-2] else parts end as parts from docs),
 doc_lines as (
  select doc_id, cast(i - 1 as INTEGER) as line_no, parts[i] as line
  from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from cut)
  union all select doc_id, null, null from cut where len(parts) = 0)"""

_COVERAGE = "case when entries > 0 then round_even(100.0::DOUBLE * with_embeddings / entries, 1) else 0.0 end as coverage_pct"

ORACLES: dict[str, str] = {
    "scan_entries": f"with {_E1} select {_RECORD}, {_TAGS}, {_DIMS}, {_SUM} from E1",
    "append_entries": f"""with {_E1} select id, role, category, text, embedding is not null as has_embedding,
 round(sqrt({_len('embedding')}), 4) as norm from E1""",
    "read_jsonl_memories": f"with {_E1} select role, category, text, created_at, {_TAGS} from E1",
    "read_memory_files": f"""with {_E4} select replace(path, '/', '-') as name, line,
 cast(row_number() over (partition by path order by line_no) - 1 as INTEGER) as line_no from E4""",
    "storage_size": "select sum(strlen(text) + 1)::bigint as bytes from documents",
    "export_json": f"""with {_E1} select id, role, category, to_json(struct_pack(id := id, role := role,
 category := category, text := text, tags := tags, created_at := created_at))::VARCHAR as json from E1""",
    "export_markdown": _MARKDOWN,
    "decode_embeddings": f"select vec_id, false as broken, {_DIMS}, {_SUM} from embeddings",
    "filter_role_category": f"with {_E1} select {_RECORD} from E1 where role = 'en' and category = 'src1'",
    "filter_tag": f"with {_E1} select {_RECORD}, {_TAGS} from E1 where list_contains(tags, 'quality')",
    "filter_since": f"with {_E5} select {_RECORD} from E5 where created_at >= '2024-01-23'",
    "validate_entries": f"""with {_BLANK_ROWS} select id,
 case when role is null or {_strip('role')} = '' then 'role is required'
      when category is null or {_strip('category')} = '' then 'category is required'
      when text is null or {_strip('text')} = '' then 'text is required' end as reject_reason from gaps""",
    "parse_tags": """select doc_id,
 case when quality = 1 and toxic = 1 then 'a,b' when quality = 1 then 'a' else '' end as tags,
 cast(quality + quality * toxic as INTEGER) as n_tags from labels""",
    "tokenize_query": f"""select doc_id, cast(len(w) as INTEGER) as n_keywords, array_to_string(w, '|') as keywords
 from (select doc_id, {_words('text')} as w from documents)""",
    "keyword_prefilter": f"""with {_E1} select id, role from E1 where len(list_filter(['toxic', 'data', 'base', 'ein'],
 lambda w: contains(lower(text || ' ' || array_to_string(tags, ' ')), w))) > 0""",
    "pending_embeddings": f"with {_E1} select id, role, category from E1 where embedding is null",
    "keyword_search": f"""with {_E1}, scored as (select id, role, category, cast(len(list_filter(
 ['quality', 'the', 'system', 'data', 'and', 'model', 'results'],
 lambda w: contains(lower(text || ' ' || array_to_string(tags, ' ')), w))) as INTEGER) as score from E1)
 select * from scored where score >= 4""",
    "semantic_search": f"""with {_E3}, sims as (select E3.id, E3.role, E3.category, {_cos('E3.embedding', 'v.embedding')} as s
 from E3, (select embedding from embeddings where vec_id = 0) v)
 select id, role, category, round(s, 4) as similarity from sims where s > 0.3""",
    "hybrid_search": _batch() + f""", {_E1}, given as (select vec_id, 'c' || label as category, embedding from embeddings where vec_id in (3, 4)),
 sims as (select g.vec_id, e.id, {_cos('g.embedding', 'e.embedding')} as s, e.text from given g join E3 e using (category)),
 words as (
  select 1 as query_no, e.id, e.text, lower(e.text || ' ') as hay, ['item', '00004'] as w from given g join E3 e using (category) where g.vec_id = 4
  union all select 3, e.id, e.text, lower(e.text || ' '), ['vector', 'item'] from given g join E3 e using (category) where g.vec_id = 3
  union all select 2, id, text, lower(text || ' ' || array_to_string(tags, ' ')), ['quality', 'the', 'system', 'data', 'and', 'model', 'results']
  from E1 where role = 'en' and category = 'src1' and list_contains(tags, 'quality')),
 scored as (select *, cast(len(list_filter(w, lambda x: contains(hay, x))) as INTEGER) as score from words)
 select null::INTEGER as query_no, query_id, mode, rank::INTEGER as rank, id, round(s, 4) as similarity, score, null::VARCHAR as text from found
 union all
 select 0, null, 'semantic', null, id, round(s, 4), null, text from sims where vec_id = 3 and s > 0.75
 union all
 select query_no, null, 'keyword', null, id, null, score, text from scored where score >= (len(w) + 1) // 2
 qualify query_no <> 3 or row_number() over (partition by query_no order by id) <= 7""",
    "batch_search_unlimited": _batch() + _HITS,
    "batch_search": _batch() + _HITS + " where rank <= 3",
    "topk_similarity": f"""with {_E3}, {_Q}, sims as (select q.query_id, e.id, {_cos('q.embedding', 'e.embedding')} as s
 from Q q join E3 e on e.role = q.role and e.category = q.category where q.embedding is not null)
 select query_id, row_number() over (partition by query_id order by s desc, id)::INTEGER as rank, id, round(s, 4) as similarity
 from sims where s > 0.2 qualify row_number() over (partition by query_id order by s desc, id) <= 4""",
    "tagged_search": f"""with {_E1}, asked as (
  select item_id, {_words('text')} as w, case when item_id % 2 = 0 then 'quality' end as tag from benchmark),
 scored as (
  select a.item_id * 10000 + substr(e.category, 4)::BIGINT * 100 + instr('de en es fr', e.role) as query_id, e.id, len(a.w) as n,
   cast(len(list_filter(a.w, lambda w: contains(lower(e.text || ' ' || array_to_string(e.tags, ' ')), w))) as INTEGER) as score
  from asked a join E1 e on a.tag is null or list_contains(e.tags, a.tag)),
 ranked as (select query_id, 'keyword' as mode, row_number() over (partition by query_id order by id)::INTEGER as rank, id, score
  from scored where n > 0 and score >= greatest((n + 1) // 2, 1))
 select * from ranked where rank <= 5""",
    "keyword_index": f"""with {_E1}, hay as (select id, role, category, lower(text || ' ' || array_to_string(tags, ' ')) as hay from E1),
 chars as (select id, role, category, list_transform(string_split(hay, ''), lambda x: ord(x)::BIGINT) as c from hay),
 grams as (select distinct id, role, category, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] + c[i + 1] * 2097152 + c[i + 2] * 4398046511104)) as gram
  from chars)
 select role, category, gram, count(*)::BIGINT as n from grams group by all""",
    "search_report": _batch() + """, n as (select role, category, count(*) as searched from E3 group by 1, 2),
 m as (select query_id, count(*) as matches from found where rank <= 3 group by 1)
 select q.query_id, q.role, q.category, coalesce(n.searched, 0)::BIGINT as searched, coalesce(m.matches, 0)::BIGINT as matches,
  coalesce(m.matches, 0) > 0 as found
 from Q q left join n on n.role = q.role and n.category = q.category left join m on m.query_id = q.query_id""",
    "similarity_self_join": f"""with {_E3M}, {_pairs('E3M')}
 select 'vec' as role, category, ia as id_a, ib as id_b, round(s, 4) as similarity from prs where s >= 0.92""",
    "similarity_join_lsh": f"""with {_E3}, {_pairs('E3')}
 select 'vec' as role, category, ia as id_a, ib as id_b, round(s, 4) as similarity from prs where s >= 0.92""",
    "cross_similarity_join": f"""with {_E3}, sims as (
  select i.role, i.category, i.id, s.id as match_id, {_cos('i.embedding', 's.embedding')} as s
  from E3 i join E3 s on s.role = i.role and s.category = i.category where i.copy_no > 0 and s.copy_no = 0)
 select role, category, id, min(match_id) as match_id, round(min_by(s, match_id), 4) as similarity
 from sims where s > 0.92 group by 1, 2, 3""",
    "anti_join_existing": f"""with {_E2} select id, category from E2 where id not in (select doc_id from labels)
 and not exists (select 1 from E2 s where s.id in (select doc_id from labels)
  and s.role = E2.role and s.category = E2.category and s.text = E2.text)""",
    "dedup_find": _dedup(_E3, "E3", _DUPLICATES.format(rows="E3")),
    "dedup_find_mixed": _dedup(_E3M, "E3M", _DUPLICATES.format(rows="E3M")),
    "dedup_find_tiled": _dedup(_E3M, "E3M", _BARE_DUPLICATES),
    "dedup_find_lsh": _dedup(_E3, "E3", _BARE_DUPLICATES),
    "dedup_summary": _dedup(_E3, "E3", """, n as (select role, category, count(*) as entries from E3 group by 1, 2)
 select n.role, n.category, n.entries, count(rm.remove_id) as found, 0::BIGINT as removed
 from n left join rm on rm.category = n.category group by all"""),
    "dedup_apply": _dedup(_E3, "E3", "select id, category, text from E3 where id not in (select remove_id from rm)"),
    "dedup_exact_text": f"""with {_E2}, k as (select *, {_norm('text')} as h from E2),
 f as (select *, min(id) over (partition by role, category, h) as keep_id from k)
 select f.role, f.category, f.keep_id, f.id as remove_id, a.text as keep_text, f.text as remove_text
 from f join E2 a on a.id = f.keep_id where f.id > f.keep_id""",
    "admit_batch": _ADMISSION,
    "merge_jsonl": _LABELLED + f" select role, category, text, created_at, {_TAGS} from fresh",
    "merge_summary": _LABELLED + """, per as (
  select 'file' as level, e.role, e.category, 1::BIGINT as files, count(*) as entries,
   (select count(*) from fresh f where f.category = e.category) as migrated from E2 e group by 2, 3)
 select level, role, category, files, entries, migrated, entries - migrated as skipped, null::BIGINT as table_rows from per
 union all
 select 'total', null, null, count(*), sum(entries)::BIGINT, sum(migrated)::BIGINT, sum(entries - migrated)::BIGINT,
  (sum(migrated) + (select count(*) from stored))::BIGINT from per""",
    "rebuild_embeddings": f"""with {_E1} select id, embedding is not null as had,
 embedding is not null or {_strip('text')} <> '' as has,
 case when embedding is not null then cast(len(embedding) as INTEGER) when {_strip('text')} <> '' then 64 end as dims,
 case when embedding is not null then round(list_sum(embedding::DOUBLE[]), 4) end as vector_sum from E1""",
    "count_entries": f"with {_E1} select role, category, count(*) as entries from E1 group by 1, 2",
    "list_categories": f"with {_E1} select distinct role, category from E1",
    "list_roles": f"with {_E1} select distinct role from E1",
    "stats_totals": f"""with {_E1}, t as (select {_COUNTS}, min(created_at) as oldest_entry, max(created_at) as newest_entry from E1)
 select *, {_COVERAGE} from t""",
    "stats_by_category": f"with {_E1}, t as (select role, category, {_COUNTS} from E1 group by 1, 2) select *, {_COVERAGE} from t",
    "stats_rollup": f"""with {_E1}, t as (select role, category, cast(grouping(role) * 2 + grouping(category) as INTEGER) as level, {_COUNTS}
 from E1 group by rollup (role, category)) select *, {_COVERAGE} from t""",
    "embedding_health": f"""with {_E1}, g as (select role, category, {_COUNTS} from E1 group by 1, 2),
 d as (select 'group' as level, role, category, entries, with_embeddings, cast(100 * with_embeddings // entries as INTEGER) as pct from g),
 s as (select *, case when pct = 100 then 'ok' when pct >= 50 then 'warn' else 'fail' end as status from d)
 select * from s union all
 select 'total', null, null, sum(entries)::BIGINT, sum(with_embeddings)::BIGINT,
  cast(100 * sum(with_embeddings) // sum(entries) as INTEGER), case when bool_or(status = 'fail') then 'fail' else 'ok' end from s""",
    "session_log_region": f"with {_E4}, {_region('E4')} select path, line_no, line, in_region, is_entry from region",
    "session_log_count": f"with {_E4}, {_region('E4')} select path, se as session_entries from counts",
    "prune_session_log": f"with {_E4}, {_region('E4')} select path, line_no, line from ranks where not is_entry or r <= 10",
    "check_files": f"with {_E4}, {_region('E4')} {_CHECKED}",
    "check_documents": f"""with {_LINES}, docs_as_files as (select cast(doc_id as VARCHAR) as path, line_no, line from doc_lines),
 {_region('docs_as_files')} {_CHECKED}""",
    "fix_files": f"""with {_E4}, {_region('E4')}
 select path, list_extract(string_split(path, '/'), -1) as name, lc as line_count, se as session_entries,
  lc - (se - keep) > 80 as over_limit, keep > 15 as session_warn, keep < se as fixed,
  case when keep < se then (lc - (se - keep))::BIGINT end as new_line_count,
  case when lc - (se - keep) > 80 then 'FAIL' else 'PASS' end as status from plan""",
    "fixed_lines": f"""with {_E4}, {_region('E4')}
 select path, line_no, line from ranks join plan using (path) where not is_entry or r <= keep""",
    "check_report": f"""with {_E4}, {_region('E4')} select count(*) as files, bool_or(lc > 80) as any_fail,
 bool_or(se > 15) as any_warn, not bool_or(lc > 80) as passed from counts""",
    "first_wins": f"""with {_E2}, k as (select *, row_number() over (partition by role, category, {_norm('text')} order by id) as rn from E2)
 select role, category, id, created_at from k where rn = 1""",
    "timeline": f"""with {_E5} select {_RECORD} from E5 where role = 'click' and created_at >= '2024-01-23'
 order by created_at desc, id desc limit 100""",
    "timeline_all_roles": f"""with {_E5}, r as (select {_RECORD},
  row_number() over (partition by role order by created_at desc, id desc)::INTEGER as rank from E5) select * from r where rank <= 20""",
    "export_order": f"with {_E1} select role, category, created_at, id from E1 order by 1, 2, 3, 4",
    "text_expressions": f"""with {_E1} select id, {_norm('text')} as normalized,
 lower(text || ' ' || array_to_string(tags, ' ')) as haystack, substring(text, 1, 80) as preview from E1""",
    "cosine_expression": f"""with {_E3} select e.id, round({_cos('e.embedding', 'b.embedding')}, 4) as similarity
 from E3 e join E3 b on b.vec_id = e.vec_id and b.copy_no = 0""",
    "embed_column": f"""select doc_id, {_strip('text')} <> '' as has,
 case when {_strip('text')} <> '' then 64 end as dims from documents""",
    "stream_admit": f"select distinct 'corpus' as role, lang as category, {_norm('text')} as normalized from documents where {_strip('text')} <> ''",
    "stream_admit_semantic": f"""with recursive {_E3}, {_pairs('E3')}, {_greedy('E3', 's > 0.92')} select id, category from kp""",
}
ORACLES["keyword_search_indexed"] = ORACLES["keyword_search"]
ORACLES["keyword_prefilter_indexed"] = ORACLES["keyword_prefilter"]
ORACLES["fixed_folder"] = f"""with {_E4}, {_region('E4')}
 select replace(path, '/', '-') as name, (lc - (se - keep))::BIGINT as line_count, keep::BIGINT as session_entries,
  lc - (se - keep) > 80 as over_limit, keep > 15 as session_warn from plan"""
