"""SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

SQL = {
    "op3_exact_dedup": r"""
with texts as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents
), grouped as (
  select doc_id, t, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size from texts
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from grouped
""",
    "op5_warc": r"""
with digests as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex from pages
), named as (
  select page_id, payload_bytes, min(page_id) over (partition by hex) as first,
         list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             cast(((cast('0x' || substr(hex, cast(5 * (k // 4) + 1 as int), 5) as int) >> cast(15 - 5 * (k % 4) as int)) & 31) + 1 as int), 1)
           for k in range(32)], 'string_agg', '') as payload_digest
  from digests
)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from named
""",
    "op7_mixing": r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         cast('0x' || substr(md5('42:' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as key
  from documents
), sources as (
  select source, cast(sum(size) as bigint) as source_size,
         row_number() over (order by source asc nulls last) as number
  from sized group by source
), limited as (
  select *, cast([5, 2, 1][(number - 1) % 3 + 1] as double) as weight, cast(source_size as double) * 3 as most from sources
), levelled as (
  select *, (sum(cast(source_size as double)) over () - coalesce(sum(most) over earlier, 0))
            / (sum(weight) over () - coalesce(sum(weight) over earlier, 0)) as level
  from limited
  window earlier as (order by most / weight, number rows between unbounded preceding and 1 preceding)
), budgets as (
  select source, source_size, least(most, weight * max(level) over ()) as target from levelled
), placed as (
  select s.doc_id, s.size, b.source_size, b.target,
         case when b.source_size > 0 then floor(b.target / b.source_size) else 0 end as epochs,
         coalesce(sum(s.size) over (partition by s.source order by s.key, s.doc_id, s.size
                                    rows between unbounded preceding and 1 preceding), 0) as front
  from sized s join budgets b on s.source is not distinct from b.source
)
select doc_id, cast(size as bigint) as size, source_size, target,
       cast(case when size > 0 then epochs + cast(size <= 2 * (target - epochs * source_size - front) as bigint) else 0 end * size
            as bigint) as taken
from placed
""",
    "op11_jaccard_join": r"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w
  from documents
), sets as (
  select doc_id, list_distinct(case when len(w) >= 3 then [w[i : i + 2] for i in range(1, len(w) - 1)] when len(w) > 0 then [w] else [] end) as s
  from worded
), each as (
  select doc_id, len(s) as n, unnest(s) as shingle from sets
), links as (
  select a.doc_id as a, b.doc_id as b
  from each a join each b on a.shingle = b.shingle and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach(id, reached) as (
  select doc_id, doc_id from documents
  union
  select r.id, l.b from reach r join links l on l.a = r.reached
)
select doc_id, cast(len(s) as bigint) as n_shingles, min(reached) as component_id
from sets join reach on id = doc_id group by doc_id, n_shingles
""",
    "op13_collocations": r"""
with cut as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), worded as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from cut
), totals as (
  select lang, cast(sum(len(w)) as bigint) as n from worded group by lang
), grams as (
  select lang, w[i : i + size - 1] as words
  from (select lang, w, size, unnest(range(1, len(w) - size + 2)) as i from worded cross join (select unnest([1, 2, 3, 4]) as size))
), counts as (
  select lang, words, count(*) as f from grams group by lang, words having count(*) >= 30
), candidates as (
  select lang, words, f as a from counts where len(words) > 1
), cuts as (
  select c.lang, c.words, c.a, c.k, l.f as l, r.f as r, (2000000 * c.a::hugeint) // (l.f + r.f) as score
  from (select lang, words, a, unnest(range(1, len(words))) as k from candidates) c
  join counts l on l.lang = c.lang and l.words = c.words[1 : c.k]
  join counts r on r.lang = c.lang and r.words = c.words[c.k + 1 :]
), lowest as (
  select * from cuts qualify row_number() over (partition by lang, words order by score, k) = 1
), above as (
  select lang, words[i : i + m - 1] as words, max(a) as most
  from (select lang, words, a, m, unnest(range(1, len(words) - m + 2)) as i
        from (select lang, words, a, unnest(range(2, len(words))) as m from candidates))
  group by 1, 2
), kept as (
  select c.lang, array_to_string(c.words, ' ') as phrase, c.a, c.l, c.r, c.score
  from lowest c left join above o on o.lang = c.lang and o.words = c.words
  where o.most is null or 100 * o.most < 80 * c.a
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score from ranked join totals using (lang) where rank <= 2000
""",
}


def all_sql() -> dict[str, str]:
    return dict(SQL)
