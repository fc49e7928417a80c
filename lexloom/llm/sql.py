"""SQL counterparts of the training-data queries, where SQL can express them over whole tables."""

from __future__ import annotations

from lexloom.llm.quality import COMMON

_REPEATED = r"""
records as (
  select distinct on (id) id, metadata.source as source, metadata.document_id as doc, text
  from chunks where metadata.source is not null
),
docs as (
  select metadata.source as source, count(distinct metadata.document_id) as n_docs
  from chunks where metadata.source is not null group by 1
),
split_up as (
  select id, source, doc, regexp_split_to_array(text, '\r\n|\r|\n') as lines from records where text is not null
),
lines as (
  select id, source, doc, no - 1 as line_no, lines[no] as line,
         lower(regexp_replace(lines[no], '[^\p{L}]', '', 'g')) as key
  from split_up, unnest(range(1, len(lines) + 1)) as t(no)
),
repeated as (
  select l.source, l.key from lines l join docs d on l.source = d.source
  where length(l.key) >= 3
  group by l.source, l.key, d.n_docs
  having count(distinct l.doc) >= 4 and count(distinct l.doc) * 20 >= d.n_docs
)"""

_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_EAST = r"\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}"
_COMMON = ", ".join(f"'{w}'" for w in sorted(COMMON))

SQL: dict[str, str] = {
    "p1_coverage": rf"""
        with normal as (
          select distinct on (id) id, metadata.page as page, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^[{_WS}]+|[{_WS}]+$', '', 'g') as body from chunks where text is not null order by id, ord desc
        )
        select id, page::bigint as page, length(body) as n_chars, md5(regexp_replace(body, '[{_WS}]+', '', 'g')) as text_md5, true as kept from normal where body <> ''""",
    "p2_groups": r"""
        with recursive words as (select distinct on (id) id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from chunks where text is not null and id is not null),
        member as (select id, array_to_string(w, ' ') as c from words where len(w) >= 40),
        class as (select c, min(id) as first from member group by c),
        sets as (select f.first as k, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s from class f join words w on w.id = f.first),
        each as (select k, len(s) as n, unnest(s) as t from sets),
        common as (select a.k as a, b.k as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from each a join each b on a.t = b.t and a.k < b.k group by 1, 2),
        link as (select a, b from common where 2 * c >= na + nb - c union all select b, a from common where 2 * c >= na + nb - c),
        reach as (select first as k, first as r from class union select reach.k, link.b from reach join link on link.a = reach.r),
        grouped as (select k, min(r) as g from reach group by k),
        n as (select a as k, count(*) as n from link group by 1)
        select m.id, g.g as group, coalesce(n.n, 0) as n_links from member m join class f on f.c = m.c join grouped g on g.k = f.first left join n on n.k = f.first""",
    "p8_counts": rf"""
        with low as (select doc_id, coalesce(text, '') as text, lower(replace(coalesce(text, ''), 'İ', 'i' || chr(775))) as low from documents),
        cut as (
          select doc_id, text, case when regexp_matches(low, '[{_EAST}]') then regexp_extract_all(low, '[\x{{3400}}-\x{{9fff}}\x{{f900}}-\x{{faff}}]|[\x{{3040}}-\x{{309f}}]+|[\x{{30a0}}-\x{{30ff}}]+|[\p{{L}}\p{{N}}]+') else regexp_extract_all(low, '[\p{{L}}\p{{N}}]+') end as w,
                 list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: regexp_replace(x, '[{_WS}]+$', '')), lambda x: regexp_matches(x, '[^{_WS}]')) as lines from low
        ),
        mixed as (select doc_id, text, lines, flatten(list_transform(w, lambda x: case when regexp_matches(x, '^[^{_EAST}]') and regexp_matches(x, '[{_EAST}]') then regexp_extract_all(x, '[\x{{3400}}-\x{{9fff}}\x{{f900}}-\x{{faff}}]|[\x{{3040}}-\x{{309f}}]+|[\x{{30a0}}-\x{{30ff}}]+|[^{_EAST}]+') else [x] end)) as w from cut)
        select doc_id, length(text) as n_chars, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
               length(regexp_replace(text, '[{_WS}]', '', 'g')) - coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as n_symbols,
               len(lines) as n_lines, len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…。！？:;：；]["''”’»)\]」』）]*$'))) as n_ended, len(list_filter(w, lambda x: x in ({_COMMON}))) as n_common
        from mixed""",
    "p1_found": r"""
        with normal as (
          select distinct on (id) id,
                 regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '', 'g') as body
          from chunks where length(text) > 900
        ),
        pieces as (
          select id, unnest(regexp_split_to_array(body, '[\s\x0b\x1c-\x1f\x85\p{Z}。！？；，、]')) as stretch
          from normal where length(body) > 900
        )
        select id, case when max(length(stretch)) > 900 then 'forced' else 'natural' end as cut from pieces group by id""",
    "p2_found": r"""
        with words as (select distinct on (id) id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from chunks where text is not null),
        sets as (select id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s from words where len(w) >= 40),
        each as (select id, len(s) as n, unnest(s) as t from sets),
        common as (select a.id as id_a, b.id as id_b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from each a join each b on a.t = b.t and a.id < b.id group by 1, 2)
        select id_a, id_b from common where 2 * c >= na + nb - c""",
    "p5_found": r"""
        with sound as (
          select distinct on (id) id, embedding::double[] as v from chunk_vectors
          where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        unit as (select id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from sound),
        pairs as (select a.id, b.id as other, list_dot_product(a.u, b.u) as cosine from unit a join unit b on a.id <> b.id),
        near as (select *, row_number() over (partition by id order by round(cosine, 6) desc, other) as place from pairs)
        select distinct least(id, other) as id_a, greatest(id, other) as id_b from near where place <= 5 and cosine >= 0.9""",
    "p3_found": f"with {_REPEATED} select l.id, cast(l.line_no as integer) as line_no from lines l join repeated r on l.source = r.source and l.key = r.key",
}
