"""SQL counterparts of the registered queries, restated independently for DuckDB over the same tables."""

from __future__ import annotations

_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _tok(x: str) -> str:
    # İ lower-cases to i and a combining dot, which DuckDB's lower() leaves out
    return f"coalesce(regexp_extract_all(lower(replace({x}, 'İ', 'i' || chr(775))), '[a-z0-9]+'), [])"


_LIVE = f"coalesce({_strip('text')}, '') <> ''"

_STORE = """
store as (
  select c.id, f.ord, c.text, c.metadata.source as source, c.metadata.source_path as source_path, c.metadata.page as page,
         c.metadata.category as category, c.metadata.document_id as document_id, c.metadata.framework as framework, c.metadata.jurisdiction as jurisdiction
  from chunks c
  join (select id, min(ord) as ord, max(ord) as last from chunks group by id) f on c.id = f.id and c.ord = f.last
)"""
_INDEX = f"""
toks as (select id, ord, {_tok('text')} as t from store),
posting as (select id, term, count(*) as tf from (select id, unnest(t) as term from toks) group by id, term),
size as (select count(*) as n, avg(len(t)) as avgdl from toks),
freq as (select term, count(*) as df from posting group by term),
raw as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as raw_idf from freq, size),
idf as (select term, df, raw_idf, case when raw_idf < 0 then 0.25 * (select avg(raw_idf) from raw) else raw_idf end as idf from raw)"""


def _bm25(asked: str = "asked") -> str:
    return f"""
qterm as (select query_id, term, count(*) as qtf from (select query_id, unnest({_tok('text')}) as term from {asked}) group by query_id, term),
part as (
  select q.query_id, p.id, sum(q.qtf * i.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * len(k.t) / s.avgdl))) as score
  from qterm q join idf i on q.term = i.term join posting p on p.term = q.term join toks k on k.id = p.id cross join size s group by q.query_id, p.id
),
lex as (
  select query_id, id, ord, score, rank from (
    select a.query_id, s.id, s.ord, round(coalesce(p.score, 0), 9) as score,
           row_number() over (partition by a.query_id order by round(coalesce(p.score, 0), 9) desc, s.ord) - 1 as rank
    from {asked} a cross join store s left join part p on p.query_id = a.query_id and p.id = s.id)
  where rank < 24
)"""


_ASKED = f"asked as (select query_id, text from eval_queries where {_LIVE})"
_SOUND = "embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
_UNIT = "list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[])))"
_DENSE = f"""
vec as (select v.id, s.ord, v.u from (select distinct on (id) id, {_UNIT} as u from chunk_vectors where {_SOUND}) v join store s on s.id = v.id),
qvec as (select a.query_id, {_UNIT} as u from asked a join embeddings e on e.vec_id = a.query_id where {_SOUND}),
near as (
  select query_id, id, ord, score, rank from (
    select query_id, id, ord, score, row_number() over (partition by query_id order by score desc, ord) - 1 as rank from (
      select q.query_id, v.id, v.ord, round(list_dot_product(q.u, v.u), 9) as score from qvec q cross join vec v))
  where rank < 24
)"""


def _fuse(lists: str, top: int) -> str:
    return f"""
fused as (
  select query_id, id, fused, place from (
    select query_id, id, fused, row_number() over (partition by query_id order by fused desc, first_list, first_rank) - 1 as place from (
      select query_id, id, round(sum(1.0::double / (61 + rank)), 12) as fused, min(list_no) as first_list, arg_min(rank, list_no) as first_rank from {lists} group by query_id, id))
  where place < {top}
)"""


_BOTH = "lists as (select query_id, 0 as list_no, rank, id from near union all select query_id, 1, rank, id from lex)"


def _hybrid(where: str | None = None, pre: bool = False) -> str:
    base = f"with everything as ({_STORE.strip()[len('store as ('):-1]}), store as (select * from everything where {where})," if pre else f"with {_STORE},"
    cut = ""
    lists = "lists"
    if where and not pre:
        cut = f", kept as (select query_id, list_no, id, row_number() over (partition by query_id, list_no order by rank) - 1 as rank from lists where id in (select id from store where {where}))"
        lists = "kept"
    return f"{base} {_ASKED}, {_INDEX}, {_bm25()}, {_DENSE}, {_BOTH} {cut}, {_fuse(lists, 24)}, hits as (select f.query_id, f.place, f.id, f.fused, s.category, s.document_id, s.text, s.source, s.page from fused f join store s on s.id = f.id where f.place < 8)"


_SHOWN = "select query_id, place, id, round(fused, 9) as fused, category, document_id from hits"
_CODE = f"upper({_strip('jurisdiction')})"
_LABELS = {"SG": "Singapore", "CN": "Mainland China", "TW": "Taiwan", "KR": "South Korea", "JP": "Japan", "HK": "Hong Kong", "EU": "European Union", "INTL": "everywhere"}
_CODES = f"list_filter(list_transform(coalesce(jurisdiction, []), lambda x: upper({_strip('x')})), lambda x: coalesce(x, '') <> '')"
# first occurrences only, in order
_DISTINCT_CODES = f"list_filter({_CODES}, lambda x, i: list_position({_CODES}, x) = i)"
_RANK = "case upper(tier) when 'P0' then 0 when 'P1' then 1 when 'P2' then 2 else 9 end"
_PRIMARY = f"coalesce(list_filter({_CODES}, lambda x: x <> 'INTL')[1], ({_CODES})[1])"
_LISTING = f"""
select pos, coalesce(document_id, '') as document_id, coalesce(nullif(title, ''), nullif(document_id, ''), 'Untitled') as title, coalesce(nullif(tier, ''), 'P2') as tier,
       coalesce(array_to_string(jurisdiction, '|'), '') as jurisdiction, nullif(ingested_at, '') as ingested_at, nullif({_strip("coalesce(source_url, '')")}, '') as source_url
from inventory"""
_SELECT = f"select pos, document_id, tier, {_RANK} as tier_rank, {_PRIMARY} as jurisdiction, nullif({_strip("coalesce(framework, '')")}, '') as framework, ingest_path from inventory where {_strip("coalesce(ingest_path, '')")} <> ''"

_STUDY = {
    "clinical_trial": ["clinical trial", "randomized", "randomised", "intervention", "phase i", "phase ii", "phase iii", "irb", "ethics committee"],
    "biobank": ["biobank", "biospecimen", "tissue bank", "sample repository", "specimen"],
    "cohort_study": ["cohort", "longitudinal", "prospective study", "registry", "population study"],
    "genomic_research": ["genome", "genomic", "whole genome", "wgs", "wes", "sequencing", "variant", "gwas"],
}
_ELEMENTS = ["secondary use", "recontact", "withdraw", "data sharing", "international", "cloud", "identifiable", "pseudonym"]


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_KIND_SCORES = ", ".join(f"len(list_filter({_list(w)}, lambda w: contains(lower(coalesce(text, '')), w))) as s{i}" for i, w in enumerate(_STUDY.values()))
_KIND = (
    f"case when not ({_LIVE}) then 'unspecified' when greatest(s0, s1, s2, s3) = 0 and regexp_matches(lower(text), '\\b(gene|genetic|dna|rna)\\b') then 'genomic_research' "
    "when greatest(s0, s1, s2, s3) = 0 then 'unspecified' when s0 = greatest(s0, s1, s2, s3) then 'clinical_trial' when s1 = greatest(s0, s1, s2, s3) then 'biobank' when s2 = greatest(s0, s1, s2, s3) then 'cohort_study' else 'genomic_research' end"
)
_MISSING = f"list_filter({_list(_ELEMENTS)}, lambda w: not contains(lower(coalesce(text, '')), w))"
_GAP = f"case when len({_MISSING}) <= 3 then 'Partially Compliant' else 'Non-Compliant' end"
_TEXTS = [
    "Say which later uses of the data are covered and which are not.",
    "Describe how a person can step back and what becomes of data passed on before.",
    "Name the places outside the home country where data are kept or processed, if any.",
]
_EMPTY_TEXT = "The store has no chunk to compare this text with: ingest documents first."
_PER_QUERY = "got as (select query_id, list(id order by place) as ids from hits group by query_id)"

_REC = f"""
rec as (select report_id, rec_no, {_strip("coalesce(text, '')")} as text, coalesce(evidence_chunk_ids, []) as ids from recommendations),
cited as (select r.report_id, r.rec_no, list_distinct({_tok('r.text')}) as rt, {_tok('s.text')} as ct from (select report_id, rec_no, text, unnest(list_distinct(ids)) as id from rec) r join store s on s.id = r.id),
best as (select report_id, rec_no, max(case when len(rt) = 0 then 0 else len(list_filter(rt, lambda x: list_contains(ct, x)))::double / len(rt) end) as score from cited group by report_id, rec_no),
scored as (select r.report_id, r.rec_no, r.text, r.ids, coalesce(b.score, 0) as score from rec r left join best b on b.report_id = r.report_id and b.rec_no = r.rec_no),
kept as (select *, case when len(ids) = 0 then 'no_evidence_chunk_ids' when score < 0.3 then 'low_token_overlap' end as reason from scored)"""
_AUDIT = f"""
numbered as (select report_id, row_number() over (partition by report_id order by rec_no) - 1 as i, {_strip("coalesce(text, '')")} as text, coalesce(evidence_chunk_ids, []) as ids from recommendations),
wrong as (select report_id, id, min(i * 1000 + pos) as first_at from (select report_id, i, unnest(ids) as id, generate_subscripts(ids, 1) as pos from numbered) where id not in (select id from store) group by report_id, id),
invalid as (select report_id, list(id order by first_at) as ids from wrong group by report_id),
issue as (
  select report_id, 0 as part, i, 0 as k, 'recommendations[' || i || '] has empty text.' as issue from numbered where text = ''
  union all select report_id, 0, i, 1, 'recommendations[' || i || '] has empty evidence_chunk_ids.' from numbered where len(ids) = 0
  union all select report_id, 1, 0, 0, 'Invalid evidence_chunk_ids (not in retrieved set): [' || array_to_string(list_transform(ids, lambda x: '''' || x || ''''), ', ') || ']' from invalid
)"""

_SUBSTR_CHUNK = """
body as (select {keep}, {strip} as b from {src}),
win as (select *, unnest(generate_series(0, cast(ceil(greatest(length(b) - 900, 0) / 750.0) as integer))) as ix from body where length(b) > 0)"""


def _windows(keep: str, src: str) -> str:
    return _SUBSTR_CHUNK.format(keep=keep, strip=_strip("regexp_replace(text, '\\r\\n?', chr(10), 'g')"), src=src)


_DOC_CHUNKS = f"with {_windows('doc_id', 'documents')}"
_BASE = "regexp_replace(lower(source), '[^a-z]+', '-', 'g') || '.txt'"

_SAVED = "id, ord, md5(substring(b, ix * 750 + 1, 900)) as text_md5, base as source, '/corpus/' || base as source_path, page, category, jurisdictions, document_id"
_META = f"""coalesce(case when {_strip("coalesce(category, '')")} <> '' then category end, regexp_replace(base, '\\.txt$', '')) as category,
       case when {_strip("coalesce(jurisdiction, '')")} <> '' then {_CODE} end as jurisdictions, case when {_strip("coalesce(document_id, '')")} <> '' then document_id end as document_id"""


def _ids(page: str) -> str:
    return f"base || '_' || substring(sha256('/corpus/' || base), 1, 12) || '_p' || {page} || '_c' || chunk_ix as id"


# reports checked from raw answers: first answers hold all lines, second answers the sound ones
_CHECKED = f"""
line as (select report_id, rec_no, {_strip("coalesce(text, '')")} as text, coalesce(text, '') as raw_text, coalesce(evidence_chunk_ids, []) as ids from recommendations),
hit as (select distinct report_id, id from (select report_id, unnest(ids) as id from line where report_id % 5 <> 4) where id in (select id from store)),
n_hit as (select report_id, count(*) as n from hit group by report_id),
full_text as (select report_id, string_agg(raw_text, ' ' order by rec_no) as text from line group by report_id),
part as (select l.report_id, l.rec_no, list_distinct({_tok('l.text')}) as rt, {_tok('s.text')} as ct from (select report_id, rec_no, text, unnest(list_distinct(ids)) as id from line) l join hit h on h.report_id = l.report_id and h.id = l.id join store s on s.id = l.id),
top as (select report_id, rec_no, max(case when len(rt) = 0 then 0 else len(list_filter(rt, lambda x: list_contains(ct, x)))::double / len(rt) end) as score from part group by report_id, rec_no),
lost as (select distinct l.report_id, l.rec_no from (select report_id, rec_no, unnest(ids) as id from line) l left join hit h on h.report_id = l.report_id and h.id = l.id where h.id is null),
flag as (select l.*, coalesce(t.score, 0) as score, x.rec_no is null and len(l.ids) > 0 and l.text <> '' as sound from line l left join top t on t.report_id = l.report_id and t.rec_no = l.rec_no left join lost x on x.report_id = l.report_id and x.rec_no = l.rec_no),
tally as (
  select report_id, bool_and(sound) and any_value(report_id) % 5 <> 1 as clean1, count(*) filter (where score >= 0.3) as kept1, count(*) as n1,
         count(*) filter (where sound and score >= 0.3) as kept2, count(*) filter (where sound) as n2,
         string_agg(text || ' ' || array_to_string(ids, '|'), chr(10) order by rec_no) filter (where score >= 0.3) as recs1, string_agg(text || ' ' || array_to_string(ids, '|'), chr(10) order by rec_no) filter (where sound and score >= 0.3) as recs2
  from flag group by report_id),
verdict as (select *, clean1 and kept1 > 0 as pass1, n2 = 0 or kept2 > 0 as pass2 from tally)"""

SQL: dict[str, str] = {
    "tokens": f"select doc_id, len({_tok('text')}) as n_tokens, len(list_distinct({_tok('text')})) as n_distinct, md5(array_to_string({_tok('text')}, ' ')) as tokens_md5 from documents",
    "token_stats": f"select token, sum(tf)::bigint as cf, count(*) as df from (select doc_id, token, count(*) as tf from (select doc_id, unnest({_tok('text')}) as token from documents) group by 1, 2) group by token",
    "chunks": f"{_DOC_CHUNKS} select doc_id, ix as chunk_ix, ix * 750 as start, length(substring(b, ix * 750 + 1, 900)) as n_chars, md5(substring(b, ix * 750 + 1, 900)) as text_md5 from win",
    "stream_ingest": f"""
        with {_windows("doc_id || '.txt' as base, doc_id, category, jurisdiction, document_id", "documents")}, placed as (select *, ix as chunk_ix, doc_id * 4294967296 + ix as ord, 0::bigint as page from win)
        select {_SAVED} from (select {_ids("0")}, ord, b, ix, base, page, {_META} from placed)""",
    "ingest_store": f"""
        with doc as (select {_BASE} as base, doc_id as page, text, category, jurisdiction, document_id from documents where source is not null),
        about as (select base, row_number() over (order by base) - 1 as no, min(category) as category, min(jurisdiction) as jurisdiction, min(document_id) as document_id from doc group by base),
        {_windows("base, page", "doc")}, placed as (select *, row_number() over (partition by base order by page, ix) - 1 as chunk_ix from win),
        met as (select p.*, a.no * 4294967296 + chunk_ix as ord, a.category, a.jurisdiction, a.document_id from placed p join about a on a.base = p.base)
        select {_SAVED} from (select {_ids("page")}, ord, b, ix, base, page, {_META} from met)""",
    "ingest_batch": f"""
        with {_STORE}, {_windows("source_path", "store where source_path is not null")}, n as (select source_path, count(*) as n from win group by 1), p as (select distinct source_path from store)
        select i.pos, i.document_id, case when p.source_path is null then 'missing_file' when n.n is null and lower(i.ingest_path) like '%.pdf' then 'error' else 'ok' end as status, coalesce(n.n, 0) as chunks
        from inventory i left join p on p.source_path = i.ingest_path left join n on n.source_path = i.ingest_path where {_strip("coalesce(ingest_path, '')")} <> ''""",
    "check_reports": f"""
        with {_STORE}, {_CHECKED}, s as (select t.report_id, t.text, {_KIND_SCORES.replace("text", "t.text")} from full_text t),
        kind as (select report_id, {_KIND} as study_type, {_GAP} as status from s)
        select v.report_id, case when h.n is null then 'empty store' when v.report_id % 5 = 3 then 'keywords' else 'model' end as made_by,
               case when h.n is null or v.report_id % 5 = 3 then k.study_type else 'given' end as study_type, case when h.n is null then 'Unknown' when v.report_id % 5 = 3 then k.status else 'Compliant' end as status,
               case when h.n is null then false when v.report_id % 5 = 3 then true else pass1 or pass2 end as grounding_ok, case when h.n is null then 1 when v.report_id % 5 = 3 or pass1 or pass2 then 0 else 1 end::bigint as n_issues,
               coalesce(h.n, 0) as allowed_chunk_count, case when h.n is null then 1 when v.report_id % 5 = 3 then 3 when pass1 then kept1 else kept2 end as recommendation_count,
               case when h.n is null then 0 when v.report_id % 5 = 3 or pass1 then 1 else 2 end as grounding_attempts, h.n is not null and v.report_id % 5 <> 3 and not pass1 and not pass2 as dropped_all,
               case when h.n is not null and v.report_id % 5 <> 3 then md5(coalesce(case when pass1 then recs1 else recs2 end, '')) end as recommendations_md5
        from verdict v join kind k on k.report_id = v.report_id left join n_hit h on h.report_id = v.report_id""",
    "audit_empty_reports": f"""
        with {_STORE}, {_REC}, {_AUDIT},
        every as (select -query_id as report_id, query_id % 3 = 0 as unparsed from eval_queries union all select distinct report_id, false from recommendations),
        n_issue as (select report_id, count(*) as n from issue group by 1),
        n_rec as (select report_id, count(*) as n, count(*) filter (where reason is null) as kept, sum(round(score, 4)) filter (where reason is null) as total from kept group by 1)
        select e.report_id, coalesce(i.n, 0) + e.unparsed::int = 0 as ok, (coalesce(i.n, 0) + e.unparsed::int)::bigint as n_issues, (select count(*) from store) as allowed_chunk_count, coalesce(r.n, 0) as recommendation_count,
               coalesce(r.n, 0) as input_count, coalesce(r.kept, 0) as kept_count, coalesce(r.n > 0 and r.kept = 0, false) as dropped_all, round(coalesce(r.total, 0), 3) as kept_scores
        from every e left join n_issue i on i.report_id = e.report_id left join n_rec r on r.report_id = e.report_id""",
    "chunk_ids": f"""
        with {_windows(f"{_BASE} as base, cast(doc_id as integer) as page, category, jurisdiction, document_id", "documents where source is not null")},
        placed as (select *, row_number() over (partition by base order by page, ix) - 1 as chunk_ix from win)
        select base || '_' || substring(sha256('/corpus/' || base), 1, 12) || '_p' || page || '_c' || chunk_ix as id, base as source, '/corpus/' || base as source_path, page, chunk_ix,
               coalesce(case when {_strip("coalesce(category, '')")} <> '' then category end, regexp_replace(base, '\\.txt$', '')) as category,
               case when {_strip("coalesce(jurisdiction, '')")} <> '' then {_CODE} end as jurisdiction, case when {_strip("coalesce(document_id, '')")} <> '' then document_id end as document_id,
               cast(null as varchar) as framework, length(substring(b, ix * 750 + 1, 900)) as n_chars
        from placed""",
    "manifest_store": f"with {_STORE} select id, ord, md5(text) as text_md5, source, cast(page as varchar) as page, category, jurisdiction as jurisdictions, document_id, framework from store",
    "bm25_index": f"with {_STORE}, {_INDEX} select term, df, round(raw_idf, 6) as raw_idf, round(idf, 6) as idf from idf",
    "bm25_stats": f"with {_STORE}, {_INDEX} select n, round(avgdl, 6) as avgdl from size",
    "bm25_topk": f"with {_STORE}, {_ASKED}, {_INDEX}, {_bm25()} select query_id, rank, id, round(score, 6) as score from lex",
    "bm25_zero_padding": f"with {_STORE}, asked as (select * from (values (1, 'zzzunmatched'), (2, 'freezer zzzunmatched freezer'), (5, 'xj 1143')) t(query_id, text)), {_INDEX}, {_bm25()} select query_id, rank, id, round(score, 6) as score from lex",
    "dense_topk": f"with {_STORE}, {_ASKED}, {_DENSE} select query_id, rank, id, round(score, 6) as score from near",
    "rrf": f"with {_STORE}, {_ASKED}, {_INDEX}, {_bm25()}, {_DENSE}, {_BOTH}, {_fuse('lists', 24)} select query_id, place, id, round(fused, 9) as fused from fused",
    "hybrid": f"{_hybrid()} {_SHOWN}",
    "hybrid_category": f"{_hybrid("lower(category) = 'consent_form'")} {_SHOWN}",
    "hybrid_jurisdiction": f"{_hybrid(f"{_CODE} in ('SG', 'HK')")} {_SHOWN}",
    "hybrid_prefilter": f"{_hybrid(f"{_CODE} in ('SG', 'HK')", pre=True)} {_SHOWN}",
    "eval_probes": f"{_hybrid()} select query_id, count(*) as hit_count, string_agg(id, '|' order by place) as top_ids, md5(string_agg(replace(substring(coalesce(text, ''), 1, 240), chr(10), ' '), '|' order by place) filter (where place < 3)) as snippets_md5 from hits group by query_id",
    "retrieval_metrics": f"""{_hybrid()},
        gold as (select a.query_id, s.id from asked a join store s on contains(s.text, substring(a.text, 1, 24))),
        good as (select h.query_id, count(*) as n, min(h.place) as first from hits h join gold g on g.query_id = h.query_id and g.id = h.id group by h.query_id)
        select g.query_id, round(coalesce(any_value(o.n), 0) / count(*), 6) as recall_at_k, round(coalesce(any_value(o.n), 0) / 8.0::double, 6) as precision_at_k, round(coalesce(1.0::double / (any_value(o.first) + 1), 0), 6) as reciprocal_rank
        from gold g left join good o on o.query_id = g.query_id group by g.query_id""",
    "evidence_pack": f"""{_hybrid()},
        block as (select query_id, place, '[chunk_id=' || id || ' source=' || coalesce(source, '?') || ' page=' || coalesce(page, 0) || ' category=' || coalesce(category, '?') || ']' || chr(10) || {_strip("coalesce(text, '')")} || chr(10) as b from hits),
        used as (select query_id, place, b, sum(length(b)) over (partition by query_id order by place) as used from block)
        select query_id, count(*) filter (where used <= 6000) as n_chunks, coalesce(max(used) filter (where used <= 6000), 0)::bigint as used_chars, md5({_strip("coalesce(string_agg(b, chr(10) order by place) filter (where used <= 6000), '')")}) as evidence_md5 from used group by query_id""",
    "chunk_cards": f"with {_STORE} select id, md5(substring(coalesce(text, ''), 1, 2000)) as card_md5, md5(replace(substring(coalesce(text, ''), 1, 240), chr(10), ' ')) as snippet_md5 from store",
    "list_jurisdictions": f"select distinct upper({_strip('metadata.jurisdiction')}) as jurisdiction from chunks where {_strip("coalesce(metadata.jurisdiction, '')")} <> ''",
    "jurisdiction_options": f"with r as (select distinct metadata.jurisdiction as raw, upper({_strip('metadata.jurisdiction')}) as c from chunks where metadata.jurisdiction is not null) select raw, case c {' '.join(f"when '{k}' then '{k} — {v}'" for k, v in _LABELS.items())} else c end as label from r",
    "jurisdiction_filters": f"select pos, array_to_string({_DISTINCT_CODES}, '|') as codes, case when len({_CODES}) > 0 then array_to_string({_DISTINCT_CODES}, ', ') else 'all jurisdictions' end as scope from inventory",
    "browse_region": f"with {_STORE}, r as (select id, ord, md5(text) as text, source, source_path, cast(page as varchar) as page, category, jurisdiction as jurisdictions, document_id, framework, count(*) over () as total from store where {_CODE} = 'HK') select * from r order by ord limit 25",
    "label_codes": f"select pos, array_to_string({_DISTINCT_CODES}, '|') as codes from inventory",
    "store_counts": f"with {_STORE} select (select count(*) from store) as n_chunks, (select count(*) from inventory) as n_documents",
    "source_links": f"with {_STORE}, link as (select document_id as key, arg_max({_strip('source_url')}, pos) as source_url from inventory where {_strip("coalesce(source_url, '')")} <> '' and coalesce(document_id, '') <> '' group by 1) select s.id, l.source_url from store s left join link l on l.key = coalesce(nullif(s.document_id, ''), s.category)",
    "corpus_listing": _LISTING,
    "corpus_region": f"{_LISTING} where list_contains(list_transform(jurisdiction, lambda x: upper(x)), 'EU')",
    "inventory_by_tier": "select upper(coalesce(nullif(tier, ''), 'P2')) as shown_tier, pos, document_id from inventory where upper(coalesce(nullif(tier, ''), 'P2')) in ('P0', 'P1', 'P2')",
    "batch_selection": f"{_SELECT} and coalesce(ingested_at, '') = ''",
    "batch_selection_tier": f"{_SELECT} and upper(tier) = 'P2'",
    "ingest_results": f"with {_STORE}, h as (select source_path, count(*) as n from store where source_path is not null group by 1) select i.pos, i.document_id, case when h.n is null then 'missing_file' else 'ok' end as status, coalesce(h.n, 0) as chunks from inventory i left join h on h.source_path = i.ingest_path where {_strip("coalesce(ingest_path, '')")} <> ''",
    "ingest_summary": f"with {_STORE}, p as (select distinct source_path from store) select count(p.source_path) as ingested, count(*) - count(p.source_path) as missing_file, 0::bigint as errors from inventory i left join p on p.source_path = i.ingest_path where {_strip("coalesce(ingest_path, '')")} <> ''",
    "study_type": f"with s as (select doc_id, text, {_KIND_SCORES} from documents) select doc_id, {_KIND} as study_type, greatest(s0, s1, s2, s3) as best_score from s",
    "keyword_gap": f"select doc_id, array_to_string({_MISSING}, '|') as missing, len({_MISSING}) as n_missing, {_GAP} as status from documents",
    "fallback_report": f"""{_hybrid()}, {_PER_QUERY}, s as (select query_id, text, {_KIND_SCORES} from eval_queries)
        select s.query_id as report_id, {_KIND} as study_type, case when g.ids is null then 'Unknown' else {_GAP} end as status, case when g.ids is null then '' else array_to_string({_MISSING}, '|') end as missing,
               case when g.ids is null then 1 else 3 end::bigint as n_recommendations, case when g.ids is null then 0 else least(len(g.ids), 5) end as n_citations, g.ids is not null as grounding_ok,
               case when g.ids is null then 'Nothing was retrieved, so no evidence can be checked.' else '' end as issues, case when g.ids is null then 0 else 1 end::bigint as grounding_attempts
        from s left join got g on g.query_id = s.query_id""",
    "fallback_recommendations": f"""{_hybrid()}, {_PER_QUERY},
        fixed as (select * from (values (0, '{_TEXTS[0]}'), (1, '{_TEXTS[1]}'), (2, '{_TEXTS[2]}')) t(rec_no, text))
        select g.query_id as report_id, f.rec_no::bigint as rec_no, f.text, g.ids[f.rec_no % len(g.ids) + 1] as evidence from got g cross join fixed f
        union all select e.query_id, 0, '{_EMPTY_TEXT}', '' from eval_queries e where e.query_id not in (select query_id from got)""",
    "fallback_citations": f"{_hybrid()} select query_id as report_id, place as no, id as chunk_id, 'Among the chunks found for this text.' as reason from hits where place < 5",
    "token_recall": f"with {_STORE}, {_REC} select report_id, rec_no, round(score, 6) as score from scored",
    "overlap_filter": f"with {_STORE}, {_REC} select report_id, rec_no, reason is null as kept, reason, round(case when reason = 'no_evidence_chunk_ids' then 0 else score end, 6) as score from kept",
    "overlap_stats": f"with {_STORE}, {_REC} select report_id, count(*) as input_count, count(*) filter (where reason is null) as kept_count, count(reason) as dropped_count, count(*) filter (where reason is null) = 0 as dropped_all, coalesce(string_agg(rec_no::varchar, '|' order by rec_no) filter (where reason is not null), '') as dropped from kept group by report_id",
    "grounding_audit": f"""with {_STORE}, {_AUDIT}
        select n.report_id, count(i.issue) = 0 as ok, coalesce(any_value(i.issue), '') as issues, any_value(n.c) as recommendation_count, coalesce(any_value(array_to_string(v.ids, '|')), '') as invalid
        from (select report_id, count(*) as c from numbered group by 1) n left join (select report_id, string_agg(issue, chr(10) order by part, i, k) as issue from issue group by 1) i on i.report_id = n.report_id left join invalid v on v.report_id = n.report_id group by n.report_id""",
    "citation_audit": f"""with {_STORE}, {_AUDIT},
        cit as (select report_id, rec_no, rec_no % 3 <> 2 as obj, case when rec_no % 3 <> 2 then evidence_chunk_ids[1] end as cid from recommendations),
        every_issue as (select * from issue union all select report_id, 2, rec_no, 0, case when not obj then 'citations[' || rec_no || '] is not an object.' else 'citations[' || rec_no || '] invalid chunk_id: ''' || cid || '''' end from cit where not obj or (cid is not null and cid not in (select id from store))),
        per as (select report_id, count(*) as n, string_agg(issue, chr(10) order by part, i, k) as t from every_issue group by 1)
        select c.report_id, any_value(p.n) is null as ok, coalesce(any_value(p.n), 0) as n_issues, md5(coalesce(any_value(p.t), '')) as issues_md5, count(*) as citation_count, coalesce(string_agg(c.cid, '|' order by c.rec_no) filter (where c.obj and c.cid in (select id from store)), '') as valid
        from cit c left join per p on p.report_id = c.report_id group by c.report_id""",
    "normalise_recs": f"""
        with live as (select report_id, rec_no, {_strip("coalesce(text, '')")} as text, coalesce(evidence_chunk_ids, []) as ids from recommendations where rec_no % 4 <> 3)
        select report_id, row_number() over (partition by report_id order by rec_no) - 1 as i, text, case when rec_no % 4 = 1 then '' else array_to_string(ids, '|') end as evidence from live""",
    "report_salvage": """
        with r as (select distinct report_id, report_id % 4 as k from recommendations)
        select report_id, case when k = 0 then 'kind ' || report_id else 'unspecified' end as study_type, case k when 0 then 'Compliant' when 1 then 'Non-Compliant' else 'Unknown' end as status,
               case when k = 0 then 'cloud' else '' end as missing, case when k = 1 then 'n' || report_id end as notes, 0::bigint as n_recommendations, k >= 2 as parse_failed from r""",
    "final_attempts": f"""with {_STORE}, {_REC}, a as (select report_id, rec_no + 1 as attempt, reason is null as ok from kept where rec_no < 2)
        select report_id, case when bool_or(ok) then min(attempt) filter (where ok) else max(attempt) end as attempt, bool_or(ok) as ok from a group by report_id""",
    "review_flags": f"""with {_STORE}, {_REC}, {_AUDIT},
        r as (select s.report_id, count(*) filter (where len(s.ids) > 0) as n, min(s.score) as low, s.report_id not in (select report_id from issue) as ok from scored s group by s.report_id),
        f as (select report_id, case when n < 2 then 'weak_retrieval' when not ok then 'grounding_failed' when low < 0.15 then 'low_overlap' end as reason from r)
        select report_id, reason is not null as needs_human_review, reason from f""",
    "chat_window": f"""with m as (select report_id as conv_id, rec_no as turn, ['user', 'assistant', 'system'][rec_no % 3 + 1] as role, {_strip("text")} as text, row_number() over (partition by report_id order by rec_no desc) as nth from recommendations)
        select conv_id, turn, role, text from m where nth <= 3 and role <> 'system' and coalesce(text, '') <> ''""",
    "chat_prompt": f"""{_hybrid()},
        block as (select query_id, place, '[chunk_id=' || id || ' source=' || coalesce(source, '?') || ' page=' || coalesce(page, 0) || ' category=' || coalesce(category, '?') || ']' || chr(10) || {_strip("coalesce(text, '')")} || chr(10) as b from hits),
        used as (select query_id, place, b, sum(length(b)) over (partition by query_id order by place) as used from block),
        ev as (select query_id, {_strip("string_agg(b, chr(10) order by place)")} as e from used where used <= 12000 group by query_id),
        s as (select query_id, text, {_KIND_SCORES} from eval_queries),
        recent as (select report_id as conv_id, rec_no as turn, {_strip('text')} as text, row_number() over (partition by report_id order by rec_no desc) as nth from recommendations where report_id in (select query_id from eval_queries))
        select s.query_id as conv_id, -1::bigint as turn, 'system' as role, md5('STUDY_TYPE_GUESS: ' || {_KIND} || chr(10) || chr(10) || 'POLICY EXCERPTS:' || chr(10) || coalesce(ev.e, '') || chr(10) || chr(10) || 'CONSENT_OR_DATA_USE_TEXT:' || chr(10) || {_strip("coalesce(s.text, '')")}) as text_md5 from s left join ev on ev.query_id = s.query_id
        union all select conv_id, turn, 'user', md5(text) from recent where nth <= 24 and coalesce(text, '') <> ''""",
}
