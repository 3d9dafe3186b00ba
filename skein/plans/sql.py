"""The queries' results in DuckDB SQL."""

from __future__ import annotations

from skein.operators.extract import ENTITY_TASK, ENTITY_TYPES, RELATIONSHIP_TASK, RELATIONSHIP_TYPES, THEME_TASK
from skein.plans.queries import AS_OF, EGO_CENTER, EGO_DEPTH, NEEDLE, SPAN
from skein.sources.views import with_views

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[\x09-\x0D\x20\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_EDGE = "id, source_entity_id, target_entity_id, kind, weight"

# Nodes and edges of projections: n (id, name, kind), e (edges with both ends in n).
_NODES = "select * from entities where merged_into_id is null"
_FILTERED = "select * from entities where merged_into_id is null and kind in ('person', 'project', 'place')"
_FILTER = "weight >= 1.0 and confidence >= 0.95"


def _graph(nodes: str, edges: str = "true") -> str:
    return f"n as ({nodes}), e as (select r.* from relationships r where ({edges}) and source_entity_id in (select id from n) and target_entity_id in (select id from n))"


_BOTH = "b as (select source_entity_id as id, target_entity_id as neighbor from e union all select target_entity_id, source_entity_id from e)"
_DEGREES = f"{_BOTH}, d as (select n.id, count(neighbor)::bigint as degree from n left join b on n.id = b.id group by n.id)"
_STATS = """select node_count, edge_count, 0::bigint as cluster_count, case when node_count > 1 then edge_count / (node_count * (node_count - 1) / 2) else 0 end::double as density,
  case when node_count > 0 then 2 * edge_count / node_count else 0 end::double as average_degree from (select (select count(*) from {n}) as node_count, (select count(*) from {e}) as edge_count)"""
_SEMANTIC = _graph(_FILTERED, f"{_FILTER} and kind <> 'cooccurs'")


def _labels() -> str:
    """Ten rounds of label propagation; a fixed point stays one."""
    out = ["l0 as (select id, id as label from n)", "w as (select id, neighbor, count(*) as n from b group by id, neighbor)"]
    for i in range(10):
        votes = f"select w.id, l.label, w.n from w join l{i} l on l.id = w.neighbor union all select id, label, 1 from l{i}"
        out.append(f"l{i + 1} as (select id, arg_min(label, (-n, label)) as label from (select id, label, sum(n) as n from ({votes}) group by id, label) group by id)")
    return ", ".join(out)


# Source pages, metadata and segments as the queries make them.
_PAGES = """dd as (select doc_id, doc_id::varchar as id, case when doc_id % 5 <> 0 then 'Document ' || doc_id end as title, '2024-01-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') || 'T10:00:00Z' as stamp from documents where doc_id is not null),
pp as (select *, unnest(case when doc_id % 90 < 10 and doc_id >= 90 then [doc_id // 90 - 1, doc_id // 90] else [doc_id // 90] end) as page_no from dd),
docs as (select page_no, (row_number() over (partition by page_no order by doc_id) - 1)::int as pos, id, title, case when doc_id % 3 <> 0 then stamp end as created_at, case when doc_id % 2 = 0 then stamp end as updated_at from pp)"""
_SEGMENTS = """sg as (select conv_id, turn, conv_id || '-' || turn as id, conv_id::varchar as document_id, text, role as source, turn % 2 = 0 as is_final,
  case when turn % 5 <> 4 then strftime(timestamp '2024-01-01' + to_seconds(turn * 30), '%Y-%m-%dT%H:%M:%S') || '.500Z' else '2024-01-01' end as start_timestamp,
  timestamp '2024-01-01' + to_seconds(turn * 30 + 20) + interval 500 millisecond as end_at,
  case when turn % 5 <> 4 then timestamp '2024-01-01' + to_seconds(turn * 30) + interval 500 millisecond end as start_at from conversations where conv_id % 11 <> 0)"""
_SYNC = "fresh as (select * from meetings where source_id::bigint % 5 <> 0), good as (select * from fresh where source_id::bigint % 11 <> 0)"

# Answers: words of turns with kind, confidence and chunk.
_ANSWERS = r"""ww as (select distinct conv_id, turn, w from (select conv_id, turn, unnest(list_filter(string_split(text, ' '), lambda w: regexp_full_match(w, '[A-Z][a-z]{3,}'))) as w from conversations)),
cc as (select distinct conv_id, substr(sha256(conv_id::varchar), 1, 32) as meeting_id from ww),
ok as (select * from cc where conv_id % 11 <> 0 and (conv_id % 7 = 0 or conv_id % 13 <> 0)),
ff as (select meeting_id, conv_id, turn, w as name, lower(w) as canonical_name, ['person', 'organization', 'actionItem', 'other'][(length(w) % 4 + 1)::int] as kind, 0.5 + (turn % 5) / 10 as confidence,
  row_number() over (partition by conv_id order by turn, w) - 1 as pos from ww join ok using (conv_id)),
hv as (select h.canonical_name, h.kind, coalesce(e.merged_into_id, e.id) as have from (select canonical_name, kind, arg_min(id, (first_seen_at, id)) as id from entities group by canonical_name, kind) h join entities e on e.id = h.id),
ids as (select f.canonical_name, f.kind, coalesce(have, substr(sha256(f.kind || '|' || f.canonical_name), 1, 32)) as entity_id, f.name, have is null as is_new
  from (select canonical_name, kind, arg_min(name, (meeting_id, pos)) as name from ff group by canonical_name, kind) f left join hv on hv.canonical_name = f.canonical_name and hv.kind = f.kind),
mm as (select substr(sha256(substr(sha256(meeting_id || '|entities|v1'), 1, 32) || '|' || pos || '|0'), 1, 32) as id, entity_id, meeting_id || ':' || turn as meeting_chunk_id, confidence, meeting_id, substr(sha256(meeting_id || '|entities|v1'), 1, 32) as extraction_run_id from ff join ids using (canonical_name, kind))"""
_TRANSCRIPTS = "tr as (select meeting_id, string_agg('[' || chunk_index || '] [' || speaker || '] ' || text, chr(10) order by chunk_index) as transcript from meeting_chunks group by meeting_id)"
_RELATED = """rl as (select meeting_id, list_sort(list_distinct(list(name))) as names from ff group by meeting_id),
ra as (select meeting_id, unnest(range(1, len(names))) as i, names from rl where len(names) > 1),
rr as (select meeting_id, i, names[i] as a, upper(names[i + 1]) as b, ['worksFor', 'partOf', 'relatesTo', 'owns'][(length(names[i]) % 4 + 1)::int] as kind from ra)"""


def _case(given: str, names: dict[str, str], default: str) -> str:
    return f"case lower({given}) " + " ".join(f"when '{k}' then '{x}'" for k, x in names.items()) + f" else '{default}' end"


_MERGED = "coalesce((select primary_id from merges where duplicate_id = {c}), {c})"
_PARTS = "p as (select * from entities where kind = 'project')"
_ALIASES = """al as (select entity_id, alias, max(source) as source from (
    select coalesce(m.primary_id, a.entity_id) as entity_id, alias, source from entity_aliases a left join merges m on m.duplicate_id = a.entity_id
    union all select m.primary_id, d.name, 'auto' from merges m join entities d on d.id = m.duplicate_id join entities p on p.id = m.primary_id where lower(d.name) <> lower(p.name)) group by entity_id, alias)"""
_RELINKED = "rm as (select r.id, coalesce(a.primary_id, r.source_entity_id) as source_entity_id, coalesce(b.primary_id, r.target_entity_id) as target_entity_id, kind, weight from relationships r left join merges a on a.duplicate_id = r.source_entity_id left join merges b on b.duplicate_id = r.target_entity_id)"
_NORMAL = r"trim(regexp_replace(regexp_replace(strip_accents(lower({})), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
_UNDONE = "u as (select duplicate_id, primary_id from merges where length(duplicate_id) % 2 = 0)"
_TAKEN_BACK = """select 'merge:1:' || m.duplicate_id as id, m.duplicate_id, m.primary_id, 'merge' as action, 'exact: same name' as reason, timestamp '2024-06-01' as performed_at, case when u.duplicate_id is not null then timestamp '2024-07-01' end as undone_at
        from merges m left join u on u.duplicate_id = m.duplicate_id union all select '{action}:2:merge:1:' || duplicate_id, duplicate_id, primary_id, '{action}', null, timestamp '2024-07-01', null from u"""
_MET = """mc as (select distinct e.id, e.canonical_name, o_custkey as c from mentions x join orders on 'order:' || o_orderkey = x.meeting_chunk_id join entities e on e.id = x.entity_id where e.kind = 'project' and e.merged_into_id is null),
        met as (select x.id as a, y.id as b, least(1.0, count(*) / 6)::double as confidence, count(*) || ' chunks in common' as reason from mc x join mc y on x.c = y.c and x.canonical_name = y.canonical_name and x.id < y.id group by all having count(*) >= 3)"""
_HITS = """hits as (select 'chunk' as type, c.id, substr(text, 1, 200) as snippet, 'Speaker: ' || speaker as context, 1.0::double as score, -epoch(date)::bigint as o from meeting_chunks c join meetings m on m.id = c.meeting_id where contains({t}, '{q}')
  union all select 'meeting', id, coalesce(summary, title), null, 0.9, -epoch(date)::bigint from meetings where contains({title}, '{q}') or contains({summary}, '{q}')
  union all select 'entity', id, name, upper(kind[1]) || lower(kind[2:]), 0.8, -mention_count from entities where contains({name}, '{q}') or contains({canonical}, '{q}'))"""


def _hits(q: str) -> str:
    f = {k: _FOLD.format(c) for k, c in (("t", "text"), ("title", "title"), ("summary", "summary"), ("name", "name"), ("canonical", "canonical_name"))}
    return _HITS.format(q=q.strip().lower(), **f)


def _searched(q: str, limit: int, offset: int) -> str:
    n = limit + offset
    return f"with {_hits(q)}, k as (select *, row_number() over (partition by type order by o, id) as r from hits) select type, id, snippet, context, score from k where r <= {n} order by score desc, o, id limit {limit} offset {offset}"


def _resolved(passes: int = 6) -> str:
    """Passes of exact groups and alias stars; those after the fixed point add nothing. f: the survivors in order; s: primaries, from first to last.

    A pass goes through the survivors one by one: each is a primary unless an earlier neighbour is.
    """
    out = ["""f0 as (select id, name, kind, first_seen_at from entities where merged_into_id is null), a0 as (select distinct entity_id, alias from entity_aliases), root0 as (select id, id as root from f0 where false)"""]
    for i in range(passes):
        j = i + 1
        out.append(f"""x{i} as materialized (select id, arg_min(id, (first_seen_at, id)) over (partition by name, kind) as p from f{i}),
        k{i} as materialized (select f.*, row_number() over (order by first_seen_at, f.id) as n from f{i} f join x{i} x on x.id = f.id and x.p = f.id),
        b{i} as materialized (select distinct coalesce(x.p, a.entity_id) as entity_id, alias from a{i} a left join x{i} x on x.id = a.entity_id),
        l{i} as materialized (select distinct least(u.n, w.n) as e, greatest(u.n, w.n) as l from b{i} b join k{i} u on u.id = b.entity_id join k{i} w on w.name = b.alias and w.kind = u.kind where u.n <> w.n),
        g{i} as materialized (select row_number() over (order by l) as step, l, list(e) as es from l{i} group by l),
        r{i} as (select 0::bigint as step, []::bigint[] as late union all select r.step + 1, case when len(list_filter(g.es, lambda e: not list_contains(r.late, e))) > 0 then list_append(r.late, g.l) else r.late end from r{i} r join g{i} g on g.step = r.step + 1),
        d{i} as materialized (select unnest(late) as l from (select late from r{i} order by step desc limit 1)),
        y{i} as materialized (select l.l, min(l.e) as e from l{i} l where l.l in (select l from d{i}) and l.e not in (select l from d{i}) group by l.l),
        m{i} as materialized (select {j} as pass, x.id as duplicate_id, x.p as primary_id, 'exact' as strategy, 'same name' as reason from x{i} x where id <> p union all select {j}, u.id, w.id, 'alias', 'alias' from y{i} y join k{i} u on u.n = y.l join k{i} w on w.n = y.e),
        z{i} as materialized (select u.id, w.id as p, u.name, w.name as own from y{i} y join k{i} u on u.n = y.l join k{i} w on w.n = y.e),
        f{j} as materialized (select id, name, kind, first_seen_at from k{i} where id not in (select id from z{i})),
        a{j} as materialized (select distinct coalesce(z.p, b.entity_id) as entity_id, alias from b{i} b left join z{i} z on z.id = b.entity_id union select p, name from z{i} where lower(name) <> lower(own))""")
    union = " union all ".join(f"select * from m{i}" for i in range(passes))
    out.append(f"mm as materialized ({union}), ch(id, last) as (select duplicate_id, primary_id from mm union all select ch.id, mm.primary_id from ch join mm on mm.duplicate_id = ch.last)")
    return "with recursive " + ", ".join(out) + " select pass, m.duplicate_id, m.primary_id, ch.last as root_id, strategy, reason from mm m join ch on ch.id = m.duplicate_id where ch.last not in (select duplicate_id from mm)"


_BODIES = {
    "ingest_documents": f"with {_PAGES} select page_no, pos, id, title, created_at, updated_at from docs",
    "dedup_pages": f"with {_PAGES}, k as (select *, row_number() over (partition by id order by page_no, pos) as r from docs) select id, page_no, pos, title from k where r = 1",
    "ingest_metadata": "select conv_id::varchar as source_id, 'Meeting ' || conv_id as title, case when conv_id % 4 <> 0 then count(*) * 60 end as duration_seconds, count(*) as n_attendees from conversations group by conv_id",
    "attendees_flat": "select conv_id::varchar as source_id, (row_number() over (partition by conv_id order by turn) - 1)::int as pos, case turn % 3 when 0 then role when 1 then 'Full ' || role else role || '@x.org' end as attendee from conversations",
    "ingest_segments": f"with {_SEGMENTS} select id, document_id, start_timestamp, source, is_final, text from sg",
    "meetings_from_source": f"""with {_PAGES}, k as (select *, row_number() over (partition by id order by page_no, pos) as r from docs),
        m as (select substr(sha256(id), 1, 32) as id, id as source_id, coalesce(title, 'Untitled') as title, coalesce(strptime(created_at, '%Y-%m-%dT%H:%M:%SZ'), strptime(updated_at, '%Y-%m-%dT%H:%M:%SZ'), timestamp '{AS_OF}') as date, 'documents' as source_adapter from k where r = 1)
        select * from m where date >= timestamp '2024-01-05'""",
    "meetings_with_duration": "select conv_id::varchar as source_id, 'Conversation ' || conv_id as title, (case when conv_id % 4 <> 0 then count(*) * 60 else 0 end)::double as duration from conversations group by conv_id",
    "chunks_from_segments": f"""with {_SEGMENTS} select substr(sha256(document_id), 1, 32) as meeting_id, row_number() over (partition by document_id order by start_at nulls last, id) - 1 as chunk_index, text, source as speaker,
        epoch_us(start_at - min(start_at) over (partition by document_id)) / 1e6 as start_time, epoch_us(end_at - min(start_at) over (partition by document_id)) / 1e6 as end_time from sg""",
    "parse_iso_ts": f"with {_SEGMENTS} select id, start_at, end_at from sg",
    "sync_new_meetings": f"with {_SYNC} select id, source_id, title, date, source_adapter, 'cached' as transcript_status, timestamp '{AS_OF}' as imported_at, timestamp '{AS_OF}' as updated_at from fresh",
    "sync_with_quarantine": f"with {_SYNC} select source_id, 'imported' as outcome, null::varchar as reason from good union all select source_id, 'quarantined', 'transcript unreadable or missing' from fresh where source_id::bigint % 11 = 0",
    "enqueue_jobs": f"""with {_SYNC} select 'job:' || id as id, 'extraction' as kind, '{{"meetingID":"' || id || '","sourceAdapter":"' || source_adapter || '"}}' as payload, 'pending' as status, timestamp '{AS_OF}' as created_at, timestamp '{AS_OF}' as scheduled_at from good""",
    "sync_report": f"with {_SYNC} select *, found - imported - failed as skipped from (select (select count(*) from meetings) as found, (select count(*) from good) as imported, (select count(*) from fresh) - (select count(*) from good) as failed)",
    "filter_entities": f"select id, kind, last_seen_at from entities where kind in ('person', 'project') and merged_into_id is null and last_seen_at between timestamp '{SPAN[0]}' and timestamp '{SPAN[1]}'",
    "filter_relationships": f"select {_EDGE} from relationships where kind in ('discusses', 'partOf') and weight >= 2.0 and confidence >= 0.95",
    "active_entities": "select id, name, kind from entities where merged_into_id is null",
    "meetings_recent": "select id, title, date from meetings",
    "meeting_detail": "select m.id as meeting_id, title, chunk_index, coalesce(normalized_text, text, raw_transcript) as shown from meetings m left join meeting_chunks c on c.meeting_id = m.id",
    "duration_label": "select id, case when m < 60 then m || 'm' else (m // 60) || 'h ' || (m % 60) || 'm' end as label from (select id, floor(duration * 25 / 60)::int as m from meetings)",
    "graph_full": f"with {_graph(_NODES)} select {_EDGE} from e",
    "graph_semantic": f"with {_SEMANTIC} select {_EDGE} from e",
    "graph_cooccurrence": f"""with {_graph(_NODES, "kind = 'cooccurs'")} select {_EDGE} from e""",
    "graph_bipartite": f"""with {_graph(_NODES)} select e.id, source_entity_id, target_entity_id, e.kind, weight from e join n a on a.id = source_entity_id join n b on b.id = target_entity_id
        where (a.kind = 'organization' and b.kind in ('project', 'place')) or (a.kind in ('project', 'place') and b.kind = 'organization')""",
    "graph_time_filtered": f"""with {_graph(f"{_NODES} and last_seen_at between timestamp '{SPAN[0]}' and timestamp '{SPAN[1]}'")} select {_EDGE} from e""",
    "graph_ego": f"""with recursive {_graph(_FILTERED, _FILTER)}, {_BOTH}, g(id, depth) as (select id, 0 from n where id = '{EGO_CENTER}' union select b.neighbor, depth + 1 from g join b on b.id = g.id where depth < {EGO_DEPTH})
        select id, kind from n where id in (select id from g)""",
    "graph_top_nodes": f"with {_graph(_NODES)}, {_DEGREES} select id, name, kind from n join d using (id) order by degree desc, id limit 500",
    "graph_stats": f"""with {_graph(_NODES, "kind <> 'cooccurs'")}, {_DEGREES}, t as (select id from d order by degree desc, id limit 500), x as (select * from e where source_entity_id in (select id from t) and target_entity_id in (select id from t)) """ + _STATS.format(n="t", e="x"),
    "graph_neighbors": f"with {_SEMANTIC}, {_BOTH} select distinct id, neighbor from b where id <> neighbor",
    "graph_subgraph": f"""with {_graph(_NODES + " and kind in ('organization', 'place')")} """ + _STATS.format(n="n", e="e"),
    "graph_adjacency": f"with {_SEMANTIC}, {_BOTH} select id, string_agg(neighbor, ',' order by neighbor) as neighbors from b group by id",
    "graph_communities": f"with {_SEMANTIC}, {_BOTH}, {_labels()} select id, label from l10",
    "community_sizes": f"with {_SEMANTIC}, {_BOTH}, {_labels()} select label, count(*) as n from l10 group by label",
    "node_degree": f"with {_graph(_NODES)}, {_DEGREES} select id, degree, 4 + 12 * ln(greatest(degree, 1) + 1) / ln((select greatest(max(degree), 1) from d) + 1) as size from d",
    "degree_rank": f"with {_graph(_NODES)}, {_DEGREES}, r as (select *, row_number() over (order by degree desc, id) as rank, count(*) over () as total from d) select id, degree, rank, floor((rank - 1) / greatest(1, ceil(total / 30)))::bigint as batch from r",
    "edge_evidence": "select id, kind, coalesce(len(evidence_chunk_refs), 0)::bigint as evidence_count from relationships",
    "stream_progress": f"with {_SYNC} select *, found - imported - failed as skipped from (select (select count(*) from meetings) as found, (select count(*) from good) as imported, (select count(*) from fresh) - (select count(*) from good) as failed)",
    "published_changes": "select id, source_id, title, date, source_adapter from meetings where source_id::bigint % 5 <> 0",
    "stream_job_counts": "select status, count(*) as n from jobs group by status",
    "stream_sync": "select id, source_id, case when source_id::bigint % 5 = 0 then 'stored before' else title end as title, date, source_adapter from meetings",
    "clean_text": f"select doc_id, md5(trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))) as cleaned_md5 from documents",
    "normalize_pass": f"select c.id, case when transcript_status = 'chunked' then trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) end as normalized_text from meeting_chunks c join meetings m on m.id = c.meeting_id",
    "pipeline_status": "select transcript_status, case transcript_status when 'cached' then 'chunked' when 'chunked' then 'normalized' else 'extracted' end as next_status, count(*) as n from meetings group by all",
    "format_transcripts": f"with {_TRANSCRIPTS} select meeting_id, transcript from tr",
    "evidence_refs": "select id, case when evidence_chunk_refs is not null then '[' || evidence_chunk_refs[1] || ']' end as refs_json, evidence_chunk_refs[1] as first_ref from relationships",
    "prompts_entities": f"""with {_TRANSCRIPTS}, wh as (select conv_id, string_agg(distinct who, ', ' order by who) as names from (select conv_id, case turn % 3 when 0 then role when 1 then 'Full ' || role else role || '@x.org' end as who from conversations) group by conv_id)
        select m.id as meeting_id, '{ENTITY_TASK}' as system, 'Meeting: ' || title || chr(10) || 'Attendees: ' || names || chr(10) || 'Transcript:' || chr(10) || transcript as message
        from meetings m join tr on tr.meeting_id = m.id join wh on wh.conv_id::varchar = m.source_id""",
    "strip_fences": r"""select conv_id, turn, regexp_replace(case when turn % 3 < 2 then text when contains(text, chr(10)) then substr(text, strpos(text, chr(10)) + 1) else '```' || text end, '^\s+|\s+$', '', 'g') as body from conversations""",
    "prompts_themes": f"with {_TRANSCRIPTS} select m.id as meeting_id, '{THEME_TASK}' as system, 'Meeting: ' || title || chr(10) || 'Transcript:' || chr(10) || transcript as message from meetings m join tr on tr.meeting_id = m.id",
    "prompts_relationships": f"""with {_ANSWERS}, {_TRANSCRIPTS}, kn as (select meeting_id, string_agg(distinct '- ' || canonical_name || ' (' || kind || ')', chr(10) order by '- ' || canonical_name || ' (' || kind || ')') as known from mm join ids using (entity_id) group by meeting_id)
        select m.id as meeting_id, '{RELATIONSHIP_TASK}' as system, 'Meeting: ' || title || chr(10) || 'Known entities:' || chr(10) || known || chr(10) || 'Transcript:' || chr(10) || transcript as message from meetings m join tr on tr.meeting_id = m.id join kn on kn.meeting_id = m.id""",
    "model_responses": f"with {_TRANSCRIPTS} select m.id as meeting_id, length('Meeting: ' || title || chr(10) || 'Transcript:' || chr(10) || transcript)::varchar as answer, null::varchar as error from meetings m join tr on tr.meeting_id = m.id",
    "parse_entities": f"""with {_ANSWERS} select cc.meeting_id, case when cc.conv_id % 11 = 0 then 'not an entity answer' when cc.conv_id % 7 <> 0 and cc.conv_id % 13 = 0 then 'no entities' end as reason, n as n_entities
        from cc left join (select meeting_id, count(*) as n from ff group by meeting_id) f on f.meeting_id = cc.meeting_id""",
    "parse_relationships": f"""with {_ANSWERS}, {_RELATED} select meeting_id, case when meeting_id like '0%' then 'a field is missing or of another type' end as reason, case when meeting_id not like '0%' then count(*) end as n_relationships from rr group by meeting_id""",
    "map_entity_kind": f"select {_case('string_split(p_name, chr(32))[-1]', ENTITY_TYPES, 'other')} as kind, case when p_size % 2 = 0 then 'organization' else 'blogIdea' end as other, count(*) as n from part group by all",
    "map_relationship_kind": f"select given, {_case('given', RELATIONSHIP_TYPES, 'relatesTo')} as kind, count(*) as n from (select ['worksfor', 'WorksOn', 'works_on', 'PARTOF', 'reports'][(event_id % 5 + 1)::int] as given from events) group by given",
    "upsert_entities": f"with {_ANSWERS} select canonical_name, kind, entity_id, name, is_new from ids",
    "build_mentions": f"with {_ANSWERS} select id, entity_id, meeting_chunk_id, confidence, extraction_run_id from mm",
    "mention_counts": f"with {_ANSWERS} select entity_id, count(*) as mention_count, min(date) as first_seen_at, max(date) as last_seen_at from mm join meetings m on m.id = mm.meeting_id group by entity_id",
    "build_relationships": f"""with {_ANSWERS}, {_RELATED}, kw as (select distinct meeting_id, entity_id, lower(canonical_name) as key from ff join ids using (canonical_name, kind)), kf as (select meeting_id, key, min(entity_id) as entity_id from kw group by all)
        select substr(sha256(substr(sha256(rr.meeting_id || '|relationships|rel-v1'), 1, 32) || '|' || (i - 1)), 1, 32) as id, substr(sha256(rr.meeting_id || '|relationships|rel-v1'), 1, 32) as extraction_run_id,
        rr.meeting_id, s.entity_id as source_entity_id, t.entity_id as target_entity_id, kind, 0.75::double as weight, 0.75::double as confidence, i::int as first_ref from rr join kf s on s.meeting_id = rr.meeting_id and s.key = lower(a) join kf t on t.meeting_id = rr.meeting_id and t.key = lower(b)
        where rr.meeting_id not like '0%'""",
    "extraction_runs": f"""with {_ANSWERS}, x as (select meeting_id, case when conv_id % 11 = 0 then 'not an entity answer' when conv_id % 7 <> 0 and conv_id % 13 = 0 then 'no entities' end as error_message from cc)
        select substr(sha256(meeting_id || '|entities|v1'), 1, 32) as id, meeting_id, 'stub' as model, 'v1' as prompt_version, 'entities' as pass_name, timestamp '{AS_OF}' as started_at, case when error_message is null then timestamp '{AS_OF}' end as completed_at, case when error_message is null then 'completed' else 'failed' end as status, error_message from x""",
    "match_exact": "select id, min(id) over (partition by name, kind) as first from entities where merged_into_id is null",
    "normalize_names": f"select name, {_NORMAL.format('name')} as key from (select distinct unnest(string_split(text, ' ')) as name from conversations)",
    "match_fuzzy": f"""with k as (select distinct kind, key from (select p_type as kind, {_NORMAL.format("p_name")} as key from part union all select 'word', {_NORMAL.format("w")} from (select unnest(string_split(text, ' ')) as w from conversations) where regexp_full_match(w, '[A-Z][a-z]+')) where key <> '')
        select a.kind, a.key as x, b.key as y, levenshtein(a.key, b.key) as distance from k a join k b on a.kind = b.kind and (length(a.key) < length(b.key) or (length(a.key) = length(b.key) and a.key < b.key))
        where abs(length(a.key) - length(b.key)) * 5 <= length(b.key) and levenshtein(a.key, b.key) * 5 <= length(b.key)""",
    "near_name_classes": f"""with recursive k as (select distinct kind, key from (select kind, {_NORMAL.format("name")} as key from entities where merged_into_id is null) where key <> ''),
        near as materialized (select a.kind, a.key as x, b.key as y from k a join k b on a.kind = b.kind and a.key <> b.key
          where abs(length(a.key) - length(b.key)) * 5 <= greatest(length(a.key), length(b.key)) and levenshtein(a.key, b.key) * 5 <= greatest(length(a.key), length(b.key))),
        r as (select 0 as step, kind, key, key as label from k union all select step + 1, r.kind, x, min(label) from r join (select * from near union all select kind, key, key from k) n on n.kind = r.kind and n.y = r.key where step < 40 group by all),
        c as (select kind, key, label from r where step = 40)
        select c.kind, c.key, label as representative, count(*) over (partition by c.kind, label) as members, coalesce(n, 0)::bigint as n_links from c left join (select kind, x, count(*) as n from near group by all) d on d.kind = c.kind and d.x = c.key""",
    "match_alias": f"with p as (select * from entities where merged_into_id is null) select distinct least(p.id, o.id) as a, greatest(p.id, o.id) as b, 1.0::double as confidence from entity_aliases x join p on p.name = x.alias join p o on o.id = x.entity_id and o.kind = p.kind where p.id <> o.id",
    "comention_pairs": "with m as (select distinct entity_id, meeting_chunk_id from mentions) select x.entity_id as a, y.entity_id as b, count(*) as shared from m x join m y on x.meeting_chunk_id = y.meeting_chunk_id and x.entity_id < y.entity_id group by all having count(*) > 1",
    "match_cooccurrence": f"with {_MET} select * from met",
    "deferred_candidates": f"with {_MET} select a, b, confidence, 'cooccurrence' as strategy, reason from met where confidence < 0.8",
    "match_candidates": f"""with ee as (select id, name, canonical_name, kind from entities where merged_into_id is null), g as (select id, min(id) over (partition by name, kind) as first from ee),
        fi as (select *, {_NORMAL.format("name")} as key from ee where id in (select first from g)),
        fz as (select x.id as a, y.id as b, levenshtein(x.key, y.key) as d, greatest(length(x.key), length(y.key)) as n from fi x join fi y on x.kind = y.kind and x.id < y.id and x.name <> y.name
          where abs(length(x.key) - length(y.key)) * 5 <= greatest(length(x.key), length(y.key)) and levenshtein(x.key, y.key) * 5 <= greatest(length(x.key), length(y.key))),
        al as (select distinct least(n.id, o.id) as a, greatest(n.id, o.id) as b from entity_aliases x join g on g.id = x.entity_id join fi o on o.id = g.first join fi n on n.name = x.alias and n.kind = o.kind where n.id <> o.id),
        sv as (select canonical_name, kind from ee group by all having min(name) <> max(name)),
        mm as (select distinct e.id, e.canonical_name, e.kind, meeting_chunk_id as c from mentions x join ee e on e.id = x.entity_id join sv on sv.canonical_name = e.canonical_name and sv.kind = e.kind),
        mp as (select x.id as p, y.id as q, count(*) as n from mm x join mm y on x.c = y.c and x.canonical_name = y.canonical_name and x.kind = y.kind and x.id < y.id group by all having count(*) >= 3),
        co as (select least(gx.first, gy.first) as a, greatest(gx.first, gy.first) as b, max(n) as n from mp join g gx on gx.id = p join g gy on gy.id = q where gx.first <> gy.first group by all),
        un as (select first as a, id as b, 1.0::double as confidence, 'exact' as strategy, 'same name' as reason, 1 as o from g where id <> first
          union all select a, b, 1 - d / n, 'fuzzy', printf('similar name %.2f', 1 - d / n), 2 from fz union all select a, b, 1.0, 'alias', 'alias', 3 from al
          union all select a, b, least(1.0, n / 6)::double, 'cooccurrence', n || ' chunks in common', 4 from co)
        select a, b, confidence, strategy, reason from un qualify row_number() over (partition by a, b order by o) = 1""",
    "resolve_entities": _resolved(),
    "resolve_exact": "with f as (select id, min(id) over (partition by name, kind) as first from entities where merged_into_id is null) select id as duplicate_id, first as primary_id from f where id <> first",
    "entity_roots": "select c_custkey as id, c_custkey // 8 * 8 + case when c_custkey < 8 then 1 else 0 end as root from customer where c_custkey % 8 <> 0 and c_custkey > 1",
    "resolution_report": f"with {_PARTS}, f as (select id, min(id) over (partition by name) as first from p) select count(*) as entities_before, count(*) filter (id <> first) as merges, 0::bigint as deferred from f",
    "merge_relationships": f"with {_RELINKED} select {_EDGE} from rm",
    "merge_mentions": "select coalesce(primary_id, entity_id) as entity_id, count(*) as mention_count from mentions x left join merges m on m.duplicate_id = x.entity_id group by 1",
    "merge_aliases": f"with {_ALIASES} select entity_id, alias, source from al",
    "merge_entities": "select e.id, coalesce(m.primary_id, e.merged_into_id) as merged_into_id from entities e left join merges m on m.duplicate_id = e.id",
    "merge_history": f"""with a as (select entity_id, count(*) as n from entity_aliases group by entity_id),
        r as (select id, count(*) as n, sum(round(weight * 10))::bigint as tenths from (select source_entity_id as id, weight from relationships union all select target_entity_id, weight from relationships where source_entity_id <> target_entity_id) group by id)
        select 'merge:1:' || duplicate_id as id, duplicate_id, primary_id, 'merge' as action, 'exact: same name' as reason, e.name, e.mention_count, coalesce(a.n, 0) as n_aliases, coalesce(r.n, 0) as n_relationships, coalesce(tenths, 0) as tenths
        from merges m join entities e on e.id = m.duplicate_id left join a on a.entity_id = m.duplicate_id left join r on r.id = m.duplicate_id""",
    "undo_merges": f"""with {_UNDONE} select r.id, case when s.duplicate_id is null then coalesce(a.primary_id, source_entity_id) else source_entity_id end as source_entity_id,
          case when t.duplicate_id is null then coalesce(b.primary_id, target_entity_id) else target_entity_id end as target_entity_id, kind, weight, confidence,
          case when evidence_chunk_refs is not null then '[' || evidence_chunk_refs[1] || ']' end as refs from relationships r
          left join merges a on a.duplicate_id = r.source_entity_id left join merges b on b.duplicate_id = r.target_entity_id left join u s on s.duplicate_id = r.source_entity_id left join u t on t.duplicate_id = r.target_entity_id""",
    "undo_entities": f"with {_UNDONE} select e.id, case when u.duplicate_id is null then coalesce(m.primary_id, e.merged_into_id) end as merged_into_id from entities e left join merges m on m.duplicate_id = e.id left join u on u.duplicate_id = e.id",
    "undo_history": f"with {_UNDONE} {_TAKEN_BACK.format(action='undo')}",
    "split_merges": f"""with {_UNDONE}, {_ALIASES}, gone as (select distinct u.primary_id as entity_id, e.name as alias from u join entities e on e.id = u.duplicate_id)
        select al.entity_id, al.alias, al.source from al left join gone on gone.entity_id = al.entity_id and gone.alias = al.alias where al.source <> 'auto' or gone.entity_id is null""",
    "split_history": f"with {_UNDONE} {_TAKEN_BACK.format(action='split')}",
    "rejected_undos": f"""with {_UNDONE}, h as (select 'merge:1:' || duplicate_id as history_id, 'merge' as action from merges union all select 'split:2:merge:1:' || duplicate_id, 'split' from u),
        q as (select id, unnest(['merge:1:' || duplicate_id, 'split:2:merge:1:' || duplicate_id, 'merge:1:' || primary_id]) as history_id from merges)
        select id, q.history_id, case when h.action is null then 'unknown history' else 'not a merge' end as reason from q left join h on h.history_id = q.history_id where h.action is null or h.action <> 'merge'""",
    "rejected_requests": "select m.id, primary_id || 'x' as primary_id, duplicate_id, 'unknown primary' as reason from merges m where length(duplicate_id) % 2 = 0",
    "search_chunks": f"with {_hits(NEEDLE)} select type, id, snippet, context, score from hits where type = 'chunk' order by o, id limit 50",
    "search_meetings": f"with {_hits('CONVERSATION 1')} select type, id, snippet, context, score from hits where type = 'meeting' order by o, id limit 50",
    "search_entities": f"with {_hits('#00000001')} select type, id, snippet, context, score from hits where type = 'entity' order by o, id limit 50",
    "search_all": _searched(" on ", 50, 0),
    "search_page": _searched("an", 30, 60),
    "search_batch": f"""with q as (select distinct unnest([substr(x, 1, 4), substr(x, 2, 2), substr(x, 1, 1), substr(x, 1, 1) || 'he ']) as query from (select lower(n_name) as x from nation)), h as (select query, id, row_number() over (partition by query order by id) as rank from meeting_chunks join q on trim(query) <> '' and contains({_FOLD.format("text")}, trim(query))) select query, rank::int as rank, id from h where rank <= 5""",
    "token_index": r"select token, chunk_id, count(*) as tf from (select id as chunk_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as token from meeting_chunks) group by all",
    "audit_unique": """select 'meetings' as "table", source_id || '|' || source_adapter as key, count(*) as n from meetings group by all having count(*) > 1
        union all select 'meeting_chunks', meeting_id || '|' || chunk_index, count(*) from meeting_chunks group by all having count(*) > 1
        union all select 'entity_aliases', entity_id || '|' || alias, count(*) from entity_aliases group by all having count(*) > 1
        union all select 'entities', canonical_name || '|' || kind, count(*) from entities group by all having count(*) > 1""",
    "audit_orphans": """with k as (select id from entities where kind <> 'place' or id like 'nation%')
        select 'relationships' as "table", 'source_entity_id' as "column", id from relationships where source_entity_id not in (select id from k)
        union all select 'relationships', 'target_entity_id', id from relationships where target_entity_id not in (select id from k)
        union all select 'mentions', 'entity_id', id from mentions where entity_id not in (select id from k)
        union all select 'entities', 'merged_into_id', id from entities where merged_into_id is not null and merged_into_id not in (select id from k)""",
    "cascade_delete": """with g as (select id from entities where kind = 'project' and try_cast(substr(id, 9) as int) % 3 = 0)
        select 'entities' as "table", count(*) as n from entities where id not in (select id from g) union all select 'entity_aliases', count(*) from entity_aliases where entity_id not in (select id from g)
        union all select 'mentions', count(*) from mentions where entity_id not in (select id from g)
        union all select 'relationships', count(*) from relationships where source_entity_id not in (select id from g) and target_entity_id not in (select id from g)""",
    "cascade_delete_meetings": f"""with {_ANSWERS}, {_RELATED}, gm as (select id from meetings where source_id::bigint % 3 = 0),
        kw as (select distinct meeting_id, entity_id, lower(canonical_name) as key from ff join ids using (canonical_name, kind)), kf as (select meeting_id, key, min(entity_id) as entity_id from kw group by all),
        rs as (select rr.meeting_id from rr join kf s on s.meeting_id = rr.meeting_id and s.key = lower(a) join kf t on t.meeting_id = rr.meeting_id and t.key = lower(b) where rr.meeting_id not like '0%')
        select 'meetings' as "table", count(*) as n from meetings where id not in (select id from gm) union all select 'meeting_chunks', count(*) from meeting_chunks where meeting_id not in (select id from gm)
        union all select 'mentions', count(*) from mm where meeting_id not in (select id from gm) union all select 'relationships', count(*) from rs where meeting_id not in (select id from gm)
        union all select 'extraction_runs', (select count(*) from cc where meeting_id not in (select id from gm)) + (select count(distinct meeting_id) from rr where meeting_id not in (select id from gm))""",
    "audit_domains": """select 'jobs' as "table", 'kind' as "column", kind as value, count(*) as n from jobs where kind not in ('purchase', 'click') group by kind""",
    "entities_by_kind": "select kind, count(*) as n from entities where merged_into_id is null group by kind",
    "entity_card": """with a as (select entity_id as id, string_agg(distinct alias, ', ' order by alias) as aliases from entity_aliases group by entity_id),
        r as (select id, count(*) as n from (select source_entity_id as id from relationships union all select target_entity_id from relationships where source_entity_id <> target_entity_id) group by id),
        m as (select entity_id, id, row_number() over (partition by entity_id order by id) as k from mentions),
        s as (select entity_id as id, count(*) as n, string_agg(id, ',' order by id) filter (k <= 20) as first_mentions from m group by entity_id)
        select e.id, name, kind, aliases, coalesce(r.n, 0) as relationship_count, coalesce(s.n, 0) as mention_rows, first_mentions from entities e left join a on a.id = e.id left join r on r.id = e.id left join s on s.id = e.id""",
    "job_counts": "select count(*) filter (status in ('pending', 'running')) as active, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed, count(*) filter (status <> 'cancelled') as total from jobs",
    "jobs_retryable": "select id, kind, attempts, created_at from jobs where status = 'failed' and attempts < max_attempts",
    "jobs_next": "select kind, id, priority, created_at from (select *, row_number() over (partition by kind order by priority desc, created_at, id) as k from jobs where status = 'pending' and scheduled_at <= timestamp '2024-01-20') where k = 1",
    "jobs_cleanup": "select id, status, completed_at from jobs where not coalesce(status = 'completed' and completed_at < timestamp '2024-01-15', false)",
    "jobs_reset": "select id, case when status = 'failed' then 'pending' else status end as status, case when status = 'failed' then 0 else attempts end as attempts, case when status <> 'failed' then last_error end as last_error from jobs",
    "jobs_backoff": "select id, attempts, least(1.0 * pow(2.0, attempts - 1), 60.0) as delay from jobs where attempts < max_attempts",
    "log_tail": "select id, kind, status, created_at from jobs order by created_at desc, id desc limit 500",
}

ORACLES = {name: with_views(body) for name, body in _BODIES.items()}
