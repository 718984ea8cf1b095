"""The queries of the general problems 1, 3, 4 and 5, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftaudit.operators import copies, nested, orphans, snapshot_diff
from driftaudit.plans.tables import Tables


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return snapshot_diff.snapshot_changes(t.observed_points, t.snapshot_headers)


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_diff.change_counts(p1_found(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    children = [
        orphans.Child("chunks", t.chunks, {"source_version_id": "sources", "parse_run_id": "parse_runs"}),
        orphans.Child("index_bindings", t.index_bindings, {"embedding_id": "embedding_records"}),
    ]
    parents = [
        orphans.Parent("sources", t.sources, "version_id"),
        orphans.Parent("parse_runs", t.parse_runs, "id"),
        orphans.Parent("embedding_records", t.embedding_records, "id"),
    ]
    return orphans.orphans(children, parents)


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_counts(p3_found(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return copies.index_differences(t.index_bindings, t.observed_points, t.snapshot_headers)


def p4_copies(spark: SparkSession, folder: str) -> DataFrame:
    """The documents against a copy of theirs that lost every 997th and has another text, language or source here and there."""
    from pyspark.sql import functions as F

    d, n = Tables(spark, folder).documents, F.col("doc_id")
    copy = d.where(n % 997 != 5).withColumns({"text": F.when(n % 1009 == 7, F.concat("text", F.lit("."))).otherwise(F.col("text")), "lang": F.when(n % 1013 == 11, None).otherwise(F.col("lang")), "source": F.when(n % 1019 == 13, "moved").otherwise(F.col("source"))})
    values = {c: F.col(c) for c in ("text", "lang", "source", "media_type")}
    return copies.copy_differences(d, copy, {"doc_id": n}, values, ("missing_in_copy", "missing_in_documents"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.manifest_records(Tables(spark, folder).manifest_bodies)


def p5_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each flat table of the manifests, and the distinct rows that are their parents."""
    from pyspark.sql import functions as F

    bodies = Tables(spark, folder).manifest_bodies
    schema = nested.merged_schema(bodies, "body")
    levels = nested.explode_levels(bodies, ["manifest_no"], "body", schema)
    return levels.groupBy("level").agg(F.count("*").alias("n_rows"), F.count_distinct("parent_id").alias("n_parents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_counts, p3_found, p3_counts, p4_found, p4_copies, p5_found, p5_levels)
}

_WS = r"[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}|{_WS}$', '', 'g')"


def _id(x: str) -> str:
    return f"nullif(lower({_strip(x)}), '')"


def _hash(x: str) -> str:
    return f"nullif({_strip(f"regexp_replace(lower({_strip(x)}), '^.*:', '')")}, '')"


def _key(x: str) -> str:
    s = _strip(x)
    return f"""case when json_valid({s}) then case json_type({s})
      when 'VARCHAR' then to_json(json_extract_string({s}, '$'))::varchar
      when 'OBJECT' then '{{' || list_aggregate(list_transform(list_sort(json_keys({s})), lambda k: to_json(k)::varchar || ':' || json_extract({s}, '$."' || k || '"')::varchar), 'string_agg', ',') || '}}'
      else json({s})::varchar end when length({s}) > 0 then to_json({s})::varchar end"""


_POINTS = f"""valid as (select distinct {_id("target_id")} target_id, {_strip("scope")} scope, snapshot_no from snapshot_headers
  where lower({_strip("snapshot_kind")}) = 'full' and lower({_strip("consistency_completeness")}) = 'complete'),
raw as (select {_id("target_id")} target_id, {_strip("scope")} scope, snapshot_no, {_key("point_id")} point_key, {_hash("payload_hash")} payload_hash,
  {_id("source_id")} source_id, {_id("embedding_id")} embedding_id, observed_at, ord from observed_points),
points as (select * from raw semi join valid using (target_id, scope, snapshot_no) where point_key is not null
  qualify row_number() over (partition by target_id, scope, snapshot_no, point_key order by observed_at desc nulls last, ord desc nulls last) = 1)"""

_P1 = f"""with {_POINTS},
pairs as (select *, lag(snapshot_no) over (partition by target_id, scope order by snapshot_no) earlier from valid),
old as (select p.*, q.snapshot_no as later from points p join pairs q on p.target_id = q.target_id and p.scope = q.scope and p.snapshot_no = q.earlier),
new as (select p.* from points p semi join (select * from pairs where earlier is not null) using (target_id, scope, snapshot_no))
select coalesce(n.target_id, o.target_id) target_id, coalesce(n.scope, o.scope) scope, coalesce(n.snapshot_no, o.later) snapshot_no, coalesce(n.point_key, o.point_key) point_key,
  case when o.point_key is null then 'added' when n.point_key is null then 'removed' else 'changed' end change_kind
from new n full join old o on n.target_id = o.target_id and n.scope = o.scope and n.snapshot_no = o.later and n.point_key = o.point_key
where o.point_key is null or n.point_key is null or o.payload_hash is distinct from n.payload_hash or o.source_id is distinct from n.source_id"""

_P3 = f"""with k as (
  select 'chunks' child_table, {_id("id")} child_id, 'source_version_id' ref_column, {_id("source_version_id")} ref, recorded_at from chunks union all
  select 'chunks', {_id("id")}, 'parse_run_id', {_id("parse_run_id")}, recorded_at from chunks union all
  select 'index_bindings', {_id("id")}, 'embedding_id', {_id("embedding_id")}, recorded_at from index_bindings),
p as (select 'source_version_id' ref_column, {_id("version_id")} ref, recorded_at, deleted_at from sources union all
  select 'parse_run_id', {_id("id")}, recorded_at, deleted_at from parse_runs union all
  select 'embedding_id', {_id("id")}, recorded_at, deleted_at from embedding_records),
t as (select child_table, child_id, min(recorded_at) t from k where child_id is not null group by all having min(recorded_at) is not null),
r as (select distinct child_table, child_id, ref_column, ref, t from k join t using (child_table, child_id) where ref is not null)
select r.child_table, r.child_id, r.ref_column, case when not bool_or(p.ref is not null) then 'missing' when bool_or(p.recorded_at > r.t) then 'late' else 'deleted' end reason,
  strftime(r.t at time zone 'UTC', '%Y-%m') period
from r left join p on p.ref_column = r.ref_column and p.ref = r.ref group by r.child_table, r.child_id, r.ref_column, r.ref, r.t
having not coalesce(bool_or(p.recorded_at <= r.t and (p.deleted_at is null or p.deleted_at > r.t)), false)"""

_P4 = f"""with {_POINTS},
newest as (select target_id, scope, max(snapshot_no) snapshot_no from valid group by all),
seen as (select * from points semi join newest using (target_id, scope, snapshot_no)),
b as (select {_id("target")} target_id, {_strip("namespace")} scope, {_key("point_id")} point_key, {_id("embedding_id")} embedding_id, {_hash("expected_payload_hash")} payload_hash, recorded_at, id from index_bindings),
want as (select * from b where point_key is not null qualify row_number() over (partition by target_id, scope, point_key order by recorded_at desc nulls last, id) = 1),
j as (select coalesce(w.target_id, s.target_id) target_id, coalesce(w.scope, s.scope) scope, coalesce(w.point_key, s.point_key) point_key,
  case when s.point_key is null then ['missing_in_index'] when w.point_key is null then ['missing_in_manifest']
  else list_filter([case when w.embedding_id is distinct from s.embedding_id then 'embedding_id' end, case when w.payload_hash is distinct from s.payload_hash then 'payload_hash' end], lambda x: x is not null) end d
  from want w full join seen s on w.target_id = s.target_id and w.scope = s.scope and w.point_key = s.point_key)
select target_id, scope, point_key, unnest(d) difference from j"""

# every value of every body by DuckDB's own walk over JSON; nearest enclosing build and parse run by climbing to the parents
_NODES = f"""with recursive u as (select manifest_no, {_strip("body")} b from manifest_bodies union all select manifest_no, {_strip("json_extract_string(b, '$')")} from u where json_valid(b) and json_type(b) = 'VARCHAR'),
n as materialized (select u.manifest_no, t.id, t.parent, t.key, t.type, t.value, p.type up, p.key up_key from (select * from u where json_valid(b) and json_type(b) <> 'VARCHAR') u, json_tree(u.b) t left join (select q.manifest_no m, w.id, w.type, w.key from u q, json_tree(q.b) w where json_valid(q.b) and json_type(q.b) <> 'VARCHAR') p on p.m = u.manifest_no and p.id = t.parent)"""
_P5 = f"""{_NODES},
o as materialized (select *, case when json_type(value, '$.id') = 'VARCHAR' then value->>'$.id' end own, case when json_type(value, '$.build.build_id') = 'VARCHAR' then value->>'$.build.build_id' end build from n where type = 'OBJECT'),
hit as materialized (select * from o where json_type(value, '$.artifact_id') = 'VARCHAR' or own like 'chk\\_%' escape '\\' and coalesce(json_type(value, '$.locator'), 'NULL') <> 'NULL'),
climb as (select manifest_no, id hit, id, 0 steps from hit union all select c.manifest_no, c.hit, n.parent, steps + 1 from climb c join n on n.manifest_no = c.manifest_no and n.id = c.id where n.parent is not null),
around as (select c.manifest_no, c.hit, arg_min(build, steps) filter (build is not null) build, arg_min(own, steps) filter (own is not null and (own like 'prs\\_%' escape '\\' or o.key = 'parse_runs' or o.up = 'ARRAY' and o.up_key = 'parse_runs')) run from climb c join o on o.manifest_no = c.manifest_no and o.id = c.id group by all),
h as (select hit.*, a.build around_build, a.run around_run, case when up = 'ARRAY' then key::int else 0 end pos, own like 'chk\\_%' escape '\\' and coalesce(json_type(value, '$.locator'), 'NULL') <> 'NULL' is_chunk from hit join around a on a.manifest_no = hit.manifest_no and a.hit = hit.id),
c as (select manifest_no, own, pos, case when json_type(value, '$.parse_run_id') = 'VARCHAR' then value->>'$.parse_run_id' else around_run end run, case when json_type(value, '$.locator') = 'VARCHAR' then case when json_valid(value->>'$.locator') then (value->>'$.locator')::json end else value->'$.locator' end loc, value->'$.tokenizer' tok from h where is_chunk),
g as (select manifest_no, own, json_type(loc, '$.heading_path') kind, loc->'$.heading_path' path from c)
select distinct * from (select manifest_no, 'artifact' record_kind, value->>'$.artifact_id' record_id, around_build parent_id, pos ordinal_pos from h where json_type(value, '$.artifact_id') = 'VARCHAR' union all select manifest_no, 'chunk', own, run, pos from c union all
select manifest_no, 'heading', path->>('$[' || i || ']'), own, i::int from (select *, unnest(range(json_array_length(path)::bigint)) i from g where kind = 'ARRAY') union all select manifest_no, 'heading', json_extract_string(path, '$'), own, 0 from g where kind = 'VARCHAR' union all
select manifest_no, 'tokenizer', nullif(trim(case when json_type(tok) = 'VARCHAR' then split_part(json_extract_string(tok, '$'), '@', 1) when json_type(tok, '$.name') = 'VARCHAR' then tok->>'$.name' end), ''), own, 0 from c) where record_id is not null"""

_P5_LEVELS = f"""{_NODES},
d as (select manifest_no, id, type, up, []::varchar[] path from n where parent is null union all select n.manifest_no, n.id, n.type, n.up, list_append(d.path, case when n.up = 'ARRAY' then '[]' else n.key end) from d join n on n.manifest_no = d.manifest_no and n.parent = d.id),
r as materialized (select *, type = 'OBJECT' and (up = 'ARRAY' or len(path) = 0 or path in (select path from d where type = 'ARRAY')) emitted from d),
f as (select manifest_no, id, -1::bigint above from n where parent is null union all select n.manifest_no, n.id, case when r.emitted then f.id else f.above end from f join r on r.manifest_no = f.manifest_no and r.id = f.id join n on n.manifest_no = f.manifest_no and n.parent = f.id)
select '[' || coalesce(array_to_string(list_transform(path, lambda x: to_json(x)::varchar), ', '), '') || ']' as level, count(*) n_rows, count(distinct (r.manifest_no, above)) n_parents from r join f on f.manifest_no = r.manifest_no and f.id = r.id where emitted group by path"""

ORACLES: dict[str, str] = {
    "p5_found": _P5,
    "p5_levels": _P5_LEVELS,
    "p1_found": _P1,
    "p1_counts": f"select target_id, scope, snapshot_no, change_kind, count(*) n_points from ({_P1}) group by all",
    "p3_found": f"select distinct * from ({_P3})",
    "p3_counts": f"select child_table, ref_column, reason, period, count(*) n_children from (select distinct * from ({_P3})) group by all",
    "p4_found": _P4,
    "p4_copies": """select doc_id, unnest(list_filter([case when doc_id % 997 = 5 then 'missing_in_copy' end, case when doc_id % 997 <> 5 and doc_id % 1009 = 7 and text is not null then 'text' end,
      case when doc_id % 997 <> 5 and doc_id % 1013 = 11 and lang is not null then 'lang' end, case when doc_id % 997 <> 5 and doc_id % 1019 = 13 and source is distinct from 'moved' then 'source' end], lambda x: x is not null)) difference from documents""",
}
