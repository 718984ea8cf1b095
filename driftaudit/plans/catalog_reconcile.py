"""Queries of the reconciliation: identities, matching, findings, ratios, policy, remediation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftaudit.operators import findings, matching
from driftaudit.operators import policy as pol
from driftaudit.plans.tables import Tables
from driftaudit.plans.fixture import FIXTURE_SQL, IDS_SQL, SCOPE, TARGET, Fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a Fixture under its name, with its SQL."""

    def register(f: Callable[[Fixture], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Fixture(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _with(sql: str) -> str:
    return f"with {FIXTURE_SQL} {sql}"


@query(_with("select severity, code, count(*) n from findings group by all"))
def q_reconcile_severity_counts(x: Fixture) -> DataFrame:
    return x.findings.groupBy("severity", "code").agg(F.count("*").alias("n"))


@query(f"with {IDS_SQL} select doc_id, namespace, uri, source_id from base")
def q_source_ids(x: Fixture) -> DataFrame:
    return x.base.select("doc_id", "namespace", "uri", "source_id")


@query(f"with {IDS_SQL} select doc_id, source_id, content_hash, version_id from base")
def q_source_versions(x: Fixture) -> DataFrame:
    return x.base.select("doc_id", "source_id", "content_hash", "version_id")


@query(f"with {IDS_SQL} select doc_id, chunk_id, embedding_id, binding_id, payload_hash from base")
def q_binding_ids(x: Fixture) -> DataFrame:
    return x.base.select("doc_id", "chunk_id", "embedding_id", "binding_id", "payload_hash")


@query(f"""with {IDS_SQL} select doc_id, version_id, first_value(version_id) over (partition by content_hash order by uri) duplicate_of from base
qualify row_number() over (partition by content_hash order by uri) > 1""")
def q_duplicate_sources(x: Fixture) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("content_hash").orderBy("uri")
    d = x.base.select("doc_id", "version_id", F.first("version_id").over(w).alias("duplicate_of"), F.row_number().over(w).alias("rn"))
    return d.where("rn > 1").drop("rn")


@query(f"with {IDS_SQL} select source_id, version_id, 'tombstone' status from base where doc_id % 10 = 0")
def q_tombstones(x: Fixture) -> DataFrame:
    from driftaudit.operators.discovery import tombstones

    present = x.sources.where("ord % 10 <> 0")  # the present scan of this fixture lacks every tenth source
    return tombstones(x.sources, present).select(F.col("id").alias("source_id"), "version_id", "status")


@query(_with("select binding_id, point_key, embedding_id, chunk_id, source_version_id, source_id, dimension, payload_hash, tenant from expected"))
def q_expected_points(x: Fixture) -> DataFrame:
    return x.expected.select("binding_id", "point_key", "embedding_id", "chunk_id", "source_version_id", "source_id", "dimension", "payload_hash", "tenant")


@query(_with("select eo e_ord, oo o_ord from m1"))
def q_match_level1(x: Fixture) -> DataFrame:
    return x.matched.where("match_level = 1").select("e_ord", "o_ord")


@query(_with("select match_level, eo e_ord, oo o_ord from pairs union all select null, ord, null from el3 union all select null, null, ord from ol3"))
def q_match_cascade(x: Fixture) -> DataFrame:
    return x.matched.select("match_level", "e_ord", "o_ord")


@query(_with("select binding_id, point_key from el3"))
def q_missing(x: Fixture) -> DataFrame:
    return x.matched.where("match_level is null and e_ord is not null").select(F.col("e_binding_id").alias("binding_id"), F.col("e_point_key").alias("point_key"))


@query(_with("select f.point_key, f.code from findings f join ol3 o on f.subject_id = o.point_key where f.match_level is null and f.code not in ('MISSING_IN_INDEX')"))
def q_orphan_classes(x: Fixture) -> DataFrame:
    rows = findings.with_current_version(x.matched.where("match_level is null and o_ord is not null"), x.sources, "o_source_id")
    return rows.select(F.col("o_point_key").alias("point_key"), findings.orphan_code().alias("code"))


@query(_with("select lv as level, k as key, n, pks[1] point_key from dup"))
def q_duplicate_groups(x: Fixture) -> DataFrame:
    return x.duplicates


@query(_with("""select 1 as level, o.point_key as key, o.ord, o.point_key from observed o join dup on lv = 1 and k = o.point_key union all
select 2, o.embedding_id, o.ord, o.point_key from ol1 o join dup on lv = 2 and k = o.embedding_id union all select 3, o.chunk_id, o.ord, o.point_key from ol2 o join dup on lv = 3 and k = o.chunk_id"""))
def q_duplicate_members(x: Fixture) -> DataFrame:
    """The points of the duplicate keys, a row each."""
    return matching.duplicate_members(x.expected, x.observed, x.rounds)


@query(_with("""select binding_id, point_key, level from (select e.binding_id, o.point_key, 'source_version_id' as level from
(select *, row_number() over (partition by source_version_id order by ord) q from el3 where source_version_id is not null) e join (select *, row_number() over (partition by source_version_id order by ord) q from ol3 where source_version_id is not null) o on e.source_version_id=o.source_version_id and e.q=o.q
union all select e.binding_id, o.point_key, 'payload_hash' from
(select *, row_number() over (partition by payload_hash order by ord) q from el3 where payload_hash is not null) e join (select *, row_number() over (partition by payload_hash order by ord) q from ol3 where payload_hash is not null) o on e.payload_hash=o.payload_hash and e.q=o.q)"""))
def q_relocation_suggestions(x: Fixture) -> DataFrame:
    m = x.matched.where("match_level is null")
    return matching.suggestions(matching._side(m.where("e_ord is not null"), "e_"), matching._side(m.where("o_ord is not null"), "o_"))


def _codes(name: str, *codes: str) -> None:
    listed = ", ".join(f"'{c}'" for c in codes)

    def run(x: Fixture) -> DataFrame:
        return x.findings.where(F.col("match_level").isNotNull() & F.col("code").isin(*codes)).select("code", "subject_id", "point_key", "match_level")

    run.__name__ = name
    query(_with(f"select code, subject_id, point_key, match_level from findings where match_level is not null and code in ({listed})"))(run)


_codes("q_stale", "STALE_SOURCE", "STALE_CHUNKING")
_codes("q_acl_findings", "ACL_MISSING", "ACL_BROADER_THAN_SOURCE", "ACL_MISMATCH")
_codes("q_tenant_findings", "TENANT_MISSING", "TENANT_MISMATCH")
_codes("q_payload_drift", "PAYLOAD_DRIFT")
_codes("q_dimension", "EMBEDDING_DIMENSION_MISMATCH")
_codes("q_vector_hash", "VECTOR_HASH_MISMATCH")


@query(_with("select fingerprint, code, severity, field, subject_id, match_level from findings"))
def q_findings_fingerprints(x: Fixture) -> DataFrame:
    return x.findings.select("fingerprint", "code", "severity", "field", "subject_id", "match_level")


_MASK = "array_to_string(list_sort(list_transform({0}, lambda a: case when a = 'PUBLIC' then a else split_part(a, ':', 1) || ':masked:' || substr(sha256(substr(a, strpos(a, ':') + 1)), 1, 16) end)), '|')"


@query(_with(f"""select binding_id subject_id, point_key, 'high' confidence, unnest(list_filter([case when stale then {{'code': 'STALE_SOURCE', 'e': cur, 'o': ov}} end, case when chunking then {{'code': 'STALE_CHUNKING', 'e': ec, 'o': oc}} end,
case when ed <> od then {{'code': 'EMBEDDING_DIMENSION_MISMATCH', 'e': ed::varchar, 'o': od::varchar}} end, case when ev <> ovh then {{'code': 'VECTOR_HASH_MISMATCH', 'e': ev, 'o': ovh}} end, case when tm then {{'code': 'TENANT_MISSING', 'e': et, 'o': ot}} end, case when tx then {{'code': 'TENANT_MISMATCH', 'e': et, 'o': ot}} end,
case when am then {{'code': 'ACL_MISSING', 'e': {_MASK.format('ea')}, 'o': {_MASK.format('oa')}}} end, case when ab then {{'code': 'ACL_BROADER_THAN_SOURCE', 'e': {_MASK.format('ea')}, 'o': {_MASK.format('oa')}}} end], lambda x: x is not null), recursive := true) from rl""").replace("select binding_id subject_id", "select subject_id, point_key, confidence, code, e as expected, o as observed from (select binding_id subject_id") + ")")
def q_findings_evidence(x: Fixture) -> DataFrame:
    """What was expected and what was seen, for the findings on pairs; access entries are masked."""
    codes = ["STALE_SOURCE", "STALE_CHUNKING", "EMBEDDING_DIMENSION_MISMATCH", "VECTOR_HASH_MISMATCH", "TENANT_MISSING", "TENANT_MISMATCH", "ACL_MISSING", "ACL_BROADER_THAN_SOURCE"]
    return x.findings.where(F.col("code").isin(*codes) & F.col("match_level").isNotNull()).select("subject_id", "point_key", "confidence", "code", "expected", "observed")


_RATIOS = """r as (select (select count(*) from expected) expected, (select count(*) from observed) observed, (select count(*) from pairs) matched, (select count(*) from el3) missing, (select count(*) from ol3) orphans,
  (select count(distinct subject_id) from findings where match_level is not null and code in ('STALE_SOURCE','STALE_CHUNKING')) stale, (select count(*) from findings where code='UNVERIFIABLE_POINT') unv,
  (select count(*) from rl where len(ea)>0) areq, (select count(distinct subject_id) from findings f join rl on rl.binding_id=f.subject_id and len(rl.ea)>0 where f.match_level is not null and code in ('ACL_MISSING','ACL_BROADER_THAN_SOURCE','ACL_MISMATCH')) abad),
ratios as (select expected, observed, matched, missing, orphans, stale, (observed-unv)/nullif(observed,0) lineage_coverage, missing/nullif(expected,0) missing_ratio, orphans/nullif(observed,0) orphan_ratio, stale/nullif(matched,0) stale_ratio, (areq-abad)/nullif(areq,0) acl_compliance from r)"""


@query(_with(f", {_RATIOS} select expected, observed, matched, missing, orphans, stale, round(lineage_coverage,9) lineage_coverage, round(missing_ratio,9) missing_ratio, round(orphan_ratio,9) orphan_ratio, round(stale_ratio,9) stale_ratio, round(acl_compliance,9) acl_compliance from ratios"))
def q_ratios(x: Fixture) -> DataFrame:
    r = findings.ratios(x.matched, x.findings)
    return r.select("expected", "observed", "matched", "missing", "orphans", "stale", *(F.round(c, 9).alias(c) for c in ("lineage_coverage", "missing_ratio", "orphan_ratio", "stale_ratio", "acl_compliance")))


POLICY = {
    "version": 1, "name": "catalogue", "requirements": {"manifest_signature": "required", "full_snapshot": "required", "lineage_coverage_min": 0.5}, "findings": {"fail_on_severity": ["critical"], "warn_on_severity": ["medium", "low"]},
    "licenses": {"unknown": "warn"}, "access": {"acl_required": True, "acl_compliance_min": 0.99}, "drift": {"stale_ratio_max": 0.05, "orphan_ratio_max": 0.5, "missing_ratio_max": 0.2},
    "rules": [
        {"category": "count", "taxonomy_codes": ["PAYLOAD_DRIFT"], "comparator": "gt", "threshold": 100000, "verdict_on_violation": "WARN"}, {"category": "acl", "taxonomy_codes": ["DUPLICATE_POINT_ID"], "comparator": "gte", "threshold": 1, "verdict_on_violation": "FAIL"},
        {"category": "severity", "threshold": 2, "verdict_on_violation": "WARN"}, {"category": "severity", "taxonomy_codes": ["TENANT_MISMATCH", "TENANT_MISSING"], "comparator": "lt", "threshold": 1000000, "verdict_on_violation": "WARN"}, {"category": "count", "verdict_on_violation": "WARN"},
    ],
}
FACTS = pol.Facts(manifest_signed=True, snapshot_kind="full", completeness="incomplete")
#: Rules as the document states them; a threshold on severity without codes is a rank and a count at once.
_RULES = """n as (select count(*) filter (severity='critical') crit, count(*) filter (severity in ('medium','low')) warn, count(*) filter (code='LICENSE_UNKNOWN') unk, count(*) filter (code='PAYLOAD_DRIFT') drift, count(*) filter (code='DUPLICATE_POINT_ID') dup,
  count(*) filter (severity in ('high','critical')) ranked, count(*) filter (code in ('TENANT_MISMATCH','TENANT_MISSING')) tenants, count(*) al from findings),
rules as (select 'requirements.manifest_signature' as "rule", 'PASS' verdict union all select 'requirements.full_snapshot', 'FAIL' union all
select 'requirements.lineage_coverage_min', case when lineage_coverage is null then 'INCONCLUSIVE' when lineage_coverage<0.5 then 'FAIL' else 'PASS' end from ratios union all
select 'findings.fail_on_severity', case when crit>0 then 'FAIL' else 'PASS' end from n union all select 'findings.warn_on_severity', case when warn>0 then 'WARN' else 'PASS' end from n union all select 'licenses.unknown', case when unk>0 then 'WARN' else 'PASS' end from n union all
select 'access.acl_compliance_min', case when acl_compliance is null then 'INCONCLUSIVE' when acl_compliance<0.99 then 'FAIL' else 'PASS' end from ratios union all
select 'drift.stale_ratio_max', case when stale_ratio>0.05 then 'FAIL' when stale_ratio is not null then 'PASS' end from ratios union all select 'drift.orphan_ratio_max', case when orphan_ratio>0.5 then 'FAIL' when orphan_ratio is not null then 'PASS' end from ratios union all
select 'drift.missing_ratio_max', case when missing_ratio>0.2 then 'FAIL' when missing_ratio is not null then 'PASS' end from ratios union all
select 'rules[0].count', case when drift>100000 then 'WARN' else 'PASS' end from n union all select 'rules[1].acl', case when dup>=1 then 'FAIL' else 'PASS' end from n union all select 'rules[2].severity', case when ranked>=2 then 'WARN' else 'PASS' end from n union all
select 'rules[3].severity', case when tenants<1000000 then 'WARN' else 'PASS' end from n union all select 'rules[4].count', case when al>=0 then 'WARN' else 'PASS' end from n)"""


@query(_with(f', {_RATIOS}, {_RULES} select "rule", verdict, verdict = \'PASS\' passed from rules where verdict is not null'))
def q_policy_rules(x: Fixture) -> DataFrame:
    return pol.evaluate(pol.Policy.load(POLICY), findings.ratios(x.matched, x.findings), x.findings, FACTS).select("rule", "verdict", "passed")


@query(_with(f", {_RATIOS}, {_RULES} select coalesce(min_by(verdict, case verdict when 'FAIL' then 0 when 'INCONCLUSIVE' then 1 when 'WARN' then 2 else 3 end),'PASS') verdict from rules where verdict is not null"))
def q_policy_verdict(x: Fixture) -> DataFrame:
    return pol.verdict(q_policy_rules(x))


# written from the specification of the plan: which codes are mended by what, not from the operator
_ACTION = """case when code in ('MISSING_IN_INDEX','STALE_SOURCE','STALE_PARSE','STALE_CHUNKING','EMBEDDING_MODEL_MISMATCH') then 'reindex_source' when code in ('ORPHAN_IN_INDEX','DUPLICATE_POINT_ID','DUPLICATE_CONTENT') then 'delete_point_candidate'
when code in ('PAYLOAD_DRIFT','ACL_MISMATCH','TENANT_MISMATCH','ACL_MISSING','TENANT_MISSING','ACL_BROADER_THAN_SOURCE') then 'update_payload_candidate' when code in ('EMBEDDING_DIMENSION_MISMATCH','TARGET_SCHEMA_DRIFT','MANIFEST_INCOMPLETE') then 'full_rebuild_required' else 'review_required' end"""


@query(_with(f"""select {_ACTION} as "action", code, 'primary' target, 'documents' scope, {_ACTION} in ('delete_point_candidate','full_rebuild_required') destructive, count(*) n_findings, count(distinct subject_id) n_candidates from findings group by code"""))
def q_remediation_plan(x: Fixture) -> DataFrame:
    return findings.remediation_plan(x.findings, TARGET, SCOPE).drop("caution", "rationale")


@query(_with(f"""select distinct code, {_ACTION} as "action", subject_id candidate from findings"""))
def q_remediation_candidates(x: Fixture) -> DataFrame:
    return findings.remediation_candidates(x.findings)


@query(_with("select severity, code, count(*) n from findings where code not in ('EMBEDDING_DIMENSION_MISMATCH') group by all union all select 'critical', 'EMBEDDING_DIMENSION_MISMATCH', count(*) from findings where code = 'EMBEDDING_DIMENSION_MISMATCH' union all select 'high', 'MANIFEST_INCOMPLETE', 1 union all select 'high', 'SNAPSHOT_INCOMPLETE', 1"))
def q_reconcile_incomplete(x: Fixture) -> DataFrame:
    """The whole run of an incomplete build against an incomplete scan: the findings on points, and one on each of the two."""
    from driftaudit.operators.reconcile import Consistency, reconcile

    run = reconcile(x.expected, x.observed, x.sources, TARGET, SCOPE, "bld_1", "incomplete", Consistency.probed("best_effort_live", 10, 11), {4, 8})
    return run.findings.groupBy("severity", "code").agg(F.count("*").alias("n"))


@query("select 'critical' severity, 'EMBEDDING_DIMENSION_MISMATCH' code, 'primary:documents' subject_id, 'dimension' field, 0::bigint expected, 0::bigint observed, null::double missing_ratio")
def q_preflight(x: Fixture) -> DataFrame:
    """A target whose vectors have dimensions that no expected point has: one finding, and nothing is read."""
    from driftaudit.operators.reconcile import reconcile

    run = reconcile(x.expected, x.observed, x.sources, TARGET, SCOPE, target_dimensions={1024})
    return run.findings.drop("expected", "observed").crossJoin(run.ratios).select("severity", "code", "subject_id", "field", "expected", "observed", "missing_ratio")  # one row each


@query(_with("select fingerprint, code, severity, subject_id from findings where severity = 'critical' order by fingerprint, subject_id limit 100 offset 50"))
def q_findings_page(x: Fixture) -> DataFrame:
    return x.findings.where("severity = 'critical'").orderBy("fingerprint", "subject_id").offset(50).limit(100).select("fingerprint", "code", "severity", "subject_id")


@query(_with("""select f.code, f.subject_id, e.source_id, e.chunk_id from findings f join expected e on e.binding_id = f.subject_id
join (select source_id s, chunk_id c from expected where binding_id = (select max(subject_id) from findings where code = 'MISSING_IN_INDEX')) t on e.source_id = t.s or e.chunk_id = t.c"""))
def q_lineage_drilldown(x: Fixture) -> DataFrame:
    """All findings on the source or the chunk of the missing binding with the largest id."""
    e = x.expected.select(F.col("binding_id").alias("subject_id"), "source_id", "chunk_id")
    top = x.findings.where("code = 'MISSING_IN_INDEX'").agg(F.max("subject_id").alias("subject_id"))  # one row
    one = e.join(F.broadcast(top), "subject_id").select(F.col("source_id").alias("s"), F.col("chunk_id").alias("c"))
    # two joins by equality instead of one with `or`; what both find counts once
    by_source = e.join(F.broadcast(one.select("s")), F.col("source_id") == F.col("s")).drop("s")
    by_chunk = e.join(F.broadcast(one.select("c", F.col("s").alias("not_s"))), (F.col("chunk_id") == F.col("c")) & ~F.col("source_id").eqNullSafe(F.col("not_s"))).drop("c", "not_s")
    return x.findings.join(by_source.unionByName(by_chunk), "subject_id").select("code", "subject_id", "source_id", "chunk_id")


@query(_with("""select fingerprint, code, severity, field, subject_id, point_key, match_level from findings qualify row_number() over (partition by fingerprint order by coalesce(match_level, 99) desc, coalesce(point_key, '') desc, coalesce(subject_id, '') desc) = 1"""))
def q_findings_sink(x: Fixture) -> DataFrame:
    """Findings as the table sink keeps them: one per fingerprint, the last."""
    return findings.sink_rows(x.findings).select("fingerprint", "code", "severity", "field", "subject_id", "point_key", "match_level")


def _bulk(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All orders as points of one source, on both sides; nations are expected only, suppliers observed only, without identity."""
    c, lit = F.col, F.lit
    null = lambda kind="string": lit(None).cast(kind)
    i = c("o_orderkey")
    ids = t.orders.select(i.alias("i")).unionByName(t.nation.select((-1 - c("n_nationkey")).cast("bigint").alias("i")))
    named = {n: F.concat(lit(f"{p}_"), F.sha2(F.concat(lit(p), c("i").cast("string")), 256)) for n, p in (("embedding_id", "emb"), ("chunk_id", "chk"), ("payload_hash", "pay"))}
    key = F.concat(lit('"point-'), c("i").cast("string"), lit('"')).alias("point_key")
    whole = ids.select(key, *(x.alias(n) for n, x in named.items()), c("i").alias("ord"))
    expected = whole.select(F.concat(lit("idx_"), c("ord").cast("string")).alias("binding_id"), "*", lit("ver_1").alias("source_version_id"), lit("src_1").alias("source_id"), lit(4).alias("dimension"), null().alias("vector_hash"), lit("tenant-a").alias("tenant"), F.array(lit("GROUP:finance")).alias("acl"))
    seen = whole.where("ord >= 0").select("*", F.when(c("ord") % 1000 == 0, "ver_0").otherwise("ver_1").alias("source_version_id"), lit("src_1").alias("source_id"), lit("tenant-a").alias("tenant"), F.array(F.when(c("ord") % 500 == 0, "PUBLIC").otherwise("GROUP:finance")).alias("acl"))
    orphans = t.supplier.select(F.concat(lit('"orphan-'), "s_suppkey", lit('"')).alias("point_key"), *(null().alias(n) for n in named), (-1000 - c("s_suppkey")).cast("bigint").alias("ord"), null().alias("source_version_id"), null().alias("source_id"), null().alias("tenant"), null("array<string>").alias("acl"))
    observed = seen.unionByName(orphans).select("*", F.create_map(lit("default"), lit(4)).alias("dimensions"), null("map<string,string>").alias("vector_hashes"))
    sources = t.region.limit(1).select(lit("src_1").alias("id"), lit("ver_1").alias("version_id"), lit(1).alias("ord"))
    return expected, observed, sources


def _bulk_query(spark: SparkSession, folder: str) -> DataFrame:
    from driftaudit.operators.reconcile import reconcile

    run = reconcile(*_bulk(Tables(spark, folder)), "bulk", "orders")
    counts = run.findings.groupBy("code").agg(F.count("*").alias("n"))
    whole = run.ratios.select(F.expr("stack(5, 'expected', expected, 'observed', observed, 'matched', matched, 'missing', missing, 'orphans', orphans) as (code, n)"))
    return counts.unionByName(whole)


QUERIES["q_reconcile_bulk"] = _bulk_query
ORACLES["q_reconcile_bulk"] = """with n as (select (select count(*) from orders) o, (select count(*) from nation) m, (select count(*) from supplier) s)
select 'STALE_SOURCE' code, count(*) n from orders where o_orderkey % 1000 = 0 having count(*) > 0 union all select 'ACL_BROADER_THAN_SOURCE', count(*) from orders where o_orderkey % 500 = 0 having count(*) > 0
union all select 'MISSING_IN_INDEX', m from n union all select 'UNVERIFIABLE_POINT', s from n union all select 'expected', o + m from n union all select 'observed', o + s from n union all select 'matched', o from n union all select 'missing', m from n union all select 'orphans', s from n"""
