"""From matched and leftover points to findings, ratios, a verdict and a remediation plan."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftaudit.functions.checks import acl_masked
from driftaudit.functions.ids import content_id, json_string
from driftaudit.operators.matching import confidence

#: All finding codes with their default severity.
SEVERITIES = {
    "STALE_SOURCE": "high", "STALE_PARSE": "medium", "STALE_CHUNKING": "high", "MISSING_IN_INDEX": "high", "ORPHAN_IN_INDEX": "high", "DUPLICATE_POINT_ID": "critical", "DUPLICATE_CONTENT": "medium",
    "PAYLOAD_DRIFT": "medium", "SOURCE_METADATA_MISSING": "medium", "EMBEDDING_DIMENSION_MISMATCH": "critical", "EMBEDDING_MODEL_MISMATCH": "high", "VECTOR_HASH_MISMATCH": "high", "TENANT_MISSING": "critical",
    "TENANT_MISMATCH": "critical", "ACL_MISSING": "critical", "ACL_BROADER_THAN_SOURCE": "critical", "ACL_MISMATCH": "high", "PII_POLICY_VIOLATION": "high", "LICENSE_POLICY_VIOLATION": "high", "LICENSE_UNKNOWN": "medium",
    "MANIFEST_INCOMPLETE": "high", "SNAPSHOT_INCOMPLETE": "high", "TARGET_SCHEMA_DRIFT": "high", "UNVERIFIABLE_POINT": "medium",
}
#: Codes whose default only a stated reason may lower.
CRITICAL = tuple(c for c, s in SEVERITIES.items() if s == "critical")
#: The action that a plan names for a code, and whether it destroys something; any other code asks for a review.
ACTIONS = {
    "reindex_source": (False, ["MISSING_IN_INDEX", "STALE_SOURCE", "STALE_PARSE", "STALE_CHUNKING", "EMBEDDING_MODEL_MISMATCH"]),
    "delete_point_candidate": (True, ["ORPHAN_IN_INDEX", "DUPLICATE_POINT_ID", "DUPLICATE_CONTENT"]),
    "update_payload_candidate": (False, ["PAYLOAD_DRIFT", "ACL_MISMATCH", "ACL_MISSING", "ACL_BROADER_THAN_SOURCE", "TENANT_MISMATCH", "TENANT_MISSING"]),
    "full_rebuild_required": (True, ["EMBEDDING_DIMENSION_MISMATCH", "TARGET_SCHEMA_DRIFT", "MANIFEST_INCOMPLETE"]),
}
REVIEW = "review_required"
CAUTIONS = {
    "delete_point_candidate": "What is deleted from a live target is gone: look at every candidate first. Nothing here deletes.",
    "full_rebuild_required": "No change of single points can mend this: the target has to be filled anew from a manifest that fits.",
}


def severity_of(code: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(code == kv[0], kv[1]), list(SEVERITIES.items())[1:], F.when(code == "STALE_SOURCE", "high"))


def override(code: str, severity: str, reason: str | None = None) -> str:
    """A severity other than a code's default; that of a critical code is lowered only for a reason."""
    if severity not in ("low", "medium", "high", "critical"):
        raise ValueError(f"no severity: {severity}")
    if code in CRITICAL and severity != "critical" and not reason:
        raise ValueError(f"{code} is critical; {severity} needs a reason")
    return severity


def _hit(cond: Column, code: str, name: str, expected: Column, observed: Column) -> Column:
    return F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(name).alias("field"), expected.cast("string").alias("expected"), observed.cast("string").alias("observed")))


def _set(c: Column) -> Column:
    return F.nullif(c, F.lit("")).isNotNull()


def pair_findings(pairs: DataFrame, key: bytes | None = None) -> DataFrame:
    """(code, field, expected, observed, subject_id, point_key, match_level): all rules over matched pairs, in one projection
    without a shuffle. What was expected and observed is told as text, access entries masked (with `key`, if there is one).

    `pairs` has e_* and o_* and `current_version`, the present version of the expected source, null when it is unknown.
    """
    e, o = (lambda n: F.col(f"e_{n}")), (lambda n: F.col(f"o_{n}"))
    stale = F.coalesce(F.col("current_version").isNotNull() & _set(o("source_version_id")) & (o("source_version_id") != F.col("current_version")), F.lit(False))
    chunking = ~stale & F.coalesce(_set(e("chunk_id")) & _set(o("chunk_id")) & (e("chunk_id") != o("chunk_id")), F.lit(False))
    dimension = F.coalesce(e("dimension").isNotNull() & (F.size(o("dimensions")) > 0) & ~F.array_contains(F.map_values(o("dimensions")), e("dimension")), F.lit(False))
    vector = F.coalesce(e("vector_hash").isNotNull() & (F.size(o("vector_hashes")) > 0) & ~F.array_contains(F.map_values(o("vector_hashes")), e("vector_hash")), F.lit(False))
    tenant_missing = _set(e("tenant")) & ~_set(o("tenant"))
    tenant_differs = F.coalesce(_set(e("tenant")) & _set(o("tenant")) & (e("tenant") != o("tenant")), F.lit(False))
    seen = F.coalesce(o("acl"), F.array().cast("array<string>"))
    known = e("acl").isNotNull()
    acl_missing = F.coalesce(known & (F.size(e("acl")) > 0) & (F.size(seen) == 0), F.lit(False))
    acl_broader = F.coalesce(known & ~acl_missing & (F.size(F.array_except(seen, e("acl"))) > 0), F.lit(False))
    acl_differs = F.coalesce(known & ~acl_missing & ~acl_broader & (F.size(F.array_except(e("acl"), seen)) > 0), F.lit(False))
    drift = F.coalesce(e("payload_hash") != o("payload_hash"), F.lit(False)) & ~stale & ~chunking & ~acl_missing & ~acl_broader & ~acl_differs & ~tenant_missing & ~tenant_differs
    listed = lambda m: F.array_join(F.array_sort(F.map_values(m)), "|")
    lists = F.array_join(acl_masked(e("acl"), key), "|"), F.array_join(acl_masked(seen, key), "|")
    rules = [
        _hit(stale, "STALE_SOURCE", "source_version_id", F.col("current_version"), o("source_version_id")), _hit(chunking, "STALE_CHUNKING", "chunk_id", e("chunk_id"), o("chunk_id")),
        _hit(dimension, "EMBEDDING_DIMENSION_MISMATCH", "dimension", e("dimension"), listed(o("dimensions"))), _hit(vector, "VECTOR_HASH_MISMATCH", "vector_hash", e("vector_hash"), listed(o("vector_hashes"))),
        _hit(tenant_missing, "TENANT_MISSING", "tenant", e("tenant"), o("tenant")), _hit(tenant_differs, "TENANT_MISMATCH", "tenant", e("tenant"), o("tenant")),
        _hit(acl_missing, "ACL_MISSING", "acl", *lists), _hit(acl_broader, "ACL_BROADER_THAN_SOURCE", "acl", *lists), _hit(acl_differs, "ACL_MISMATCH", "acl", *lists),
        _hit(drift, "PAYLOAD_DRIFT", "payload_hash", e("payload_hash"), o("payload_hash")),
    ]
    return pairs.select(e("binding_id").alias("subject_id"), o("point_key").alias("point_key"), "match_level", F.inline(F.array_compact(F.array(*rules))))


def orphan_code(o: str = "o_") -> Column:
    """What an observed point without a partner is; needs `current_version` of its source id."""
    c = lambda n: F.col(o + n)
    nothing = ~(_set(c("embedding_id")) | _set(c("chunk_id")) | _set(c("source_id")) | _set(c("source_version_id")))
    known = F.col("current_version").isNotNull()
    stale = _set(c("source_version_id")) & (c("source_version_id") != F.col("current_version"))
    return (
        F.when(nothing, "UNVERIFIABLE_POINT").when(_set(c("source_id")) & known & stale, "STALE_SOURCE").when(_set(c("source_id")) & known, "STALE_CHUNKING")
        .when(_set(c("source_id")), "ORPHAN_IN_INDEX").when(_set(c("embedding_id")) | _set(c("chunk_id")), "SOURCE_METADATA_MISSING").otherwise("ORPHAN_IN_INDEX")
    )


def pii_findings(pairs: DataFrame, assertions: DataFrame, deny: list[str], allow: list[str] = (), max_confidence: float = 1.0) -> DataFrame:
    """PII_POLICY_VIOLATION per scanned entity of a pair's chunk that the policy forbids.

    `pairs` has e_binding_id, o_point_key, match_level and e_pii_assertion_ids; `assertions` has id and findings (entity_type,
    confidence, start). An entity is forbidden if its type is denied, or an allow list is given without it, and its confidence
    is above `max_confidence`: with the default of 1 nothing is.
    """
    refs = pairs.select(F.col("e_binding_id").alias("subject_id"), F.col("o_point_key").alias("point_key"), "match_level", F.explode("e_pii_assertion_ids").alias("id"))
    seen = refs.join(assertions.select("id", "findings"), "id").select("subject_id", "point_key", "match_level", F.inline("findings"))
    forbidden = F.col("entity_type").isin(*deny) if deny else F.lit(False)
    if allow:
        forbidden = forbidden | ~F.col("entity_type").isin(*allow)
    hit = seen.where(forbidden & (F.col("confidence") > max_confidence))
    severity = F.when(F.col("confidence") >= 0.9, "critical").otherwise("high")
    return hit.select("subject_id", "point_key", "match_level", F.lit("PII_POLICY_VIOLATION").alias("code"), F.concat(F.lit("pii:"), "entity_type", F.lit(":"), F.col("start")).alias("field"), severity.alias("severity"))


def licence_findings(pairs: DataFrame, assertions: DataFrame, allow: list[str] = (), deny: list[str] = (), unknown: str = "warn") -> DataFrame:
    """LICENSE_UNKNOWN or LICENSE_POLICY_VIOLATION per pair, by the licence of least precedence (the first among equals).

    `pairs` has e_license_assertion_ids; `assertions` has id, precedence and spdx_expression.
    """
    refs = pairs.select(F.col("e_binding_id").alias("subject_id"), F.col("o_point_key").alias("point_key"), "match_level", F.posexplode("e_license_assertion_ids").alias("pos", "id"))
    best = refs.join(assertions.select("id", "precedence", "spdx_expression"), "id").groupBy("subject_id", "point_key", "match_level").agg(F.min_by("spdx_expression", F.struct("precedence", "pos")).alias("x"))
    x = F.col("x")
    bad = (x.isin(*deny) if deny else F.lit(False)) | (~x.isin(*allow) if allow else F.lit(False))
    code = F.when(x == "NOASSERTION", F.lit("LICENSE_UNKNOWN") if unknown in ("warn", "fail") else F.lit(None)).when(bad, "LICENSE_POLICY_VIOLATION")
    severity = F.when(F.col("code") == "LICENSE_UNKNOWN", "high" if unknown == "fail" else "medium").otherwise("high")
    return best.withColumn("code", code).where("code is not null").select("subject_id", "point_key", "match_level", "code", F.lit("license").alias("field"), severity.alias("severity"))


def with_current_version(rows: DataFrame, sources: DataFrame, source_id: str) -> DataFrame:
    """`rows` with `current_version`, the version of the source row that is last by `ord`."""
    current = sources.groupBy(F.col("id").alias("cv_id")).agg(F.max_by("version_id", "ord").alias("current_version"))
    return rows.join(current, F.col(source_id) == F.col("cv_id"), "left").drop("cv_id")


COLUMNS = ["code", "field", "subject_id", "point_key", "match_level"]
EVIDENCE = ["expected", "observed"]


def _other(spark, code: str, subject: str, field: str) -> DataFrame:
    """A finding on the run as a whole."""
    return spark.createDataFrame([(code, field, subject)], "code string, field string, subject_id string").select("code", "field", "subject_id", F.lit(None).cast("string").alias("point_key"), F.lit(None).cast("int").alias("match_level"))


def manifest_findings(spark, build_id: str, status: str) -> list[DataFrame]:
    """MANIFEST_INCOMPLETE unless the build is complete."""
    return [] if status == "complete" else [_other(spark, "MANIFEST_INCOMPLETE", build_id, "build.status")]


def snapshot_findings(spark, target: str, scope: str, completeness: str) -> list[DataFrame]:
    """SNAPSHOT_INCOMPLETE if the scan says so of itself."""
    return [_other(spark, "SNAPSHOT_INCOMPLETE", f"{target}:{scope}", "consistency.completeness")] if completeness == "incomplete" else []


def preflight_findings(spark, target: str, scope: str, expected: set[int], present: set[int]) -> list[DataFrame]:
    """EMBEDDING_DIMENSION_MISMATCH if both sides have dimensions and none in common."""
    return [_other(spark, "EMBEDDING_DIMENSION_MISMATCH", f"{target}:{scope}", "dimension")] if expected and present and not expected & present else []


def fingerprinted(rows: DataFrame, target: str, scope: str) -> DataFrame:
    """`rows` (COLUMNS, and severity, expected, observed where there are any) with fingerprint, severity, and the confidence of the match."""
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in EVIDENCE if c not in rows.columns})
    print_ = content_id("finding", json_string(F.col("code")), json_string(F.lit(target)), json_string(F.lit(scope)), json_string(F.col("subject_id")), json_string(F.col("field")))
    severity = F.coalesce("severity", severity_of(F.col("code"))) if "severity" in rows.columns else severity_of(F.col("code"))
    return rows.select(print_.alias("fingerprint"), "code", severity.alias("severity"), "field", "subject_id", "point_key", "match_level", F.when(F.col("match_level").isNotNull(), confidence(F.col("match_level"))).alias("confidence"), *EVIDENCE)


def all_findings(matched: DataFrame, duplicates: DataFrame, sources: DataFrame, target: str, scope: str, more: Iterable[DataFrame] = (), key: bytes | None = None) -> DataFrame:
    """(fingerprint, code, severity, field, subject_id, point_key, match_level, confidence, expected, observed) of a cascade's outcome.

    `more` are findings of other producers: on personal data, licences, the manifest, the snapshot.
    """
    pairs = with_current_version(matched.where("match_level is not null"), sources, "e_source_id")
    found = pair_findings(pairs, key)
    missing = matched.where("match_level is null and e_ord is not null").select(F.col("e_binding_id").alias("subject_id"), F.col("e_point_key").alias("point_key"), F.lit(None).cast("int").alias("match_level"), F.lit("MISSING_IN_INDEX").alias("code"), F.lit("point_id").alias("field"), F.col("e_embedding_id").alias("expected"))
    orphans = with_current_version(matched.where("match_level is null and o_ord is not null"), sources, "o_source_id")
    orphans = orphans.select(F.col("o_point_key").alias("subject_id"), F.col("o_point_key").alias("point_key"), F.lit(None).cast("int").alias("match_level"), orphan_code().alias("code"), F.lit("point_id").alias("field"), F.coalesce("o_source_id", "o_chunk_id", "o_embedding_id", "o_source_version_id").alias("observed"))
    twice = duplicates.select(F.col("key").alias("subject_id"), "point_key", F.col("level").alias("match_level"), F.when(F.col("level") == 1, "DUPLICATE_POINT_ID").otherwise("DUPLICATE_CONTENT").alias("code"), F.element_at(F.array(*map(F.lit, ("point_id", "embedding_id", "chunk_id"))), F.col("level")).alias("field"), F.col("n").cast("string").alias("observed"))
    optional = ("severity", *EVIDENCE)
    rows = [x.select(*COLUMNS, *(c if c in x.columns else F.lit(None).cast("string").alias(c) for c in optional)) for x in (found, missing, orphans, twice, *more)]
    return fingerprinted(reduce(DataFrame.unionByName, rows), target, scope)


def ratios(matched: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: counts and the five ratios; a ratio without a denominator is null, not zero."""
    base = matched.agg(
        F.count_if(F.expr("e_ord is not null")).alias("expected"), F.count_if(F.expr("o_ord is not null")).alias("observed"), F.count("match_level").alias("matched"), F.count_if(F.expr("match_level is null and e_ord is not null")).alias("missing"),
        F.count_if(F.expr("match_level is null and o_ord is not null")).alias("orphans"), F.count_if(F.expr("match_level is not null and size(e_acl) > 0")).alias("acl_required"),
    )
    return _ratio_row(base, findings, matched.where("match_level is not null and size(e_acl) > 0").select(F.col("e_binding_id").alias("subject_id")))


def ratios_of_sides(expected: DataFrame, observed: DataFrame, left: DataFrame, findings: DataFrame) -> DataFrame:
    """The same row without going through the pairs: from the sides, and `left`, what is over on either (e_* and o_* columns).

    A binding stands once on the expected side, so what isn't left over is matched."""
    has = "size(acl) > 0"
    e = expected.agg(F.count("*").alias("expected"), F.count_if(F.expr(has)).alias("e_acl_n"))
    o = observed.agg(F.count("*").alias("observed"))
    rest = left.agg(F.count_if(F.expr("e_ord is not null")).alias("missing"), F.count_if(F.expr("o_ord is not null")).alias("orphans"), F.count_if(F.expr("e_ord is not null and size(e_acl) > 0")).alias("left_acl_n"))
    base = e.crossJoin(o).crossJoin(rest)  # one row each
    base = base.select("expected", "observed", (F.col("expected") - F.col("missing")).alias("matched"), "missing", "orphans", (F.col("e_acl_n") - F.col("left_acl_n")).alias("acl_required"))
    return _ratio_row(base, findings, expected.where(has).select(F.col("binding_id").alias("subject_id")))


def _ratio_row(base: DataFrame, findings: DataFrame, required: DataFrame) -> DataFrame:
    acl = findings.where("match_level is not null and code in ('ACL_MISSING', 'ACL_BROADER_THAN_SOURCE', 'ACL_MISMATCH')").select("subject_id").distinct().join(required, "subject_id", "left_semi")
    extra = findings.agg(F.count_if(F.expr("code = 'UNVERIFIABLE_POINT'")).alias("unverifiable"), F.count_distinct(F.when(F.col("code").isin("STALE_SOURCE", "STALE_CHUNKING") & F.col("match_level").isNotNull(), F.col("subject_id"))).alias("stale"))
    one = base.crossJoin(extra).crossJoin(acl.agg(F.count("*").alias("acl_bad")))  # three tables of one row each
    return one.select(
        "expected", "observed", "matched", "missing", "orphans", "stale", F.try_divide(F.col("observed") - F.col("unverifiable"), "observed").alias("lineage_coverage"), F.try_divide("missing", "expected").alias("missing_ratio"),
        F.try_divide("orphans", "observed").alias("orphan_ratio"), F.try_divide("stale", "matched").alias("stale_ratio"), F.try_divide(F.col("acl_required") - F.col("acl_bad"), "acl_required").alias("acl_compliance"),
    )


def action_of(code: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(code.isin(*kv[1][1]), kv[0]), ACTIONS.items(), F.when(F.lit(False), "")).otherwise(REVIEW)


def remediation_candidates(findings: DataFrame) -> DataFrame:
    """(code, action, candidate), distinct: what a plan's actions are about, one row each. The candidate is the binding, else the point."""
    return findings.select("code", action_of(F.col("code")).alias("action"), F.coalesce(F.nullif("subject_id", F.lit("")), "point_key").alias("candidate")).where("candidate is not null").distinct()


def remediation_plan(findings: DataFrame, target: str, scope: str) -> DataFrame:
    """(action, code, target, scope, destructive, n_findings, n_candidates, caution, rationale), one row per code.

    The candidates themselves are rows of `remediation_candidates`: a code may have any number.
    """
    n = findings.groupBy("code").agg(F.count("*").alias("n_findings"))
    found = remediation_candidates(findings).groupBy("code").agg(F.count("*").alias("n_candidates"))
    action = F.col("action")
    caution = reduce(lambda acc, kv: acc.when(action == kv[0], kv[1]), CAUTIONS.items(), F.when(F.lit(False), ""))
    return n.join(found, "code", "left").withColumn("action", action_of(F.col("code"))).select(
        "action", "code", F.lit(target).alias("target"), F.lit(scope).alias("scope"), action.isin(*(a for a, (d, _) in ACTIONS.items() if d)).alias("destructive"), "n_findings", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        caution.alias("caution"), F.concat(F.col("n_findings").cast("string"), F.lit(" findings of "), "code").alias("rationale"),
    )


def sink_rows(findings: DataFrame) -> DataFrame:
    """Findings as a table keeps them: one per fingerprint, the last in order of match level (none last) and point."""
    columns = [c for c in findings.columns if c != "fingerprint"]
    order = F.struct(F.coalesce("match_level", F.lit(99)).alias("level"), F.coalesce("point_key", F.lit("")).alias("point"), F.coalesce("subject_id", F.lit("")).alias("subject"))
    return findings.groupBy("fingerprint").agg(F.max_by(F.struct(*columns), order).alias("r")).select("fingerprint", "r.*")


def ci_summary(ratio_row: dict, severities: dict[str, int], verdict: str) -> str:
    """Plain text for a log."""
    lines = [f"verdict: {verdict}", f"expected {ratio_row['expected']}, observed {ratio_row['observed']}, matched {ratio_row['matched']}"]
    lines += [f"{s}: {severities[s]}" for s in ("critical", "high", "medium", "low") if s in severities]
    return "\n".join(lines) + "\n"


def codes() -> Iterable[str]:
    return SEVERITIES
