"""A whole reconciliation: preflight, match, findings, ratios, summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from driftaudit.operators import findings as fd
from driftaudit.operators import matching
from driftaudit.operators.policy import Facts, Policy
from driftaudit.session import cut


@dataclass(frozen=True)
class Consistency:
    """What a scan of a target says about itself."""

    mode: str = "strict_consistent"
    completeness: str = "complete"
    start_count: int | None = None
    end_count: int | None = None
    snapshot_kind: str = "full"
    detail: str | None = None

    @classmethod
    def probed(cls, mode: str, start: int | None, end: int | None, snapshot_kind: str = "full") -> Consistency:
        """From the counts before and after a scan: incomplete if they differ; unknown counts prove nothing either way."""
        if start is None or end is None:
            return cls(mode, "complete", start, end, snapshot_kind, "no count before or after the scan")
        return cls(mode, "complete" if start == end else "incomplete", start, end, snapshot_kind, None if start == end else f"{start} points before, {end} after")


@dataclass(frozen=True)
class Result:
    findings: DataFrame
    ratios: DataFrame
    matched: DataFrame | None
    caveat: dict
    short_circuited: bool
    facts: Facts

    def summary(self) -> dict:
        """Counts on the driver: one row of ratios and the findings by severity."""
        row = self.ratios.first().asDict()
        counts = {r.severity: r["count"] for r in self.findings.groupBy("severity").count().collect()}
        return {"expected": row["expected"], "observed": row["observed"], "matched": row["matched"], "findings": sum(counts.values()), "by_severity": counts, "manifest_signed": self.facts.manifest_signed, "preflight_short_circuited": self.short_circuited}


def dimensions(expected: DataFrame) -> set[int]:
    """The distinct dimensions that are expected: as many as there are models, few by their nature."""
    return {r.dimension for r in expected.where("dimension is not null").select("dimension").distinct().collect()}


def caveat(c: Consistency, observed: int | None) -> dict:
    return {"mode": c.mode, "completeness": c.completeness, "start_count": c.start_count, "end_count": c.end_count, "observed_count": observed, "degraded_confidence": c.completeness == "incomplete", "snapshot_kind": c.snapshot_kind, "detail": c.detail}


_NOTHING = "select 0L expected, 0L observed, 0L matched, 0L missing, 0L orphans, 0L stale, cast(null as double) lineage_coverage, cast(null as double) missing_ratio, cast(null as double) orphan_ratio, cast(null as double) stale_ratio, cast(null as double) acl_compliance"


def reconcile(
    expected: DataFrame, observed: DataFrame, sources: DataFrame, target: str, scope: str, build_id: str = "", build_status: str = "complete", consistency: Consistency = Consistency(), target_dimensions: set[int] | None = None,
    policy: Policy | None = None, pii: DataFrame | None = None, licences: DataFrame | None = None, signed: bool = False, key: bytes | None = None,
) -> Result:
    """Findings and ratios of one target and scope.

    If expected and present dimensions have none in common, no point is read: the one finding says so, all counts are 0, all
    ratios null, and the caveat is that of an incomplete scan. `pii` and `licences` are assertions; with a policy that has a
    section on them they give findings. An incomplete build or scan is a finding of its own.

    The expected side, which comes of joins, and the findings are kept (checkpoint): the one is read several times by the
    match, the other by everything after it. Pairs are made once, for the findings.
    """
    spark = expected.sparkSession
    expected = cut(expected)
    if target_dimensions and (stop := fd.preflight_findings(spark, target, scope, dimensions(expected), target_dimensions)):
        c = Consistency("best_effort_live", "incomplete", None, None, consistency.snapshot_kind, "dimensions have none in common; no point was read")
        return Result(fd.fingerprinted(stop[0], target, scope), spark.sql(_NOTHING), None, caveat(c, 0), True, Facts(signed, c.snapshot_kind, c.completeness))
    done = matching.rounds(expected, observed)
    matched, twice = matching.cascade(expected, observed, done), matching.duplicate_keys(expected, observed, done)
    more: list[DataFrame] = [*fd.manifest_findings(spark, build_id, build_status), *fd.snapshot_findings(spark, target, scope, consistency.completeness)]
    pairs = matched.where("match_level is not null")
    if policy and "pii" in policy.sections and pii is not None and "e_pii_assertion_ids" in pairs.columns:
        more.append(fd.pii_findings(pairs, pii, policy.get("pii", "deny", []), policy.get("pii", "allow", []), policy.get("pii", "max_confidence_allowed", 1.0)))
    if policy and "licenses" in policy.sections and licences is not None and "e_license_assertion_ids" in pairs.columns:
        more.append(fd.licence_findings(pairs, licences, policy.get("licenses", "allow", []), policy.get("licenses", "deny", []), policy.get("licenses", "unknown", "allow")))
    found = cut(fd.all_findings(matched, twice, sources, target, scope, more, key))
    left = matched.where("match_level is null")
    return Result(found, fd.ratios_of_sides(expected, observed, left, found), matched, caveat(consistency, None), False, Facts(signed, consistency.snapshot_kind, consistency.completeness))

