"""Policies: a document of requirements, gates and rules, checked strictly, held against ratios and findings."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from numbers import Real

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftaudit.operators.findings import SEVERITIES

#: Ranks that a rule's threshold means, verdicts from the worst to the best, and exit codes.
SEVERITY_RANKS = {"low": 0, "medium": 1, "high": 2, "critical": 3}
VERDICTS = ("FAIL", "INCONCLUSIVE", "WARN", "PASS")
EXIT_CODES = {"PASS": 0, "WARN": 0, "FAIL": 1, "INCONCLUSIVE": 2}
#: What rules may be about, and how they compare.
CATEGORIES = ("count", "ratio", "severity", "source_path", "media_type", "license", "pii", "acl", "tenant", "age", "completeness")
COMPARATORS = ("lt", "lte", "gt", "gte", "eq")


class PolicyError(ValueError):
    """A document that is no policy."""


# What a value may be: a tester and its name in messages. Sections are mappings of names to these.
def _one_of(*values: str):
    return (lambda v: isinstance(v, str) and v in values), f"one of {', '.join(values)}"


def _list_of(test):
    return (lambda v: isinstance(v, list) and all(test[0](x) for x in v)), f"a list, each {test[1]}"


_SHARE = (lambda v: isinstance(v, Real) and not isinstance(v, bool) and 0 <= v <= 1), "a number between 0 and 1"
_NUMBER = (lambda v: isinstance(v, Real) and not isinstance(v, bool)), "a number"
_COUNT = (lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= 0), "a whole number from 0"
_TEXT = (lambda v: isinstance(v, str)), "text"
_FLAG = (lambda v: isinstance(v, bool)), "true or false"
_SEVERITY = _one_of(*SEVERITY_RANKS)
SECTIONS = {
    "requirements": {"manifest_signature": _one_of("required", "optional"), "full_snapshot": _one_of("required", "optional"), "lineage_coverage_min": _SHARE},
    "findings": {"fail_on_severity": _list_of(_SEVERITY), "warn_on_severity": _list_of(_SEVERITY)},
    "pii": {"deny": _list_of(_TEXT), "allow": _list_of(_TEXT), "max_confidence_allowed": _SHARE},
    "licenses": {"allow": _list_of(_TEXT), "deny": _list_of(_TEXT), "unknown": _one_of("fail", "warn", "allow")},
    "access": {"acl_required": _FLAG, "tenant_required": _FLAG, "acl_compliance_min": _SHARE},
    "drift": {"stale_ratio_max": _SHARE, "orphan_ratio_max": _SHARE, "missing_ratio_max": _SHARE},
}
RULE = {"category": _one_of(*CATEGORIES), "taxonomy_codes": _list_of(_one_of(*SEVERITIES)), "comparator": _one_of(*COMPARATORS), "threshold": _NUMBER, "pattern": _TEXT, "max_age_days": _COUNT, "verdict_on_violation": _one_of("WARN", "FAIL")}


def _checked(what: str, doc, allowed: dict, needed: tuple[str, ...] = ()) -> dict:
    if not isinstance(doc, dict):
        raise PolicyError(f"{what} must be a mapping")
    if unknown := sorted(set(doc) - set(allowed)):
        raise PolicyError(f"{what}: unknown keys {unknown}")
    if missing := sorted(set(needed) - set(doc)):
        raise PolicyError(f"{what}: {missing} missing")
    for k, v in doc.items():
        if v is not None and not allowed[k][0](v):
            raise PolicyError(f"{what}.{k} must be {allowed[k][1]}")
    return {k: v for k, v in doc.items() if v is not None}


@dataclass(frozen=True)
class Policy:
    """A checked document. Sections that are absent are empty, but known to be absent."""

    name: str
    sections: dict[str, dict]
    rules: list[dict]

    @classmethod
    def load(cls, doc: dict | str) -> Policy:
        """From a mapping, or its JSON or YAML. Unknown keys anywhere are errors."""
        if isinstance(doc, str):
            try:
                doc = json.loads(doc)
            except ValueError:
                from driftaudit.operators.recognizers import _document

                doc = _document(doc)
        if not isinstance(doc, dict):
            raise PolicyError("a policy is a mapping")
        if unknown := sorted(set(doc) - {"version", "name", "rules", *SECTIONS}):
            raise PolicyError(f"unknown keys {unknown}")
        if doc.get("version", 1) != 1 or isinstance(doc.get("version"), bool):
            raise PolicyError("only version 1 is known")
        if not isinstance(doc.get("name"), str) or not doc["name"]:
            raise PolicyError("a policy has a name")
        if missing := [s for s in ("requirements", "findings") if s not in doc]:
            raise PolicyError(f"sections missing: {missing}")
        sections = {s: _checked(s, doc[s], SECTIONS[s], ("fail_on_severity",) if s == "findings" else ()) for s in SECTIONS if doc.get(s) is not None}
        rules = doc.get("rules") or []
        if not isinstance(rules, list):
            raise PolicyError("rules must be a list")
        return cls(doc["name"], sections, [_checked(f"rules[{i}]", r, RULE, ("category", "verdict_on_violation")) for i, r in enumerate(rules)])

    def get(self, section: str, key: str, default=None):
        return self.sections.get(section, {}).get(key, default)


@dataclass(frozen=True)
class Facts:
    """What a run knows besides ratios and findings."""

    manifest_signed: bool = False
    snapshot_kind: str = "full"
    completeness: str = "complete"


def _rank(severity: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(severity == kv[0], kv[1]), list(SEVERITY_RANKS.items())[1:], F.when(severity == "low", 0)).otherwise(-1)


def _matching(rule: dict) -> Column:
    """Which findings a rule counts: those of its codes, or for a rule on severity without codes those from its rank on, or all."""
    if codes := rule.get("taxonomy_codes"):
        return F.col("code").isin(*codes)
    if rule["category"] == "severity" and "threshold" in rule:
        return _rank(F.col("severity")) >= int(rule["threshold"])
    return F.lit(True)


def evaluate(policy: Policy, ratio_row: DataFrame, findings: DataFrame, facts: Facts = Facts()) -> DataFrame:
    """(rule, verdict, passed, detail), one row per rule that applies, in their order as `no`.

    Findings are counted once for all rules. A floor on a ratio that is null is INCONCLUSIVE, a ceiling does not apply; both
    compare strictly. A rule without a threshold compares with 0, one without a comparator by `gte`.
    """
    fail, warn = policy.get("findings", "fail_on_severity", []), policy.get("findings", "warn_on_severity", [])
    among = lambda s: F.count_if(F.col("severity").isin(*s)) if s else F.lit(0).cast("bigint")
    counts = findings.agg(among(fail).alias("n_fail"), among(warn).alias("n_warn"), F.count_if(F.col("code") == "LICENSE_UNKNOWN").alias("n_unknown"), *(F.count_if(_matching(r)).alias(f"n_{i}") for i, r in enumerate(policy.rules)))
    out: list[Column] = []

    def add(name: str, verdict: Column, detail: Column) -> None:
        out.append(F.struct(F.lit(len(out)).alias("no"), F.lit(name).alias("rule"), verdict.alias("verdict"), detail.alias("detail")))

    def shown(c: Column) -> Column:
        return F.format_string("%.4f", c)

    def floor(section: str, key: str, ratio: str) -> None:
        if (least := policy.get(section, key)) is not None:
            r = F.col(ratio)
            verdict = F.when(r.isNull(), "INCONCLUSIVE").when(r < float(least), "FAIL").otherwise("PASS")
            add(f"{section}.{key}", verdict, F.coalesce(F.concat(F.lit(f"{ratio} "), shown(r), F.lit(f", at least {least:.4f} asked for")), F.lit(f"{ratio} does not apply")))

    for key, ok, is_ in (("manifest_signature", facts.manifest_signed, f"signed: {facts.manifest_signed}"), ("full_snapshot", facts.snapshot_kind == "full" and facts.completeness == "complete", f"{facts.snapshot_kind}, {facts.completeness}")):
        if policy.get("requirements", key) == "required":
            add(f"requirements.{key}", F.lit("PASS" if ok else "FAIL"), F.lit(is_))
    floor("requirements", "lineage_coverage_min", "lineage_coverage")
    for gate, n, verdict, severities in (("fail", "n_fail", "FAIL", fail), ("warn", "n_warn", "WARN", warn)):
        if gate == "fail" or severities:
            add(f"findings.{gate}_on_severity", F.when(F.col(n) > 0, verdict).otherwise("PASS"), F.concat(F.col(n).cast("string"), F.lit(f" findings of {', '.join(sorted(severities))}")))
    if unknown := policy.get("licenses", "unknown"):
        bad = F.lit("PASS") if unknown == "allow" else F.when(F.col("n_unknown") > 0, "FAIL" if unknown == "fail" else "WARN").otherwise("PASS")
        add("licenses.unknown", bad, F.concat(F.col("n_unknown").cast("string"), F.lit(" licences that assert nothing")))
    floor("access", "acl_compliance_min", "acl_compliance")
    for ratio in ("stale_ratio", "orphan_ratio", "missing_ratio"):
        if (most := policy.get("drift", f"{ratio}_max")) is not None:
            r = F.col(ratio)
            add(f"drift.{ratio}_max", F.when(r > float(most), "FAIL").when(r.isNotNull(), "PASS"), F.concat(F.lit(f"{ratio} "), shown(r), F.lit(f", at most {most:.4f} allowed")))
    for i, rule in enumerate(policy.rules):
        n, limit, how = F.col(f"n_{i}").cast("double"), float(rule.get("threshold", 0)), rule.get("comparator", "gte")
        violated = {"lt": n < limit, "lte": n <= limit, "gt": n > limit, "gte": n >= limit, "eq": n == limit}[how]
        add(f"rules[{i}].{rule['category']}", F.when(violated, rule["verdict_on_violation"]).otherwise("PASS"), F.concat(F.col(f"n_{i}").cast("string"), F.lit(f" findings, violated if {how} {limit:g}")))
    one = ratio_row.crossJoin(counts)  # one row each
    return one.select(F.inline(F.array(*out))).where("verdict is not null").select("no", "rule", "verdict", (F.col("verdict") == "PASS").alias("passed"), "detail")


def verdict(rules: DataFrame) -> DataFrame:
    """One row: the worst verdict, PASS without rules."""
    rank = reduce(lambda acc, iv: acc.when(F.col("verdict") == iv[1], iv[0]), list(enumerate(VERDICTS))[1:], F.when(F.col("verdict") == "FAIL", 0))
    return rules.agg(F.coalesce(F.min_by("verdict", rank), F.lit("PASS")).alias("verdict"))
