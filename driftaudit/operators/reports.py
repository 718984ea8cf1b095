"""Reports: facet counts, self-contained HTML pages, remediation CSV, the audit log."""

from __future__ import annotations

import html
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftaudit.functions.canonical import canonical


def facets(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(facet, key, n) for {facet: (table, column expression)}: one small aggregation each, united."""
    parts = [df.groupBy(F.expr(c).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("facet"), "key", "n") for name, (df, c) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def table(header: Iterable[str], rows: Iterable[Iterable]) -> str:
    def cells(tag: str, values: Iterable) -> str:
        return "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in values)

    return f"<table><tr>{cells('th', header)}</tr>{''.join(f'<tr>{cells("td", r)}</tr>' for r in rows)}</table>"


def page(title: str, *parts: str) -> str:
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{''.join(parts)}</body></html>"


def reconciliation_page(ratio_row: dict, counts: dict[str, int], verdict: str, sample: list[dict], title: str = "Reconciliation") -> str:
    """Ratios, counts by severity, the verdict and a sample of findings, with how many there are; everything escaped."""
    shown = [(k, "n/a" if v is None else v) for k, v in ratio_row.items()]
    findings = table(["code", "severity", "subject"], [(f["code"], f["severity"], f["subject_id"]) for f in sample])
    note = f"<p>{len(sample)} of {sum(counts.values())} findings are shown.</p>"
    return page(title, f"<p>Verdict: <b>{html.escape(verdict)}</b></p>", table(["measure", "value"], shown), table(["severity", "findings"], counts.items()), note, findings)


def manifest_facets(t: dict[str, DataFrame]) -> DataFrame:
    """(facet, key, n) of a manifest's tables (see sources.manifest.tables): eleven counters, each an aggregation of its own."""
    warned = lambda df: df.select(F.explode("warnings").alias("w")).select(F.col("w.code").alias("key"))
    a, s = t["assertions"], t["sources"]
    pii = a.where("type = 'PII_SCAN'")
    # a source counts with the expression and the entries of the assertions it names
    licensed = s.select(F.explode("license_assertion_ids").alias("id")).join(a.where("type = 'LICENSE'").select("id", F.col("spdx_expression").alias("key")), "id")
    open_to = s.select(F.col("declared_acl_assertion_id").alias("id")).join(a.where("type = 'ACL'").select("id", F.coalesce(F.nullif(F.array_join("entries", ","), F.lit("")), F.lit("(empty)")).alias("key")), "id")
    parts = {
        "media_type": s.select(F.col("media_type").alias("key")), "source_status": s.select(F.col("status").alias("key")), "parse_status": t["parse_runs"].select(F.col("status").alias("key")), "parser": t["parse_runs"].select(F.col("parser_name").alias("key")),
        "embedding_model": t["embeddings"].select(F.concat("provider", F.lit("/"), "model").alias("key")), "pii_status": pii.select(F.col("status").alias("key")), "pii_entity_type": pii.select(F.explode("findings").alias("f")).select(F.col("f.entity_type").alias("key")),
        "license": licensed.select("key"), "acl": open_to.select("key"), "tenant": s.where("declared_tenant is not null").select(F.col("declared_tenant").alias("key")),
        "warning": warned(t["parse_runs"]).unionByName(warned(a.where("type = 'QUALITY'"))),
    }
    return facets({n: (df, "key") for n, df in parts.items()})


def masked_examples(assertions: DataFrame) -> DataFrame:
    """(entity_type, example): the first masked preview of each type, in order of the assertions."""
    f = assertions.where("type = 'PII_SCAN'").select("ord", F.posexplode("findings").alias("pos", "f")).where("f.masked_preview is not null")
    return f.groupBy(F.col("f.entity_type").alias("entity_type")).agg(F.min_by("f.masked_preview", F.struct("ord", "pos")).alias("example"))


def _nested(rows: DataFrame) -> dict[str, dict[str, int]]:
    out: dict[str, dict[str, int]] = {}
    for r in sorted(rows.collect()):  # as many rows as there are kinds of things, not things
        out.setdefault(r.facet, {})[r.key] = r.n
    return out


def manifest_report(doc: dict, t: dict[str, DataFrame]) -> dict:
    """A manifest in numbers."""
    build = doc["build"]
    return {
        "report_type": "driftaudit.manifest_report.v1", "build": {k: build.get(k) for k in ("build_id", "status", "started_at", "completed_at", "stages")}, "statistics": doc.get("statistics", {}), "facets": _nested(manifest_facets(t)),
        "masked_examples": {r.entity_type: r.example for r in sorted(masked_examples(t["assertions"]).collect())}, "integrity": doc.get("integrity", {}), "signatures": [{k: s.get(k) for k in ("key_fingerprint", "algorithm", "issuer", "signed_at")} for s in doc.get("signatures", [])],
    }


def snapshot_facets(points: DataFrame) -> DataFrame:
    """(facet, key, n): points by vector name, by tenant (of those that have one), and by warning."""
    return facets({"vector_name": (points.select(F.explode("vector_names").alias("key")), "key"), "tenant": (points.where("tenant is not null"), "tenant"), "warning": (points.select(F.explode("normalization_warnings").alias("key")), "key")})


def snapshot_report(header: dict, trailer: dict, points: DataFrame, locators: int = 10) -> dict:
    """A snapshot in numbers, with the first locators in its order."""
    first = [r.raw_locator for r in points.select("ord", "raw_locator").orderBy("ord").limit(locators).collect()]
    shown = {k: header.get(k) for k in ("target_id", "scope", "target_type", "vector_names", "vector_dimensions", "started_at", "consistency_mode", "snapshot_kind")} | {k: trailer.get(k) for k in ("finished_at", "point_count", "consistency_completeness", "consistency_start_count", "consistency_end_count", "content_hash")}
    return {"report_type": "driftaudit.snapshot_report.v1"} | shown | {"observed_point_count": points.count(), "facets": _nested(snapshot_facets(points)), "sample_locators": first}


def report_bytes(report: dict) -> bytes:
    """A report as canonical JSON: equal reports are equal bytes."""
    return canonical(report).encode()


def report_page(report: dict) -> str:
    """Any of the reports as a page: what is single in one table, each counter in one of its own."""
    single = [(k, v) for k, v in report.items() if not isinstance(v, (dict, list))]
    parts = [table(["", ""], single)]
    for k, v in report.items():
        if isinstance(v, dict):
            for name, counts in v.items() if v and all(isinstance(x, dict) for x in v.values()) else [(k, v)]:
                parts.append(f"<h2>{html.escape(str(name))}</h2>" + table(["", ""], sorted(counts.items(), key=lambda kv: str(kv[0]))))
        elif isinstance(v, list):
            parts.append(f"<h2>{html.escape(k)}</h2>" + table([k], [[canonical(x) if isinstance(x, (dict, list)) else x] for x in v]))
    return page(report["report_type"], *parts)


def remediation_csv(plan: DataFrame, path: str) -> None:
    """One row per action: action, target, scope, destructive, candidate_count, rationale."""
    plan.select("action", "target", "scope", "destructive", F.col("n_candidates").alias("candidate_count"), "rationale").write.mode("overwrite").option("header", True).csv(path)


#: Parts of names that secrets go by, without what joins words.
SECRET_NAMES = ("password", "passwd", "passphrase", "secret", "token", "apikey", "privatekey", "credential", "dsn", "connectionstring", "authorization")


def append_audit(log: DataFrame, path: str) -> None:
    """Appends rows with a map `metadata`; a key that looks like a secret's fails the write."""
    bare = lambda k: F.translate(F.lower(k), "_- .", "")
    secret = F.exists(F.map_keys("metadata"), lambda k: bare(k).rlike("|".join(SECRET_NAMES)))
    guarded = log.withColumn("metadata", F.when(F.coalesce(secret, F.lit(False)), F.raise_error(F.lit("audit metadata holds a secret-shaped key")).cast("map<string,string>")).otherwise(F.col("metadata")))
    guarded.write.mode("append").parquet(path)
