"""Manifest documents: reading into tables, assembling, hashing."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftaudit.functions.canonical import canonical
from driftaudit.functions.checks import acl_projection, tenant_projection

RECORDS = ("sources", "parse_runs", "chunks", "embeddings", "index_bindings", "assertions", "artifacts")


def read_manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One DataFrame per record list, with `ord`, of manifests of one JSON document per file."""
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v")).where("v is not null")
    return {r: doc.select(F.posexplode(F.try_variant_get("v", f"$.{r}", "array<variant>")).alias("ord", "record")) for r in RECORDS}


#: What the records of each list must have, and what else they may have; further members stand under `extensions`.
FIELDS = {
    "sources": ("id version_id namespace uri media_type size_bytes content_hash status", "modified_at discovered_by source_system declared_tenant declared_acl_assertion_id license_assertion_ids raw_artifact_ref relationships error"),
    "parse_runs": ("id source_version_id parser_name parser_version status parsed_artifact_ref", "config_hash config_redacted container_digest ocr warnings duration_seconds"),
    "chunks": ("id source_version_id parse_run_id locator raw_hash contextualized_hash token_count tokenizer", "pii_assertion_ids license_assertion_ids acl_assertion_ids neighbor_ids metadata"),
    "embeddings": ("id chunk_id model dimension dtype contextualized_hash", "normalization distance_expectation vector_hash generated_at usage"),
    "index_bindings": ("id target namespace point_id embedding_id", "expected_payload_hash expected_payload_projection tenant_projection acl_projection write_status observed_at"),
    "assertions": ("id type subject_ref", None),
    "artifacts": ("id media_type sha256 size_bytes", "compression encryption locator sensitivity"),
}
_IDS = {"sources": "src", "parse_runs": "prs", "chunks": "chk", "embeddings": "emb", "index_bindings": "idx"}
TOP = {"manifest_version", "namespace", "ledger_version", "created_at", "build", "statistics", "integrity", "signatures", "extensions", *RECORDS}


def problems(doc) -> list[str]:
    """What is wrong with a manifest document, empty if nothing is: shape, unknown members, references, statistics, hash."""
    if not isinstance(doc, dict):
        return ["a manifest is an object"]
    out = [f"unknown member {k}" for k in sorted(set(doc) - TOP)] + [f"{k} missing" for k in ("manifest_version", "build") if k not in doc]
    if not isinstance(doc.get("build", {}), dict) or not (doc.get("build") or {}).get("build_id"):
        out.append("build.build_id missing")
    for name, (must, may) in FIELDS.items():
        rows = doc.get(name, [])
        if not isinstance(rows, list):
            out.append(f"{name} must be a list")
            continue
        for i, r in enumerate(rows):
            if not isinstance(r, dict):
                out.append(f"{name}[{i}] must be an object")
                continue
            out += [f"{name}[{i}]: {k} missing" for k in must.split() if r.get(k) is None]
            if may is not None:
                out += [f"{name}[{i}]: unknown member {k}" for k in sorted(set(r) - {*must.split(), *may.split(), "extensions"})]
            if name in _IDS and isinstance(r.get("id"), str) and not r["id"].startswith(_IDS[name] + "_"):
                out.append(f"{name}[{i}]: id begins with {_IDS[name]}_")
    said = doc.get("integrity", {}).get("manifest_hash") if isinstance(doc.get("integrity"), dict) else None
    if said is not None and said != manifest_hash(doc):
        out.append("integrity.manifest_hash is that of another document")
    return out


def statistics(doc: dict) -> dict[str, int]:
    """Counts of the records; sources by id and by version; warnings of the build, the parse runs and the assertions on quality."""
    n = {k: len(doc.get(k, [])) for k in RECORDS}
    warned = len(doc["build"].get("warnings", [])) + sum(len(r.get("warnings") or []) for r in doc.get("parse_runs", [])) + sum(len(r.get("warnings") or []) for r in doc.get("assertions", []) if r.get("type") == "QUALITY")
    return {"source_count": len({s["id"] for s in doc.get("sources", [])}), "source_version_count": n["sources"], "parse_run_count": n["parse_runs"], "chunk_count": n["chunks"], "embedding_count": n["embeddings"], "index_binding_count": n["index_bindings"], "assertion_count": n["assertions"], "artifact_count": n["artifacts"], "warning_count": warned}


def tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The record lists of a manifest file as typed tables with `ord`, for reconciliation and reports."""
    raw = read_manifest(spark, path)

    def cols(name: str, **fields: str) -> DataFrame:
        return raw[name].select("ord", *(F.try_variant_get("record", "$." + p, t).alias(c) for c, (p, t) in ((c, f.split(" ", 1)) for c, f in fields.items())))

    as_json = F.to_json(F.try_variant_get("record", "$.point_id", "variant"))
    bindings = raw["index_bindings"].select(
        "ord", *(F.try_variant_get("record", f"$.{c}", "string").alias(c) for c in ("id", "target", "namespace", "embedding_id", "expected_payload_hash", "write_status")), as_json.alias("point_key"),
        acl_projection(F.to_json(F.try_variant_get("record", "$.acl_projection", "variant"))).alias("acl"), tenant_projection(F.to_json(F.try_variant_get("record", "$.tenant_projection", "variant"))).alias("tenant"),
    )
    finding = "array<struct<entity_type:string,confidence:double,start:int,end:int,masked_preview:string>>"
    return {
        "sources": cols("sources", id="id string", version_id="version_id string", uri="uri string", content_hash="content_hash string", media_type="media_type string", status="status string", declared_tenant="declared_tenant string", declared_acl_assertion_id="declared_acl_assertion_id string", license_assertion_ids="license_assertion_ids array<string>"),
        "parse_runs": cols("parse_runs", id="id string", parser_name="parser_name string", status="status string", warnings="warnings array<struct<code:string>>"),
        "chunks": cols("chunks", id="id string", source_version_id="source_version_id string", parse_run_id="parse_run_id string", pii_assertion_ids="pii_assertion_ids array<string>", license_assertion_ids="license_assertion_ids array<string>"),
        "embeddings": cols("embeddings", id="id string", chunk_id="chunk_id string", dimension="dimension int", vector_hash="vector_hash string", provider="model.provider string", model="model.name string"),
        "index_bindings": bindings,
        "assertions": cols("assertions", id="id string", type="type string", subject_ref="subject_ref string", status="status string", findings=f"findings {finding}", method="method string", spdx_expression="spdx_expression string", entries="entries array<string>", warnings="warnings array<struct<code:string>>"),
        "artifacts": cols("artifacts", id="id string", sha256="sha256 string", size_bytes="size_bytes bigint"),
    }


def without_nulls(v):
    """Optional members that are null are left out, never written as null."""
    if isinstance(v, dict):
        return {k: without_nulls(x) for k, x in v.items() if x is not None}
    return [without_nulls(x) for x in v] if isinstance(v, (list, tuple)) else v


def manifest_hash(manifest: dict) -> str:
    """SHA-256 of the canonical bytes without signatures and without the hash itself."""
    view = {k: v for k, v in manifest.items() if k != "signatures"} | {"signatures": []}
    if "integrity" in view:
        view["integrity"] = {k: v for k, v in view["integrity"].items() if k != "manifest_hash"}
    return hashlib.sha256(canonical(without_nulls(view)).encode()).hexdigest()


def assemble(build: dict, tables: dict[str, DataFrame]) -> dict:
    """A manifest document from ordered tables; for exchange, so its size is that of one document on the driver."""
    import json

    out = {"manifest_version": "1.0", "build": build, "signatures": []}
    for r in RECORDS:
        rows = tables[r].orderBy("uri" if r == "sources" else "id").select(F.to_json(F.struct("*")).alias("j")).toLocalIterator() if r in tables else []
        out[r] = [json.loads(x.j) for x in rows]
    out = without_nulls(out)
    out["statistics"] = statistics(out)
    out["integrity"] = {"canonicalization": "RFC8785", "hash_algorithm": "sha256"}
    out["integrity"]["manifest_hash"] = manifest_hash(out)
    if bad := problems(out):
        raise ValueError("; ".join(bad[:20]) + (f" and {len(bad) - 20} more" if len(bad) > 20 else ""))
    return out


def load(path: str) -> dict:
    """A manifest document from a file, checked; raises ValueError with what is wrong."""
    import json
    from pathlib import Path

    doc = json.loads(Path(path).read_text())
    if bad := problems(doc):
        raise ValueError("; ".join(bad[:20]))
    return doc


def write(path: str, doc: dict) -> None:
    """Canonical bytes of a checked document."""
    from pathlib import Path

    if bad := problems(doc):
        raise ValueError("; ".join(bad[:20]))
    Path(path).write_text(canonical(doc))
