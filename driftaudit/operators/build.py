"""From files to the tables of a manifest: discover, parse, govern, chunk, scan, embed; each stage a DataFrame of the one before.

Stages that are used more than once (outcomes, chunks) are computed once and kept. Nothing is collected but counts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftaudit.functions.canonical import canonical
from driftaudit.functions.ids import content_id, id_of_strings, json_object, json_string, json_strings, plain
from driftaudit.functions.text import vector_hash_f32, with_text_hash
from driftaudit.operators import access, chunking, embedding, licences, parsing, recognizers
from driftaudit.operators.discovery import tombstones
from driftaudit.session import cut


def hash_of(value) -> str:
    """SHA-256 of a value's canonical JSON, on the driver."""
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def stage_key(stage: str, input_hash: Column, adapter: str, version: str, config_hash: str) -> Column:
    """What a stage's output depends on, as one digest: the key of its cache."""
    parts = {"stage": F.lit(stage), "input_hash": input_hash, "adapter_name": F.lit(adapter), "adapter_version": F.lit(version), "config_hash": F.lit(config_hash)}
    return F.sha2(json_object({k: json_string(v) for k, v in parts.items()}), 256)


@dataclass(frozen=True)
class BuildConfig:
    namespace: str
    build_id: str
    created_at: str
    limits: parsing.Limits = parsing.Limits()
    chunker: str = "hierarchical"
    chunker_config: dict = field(default_factory=dict)
    provider: object | None = None
    normalization: str = "l2"
    pii: recognizers.ScanConfig | None = None
    blocked_types: tuple[str, ...] = ()
    blocked_from: float = 0.0
    licence_rules: tuple[tuple[str, str], ...] = ()
    licence_default: str | None = None
    govern_licences: bool = False
    acl: access.Rules | None = None
    tenant: access.Rules | None = None
    tenant_required: bool = False
    previous: DataFrame | None = None

    @property
    def chunker_hash(self) -> str:
        return hash_of({"chunker": self.chunker, "version": chunking.CHUNKER_VERSION, "config": self.chunker_config})

    @property
    def pipeline_hash(self) -> str:
        return hash_of({"parser_config": {}, "chunker_name": self.chunker, "chunker_config": self.chunker_config, "embedding_normalization": self.normalization})


class Build:
    """The tables of a build over `found`: rows of `discover` (id, version_id, namespace, uri, media_type, content, ...)."""

    def __init__(self, found: DataFrame, config: BuildConfig):
        self.found, self.config = found, config
        chunking.Sizes.load(config.chunker_config)  # a bad configuration fails before any work
        if config.chunker not in chunking.CHUNKERS:
            raise ValueError(f"no chunker {config.chunker}")

    @cached_property
    def _parser_hash(self) -> Column:
        known = {m: hash_of({"parser": f"driftaudit.{m}", "version": parsing.VERSION, "config": {}}) for m in parsing.PARSERS}
        return reduce(lambda acc, kv: acc.when(F.col("media_type") == kv[0], kv[1]), known.items(), F.when(F.lit(False), "")).otherwise(hash_of({"parser": "none"}))

    @cached_property
    def outcomes(self) -> DataFrame:
        """One row per source version: parse_run_id and the parser's outcome."""
        runs = self.found.withColumn("config_hash", self._parser_hash)
        runs = runs.withColumn("parse_run_id", content_id("parse_run", plain(F.col("version_id")), plain(F.col("config_hash"))))
        parsed = parsing.parse_documents(runs.dropDuplicates(["parse_run_id"]), "parse_run_id", "content", "media_type", self.config.limits)
        keep = runs.select("parse_run_id", "version_id", "id", "uri", "media_type", "content_hash", "config_hash", licences.spdx_header(F.decode("content", "UTF-8")).alias("header") if dict(self.found.dtypes)["content"] == "binary" else licences.spdx_header(F.col("content")).alias("header"))
        return cut(keep.join(parsed, "parse_run_id"))

    @cached_property
    def parse_runs(self) -> DataFrame:
        name = reduce(lambda acc, m: acc.when(F.col("media_type") == m, f"driftaudit.{m}"), parsing.PARSERS, F.when(F.lit(False), "")).otherwise("none")
        failed = F.transform("errors", lambda e: F.struct(F.substring_index(e, ":", 1).alias("code"), e.alias("message")))
        return self.outcomes.select(F.col("parse_run_id").alias("id"), F.col("version_id").alias("source_version_id"), name.alias("parser_name"), F.lit(parsing.VERSION).alias("parser_version"), "config_hash", "status", F.concat("warnings", failed).alias("warnings"), F.concat(F.lit("art_"), F.sha2(F.to_json("elements"), 256)).alias("parsed_artifact_ref"), F.lit(0.0).alias("duration_seconds"))

    @cached_property
    def elements(self) -> DataFrame:
        return parsing.elements(self.outcomes, "parse_run_id").where("ord is not null")

    @cached_property
    def _governed(self) -> DataFrame:
        """Outcomes with access, tenant and licence candidates of their source."""
        c, path = self.config, F.regexp_replace("uri", "^file:", "")
        d = self.outcomes.select("version_id", "uri", "header", "front_matter", path.alias("path"))
        d = access.expected_acl(d, "path", c.acl, "acl") if c.acl else d.withColumn("acl", F.lit(None).cast("array<string>"))
        d = access.expected_tenant(d, "path", c.tenant, "tenant") if c.tenant else d.withColumn("tenant", F.lit(None).cast("struct<key:string,value:string>"))
        found = licences.candidates(front_matter=F.get_json_object("front_matter", "$.license"), header=F.col("header"), path=F.col("path"), rules=list(c.licence_rules), default=c.licence_default)
        return d.withColumn("licences", found)

    @cached_property
    def licence_assertions(self) -> DataFrame:
        return licences.assertions(self._governed, "version_id", "licences")

    @cached_property
    def acl_assertions(self) -> DataFrame:
        return access.acl_assertions(self._governed, "version_id", "acl")

    @cached_property
    def tenant_assertions(self) -> DataFrame:
        return access.tenant_assertions(self._governed, "version_id", "tenant")

    @cached_property
    def sources(self) -> DataFrame:
        """Active sources with what is declared of them, and tombstones of those that a previous build had."""
        c = self.config
        d = self.found.drop("content").withColumn("raw_artifact_ref", F.concat(F.lit("art_"), "content_hash"))
        g = self._governed.select(F.col("version_id").alias("v"), F.col("tenant.value").alias("declared_tenant"))
        d = d.join(g, d.version_id == g.v, "left").drop("v")
        acl = self.acl_assertions.select(F.col("subject_ref").alias("v"), F.col("id").alias("declared_acl_assertion_id"))
        d = d.join(acl, d.version_id == acl.v, "left").drop("v")
        if c.govern_licences:
            one = self.licence_assertions.where("effective").select(F.col("subject_ref").alias("v"), F.array("id").alias("license_assertion_ids"))
            d = d.join(one, d.version_id == one.v, "left").drop("v")
        if c.previous is not None:
            gone = tombstones(c.previous, self.found).select(*(x for x in c.previous.columns if x in d.columns))
            d = d.unionByName(gone, allowMissingColumns=True)
        return d

    @cached_property
    def _candidates(self) -> tuple[DataFrame, DataFrame]:
        found = chunking.candidates(self.elements, "parse_run_id", self.config.chunker, self.config.chunker_config)
        return chunking.without_empty(found, "parse_run_id")

    @cached_property
    def chunks(self) -> DataFrame:
        """Chunks with `contextualized`, their text as embedders see it, which is no part of a manifest."""
        kept, _ = self._candidates
        hashed = with_text_hash(with_text_hash(kept.where("error is null"), "text", "raw_hash"), "contextualized", "contextualized_hash")
        number = lambda name: F.col(name).cast("string")
        locator = json_object({
            "kind": F.lit('"document_span"'), "ordinal": number("ordinal"), "page_start": number("page_start"), "page_end": number("page_end"), "character_start": number("character_start"), "character_end": number("character_end"),
            "element_ids": json_strings(F.col("element_ids")), "heading_path": F.when(F.size("heading_path") > 0, json_strings(F.col("heading_path"))),
        })
        chunk_id = content_id("chunk", plain(F.col("parse_run_id")), plain(F.lit(self.config.chunker_hash)), locator, plain(F.col("raw_hash")))
        versions = self.outcomes.select("parse_run_id", F.col("version_id").alias("source_version_id"))
        place = F.struct(F.lit("document_span").alias("kind"), "page_start", "page_end", "heading_path", "element_ids", "character_start", "character_end", "ordinal").alias("locator")
        tokenizer = F.struct(F.lit("driftaudit-whitespace").alias("name"), F.lit("1").alias("revision")).alias("tokenizer")
        return cut(hashed.join(versions, "parse_run_id").select(chunk_id.alias("id"), "source_version_id", "parse_run_id", place, "raw_hash", "contextualized_hash", "token_count", tokenizer, "contextualized"))

    @cached_property
    def pii_assertions(self) -> DataFrame:
        """Scans of sources (their elements joined) and of chunks, each with the id of what was scanned as subject."""
        if self.config.pii is None:
            return recognizers.assertions(self.chunks.limit(0), "id", "contextualized")
        whole = self.outcomes.where("status = 'success'").select(F.col("version_id").alias("id"), F.array_join(F.transform("elements", lambda e: e["text"]), "\n\n").alias("contextualized"))
        return recognizers.assertions(whole.unionByName(self.chunks.select("id", "contextualized")), "id", "contextualized", self.config.pii)

    @cached_property
    def quality_assertions(self) -> DataFrame:
        """(id, type, subject_ref, code, n): empty chunks that were dropped, and contents that stand more than once in a run.

        The chunks of repeated contents are rows of `duplicate_chunks`, however many they are."""
        _, dropped = self._candidates
        empty = dropped.select(F.col("parse_run_id").alias("subject_ref"), F.lit("EMPTY_CHUNKS_DROPPED").alias("code"), F.col("n_dropped").alias("n"))
        twice = self.duplicate_chunks.groupBy(F.col("parse_run_id").alias("subject_ref")).agg(F.count("*").alias("n")).select("subject_ref", F.lit("DUPLICATE_CHUNK_CONTENT").alias("code"), "n")
        both = empty.unionByName(twice)
        return both.select(id_of_strings("quality", F.col("subject_ref"), F.col("code")).alias("id"), F.lit("QUALITY").alias("type"), "subject_ref", "code", "n")

    @cached_property
    def duplicate_chunks(self) -> DataFrame:
        """(parse_run_id, raw_hash, chunk_id) of the contents that a run has more than once."""
        many = self.chunks.groupBy("parse_run_id", "raw_hash").agg(F.count("*").alias("n")).where("n > 1")
        return self.chunks.join(many, ["parse_run_id", "raw_hash"], "left_semi").select("parse_run_id", "raw_hash", F.col("id").alias("chunk_id"))

    @cached_property
    def embeddings(self) -> DataFrame:
        """Embeddings of the chunks that aren't blocked; those whose embedding failed are in `warnings`."""
        return self._embedded.where("embedding_error is null and vector is not null").select("id", "chunk_id", "model", "dimension", "dtype", "normalization", "contextualized_hash", "vector_hash")

    @cached_property
    def _embedded(self) -> DataFrame:
        c = self.config
        model = c.provider.model if c.provider else embedding.Model()
        todo = self.chunks
        if c.provider is None:
            todo = todo.limit(0)
        elif c.pii is not None and c.blocked_types:
            stop = self.pii_assertions.where(recognizers.blocked(F.col("findings"), list(c.blocked_types), c.blocked_from)).select(F.col("subject_ref").alias("id"))
            todo = todo.join(stop, "id", "left_anti")
        slim = todo.select(F.col("id").alias("chunk_id"), "contextualized_hash", "contextualized")
        # kept: a provider is called once for each chunk, however often its vectors are read
        vectors = cut(c.provider.embed(slim, "contextualized")) if c.provider else slim.withColumns({"vector": F.lit(None).cast("array<double>"), "embedding_error": F.lit(None).cast("string")})
        eid = content_id("embedding", plain(F.col("chunk_id")), plain(F.col("contextualized_hash")), plain(F.lit(model.config_hash(c.normalization))))
        named = F.struct(F.lit(model.provider).alias("provider"), F.lit(model.name).alias("name"), F.lit(model.revision).alias("revision"))
        return vectors.select(
            eid.alias("id"), "chunk_id", named.alias("model"), F.lit(model.dimension).alias("dimension"), F.lit(model.dtype).alias("dtype"), F.lit(c.normalization).alias("normalization"), "contextualized_hash", vector_hash_f32("vector").alias("vector_hash"), "vector", "embedding_error",
        )

    @cached_property
    def warnings(self) -> DataFrame:
        """(code, subject): of the build as a whole."""
        failed = self._embedded.where("embedding_error is not null or vector is null").select(F.lit("EMBEDDING_FAILED").alias("code"), F.col("chunk_id").alias("subject"))
        if self.config.tenant_required:
            failed = failed.unionByName(access.missing_tenants(self._governed, "uri", "tenant").withColumnRenamed("uri", "subject"))
        return failed

    @cached_property
    def artifacts(self) -> DataFrame:
        """References to the raw and the parsed content of every source, each once."""
        raw = self.found.select("media_type", F.col("content_hash").alias("sha256"), F.col("size_bytes").cast("bigint").alias("size_bytes"), F.lit("restricted").alias("sensitivity"))
        parsed = self.outcomes.select(F.lit("application/vnd.driftaudit.elements+json").alias("media_type"), F.sha2(F.to_json("elements"), 256).alias("sha256"), F.octet_length(F.to_json("elements")).cast("bigint").alias("size_bytes"), F.lit("internal").alias("sensitivity"))
        both = raw.unionByName(parsed).dropDuplicates(["sha256"])
        return both.select(F.concat(F.lit("art_"), "sha256").alias("artifact_id"), "media_type", "sha256", "size_bytes", F.lit("none").alias("compression"), F.lit("none").alias("encryption"), F.concat(F.lit("artifacts/"), "sha256").alias("locator"), "sensitivity")

    def bind(self, target: str, scope: str) -> DataFrame:
        """Bindings of every embedding to a point of its own in a target, named after the chunk."""
        point = json_string(F.col("chunk_id"))
        return self.embeddings.select(content_id("binding", json_string(F.lit(target)), plain(F.col("id")), point).alias("id"), F.lit(target).alias("target"), F.lit(scope).alias("namespace"), point.alias("point_id"), F.col("id").alias("embedding_id"))

    def stage_counts(self) -> DataFrame:
        """(stage, input_count, output_count) of discovery, parsing, chunking and embedding."""
        n = {"sources": self.found, "parse_runs": self.outcomes, "chunks": self.chunks, "embeddings": self.embeddings}
        counted = reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n") for k, df in n.items()))
        wide = counted.agg(*(F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in n))
        rows = [("discover", "sources", "sources"), ("parse", "sources", "parse_runs"), ("chunk", "parse_runs", "chunks"), ("embed", "chunks", "embeddings")]
        return wide.select(F.inline(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(i).alias("input_count"), F.col(o).alias("output_count")) for s, i, o in rows))))

    def status(self) -> str:
        return "incomplete" if self.outcomes.where("status = 'fail'").limit(1).count() else "complete"

    def record(self) -> dict:
        """The build's own record, on the driver. The digest of the sources is made in order of uri by streaming them through it."""
        digest, first = hashlib.sha256(b"["), True
        active = self.sources.where("status = 'active'").select("uri", "content_hash").orderBy("uri", "content_hash")
        for r in active.toLocalIterator(prefetchPartitions=True):
            digest.update((("" if first else ",") + canonical({"uri": r.uri, "content_hash": r.content_hash})).encode())
            first = False
        digest.update(b"]")
        stages = [{"name": f"driftaudit.{r.stage}", "version": "1", "input_count": r.input_count, "output_count": r.output_count} for r in self.stage_counts().collect()]
        c = self.config
        return {"build_id": c.build_id, "status": self.status(), "source_snapshot_hash": digest.hexdigest(), "pipeline_config_hash": c.pipeline_hash, "started_at": c.created_at, "completed_at": c.created_at, "stages": stages, "warnings": [{"code": r.code, "context": {"subject": r.subject}} for r in self.warnings.orderBy("code", "subject").toLocalIterator()]}

    def manifest_chunks(self) -> DataFrame:
        """Chunks with the ids of what is asserted of them."""
        d = self.chunks.drop("contextualized")
        acl = self.acl_assertions.select(F.col("subject_ref").alias("source_version_id"), F.array("id").alias("acl_assertion_ids"))
        d = d.join(acl, "source_version_id", "left")
        if self.config.pii is not None:
            d = d.join(self.pii_assertions.select(F.col("subject_ref").alias("id"), F.array(F.col("id")).alias("pii_assertion_ids")), "id", "left")
        return d

    def tables(self) -> dict[str, DataFrame]:
        """The record lists of a manifest."""
        quality = self.quality_assertions.select("id", "type", "subject_ref", F.array(F.struct("code", F.struct(F.col("n").alias("count")).alias("context"))).alias("warnings"))
        assertions = [self.acl_assertions, self.tenant_assertions, quality]
        assertions += [self.licence_assertions.drop("effective")] if self.config.govern_licences else []
        assertions += [self.pii_assertions] if self.config.pii else []
        return {
            "sources": self.sources.drop("error").withColumn("source_system", F.lit("filesystem")), "parse_runs": self.parse_runs, "chunks": self.manifest_chunks(), "embeddings": self.embeddings, "artifacts": self.artifacts.withColumnRenamed("artifact_id", "id"),
            "assertions": reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), assertions),
        }
