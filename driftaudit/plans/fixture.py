"""A reconciliation derived from the table `documents`: deterministic drift by divisibility of the document's id.

`Fixture` builds it with DataFrames, `FIXTURE_SQL` is the same arithmetic as common table expressions.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftaudit.functions.ids import content_id, id_of_strings, payload_hash, plain
from driftaudit.operators import findings, matching
from driftaudit.plans.tables import Tables
from driftaudit.session import cut

TARGET, SCOPE = "primary", "documents"
SECOND = 1_000_000_000


def _every(n: int) -> Column:
    return F.col("doc_id") % n == 0


class Fixture:
    def __init__(self, spark: SparkSession, folder: str):
        self.t = Tables(spark, folder)

    @cached_property
    def base(self) -> DataFrame:
        """Documents with the identities of their source, version, parse run, chunk, embedding and binding."""
        d = self.t.documents.where("text is not null").select(
            "doc_id", F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("unknown")).alias("namespace"), F.coalesce("lang", F.lit("und")).alias("lang"),
            F.concat(F.lit("file:documents/"), F.col("doc_id"), F.lit(".txt")).alias("uri"), F.sha2("text", 256).alias("content_hash"), F.concat(F.lit('"point-'), F.col("doc_id"), F.lit('"')).alias("point_key"),
        )
        c, lit = F.col, F.lit
        d = d.withColumn("source_id", id_of_strings("source", c("namespace"), c("uri")))
        d = d.withColumn("version_id", content_id("version", plain(c("source_id")), plain(c("content_hash"))))
        d = d.withColumn("parse_run_id", content_id("parse_run", plain(c("version_id")), plain(lit("parser-1"))))
        d = d.withColumn("chunk_id", content_id("chunk", plain(c("parse_run_id")), plain(lit("chunker-1")), lit('{"kind":"document_span","ordinal":0}'), plain(c("content_hash"))))
        d = d.withColumn("embedding_id", content_id("embedding", plain(c("chunk_id")), plain(c("content_hash")), plain(lit("embedding-1"))))
        d = d.withColumn("binding_id", content_id("binding", plain(lit(TARGET)), plain(c("embedding_id")), c("point_key")))
        acl = F.when(_every(7), None).when(_every(41), F.array().cast("array<string>")).when(_every(5), F.array(lit("PUBLIC"))).otherwise(F.array(F.concat(lit("GROUP:"), c("lang"))))
        d = d.withColumns({"acl": acl, "tenant": F.when(~_every(37), c("namespace")), "vector_hash": F.sha2(F.concat(lit("v"), c("doc_id")), 256)})
        # computed once: six ids, each hashed from the one before, would otherwise be inlined into every consumer's plan
        return cut(d.withColumn("payload_hash", payload_hash(c("acl"), c("chunk_id"), c("embedding_id"), c("source_id"), c("version_id"), c("tenant"))))

    @property
    def sources(self) -> DataFrame:
        return self.base.select(F.col("source_id").alias("id"), "version_id", "namespace", "uri", "content_hash", F.col("doc_id").alias("ord"))

    @cached_property
    def expected(self) -> DataFrame:
        b, c = self.base, F.col
        bindings = b.select(c("binding_id").alias("id"), F.lit(TARGET).alias("target"), F.lit(SCOPE).alias("namespace"), "point_key", "embedding_id", c("payload_hash").alias("expected_payload_hash"), "tenant", "acl", c("doc_id").alias("ord"))
        embeddings = b.select(c("embedding_id").alias("id"), "chunk_id", F.lit(4).alias("dimension"), "vector_hash", c("doc_id").alias("ord"))
        chunks = b.select(c("chunk_id").alias("id"), c("version_id").alias("source_version_id"), "parse_run_id", c("doc_id").alias("ord"))
        runs = b.select(c("parse_run_id").alias("id"), F.lit("plain").alias("parser_name"), c("doc_id").alias("ord"))
        # kept, as `reconcile` does: a match reads its expected side, which comes of four joins, several times
        return cut(matching.expected_points(bindings, embeddings, chunks, runs, self.sources, TARGET, SCOPE))

    @property
    def observed(self) -> DataFrame:
        c, lit = F.col, F.lit
        moved = lambda p, col, *ns: F.when(F.exists(F.array(*map(lit, ns)), lambda n: c("doc_id") % n == 0), F.concat(lit(p), c("doc_id"))).otherwise(c(col))
        acl = F.when(_every(43), F.array().cast("array<string>")).when(_every(11), F.concat(F.coalesce(c("acl"), F.array().cast("array<string>")), F.array(lit("USER:mallory")))).otherwise(c("acl"))
        key = F.when(F.greatest(_every(23), _every(29), _every(53)), F.concat(lit('"moved-'), c("doc_id"), lit('"'))).otherwise(c("point_key"))
        o = self.base.where(~_every(17)).select(
            key.alias("point_key"), moved("emb_moved_", "embedding_id", 29, 53).alias("embedding_id"), moved("chk_moved_", "chunk_id", 53).alias("chunk_id"), "source_id",
            F.when(_every(13), "ver_sha256_old").otherwise(c("version_id")).alias("source_version_id"), F.when(_every(59), "0" * 64).otherwise(c("payload_hash")).alias("payload_hash"),
            F.when(_every(47), None).when(_every(19), "tenant-x").otherwise(c("tenant")).alias("tenant"), acl.alias("acl"), F.create_map(lit("default"), F.when(_every(61), 8).otherwise(4)).alias("dimensions"),
            F.create_map(lit("default"), F.when(_every(67), "f" * 64).otherwise(c("vector_hash"))).alias("vector_hashes"), c("doc_id").alias("ord"),
        )
        twice = o.where("ord % 31 = 0").withColumn("ord", F.col("ord") + SECOND)
        s = c("s_suppkey")
        null = F.lit(None).cast("string")
        orphans = self.t.supplier.select(
            F.concat(lit('"orphan-'), s, lit('"')).alias("point_key"), null.alias("embedding_id"), F.when(s % 4 == 3, F.concat(lit("chk_lost_"), s)).alias("chunk_id"), F.when(s % 4 == 1, F.concat(lit("src_lost_"), s)).alias("source_id"), null.alias("source_version_id"), null.alias("payload_hash"), null.alias("tenant"),
            F.lit(None).cast("array<string>").alias("acl"), F.create_map(lit("default"), lit(4)).alias("dimensions"), F.lit(None).cast("map<string,string>").alias("vector_hashes"), (s + 2 * SECOND).alias("ord"),
        )
        return o.unionByName(twice).unionByName(orphans)

    @cached_property
    def rounds(self) -> matching.Rounds:
        return matching.rounds(self.expected, self.observed)

    @cached_property
    def matched(self) -> DataFrame:
        return matching.cascade(self.expected, self.observed, self.rounds)

    @cached_property
    def duplicates(self) -> DataFrame:
        return matching.duplicate_keys(self.expected, self.observed, self.rounds)

    @cached_property
    def findings(self) -> DataFrame:
        return findings.all_findings(self.matched, self.duplicates, self.sources, TARGET, SCOPE)


def b32(h: str) -> str:
    """SQL for the base-32 text of 64 hex digits in column h."""
    parts = "||".join(f"to_base(('0x'||substr({h}||'0',{i},{n}))::bigint,32,{n * 4 // 5})" for i, n in ((1, 15), (16, 15), (31, 15), (46, 15), (61, 5)))
    return f"translate({parts},'0123456789ABCDEFGHIJKLMNOPQRSTUV','abcdefghijklmnopqrstuvwxyz234567')"


def _cte(level: int, key: str, before: list[str]) -> str:
    order = ", ".join([*(f"{k} nulls last" for k in reversed(before)), "ord"])
    e, o = ("expected", "observed") if level == 1 else (f"el{level - 1}", f"ol{level - 1}")
    return f"""er{level} as materialized (select *, row_number() over (partition by {key} order by {order}) rn from {e} where {key} is not null),
or{level} as materialized (select *, row_number() over (partition by {key} order by {order}) rn from {o} where {key} is not null),
m{level} as materialized (select e.ord eo, o.ord oo from er{level} e join or{level} o on e.{key} = o.{key} and e.rn = o.rn),
el{level} as materialized (select * from {e} where ord not in (select eo from m{level})),
ol{level} as materialized (select * from {o} where ord not in (select oo from m{level}))"""


# a table expression per step, materialized: aliases of aliases would be inlined, and grow as a power of their uses
IDS_SQL = f"""b0 as materialized (select doc_id, coalesce(nullif(trim(source),''),'unknown') namespace, coalesce(lang,'und') lang, 'file:documents/'||doc_id||'.txt' uri, sha256(text) content_hash, '"point-'||doc_id||'"' point_key from documents where text is not null),
b1 as materialized (select *, sha256('["'||namespace||'","'||uri||'"]') h1 from b0),
b2 as materialized (select *, 'src_sha256_'||{b32("h1")} source_id from b1),
b3 as materialized (select *, sha256('["'||source_id||'","'||content_hash||'"]') h2 from b2),
b4 as materialized (select *, 'ver_sha256_'||{b32("h2")} version_id from b3),
b5 as materialized (select *, sha256('["'||version_id||'","parser-1"]') h3 from b4),
b6 as materialized (select *, 'prs_sha256_'||{b32("h3")} parse_run_id from b5),
b7 as materialized (select *, sha256('["'||parse_run_id||'","chunker-1",{{"kind":"document_span","ordinal":0}},"'||content_hash||'"]') h4 from b6),
b8 as materialized (select *, 'chk_sha256_'||{b32("h4")} chunk_id from b7),
b9 as materialized (select *, sha256('["'||chunk_id||'","'||content_hash||'","embedding-1"]') h5 from b8),
b10 as materialized (select *, 'emb_sha256_'||{b32("h5")} embedding_id from b9),
b11 as materialized (select *, sha256('["primary","'||embedding_id||'",'||point_key||']') h6,
  case when doc_id%7=0 then null when doc_id%41=0 then []::varchar[] when doc_id%5=0 then ['PUBLIC'] else ['GROUP:'||lang] end acl, case when doc_id%37<>0 then namespace end tenant, sha256('v'||doc_id) vector_hash from b10),
base as materialized (select *, 'idx_sha256_'||{b32("h6")} binding_id,
  sha256('{{'||array_to_string(list_filter([case when acl is not null then '"acl":['||coalesce(array_to_string(list_transform(acl, lambda a: '"'||a||'"'),','),'')||']' end,'"chunk_id":"'||chunk_id||'"','"embedding_id":"'||embedding_id||'"','"source_id":"'||source_id||'"','"source_version_id":"'||version_id||'"','"tenant":"'||tenant||'"'], lambda x: x is not null),',')||'}}') payload_hash
  from b11)"""

FIXTURE_SQL = f"""{IDS_SQL},
expected as materialized (select binding_id, point_key, embedding_id, chunk_id, version_id source_version_id, source_id, 4 dimension, vector_hash, payload_hash, tenant, acl, doc_id ord from base),
o1 as materialized (select case when doc_id%23=0 or doc_id%29=0 or doc_id%53=0 then '"moved-'||doc_id||'"' else point_key end point_key, case when doc_id%29=0 or doc_id%53=0 then 'emb_moved_'||doc_id else embedding_id end embedding_id,
  case when doc_id%53=0 then 'chk_moved_'||doc_id else chunk_id end chunk_id, source_id, case when doc_id%13=0 then 'ver_sha256_old' else version_id end source_version_id, case when doc_id%59=0 then repeat('0',64) else payload_hash end payload_hash,
  case when doc_id%47=0 then null when doc_id%19=0 then 'tenant-x' else tenant end tenant, case when doc_id%43=0 then []::varchar[] when doc_id%11=0 then list_concat(coalesce(acl,[]::varchar[]),['USER:mallory']) else acl end acl,
  case when doc_id%61=0 then 8 else 4 end dim, case when doc_id%67=0 then repeat('f',64) else vector_hash end vh, doc_id ord from base where doc_id%17<>0),
observed as materialized (select * from o1 union all select * replace (ord+1000000000 as ord) from o1 where ord%31=0 union all
  select '"orphan-'||s_suppkey||'"', null, case when s_suppkey%4=3 then 'chk_lost_'||s_suppkey end, case when s_suppkey%4=1 then 'src_lost_'||s_suppkey end, null, null, null, null, 4, null, s_suppkey+2000000000 from supplier),
{_cte(1, "point_key", [])},
{_cte(2, "embedding_id", ["point_key"])},
{_cte(3, "chunk_id", ["point_key", "embedding_id"])},
pairs as (select 1 match_level, * from m1 union all select 2, * from m2 union all select 3, * from m3),
pr as (select p.match_level, e.binding_id, o.point_key, e.source_version_id cur, o.source_version_id ov, e.chunk_id ec, o.chunk_id oc, e.dimension ed, o.dim od, e.vector_hash ev, o.vh ovh, nullif(e.tenant,'') et, nullif(o.tenant,'') ot, e.acl ea, coalesce(o.acl,[]::varchar[]) oa, e.payload_hash ep, o.payload_hash op
  from pairs p join expected e on e.ord=p.eo join observed o on o.ord=p.oo),
rl as materialized (select *, coalesce(ov<>cur,false) stale, not coalesce(ov<>cur,false) and coalesce(ec<>oc,false) chunking, et is not null and ot is null tm, coalesce(et<>ot,false) tx,
  coalesce(len(ea)>0 and len(oa)=0,false) am, coalesce(len(list_filter(oa, lambda x: not list_contains(ea,x)))>0,false) and not coalesce(len(ea)>0 and len(oa)=0,false) ab, coalesce(len(list_filter(ea, lambda x: not list_contains(oa,x)))>0,false) al from pr),
pf as (select match_level, binding_id subject_id, point_key, unnest(list_filter([case when stale then ['STALE_SOURCE','source_version_id'] end, case when chunking then ['STALE_CHUNKING','chunk_id'] end, case when ed<>od then ['EMBEDDING_DIMENSION_MISMATCH','dimension'] end,
  case when ev<>ovh then ['VECTOR_HASH_MISMATCH','vector_hash'] end, case when tm then ['TENANT_MISSING','tenant'] end, case when tx then ['TENANT_MISMATCH','tenant'] end, case when am then ['ACL_MISSING','acl'] end, case when ab then ['ACL_BROADER_THAN_SOURCE','acl'] end,
  case when al and not am and not ab then ['ACL_MISMATCH','acl'] end, case when coalesce(ep<>op,false) and not stale and not chunking and not am and not ab and not al and not tm and not tx then ['PAYLOAD_DRIFT','payload_hash'] end], lambda x: x is not null)) cf from rl),
orph as (select o.*, b.version_id cv from ol3 o left join base b using (source_id)),
dup as (select 1 lv, point_key k, count(*) n, list_sort(list(point_key)) pks from observed where point_key is not null and point_key in (select point_key from expected) group by point_key having count(*)>1
  union all select 2, embedding_id, count(*), list_sort(list(point_key)) from ol1 where embedding_id is not null and embedding_id in (select embedding_id from el1) group by embedding_id having count(*)>1
  union all select 3, chunk_id, count(*), list_sort(list(point_key)) from ol2 where chunk_id is not null and chunk_id in (select chunk_id from el2) group by chunk_id having count(*)>1),
f0 as materialized (select cf[1] code, cf[2] field, subject_id, point_key, match_level from pf union all
  select 'MISSING_IN_INDEX','point_id',binding_id,point_key,null from el3 union all
  select case when embedding_id is null and chunk_id is null and source_id is null and source_version_id is null then 'UNVERIFIABLE_POINT' when source_id is not null and cv is not null and source_version_id<>cv then 'STALE_SOURCE' when source_id is not null and cv is not null then 'STALE_CHUNKING' when source_id is not null then 'ORPHAN_IN_INDEX' when embedding_id is not null or chunk_id is not null then 'SOURCE_METADATA_MISSING' else 'ORPHAN_IN_INDEX' end,'point_id',point_key,point_key,null from orph union all
  select case when lv=1 then 'DUPLICATE_POINT_ID' else 'DUPLICATE_CONTENT' end, ['point_id','embedding_id','chunk_id'][lv], k, pks[1], lv from dup),
f1 as materialized (select *, case when code in ('DUPLICATE_POINT_ID','EMBEDDING_DIMENSION_MISMATCH','TENANT_MISSING','TENANT_MISMATCH','ACL_MISSING','ACL_BROADER_THAN_SOURCE') then 'critical' when code in ('DUPLICATE_CONTENT','PAYLOAD_DRIFT','SOURCE_METADATA_MISSING','LICENSE_UNKNOWN','UNVERIFIABLE_POINT') then 'medium' else 'high' end severity,
  sha256('["'||code||'","primary","documents",'||to_json(subject_id)::varchar||',"'||field||'"]') fh from f0),
findings as materialized (select 'fnd_sha256_'||{b32("fh")} fingerprint, code, severity, field, subject_id, point_key, match_level from f1)"""
