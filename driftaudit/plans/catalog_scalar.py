"""Queries of scalar operators: check digits, masks, access lists, vectors, aggregates over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftaudit.functions import checks, ids, text
from driftaudit.operators import access, discovery, embedding, recognizers
from driftaudit.operators.build import stage_key
from driftaudit.plans.fixture import b32
from driftaudit.plans.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("""with d as (select l_orderkey, l_linenumber, lpad((l_orderkey * 9973 + l_partkey)::varchar, 12, '4') || lpad((l_suppkey * 7)::varchar, 4, '0') card from lineitem)
select l_orderkey, l_linenumber, card, list_sum(list_transform(range(1, 17), lambda i: case when i % 2 = 0 then case when substr(reverse(card), i, 1)::int > 4 then substr(reverse(card), i, 1)::int * 2 - 9 else substr(reverse(card), i, 1)::int * 2 end else substr(reverse(card), i, 1)::int end)) % 10 = 0 ok from d""")
def q_luhn(t: Tables) -> DataFrame:
    card = F.concat(F.lpad((F.col("l_orderkey") * 9973 + F.col("l_partkey")).cast("string"), 12, "4"), F.lpad((F.col("l_suppkey") * 7).cast("string"), 4, "0"))
    d = t.lineitem.select("l_orderkey", "l_linenumber", card.alias("card"))
    return d.withColumn("ok", checks.luhn_ok(F.col("card")))


@query("""with d as (select o_orderkey, lpad((o_orderkey * 31337 + o_custkey)::varchar, 9, '0') s from orders)
select o_orderkey, s ssn, substr(s,1,3) not in ('000','666') and substr(s,1,1) <> '9' and substr(s,4,2) <> '00' and substr(s,6,4) <> '0000' and length(s) = 9 ok from d""")
def q_ssn(t: Tables) -> DataFrame:
    s = F.lpad((F.col("o_orderkey") * 31337 + F.col("o_custkey")).cast("string"), 9, "0")
    return t.orders.select("o_orderkey", s.alias("ssn")).withColumn("ok", checks.ssn_ok(F.col("ssn")))


@query("""with d as (select o_orderkey, lpad((o_orderkey * 7919 + o_custkey * 13)::varchar, 11, '1') s from orders),
e as (select *, list_transform(range(1, 12), lambda i: substr(s, i, 1)::int) g from d)
select o_orderkey, s tckn, g[1] <> 0 and ((g[1]+g[3]+g[5]+g[7]+g[9])*7 - (g[2]+g[4]+g[6]+g[8])) % 10 + case when ((g[1]+g[3]+g[5]+g[7]+g[9])*7 - (g[2]+g[4]+g[6]+g[8])) % 10 < 0 then 10 else 0 end = g[10] and list_sum(g[1:10]) % 10 = g[11] ok from e""")
def q_tckn(t: Tables) -> DataFrame:
    s = F.lpad((F.col("o_orderkey") * 7919 + F.col("o_custkey") * 13).cast("string"), 11, "1")
    return t.orders.select("o_orderkey", s.alias("tckn")).withColumn("ok", checks.tckn_ok(F.col("tckn")))


@query("""with d as (select o_orderkey, 'DE' || lpad((o_orderkey % 97)::varchar, 2, '0') || lpad((o_orderkey * 104729 + o_custkey)::varchar, 18, '0') s from orders)
select o_orderkey, s iban, list_reduce(list_prepend(0, list_transform(range(1, length(s) + 3), lambda i: substr(substr(s,5) || '1314' || substr(s,3,2), i, 1)::int)), lambda a, c: (a * 10 + c) % 97) = 1 ok from d""")
def q_iban(t: Tables) -> DataFrame:
    s = F.concat(F.lit("DE"), F.lpad((F.col("o_orderkey") % 97).cast("string"), 2, "0"), F.lpad((F.col("o_orderkey") * 104729 + F.col("o_custkey")).cast("string"), 18, "0"))
    return t.orders.select("o_orderkey", s.alias("iban")).withColumn("ok", checks.iban_ok(F.col("iban")))


#: The six patterns for DuckDB, whose engine has no look-around: digits before and after are matched as guards and cut off.
_SQL_PATTERNS = {
    "EMAIL_ADDRESS": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0, "true"),
    "PHONE_NUMBER": (r"(?:^|\P{Nd})((?:\+\p{Nd}{1,3}[-.\s]?)?\(?\p{Nd}{3}\)?[-.\s]\p{Nd}{3}[-.\s]\p{Nd}{4})(?:\P{Nd}|$)", 1, "true"),
    "CREDIT_CARD": (r"(?:^|\P{Nd})(\p{Nd}{4}[-\s]?\p{Nd}{4}[-\s]?\p{Nd}{4}[-\s]?\p{Nd}{1,7})(?:\P{Nd}|$)", 1, "luhn(d)"),
    "US_SSN": (r"(?:^|\P{Nd})(\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4})(?:\P{Nd}|$)", 1, "length(d) = 9 and substr(d,1,3) not in ('000','666') and substr(d,1,1) <> '9' and substr(d,4,2) <> '00' and substr(d,6) <> '0000'"),
    "TR_TCKN": (r"(?:^|\P{Nd})(\p{Nd}{11})(?:\P{Nd}|$)", 1, "substr(d,1,1) <> '0' and (((g[1]+g[3]+g[5]+g[7]+g[9])*7 - (g[2]+g[4]+g[6]+g[8])) % 10 + 10) % 10 = g[10] and list_sum(g[1:10]) % 10 = g[11]"),
    "IBAN": (r"\b[A-Z]{2}\p{Nd}{2}(?:[ ]?[A-Z0-9]{4}){2,7}[ ]?[A-Z0-9]{1,4}\b", 0, "length(c) between 15 and 34 and list_reduce(list_prepend(0, list_transform(string_split(substr(c,5) || substr(c,1,4), ''), lambda x: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', x) - 1)), lambda a, x: (a * case when x > 9 then 100 else 10 end + x) % 97) = 1"),
}
_LUHN = "length(d) between 13 and 19 and list_sum(list_transform(range(1, length(d) + 1), lambda i: case when i % 2 = 0 then case when substr(reverse(d), i, 1)::int > 4 then substr(reverse(d), i, 1)::int * 2 - 9 else substr(reverse(d), i, 1)::int * 2 end else substr(reverse(d), i, 1)::int end)) % 10 = 0"
_CONFIDENCE = {"EMAIL_ADDRESS": 0.85, "PHONE_NUMBER": 0.5, "CREDIT_CARD": 0.9, "US_SSN": 0.75, "TR_TCKN": 0.9, "IBAN": 0.9}


def _found_sql() -> str:
    """v(note_id, field_name, entity_type, x): the values of each recognizer. Of values apart by one character guards would
    take every other one, so the character is doubled first."""
    fields = " union all ".join(f"select note_id, '{f}' field_name, {f} t from contact_rows where {f} is not null" for f in ("notes", "contact_email", "text"))
    parts = []
    for name, (pattern, group, ok) in _SQL_PATTERNS.items():
        text = "t" if not group else "regexp_replace(t, '(\\P{Nd})', '\\1\\1', 'g')" if name == "TR_TCKN" else "t"
        parts.append(f"select note_id, field_name, '{name}' entity_type, x from (select *, regexp_replace(x, '[^0-9]', '', 'g') d, replace(upper(x), ' ', '') c, list_transform(string_split(regexp_replace(x, '[^0-9]', '', 'g'), ''), lambda q: try_cast(q as int)) g from (select note_id, field_name, unnest(regexp_extract_all({text}, '{pattern}', {group})) x from f)) where {ok.replace('luhn(d)', _LUHN)}")
    return f"f as ({fields}), v as materialized ({' union all '.join(parts)})"


def _found(t: Tables) -> DataFrame:
    return recognizers.values(t.contact_rows, "note_id", ["notes", "contact_email", "text"])


@query(f'with {_found_sql()} select note_id, field_name, entity_type, x as "value" from v')
def q_pii_values(t: Tables) -> DataFrame:
    return _found(t).select("note_id", "field_name", "entity_type", "value")


@query(f'with {_found_sql()} select note_id, field_name, entity_type, case entity_type {" ".join(f"when {chr(39)}{k}{chr(39)} then {c}" for k, c in _CONFIDENCE.items())} end::double confidence, x as "at_place" from v')
def q_pii_positions(t: Tables) -> DataFrame:
    """What stands at the places of the findings in the stored texts."""
    f = _found(t).join(t.contact_rows.select("note_id", "notes", "contact_email", "text"), "note_id")
    stored = F.when(F.col("field_name") == "notes", F.col("notes")).when(F.col("field_name") == "text", F.col("text")).otherwise(F.col("contact_email"))
    return f.select("note_id", "field_name", "entity_type", "confidence", F.substring(stored, F.col("start") + 1, F.col("end") - F.col("start")).alias("at_place"))


@query(f"""with {_found_sql()} select note_id, field_name, entity_type, x as "value", case when entity_type <> 'EMAIL_ADDRESS' then case when length(x) <= 4 then repeat('*', length(x)) else repeat('*', length(x) - 4) || right(x, 4) end
else left(l, case when length(l) > 2 then 2 else 1 end) || '***@' || left(h, case when length(h) > 2 then 2 else 1 end) || '***' || substr(host, length(h) + 1) end masked from (select *, split_part(host, '.', 1) h from (select *, split_part(x, '@', 1) l, split_part(x, '@', 2) host from v))""")
def q_pii_mask(t: Tables) -> DataFrame:
    return _found(t).select("note_id", "field_name", "entity_type", "value", recognizers.masked(F.col("entity_type"), F.col("value")).alias("masked"))


@query(f"with {_found_sql()} select entity_type, count(*) n, count(distinct x) n_distinct, count(distinct note_id) n_notes from v group by 1")
def q_pii_counts(t: Tables) -> DataFrame:
    return _found(t).groupBy("entity_type").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_distinct"), F.count_distinct("note_id").alias("n_notes"))


@query(f"with {_found_sql()}, n as (select note_id, count(*) n, max(case entity_type {' '.join(f'when {chr(39)}{k}{chr(39)} then {c}' for k, c in _CONFIDENCE.items())} end)::double top, bool_or(entity_type in ('IBAN', 'US_SSN')) blocked from v where field_name = 'notes' group by 1) select c.note_id, case when n > 0 then 'findings_detected' else 'no_findings_detected' end status, coalesce(n, 0) n_findings, top, coalesce(blocked, false) blocked from contact_rows c left join n using (note_id)")
def q_pii_assertions(t: Tables) -> DataFrame:
    a = recognizers.assertions(t.contact_rows.select(F.col("note_id").cast("string").alias("note_id"), "notes"), "note_id", "notes", recognizers.ScanConfig(secret=_KEY))
    top = F.array_max(F.transform("findings", lambda f: f["confidence"]))
    return a.select(F.col("subject_ref").cast("bigint").alias("note_id"), "status", F.size("findings").cast("bigint").alias("n_findings"), top.alias("top"), recognizers.blocked(F.col("findings"), ["IBAN", "US_SSN"], 0.5).alias("blocked"))


_KEY = b"audit-secret"


def _hmac_sql(x: str) -> str:
    key = _KEY.ljust(64, b"\0")
    pads = ["".join(f"\\x{b ^ p:02X}" for b in key) for p in (0x36, 0x5C)]
    return f"sha256('{pads[1]}'::blob || unhex(sha256('{pads[0]}'::blob || encode({x}))))"


@query(f"select c_custkey, {_hmac_sql('c_name')} digest from customer")
def q_pii_hmac(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", ids.hmac_sha256(_KEY, F.col("c_name")).alias("digest"))


@query("""with a as (select note_id, [upper(coalesce(kind,'PUBLIC')), 'GROUP:' || coalesce(region,'none'), 'PUBLIC', 'GROUP:' || coalesce(region,'none')] acl from contact_rows)
select note_id, array_to_string(list_sort(list_distinct(acl)), '|') acl, list_bool_and(list_transform(acl, lambda e: regexp_matches(e, '^(PUBLIC|(USER|GROUP|ROLE):.+|ATTRIBUTE:[^=]+=.+)$'))) valid from a""")
def q_acl_normalize(t: Tables) -> DataFrame:
    group = F.concat(F.lit("GROUP:"), F.coalesce("region", F.lit("none")))
    acl = F.array(F.upper(F.coalesce("kind", F.lit("PUBLIC"))), group, F.lit("PUBLIC"), group)
    d = t.contact_rows.select("note_id", acl.alias("a"))
    return d.select("note_id", F.array_join(checks.acl_normalized(F.col("a")), "|").alias("acl"), F.forall("a", checks.acl_valid).alias("valid"))


@query(f"""select c_custkey, array_to_string(list_sort(['PUBLIC', 'USER:masked:' || substr({_hmac_sql("c_name")},1,16), 'GROUP:masked:' || substr({_hmac_sql("c_mktsegment")},1,16)]), '|') masked from customer""")
def q_acl_mask(t: Tables) -> DataFrame:
    acl = F.array(F.lit("PUBLIC"), F.concat(F.lit("USER:"), "c_name"), F.concat(F.lit("GROUP:"), "c_mktsegment"))
    return t.customer.select("c_custkey", F.array_join(checks.acl_masked(acl, _KEY), "|").alias("masked"))


_DIRECT = "case when doc_id % 50 = 0 then ['ROLE:owner', 'PUBLIC', 'ROLE:owner']"


def _uris(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.concat(F.lit("docs/"), "doc_id", F.lit(".txt")).alias("uri"))


def _acl_rules(t: Tables) -> access.Rules:
    direct = _uris(t).where("doc_id % 50 = 0").select("uri", F.array(F.lit("ROLE:owner"), F.lit("PUBLIC"), F.lit("ROLE:owner")).alias("value"))
    return access.Rules(direct, [("docs/1*", ["GROUP:one"]), ("*5.txt", ["PUBLIC"]), ("docs/2*.txt", ["GROUP:two", "ROLE:auditor"]), ("docs/3[0-4]*", [])])


_ACL_SQL = f"""a as (select doc_id, list_sort(list_distinct({_DIRECT} when uri like 'docs/1%' then ['GROUP:one'] when uri like '%5.txt' then ['PUBLIC'] when uri like 'docs/2%.txt' then ['GROUP:two','ROLE:auditor'] when regexp_matches(uri, '^docs/3[0-4]') then []::varchar[] end)) acl from (select doc_id, 'docs/' || doc_id || '.txt' uri from documents))"""


@query(f"with {_ACL_SQL} select doc_id, acl is not null known, array_to_string(acl, '|') acl from a")
def q_expected_acl_rules(t: Tables) -> DataFrame:
    d = access.expected_acl(_uris(t), "uri", _acl_rules(t))
    return d.select("doc_id", F.col("acl").isNotNull().alias("known"), F.array_join("acl", "|").alias("acl"))


@query(f"""with {_ACL_SQL}, h as (select doc_id, sha256('[' || array_to_string(list_transform(acl, lambda x: '"' || x || '"'), ',') || ']') acl_hash from a where acl is not null) select doc_id, acl_hash, 'acl_sha256_' || {b32("i")} id from (select *, sha256('["' || doc_id || '","' || acl_hash || '"]') i from h)""")
def q_acl_assertions(t: Tables) -> DataFrame:
    d = access.expected_acl(_uris(t), "uri", _acl_rules(t)).select(F.col("doc_id").cast("string").alias("subject"), "acl")
    return access.acl_assertions(d, "subject", "acl").select(F.col("subject_ref").cast("bigint").alias("doc_id"), "acl_hash", "id")


_TENANT_SQL = "t as (select doc_id, case when doc_id % 40 = 0 then 'org' when uri like 'docs/3%' then 'team' when uri like '%7.txt' then 'org' end k, case when doc_id % 40 = 0 then 'direct' when uri like 'docs/3%' then 'tenant-a' when uri like '%7.txt' then 'tenant-b' end v from (select doc_id, 'docs/' || doc_id || '.txt' uri from documents))"


def _tenants(t: Tables) -> DataFrame:
    direct = _uris(t).where("doc_id % 40 = 0").select("uri", F.struct(F.lit("org").alias("key"), F.lit("direct").alias("value")).alias("value"))
    return access.expected_tenant(_uris(t), "uri", access.Rules(direct, [("docs/3*", ("team", "tenant-a")), ("*7.txt", ("org", "tenant-b"))]))


@query(f'with {_TENANT_SQL} select doc_id, k as "key", v as "value" from t')
def q_expected_tenant_rules(t: Tables) -> DataFrame:
    return _tenants(t).select("doc_id", "tenant.key", "tenant.value")


@query(f"""with {_TENANT_SQL} select doc_id, sha256('{{"key":"' || k || '","value":"' || v || '"}}') tenant_hash, 'tnt_sha256_' || {b32("i")} id from (select *, sha256('["' || doc_id || '","' || k || '","' || v || '"]') i from t where k is not null)""")
def q_tenant_assertions(t: Tables) -> DataFrame:
    d = _tenants(t).select(F.col("doc_id").cast("string").alias("subject"), "tenant")
    return access.tenant_assertions(d, "subject", "tenant").select(F.col("subject_ref").cast("bigint").alias("doc_id"), "tenant_hash", "id")


@query("""with d as (select doc_id, 'docs/' || doc_id || case doc_id % 5 when 0 then '.md' when 1 then '.html' when 2 then '.csv' when 3 then '.json' else '' end path, text from documents where text is not null)
select doc_id, case when path like '%.md' then 'text/markdown' when path like '%.html' then 'text/html' when path like '%.csv' then 'text/csv' when path like '%.json' then 'application/json' when lower(text) like '%<html%' then 'text/html' else 'text/plain' end media_type from d""")
def q_media_type(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 5
    path = F.concat(F.lit("docs/"), "doc_id", F.when(k == 0, ".md").when(k == 1, ".html").when(k == 2, ".csv").when(k == 3, ".json").otherwise(""))
    d = t.documents.where("text is not null").select("doc_id", path.alias("path"), F.encode("text", "utf-8").alias("content"))
    return d.select("doc_id", discovery.media_type(F.col("path"), F.col("content")).alias("media_type"))


@query(r"""select doc_id, path, case when regexp_matches(path, '^(?:.*/)?keep-[^/]*\.txt(?:/.*)?$') then false when regexp_matches(path, '^tmp/.*$') then true when regexp_matches(path, '^(?:.*/)?[^/]*7\.txt(?:/.*)?$') then true else false end ignored
from (select doc_id, case doc_id % 3 when 0 then 'tmp/' when 1 then 'docs/keep-' else 'docs/' end || doc_id || '.txt' path from documents)""")
def q_ignore_filter(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    path = F.concat(F.when(k == 0, "tmp/").when(k == 1, "docs/keep-").otherwise("docs/"), "doc_id", F.lit(".txt"))
    return t.documents.select("doc_id", path.alias("path")).withColumn("ignored", discovery.is_ignored(F.col("path"), ["*7.txt", "/tmp/", "!keep-*.txt"]))


@query("""select vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) + 0.0 as norm, round(list_sum(v), 6) + 0.0 as total from (select vec_id, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) v from embeddings)""")
def q_l2_normalize(t: Tables) -> DataFrame:
    v = t.embeddings.select("vec_id", text.l2_normalized(F.col("embedding")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return v.select("vec_id", (F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 6) + 0.0).alias("norm"), (F.round(total, 6) + 0.0).alias("total"))


@query("select vec_id, len(list_filter(embedding, lambda x: isnan(x) or isinf(x))) = 0 and len(embedding) = (select mode(len(embedding)) from embeddings) ok from embeddings")
def q_vector_finite(t: Tables) -> DataFrame:
    size = t.embeddings.agg(F.mode(F.size("embedding"))).first()[0]  # the dimension that a provider would declare
    return t.embeddings.select("vec_id", text.finite(F.col("embedding"), size).alias("ok"))


def _word(i: int) -> str:
    return f"round((('0x' || substr(h, {8 * i + 1}, 8))::bigint) / 4294967295.0 * 2.0 - 1.0, 9) + 0.0"


@query(f"""with b as (select c_custkey, counter, sha256(encode('7:' || c_name) || unhex(printf('%08x', counter))) h from customer, range(2) t(counter)) select c_custkey, counter * 8 + i as position, case i {' '.join(f'when {i} then {_word(i)}' for i in range(8))} end x from b, range(8) r(i)""")
def q_embedding_project(t: Tables) -> DataFrame:
    v = t.customer.select("c_custkey", F.posexplode(text.hash_embedding(F.col("c_name"), 7, 16)).alias("position", "x"))
    return v.select("c_custkey", F.col("position").cast("bigint").alias("position"), (F.round("x", 9) + 0.0).alias("x"))


_BYTES = "array_to_string(list_transform(embedding, lambda x: array_to_string(list_transform([25, 17, 9, 1], lambda i: lpad(to_base(list_reduce(list_prepend(0::bigint, list_transform(range(i, i + 8), lambda k: substr(x::float::bit::varchar, k, 1)::bigint)), lambda a, b: a * 2 + b), 16), 2, '0')), '')), '')"


@query(f"select vec_id, sha256(unhex({_BYTES})) hash from embeddings")
def q_vector_hash_f32(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", text.vector_hash_f32(F.col("embedding")).alias("hash"))


#: A double as ECMAScript prints it, from DuckDB's text: plain down to 1e-6, no zero in front of an exponent, no `.0`.
_ES = r"case when regexp_matches(s, 'e-0[56]$') then regexp_extract(s, '^-?') || '0.' || repeat('0', regexp_extract(s, 'e-0(.)$', 1)::int - 1) || regexp_replace(regexp_extract(s, '^-?(.*)e', 1), '\.', '') else regexp_replace(regexp_replace(s, '\.0$', ''), 'e([+-])0', 'e\1') end"


@query(f"select vec_id, sha256('[' || string_agg({_ES}, ',' order by i) || ']') hash from (select vec_id, unnest(embedding)::double::varchar s, unnest(range(len(embedding))) i from embeddings) group by vec_id")
def q_vector_hash_json(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", text.vector_hash_json(F.col("embedding").cast("array<double>")).alias("hash"))


@query("""select 'sources' facet, count(*) n, count(distinct version_id) n_keys from sources union all select 'parse_runs', count(*), count(distinct id) from parse_runs union all select 'chunks', count(*), count(distinct id) from chunks
union all select 'embeddings', count(*), count(distinct id) from embedding_records union all select 'index_bindings', count(*), count(distinct id) from index_bindings union all select 'warnings', coalesce(sum(len(warnings)), 0)::bigint, 0 from parse_runs""")
def q_manifest_stats(t: Tables) -> DataFrame:
    parts = [(t.sources, "sources", "version_id"), (t.parse_runs, "parse_runs", "id"), (t.chunks, "chunks", "id"), (t.embedding_records, "embeddings", "id"), (t.index_bindings, "index_bindings", "id")]
    out = t.parse_runs.agg(F.coalesce(F.sum(F.when(F.col("warnings").isNotNull(), F.size("warnings"))), F.lit(0)).cast("bigint").alias("n")).select(F.lit("warnings").alias("facet"), "n", F.lit(0).cast("bigint").alias("n_keys"))
    for df, name, key in parts:
        out = out.unionByName(df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_keys")).select(F.lit(name).alias("facet"), "n", "n_keys"))
    return out


@query("""select 'media_type' facet, media_type as "key", count(*) n from sources group by all union all select 'status', status, count(*) from sources group by all union all select 'parser', parser_name, count(*) from parse_runs group by all
union all select 'tokenizer', tokenizer."name", count(*) from chunks group by all union all select 'model', model."name", count(*) from embedding_records group by all union all select 'write_status', write_status, count(*) from index_bindings group by all""")
def q_manifest_facets(t: Tables) -> DataFrame:
    from functools import reduce

    facets = [(t.sources, "media_type", F.col("media_type")), (t.sources, "status", F.col("status")), (t.parse_runs, "parser", F.col("parser_name")), (t.chunks, "tokenizer", F.col("tokenizer.name")), (t.embedding_records, "model", F.col("model.name")), (t.index_bindings, "write_status", F.col("write_status"))]
    return reduce(DataFrame.unionByName, (df.groupBy(c.alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("facet"), "key", "n") for df, name, c in facets))


@query("""select 'vector_name' facet, v as "key", count(*) n from (select unnest(vector_names) v from observed_points) group by all union all select 'tenant', tenant, count(*) from observed_points group by all
union all select 'warning', w, count(*) from (select unnest(normalization_warnings) w from observed_points) group by all""")
def q_snapshot_facets(t: Tables) -> DataFrame:
    p = t.observed_points

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("key").agg(F.count("*").alias("n")).select(F.lit(name).alias("facet"), "key", "n")

    return count(p.select(F.explode("vector_names").alias("key")), "vector_name").unionByName(count(p.select(F.col("tenant").alias("key")), "tenant")).unionByName(count(p.select(F.explode("normalization_warnings").alias("key")), "warning"))


@query("select raw_locator, ord from observed_points order by ord limit 10")
def q_snapshot_first_locators(t: Tables) -> DataFrame:
    return t.observed_points.select("raw_locator", "ord").orderBy("ord").limit(10)


@query("""with g as (select parse_run_id, raw_hash, list_sort(list(distinct id)) ids from chunks where raw_hash is not null and parse_run_id is not null group by all having count(distinct id) > 1)
select parse_run_id, count(*) n_hashes, array_to_string(list_sort(list_distinct(flatten(list(ids)))), '|') chunk_ids from g group by parse_run_id""")
def q_duplicate_chunks(t: Tables) -> DataFrame:
    g = t.chunks.where("raw_hash is not null and parse_run_id is not null").groupBy("parse_run_id", "raw_hash").agg(F.collect_set("id").alias("ids")).where("size(ids) > 1")
    return g.groupBy("parse_run_id").agg(F.count("*").alias("n_hashes"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), "|").alias("chunk_ids"))


@query("""select namespace, sha256('[' || string_agg('{"content_hash":"' || content_hash || '","uri":' || to_json(uri)::varchar || '}', ',' order by uri, content_hash) || ']') snapshot_hash, count(*) n from (select distinct namespace, uri, content_hash from sources where status = 'active' and uri is not null and content_hash is not null) group by namespace""")
def q_source_snapshot_hash(t: Tables) -> DataFrame:
    s = t.sources.where("status = 'active' and uri is not null and content_hash is not null").select("namespace", "uri", "content_hash").distinct()
    item = F.concat(F.lit('{"content_hash":"'), "content_hash", F.lit('","uri":'), ids.json_string(F.col("uri")), F.lit("}"))
    return ids.ordered_digest(s.withColumn("item", item), "namespace", ["uri", "content_hash"], "item").withColumnRenamed("digest", "snapshot_hash")


@query("""with s as (select distinct namespace, sha256(content_hash || chr(10) || uri) h from sources where status = 'active' and uri is not null and content_hash is not null), p as (select namespace, substr(h, 1, 3) p, sha256(string_agg(h, '' order by h)) d, count(*) n from s group by all)
select namespace, sha256(string_agg(d, '' order by p)) digest, sum(n)::bigint n from p group by 1""")
def q_source_set_hash(t: Tables) -> DataFrame:
    """A digest of a namespace's sources that any number of tasks can make."""
    return ids.set_digest(t.sources.where("status = 'active' and uri is not null and content_hash is not null"), ["namespace"], F.sha2(F.concat("content_hash", F.lit("\n"), "uri"), 256))


@query("""select ord, sha256('{' || array_to_string(list_filter([case when chunk_id is not null then '"chunk_id":"' || chunk_id || '"' end, case when embedding_id is not null then '"embedding_id":"' || embedding_id || '"' end], lambda x: x is not null), ',') || '}') rehash from observed_points""")
def q_projection_rehash(t: Tables) -> DataFrame:
    """Points restricted to two payload fields, with their payload hash computed again."""
    members = {c: ids.plain(F.col(c)) for c in ("chunk_id", "embedding_id")}
    return t.observed_points.select("ord", F.sha2(ids.json_object(members), 256).alias("rehash"))


@query("""select id, sha256('["' || contextualized_hash || '","m1"]') cache_key from chunks c where contextualized_hash is not null and not exists (select 1 from embedding_records e where e.contextualized_hash = c.contextualized_hash)""")
def q_cache_misses(t: Tables) -> DataFrame:
    """Chunks whose contextualized text no embedding has yet: what an incremental build has to compute."""
    c = t.chunks.where("contextualized_hash is not null").join(t.embedding_records.select("contextualized_hash"), "contextualized_hash", "left_anti")
    return c.select("id", F.sha2(F.concat(F.lit('["'), "contextualized_hash", F.lit('","m1"]')), 256).alias("cache_key"))


@query("""with c as (select 'parse' s, id, raw_hash h from chunks where raw_hash is not null)
select id, sha256('{"adapter_name":"a","adapter_version":"1","config_hash":"c","input_hash":"' || h || '","stage":"' || s || '"}') cache_key from c""")
def q_stage_keys(t: Tables) -> DataFrame:
    """What a stage's output is kept under: all five fields."""
    return t.chunks.where("raw_hash is not null").select("id", stage_key("parse", F.col("raw_hash"), "a", "1", "c").alias("cache_key"))


@query("""select doc_id, sha256(replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), chr(13), chr(10))) text_hash from documents""")
def q_text_hash(t: Tables) -> DataFrame:
    """Texts in normal form, hashed: NFC, plain line ends, nothing trimmed."""
    return text.with_text_hash(t.documents, "text", "text_hash").select("doc_id", "text_hash")


@query("""select ord, case when point_id is null then null when json_valid(point_id) then json_type(point_id) end kind from observed_points""")
def q_point_kinds(t: Tables) -> DataFrame:
    """What point ids are as JSON: text and numbers are different points."""
    v = F.try_parse_json("point_id")
    kind = F.schema_of_variant(v)
    return t.observed_points.select("ord", F.when(kind.startswith("OBJECT"), "OBJECT").when(kind.startswith("ARRAY"), "ARRAY").when(kind == "STRING", "VARCHAR").when(kind == "BIGINT", F.when(F.to_json(v).startswith("-"), "BIGINT").otherwise("UBIGINT")).when(kind == "BOOLEAN", "BOOLEAN").when(kind == "VOID", "NULL").when(v.isNotNull(), "DOUBLE").alias("kind"))


@query("""select id, case when acl_projection is null or not json_valid(acl_projection) or json_type(acl_projection) = 'NULL' then null when json_type(acl_projection) = 'ARRAY' then array_to_string(list_transform(acl_projection::json::varchar[], lambda x: x), '|') else acl_projection->>'$' end acl,
acl_projection is not null and json_valid(acl_projection) and json_type(acl_projection) <> 'NULL' known from index_bindings""")
def q_acl_projection(t: Tables) -> DataFrame:
    """Access projections of bindings as lists; null stays null, which says something else than empty."""
    a = checks.acl_projection(F.col("acl_projection"))
    return t.index_bindings.select("id", F.array_join(a, "|").alias("acl"), a.isNotNull().alias("known"))


@query("""select vec_id, i as position, round(embedding[i + 1]::float::double, 9) + 0.0 x from embeddings, range(8) r(i)""")
def q_float32(t: Tables) -> DataFrame:
    """Imported vectors in 32-bit precision."""
    return t.embeddings.select("vec_id", F.posexplode(text.as_float32(F.col("embedding").cast("array<double>"))).alias("position", "x")).select("vec_id", F.col("position").cast("bigint").alias("position"), (F.round("x", 9) + 0.0).alias("x")).where("position < 8")


@query("""select vec_id, len(embedding) dim, round(list_sum(embedding::double[]), 4) + 0.0 total from embeddings""")
def q_vector_literal(t: Tables) -> DataFrame:
    """Vectors written as text and read again."""
    literal = F.concat(F.lit("["), F.array_join(F.transform(F.col("embedding").cast("array<double>"), lambda x: x.cast("string")), ", "), F.lit("]"))
    v = text.vector_literal(literal)
    return t.embeddings.select("vec_id", F.size(v).cast("bigint").alias("dim"), (F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4) + 0.0).alias("total"))


@query("""with w as (select vec_id, case when vec_id % 11 = 0 then embedding[1:3] when vec_id % 13 = 0 then list_append(embedding[1:len(embedding)-1], 'inf'::float) else embedding end v, (select mode(len(embedding)) from embeddings) d from embeddings)
select vec_id, case when vec_id % 17 = 0 then 'VECTOR_MISSING' when len(list_filter(v, lambda x: isnan(x) or isinf(x))) > 0 then 'VECTOR_NOT_FINITE' when len(v) <> d then 'VECTOR_DIMENSION' end error from w""")
def q_vector_import(t: Tables) -> DataFrame:
    """Vectors from elsewhere: some absent, cut off or infinite."""
    e, n = F.col("embedding").cast("array<double>"), F.col("vec_id")
    d = t.embeddings.agg(F.mode(F.size("embedding"))).first()[0]
    v = F.when(n % 17 == 0, None).when(n % 11 == 0, F.slice(e, 1, 3)).when(n % 13 == 0, F.array_append(F.slice(e, F.lit(1), F.size(e) - 1), F.lit(float("inf")))).otherwise(e)
    return embedding.Imported(embedding.Model(dimension=d)).vectors(t.embeddings.select("vec_id", v.alias("v")), "v").select("vec_id", F.col("embedding_error").alias("error"))


@query("""select time_bucket(interval '1 day', ts) as day, event_type, count(*) n, round(sum(value), 4) + 0.0 as total from events group by all""")
def q_events_daily(t: Tables) -> DataFrame:
    """The batch form of the event window that streaming.events runs incrementally."""
    return t.events.groupBy(F.window(F.col("ts"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), (F.round(F.sum("value"), 4) + 0.0).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")
