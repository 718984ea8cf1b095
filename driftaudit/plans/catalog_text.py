"""Queries of parsing, chunking and licence operators over the table `documents`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftaudit.functions import ids, text
from driftaudit.operators import build, chunking, embedding, licences, parsing
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


_WS = r" \t\n\x0b\x0c\r"
_PARAS = f"""p as (select doc_id, list_filter(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10) || chr(10)), lambda x: regexp_replace(x, '^[{_WS}]+|[{_WS}]+$', '', 'g')), lambda x: x <> '') ps from documents where text is not null),
e as (select doc_id, unnest(range(len(ps)))::int ord, unnest(ps) text from p)"""
_TOKEN = r"[^\s\x{85}\x{a0}\x{b}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _elements(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("ord", "text"))


@query(f"with {_PARAS} select doc_id, ord, text from e")
def q_text_paragraphs(t: Tables) -> DataFrame:
    return _elements(t)


@query(f"with {_PARAS} select doc_id, ord, coalesce(sum(length(text) + 2) over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding), 0)::bigint as \"start\", length(text) as len from e")
def q_element_offsets(t: Tables) -> DataFrame:
    return chunking.offsets(_elements(t), "doc_id").select("doc_id", "ord", "start", (F.col("end") - F.col("start")).alias("len"))


@query(f"""with {_PARAS}, h as (select *, [case when text like '#%' then regexp_extract(text, '^#+') else left(text, 1) end] heading_path from e),
f as (select *, case when lag(heading_path) over w is null or lag(heading_path) over w <> heading_path then 1 else 0 end as brk from h window w as (partition by doc_id order by ord))
select doc_id, ord, (sum(brk) over (partition by doc_id order by ord) - 1)::int as section from f""")
def q_sections(t: Tables) -> DataFrame:
    path = F.array(F.when(F.col("text").startswith("#"), F.regexp_extract("text", "^#+", 0)).otherwise(F.left("text", F.lit(1))))
    return chunking.sections(_elements(t).withColumn("heading_path", path), "doc_id").select("doc_id", "ord", "section")


@query(f"select doc_id, coalesce(len(regexp_extract_all(text, '{_TOKEN}')), 0) n_tokens from documents")
def q_token_count(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.token_count(F.col("text")).alias("n_tokens"))


@query(f"""with {_PARAS}, n as (select *, len(regexp_extract_all(text, '{_TOKEN}')) n from e), o as (select *, coalesce(sum(n) over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding), 0)::bigint first from n),
l as (select *, first + n as last from o where n > 0), tot as (select doc_id, max(last) total from l group by 1), w as (select doc_id, unnest(range(0, (total - 1) // 48 + 1)) k from tot)
select w.doc_id, w.k as ordinal, string_agg(text, chr(10) || chr(10) order by ord) text, sum(n)::bigint token_count from w join l on l.doc_id = w.doc_id and l.first < w.k * 48 + 64 and l.last > w.k * 48 group by all""")
def q_line_windows(t: Tables) -> DataFrame:
    return chunking.line_windows(_elements(t), "doc_id", 64, 16)


def _with_path(t: Tables) -> DataFrame:
    return _elements(t).withColumn("heading_path", F.array(F.when(F.col("text").startswith("#"), F.col("text")).otherwise("")))


_SIZES = chunking.Sizes(max_tokens=128)
_OVERLAP = chunking.Sizes(max_tokens=128, overlap_tokens=24)


def _packed_sql(overlap: int) -> str:
    """Both packers as a recursion over the elements of all sections at once, whose state is the list of sizes in the open group."""
    tail = f"ns[coalesce(list_min(list_filter(range(1, len(ns) + 1), lambda i: list_sum(ns[i:]) <= {overlap})), len(ns) + 1):]" if overlap else "[]::bigint[]"
    return f"""with recursive {_PARAS}, h as (select *, case when text like '#%' then text else '' end as hp, len(regexp_extract_all(text, '{_TOKEN}'))::bigint n from e),
s as materialized (select doc_id, ord, hp, n, sum(case when prev is null or prev <> hp then 1 else 0 end) over (partition by doc_id order by ord) section from (select *, lag(hp) over (partition by doc_id order by ord) prev from h)),
f as (select doc_id, section, ord, true fresh, n, case when n > 128 then []::bigint[] else [n] end ns from s where (doc_id, ord) in (select (doc_id, min(ord)) from s group by doc_id, section) union all
select c.doc_id, c.section, c.ord, c.n > 128 or f.n > 128 or list_sum(f.ns) + c.n > 128, c.n, case when c.n > 128 then []::bigint[] when f.n > 128 then [c.n] when list_sum(f.ns) + c.n > 128 then list_append({tail.replace('ns', 'f.ns')}, c.n) else list_append(f.ns, c.n) end from f join s c on c.doc_id = f.doc_id and c.section = f.section and c.ord = f.ord + 1),
g as (select *, coalesce(lead(fresh) over (partition by doc_id, section order by ord), true) last from f),
k as (select doc_id, ord, 0 piece, list_sum(ns)::bigint n_tokens, len(ns)::int n_elements from g where last and n <= 128 union all select doc_id, ord, i, least(128, n - i * 128), 1 from (select doc_id, ord, n, unnest(range(0, (n + 127) // 128)) i from g where n > 128))
select doc_id, (row_number() over (partition by doc_id order by k.ord, piece) - 1)::int as ordinal, n_tokens, n_elements, s.hp heading from k join s using (doc_id, ord)"""


def _chunk_sizes(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "ordinal", text.token_count(F.col("text")).cast("bigint").alias("n_tokens"), F.size("element_ids").alias("n_elements"), F.coalesce(F.get("heading_path", F.lit(0)), F.lit("")).alias("heading"))


def _chunk_rows(found: DataFrame) -> DataFrame:
    """Candidates as rows that SQL can give too: where they begin and end, how many elements, what heading they are under."""
    return found.select("doc_id", "ordinal", "character_start", "character_end", F.size("element_ids").alias("n_elements"), F.coalesce(F.get("heading_path", F.lit(0)), F.lit("")).alias("heading"), F.length("text").alias("n_chars"))


@query(_packed_sql(0))
def q_chunks_hierarchical(t: Tables) -> DataFrame:
    return _chunk_sizes(chunking.hierarchical(_with_path(t), "doc_id", _SIZES))


@query(_packed_sql(24))
def q_chunks_hybrid(t: Tables) -> DataFrame:
    return _chunk_sizes(chunking.hybrid(_with_path(t), "doc_id", _OVERLAP))


@query(f"""with {_PARAS}, n as (select *, len(regexp_extract_all(text, '{_TOKEN}')) n, coalesce(sum(length(text) + 2) over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding), 0)::bigint pos from e), o as (select *, coalesce(sum(n) over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding), 0)::bigint first from n),
l as (select *, first + n as last from o where n > 0), tot as (select doc_id, max(last) total from l group by 1), w as (select doc_id, unnest(range(0, (total - 1) // 104 + 1)) k from tot)
select w.doc_id, (row_number() over (partition by w.doc_id order by w.k) - 1)::int as ordinal, min(pos)::int character_start, max(pos + length(text))::int character_end, count(*)::int n_elements, arg_min(case when text like '#%' then text else '' end, ord) heading, (sum(length(text)) + 2 * (count(*) - 1))::int n_chars
from w join l on l.doc_id = w.doc_id and l.first < w.k * 104 + 128 and l.last > w.k * 104 group by w.doc_id, w.k""")
def q_chunks_line_based(t: Tables) -> DataFrame:
    return _chunk_rows(chunking.line_based(_with_path(t), "doc_id", _OVERLAP))


@query(rf"""with {_PARAS}, tk as (select doc_id, ord, text, list_filter(string_split(regexp_replace(text, '[{_WS}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x1c-\x1f]+', ' ', 'g'), ' '), lambda x: x <> '') w from e),
k as (select doc_id, ord, w, unnest(range(0, (len(w) + 31) // 32)) piece from tk where len(w) > 0) select doc_id, ord, piece::int piece, array_to_string(w[piece * 32 + 1 : piece * 32 + 32], ' ') words from k""")
def q_oversized_split(t: Tables) -> DataFrame:
    p = chunking.split_tokens(_elements(t), "doc_id", 32)
    return p.select("doc_id", "ord", "piece", F.regexp_replace("text", F.lit(r"(?U)[\s\x1c-\x1f]+"), F.lit(" ")).alias("words"))


@query(f"with {_PARAS} select doc_id, ord, 'doc ' || doc_id || chr(10) || chr(10) || text || ' [' || ord || ']' as contextualized from e")
def q_contextualize(t: Tables) -> DataFrame:
    c = chunking.template_column("doc {doc}\n\n{text} [{ord}]", {"doc": F.col("doc_id").cast("string"), "text": F.col("text"), "ord": F.col("ord").cast("string")})
    return _elements(t).select("doc_id", "ord", c.alias("contextualized"))


def _parsed(t: Tables, media_type: str, body) -> DataFrame:
    d = t.documents.where("text is not null").select("doc_id", body.alias("body"), F.lit(media_type).alias("m"))
    return parsing.parse(d, "doc_id", "body", "m").select("doc_id", "status", "ord", "kind", "text", F.array_join("heading_path", " / ").alias("path"))


@query()
def q_markdown_elements(t: Tables) -> DataFrame:
    return _parsed(t, "text/markdown", F.col("text"))


# documents of known parts around a number, {0}, so that SQL can say what must come out
_MD = "# T{0}\n\nintro {0}\nmore\n\n## A\n- one\n2. two\n\nTable: c{0}\n\n| h | i |\n|---|:-:|\n| {0} | b |\n\n### B\n```py\nx = {0}\n\ny\n```\n| no table |\n\n## C\nend"
_MD_WANT = [
    ("title", "T{0}", "", None, None), ("paragraph", "intro {0} more", "T{0}", None, None), ("heading", "A", "T{0}", None, None), ("list_item", "one", "T{0} / A", None, None), ("list_item", "two", "T{0} / A", None, None),
    ("table", "h | i", "T{0} / A", "c{0}", "h | i"), ("table", "{0} | b", "T{0} / A", "c{0}", "h | i"), ("heading", "B", "T{0} / A", None, None), ("code", "x = {0}\n\ny", "T{0} / A / B", None, None), ("paragraph", "| no table |", "T{0} / A / B", None, None),
    ("heading", "C", "T{0}", None, None), ("paragraph", "end", "T{0} / C", None, None),
]
_HTML = "<title>Doc {0}</title><style>no</style><h1>T{0}</h1><p>in <b>bold</b> {0}</p><h3>A</h3><ul><li>one</li><li>two &amp; more</li></ul><pre>\nx  y\n</pre><table><caption>c{0}</caption><tr><th>h</th><th>i</th></tr><tr><td> {0} </td><td>b</td></tr></table><h2>B</h2>loose {0}"
_HTML_WANT = [
    ("paragraph", "Doc {0}", "", None, None), ("title", "T{0}", "", None, None), ("paragraph", "in bold {0}", "T{0}", None, None), ("heading", "A", "T{0}", None, None), ("list_item", "one", "T{0} / A", None, None), ("list_item", "two & more", "T{0} / A", None, None),
    ("code", "x  y", "T{0} / A", None, None), ("table", "h | i", "T{0} / A", "c{0}", "h | i"), ("table", "{0} | b", "T{0} / A", "c{0}", "h | i"), ("heading", "B", "T{0}", None, None), ("paragraph", "loose {0}", "T{0} / B", None, None),
]
_CSV = 'a,b\n\n{0},"x\ny"\n , \nlast,"q""q"\n'
_CSV_WANT = [("table", "a | b", "", None, "a | b"), ("table", "{0} | x\ny", "", None, "a | b"), ("table", 'last | q"q', "", None, "a | b")]
_JSON = '{"b":{"y":[1,null],"x":"{0}"},"a":"text {0}"}'
_JSON_WANT = [("paragraph", "text {0}", "a", None, None), ("paragraph", '{\n  "x": "{0}",\n  "y": [\n    1,\n    null\n  ]\n}', "b", None, None)]


def _want_sql(rows: list) -> str:
    def lit(x: str | None) -> str:
        if x is None:
            return "null"
        return " || doc_id || ".join("'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for p in x.split("{0}"))

    return " union all ".join(f"select doc_id, {i}::int ord, {lit(k)} kind, {lit(t)} text, {lit(p)} path, {lit(c)} caption, {lit(h)} header from documents" for i, (k, t, p, c, h) in enumerate(rows))


def _composed(name: str, media_type: str, template: str, want: list) -> None:
    """A query that parses a composed document per row of `documents`, and the SQL of the elements it must have."""

    def run(t: Tables) -> DataFrame:
        body = F.concat(*(x for i, p in enumerate(template.split("{0}")) for x in ([F.col("doc_id").cast("string")] if i else []) + [F.lit(p)]))
        d = t.documents.select("doc_id", body.alias("body"), F.lit(media_type).alias("m"))
        return parsing.parse(d, "doc_id", "body", "m").select("doc_id", "ord", "kind", "text", F.array_join("heading_path", " / ").alias("path"), F.col("table_caption").alias("caption"), F.col("table_header").alias("header"))

    run.__name__ = name
    query(_want_sql(want))(run)


_composed("q_markdown_parts", "text/markdown", _MD, _MD_WANT)
_composed("q_html_parts", "text/html", _HTML, _HTML_WANT)
_composed("q_csv_parts", "text/csv", _CSV, _CSV_WANT)
_composed("q_json_parts", "application/json", _JSON, _JSON_WANT)


@query("select doc_id, 0::int ord, 'title' kind, doc_id::varchar text, '' path from documents where text is not null")
def q_html_elements(t: Tables) -> DataFrame:
    """The first element of every text as an HTML document: its heading."""
    body = F.concat(F.lit("<html><body><h1>"), "doc_id", F.lit("</h1><p>"), F.replace(F.replace("text", F.lit("<"), F.lit("&lt;")), F.lit("\n\n"), F.lit("</p><p>")), F.lit("</p></body></html>"))
    return _parsed(t, "text/html", body).where("ord = 0").select("doc_id", "ord", "kind", "text", "path")


@query("select doc_id, 'success' status, 0::int ord, 'paragraph' kind, text, 'text' path from documents where text is not null")
def q_json_elements(t: Tables) -> DataFrame:
    return _parsed(t, "application/json", F.to_json(F.struct("text")))


@query(r"""select doc_id, 'success' status, 0::int ord, 'table' kind, 'id | text' text, '' path from documents where text is not null union all
select doc_id, 'success', 1, 'table', doc_id || ' | ' || regexp_replace(text, '^[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g'), '' from documents where text is not null""")
def q_csv_elements(t: Tables) -> DataFrame:
    return _parsed(t, "text/csv", F.concat(F.lit("id,text\n"), "doc_id", F.lit(',"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"\n')))


_HEADER = "(?i)SPDX-License-Identifier:\\s*([^\\n]+)"


@query("""with d as (select doc_id, case doc_id % 4 when 0 then '// SPDX-License-Identifier: MIT' || chr(10) when 1 then 'spdx-license-identifier:  Apache-2.0 OR MIT ' || chr(10) when 2 then repeat(chr(10), 25) || 'SPDX-License-Identifier: MIT' || chr(10) else '' end || text body from documents where text is not null)
select doc_id, nullif(trim(regexp_extract(array_to_string(string_split(replace(body, chr(13), chr(10)), chr(10))[1:20], chr(10)), '(?i)SPDX-License-Identifier:[ ]*([^\\n]+)', 1)), '') expression from d""")
def q_spdx_header(t: Tables) -> DataFrame:
    return _headed(t).select("doc_id", licences.spdx_header(F.col("body")).alias("expression"))


def _headed(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 4
    head = F.when(k == 0, "// SPDX-License-Identifier: MIT\n").when(k == 1, "spdx-license-identifier:  Apache-2.0 OR MIT \n").when(k == 2, "\n" * 25 + "SPDX-License-Identifier: MIT\n").otherwise("")
    return t.documents.where("text is not null").select("doc_id", F.concat(head, "text").alias("body"))


_EXPRESSIONS = ["MIT", "not a licence", "(MIT OR Apache-2.0) AND ISC", "GPL-2.0-only+", "MIT AND", "LGPL-3.0-or-later", "((0BSD))", "EPL-2.0", "MIT AND NOASSERTION", "GPL-2.0-only WITH anything", "AGPL-3.0-or-later OR (CC0-1.0 WITH MIT)", "NOASSERTION"]
_VALID = [True, False, True, True, False, True, True, False, False, False, True, True]


def _pick(k) -> object:
    return F.get(F.array(*map(F.lit, _EXPRESSIONS)), (k % len(_EXPRESSIONS)).cast("int"))


@query("select * from (values " + ", ".join(f"('{x}', {str(v).lower()})" for x, v in zip(_EXPRESSIONS, _VALID, strict=True)) + ") v(expression, ok) where exists (select 1 from documents)")
def q_spdx_valid(t: Tables) -> DataFrame:
    """The expressions that the other licence queries use, judged. The SQL states each verdict."""
    return t.documents.select(F.explode(F.array(*map(F.lit, _EXPRESSIONS))).alias("expression")).distinct().select("expression", licences.valid_expression(F.col("expression")).alias("ok"))


def _licensed(t: Tables) -> DataFrame:
    """Candidates of every document by all five ways: some documents have each, some none."""
    d = F.col("doc_id")
    c = licences.candidates(F.when(d % 6 == 0, _pick(d)), F.when(d % 7 == 0, _pick(d + 1)), F.when(d % 4 == 0, _pick(d + 2)), F.when(d % 3 == 0, _pick(d + 3)), F.concat(F.lit("docs/"), d.cast("string")), [("docs/*5", "ISC"), ("docs/1*", "MPL-2.0")], None)
    return licences.assertions(t.documents.select(d.cast("string").alias("subject"), c.alias("c")), "subject", "c")


_LIST = "[" + ", ".join(f"'{x}'" for x in _EXPRESSIONS) + "]"
_GOOD = "[" + ", ".join(f"'{x}'" for x, v in zip(_EXPRESSIONS, _VALID, strict=True) if v) + ", 'ISC', 'MPL-2.0']"
_ASSERTED = f"""c as (select doc_id, 0 p, 'user_assertion' m, {_LIST}[doc_id % 12 + 1] x from documents where doc_id % 6 = 0 union all select doc_id, 1, 'sidecar', {_LIST}[(doc_id + 1) % 12 + 1] from documents where doc_id % 7 = 0 union all
select doc_id, 2, 'frontmatter', case when doc_id % 4 = 0 then {_LIST}[(doc_id + 2) % 12 + 1] else {_LIST}[(doc_id + 3) % 12 + 1] end from documents where doc_id % 4 = 0 or doc_id % 3 = 0 union all
select doc_id, 3, 'path_rule', case when doc_id % 10 = 5 then 'ISC' else 'MPL-2.0' end from documents where doc_id % 10 = 5 or doc_id::varchar like '1%'),
k as (select * from c union all select doc_id, 4, 'repository_default', 'NOASSERTION' from documents where doc_id not in (select doc_id from c)),
j as (select doc_id, p, m, case when list_contains({_GOOD}, x) then x else 'NOASSERTION' end x from k),
i as (select *, 'lic_sha256_' || {b32("h")} id from (select *, sha256('["' || doc_id || '","' || m || '","' || x || '"]') h from j))"""


@query(f"with {_ASSERTED} select doc_id, id, m as \"method\", x as expression, p = min(p) over (partition by doc_id) effective, case when (select count(distinct z.x) from i z where z.doc_id = i.doc_id) > 1 then (select count(*) from i z where z.doc_id = i.doc_id) - 1 else 0 end n_conflicting from i")
def q_license_assertions(t: Tables) -> DataFrame:
    return _licensed(t).select(F.col("subject_ref").cast("bigint").alias("doc_id"), "id", "method", F.col("spdx_expression").alias("expression"), "effective", F.size("conflicting_assertion_ids").cast("bigint").alias("n_conflicting"))


@query(f"with {_ASSERTED} select doc_id, min_by(m, p) as \"method\", min_by(x, p) expression from j group by 1")
def q_license_effective(t: Tables) -> DataFrame:
    return licences.effective(_licensed(t)).select(F.col("subject_ref").cast("bigint").alias("doc_id"), "method", F.col("spdx_expression").alias("expression"))


@query(f"with {_ASSERTED} select doc_id, count(distinct x) n_expressions from j group by 1 having count(distinct x) > 1")
def q_license_conflicts(t: Tables) -> DataFrame:
    return licences.conflicts(_licensed(t)).select(F.col("subject_ref").cast("bigint").alias("doc_id"), "n_expressions")


def _built(t: Tables):
    """A build over the documents as text files, without personal data rules."""
    d = t.documents.where("text is not null").select(F.lit("docs").alias("namespace"), F.concat(F.lit("file:"), "doc_id", F.lit(".txt")).alias("uri"), F.lit("text/plain").alias("media_type"), F.octet_length("text").alias("size_bytes"), F.sha2("text", 256).alias("content_hash"), F.col("collected_at").alias("modified_at"), F.encode("text", "utf-8").alias("content"), F.lit("active").alias("status"))
    d = d.withColumn("id", ids.id_of_strings("source", F.col("namespace"), F.col("uri")))
    return build.Build(d.withColumn("version_id", ids.id_of_strings("version", F.col("id"), F.col("content_hash"))), build.BuildConfig("docs", "bld_1", "2026-01-01T00:00:00Z", chunker_config={"max_tokens": 128}, provider=embedding.Local(8)))


# all paragraphs of a text are one section: the greedy fold of a list of sizes
_BUILD_SQL = _packed_sql(0).replace("case when text like '#%' then text else '' end as hp", "'' as hp")


@query(f"""with c as ({_BUILD_SQL}), d as (select count(*) n from documents where text is not null), k as (select count(*) n from c)
select 'discover' stage, d.n input_count, d.n output_count from d union all select 'parse', d.n, d.n from d union all select 'chunk', d.n, k.n from d, k union all select 'embed', k.n, k.n from k""")
def q_build_stages(t: Tables) -> DataFrame:
    """Rows in and out of every stage of a build."""
    return _built(t).stage_counts()


@query(f"with c as ({_BUILD_SQL}) select doc_id, count(*) n_chunks, sum(n_tokens)::bigint n_tokens from c group by 1")
def q_build_chunks(t: Tables) -> DataFrame:
    """Chunks and their tokens of every document that a build has."""
    b = _built(t)
    doc = b.outcomes.select(F.regexp_extract("uri", r"(\d+)", 1).cast("bigint").alias("doc_id"), F.col("version_id").alias("source_version_id"))
    return b.chunks.join(doc, "source_version_id").groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("token_count").cast("bigint").alias("n_tokens"))


@query(f"""with {_PARAS}, x as (select doc_id, list_filter(list_transform(ps, lambda p: case when doc_id % 3 = 0 then ' ' else p end), lambda p: true) ps from p)
select count(*) filter (doc_id % 3 <> 0) n_kept, count(distinct doc_id) filter (doc_id % 3 = 0) n_documents, count(*) filter (doc_id % 3 = 0) n_dropped from (select doc_id, unnest(ps) t from x)""")
def q_drop_empty(t: Tables) -> DataFrame:
    """Candidates of white space only are dropped and counted by document."""
    e = _elements(t).select("doc_id", F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("text")).alias("text"))
    kept, dropped = chunking.without_empty(e, "doc_id")
    return kept.agg(F.count("*").alias("n_kept")).crossJoin(dropped.agg(F.count("*").alias("n_documents"), F.coalesce(F.sum("n_dropped"), F.lit(0)).alias("n_dropped")))  # one row each
