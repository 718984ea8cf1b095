"""Operators of the engine: identities, checks, matching, policy, parsing, sources, streaming."""

import base64
import hashlib
import hmac
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftaudit.functions import canonical, checks, ids, text
from driftaudit.operators import access, chunking, discovery, embedding, findings, licences, matching, parsing, policy, recognizers, reconcile
from driftaudit.sources import connectors, manifest, snapshot


def test_ids_equal_hashlib(spark):
    values = ["a", 'qu"ote', "back\\slash", "tab\tnl\n\x01", "ünï😀", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for r in df.select("v", ids.id_of_strings("source", F.lit("ns"), F.col("v")).alias("i")).collect():
        digest = hashlib.sha256(json.dumps(["ns", r.v], ensure_ascii=False, separators=(",", ":")).encode()).digest()
        assert r.i == "src_sha256_" + base64.b32encode(digest).decode().lower().rstrip("=")


def test_hmac(spark):
    r = spark.range(1).select(ids.hmac_sha256(b"key", F.lit("héllo")).alias("h")).first()
    assert r.h == hmac.new(b"key", "héllo".encode(), hashlib.sha256).hexdigest()


def test_canonical_numbers():
    assert [canonical.number(x) for x in (0.0, -0.0, 1.0, 1.5, 1e21, 1e-7, 1e-6, 123456789012345680000.0, -2.5e-9, 0.1)] == ["0", "0", "1", "1.5", "1e+21", "1e-7", "0.000001", "123456789012345680000", "-2.5e-9", "0.1"]
    with pytest.raises(ValueError):
        canonical.canonical(float("nan"))


@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(codec="utf-8")), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(st.characters(codec="utf-8"), max_size=4), x, max_size=3), max_leaves=8))
@settings(max_examples=80, deadline=None)
def test_canonical_is_stable(v):
    once = canonical.canonical(v)
    assert canonical.canonical(json.loads(once)) == once


def test_check_digits(spark):
    r = spark.range(1).select(checks.luhn_ok(F.lit("4111 1111 1111 1111")), checks.luhn_ok(F.lit("4111 1111 1111 1112")), checks.iban_ok(F.lit("GB82 WEST 1234 5698 7654 32")), checks.iban_ok(F.lit("GB82WEST12345698765433")), checks.tckn_ok(F.lit("10000000146")), checks.tckn_ok(F.lit("10000000147")), checks.ssn_ok(F.lit("666-12-3456")), checks.ssn_ok(F.lit("123-45-6789"))).first()
    assert tuple(r) == (True, False, True, False, True, False, False, True)


def side(spark, rows):
    return spark.createDataFrame([(f"b{o}", *r, o) for o, r in enumerate(rows)], "binding_id string, point_key string, embedding_id string, chunk_id string, source_version_id string, payload_hash string, ord int")


def test_cascade_pairs_duplicates_by_position(spark):
    e = side(spark, [("p1", "e1", "c1", None, None), ("p1", "e2", "c2", None, None), (None, "e3", "c3", None, None), ("p9", "e9", "c4", "v", None)])
    o = side(spark, [("p1", "x", "y", None, None), ("p7", "e3", "y", None, None), ("p8", "x", "c4", None, None), ("p1", "x", "y", None, None), ("p1", "x", "y", None, None)])
    got = {(r.match_level, r.e_ord, r.o_ord) for r in matching.cascade(e, o).collect()}
    assert got == {(1, 0, 0), (1, 1, 3), (2, 2, 1), (3, 3, 2), (None, None, 4)}
    dup = matching.duplicate_keys(e, o).collect()
    assert [(r.level, r.key, r.n) for r in dup] == [(1, "p1", 3)]


def test_findings_need_no_lists_of_points(spark):
    e = side(spark, [("p1", "e1", "c1", None, None), (None, "e3", "c3", None, None), (None, None, "c5", None, None)])
    o = side(spark, [("p1", "e0", "c0", None, None), ("p1", "e0", "c0", None, None), ("p8", "e3", "c0", None, None), ("p7", "e3", "c0", None, None), ("p9", "e9", "c9", None, None), ("p6", "e9", "c9", None, None)])
    done = matching.rounds(e, o)
    keys, members = matching.duplicate_keys(e, o, done), matching.duplicate_members(e, o, done)
    assert sorted(map(tuple, keys.collect())) == [(1, "p1", 2, "p1"), (2, "e3", 2, "p7")]
    assert sorted((r.level, r.key, r.point_key) for r in members.collect()) == [(1, "p1", "p1"), (1, "p1", "p1"), (2, "e3", "p7"), (2, "e3", "p8")]
    for df in (keys, members):
        assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()


RATIOS = "lineage_coverage double, acl_compliance double, stale_ratio double, orphan_ratio double, missing_ratio double"


def test_policy(spark):
    ratio = spark.createDataFrame([(0.9, None, 0.1, 0.0, None)], RATIOS)
    found = spark.createDataFrame([("TENANT_MISSING", "critical"), ("PAYLOAD_DRIFT", "medium"), ("LICENSE_UNKNOWN", "medium")], "code string, severity string")
    doc = {"name": "p", "requirements": {"lineage_coverage_min": 0.9, "manifest_signature": "required", "full_snapshot": "optional"}, "findings": {"fail_on_severity": ["high"], "warn_on_severity": []}, "access": {"acl_compliance_min": 0.5}, "drift": {"stale_ratio_max": 0.05, "missing_ratio_max": 0.1}, "licenses": {"unknown": "fail"}}
    doc["rules"] = [{"category": "severity", "threshold": 3, "comparator": "lt", "verdict_on_violation": "WARN"}, {"category": "count", "verdict_on_violation": "WARN"}, {"category": "pii", "taxonomy_codes": ["PAYLOAD_DRIFT"], "threshold": 1, "comparator": "gt", "verdict_on_violation": "FAIL"}]
    rules = policy.evaluate(policy.Policy.load(doc), ratio, found)
    assert {r["rule"]: r.verdict for r in rules.collect()} == {
        "requirements.manifest_signature": "FAIL", "requirements.lineage_coverage_min": "PASS", "findings.fail_on_severity": "PASS", "licenses.unknown": "FAIL", "access.acl_compliance_min": "INCONCLUSIVE", "drift.stale_ratio_max": "FAIL",
        "rules[0].severity": "WARN", "rules[1].count": "WARN", "rules[2].pii": "PASS",
    }
    assert policy.verdict(rules).first().verdict == "FAIL"
    signed = policy.evaluate(policy.Policy.load(doc), ratio, found, policy.Facts(manifest_signed=True)).where("rule = 'requirements.manifest_signature'")
    assert signed.first().passed and policy.verdict(rules.limit(0)).first().verdict == "PASS"


def test_policy_documents_are_checked():
    good = {"version": 1, "name": "p", "requirements": {}, "findings": {"fail_on_severity": []}}
    policy.Policy.load(good)
    assert policy.Policy.load("name: p\nrequirements: {}\nfindings:\n  fail_on_severity: [high]\n").get("findings", "fail_on_severity") == ["high"]
    for bad in ({"typo": 1}, {"version": 2}, {"name": ""}, {"findings": {"fail_on_severity": ["awful"]}}, {"findings": {}}, {"requirements": {"typo": 1}}, {"drift": {"stale_ratio_max": 2}}, {"rules": [{"category": "count"}]}, {"rules": [{"category": "x", "verdict_on_violation": "FAIL"}]}, {"rules": [{"category": "count", "verdict_on_violation": "FAIL", "taxonomy_codes": ["NOPE"]}]}, {"rules": [{"category": "count", "verdict_on_violation": "FAIL", "comparator": ">"}]}):
        with pytest.raises(policy.PolicyError):
            policy.Policy.load(good | bad)


def test_severities_and_actions(spark):
    assert findings.override("TENANT_MISSING", "high", "known case") == "high" and findings.override("PAYLOAD_DRIFT", "low") == "low"
    with pytest.raises(ValueError):
        findings.override("TENANT_MISSING", "high")
    got = {r.code: (r.action, r.destructive, r.n_findings, r.n_candidates) for r in findings.remediation_plan(spark.createDataFrame([("STALE_PARSE", "b1", "p1"), ("STALE_PARSE", "b1", "p2"), ("MANIFEST_INCOMPLETE", "bld", None), ("VECTOR_HASH_MISMATCH", "b2", "p"), ("EMBEDDING_MODEL_MISMATCH", "b2", "p"), ("TARGET_SCHEMA_DRIFT", None, None)], "code string, subject_id string, point_key string"), "t", "s").collect()}
    assert got == {"STALE_PARSE": ("reindex_source", False, 2, 1), "MANIFEST_INCOMPLETE": ("full_rebuild_required", True, 1, 1), "VECTOR_HASH_MISMATCH": ("review_required", False, 1, 1), "EMBEDDING_MODEL_MISMATCH": ("reindex_source", False, 1, 1), "TARGET_SCHEMA_DRIFT": ("full_rebuild_required", True, 1, 0)}


def test_whole_runs(spark):
    e = side(spark, [("p1", "e1", "c1", None, None)]).withColumns({"source_id": F.lit("s1"), "dimension": F.lit(4), "vector_hash": F.lit(None).cast("string"), "tenant": F.lit(None).cast("string"), "acl": F.array(F.lit("PUBLIC")), "pii_assertion_ids": F.array(F.lit("a1")), "license_assertion_ids": F.array(F.lit("l1"))})
    o = side(spark, [("p1", "e1", "c1", "v1", None)]).drop("binding_id").withColumns({"source_id": F.lit("s1"), "tenant": F.lit(None).cast("string"), "acl": F.array(F.lit("PUBLIC")), "dimensions": F.create_map(F.lit("d"), F.lit(4)), "vector_hashes": F.lit(None).cast("map<string,string>")})
    sources = spark.createDataFrame([("s1", "v0", 1), ("s1", "v1", 2)], "id string, version_id string, ord int")
    pii = spark.createDataFrame([("a1", [("EMAIL", 0.95, 3), ("PHONE", 0.5, 9)])], "id string, findings array<struct<entity_type:string,confidence:double,start:int>>")
    lic = spark.createDataFrame([("l1", 0, "MIT")], "id string, precedence int, spdx_expression string")
    p = policy.Policy.load({"name": "p", "requirements": {}, "findings": {"fail_on_severity": []}, "pii": {"deny": ["EMAIL", "PHONE"], "max_confidence_allowed": 0.6}, "licenses": {"deny": ["MIT"]}})
    run = reconcile.reconcile(e, o, sources, "t", "s", "bld_1", "incomplete", reconcile.Consistency.probed("best_effort_live", 3, 4), {4}, p, pii, lic)
    assert {(r.code, r.severity, r.subject_id) for r in run.findings.collect()} == {("PII_POLICY_VIOLATION", "critical", "b0"), ("LICENSE_POLICY_VIOLATION", "high", "b0"), ("MANIFEST_INCOMPLETE", "high", "bld_1"), ("SNAPSHOT_INCOMPLETE", "high", "t:s")}
    assert run.caveat["degraded_confidence"] and run.summary()["matched"] == 1 and not run.summary()["preflight_short_circuited"]
    stop = reconcile.reconcile(e, o, sources, "t", "s", target_dimensions={1024})
    assert stop.short_circuited and stop.summary()["by_severity"] == {"critical": 1} and stop.ratios.first().missing_ratio is None and stop.caveat["completeness"] == "incomplete"
    assert reconcile.Consistency.probed("x", None, 3).completeness == "complete"


def test_parsers():
    md = parsing.parse_markdown("---\nlicense: MIT\n---\n# A\n\ntext\nmore\n\n## B\n- item\n\n| h | i |\n|---|---|\n| 1 | 2 |\n\n```\ncode\n```\n# C\nx")
    assert md.front_matter == {"license": "MIT"}
    assert [(k, t) for k, t, *_ in md.elements] == [("title", "A"), ("paragraph", "text more"), ("heading", "B"), ("list_item", "item"), ("table", "h | i"), ("table", "1 | 2"), ("code", "code"), ("title", "C"), ("paragraph", "x")]
    assert [p for _, _, p, *_ in md.elements] == [[], ["A"], ["A"], *[["A", "B"]] * 4, [], ["C"]] and md.elements[5][4] == "h | i"
    assert parsing.parse_markdown("---\n- a\n---\nx").warnings[0][0] == "FRONTMATTER_NOT_A_MAPPING" and parsing.parse_markdown("---\na: [\n---\nx").warnings[0][0] == "FRONTMATTER_YAML_INVALID"
    html = parsing.parse_html("<title>T</title><h1>A &amp; B</h1><p>x <b>y</b></p><script>no</script><ul><li>i</li></ul><table><caption>C</caption><tr><th>h</th></tr><tr><td>1</td></tr></table><p>open<p>end").elements
    assert [(k, t) for k, t, *_ in html] == [("paragraph", "T"), ("title", "A & B"), ("paragraph", "x y"), ("list_item", "i"), ("table", "h"), ("table", "1"), ("paragraph", "open"), ("paragraph", "end")]
    assert html[5][3:] == ("C", "h") and html[1][2] == [] and html[2][2] == ["A & B"]
    assert [t for _, t, *_ in parsing.parse_csv('a,b\n\n"x\ny",2\n').elements] == ["a | b", "x\ny | 2"]
    assert [p for *_, p, _, _ in parsing.parse_json('[{"b":1,"a":2}, 3]').elements] == [["item 0"], ["item 1"]]


def test_csv_fields_of_any_length():
    assert [t for _, t, *_ in parsing.parse_csv("id,text\n1," + "x" * 200_000 + "\n").elements] == ["id | text", "1 | " + "x" * 200_000]


def test_parse_failures_are_rows(spark):
    def slow(text):
        while True:
            pass

    parsing.register_parser("test/slow", slow)
    df = spark.createDataFrame([(1, "{bad", "application/json"), (2, "x", "image/png"), (3, None, "text/plain"), (4, "x" * 5000, "text/plain"), (5, "x", "test/slow"), (6, "x", "application/pdf"), (7, "[" * 100_000, "application/json"), (8, "x", None)], "id bigint, body string, m string")
    got = {(r.id, r.status, (r.error or "").split(":")[0]) for r in parsing.parse(df, "id", "body", "m", parsing.Limits(max_input_bytes=200_000, max_output_bytes=1000, timeout_seconds=0.3)).collect()}
    parsing.PARSERS.pop("test/slow")
    assert got == {(1, "fail", "PARSE_ERROR"), (2, "fail", "NO_PARSER_AVAILABLE"), (4, "fail", "OUTPUT_TOO_LARGE"), (5, "fail", "TIMEOUT"), (6, "fail", "PDF_READER_NOT_INSTALLED"), (7, "fail", "TOO_MUCH"), (8, "fail", "NO_PARSER_AVAILABLE")}
    raw = spark.createDataFrame([(1, b"\xff\xfe", "text/plain"), (2, "é".encode(), "text/plain")], "id bigint, body binary, m string")
    assert {(r.id, r.status, r.text) for r in parsing.parse(raw, "id", "body", "m").collect()} == {(1, "fail", None), (2, "success", "é")}


def pieces(*sizes):
    return [chunking.Piece((), n, i, i, " ".join(["w"] * n)) for i, n in enumerate(sizes)]


def test_packing_groups():
    def groups(sizes, **kw):
        return [[p.tokens for p in g] for g in chunking.pack_section(pieces(*sizes), chunking.Sizes(**kw))]

    assert groups([5, 5, 5, 25, 2], max_tokens=10) == [[5, 5], [5], [10], [10], [5], [2]]
    assert groups([5, 5, 5, 2], max_tokens=10, overlap_tokens=5) == [[5, 5], [5, 5], [5, 2]]
    assert groups([9, 4, 8], max_tokens=10, overlap_tokens=4) == [[9], [4], [4, 8]]  # the tail counts, and is not checked again
    with pytest.raises(chunking.OversizedElement):
        groups([11], max_tokens=10, oversized_element_policy="fail")


def test_candidates(spark):
    rows = [("d", 0, "table", "h | i", ["A"], 3, "cap", "h | i"), ("d", 1, "table", "1 | 2", ["A"], 5, "cap", "h | i"), ("d", 2, "paragraph", "w " * 30, ["A"], None, None, None), ("d", 3, "paragraph", " ", ["B"], None, None, None), ("e", 0, "paragraph", "x y", None, None, None, None)]
    e = spark.createDataFrame(rows, "doc string, ord int, kind string, text string, heading_path array<string>, page int, table_caption string, table_header string")
    got = chunking.candidates(e, "doc", "hierarchical", {"max_tokens": 4, "contextualization_template": "{heading_path}: {text}"}).orderBy("doc", "ordinal").collect()
    assert [(r.doc, r.ordinal, r.element_ids, r.page_start, r.page_end) for r in got[:3]] == [("d", 0, ["e0"], 3, 3), ("d", 1, ["e1"], 5, 5), ("d", 2, ["e2"], None, None)]
    assert got[1].text == "h | i\n1 | 2" and got[1].contextualized == "A: h | i\n1 | 2" and got[1].token_count == 7 and got[0].table_caption == "cap"
    assert [r.text for r in got if r.element_ids == ["e2"]] == ["w w w w"] * 7 + ["w w"] and got[2].character_start == 14
    kept, dropped = chunking.without_empty(chunking.hierarchical(e, "doc", chunking.Sizes(max_tokens=4)), "doc")
    assert dropped.collect()[0].n_dropped == 1 and kept.count() == len(got) - 1
    failed = chunking.hybrid(e, "doc", chunking.Sizes(max_tokens=4, oversized_element_policy="fail")).where("error is not null").collect()
    assert [r.doc for r in failed] == ["d"]
    assert chunking.line_based(e, "doc", chunking.Sizes(max_tokens=4, overlap_tokens=1)).where("doc = 'e'").first().text == "x y"
    for bad in ({"max_tokens": 0}, {"max_tokens": 5, "overlap_tokens": 5}, {"min_tokens": -1}, {"target_tokens": 300}, {"oversized_element_policy": "cut"}, {"typo": 1}, {"max_tokens": True}, {"contextualization_template": "{secret}"}):
        with pytest.raises(ValueError):
            chunking.Sizes.load(bad)
    with pytest.raises(LookupError):
        chunking.candidates(e, "doc", config={"tokenizer_name": "gpt"})


def test_keys_beside_nulls_keep_their_digits(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(None, 0, "a b c", "text/plain"), (big, 0, "d e", "text/plain")], "id bigint, ord int, text string, m string").withColumn("heading_path", F.array(F.lit("h")))
    assert {r.id for r in parsing.parse(df, "id", "text", "m").collect()} == {None, big}
    assert {(r.id, r.text) for r in chunking.hybrid(df, "id", chunking.Sizes(max_tokens=2, overlap_tokens=1)).collect()} == {(None, "a b"), (None, "c"), (big, "d e")}
    assert {(r.id, r.text) for r in chunking.split_tokens(df, "id", 2).collect()} == {(None, "a b"), (None, "c"), (big, "d e")}


def test_ignore_rules(spark):
    df = spark.createDataFrame([("a.log",), ("x/a.log",), ("x/keep.log",), ("build/o",), ("src/build/o",)], "p string")
    got = [r.i for r in df.select(discovery.is_ignored(F.col("p"), ["*.log", "!keep.log", "/build/"]).alias("i")).collect()]
    assert got == [True, True, False, True, False]


def test_discover(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# x")
    (tmp_path / "sub" / "b").write_bytes(b"%PDF-1.4")
    (tmp_path / "c.log").write_text("x")
    got = {r.uri: r.media_type for r in discovery.discover(spark, str(tmp_path), "ns", ["*.log"]).collect()}
    assert got == {"file:a.md": "text/markdown", "file:sub/b": "application/pdf"}


def test_licence_expressions(spark):
    good = ["MIT", "MIT OR Apache-2.0", "(MIT OR Apache-2.0) AND BSD-3-Clause", "GPL-3.0-only+", "NOASSERTION", " MIT ", "((((MIT))))", "(MIT AND (ISC OR (0BSD)))"]
    bad = ["", "TotallyMadeUp-9", "(MIT OR Apache-2.0", "MIT AND", "AND MIT", "MIT MIT", "()", "MIT)", "MIT AND NOASSERTION", "GPL-2.0-only WITH Classpath-exception-2.0", "(MIT)(ISC)", None]
    got = spark.createDataFrame([(x,) for x in good + bad], "e string").select("e", licences.valid_expression(F.col("e")).alias("v")).collect()
    assert all(r.v is (r.e in good) for r in got)


def test_licence_sources(spark):
    side_files = {"MIT": "MIT", '{"spdx_expression": " ISC "}': "ISC", "spdx_expression: MIT\nother: 1": "MIT", "other: 1": None, "  ": None, None: None}
    assert {t: licences.sidecar_expression(t) for t in side_files} == side_files
    df = spark.createDataFrame([("s", "MIT", "bad one", "")], "subject string, user string, side string, front string")
    c = licences.candidates(F.col("user"), F.col("side"), F.col("front"), F.lit("ISC"), F.lit("a/b.md"), [("*.txt", "0BSD"), ("a/*", "0BSD")], "MPL-2.0")
    rows = licences.assertions(df.select("subject", c.alias("c")), "subject", "c").collect()
    assert [(r.method, r.spdx_expression, r.effective, len(r.conflicting_assertion_ids)) for r in rows] == [("user_assertion", "MIT", True, 4), ("sidecar", "NOASSERTION", False, 4), ("frontmatter", "ISC", False, 4), ("path_rule", "0BSD", False, 4), ("repository_default", "MPL-2.0", False, 4)]
    assert rows[0].id not in rows[0].conflicting_assertion_ids
    head = spark.createDataFrame([("x\r\n// SPDX-License-Identifier: MIT \r\n",), ("\n" * 20 + "SPDX-License-Identifier: MIT",), (None,)], "t string").select(licences.spdx_header(F.col("t")).alias("h"))
    assert [r.h for r in head.collect()] == ["MIT", None, None]


def test_recognizers(spark):
    text_ = "😀 Mail a.b@mail.example.com or +1 202-555-0143, card 4111 1111 1111 1111; SSN 123-45-6789 and 666-45-6789. TC 10000000146 10000000147 IBAN GB82WEST12345698765432 EMP-123456"
    df = spark.createDataFrame([(1, text_, "k"), (2, None, "k"), (3, "", "k")], "id int, t string, findings string")
    custom = recognizers.Custom.load('{"recognizers": [{"entity_type": "EMPLOYEE_ID", "pattern": "EMP-\\\\d{6}", "confidence": 0.7}]}')
    got = {r.id: r.f for r in recognizers.scan(df, "t", "f", custom).collect()}
    assert [(f.entity_type, f.confidence) for f in got[1]] == [("EMAIL_ADDRESS", 0.85), ("PHONE_NUMBER", 0.5), ("CREDIT_CARD", 0.9), ("US_SSN", 0.75), ("TR_TCKN", 0.9), ("IBAN", 0.9), ("EMPLOYEE_ID", 0.7)]
    assert all(text_[f.start : f.end] == f.value for f in got[1]) and got[2] == got[3] == []
    a = {r.subject_ref: r for r in recognizers.assertions(df, "id", "t", recognizers.ScanConfig(secret=b"k")).collect()}
    assert a[1].findings[0].masked_preview == "a.***@ma***.example.com" and a[3].status == "no_findings_detected" and text_[7:27] not in str(a[1])
    digest = hmac.new(ids.hkdf_sha256(b"k", b"driftaudit-value-digest-v1"), b"123-45-6789", hashlib.sha256).hexdigest()
    assert a[1].findings[3].value_hmac == digest
    assert recognizers.scan(spark.createDataFrame([("a" * 36,)], "t string"), "t", "f", [recognizers.Custom("X", "(a+)+b", 0.5, 0.3)]).first().f == []
    for bad in ("[1]", '{"recognizers": 1}', '{"recognizers": [{"pattern": "x"}]}', '{"recognizers": [{"entity_type": "x", "pattern": "("}]}', '{"recognizers": [{"entity_type": "x", "pattern": "y", "confidence": 2}]}'):
        with pytest.raises(ValueError):
            recognizers.Custom.load(bad)


def test_access(spark):
    df = spark.createDataFrame([("a/1",), ("b/2",), ("c",), ("d",)], "uri string")
    exact = spark.createDataFrame([("d", ["USER:x", "PUBLIC", "USER:x"])], "uri string, value array<string>")
    got = {r.uri: r.acl for r in access.expected_acl(df, "uri", access.Rules(exact, [("a/*", ["GROUP:g"]), ("b/?", [])])).collect()}
    assert got == {"a/1": ["GROUP:g"], "b/2": [], "c": None, "d": ["PUBLIC", "USER:x"]}
    for entry, reason in (("DENY:USER:x", "unsupported"), ("someone", "invalid")):
        with pytest.raises(Exception, match=reason):
            access.expected_acl(df, "uri", access.Rules(None, [("*", [entry])])).collect()
    tenants = access.expected_tenant(df, "uri", access.Rules(None, [("a/*", ("org", "one"))]))
    assert [r.tenant_value for r in access.tenant_assertions(tenants, "uri", "tenant").collect()] == ["one"] and access.missing_tenants(tenants, "uri", "tenant").count() == 3
    r = spark.range(1).select(checks.acl_projection(F.lit('["a",1]')).alias("a"), checks.acl_projection(F.lit('"u"')).alias("b"), checks.acl_projection(F.lit("null")).alias("c"), checks.tenant_projection(F.lit('{"value":"t"}')).alias("d"), checks.tenant_projection(F.lit("3")).alias("e")).first()
    assert tuple(r) == (["a", "1"], ["u"], None, "t", "3")


def test_vectors(spark):
    r = spark.range(1).select(text.vector_literal(F.lit("[1, 2.5]")).alias("a"), text.vector_literal(F.lit("[a]")).alias("b"), text.vector_literal(F.lit(" ")).alias("c"), text.as_float32(F.array(F.lit(0.1))).alias("d"), checks.mask_email(F.lit("jo@x.mail.org")).alias("e"), checks.luhn_ok(F.lit("4" * 25)).alias("f"), checks.tckn_ok(F.lit("100 000 001 46")).alias("g")).first()
    assert (r.a, r.b, r.c, r.e, r.f, r.g) == ([1.0, 2.5], None, [], "j***@x***.mail.org", False, True) and abs(r.d[0] - 0.1) < 1e-7 and r.d[0] != 0.1
    model = embedding.Model("p", "m", "1", 2)
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None), (4, "nan")], "id int, t string")

    def make():
        def call(texts):
            if "bad" in texts:
                raise embedding.ProviderError("down")
            return [[float("nan"), 0.0] if t == "nan" else [1.0, 0.5] for t in texts]

        return call

    got = {r.id: (r.vector, (r.embedding_error or "").split(":")[0]) for r in embedding.Called(model, make, batch=2).embed(df, "t").collect()}
    assert got == {1: ([1.0, 0.5], ""), 2: (None, "EMBEDDING_FAILED"), 3: (None, ""), 4: (None, "EMBEDDING_FAILED")}
    local = embedding.Local(4, 3).embed(df, "t").collect()
    assert abs(sum(x * x for x in local[0].vector) - 1) < 1e-6
    digest = hashlib.sha256(b"3:good" + (0).to_bytes(4, "big")).digest()
    raw = [int.from_bytes(digest[i : i + 4], "big") / 0xFFFFFFFF * 2 - 1 for i in range(0, 16, 4)]
    size = sum(x * x for x in raw) ** 0.5
    assert all(abs(a - b / size) < 1e-6 for a, b in zip(local[0].vector, raw, strict=True))
    imported = embedding.Imported(model).vectors(spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([float("inf"), 0.0],), (None,)], "v array<double>"), "v").collect()
    assert [r.embedding_error for r in imported] == [None, "VECTOR_DIMENSION", "VECTOR_NOT_FINITE", "VECTOR_MISSING"]
    with pytest.raises(embedding.NotAvailable):
        embedding.Unwired(model).embed(df, "t")


def test_snapshot_file_round_trip(spark, tmp_path):
    spark.dataSource.register(snapshot.SnapshotSource)
    df = spark.createDataFrame([(2, '{"a":1}', "h2", None, ["PUBLIC"]), (1, '"p"', "h1", "t", None)], "ord bigint, point_id string, payload_hash string, tenant string, acl array<string>")
    path = tmp_path / "s.zst"
    trailer = snapshot.write_snapshot(df, str(path), {"target_id": "t", "scope": "s"}, "2026-01-01T00:00:00Z")
    back = spark.read.format("snapshot").load(str(path)).orderBy("ord").collect()
    assert [(r.point_id, r.payload_hash, r.tenant, r.acl) for r in back] == [('"p"', "h1", "t", None), ('{"a":1}', "h2", None, ["PUBLIC"])]
    assert trailer["point_count"] == 2
    import zstandard

    plain = zstandard.ZstdDecompressor().stream_reader(path.read_bytes()).read()
    path.write_bytes(zstandard.ZstdCompressor().compress(plain.replace(b"h1", b"hX")))
    with pytest.raises(snapshot.SnapshotError):
        list(snapshot.read_points(str(path)))
    path.write_bytes(zstandard.ZstdCompressor().compress(plain[: plain.rindex(b'{"content_hash"')]))
    with pytest.raises(snapshot.SnapshotError):
        list(snapshot.read_points(str(path)))


PAGES = {None: ([{"id": 1, "payload": {"meta": {"src": "s1"}, "acl": "PUBLIC"}, "vector": [0.5, 1.0]}, {"id": "b", "payload": [1]}], 7), 7: ([{"id": 3, "payload": {"acl": ["A", 1]}, "vector": "x"}], None)}


def fake_transport(method, path, body):
    """A scroll interface; a module's function, for executors import it."""
    if method == "GET":
        return {"result": {"/collections/kb": {"config": {"params": {"vectors": {"size": 2}}}, "payload_schema": {"b": 1, "a": 1}, "points_count": 3}, "/aliases": {"aliases": [{"alias_name": "kb", "collection_name": "kb_v2"}]}}.get(path)}
    rows, following = PAGES[body.get("offset")]
    return {"result": {"points": rows, "next_page_offset": following}}


def test_scroll_pages_and_guards():
    calls, pauses = [], []

    def transport(method, path, body):
        calls.append(body.get("offset"))
        if len(calls) < 3:
            raise OSError("try again")
        return fake_transport(method, path, body)

    assert connectors._tried(transport, "POST", "/collections/kb/points/scroll", {}, 3, 0.1, pauses.append)["result"] and pauses == [0.1, 0.2]
    assert [r["id"] for r in connectors.scroll(fake_transport, "kb")] == [1, "b", 3] and [r["id"] for r in connectors.scroll(fake_transport, "kb", offset=7)] == [3]
    with pytest.raises(OSError):
        connectors._tried(lambda *_: (_ for _ in ()).throw(OSError()), "GET", "/aliases", None, 1, 0, lambda _: None)
    assert all(connectors.allowed_request("GET", p) for p in ("/", "/collections", "/collections/kb", "/aliases", "/collections/kb/aliases"))
    for method, path in (("DELETE", "/collections/kb"), ("POST", "/collections/kb/points"), ("GET", "/collections/kb/points/scroll"), ("GET", "/collections/../x"), ("GET", "/collections//x"), ("GET", "collections"), ("POST", "/collections/a?b/points/scroll")):
        assert not connectors.allowed_request(method, path)
    for sql in ("select 1; drop table x", "delete from x", "", "with x as (select 1) select * from x"):
        with pytest.raises(PermissionError):
            connectors.read_only(sql)


def test_target_configuration():
    make = connectors.TableTarget
    assert make("t", ["id"], {"tenant": "ten"}, {"a": [1, "x'y"], "b": True}).query() == "SELECT id, ten FROM t WHERE a IN (1, 'x''y') AND b = TRUE ORDER BY id"
    assert make("t", ["a", "b"], schema="s").query({"a": 1, "b": "x"}) == "SELECT a, b FROM s.t WHERE (a, b) > (1, 'x') ORDER BY a, b"
    for bad in (dict(table="t; drop"), dict(primary_key=[]), dict(columns={"x": "y"}), dict(columns={"tenant": "1a"}), dict(where={"a": []}), dict(where={"a": None}), dict(page=0), dict(vector_column="id"), dict(consistency="none"), dict(dsn_env="A-B")):
        with pytest.raises(connectors.ConfigError):
            make(**({"table": "t", "primary_key": ["id"]} | bad))
    with pytest.raises(connectors.ConfigError):
        make("t", ["a", "b"]).query({"a": 1})
    assert connectors.endpoint("https://h:1/p/") == "https://h:1/p"
    for url in ("ftp://h", "http://", "http://u:p@h", "http://h?q=1", "http://h#f"):
        with pytest.raises(connectors.ConfigError):
            connectors.endpoint(url)
    assert connectors.credential("X_Y", {"X_Y": "v"}) == "v"
    for name in ("X Y", "NOPE"):
        with pytest.raises(connectors.ConfigError):
            connectors.credential(name, {})


def test_scroll_target(spark):
    t = connectors.ScrollTarget("kb", "test_engine:fake_transport", {"source_id": "meta.src", "acl": "acl"}, pause=0)
    assert connectors.preflight(t, 2)["dimension_match"] and connectors.preflight(t, 3)["dimension_match"] is False
    assert t.inspect() == connectors.Schema("kb", {"default": 2}, "string_or_integer", 3, ("a", "b"), "kb_v2")
    points, done = t.scan(spark, vectors=True)
    got = {r.point_id: r for r in points.collect()}
    assert set(got) == {"1", '"b"', "3"} and got["1"].source_id == "s1" and got["1"].acl == ["PUBLIC"] and got["3"].acl == ["A", "1"] and done().completeness == "complete"
    assert got["1"].normalization_warnings == ["acl_not_list", "vector_retrieval_enabled"] and got["1"].vector_hashes == {"default": hashlib.sha256(b"[0.5,1]").hexdigest()} and got["1"].raw_locator == "scroll:kb#1"
    assert got['"b"'].normalization_warnings == ["payload_not_object", "missing_mapped_field:source_id", "missing_mapped_field:acl", "vector_retrieval_enabled", "vector_missing"] and "vector_shape_unrecognized" in got["3"].normalization_warnings
    assert got["1"].payload_hash == hashlib.sha256(b'{"acl":["PUBLIC"],"source_id":"s1"}').hexdigest() and got['"b"'].payload_hash == hashlib.sha256(b"{}").hexdigest()
    assert [r.point_id for r in t.read(spark, after=7).collect()] == ["3"]
    assert not connectors.preflight(connectors.ScrollTarget("kb", "test_engine:broken", pause=0, retries=0))["reachable"]


def broken(method, path, body):
    raise OSError("down")


def test_table_target(spark):
    spark.createDataFrame([(1, "x", "s1", "PUBLIC", "[1,2]", "t"), (2, "y", None, None, "oops", "t"), (3, "z", "s3", "U", None, "other")], "a int, b string, src string, acl string, vec string, ten string").createOrReplaceTempView("points_table")
    for name, rows, schema in (("pg_attribute", [(10, 2, "vec", 5)], "attrelid int, atttypmod int, attname string, atttypid int"), ("pg_class", [(10, 1, "points_table"), (11, 1, "idx_b")], "oid int, relnamespace int, relname string"), ("pg_namespace", [(1, "public")], "oid int, nspname string"), ("pg_type", [(5, "vector")], "oid int, typname string"), ("pg_index", [(10, 11)], "indrelid int, indexrelid int")):
        spark.createDataFrame(rows, schema).createOrReplaceTempView(name)
    t = connectors.TableTarget("points_table", ["a", "b"], {"source_id": "src", "acl": "acl"}, {"ten": ["t"]}, vector_column="vec", consistency="best_effort_paged", run=spark.sql)
    assert t.inspect() == connectors.Schema("points_table", {"vec": 2}, "composite", 2, ("idx_b",)) and t.estimate_count() == 2 and connectors.preflight(t, 2, "vec")["dimension_match"]
    points, done = t.scan(spark, vectors=True)
    got = {r.point_id: r for r in points.collect()}
    assert set(got) == {'{"a":1,"b":"x"}', '{"a":2,"b":"y"}'} and done().completeness == "complete"
    one, two = got['{"a":1,"b":"x"}'], got['{"a":2,"b":"y"}']
    assert one.acl == ["PUBLIC"] and one.vector_hashes == {"vec": hashlib.sha256(b"[1,2]").hexdigest()} and two.normalization_warnings == ["missing_mapped_field:source_id", "missing_mapped_field:acl", "vector_retrieval_enabled", "vector_shape_unrecognized"]
    assert [r.point_id for r in t.read(spark, after={"a": 1, "b": "x"}).collect()] == ['{"a":2,"b":"y"}']
    assert not connectors.TableTarget("nowhere", ["a"], run=spark.sql).test_connection(spark)[0]
    assert t.capabilities().resume and t.capabilities().modes == ("strict_consistent", "best_effort_paged")


def test_build(spark, tmp_path):
    from driftaudit.operators import build

    rows = [("a.md", "text/markdown", "---\nlicense: MIT\n---\n# T\n\none two\n\none two\n\nIBAN GB82WEST12345698765432 here"), ("b.txt", "text/plain", "// SPDX-License-Identifier: ISC\n\nplain words"), ("c.bin", "image/png", "x")]
    found = spark.createDataFrame([(f"file:{u}", m, t, i) for i, (u, m, t) in enumerate(rows)], "uri string, media_type string, t string, ord int").select("uri", "media_type", F.lit("ns").alias("namespace"), F.octet_length("t").alias("size_bytes"), F.sha2("t", 256).alias("content_hash"), F.current_timestamp().alias("modified_at"), F.encode("t", "utf-8").alias("content"), F.lit("active").alias("status"), "ord")
    found = found.withColumn("id", ids.id_of_strings("source", F.col("namespace"), F.col("uri"))).withColumn("version_id", ids.id_of_strings("version", F.col("id"), F.col("content_hash")))
    gone = found.limit(1).withColumns({"id": F.lit("src_gone"), "uri": F.lit("file:gone")}).drop("content")
    b = build.Build(found.drop("ord"), build.BuildConfig("ns", "bld_1", "2026-01-01T00:00:00Z", chunker_config={"max_tokens": 2}, provider=embedding.Local(4), pii=recognizers.ScanConfig(), blocked_types=("IBAN",), govern_licences=True, acl=access.Rules(None, [("a*", ["PUBLIC"])]), tenant=access.Rules(None, [("a*", ("org", "x"))]), tenant_required=True, previous=gone))
    chunks = b.chunks.collect()
    assert {r.raw_hash for r in chunks if r.locator.character_start is not None} and b.status() == "incomplete"
    assert [(r.code, r.n) for r in b.quality_assertions.collect()] == [("DUPLICATE_CHUNK_CONTENT", 2)] and b.duplicate_chunks.count() == 2
    blocked = [c.id for c in chunks if "GB82" in c.contextualized]
    assert len(blocked) == 1 and b.embeddings.count() == len(chunks) - 1
    assert {(r.code, r.subject) for r in b.warnings.collect()} == {("TENANT_REQUIRED_BUT_MISSING", "file:b.txt"), ("TENANT_REQUIRED_BUT_MISSING", "file:c.bin")}
    assert {r.method + ":" + r.spdx_expression for r in b.licence_assertions.collect()} == {"frontmatter:MIT", "frontmatter:ISC", "repository_default:NOASSERTION"}
    assert {(r.uri, r.status, r.declared_tenant) for r in b.sources.collect()} == {("file:a.md", "active", "x"), ("file:b.txt", "active", None), ("file:c.bin", "active", None), ("file:gone", "tombstone", None)}
    assert b.record()["stages"][0] == {"name": "driftaudit.discover", "version": "1", "input_count": 3, "output_count": 3}
    listed = [{"uri": r.uri, "content_hash": r.content_hash} for r in found.orderBy("uri").collect()]
    assert b.record()["source_snapshot_hash"] == hashlib.sha256(canonical.canonical(listed).encode()).hexdigest()
    one = next(c for c in chunks if c.id not in blocked)
    place = {k: v for k, v in one.locator.asDict().items() if v not in (None, [])}
    digest = hashlib.sha256(canonical.canonical([one.parse_run_id, b.config.chunker_hash, place, one.raw_hash]).encode()).digest()
    assert one.id == "chk_sha256_" + base64.b32encode(digest).decode().lower().rstrip("=")


def test_manifest_hash_ignores_signatures():
    m = {"a": 1, "b": None, "signatures": ["x"], "integrity": {"manifest_hash": "y"}}
    assert manifest.manifest_hash(m) == manifest.manifest_hash({"a": 1, "signatures": [], "integrity": {}})


def test_incremental_ingest(spark, tmp_path):
    from driftaudit.streaming import ingest

    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for n, total in ((5, 5), (0, 5), (3, 8)):
        if n:
            spark.range(n).write.mode("append").parquet(src)
        ingest.ingest_new(spark, "id bigint", src, out, cp).awaitTermination(60)
        assert spark.read.parquet(out).count() == total


def test_stages_compute_only_what_is_missing(spark, tmp_path):
    from driftaudit.streaming import ingest

    path, asked = str(tmp_path / "stage"), []

    def compute(todo):
        asked.append(sorted(r.k for r in todo.collect()))
        return todo.select("k", F.upper("v").alias("out"))

    for rows, new in (([("a", "x"), ("b", "y")], ["a", "b"]), ([("b", "y"), ("c", "z"), ("c", "z")], ["c", "c"]), ([("a", "x")], [])):
        got = ingest.stage(spark, spark.createDataFrame(rows, "k string, v string"), "k", path, compute)
        assert {(r.k, r.out) for r in got.collect()} == {(k, v.upper()) for k, v in rows} and asked[-1] == new


def test_event_windows_as_a_stream(spark, tmp_path):
    from driftaudit.streaming import ingest

    src = str(tmp_path / "events")
    rows = [("2026-01-01 10:00:00", "view", 1.0), ("2026-01-01 11:00:00", "view", 2.0), ("2026-01-02 09:00:00", "buy", 5.0), ("2026-01-05 00:00:00", "view", 1.0)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").write.parquet(src)
    stream = spark.readStream.schema("ts string, event_type string, value double").parquet(src)
    q = ingest.event_windows(stream).writeStream.format("memory").queryName("windows_test").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {(str(r.day), r.event_type, r.n, r.total) for r in spark.table("windows_test").collect()}
    assert {("2026-01-01 00:00:00", "view", 2, 3.0), ("2026-01-02 00:00:00", "buy", 1, 5.0)} <= got


def test_normalized_text(spark):
    df = spark.createDataFrame([("é\r\nx",), ("plain\r",), (None,)], "t string")
    assert {r.n for r in text.with_normalized(df, "t", "n").collect()} == {"é\nx", "plain\n", None}


def test_queries_equal_sql(spark):
    import __spark_entry__ as entry
    from compare import compare, duck

    folder = "/root/testdata/sf0.001"
    con, queries, sqls = duck(folder), entry.queries(), entry.oracle_sql()
    for name in ("q_reconcile_severity_counts", "q_ratios", "q_remediation_plan", "q_luhn", "q_sections", "q_line_windows", "p1_found", "p3_found", "p4_found"):
        said, same = compare(spark, con, name, folder, queries[name], sqls[name])
        assert same, said
