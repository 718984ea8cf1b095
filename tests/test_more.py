"""Hot keys in the positional match, policy findings, signatures, artifacts and reports."""

import pytest
from pyspark.sql import functions as F

from driftaudit.operators import artifacts, findings, matching, reports
from driftaudit.session import cut
from driftaudit.sources import signing


def test_hot_keys_are_ranked_in_parts(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") * 7919 % 100003).alias("pos"))
    ids_ = cut(df.orderBy("pos").repartitionByRange(7, "pos").sortWithinPartitions("pos").withColumn("pos", F.monotonically_increasing_id()))
    for d in (df, ids_):
        assert {tuple(r) for r in matching._ranked(d, "k", 50).select("pos", "rn").collect()} == {tuple(r) for r in matching._ranked(d, "k").select("pos", "rn").collect()}


def test_matches_are_the_same_by_any_way(spark):
    """Odd keys by broadcast, by shuffle, and everything through the rounds."""
    import random

    r = random.Random(3)
    rows = lambda n, p: [(f"{p}{i}", r.choice([None, *(f"k{j}" for j in range(n))]), r.choice(["e1", "e2", None, f"e{i}"]), r.choice(["c1", None, f"c{i}"]), i) for i in range(n)]
    schema = "binding_id string, point_key string, embedding_id string, chunk_id string, ord int"
    e, o = spark.createDataFrame(rows(150, "b"), schema), spark.createDataFrame(rows(150, "o"), schema)

    def brute():
        left_e, left_o, out = sorted(e.collect(), key=lambda x: x.ord), sorted(o.collect(), key=lambda x: x.ord), set()
        for level, key in enumerate(matching.LEVELS, 1):
            for side in (left_e, left_o):
                side.sort(key=lambda x: (x[key] is None, x[key] or ""))
            pairs = []
            for k in {x[key] for x in left_e if x[key]}:
                pairs += zip([x for x in left_e if x[key] == k], [x for x in left_o if x[key] == k])
            out |= {(level, a.ord, b.ord) for a, b in pairs}
            left_e, left_o = [x for x in left_e if x not in [a for a, _ in pairs]], [x for x in left_o if x not in [b for _, b in pairs]]
        return out | {(None, x.ord, None) for x in left_e} | {(None, None, x.ord) for x in left_o}

    want = brute()
    for bound in (0, 1000):
        got = matching.cascade(e, o, matching.rounds(e, o, broadcast_rows=bound))
        assert {(x.match_level, x.e_ord, x.o_ord) for x in got.collect()} == want


def test_ratios_are_the_same_from_the_sides(spark):
    from driftaudit.plans.fixture import Fixture

    x = Fixture(spark, "/root/testdata/sf0.001")
    one = findings.ratios(x.matched, x.findings).first()
    assert findings.ratios_of_sides(x.expected, x.observed, x.matched.where("match_level is null"), x.findings).first() == one and one.acl_compliance < 1


def test_policy_findings(spark):
    pairs = spark.createDataFrame([("b1", "p1", 1, ["a1", "a2"], ["l1", "l2"]), ("b2", "p2", 1, None, ["l2"])], "e_binding_id string, o_point_key string, match_level int, e_pii_assertion_ids array<string>, e_license_assertion_ids array<string>")
    pii = spark.createDataFrame([("a1", [("EMAIL", 0.95, 3), ("PHONE", 0.5, 9)])], "id string, findings array<struct<entity_type:string,confidence:double,start:int>>")
    got = {(r.subject_id, r.field, r.severity) for r in findings.pii_findings(pairs, pii, ["EMAIL"], max_confidence=0.4).collect()}
    assert got == {("b1", "pii:EMAIL:3", "critical")}
    assert findings.pii_findings(pairs, pii, ["EMAIL"]).count() == 0
    lic = spark.createDataFrame([("l1", 2, "MIT"), ("l2", 1, "NOASSERTION")], "id string, precedence int, spdx_expression string")
    assert {(r.subject_id, r.code) for r in findings.licence_findings(pairs, lic, ["MIT"]).collect()} == {("b1", "LICENSE_UNKNOWN"), ("b2", "LICENSE_UNKNOWN")}


def test_signatures(spark):
    private, public = signing.generate(spark)
    sig = signing.sign(spark, "ab" * 32, private, public, "me", "2026-01-01T00:00:00Z")
    keys = {signing.fingerprint(public): public}
    assert signing.verify(spark, "ab" * 32, [sig], keys) == ("VALID_TRUSTED", ["valid"])
    assert signing.verify(spark, "cd" * 32, [sig], keys)[0] == "INVALID"
    assert signing.verify(spark, "ab" * 32, [sig], {})[0] == "VALID_UNTRUSTED"


def test_artifacts(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(b"a",), (b"b",), (b"a",), (None,)], "content binary")
    artifacts.put(rows, "content", path)
    artifacts.put(rows, "content", path)
    assert spark.read.parquet(path).count() == 2 and artifacts.damaged(spark, path).count() == 0
    assert artifacts.listing(spark, path).agg(F.sum("size_bytes")).first()[0] == 2
    asked = spark.createDataFrame([("ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb",), ("00",)], "sha256 string")
    assert {tuple(r) for r in artifacts.exists(spark, path, asked).collect()} == {(asked.first()[0], True), ("00", False)}
    assert artifacts.get(spark, path, "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb") == b"a"


def test_reports(spark, tmp_path):
    assert "<script>" not in reports.reconciliation_page({"x": None}, {"high": 1}, "FAIL", [{"code": "<script>", "severity": "high", "subject_id": "s"}])
    with pytest.raises(Exception, match="secret-shaped"):
        reports.append_audit(spark.sql("select map('private-key', 'x') as metadata"), str(tmp_path / "log"))


def test_command_line(spark, tmp_path, capsys):
    import json

    from driftaudit import cli

    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("# Title\\n\\nSome words here.\\n\\nMail a@b.example.org".replace("\\\\n", "\\n"))
    (docs / "b.txt").write_text("plain text")
    (docs / "c.log").write_text("ignored")
    at = lambda n: str(tmp_path / n)
    assert cli.main(["init", str(docs), "--namespace", "kb"]) == 0 and cli.main(["init", str(docs)]) == cli.EXIT["invalid"]
    assert cli.main(["build", str(docs), str(docs / cli.CONFIG), at("m.json"), "--epoch", "1767225600", "--target", "main"]) == 0
    first = (tmp_path / "m.json").read_bytes()
    assert cli.main(["build", str(docs), str(docs / cli.CONFIG), at("m2.json"), "--epoch", "1767225600", "--target", "main"]) == 0
    strip = lambda b: {k: v for k, v in json.loads(b).items()}
    assert strip(first)["build"]["build_id"] == "bld_20260101T000000Z" and strip(first) == strip((tmp_path / "m2.json").read_bytes())
    assert cli.main(["validate", at("m.json")]) == 0
    (tmp_path / "bad.json").write_text('{"manifest_version": "1.0", "typo": 1}')
    assert cli.main(["validate", at("bad.json")]) == cli.EXIT["invalid"] and "unknown member typo" in capsys.readouterr().out
    assert cli.main(["key-generate", str(tmp_path)]) == 0 and cli.main(["sign", at("m.json"), str(tmp_path), "me", "--epoch", "0"]) == 0
    assert cli.main(["verify", at("m.json"), at("public.key")]) == 0 and cli.main(["verify", at("none.json"), at("public.key")]) == cli.EXIT["io"]
    assert cli.main(["report", "manifest", at("m.json"), "--html", at("m.html")]) == 0
    shown = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert shown["facets"]["source_status"] == {"active": 2} and shown["masked_examples"] == {"EMAIL_ADDRESS": "a***@b***.example.org"} and "<table>" in (tmp_path / "m.html").read_text()
    # what the manifest expects, seen without its last point and with a stranger
    bindings = strip(first)["index_bindings"]
    assert len(bindings) == strip(first)["statistics"]["embedding_count"] > 1
    from driftaudit.sources import snapshot

    rows = [(json.dumps(b["point_id"]), b["embedding_id"], "x", i) for i, b in enumerate(bindings[:-1])] + [('"stranger"', None, None, 99)]
    points = spark.createDataFrame(rows, "point_id string, embedding_id string, tenant string, ord int")
    snapshot.write_snapshot(points, at("s.zst"), {"target_id": "main", "scope": "main", "vector_dimensions": {"v": 32}}, "2026-01-01T00:00:00Z")
    (tmp_path / "p.json").write_text(json.dumps({"name": "p", "requirements": {"manifest_signature": "required"}, "findings": {"fail_on_severity": ["high"]}}))
    assert cli.main(["reconcile", at("m.json"), at("s.zst"), "--policy", at("p.json"), "--html", at("r.html"), "--json", at("r.json"), "--findings", at("f")]) == cli.EXIT["fail"]
    assert "verdict: FAIL" in capsys.readouterr().out and "of 2 findings" in (tmp_path / "r.html").read_text()
    assert {(r.code) for r in spark.read.parquet(at("f")).collect()} == {"MISSING_IN_INDEX", "UNVERIFIABLE_POINT"} and json.loads((tmp_path / "r.json").read_text())["policy"]["verdict"] == "FAIL"
    assert cli.main(["report", "snapshot", at("s.zst")]) == 0 and json.loads(capsys.readouterr().out)["observed_point_count"] == len(rows)
    # a snapshot of a target, and the rest of it
    (tmp_path / "t.json").write_text(json.dumps({"type": "snapshot", "path": at("s.zst")}))
    assert cli.main(["target-add", "one", at("t.json"), at("targets")]) == 0 and (tmp_path / "targets" / "one.json").exists()
    assert cli.main(["snapshot", at("t.json"), at("copy.zst")]) == 0 and json.loads((tmp_path / "copy.zst.checkpoint.json").read_text()) == {"checkpoint": "stranger"}
    assert cli.main(["snapshot", at("t.json"), at("copy.zst"), "--checkpoint", rows[0][0]]) == 0
    assert len(list(snapshot.read_points(at("copy.zst")))) == len(rows) - 1
    (tmp_path / "t.json").write_text('{"type": "table", "table": "x; drop", "primary_key": ["id"]}')
    assert cli.main(["target-add", "two", at("t.json"), at("targets")]) == cli.EXIT["invalid"]


def test_discovery_keeps_what_it_cannot_take(spark, tmp_path):
    from driftaudit.operators import discovery

    (tmp_path / "big.txt").write_text("x" * 100)
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "link.txt").symlink_to(tmp_path / "a.txt")
    got = {r.uri: (r.error, r.content_hash is None) for r in discovery.discover(spark, str(tmp_path), "ns", size_cap=50).collect()}
    assert got == {"file:a.txt": (None, False), "file:big.txt": ("INPUT_TOO_LARGE", True)}
    assert discovery.discover(spark, str(tmp_path), "ns", follow_links=True).count() == 3
