"""The general problems on small tables with every kind of dirt, against results worked out by hand."""

import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from driftaudit.functions.normalize import norm_hash, norm_id, point_key
from driftaudit.operators import copies, nested, orphans, snapshot_diff


def at(day, hour=0):
    return datetime(2026, 1, day, hour, tzinfo=timezone.utc)


HEADERS = "target_id string, scope string, snapshot_no int, snapshot_kind string, consistency_completeness string"
POINTS = "target_id string, scope string, snapshot_no int, point_id string, payload_hash string, source_id string, embedding_id string, observed_at timestamp, ord bigint, t string, h string, later string"


def headers(spark):
    return spark.createDataFrame([("t", "s", 1, "full", "complete"), ("t", "s", 2, "sample", "complete"), ("t", "s", 3, "full", "incomplete"), ("T ", "s", 4, "Full", "complete"), ("u", "s", 1, "full", "complete")], HEADERS)


def points(spark):
    rows = [
        ("t", "s", 1, '"a"', "sha256:AA", "s1", "e1", at(1), 1), ("t", "s", 1, '{"b":1,"a":2}', "bb", "s1", "e1", at(1), 2), ("t", "s", 1, "42", "cc", None, None, at(1), 3), ("t", "s", 1, '"gone"', "dd", "s1", "e4", at(1), 4),
        ("t", "s", 2, '"only-in-sample"', "zz", "s1", "e1", at(2), 5), ("t", "s", 3, '"only-in-incomplete"', "zz", "s1", "e1", at(3), 6),
        ("t", "s", 4, ' "\\u0061" ', "aa ", " S1", "E1 ", at(9), 7), ("t", "s", 4, '{"a": 2, "b": 1}', "xx", "s1", "e1", at(4), 8), ("t", "s", 4, '{"a":2,"b":1}', "bb", "s1", "e1", at(5), 9), ("t", "s", 4, "42", "cc", "s9", None, at(4), 10),
        ("t", "s", 4, '"42"', None, " ", None, at(4), 11), ("t", "s", 4, None, "qq", "s1", None, at(4), 12), ("t", "s", 4, "  ", "qq", "s1", None, at(4), 13), (None, None, 4, '"a"', "qq", "s1", None, None, 14), ("u", "s", 1, '"x"', "aa", "s1", "e1", at(1), 15),
        ("t", "s", 4, '"tie"', "old", "s1", None, at(4), 16), ("t", "s", 4, '"tie"', "new", "s1", None, at(4), 17), ("t", "s", 1, '"tie"', "new", "s1", None, None, 18),
    ]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], POINTS)


def test_point_keys(spark):
    df = spark.createDataFrame([('"point\\u002d1"',), (" 42 ",), ('"42"',), ('{"seq": 2, "doc":1}',), ('["hr" , 798]',), ("plain",), (" ",), (None,)], "p string")
    assert [r.k for r in df.select(point_key(F.col("p")).alias("k")).collect()] == ['"point-1"', "42", '"42"', '{"doc":1,"seq":2}', '["hr",798]', '"plain"', None, None]


def test_ids_and_hashes(spark):
    r = spark.range(1).select(norm_id(F.lit(" Ab\n")).alias("a"), norm_id(F.lit(" ")).alias("b"), norm_hash(F.lit("SHA256:AB ")).alias("c"), norm_hash(F.lit("")).alias("d")).first()
    assert tuple(r) == ("ab", None, "ab", None)


def test_snapshot_changes(spark):
    got = {tuple(r) for r in snapshot_diff.snapshot_changes(points(spark), headers(spark)).collect()}
    assert got == {("t", "s", 4, '"gone"', "removed"), ("t", "s", 4, '"42"', "added"), ("t", "s", 4, "42", "changed")}


def test_snapshot_changes_empty(spark):
    assert snapshot_diff.snapshot_changes(points(spark).limit(0), headers(spark)).count() == 0
    assert snapshot_diff.snapshot_changes(points(spark), headers(spark).limit(0)).count() == 0


def test_index_differences(spark):
    rows = [("b1", "t", "s", '"a"', "e1", "AA", at(1)), ("b2", "t", "s", '{"a":2,"b":1}', "old", "zz", at(1)), ("b3", "t", "s", '{"b":1,"a":2}', "e1", "zz", at(2)), ("b4", "t", "s", "42", "e9", "cc", at(1)), ("b5", "t", "s", '"lost"', "e1", "aa", at(1)), ("b6", "t", "s", None, "e1", "aa", at(1)), ("b7", "v", "s", '"x"', "e1", "aa", None)]
    bindings = spark.createDataFrame(rows, "id string, target string, namespace string, point_id string, embedding_id string, expected_payload_hash string, recorded_at timestamp")
    want = {
        ("t", "s", '{"a":2,"b":1}', "payload_hash"), ("t", "s", "42", "embedding_id"), ("t", "s", '"lost"', "missing_in_index"), ("t", "s", '"42"', "missing_in_manifest"), ("t", "s", '"tie"', "missing_in_manifest"),
        ("v", "s", '"x"', "missing_in_index"), ("u", "s", '"x"', "missing_in_manifest"),
    }
    for buckets in (1, 7, 4096):
        assert {tuple(r) for r in copies.index_differences(bindings, points(spark), headers(spark), buckets).collect()} == want


def test_equal_copies_have_no_unequal_cells(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).cast("string").alias("v"))
    side = copies.latest(df, {"k": F.col("k")}, {"v": F.col("v")}, F.lit(1))
    other = copies.latest(df.withColumn("v", F.when(F.col("k") == "77", "x").otherwise(F.col("v"))).repartition(5), {"k": F.col("k")}, {"v": F.col("v")}, F.lit(1))
    assert copies.unequal_cells(side, side, ["k"], ["v"], 64).count() == 0
    cell = copies.unequal_cells(side, other, ["k"], ["v"], 64).collect()
    assert len(cell) == 1 and cell[0].v and not cell[0].key
    assert [tuple(r) for r in copies.differences(side, other, ["k"], ["v"], buckets=64).collect()] == [("77", "v")]


def test_copies_with_unique_keys_shuffle_only_unequal_buckets(spark):
    df = spark.range(20000).select("id", (F.col("id") % 7).cast("string").alias("v"), F.lit("z").alias("bucket")).unionByName(spark.createDataFrame([(None, "x", "z")], "id bigint, v string, bucket string"))
    other = df.where("id <> 5").withColumn("v", F.when(F.col("id") == 77, None).otherwise(F.col("v")))
    for buckets in (None, 1, 4096):
        got = copies.copy_differences(df, other, {"id": F.col("id")}, {"v": F.col("v")}, buckets=buckets)
        assert {tuple(r) for r in got.collect()} == {(5, "missing_in_right"), (77, "v")}
    assert copies.copy_differences(df, df.limit(0), {"id": F.col("id")}, {"v": F.col("v")}).count() == 20000
    assert [copies.buckets_for(n) for n in (0, 10_000, 10**6, 10**12)] == [256, 256, 4096, copies.MAX_BUCKETS]


def test_parent_periods_are_merged(spark):
    spans = {0: [(i, None) for i in range(50)], 1: [(i, 90) for i in range(50)] + [(99, 95)], 2: [(1, 4), (3, 7), (7, 9), (11, 13), (2, 3), (11, 12)], 3: [(5, 5)]}
    rows = [(0, k, 0, a, b) for k, v in spans.items() for a, b in v]
    df = spark.createDataFrame(rows, "parent int, k1 bigint, k2 bigint, since bigint, until bigint")
    got = sorted((r.k1, r.since, r.until) for r in orphans.merged_periods(df).collect())
    assert got == [(0, 0, 2**62), (1, 0, 90), (2, 1, 9), (2, 11, 13)]
    for t in range(110):
        assert {k for k, a, b in got if a <= t < b} == {k for k, v in spans.items() if any(a <= t and (b is None or t < b) for a, b in v)}


def test_orphans(spark):
    kids = spark.createDataFrame(
        [("c1", "v1", at(10)), ("c2", "V2 ", at(10)), ("c3", "v3", at(10)), ("c4", "nowhere", at(10)), ("c5", None, at(10)), ("c6", " ", at(10)), ("c7", "v3", at(20)), ("C7 ", "v3", at(10)), (None, "nowhere", at(1)), ("c8", "v4", at(15)), ("c9", "v1", None), ("c4", "nowhere", at(10))],
        "id string, ref string, recorded_at timestamp",
    )
    parents = spark.createDataFrame([("v1", at(1), None), ("v2", at(1), at(5)), ("v3", at(12), None), ("v3", at(13), None), ("v4", at(1), at(5)), ("v4", at(14), at(16)), (None, at(1), None)], "id string, recorded_at timestamp, deleted_at timestamp")
    want = {("kids", "c2", "ref", "deleted", "2026-01"), ("kids", "c3", "ref", "late", "2026-01"), ("kids", "c4", "ref", "missing", "2026-01"), ("kids", "c7", "ref", "late", "2026-01")}
    for bound in (0, 1000):
        got = orphans.orphans([orphans.Child("kids", kids, {"ref": "p"})], [orphans.Parent("p", parents, "id")], bound).collect()
        assert {tuple(r) for r in got} == want and len(got) == 4
    none = orphans.orphans([orphans.Child("kids", kids, {"ref": "p"})], [orphans.Parent("p", parents.limit(0), "id")])
    assert {r.reason for r in none.collect()} == {"missing"}


def test_manifests(spark):
    chunk = {"id": "chk_1", "locator": json.dumps({"heading_path": ["A", "B"]}), "tokenizer": "ws@1"}
    body = {"build": {"build_id": "b1"}, "artifacts": {"artifact_id": "a1"}, "parse_runs": [{"id": "prs_1", "chunks": [{"id": "x"}, chunk]}], "extensions": {"deep": {"chunks": [{"id": "chk_2", "parse_run_id": "prs_9", "locator": {"heading_path": "lone"}, "tokenizer": {"name": "bpe"}}]}}}
    none = {"build": {"build_id": "b2"}, "sources": [{"extensions": {"crm": {"artifact_id": None}}}], "chunks": [{"id": "chk_3", "locator": None}]}
    bodies = [(1, json.dumps(body)), (2, json.dumps(json.dumps([none]))), (3, "﻿" + json.dumps({"artifacts": [{"artifact_id": "a2"}, {"artifact_id": "a3"}]})), (4, "not json"), (5, None), (6, ""), (7, json.dumps(body)[:-3])]
    deep = json.dumps({"artifacts": [{"artifact_id": "deep"}]})
    for _ in range(6):
        deep = " " + json.dumps(deep)
    bodies += [(8, deep), (9, '{"artifacts": [{"artifact_id": "old", "artifact_id": "new"}]}'), (10, '{"artifacts": [{"artifact_id": "x"}]} {"a": 1}'), (11, '{"artifacts": [{"artifact_id": "x", "n": NaN}]}'), (12, "3")]
    got = {tuple(r) for r in nested.manifest_records(spark.createDataFrame([(*b, "c") for b in bodies], "manifest_no bigint, body string, level string")).collect()}
    assert got == {
        (1, "artifact", "a1", "b1", 0), (1, "chunk", "chk_1", "prs_1", 1), (1, "heading", "A", "chk_1", 0), (1, "heading", "B", "chk_1", 1), (1, "tokenizer", "ws", "chk_1", 0),
        (1, "chunk", "chk_2", "prs_9", 0), (1, "heading", "lone", "chk_2", 0), (1, "tokenizer", "bpe", "chk_2", 0), (3, "artifact", "a2", None, 0), (3, "artifact", "a3", None, 1),
        (8, "artifact", "deep", None, 0), (9, "artifact", "new", None, 0),
    }


def test_flat_tables_keep_links(spark):
    df = spark.createDataFrame([(1, json.dumps({"x": [{"n": 1, "y": [{"m": "p"}, {"m": "q"}]}, {"n": 2, "o": {"z": True}}]}))], "id bigint, body string")
    schema = nested.merged_schema(df, "body")
    levels = nested.explode_levels(df, ["id"], "body", schema)
    parents = nested.flat_table(levels, schema, ("x", "[]"), ["id"])
    children = nested.flat_table(levels, schema, ("x", "[]", "y", "[]"), ["id"])
    rows = children.alias("c").join(parents.alias("p"), F.col("c.parent_id") == F.col("p.node_id")).select("p.n", "c.ordinal", "c.m").collect()
    assert {tuple(r) for r in rows} == {("1", 0, "p"), ("1", 1, "q")}
    assert {(r.n, r["o.z"]) for r in parents.collect()} == {("1", None), ("2", "true")}
