"""Differences between two copies of a dataset.

Method: a matrix of checksums, one row per key bucket and one cell per column, locates the buckets and columns that
differ; only the rows of those are joined, and only those columns are compared. A cell is the sum of 128-bit hashes of
(key, value), as four lanes of 32 bits summed in 64, so it does not depend on the order of rows; the copies go in with
opposite signs, and a cell that is not zero differs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftaudit.functions.normalize import norm_hash, norm_id, point_key, strip, wide_hash
from driftaudit.operators.snapshot_diff import comparable_snapshots, recency

#: Buckets per matrix at most: its rows, and so the list of unequal buckets, have this proven bound, which makes it safe to broadcast.
MAX_BUCKETS = 1 << 16
LANES = ("_0", "_1", "_2", "_3")


def latest(df: DataFrame, keys: dict[str, Column], values: dict[str, Column], order: Column) -> DataFrame:
    """One row per key: the 128-bit hash of each value in the row that is last by `order`. Copies combine before the shuffle."""
    lanes = {f"{n}{i}": h for n, v in values.items() for i, h in enumerate(wide_hash(v), 1)}
    rows = df.select(*(k.alias(n) for n, k in keys.items()), *(h.alias(n) for n, h in lanes.items()), order.alias("order_"))
    return rows.groupBy(*keys).agg(*(F.max_by(n, "order_").alias(n) for n in lanes))


def hashed(df: DataFrame, keys: dict[str, Column], values: dict[str, Column]) -> DataFrame:
    """The same columns for a side whose keys are known to be unique: row by row, without a shuffle."""
    lanes = {f"{n}{i}": h for n, v in values.items() for i, h in enumerate(wide_hash(v), 1)}
    return df.select(*(k.alias(n) for n, k in keys.items()), *(h.alias(n) for n, h in lanes.items()))


def buckets_for(rows: int) -> int:
    """About 256 rows to a bucket, a power of two between 256 and MAX_BUCKETS: sums of a task combine, and a bucket stays small."""
    return min(MAX_BUCKETS, max(256, 1 << (rows // 256).bit_length()))


def _lanes(hashes: tuple[Column, Column]) -> list[Column]:
    low = F.lit(0xFFFFFFFF).cast("bigint")
    return [part for h in hashes for part in (h.bitwiseAND(low), F.shiftrightunsigned(h, 32))]


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("bucket"), *keys), F.lit(buckets)).cast("int")


def checksum_matrix(side: DataFrame, keys: list[str], values: list[str], buckets: int, sign: int = 1) -> DataFrame:
    """(bucket, <column>_0.._3 for `key` and each of `values`): the signed sums of one side."""
    key = wide_hash(*(F.col(k) for k in keys))
    cells = {"key": _lanes(key)} | {v: _lanes((F.xxhash64(key[0], F.col(f"{v}1")), F.xxhash64(key[1], F.col(f"{v}2")))) for v in values}
    flat = side.select(_bucket(keys, buckets).alias("bucket"), *((F.lit(sign) * lane).alias(f"{c}{n}") for c, lanes in cells.items() for n, lane in zip(LANES, lanes, strict=True)))
    return flat.groupBy("bucket").agg(*(F.sum(f"{c}{n}").alias(f"{c}{n}") for c in cells for n in LANES))


def unequal_cells(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], buckets: int) -> DataFrame:
    """(bucket, key, <each of values>: whether the cell differs), of the buckets with a differing cell."""
    columns = ["key", *values]
    both = checksum_matrix(left, keys, values, buckets).unionByName(checksum_matrix(right, keys, values, buckets, -1))
    sums = both.groupBy("bucket").agg(*(F.sum(f"{c}{n}").alias(f"{c}{n}") for c in columns for n in LANES))
    flags = sums.select("bucket", *(reduce(Column.__or__, (F.col(f"{c}{n}") != 0 for n in LANES)).alias(c) for c in columns))
    return flags.where(reduce(Column.__or__, (F.col(c) for c in columns)))


def differences(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], names: tuple[str, str] = ("missing_in_right", "missing_in_left"), buckets: int = 4096) -> DataFrame:
    """(*keys, difference) for two sides made by `latest` or `hashed` with the same keys and values.

    `difference` is names[0] for a key that only the left has, names[1] for one that only the right has, else the name of
    a column whose values differ (null equals null only), one row each. The list of unequal buckets has at most
    MAX_BUCKETS rows and is broadcast. Sides made by `latest` are partitioned by the key already, so the join needs no
    further shuffle. Of sides made by `hashed` only the rows of unequal buckets are ever shuffled: with few differences
    next to nothing is.
    """
    if not 1 <= buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must be between 1 and {MAX_BUCKETS}")
    cells = F.broadcast(unequal_cells(left, right, keys, values, buckets).select("bucket", *(F.col(v).alias(f"look_{v}") for v in values)))

    def read(side: DataFrame, n: str) -> DataFrame:
        hit = side.withColumn("bucket", _bucket(keys, buckets)).join(cells, "bucket")
        return hit.select(*keys, F.lit(True).alias(f"in_{n}"), *(F.when(F.col(f"look_{v}"), F.struct(f"{v}1", f"{v}2")).alias(f"{n}_{v}") for v in values))

    both = read(left, "l").join(read(right, "r"), keys, "full")
    found = F.when(F.col("in_r").isNull(), F.array(F.lit(names[0]))).when(F.col("in_l").isNull(), F.array(F.lit(names[1]))).otherwise(
        F.array_compact(F.array(*(F.when(~F.col(f"l_{v}").eqNullSafe(F.col(f"r_{v}")), F.lit(v)) for v in values)))
    )
    return both.select(*keys, F.explode(found).alias("difference"))


def copy_differences(left: DataFrame, right: DataFrame, keys: dict[str, Column], values: dict[str, Column], names: tuple[str, str] = ("missing_in_right", "missing_in_left"), buckets: int | None = None) -> DataFrame:
    """(*keys, difference) between two copies whose keys are unique on either side. Rows with a null key have no identity."""
    if buckets is None:
        buckets = buckets_for(max(left.count(), right.count()))
    known = [df.where(~F.greatest(*(k.isNull() for k in keys.values()), F.lit(False))) for df in (left, right)]
    sides = [hashed(df, keys, values) for df in known]
    return differences(*sides, list(keys), list(values), names, buckets)


def index_differences(bindings: DataFrame, points: DataFrame, headers: DataFrame, buckets: int = 4096) -> DataFrame:
    """(target_id, scope, point_key, difference): the manifest's points against the newest full and complete snapshot.

    Per target, scope and point, the binding with the latest `recorded_at` counts (among equals one chosen by a hash of its id), and in
    the snapshot the row with the latest `observed_at`, then `ord`. Targets and scopes that have bindings but no such
    snapshot have all points missing in the index; those with a snapshot but no bindings all missing in the manifest.
    Rows without a point id have no identity and are not compared. Empty tables and further columns are allowed.
    """
    keys, values = ["target_id", "scope", "point_key"], ["embedding_id", "payload_hash"]
    newest = comparable_snapshots(headers).groupBy("target_id", "scope").agg(F.max("snapshot_no").alias("snapshot_no"))
    expected = latest(
        bindings.where(F.length(strip(F.col("point_id"))) > 0),
        {"target_id": norm_id(F.col("target")), "scope": strip(F.col("namespace")), "point_key": point_key(F.col("point_id"))},
        {"embedding_id": norm_id(F.col("embedding_id")), "payload_hash": norm_hash(F.col("expected_payload_hash"))}, recency(F.col("recorded_at"), F.xxhash64(F.col("id"))),
    )
    seen = points.where(F.length(strip(F.col("point_id"))) > 0).withColumns({"target_id": norm_id(F.col("target_id")), "scope": strip(F.col("scope"))})
    observed = latest(
        seen.join(newest, ["target_id", "scope", "snapshot_no"], "left_semi"),
        {"target_id": F.col("target_id"), "scope": F.col("scope"), "point_key": point_key(F.col("point_id"))},
        {"embedding_id": norm_id(F.col("embedding_id")), "payload_hash": norm_hash(F.col("payload_hash"))}, recency(F.col("observed_at"), F.col("ord")),
    )
    return differences(expected, observed, keys, values, ("missing_in_index", "missing_in_manifest"), buckets)
