"""What changed between full snapshots.

Method: the rows of each compared pair of snapshots are united, tagged by side, grouped by key, and classified from the
hashes that either side has, all in one aggregation shuffle with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftaudit.functions.normalize import norm_hash, norm_id, point_key, strip

_BEFORE_ALL_TIME = -62_200_000_000_000_000  # microseconds; older than any timestamp


def comparable_snapshots(headers: DataFrame) -> DataFrame:
    """(target_id, scope, snapshot_no) of the deliveries that are full and complete, each once."""
    return headers.where(
        (F.lower(strip(F.col("snapshot_kind"))) == "full") & (F.lower(strip(F.col("consistency_completeness"))) == "complete")
    ).select(norm_id(F.col("target_id")).alias("target_id"), strip(F.col("scope")).alias("scope"), "snapshot_no").distinct()


def recency(at: Column, ordinal: Column) -> Column:
    """One number that orders rows by time, then by ordinal: fixed width, so the aggregation stays a hash aggregation."""
    micros = F.coalesce(F.unix_micros(at), F.lit(_BEFORE_ALL_TIME)).cast("decimal(19,0)")
    return (micros * F.lit("9223372036854775808").cast("decimal(19,0)") + F.coalesce(ordinal, F.lit(-1)).cast("decimal(19,0)")).cast("decimal(38,0)")


def snapshot_changes(points: DataFrame, headers: DataFrame, compare: dict[str, Column] | None = None) -> DataFrame:
    """(target_id, scope, snapshot_no, point_key, change_kind) for consecutive comparable snapshots.

    Each comparable snapshot is held against the one before it of the same target and scope; `snapshot_no` is the later
    one and the first yields nothing. `compare` names the compared values (payload_hash and source_id unless given);
    null equals null only. A point that stands more than once in a snapshot counts as its row with the latest
    `observed_at`, among equals the largest `ord`. Rows without a point id have no identity and are not compared.
    Snapshots without a header, empty tables and points of unknown targets yield no rows; other columns are ignored.

    A snapshot's rows are needed as the later side of one pair and the earlier side of the next, so the join with the
    pairs (one row per delivery) doubles them; the shuffle carries a pair number, the key, and per side one 64-bit hash
    and one order. Copies of one point combine before the shuffle, so no key can grow a task.
    """
    compare = compare or {"payload_hash": norm_hash(F.col("payload_hash")), "source_id": norm_id(F.col("source_id"))}
    series = Window.partitionBy("target_id", "scope").orderBy("snapshot_no")
    valid = comparable_snapshots(headers).withColumn("earlier", F.lag("snapshot_no").over(series)).where("earlier is not null")
    # a pair number instead of two names in every shuffled row; headers are one row per delivery, so one task numbers them
    pairs = valid.withColumn("pair", F.row_number().over(Window.orderBy("target_id", "scope", "snapshot_no")))
    sides = pairs.select("pair", F.col("target_id").alias("t"), F.col("scope").alias("s"), F.explode(F.array(
        F.struct(F.col("earlier").alias("n"), F.lit(False).alias("later")), F.struct(F.col("snapshot_no").alias("n"), F.lit(True).alias("later")),
    )).alias("side")).select("pair", "t", "s", "side.n", "side.later")

    row_hash = F.xxhash64(*(F.coalesce(F.concat(F.lit("="), v), F.lit("-")) for v in compare.values()))
    # the filter is on the raw text: one on the key would have the JSON parsed a second time
    rows = points.where(F.length(strip(F.col("point_id"))) > 0).select(
        norm_id(F.col("target_id")).alias("t"), strip(F.col("scope")).alias("s"), F.col("snapshot_no").alias("n"),
        point_key(F.col("point_id")).alias("point_key"), row_hash.alias("h"), recency(F.col("observed_at"), F.col("ord")).alias("at"),
    )
    tagged = rows.join(sides, ["t", "s", "n"])
    both = tagged.groupBy("pair", "point_key").agg(
        F.max_by(F.when(F.col("later"), F.col("h")), F.when(F.col("later"), F.col("at"))).alias("new"),
        F.max_by(F.when(~F.col("later"), F.col("h")), F.when(~F.col("later"), F.col("at"))).alias("old"),
    )
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.withColumn("change_kind", kind).where("change_kind is not null").join(
        pairs.select("pair", "target_id", "scope", "snapshot_no"), "pair"
    ).select("target_id", "scope", "snapshot_no", "point_key", "change_kind")


def change_counts(changes: DataFrame) -> DataFrame:
    """(target_id, scope, snapshot_no, change_kind, n_points)."""
    return changes.groupBy("target_id", "scope", "snapshot_no", "change_kind").agg(F.count("*").alias("n_points"))
