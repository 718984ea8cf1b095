"""References to records that do not exist.

Method: parent and child keys are united in long form, grouped by parent table and key, and the groups without a valid
parent flag are kept; their references are then told apart by time and counted by period.

Keys and child ids travel as 128-bit hashes, so that no shuffle carries an id's text. The steps:

1. children: one row per child id with t (its earliest delivery) and its distinct references; copies combine map-side;
2. groups: parents and children by (parent table, key), all aggregates fixed-width, copies and hot keys combine map-side;
   a key with a parent that was recorded before any child and never deleted is settled here;
3. the remaining keys' periods are merged where they overlap; a child outside all of them is an orphan, with its reason;
   only the children that refer to such a key are put together again for that;
4. the orphans' id texts are fetched from the child tables.

Steps 3 and 4 keep few rows of many. What they look up has rows of fixed width, is checkpointed and counted: below `broadcast_rows` it is
broadcast, above it a shuffle join with AQE's skew handling is left to Spark. Either way gives the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftaudit.functions.normalize import norm_id, wide_hash
from driftaudit.session import BROADCAST_ROWS, lookup

@dataclass(frozen=True)
class Child:
    """A table whose columns `refs` (column: parent table) hold keys of other tables."""

    name: str
    df: DataFrame
    refs: dict[str, str]
    id: str = "id"
    recorded: str = "recorded_at"


@dataclass(frozen=True)
class Parent:
    name: str
    df: DataFrame
    key: str
    recorded: str = "recorded_at"
    deleted: str = "deleted_at"


def _micros(name: str):
    return F.unix_micros(F.col(name))


def _child_rows(children: list[Child]) -> DataFrame:
    """(tag, c1, c2, t, refs): every row, with t in microseconds and refs the (ref, k1, k2) that aren't blank."""
    parts = []
    for tag, c in enumerate(children):
        c1, c2 = wide_hash(norm_id(F.col(c.id)))
        refs = []
        for no, ref in enumerate(c.refs):
            k1, k2 = wide_hash(norm_id(F.col(ref)))
            refs.append(F.when(norm_id(F.col(ref)).isNotNull(), F.struct(F.lit(no).alias("ref"), k1.alias("k1"), k2.alias("k2"))))
        parts.append(c.df.where(norm_id(F.col(c.id)).isNotNull()).select(
            F.lit(tag).alias("tag"), c1.alias("c1"), c2.alias("c2"), _micros(c.recorded).alias("t"), F.array_compact(F.array(*refs)).alias("refs"),
        ))
    return reduce(DataFrame.unionByName, parts)


def _with_parent(long: DataFrame, children: list[Child], parents: list[Parent]) -> DataFrame:
    place = {p.name: i for i, p in enumerate(parents)}
    of = F.array(*(F.array(*(F.lit(place[p]) for p in c.refs.values())) for c in children))
    return long.withColumn("parent", F.get(F.get(of, F.col("tag")), F.col("ref")))


def _references(rows: DataFrame, children: list[Child], parents: list[Parent]) -> DataFrame:
    """(tag, c1, c2, t, ref, parent, k1, k2), one row per child id and distinct reference, t the earliest of all rows of the id;
    a child without any time has none."""
    # distinct lists of references, of which a child id has one unless its rows disagree
    ids = rows.groupBy("tag", "c1", "c2").agg(F.min("t").alias("t"), F.array_distinct(F.flatten(F.collect_set("refs"))).alias("refs"))
    return _with_parent(ids.where("t is not null").select("tag", "c1", "c2", "t", F.inline("refs")), children, parents)


def _parent_rows(parents: list[Parent]) -> DataFrame:
    parts = []
    for i, p in enumerate(parents):
        k1, k2 = wide_hash(norm_id(F.col(p.key)))
        parts.append(p.df.where(norm_id(F.col(p.key)).isNotNull()).select(
            F.lit(i).alias("parent"), k1.alias("k1"), k2.alias("k2"), _micros(p.recorded).alias("since"), _micros(p.deleted).alias("until"),
        ))
    return reduce(DataFrame.unionByName, parts)


def suspect_keys(references: DataFrame, parent_rows: DataFrame) -> DataFrame:
    """(parent, k1, k2) of the referred keys without a parent that holds for all their references."""
    tagged = references.select("parent", "k1", "k2", "t", F.lit(None).cast("boolean").alias("is_parent"), F.lit(None).cast("bigint").alias("open_since")).unionByName(
        parent_rows.select("parent", "k1", "k2", F.lit(None).cast("bigint").alias("t"), F.lit(True).alias("is_parent"), F.expr("case when until is null then since end").alias("open_since"))
    )
    groups = tagged.groupBy("parent", "k1", "k2").agg(F.min("t").alias("first_use"), F.max("is_parent").alias("has_parent"), F.min("open_since").alias("open_since"))
    return groups.where("first_use is not null and (has_parent is null or open_since is null or open_since > first_use)").select("parent", "k1", "k2")


def merged_periods(parent_rows: DataFrame) -> DataFrame:
    """(parent, k1, k2, since, until): when a key holds, as few periods as there are; they neither overlap nor touch."""
    keys = ["parent", "k1", "k2"]
    # of periods with the same end the longest, combined map-side: a key delivered again and again keeps one per deletion
    ends = parent_rows.groupBy(*keys, F.coalesce("until", F.lit(2**62)).alias("until")).agg(F.min("since").alias("since")).where("since < until")
    w = Window.partitionBy(*keys).orderBy("since", "until")
    apart = ends.withColumn("reach", F.max("until").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    apart = apart.withColumn("no", F.sum(F.when(F.col("since") <= F.col("reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return apart.groupBy(*keys, "no").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("no")


def orphans(children: list[Child], parents: list[Parent], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(child_table, child_id, ref_column, reason, period), one row per child id and reference that is not in order.

    With t the earliest recorded time of the child id: the reference is in order if some row of the parent table has the
    key, recorded at or before t and not deleted at t. Else `reason` is `missing` (no row has the key), `late` (a row is
    recorded after t) or `deleted`. Ids are compared, and returned, trimmed and in lower case. Null and blank references
    refer to nothing; rows without a child id, and child ids without any time, are not reported. A parent row without a
    recorded time holds from the beginning. Equal rows count once; empty tables give no rows, or only `missing`.
    """
    delivered, rows = _child_rows(children), _parent_rows(parents).withColumn("since", F.coalesce("since", F.lit(-(2**62))))
    keys, ids = ["parent", "k1", "k2"], ["tag", "c1", "c2"]
    suspects = lookup(suspect_keys(_references(delivered, children, parents), rows), broadcast_rows)
    # from here on only children with a suspect reference: all their rows, for the earliest time is that of any
    pointing = _with_parent(delivered.select(*ids, F.inline("refs")), children, parents).join(suspects, keys, "left_semi").select(*ids)
    refs = _references(delivered.join(lookup(pointing.distinct(), broadcast_rows), ids, "left_semi"), children, parents)
    known = rows.join(suspects, keys, "left_semi")
    held = lookup(suspects.join(known.groupBy(*keys).agg(F.max("since").alias("last")), keys, "left"), broadcast_rows)
    spans = lookup(merged_periods(known), broadcast_rows).select(*(F.col(c).alias("p_" + c) for c in (*keys, "since", "until")))
    inside = reduce(lambda a, b: a & b, [F.col(k) == F.col("p_" + k) for k in keys]) & (F.col("p_since") <= F.col("t")) & (F.col("p_until") > F.col("t"))
    reason = F.when(F.col("last").isNull(), "missing").when(F.col("last") > F.col("t"), "late").otherwise("deleted")
    bad = refs.join(held, keys).join(spans, inside, "left_anti").select("tag", "c1", "c2", "ref", reason.alias("reason"), "t")
    bad = lookup(bad, broadcast_rows)
    parts = []
    for tag, c in enumerate(children):
        c1, c2 = wide_hash(norm_id(F.col(c.id)))
        ids = c.df.select(norm_id(F.col(c.id)).alias("child_id"), c1.alias("c1"), c2.alias("c2"))
        names = F.array(*map(F.lit, c.refs))
        parts.append(ids.join(bad.where(F.col("tag") == tag), ["c1", "c2"]).select(
            F.lit(c.name).alias("child_table"), "child_id", F.get(names, F.col("ref")).alias("ref_column"), "reason",
            F.date_format(F.timestamp_micros("t"), "yyyy-MM").alias("period"),
        ))
    return reduce(DataFrame.unionByName, parts).distinct()


def orphan_counts(found: DataFrame) -> DataFrame:
    """(child_table, ref_column, reason, period, n_children)."""
    return found.groupBy("child_table", "ref_column", "reason", "period").agg(F.count("*").alias("n_children"))
