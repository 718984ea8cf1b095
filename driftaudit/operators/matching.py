"""Expected points against observed ones: a cascade of positional full-outer rounds.

In a round both sides are ranked within their key, and the i-th expected is paired with the i-th observed; what is left
over goes to the next round. A plain full-outer join would multiply duplicates. Null keys never match.

Nearly all points have a key that stands once on either side. An aggregation of key hashes alone finds the others; only
their rows, and those without a key, go through ranks and rounds and are kept. The rest is one join by key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftaudit.functions.normalize import wide_hash
from driftaudit.session import BROADCAST_ROWS, cut, lookup

#: The levels at which pairs are made, in order, and those at which leftovers only get suggestions.
LEVELS = ("point_key", "embedding_id", "chunk_id")
SUGGESTION_LEVELS = ("source_version_id", "payload_hash")


def expected_points(bindings: DataFrame, embeddings: DataFrame, chunks: DataFrame, parse_runs: DataFrame, sources: DataFrame, target: str, scope: str) -> DataFrame:
    """Bindings of one target and scope with what is known of their embedding, chunk, parse run and source.

    Lookup tables are reduced to one row per id before the joins (the last by `ord`), so no join multiplies rows.
    """

    def one(df: DataFrame, key: str, prefix: str, columns: list[str]) -> DataFrame:
        last = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), "ord").alias("r"))
        return last.select(F.col(key).alias(prefix + "key"), *(F.col("r")[c].alias(prefix + c) for c in columns))

    b = bindings.where((F.col("target") == target) & (F.col("namespace") == scope))
    e = one(embeddings, "id", "e_", ["chunk_id", "dimension", "vector_hash"])
    ids = [x for x in ("pii_assertion_ids", "license_assertion_ids") if x in chunks.columns]
    c = one(chunks, "id", "c_", ["source_version_id", "parse_run_id", *ids])
    p = one(parse_runs, "id", "p_", ["parser_name"])
    s = one(sources, "version_id", "s_", ["id"])
    joined = b.join(e, b.embedding_id == e.e_key, "left").join(c, F.col("e_chunk_id") == F.col("c_key"), "left")
    joined = joined.join(p, F.col("c_parse_run_id") == F.col("p_key"), "left").join(s, F.col("c_source_version_id") == F.col("s_key"), "left")
    return joined.select(
        F.col("id").alias("binding_id"), "point_key", "embedding_id", F.col("e_chunk_id").alias("chunk_id"), F.col("c_source_version_id").alias("source_version_id"), F.col("s_id").alias("source_id"),
        F.col("e_dimension").alias("dimension"), F.col("e_vector_hash").alias("vector_hash"), F.col("expected_payload_hash").alias("payload_hash"), "tenant", "acl", "ord", *(F.col(f"c_{x}").alias(x) for x in ids),
    )


#: A key with more rows than this is ranked in parts. Of n rows at most n / HOT keys are hot, so the list of them is broadcast.
HOT = 1_000_000
#: Rows in order of `pos`: in the first round that of `ord`, later that in which the rounds before leave them.
_BITS = 33  # monotonically increasing ids have the partition above this bit


def _ranked(df: DataFrame, key: str, hot: int = HOT, order: str = "pos") -> DataFrame:
    """`df` with `rn`, the rank within the key. A hot key's rows are ranked within parts of the order, and the sizes of the
    parts before are added, so no key is sorted in one task."""
    columns = df.columns
    # as text: an expression in Python is a call to the JVM for each of its parts
    span = df.groupBy(key).agg(F.expr("count(*) as n_"), F.expr(f"min({order}) as lo_"), F.expr(f"max({order}) as hi_")).where(f"n_ > {hot}")
    marked = df.join(F.broadcast(span), key, "left")
    rest = marked.where("n_ is null").selectExpr(*columns, f"cast(row_number() over (partition by {key} order by {order}) as bigint) as rn")
    # ids given by sorted partitions are dense within one and far apart between two: there the partition is the part
    step = f"greatest(1L, cast(ceil((hi_ - lo_ + 1) / ceil(n_ / {hot})) as bigint))"
    part = f"if(hi_ >= {1 << _BITS}L, shiftright(cast({order} as bigint), {_BITS}), cast(floor(({order} - lo_) / {step}) as bigint)) as part_"
    parts = marked.where("n_ is not null").selectExpr(*columns, part)
    sizes = parts.groupBy(key, "part_").count().selectExpr(key, "part_", f"sum(count) over (partition by {key} order by part_) - count as before_")
    ranked = parts.selectExpr("*", f"row_number() over (partition by {key}, part_ order by {order}) as in_").join(F.broadcast(sizes), [key, "part_"])
    return rest.unionByName(ranked.selectExpr(*columns, "cast(in_ + before_ as bigint) as rn"))


def _prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.toDF(*(p + c for c in df.columns))


def match_round(expected: DataFrame, observed: DataFrame, level: int, hot: int = HOT) -> DataFrame:
    """The full outer result of one round over rows with `pos`: e_* and o_* columns, both sides set for a pair."""
    key = LEVELS[level]
    e = _prefixed(_ranked(expected.where(F.col(key).isNotNull()), key, hot), "e_")
    o = _prefixed(_ranked(observed.where(F.col(key).isNotNull()), key, hot), "o_")
    both = e.join(o, (F.col(f"e_{key}") == F.col(f"o_{key}")) & (F.col("e_rn") == F.col("o_rn")), "full").drop("e_rn", "o_rn")
    rest_e = _prefixed(expected.where(F.col(key).isNull()), "e_")
    rest_o = _prefixed(observed.where(F.col(key).isNull()), "o_")
    return both.unionByName(rest_e, allowMissingColumns=True).unionByName(rest_o, allowMissingColumns=True)


def _side(df: DataFrame, p: str) -> DataFrame:
    names = [c for c in df.columns if c.startswith(p)]
    return df.select(*names).toDF(*(c[len(p) :] for c in names))


def _left(both: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What a round leaves on the sides, with their new `pos`: by the round's key, nulls last, then as before.

    Kept, for the ids follow the partitions, which another evaluation may cut otherwise.
    """
    either = lambda c: F.coalesce(f"e_{c}", f"o_{c}")
    rows = both.where("e_ord is null or o_ord is null").orderBy(F.col("e_ord").isNull(), either(key).asc_nulls_last(), either("pos"))
    kept = cut(rows.withColumn("pos_", F.monotonically_increasing_id()))
    return tuple(_side(kept.where(f"{p}_ord is not null").drop(f"{p}_pos").withColumnRenamed("pos_", f"{p}_pos"), f"{p}_") for p in "eo")


@dataclass(frozen=True)
class Rounds:
    """How a match goes: the points with a key of their own on either side (`plain`), and level by level the others, as the
    expected and observed rows that enter and the full outer result."""

    plain: DataFrame
    levels: list[tuple[DataFrame, DataFrame, DataFrame]]


def odd_keys(expected: DataFrame, observed: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(h1, h2): the hashes of point keys that don't stand once on either side. Counts of copies combine before the shuffle."""

    def counted(df: DataFrame, e: int) -> DataFrame:
        h1, h2 = wide_hash(F.col(LEVELS[0]))
        return df.where(F.col(LEVELS[0]).isNotNull()).select(h1.alias("h1"), h2.alias("h2"), F.lit(e).alias("e"))

    n = counted(expected, 1).unionByName(counted(observed, 0)).groupBy("h1", "h2").agg(F.sum("e").alias("n_e"), F.count("*").alias("n"))
    return lookup(n.where("n_e <> 1 or n <> 2").select("h1", "h2"), broadcast_rows)


def rounds(expected: DataFrame, observed: DataFrame, levels: int = len(LEVELS), broadcast_rows: int = BROADCAST_ROWS) -> Rounds:
    """The rounds of a match. The rows of odd keys are computed once and kept, and so is each level's result over them."""
    key = LEVELS[0]
    h1, h2 = wide_hash(F.col(key))
    odd = odd_keys(expected, observed, broadcast_rows)

    def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        hashed = df.withColumns({"h1": h1, "h2": h2})
        some = hashed.where(F.col(key).isNotNull())
        strange = some.join(odd, ["h1", "h2"], "left_semi").unionByName(hashed.where(F.col(key).isNull())).drop("h1", "h2")
        return some.join(odd, ["h1", "h2"], "left_anti").drop("h1", "h2"), cut(strange.withColumn("pos", F.col("ord").cast("bigint")))

    (e_plain, e), (o_plain, o) = split(expected), split(observed)
    plain = _prefixed(e_plain, "e_").join(_prefixed(o_plain, "o_"), F.col(f"e_{key}") == F.col(f"o_{key}"))
    out = []
    for level in range(levels):
        both = cut(match_round(e, o, level))
        out.append((e, o, both))
        if level + 1 < levels:
            e, o = _left(both, LEVELS[level])
    return Rounds(plain, out)


def cascade(expected: DataFrame, observed: DataFrame, done: Rounds | None = None) -> DataFrame:
    """All rounds: e_*, o_* and `match_level` (1-based, null for what is left over on either side)."""
    done = done or rounds(expected, observed)
    out = [done.plain.withColumn("match_level", F.lit(1))]
    out += [both.where("e_ord is not null and o_ord is not null").withColumn("match_level", F.lit(i)).drop("e_pos", "o_pos") for i, (_, _, both) in enumerate(done.levels, 1)]
    out.append(done.levels[-1][2].where("e_ord is null or o_ord is null").withColumn("match_level", F.lit(None).cast("int")).drop("e_pos", "o_pos"))
    return reduce(DataFrame.unionByName, out)


def _shared(e: DataFrame, o: DataFrame, key: str) -> DataFrame:
    """(key, n, point_key): the keys that several observed points share and that the expected side has; the least point key of each."""
    many = o.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), F.min("point_key").alias("point_key")).where("n > 1")
    return many.join(e.select(F.col(key).alias("key")).distinct(), "key", "left_semi")


def duplicate_keys(expected: DataFrame, observed: DataFrame, done: Rounds | None = None) -> DataFrame:
    """(level, key, n, point_key): keys that several observed points share in a round and that the expected side has too, with the least of their point keys."""
    out = []
    for level, (e, o, _) in enumerate((done or rounds(expected, observed)).levels):
        out.append(_shared(e, o, LEVELS[level]).select(F.lit(level + 1).alias("level"), "key", "n", "point_key"))
    return reduce(DataFrame.unionByName, out)


def duplicate_members(expected: DataFrame, observed: DataFrame, done: Rounds | None = None) -> DataFrame:
    """(level, key, ord, point_key): the points of the duplicate keys, one row each, however many share a key."""
    out = []
    for level, (e, o, _) in enumerate((done or rounds(expected, observed)).levels):
        key = LEVELS[level]
        out.append(o.select(F.col(key).alias("key"), "ord", "point_key").join(_shared(e, o, key).select("key"), "key", "left_semi").select(F.lit(level + 1).alias("level"), "key", "ord", "point_key"))
    return reduce(DataFrame.unionByName, out)


def suggestions(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(binding_id, point_key, level): leftovers paired by source version and by payload hash, each level by itself."""
    out = []
    for level in SUGGESTION_LEVELS:
        e = _ranked(expected.where(F.col(level).isNotNull()).select(F.col(level).alias("k"), "binding_id", "ord"), "k", order="ord")
        o = _ranked(observed.where(F.col(level).isNotNull()).select(F.col(level).alias("k"), "point_key", "ord"), "k", order="ord")
        out.append(e.drop("ord").join(o.drop("ord"), ["k", "rn"]).select("binding_id", "point_key", F.lit(level).alias("level")))
    return reduce(DataFrame.unionByName, out)


def confidence(level: Column) -> Column:
    return F.when(level <= 3, "high").when(level == 4, "medium").otherwise("low")
