"""A selection of documents in which each source has its target share of the tokens.

Method: Efraimidis-Spirakis sampling. Each document gets an exponential key divided by its quality weight; within a source
the documents with the smallest keys come first, and are taken until their tokens reach the budget. Whole epochs of a
small source come before the fraction that is sampled.

No source is sorted in one task: keys fall into buckets that keep their order, the tokens per bucket are summed first,
which shows the bucket in which a source's budget ends, and only that bucket's documents are put in order. There are so
many buckets that one holds about a thousand documents of the largest source.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftaudit.functions.normalize import norm_id
from driftaudit.llm.tokens import with_tokens
from driftaudit.session import cut


def source_name(c: Column) -> Column:
    """Sources compare trimmed, without regard to case, and with hyphen, space and underscore alike."""
    return F.translate(norm_id(c), "- ", "__")


def quality_weight(text: Column) -> Column:
    """Between 0.05 and 1: the share of letters, less for texts of under 200 characters."""
    n = F.length(text)
    letters = F.length(F.regexp_replace(text, F.lit(r"[^\p{L}\p{M}]"), F.lit("")))
    return F.coalesce(F.greatest(F.lit(0.05), letters / F.greatest(n, F.lit(1)) * F.least(F.lit(1.0), n / F.lit(200.0))), F.lit(0.05))


def sampling_key(key: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) from a hash of the key, so that the same document always draws the same."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / weight


def budgets(sized: DataFrame, targets: DataFrame, total: float) -> DataFrame:
    """One row per target source: supply, budget, whole epochs, and the tokens to sample in the last one."""
    supply = sized.groupBy("source").agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("n_docs"))
    t = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").join(supply, "source", "left")
    t = t.withColumns({"supply": F.coalesce("supply", F.lit(0)), "n_docs": F.coalesce("n_docs", F.lit(0)), "budget": F.col("target_share") * F.lit(float(total))})
    epochs = F.when(F.col("supply") > 0, F.least(F.floor(F.col("budget") / F.col("supply")), F.col("max_repeats"))).otherwise(0).cast("int")
    t = t.withColumn("epochs", epochs)
    return t.withColumn("sampled", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("supply")).otherwise(0.0))


def filled(sizes: list[int], room: float) -> list[int]:
    """The places of the items to take, in order: each that still fits, then the one that comes nearest, if nearer with it than without."""
    out = []
    for i, n in enumerate(sizes):
        if n <= room:
            out.append(i)
            room -= n
    held = set(out)
    over = min((i for i, n in enumerate(sizes) if i not in held and n < 2 * room), key=lambda i: abs(sizes[i] - room), default=None)
    return sorted([*out, over]) if over is not None else out


def _upto(rows: DataFrame, need: str) -> DataFrame:
    """(source, last, before): the bucket in which a source's tokens exceed `need`, and the tokens of the buckets before it."""
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"), F.first(need).alias("need"))
    upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")))
    return upto.where(F.col("upto") > F.col("need")).groupBy("source").agg(F.min("bucket").alias("last"), F.min_by(F.col("upto") - F.col("n"), "bucket").alias("before"))


def mix(docs: DataFrame, targets: DataFrame, total: float, tokenizer: str, key: str = "doc_id", text: str = "text", seed: int = 11, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The selection (<key>, source, n_tokens, n_times) and the report, one row per source of `targets`.

    `n_times` counts the whole epochs and the sampled one and is at most max_repeats. Of the sampled epoch the documents
    with the smallest keys are taken while they fit the budget; then, of those that follow up to eight times as many tokens
    as are left, each that still fits; last one more, if the budget is nearer with it than without. A source misses its
    budget by less than half of its largest document, unless its supply times max_repeats is smaller. Documents of no target source, or
    without source, key or tokens are not chosen. The key must be unique; ties of equal keys' draws are broken by
    the key. `targets` is a small list by its nature, one row per source.

    A source is put in order only within one bucket of keys, of about a thousand documents unless `buckets` says otherwise.
    """
    slim = with_tokens(docs, text, {key: F.col(key), "source": source_name(F.col("source")), "weight": quality_weight(F.col(text))}, tokenizer)
    sized = cut(slim.where((F.col("n_tokens") > 0) & F.col("source").isNotNull() & F.col(key).isNotNull()))  # several passes follow; texts are tokenized once
    plan = cut(budgets(sized, targets, total))
    if buckets is None:
        buckets = max(4096, (plan.agg(F.max("n_docs")).first()[0] or 0) // 1000)
    drawn = sized.join(F.broadcast(plan.where("epochs > 0 or sampled > 0").select("source", "epochs", "sampled")), "source")
    drawn = drawn.withColumn("draw", sampling_key(F.col(key), F.col("weight"), seed))
    drawn = drawn.withColumn("bucket", F.floor(F.lit(buckets) * F.col("draw") / (1 + F.col("draw"))).cast("int"))
    # at most sources x buckets sums; of them one row per source is looked up
    placed = drawn.join(F.broadcast(_upto(drawn, "sampled")), "source", "left")
    inside = placed.where("last is null or bucket < last").withColumn("taken", F.lit(1))
    after = placed.where("bucket >= last").withColumn("room", F.col("sampled") - F.col("before"))
    # what may fill the room: enough documents, in order, and none so large that it is further off with it than without
    fits = after.where("n_tokens < 2 * room").withColumn("enough", 8 * F.col("room"))
    bound = _upto(fits.where("n_tokens <= room"), "enough").select("source", F.col("last").alias("until"))
    near = fits.join(F.broadcast(bound), "source", "left").where("until is null or bucket <= until")
    kind = dict(docs.dtypes)[key]

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["draw", key], kind="stable")
        return part.iloc[filled(part["n_tokens"].tolist(), float(part["room"].iloc[0]))][[key, "source"]]

    taken = near.select(key, "source", "draw", "n_tokens", "room").groupBy("source").applyInPandas(fill, f"{key} {kind}, source string").withColumn("taken", F.lit(1))
    edge = after.join(taken, [key, "source"], "left")
    columns = [key, "source", "n_tokens", "epochs", "sampled", "taken"]
    times = F.col("epochs") + F.when(F.col("sampled") > 0, F.coalesce("taken", F.lit(0))).otherwise(0)
    chosen = inside.select(columns).unionByName(edge.select(columns)).select(key, "source", "n_tokens", times.cast("int").alias("n_times")).where("n_times > 0")
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_times")).alias("chosen_tokens"), F.max("n_times").alias("most_times"))
    report = plan.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "supply", "budget", F.coalesce("chosen_tokens", F.lit(0)).alias("chosen_tokens"), F.coalesce("most_times", F.lit(0)).alias("most_times")
    )
    everything = Window.partitionBy(F.lit(0))  # over the targets' few rows
    report = report.withColumn("actual_share", F.col("chosen_tokens") / F.nullif(F.sum("chosen_tokens").over(everything), F.lit(0)))
    return chosen, report
