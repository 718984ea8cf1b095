"""The queries of the text problems 2, 6, 7, 8 and 9, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftaudit.llm import mixing, packing, pii, sentences, splitting
from driftaudit.llm.tokens import with_tokens
from driftaudit.plans.tables import Tables


#: The vocabulary that documents are measured with in problems 7 and 8: byte-level, for many languages. A parameter of the operators.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def _limits(t: Tables) -> dict[str, int]:
    return {r.name: r.tokens for r in t.size_limits.collect()}  # a table of four settings


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    limits = _limits(t)
    return splitting.split_oversized(t.chunks, t.elements, limits["chunk_max"], limits["chunk_overlap"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_pieces(spark, folder).select("chunk_id").distinct()


def p2_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Per chunk what its pieces add up to: that none is above the limit, that each begins the overlap before the end of the one
    before, that the first begins and the last ends the chunk, and its number of tokens."""
    from pyspark.sql.window import Window

    limits = _limits(Tables(spark, folder))
    before = F.lag("token_end").over(Window.partitionBy("chunk_id", "list").orderBy("piece_no"))
    p = p2_pieces(spark, folder).withColumn("list", F.col("n_pieces"))
    p = p.withColumn("joined", F.coalesce(before - F.col("token_start") == limits["chunk_overlap"], F.col("token_start") == 0))
    least = F.ceil((F.max("token_end") - limits["chunk_overlap"]) / (limits["chunk_max"] - limits["chunk_overlap"]))
    return p.groupBy("chunk_id", "list").agg(
        F.max("token_end").cast("bigint").alias("n_tokens"), (F.max(F.col("token_end") - F.col("token_start")) <= limits["chunk_max"]).alias("within_limit"), F.min("joined").alias("joined"),
        (F.count("*") == F.max("n_pieces")).alias("whole"), (F.count("*") <= least * 1.1 + 1).alias("few"), F.min(F.size(F.split(F.trim("piece"), r"(?U)[\s\x1c-\x1f]+")) == F.col("token_end") - F.col("token_start")).alias("exact"),
    ).drop("list")


def p7_limits(spark: SparkSession, folder: str) -> DataFrame:
    """One row: documents, those in no container, containers above the capacity, documents divided though they fit, tokens lost."""
    t = Tables(spark, folder)
    capacity = _limits(t)["container_capacity"]
    packed = p7_containers(spark, folder)
    loads = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("n_above"))
    docs = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"))
    sized = with_tokens(t.documents, "text", {"doc_id": F.col("doc_id")}, TOKENIZER)
    both = sized.join(docs, "doc_id", "left").agg(
        F.count("*").alias("n_documents"), F.count_if(F.col("n").isNull()).alias("n_missing"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= capacity)).alias("n_divided"), F.sum(F.col("n_tokens") - F.coalesce("n", F.lit(0))).alias("n_lost")
    )
    return both.crossJoin(loads)  # one row each


def p8_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Per target source: its share, and whether no document is chosen too often or twice, and the budget, as far as the supply reaches, is missed by less than half
    of the source's largest document."""
    chosen, report = _mix(spark, folder)
    most = chosen.groupBy("source").agg(F.max("n_times").alias("times"), F.count("*").alias("rows"), F.count_distinct("doc_id").alias("docs"))
    sized = with_tokens(Tables(spark, folder).documents, "text", {"source": mixing.source_name(F.col("source"))}, TOKENIZER)
    r = report.join(most, "source", "left").join(sized.groupBy("source").agg(F.max("n_tokens").alias("largest")), "source", "left")
    reach = F.least(F.col("budget"), F.col("supply") * F.col("max_repeats"))
    return r.select("source", "target_share", "max_repeats", (F.coalesce("times", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"), (F.coalesce("rows", F.lit(0)) == F.coalesce("docs", F.lit(0))).alias("once"), (F.abs(F.col("chosen_tokens") - reach) <= F.coalesce("largest", F.lit(0)) / 2).alias("near_budget"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return packing.pack(t.documents, _limits(t)["container_capacity"], TOKENIZER)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, folder), _limits(Tables(spark, folder))["container_capacity"])


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    t = Tables(spark, folder)
    total = _limits(t)["mix_total_per_thousand_documents"] * t.documents.count() / 1000
    return mixing.mix(t.documents, t.mix_targets, total, TOKENIZER)


def p8_selection(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(Tables(spark, folder).contact_rows)


def p6_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redact(Tables(spark, folder).contact_rows)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_units(Tables(spark, folder).documents).select("doc_id", "start_pos", "end_pos")


def p9_units(spark: SparkSession, folder: str) -> DataFrame:
    """Units and characters in units of each document."""
    units = sentences.sentence_units(Tables(spark, folder).documents)
    return units.groupBy("doc_id").agg(F.count("*").alias("n_units"), F.sum(F.length("unit")).alias("n_chars"))


def p6_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Per row whether what stands between the entities found is what stands between the placeholders: all else is unchanged."""
    t = Tables(spark, folder).contact_rows
    fields = pii.FIELDS
    red = pii.redact(t).select("note_id", F.inline(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("red")) for f in fields))))
    raw = t.select("note_id", F.inline(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw")) for f in fields))))
    spans = pii.find(t).groupBy("note_id", "field_name").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "entity_type"))).alias("spans"))  # of one text
    none = F.array().cast("array<struct<start_pos:int,end_pos:int,entity_type:string>>")
    d = raw.join(spans, ["note_id", "field_name"], "left").withColumn("spans", F.coalesce("spans", none))
    parts = F.transform("spans", lambda x, i: F.concat(F.substring(F.col("raw"), F.when(i == 0, 1).otherwise(F.get("spans", i - 1)["end_pos"] + 1), x["start_pos"] - F.when(i == 0, 0).otherwise(F.get("spans", i - 1)["end_pos"])), F.lit("["), x["entity_type"], F.lit("]")))
    rest = F.expr("substring(raw, case when size(spans) > 0 then spans[size(spans) - 1].end_pos + 1 else 1 end, length(raw))")
    want = F.concat(F.array_join(parts, ""), rest)
    return d.join(red, ["note_id", "field_name"]).groupBy("note_id").agg(F.min(F.col("red").eqNullSafe(want)).alias("kept"))


def p9_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Per document that its units stand in order and apart, without white space at either end, and are the stored text at their places."""
    from pyspark.sql.window import Window

    t = Tables(spark, folder)
    u = sentences.sentence_units(t.documents).withColumn("before", F.lag("end_pos").over(Window.partitionBy("doc_id").orderBy("unit_no")))
    d = t.documents.select("doc_id", "text").join(u, "doc_id", "left")
    same = F.expr("substring(text, start_pos + 1, end_pos - start_pos)") == F.col("unit")
    yes = lambda c: F.coalesce(F.min(c), F.lit(True))
    return d.groupBy("doc_id").agg(yes(same).alias("same"), yes(F.coalesce(F.col("before") <= F.col("start_pos"), F.lit(True))).alias("apart"), yes(F.trim("unit") == F.col("unit")).alias("trimmed"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_pieces, p2_limits, p6_found, p6_redacted, p6_kept, p7_containers, p7_fill, p7_limits, p8_selection, p8_shares, p8_limits, p9_found, p9_units, p9_cover)}

_SPACE = r"[^ \t\n\x0b\x0c\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

ORACLES: dict[str, str] = {
    "p2_found": f"""with e as (select lower(trim(id, ' \t\n\r')) e, max(len(regexp_extract_all(text, '{_SPACE}'))) n from elements where text is not null group by 1),
c as (select distinct nullif(lower(trim(id)), '') chunk_id, list_sort(list_distinct(list_transform(locator.element_ids, lambda x: lower(trim(x, ' \t\n\r'))))) ids from chunks where len(locator.element_ids) > 0),
r as (select chunk_id, ids, unnest(ids) e from c where chunk_id is not null)
select distinct chunk_id from (select chunk_id, ids, sum(n) n from r join e using (e) group by all) where n > 512""",
    "p9_cover": "select doc_id, true same, true apart, true trimmed from documents",
    "p6_kept": "select note_id, true kept from contact_rows",
    "p7_limits": "select count(*) n_documents, 0::bigint n_missing, 0::bigint n_divided, 0::bigint n_lost, 0::bigint n_above from documents",
    "p8_limits": "select replace(replace(lower(trim(source)), '-', '_'), ' ', '_') source, target_share, max_repeats, true within_cap, true once, true near_budget from mix_targets",
}
ORACLES["p2_limits"] = f"""with e as (select lower(trim(id, ' \t\n\r')) e, arg_max(text, (len(regexp_extract_all(text, '{_SPACE}')), text)) text from elements where text is not null group by 1),
c as (select distinct nullif(lower(trim(id)), '') chunk_id, list_distinct(list_transform(locator.element_ids, lambda x: lower(trim(x, ' \t\n\r')))) ids from chunks where len(locator.element_ids) > 0),
n as (select chunk_id, ids, sum(len(regexp_extract_all(text, '{_SPACE}')))::bigint n from (select chunk_id, list_sort(ids) ids, unnest(ids) e from c where chunk_id is not null) join e using (e) group by all)
select chunk_id, n n_tokens, true within_limit, true joined, true whole, true few, true exact from n where n > 512"""
