"""Elements to chunks: offsets, sections, three ways of packing, candidates with their place in the document."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftaudit.functions.text import token_count

GAP = 2  # elements are joined by a blank line
TOKENIZERS: dict[str, Callable[[Column], Column]] = {"driftaudit-whitespace@1": token_count}
PLACEHOLDERS = ("heading_path", "text", "table_caption")


def resolve_tokenizer(name: str) -> Callable[[Column], Column]:
    """The expression that counts a text's tokens. An unknown name is an error: counts of another tokenizer are no substitute."""
    if name not in TOKENIZERS:
        raise LookupError(f"no tokenizer {name}; there are {sorted(TOKENIZERS)}")
    return TOKENIZERS[name]


def template_column(template: str, columns: dict[str, Column | None], check: bool = False) -> Column | None:
    """A template with {names} of the given columns as one concatenation, so nothing in a value is taken for a name; other names are errors."""
    parts = re.split(r"\{([a-z_]+)\}", template)
    if unknown := sorted({n for n in parts[1::2] if n not in columns}):
        raise ValueError(f"unknown placeholders {unknown}; there are {sorted(columns)}")
    if check:
        return None
    shown = [F.coalesce(columns[x], F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts) if i % 2 or x]
    return reduce(F.concat, shown) if shown else F.lit("")


@dataclass(frozen=True)
class Sizes:
    """Checked sizes of chunks. `target_tokens` and `min_tokens` are accepted and checked, but no chunker uses them."""

    max_tokens: int = 200
    overlap_tokens: int = 0
    min_tokens: int = 0
    target_tokens: int | None = None
    oversized_element_policy: str = "split"
    tokenizer_name: str = "driftaudit-whitespace@1"
    contextualization_template: str = "{text}"

    def __post_init__(self) -> None:
        def whole(name: str, least: int, most: int | None = None) -> None:
            v = getattr(self, name)
            if isinstance(v, bool) or not isinstance(v, int) or v < least or most is not None and v > most:
                raise ValueError(f"{name} must be a whole number from {least}" + (f" to {most}" if most is not None else ""))

        whole("max_tokens", 1)
        whole("overlap_tokens", 0, self.max_tokens - 1)
        whole("min_tokens", 0)
        if self.target_tokens is not None:
            whole("target_tokens", 1, self.max_tokens)
        if self.oversized_element_policy not in ("split", "fail"):
            raise ValueError("oversized_element_policy is split or fail")
        if not isinstance(self.tokenizer_name, str) or not self.tokenizer_name:
            raise ValueError("tokenizer_name must be a name")
        template_column(self.contextualization_template, dict.fromkeys(PLACEHOLDERS, None), check=True)

    @classmethod
    def load(cls, config: dict) -> Sizes:
        if unknown := sorted(set(config) - set(cls.__dataclass_fields__)):
            raise ValueError(f"unknown keys: {unknown}")
        return cls(**config)


def offsets(elements: DataFrame, doc: str) -> DataFrame:
    """Elements with `start` and `end` in the document's joined text."""
    w = Window.partitionBy(doc).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + GAP).over(w), F.lit(0))
    return elements.withColumn("start", start.cast("bigint")).withColumn("end", F.col("start") + F.length("text"))


def sections(elements: DataFrame, doc: str) -> DataFrame:
    """Elements with `section`: the number of the maximal run of equal heading paths they are in, from 0."""
    w = Window.partitionBy(doc).orderBy("ord")
    new = F.when(F.lag("ord").over(w).isNull() | ~F.lag("heading_path").over(w).eqNullSafe(F.col("heading_path")), 1).otherwise(0)
    return elements.withColumn("new_", new).withColumn("section", (F.sum("new_").over(w) - 1).cast("int")).drop("new_")


def line_windows(elements: DataFrame, doc: str, max_tokens: int, overlap: int) -> DataFrame:
    """(<doc>, ordinal, text, token_count): windows of `max_tokens` stepping by max less overlap, each the whole elements that overlap it."""
    hits = _window_hits(elements.withColumn("n", token_count(F.col("text"))), doc, max_tokens, overlap)
    return hits.groupBy(doc, "ordinal").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n").alias("text"), F.sum("n").alias("token_count"))


def _window_hits(elements: DataFrame, doc: str, max_tokens: int, overlap: int) -> DataFrame:
    """Elements with tokens, once per window (`ordinal`) that they overlap: a whole step apart, and none that begins past the last token."""
    step = max_tokens - overlap
    w = Window.partitionBy(doc).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    e = elements.withColumn("first_", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("last_", F.col("first_") + F.col("n")).withColumn("total_", F.sum("n").over(Window.partitionBy(doc)))
    # the windows an element overlaps follow from its own place, so no range join is needed
    lo = F.greatest(F.lit(0), F.floor((F.col("first_") - max_tokens) / step) + 1)
    hi = F.floor((F.col("last_") - 1) / step)
    hits = e.where("n > 0").withColumn("ordinal", F.explode(F.sequence(lo, hi)))
    return hits.where(F.col("ordinal") * step < F.col("total_")).drop("first_", "last_", "total_")


class OversizedElement(ValueError):
    """An element above the limit where the policy is to fail."""


@dataclass
class Piece:
    """An element, or a piece of one that was too large, as packers see it."""

    row: tuple  # of _FIELDS
    tokens: int
    start: int
    end: int
    text: str


def token_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"\S+", text)]


def pieces_of(piece: Piece, max_tokens: int) -> list[Piece]:
    """An element as exact substrings of at most `max_tokens` tokens each; one without tokens stays as it is."""
    spans = token_spans(piece.text)
    out = []
    for i in range(0, len(spans), max_tokens):
        a, b = spans[i][0], spans[min(i + max_tokens, len(spans)) - 1][1]
        out.append(Piece(piece.row, min(max_tokens, len(spans) - i), piece.start + a, piece.start + b, piece.text[a:b]))
    return out or [piece]


def pack_section(pieces: list[Piece], sizes: Sizes) -> Iterator[list[Piece]]:
    """Groups of a section's elements, greedily filled up to the limit.

    An element above it ends the group and stands in groups of its own, cut into pieces, or fails, as the policy says. With
    an overlap a group begins with the last whole elements of the one before that together are within the overlap; they
    count towards its size, which is not checked again for them.
    """
    group: list[Piece] = []
    size = 0
    for p in pieces:
        if p.tokens > sizes.max_tokens:
            if group:
                yield group
            if sizes.oversized_element_policy == "fail":
                raise OversizedElement(f"an element of {p.tokens} tokens, {sizes.max_tokens} are allowed")
            yield from ([x] for x in pieces_of(p, sizes.max_tokens))
            group, size = [], 0
            continue
        if group and size + p.tokens > sizes.max_tokens:
            yield group
            tail, size = len(group), 0
            while tail and size + group[tail - 1].tokens <= sizes.overlap_tokens and sizes.overlap_tokens:
                tail -= 1
                size += group[tail].tokens
            group = group[tail:]
        group.append(p)
        size += p.tokens
    if group:
        yield group


_FIELDS = ("kind", "page", "heading_path", "element_id", "table_caption", "table_header")
CANDIDATE = "ordinal int, text string, heading_path array<string>, element_ids array<string>, page_start int, page_end int, character_start int, character_end int, table_caption string, error string"


def _with_fields(elements: DataFrame, doc: str) -> DataFrame:
    """All columns that a candidate is made of; those that are absent are null."""
    kinds = {"kind": "string", "page": "int", "heading_path": "array<string>", "element_id": "string", "table_caption": "string", "table_header": "string"}
    have = set(elements.columns)
    missing = {c: F.lit(None).cast(t) for c, t in kinds.items() if c not in have}
    d = elements.withColumns(missing) if missing else elements
    return d.withColumn("element_id", F.coalesce("element_id", F.concat(F.lit("e"), F.col("ord").cast("string"))))


def hierarchical(elements: DataFrame, doc: str, sizes: Sizes = Sizes()) -> DataFrame:
    """(<doc>, CANDIDATE): whole elements of a section up to the limit; no overlap."""
    return _packed(elements, doc, sizes, Sizes(sizes.max_tokens, 0, oversized_element_policy=sizes.oversized_element_policy))


def hybrid(elements: DataFrame, doc: str, sizes: Sizes = Sizes()) -> DataFrame:
    """(<doc>, CANDIDATE): as hierarchical, and a group begins with the tail of the one before it in its section."""
    return _packed(elements, doc, sizes, sizes)


def _packed(elements: DataFrame, doc: str, sizes: Sizes, effective: Sizes) -> DataFrame:
    """The windows that number sections leave each document's elements together and in order, so packing streams over them.

    A section at a time is in memory. An oversized element under the policy `fail` is a row with `error`, the document's last.
    """
    count = resolve_tokenizer(sizes.tokenizer_name)
    placed = sections(offsets(_with_fields(elements, doc), doc), doc).withColumn("n", count(F.col("text")))
    kind = dict(elements.dtypes)[doc]
    names = [doc, *(c.split()[0] for c in CANDIDATE.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = {"doc": None, "section": None, "ordinal": 0, "failed": False}
        held: list[Piece] = []
        out: list[tuple] = []

        def close() -> None:
            if held and not state["failed"]:
                try:
                    for group in pack_section(held, effective):
                        out.append((state["doc"], state["ordinal"], *_candidate(group), None))
                        state["ordinal"] += 1
                except OversizedElement as e:
                    out.append((state["doc"], state["ordinal"], *[None] * 8, str(e)))
                    state["failed"] = True
            held.clear()

        def frame() -> pd.DataFrame:
            made = pd.DataFrame(out, columns=names).astype({c: "Int32" for c in ("page_start", "page_end", "character_start", "character_end")})
            out.clear()
            return made

        for pdf in batches:
            for key, section, n, a, b, text, *row in zip(*(pdf[c].tolist() for c in (doc, "section", "n", "start", "end", "text", *_FIELDS)), strict=True):
                if state["doc"] != key or state["section"] != section:
                    close()
                    if state["doc"] != key:
                        state |= {"doc": key, "ordinal": 0, "failed": False}
                    state["section"] = section
                held.append(Piece(tuple(row), n, a, b, text))
            yield frame()
        close()
        yield frame()

    # the key as text: pandas would make floats of integers beside a null
    slim = placed.where(F.col("text").isNotNull()).select(F.col(doc).cast("string").alias(doc), "ord", "section", "n", "start", "end", "text", *_FIELDS)
    return slim.sortWithinPartitions(doc, "ord").mapInPandas(run, f"{doc} string, {CANDIDATE}").withColumn(doc, F.col(doc).cast(kind))


def _numbered(packed: DataFrame, doc: str, order: list[str]) -> DataFrame:
    number = F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1
    return packed.withColumn("ordinal", number.cast("int")).select(doc, *(c.split()[0] for c in CANDIDATE.split(", ")))


def _candidate(group: list[Piece]) -> tuple:
    """The joined text, which begins with the header of its table unless it is that; path, ids, pages, offsets, caption."""
    rows = [dict(zip(_FIELDS, p.row, strict=True)) for p in group]
    text, first = "\n\n".join(p.text for p in group), rows[0]
    header = first["table_header"]
    if first["kind"] == "table" and header and group[0].text.strip() != header.strip():
        text = f"{header}\n{text}"
    pages = [int(r["page"]) for r in rows if not pd.isna(r["page"])]
    path = first["heading_path"]
    caption = next((r["table_caption"] for r in rows if r["table_caption"]), None)
    return text, None if path is None else list(path), [r["element_id"] for r in rows], min(pages, default=None), max(pages, default=None), group[0].start, group[-1].end, caption


def line_based(elements: DataFrame, doc: str, sizes: Sizes = Sizes()) -> DataFrame:
    """(<doc>, CANDIDATE): windows over the document's tokens, each with the whole elements that overlap it, in built-in expressions."""
    count = resolve_tokenizer(sizes.tokenizer_name)
    placed = offsets(_with_fields(elements, doc), doc).where(F.col("text").isNotNull()).withColumn("n", count(F.col("text")))
    hits = _window_hits(placed, doc, sizes.max_tokens, sizes.overlap_tokens)
    fields = ["ord", "text", "start", "end", *_FIELDS]
    g = hits.groupBy(doc, F.col("ordinal").alias("no")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("p"))
    first = lambda c: F.get("p", F.lit(0))[c]
    body = F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")
    header = (first("kind") == "table") & (first("table_header") != "") & (F.trim(first("text")) != F.trim(first("table_header")))
    pages = F.filter(F.transform("p", lambda x: x["page"]), lambda x: x.isNotNull())
    packed = g.select(
        doc, "no", F.when(header, F.concat(first("table_header"), F.lit("\n"), body)).otherwise(body).alias("text"), first("heading_path").alias("heading_path"), F.transform("p", lambda x: x["element_id"]).alias("element_ids"),
        F.array_min(pages).alias("page_start"), F.array_max(pages).alias("page_end"), first("start").cast("int").alias("character_start"), F.element_at("p", -1)["end"].cast("int").alias("character_end"),
        F.get(F.filter(F.transform("p", lambda x: x["table_caption"]), lambda x: x.isNotNull() & (x != "")), F.lit(0)).alias("table_caption"), F.lit(None).cast("string").alias("error"),
    )
    return _numbered(packed, doc, ["no"])


#: Chunkers by name: a function of the elements, the document's key and the sizes that gives candidates.
CHUNKERS: dict[str, Callable[[DataFrame, str, Sizes], DataFrame]] = {"hierarchical": hierarchical, "hybrid": hybrid, "line_based": line_based}
CHUNKER_VERSION = "1"


def register_chunker(name: str, chunker: Callable[[DataFrame, str, Sizes], DataFrame]) -> None:
    CHUNKERS[name] = chunker


def candidates(elements: DataFrame, doc: str, chunker: str = "hierarchical", config: dict | None = None) -> DataFrame:
    """The candidates of a chunker by name, with `contextualized` and `token_count` (of the contextualized text)."""
    if chunker not in CHUNKERS:
        raise LookupError(f"no chunker {chunker}; there are {sorted(CHUNKERS)}")
    sizes = Sizes.load(config or {})
    count = resolve_tokenizer(sizes.tokenizer_name)
    found = CHUNKERS[chunker](elements, doc, sizes)
    return found.withColumn("contextualized", contextualized(sizes.contextualization_template)).withColumn("token_count", count(F.col("contextualized")))


def contextualized(template: str) -> Column:
    return template_column(template, {"heading_path": F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " > "), "text": F.col("text"), "table_caption": F.col("table_caption")})


def without_empty(found: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """The candidates that say something, and (<doc>, n_dropped) of the documents that had others."""
    blank = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), F.lit(r"(?U)\s+"), F.lit(" "))) == ""
    failed = F.col("error").isNotNull() if "error" in found.columns else F.lit(False)
    return found.where(~blank | failed), found.where(blank & ~failed).groupBy(doc).agg(F.count("*").alias("n_dropped"))


def split_tokens(elements: DataFrame, doc: str, max_tokens: int) -> DataFrame:
    """(<doc>, ord, piece, start, text): exact substrings of elements, of at most `max_tokens` tokens each, and where they begin."""
    kind = dict(elements.dtypes)[doc]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, o, t in zip(pdf[doc], pdf["ord"], pdf["text"], strict=True):
                if isinstance(t, str) and token_spans(t):
                    rows += [(d, o, k, p.start, p.text) for k, p in enumerate(pieces_of(Piece(0, 0, 0, len(t), t), max_tokens))]
            yield pd.DataFrame(rows, columns=[doc, "ord", "piece", "start", "text"])

    slim = elements.select(F.col(doc).cast("string").alias(doc), "ord", "text")
    return slim.mapInPandas(run, f"{doc} string, ord int, piece int, start int, text string").withColumn(doc, F.col(doc).cast(kind))
