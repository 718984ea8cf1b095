"""Chunks whose elements hold more tokens than the limit, as pieces below it.

Method: balanced targets. The least number of pieces gives equal-length targets; each target moves to the strongest
boundary nearby (element end, sentence end, clause or line end), within what the limit allows; where that leaves no good
boundary, one more piece is planned.

Sizes come first, without texts: only the elements of oversized chunks have their texts shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftaudit.functions.normalize import norm_id, wide_hash
from driftaudit.session import BROADCAST_ROWS, lookup

_SPACE = r" \t\n\x0b\x0c\r\x85\xa0                　"
_TOKEN = f"[^{_SPACE}]+"
_FIND = re.compile(_TOKEN)
_SENTENCE = re.compile(r"[.!?。！？…।؟]+[\"'”’»)\]」』）]*$")
_CLAUSE = re.compile(r"[,;:،、，；：]$")
ELEMENT, SENTENCE, CLAUSE = 3, 2, 1


def token_count(text: Column) -> Column:
    """Longest runs of characters that are not Unicode white space."""
    return F.coalesce(F.regexp_count(text, F.lit(_TOKEN)), F.lit(0))


def _end(strength: np.ndarray, at: int, target: int, reach: int, limit: int, overlap: int, least: int) -> int:
    """Where the piece that begins at `at` ends: at the strongest boundary near its target, the nearest of equals.

    First near the target, where the rest still fits into the least count of pieces (from `least` on). If no element or
    sentence ends there, further before the target, then anywhere in the second half of the piece, at the price of one
    piece more; and where none ends at all, at the best that is near.
    """
    hi = min(len(strength) - 1, target + reach, at + limit)
    first = max(at + overlap + 1, at + 1)
    near: tuple[int, int] | None = None
    for lo in (max(first, target - reach, least), max(first, target - reach), max(first, at + limit // 2)):
        part = strength[lo - 1 : hi]
        if not len(part):
            continue
        best = int(part.max())
        if best > 0 and (near is None or best > near[0]):
            places = np.flatnonzero(part == best) + lo
            near = best, int(places[np.abs(places - target).argmin()])
        if near and near[0] >= SENTENCE:
            break
    return near[1] if near else min(target, hi)


def plan(strength: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of `len(strength)` tokens; strength[i] is that of the boundary after token i.

    Each piece has at most `limit` tokens, and each but the first begins `overlap` tokens before the end of the one before.
    The targets of what is left are worked out anew after each end, so one end that is off does not move the others, and
    a text takes time in proportion to its length.
    """
    n, step_most, at = len(strength), limit - overlap, 0
    out: list[tuple[int, int]] = []
    while n - at > limit:
        k = -(-(n - at - overlap) // step_most)  # the least count for what is left
        step = (n - at - overlap) / k
        end = _end(strength, at, min(at + limit, at + overlap + round(step)), int(step // 5), limit, overlap, n - (k - 1) * step_most)
        out.append((at, end))
        at = end - overlap
    return [*out, (at, n)] if n else []


def cut_elements(elements: list[tuple[str, int | None]], limit: int, overlap: int) -> list[dict]:
    """The pieces of one chunk: its (text, page) elements in order, joined by blank lines."""
    text, spans, strength, pages = "", [], [], []
    for body, page in elements:
        base = len(text)
        found = [(base + m.start(), base + m.end()) for m in _FIND.finditer(body)]
        text += body + "\n\n"
        for i, (a, b) in enumerate(found):
            word = text[a:b]
            gap = text[b : found[i + 1][0]] if i + 1 < len(found) else ""
            strength.append(ELEMENT if i + 1 == len(found) else SENTENCE if _SENTENCE.search(word) else CLAUSE if _CLAUSE.search(word) or "\n" in gap else 0)
        spans += found
        pages += [page] * len(found)
    out = []
    for a, b in plan(np.array(strength), limit, overlap):
        known = [p for p in pages[a:b] if p is not None]
        out.append({"token_start": a, "token_end": b, "page_start": min(known, default=None), "page_end": max(known, default=None), "boundary": int(strength[b - 1]), "piece": text[spans[a][0] : spans[b - 1][1]]})
    return out


SCHEMA = "chunk_id string, piece_no int, n_pieces int, token_start int, token_end int, page_start int, page_end int, boundary int, piece string"


def split_oversized(chunks: DataFrame, elements: DataFrame, limit: int = 512, overlap: int = 48, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The pieces of every chunk that holds more than `limit` tokens (SCHEMA).

    A chunk's tokens are those of the elements it names, in its order, each once; the texts decide, not token_count. Of an
    element delivered more than once the longest text counts. A chunk delivered twice with the same elements is one;
    with other elements, each list is judged by itself. `page_start` and `page_end` are those of the piece's elements,
    else those of the chunk, put in order. Lookups of up to `broadcast_rows` rows, all of them two 64-bit hashes, are
    broadcast, larger ones joined by shuffle; the pieces are the same. `boundary` is the strength of the piece's end: 3 element, 2 sentence, 1 clause
    or line, 0 none. Chunks without id or elements, element ids without text and empty tables yield nothing.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    loc, ids = F.col("locator"), F.array_distinct(F.array_compact(F.transform("locator.element_ids", norm_id)))
    first, last = F.least(loc["page_start"], loc["page_end"]), F.greatest(loc["page_start"], loc["page_end"])
    lists = chunks.where(F.size("locator.element_ids") > 0).select(norm_id(F.col("id")).alias("chunk_id"), ids.alias("ids"), first.alias("first"), last.alias("last"))
    lists = lists.where("chunk_id is not null").groupBy("chunk_id", "ids").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    lists = lists.withColumns({"k1": F.xxhash64("chunk_id", "ids"), "k2": F.xxhash64("ids", "chunk_id", F.lit(1))})
    sized = elements.where("text is not null").select(norm_id(F.col("id")).alias("e"), token_count(F.col("text")).alias("n"))
    sizes = sized.groupBy("e").agg(F.max("n").alias("n"))
    total = lists.select("k1", "k2", F.explode("ids").alias("e")).join(sizes, "e").groupBy("k1", "k2").agg(F.sum("n").alias("n"))
    big = lists.join(lookup(total.where(F.col("n") > limit).select("k1", "k2"), broadcast_rows), ["k1", "k2"], "left_semi")
    refs = big.select("k1", "k2", "chunk_id", "first", "last", F.posexplode("ids").alias("pos", "e"))
    h1, h2 = (h.alias(f"h{i}") for i, h in enumerate(wide_hash(F.col("e")), 1))
    needed = lookup(refs.select(h1, h2).distinct(), broadcast_rows)
    bodies = elements.where("text is not null").select(norm_id(F.col("id")).alias("e"), "text", "page").select("*", h1, h2)
    bodies = bodies.join(needed, ["h1", "h2"], "left_semi").groupBy("e").agg(F.max_by(F.struct("text", "page"), F.struct(token_count(F.col("text")).alias("n"), "text")).alias("body"))
    whole = refs.join(bodies, "e").groupBy("k1", "k2").agg(
        F.first("chunk_id").alias("chunk_id"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.sort_array(F.collect_list(F.struct("pos", "body.text", "body.page"))).alias("parts"),
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            rows = []
            for chunk_id, lo, hi, parts in zip(pdf["chunk_id"], pdf["first"], pdf["last"], pdf["parts"], strict=True):
                pieces = cut_elements([(p["text"], None if p["page"] is None or p["page"] != p["page"] else int(p["page"])) for p in parts], limit, overlap)
                for i, p in enumerate(pieces):
                    if p["page_start"] is None:
                        p |= {"page_start": None if pd.isna(lo) else int(lo), "page_end": None if pd.isna(hi) else int(hi)}
                    rows.append({"chunk_id": chunk_id, "piece_no": i, "n_pieces": len(pieces)} | p)
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({c: "Int32" for c in columns[1:-1]})

    return whole.select("chunk_id", "first", "last", "parts").mapInPandas(cut, SCHEMA)
