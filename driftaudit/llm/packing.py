"""Documents combined into containers of fixed capacity.

Method: best-two-fit. A container is filled greedily with the largest document that fits; then its smallest document is
replaced by two unpacked ones that fill the widened gap more tightly, as long as that helps.

Containers are packed within groups of about `group_items` documents, formed by a hash of the document id: a group is
large enough for its last, badly filled container not to matter, and small enough for one task, however large the table.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftaudit.llm.tokens import with_tokens


class Pool:
    """Item numbers by size, largest fitting first."""

    def __init__(self, sizes: np.ndarray):
        self.by: dict[int, list[int]] = {}
        for i in np.argsort(sizes, kind="stable")[::-1]:
            self.by.setdefault(int(sizes[i]), []).append(int(i))
        self.sizes = sorted(self.by)

    def largest(self, most: int) -> int | None:
        i = bisect_right(self.sizes, most)
        return self.sizes[i - 1] if i else None

    def take(self, size: int) -> int:
        items = self.by[size]
        item = items.pop()
        if not items:
            del self.by[size]
            self.sizes.remove(size)
        return item

    def put(self, size: int, item: int) -> None:
        if size not in self.by:
            self.by[size] = []
            insort(self.sizes, size)
        self.by[size].append(item)

    def two(self, room: int, more_than: int) -> tuple[int, int] | None:
        """The sizes of the two items with the largest sum above `more_than` and within `room`."""
        s = np.array(self.sizes)
        a = s[: bisect_right(self.sizes, room // 2)]
        if not len(a):
            return None
        j = np.searchsorted(s, room - a, side="right") - 1
        b = s[j]
        single = np.array([len(self.by[int(x)]) == 1 for x in a]) & (b == a)
        # the same item can't be taken twice: then the next smaller one
        b = np.where(single, np.where(j > 0, s[np.maximum(j - 1, 0)], -room), b)
        best = int((a + b).argmax())
        return (int(a[best]), int(b[best])) if a[best] + b[best] > more_than else None


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item; every size must be between 1 and the capacity."""
    pool, out, no = Pool(sizes), np.zeros(len(sizes), np.int64), 0
    while pool.sizes:
        size = pool.sizes[-1]
        held = [(size, pool.take(size))]
        gap = capacity - size
        while gap and (size := pool.largest(gap)) is not None:
            held.append((size, pool.take(size)))
            gap -= size
        while gap and len(held) > 1 and (pair := pool.two(gap + held[-1][0], held[-1][0])):
            small, item = held.pop()
            gap += small
            held += [(x, pool.take(x)) for x in sorted(pair, reverse=True)]
            pool.put(small, item)
            held.sort(reverse=True)
            gap -= sum(pair)
        for _, item in held:
            out[item] = no
        no += 1
    return out


def pack(docs: DataFrame, capacity: int, tokenizer: str, key: str = "doc_id", text: str = "text", group_items: int = 20_000) -> DataFrame:
    """(container_id, <key>, piece_no, token_start, n_tokens): every document, in containers of at most `capacity` tokens.

    A document is in one container whole, unless it is larger than the capacity: then its full pieces are containers of
    their own and the rest is packed as a document of its size. Null and empty texts have no tokens; they stand in a
    container `empty` of no tokens. Equal keys and equal texts are packed each by itself.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    groups = max(1, -(-docs.count() // group_items))
    sized = with_tokens(docs, text, {key: F.col(key), "row_": F.monotonically_increasing_id()}, tokenizer)
    n, cap = F.col("n_tokens"), F.lit(capacity)
    full = F.floor(n / cap).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(full - F.when(n % cap == 0, 1).otherwise(0), F.lit(0))), lambda i: F.struct(i.cast("int").alias("piece_no"), F.least(cap, n - i * cap).cast("bigint").alias("n_tokens")))
    cut = sized.select(key, "row_", F.inline(pieces)).withColumn("token_start", (F.col("piece_no") * cap).cast("bigint"))
    alone = cut.where((F.col("n_tokens") == cap) | (F.col("n_tokens") == 0)).select(
        F.when(F.col("n_tokens") == 0, "empty").otherwise(F.concat(F.lit("full-"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("-"), F.col("piece_no"), F.lit("-"), F.col("row_"))).alias("container_id"), key, "piece_no", "token_start", "n_tokens"
    )
    rest = cut.where((F.col("n_tokens") < cap) & (F.col("n_tokens") > 0)).withColumn("group", F.pmod(F.xxhash64(key, "piece_no"), F.lit(groups)).cast("int"))
    kind = dict(docs.dtypes)[key]

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_tokens", key, "piece_no"], kind="stable")
        number = best_two_fit(part["n_tokens"].to_numpy(), capacity)
        return part.assign(container_id=[f"{g}-{i}" for g, i in zip(part["group"], number, strict=True)])[["container_id", key, "piece_no", "token_start", "n_tokens"]]

    # keys go through pandas as text: beside a null it would make floats of integers
    rest = rest.withColumn(key, F.col(key).cast("string"))
    packed = rest.groupBy("group").applyInPandas(fill, f"container_id string, {key} string, piece_no int, token_start bigint, n_tokens bigint")
    return alone.unionByName(packed.withColumn(key, F.col(key).cast(kind)))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(n_containers, n_documents, n_tokens, fill): one row; fill is the share of the capacity that is used."""
    bins = packed.where("container_id <> 'empty'").groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("items"))
    return bins.agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("items"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), (F.sum("n") / (F.count("*") * capacity)).alias("fill"))
