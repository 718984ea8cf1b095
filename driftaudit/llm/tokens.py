"""Text sizes in tokens of a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level vocabularies of this family cut a text before merging. The same on every machine.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(docs: DataFrame, text: str, keep: dict, tokenizer: str, name: str = "n_tokens") -> DataFrame:
    """The columns of `keep` (name: Column) and the number of tokens of `text`, 0 where it is null; whole texts count.

    `tokenizer` is the path of a byte-level vocabulary as ranks, readable on every executor.
    """
    slim = docs.select(*(c.alias(n) for n, c in keep.items()), F.col(text).alias("text_"))
    fields = [f for f in slim.schema if f.name != "text_"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # columns of Arrow stay what they are; pandas would make floats of integers beside a null
        encoder = _encoder(tokenizer)
        for b in batches:
            at = b.schema.get_field_index("text_")
            n = pa.array([len(encoder.encode_ordinary(t)) if t is not None else 0 for t in b.column(at).to_pylist()], pa.int64())
            names = [*(f.name for i, f in enumerate(b.schema) if i != at), name]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), n], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"{name} bigint"])
    return slim.mapInArrow(count, schema)
