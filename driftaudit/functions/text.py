"""Texts and vectors: normal forms, hashes, tokens, embeddings."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftaudit.functions.ids import let

TOKEN = r"[^\s\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def line_ends(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def with_normalized(df: DataFrame, text: str, name: str) -> DataFrame:
    """`df` with the text in NFC with plain line ends. Only rows that may change leave the JVM: those with a character from U+0300 on."""
    d = df.withColumn(name, line_ends(F.col(text)))
    hard = F.coalesce(F.col(name).rlike(r"[^\x{0}-\x{2ff}]"), F.lit(False))
    return d.where(~hard).unionByName(d.where(hard).withColumn(name, _nfc(F.col(name))))


def with_text_hash(df: DataFrame, text: str, name: str) -> DataFrame:
    """`df` with SHA-256 of the text in normal form: NFC, plain line ends, nothing trimmed."""
    kept = df.columns
    return with_normalized(df, text, "normal_").select(*kept, F.sha2(F.col("normal_"), 256).alias(name))


def token_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(TOKEN)), F.lit(0))


def paragraphs(c: Column) -> Column:
    """Blank-line paragraphs, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(line_ends(c), "\n\n"), lambda p: F.btrim(p, F.lit(" \t\n\x0b\x0c\r"))), lambda p: p != "")


def l2_normalized(v: Column) -> Column:
    """The vector over its length; a zero vector becomes the first unit vector."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda _, i: F.when(i == 0, 1.0).otherwise(0.0)))


def finite(v: Column, dimension: int | None = None) -> Column:
    ok = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return ok & (F.size(v) == dimension) if dimension else ok


def hash_embedding(text: Column, seed: int, dimension: int) -> Column:
    """Deterministic vector in [-1, 1]: a SHA-256 counter stream over `seed:text`, four bytes per number."""
    blocks = -(-dimension // 8)

    def block(i: Column) -> Column:
        h = F.sha2(F.concat(F.encode(F.concat(F.lit(f"{seed}:"), text), "utf-8"), F.unhex(F.lpad(F.hex(i), 8, "0"))), 256)
        return let(h, lambda x: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.conv(F.substring(x, k * 8 + 1, F.lit(8)), 16, 10).cast("double") / 4294967295.0 * 2.0 - 1.0))

    return F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), block)), 1, dimension)


def as_float32(v: Column) -> Column:
    """The doubles that the nearest 32-bit numbers are."""
    return v.cast("array<float>").cast("array<double>")


def vector_literal(c: Column) -> Column:
    """`[0.1,0.2]`, or without brackets, as doubles; empty text is the empty vector, and null comes out if any part is no number."""
    inner = F.trim(c)
    inner = F.when(inner.startswith("[") & inner.endswith("]"), F.substring(inner, F.lit(2), F.length(inner) - 2)).otherwise(inner)
    parts = F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("double"))
    return F.when(inner == "", F.array().cast("array<double>")).when(~F.exists(parts, lambda x: x.isNull()), parts)


def starts(lengths: Column) -> Column:
    """Running sums before each element, in runs of 256 so that long lists don't take quadratic time."""
    run = 256

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda acc, x: acc + x)

    def of(i: Column) -> Column:
        return F.floor(i / run).cast("int")

    def place(lens: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), of(F.size(lens) - 1)), lambda g: total(F.slice(lens, g * run + 1, F.lit(run))))
        before = let(sums, lambda x: F.transform(x, lambda _, g: total(F.slice(x, F.lit(1), g))))
        return let(before, lambda b: F.transform(lens, lambda _, i: F.get(b, of(i)) + total(F.slice(lens, of(i) * run + 1, i % run))))

    return let(lengths, place)


@F.pandas_udf(T.StringType())
def vector_hash_f32(s: pd.Series) -> pd.Series:
    """SHA-256 of the little-endian float32 bytes."""
    import hashlib

    return s.map(lambda v: hashlib.sha256(np.asarray(v, "<f4").tobytes()).hexdigest(), na_action="ignore")


@F.pandas_udf(T.StringType())
def vector_hash_json(s: pd.Series) -> pd.Series:
    """SHA-256 of the canonical JSON array of the doubles."""
    import hashlib

    from driftaudit.functions.canonical import canonical

    return s.map(lambda v: hashlib.sha256(canonical([float(x) for x in v]).encode()).hexdigest(), na_action="ignore")
