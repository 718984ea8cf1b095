"""Embedding providers: what they are called, what they give, and what happens when they fail."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftaudit.functions.canonical import canonical
from driftaudit.functions.text import as_float32, finite, hash_embedding, l2_normalized


class ProviderError(RuntimeError):
    """A call that failed, or a vector that can't be used; worth another try."""


class NotAvailable(RuntimeError):
    """A provider that can be named and configured, but not called here."""


@dataclass(frozen=True)
class Model:
    """A provider's identity. What isn't known is `unknown`, never guessed."""

    provider: str = "unknown"
    name: str = "unknown"
    revision: str = "unknown"
    dimension: int = 32
    dtype: str = "float32"

    def __post_init__(self) -> None:
        if isinstance(self.dimension, bool) or not isinstance(self.dimension, int) or self.dimension < 1:
            raise ValueError("a dimension is at least 1")

    def config_hash(self, normalization: str = "l2") -> str:
        parts = {"provider": self.provider, "name": self.name, "revision": self.revision, "dimension": self.dimension, "dtype": self.dtype, "normalization": normalization}
        return hashlib.sha256(canonical(parts).encode()).hexdigest()


@dataclass(frozen=True)
class Local:
    """The reference embedder: unit vectors projected from a hash of the text, as built-in expressions. No model of meaning."""

    dimension: int = 32
    seed: int = 0

    @property
    def model(self) -> Model:
        return Model("driftaudit-local", f"hash-projection-seed{self.seed}", "1", self.dimension)

    def embed(self, df: DataFrame, text: str, name: str = "vector") -> DataFrame:
        return df.withColumn(name, as_float32(l2_normalized(hash_embedding(F.col(text), self.seed, self.dimension)))).withColumn("embedding_error", F.lit(None).cast("string"))


@dataclass(frozen=True)
class Called:
    """A provider behind a function of a list of texts that gives as many vectors, in their order. Called on executors, in batches.

    `make` is called once per worker, so a model is loaded once. A batch that fails is tried again, then text by text, each
    twice; what fails still has no vector but an error. NaN, infinite and wrongly sized vectors count as failures.
    """

    model: Model
    make: Callable[[], Callable[[list[str]], list]]
    batch: int = 64
    tries: int = 2

    def embed(self, df: DataFrame, text: str, name: str = "vector") -> DataFrame:
        dimension, make, size, tries = self.model.dimension, self.make, self.batch, self.tries

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            call = make()

            def checked(texts: list[str]) -> list[list[float]]:
                vectors = call(texts)
                if len(vectors) != len(texts):
                    raise ProviderError(f"{len(vectors)} vectors for {len(texts)} texts")
                out = [np.asarray(v, np.float32) for v in vectors]
                if any(v.shape != (dimension,) or not np.isfinite(v).all() for v in out):
                    raise ProviderError(f"a vector is not {dimension} finite numbers")
                return [v.astype(float).tolist() for v in out]

            def attempt(texts: list[str]) -> tuple[list | None, str | None]:
                error = None
                for _ in range(tries):
                    try:
                        return checked(texts), None
                    except (ProviderError, OSError) as e:
                        error = f"EMBEDDING_FAILED: {e}"
                return None, error

            for series in batches:
                vectors: list = [None] * len(series)
                errors: list = [None] * len(series)
                known = [i for i, t in enumerate(series) if isinstance(t, str)]
                for lo in range(0, len(known), size):
                    part = known[lo : lo + size]
                    got, _ = attempt([series.iloc[i] for i in part])
                    for k, i in enumerate(part):
                        if got is not None:
                            vectors[i] = got[k]
                        else:
                            one, errors[i] = attempt([series.iloc[i]])
                            vectors[i] = one[0] if one else None
                yield pd.DataFrame({"vector": vectors, "error": errors})

        embedded = F.pandas_udf(run, "struct<vector:array<double>,error:string>")
        return df.withColumn("e_", embedded(F.col(text))).select(*df.columns, F.col("e_.vector").alias(name), F.col("e_.error").alias("embedding_error"))


@dataclass(frozen=True)
class Imported:
    """Vectors that were made elsewhere; nothing is computed, only checked."""

    model: Model = field(default_factory=Model)

    def embed(self, df: DataFrame, text: str, name: str = "vector") -> DataFrame:
        raise NotAvailable("imported vectors are not computed from texts")

    def vectors(self, df: DataFrame, vector: str) -> DataFrame:
        """`df` with the vector in 32-bit precision and `embedding_error` where it has a number that isn't finite or another dimension."""
        v = as_float32(F.col(vector))
        bad = F.when(v.isNull(), "VECTOR_MISSING").when(~finite(v), "VECTOR_NOT_FINITE").when(F.size(v) != self.model.dimension, "VECTOR_DIMENSION")
        return df.withColumn("embedding_error", bad).withColumn(vector, F.when(F.col("embedding_error").isNull(), v))


@dataclass(frozen=True)
class Unwired:
    """A provider that is known by name; calling it is an error until a `Called` takes its place."""

    model: Model

    def embed(self, df: DataFrame, text: str, name: str = "vector") -> DataFrame:
        raise NotAvailable(f"{self.model.provider} is not wired to a model here")


def with_cache(todo: DataFrame, text_hash: str, model: Model, cached: DataFrame | None, normalization: str = "l2") -> tuple[DataFrame, DataFrame | None]:
    """`todo` with `cache_key`, and those of its rows whose key `cached` doesn't have: what is left to embed."""
    from driftaudit.operators.build import stage_key

    key = stage_key("embed", F.col(text_hash), f"{model.provider}:{model.name}", model.revision, model.config_hash(normalization))
    keyed = todo.withColumn("cache_key", key)
    return keyed, keyed.join(cached.select("cache_key"), "cache_key", "left_anti") if cached is not None else keyed

