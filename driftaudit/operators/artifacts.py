"""Content-addressed artifacts: bytes under their SHA-256."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def put(rows: DataFrame, content: str, path: str) -> None:
    """Adds the distinct contents that the store doesn't have; running it again adds nothing."""
    new = rows.where(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("sha256"), F.col(content).alias("content")).dropDuplicates(["sha256"])
    try:
        new = new.join(rows.sparkSession.read.parquet(path).select("sha256"), "sha256", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.withColumn("shard", F.substring("sha256", 1, 2)).write.mode("append").partitionBy("shard").parquet(path)


def get(spark: SparkSession, path: str, sha256: str) -> bytes | None:
    row = spark.read.parquet(path).where((F.col("shard") == sha256[:2]) & (F.col("sha256") == sha256)).select("content").first()
    return bytes(row.content) if row else None


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """(sha256) of artifacts whose content has another hash than its name."""
    return spark.read.parquet(path).where(F.sha2("content", 256) != F.col("sha256")).select("sha256")


def exists(spark: SparkSession, path: str, digests: DataFrame) -> DataFrame:
    """(sha256, present) of digests that are asked for."""
    have = spark.read.parquet(path).select("sha256").withColumn("there", F.lit(True))
    return digests.select("sha256").distinct().join(have, "sha256", "left").select("sha256", F.coalesce("there", F.lit(False)).alias("present"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, size_bytes) of all artifacts."""
    return spark.read.parquet(path).select("sha256", F.octet_length("content").cast("bigint").alias("size_bytes"))
