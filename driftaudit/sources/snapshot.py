"""Snapshot files: a header line, a line per point, a trailer line, as canonical JSON, compressed with zstd.

`SnapshotSource` reads them as a Spark data source (one partition per file, for a compressed stream can't be split) and
checks count and hash; `write_snapshot` writes them in order. The hash covers the point lines in order, so it is made in
one ordered task; `bulk_digest` is the order-free digest for tables that need not be one file.
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from driftaudit.functions.canonical import canonical
from driftaudit.functions.ids import utc_text

FIELDS = ("point_id", "payload_hash", "source_id", "source_version_id", "chunk_id", "embedding_id", "tenant", "observed_at", "raw_locator")
NESTED = {"acl": "array<string>", "vector_names": "array<string>", "vector_dimensions": "map<string,int>", "vector_hashes": "map<string,string>", "normalization_warnings": "array<string>"}
SCHEMA = "target_id string, scope string, ord bigint, " + ", ".join([*(f"{f} string" for f in FIELDS), *(f"{f} {t}" for f, t in NESTED.items())])


class SnapshotError(ValueError):
    """A snapshot that is truncated, altered or not a snapshot."""


def _lines(path: str) -> Iterator[bytes]:
    import zstandard

    with open(path, "rb") as f, zstandard.ZstdDecompressor().stream_reader(f) as z:
        yield from io.BufferedReader(z, 1 << 20)


def read_points(path: str, check_duplicates: bool = False) -> Iterator[tuple[dict, dict]]:
    """(header, point) in file order; raises SnapshotError when the trailer's count or hash disagrees."""
    header, digest, n, trailer, seen = None, hashlib.sha256(), 0, None, set()
    for line in _lines(path):
        record = json.loads(line)
        kind = record.get("record_type")
        if header is None:
            if kind != "header":
                raise SnapshotError(f"{path}: no header")
            header = record
        elif kind == "trailer":
            trailer = record
        elif trailer is not None:
            raise SnapshotError(f"{path}: lines after the trailer")
        else:
            digest.update(line)
            n += 1
            if check_duplicates:
                key = canonical(record["point_id"])
                if key in seen:
                    raise SnapshotError(f"{path}: point {key} twice")
                seen.add(key)
            yield header, record
    if trailer is None:
        raise SnapshotError(f"{path}: no trailer, the file is truncated")
    if trailer["point_count"] != n or trailer["content_hash"] != digest.hexdigest():
        raise SnapshotError(f"{path}: count or hash differs from the trailer")


def read_header(path: str) -> dict:
    line = next(iter(_lines(path)), None)
    header = json.loads(line) if line else {}
    if header.get("record_type") != "header":
        raise SnapshotError(f"{path}: no header")
    return header


def read_trailer(path: str) -> dict:
    """The last line, which says how the scan went."""
    last = b"{}"
    for line in _lines(path):
        last = line
    trailer = json.loads(last)
    if trailer.get("record_type") != "trailer":
        raise SnapshotError(f"{path}: no trailer, the file is truncated")
    return trailer


def observed(points: DataFrame) -> DataFrame:
    """Points of a snapshot as the observed side of a match."""
    return points.select(F.col("point_id").alias("point_key"), "embedding_id", "chunk_id", "source_id", "source_version_id", "payload_hash", "tenant", "acl", F.col("vector_dimensions").alias("dimensions"), "vector_hashes", "ord")


class SnapshotSource(DataSource):
    """`spark.read.format("snapshot").option("checkDuplicates", "true").load(file or folder)`"""

    @classmethod
    def name(cls) -> str:
        return "snapshot"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.check = options["path"], options.get("checkDuplicates", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        p = Path(self.path)
        return [InputPartition(str(f)) for f in (sorted(p.glob("*.zst")) if p.is_dir() else [p])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i, (header, point) in enumerate(read_points(partition.value, self.check)):
            values = [canonical(point["point_id"]), *(point.get(f) for f in FIELDS[1:])]
            yield (header["target_id"], header["scope"], i, *values, *(point.get(f) for f in NESTED))


def write_snapshot(points: DataFrame, path: str, header: dict, finished_at: str, consistency=None) -> dict:
    """Writes the points in order of `ord`, streaming partition by partition through the driver; returns the trailer.

    `consistency` is a function that is called when all points are written, as `scan` of a target gives it.
    """
    import zstandard

    digest, n = hashlib.sha256(), 0
    wanted = [c for c in (*FIELDS, *NESTED) if c in points.columns]
    if "observed_at" in wanted and dict(points.dtypes)["observed_at"] != "string":
        points = points.withColumn("observed_at", utc_text(F.col("observed_at")))
    ordered = points.orderBy("ord").select("ord", *wanted)
    with open(path, "wb") as f, zstandard.ZstdCompressor(level=3, write_checksum=True).stream_writer(f) as z:
        z.write((canonical(header | {"record_type": "header"}) + "\n").encode())
        for row in ordered.toLocalIterator(prefetchPartitions=True):
            r = row.asDict()
            point = {k: v for k, v in r.items() if v is not None and k not in ("ord", "point_id")}
            line = (canonical(point | {"record_type": "point", "point_id": json.loads(r["point_id"])}) + "\n").encode()
            digest.update(line)
            n += 1
            z.write(line)
        trailer = {"record_type": "trailer", "point_count": n, "content_hash": digest.hexdigest(), "finished_at": finished_at}
        if consistency:
            said = consistency()
            trailer |= {k: v for k, v in (("consistency_completeness", said.completeness), ("consistency_start_count", said.start_count), ("consistency_end_count", said.end_count)) if v is not None}
        z.write((canonical(trailer) + "\n").encode())
    return trailer


def bulk_digest(points: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n_points, digest): the sum of row hashes, which any number of tasks can make in any order."""
    h = F.sha2(F.to_json(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns))), 256)
    lanes = [F.sum(F.conv(F.substring(h, i, 8), 16, 10).cast("decimal(10,0)")).cast("string") for i in (1, 9, 17, 25)]
    return points.agg(F.count("*").alias("n_points"), F.sha2(F.concat_ws("|", *lanes), 256).alias("digest"))
