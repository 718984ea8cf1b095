"""Source discovery: records of files, media types, ignore rules, tombstones, catalog upsert."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftaudit.functions.ids import id_of_strings

#: Extensions whose media type does not follow from the system's table.
EXTENSIONS = {
    "md": "text/markdown", "markdown": "text/markdown", "html": "text/html", "htm": "text/html", "json": "application/json", "csv": "text/csv", "txt": "text/plain", "pdf": "application/pdf",
}


def media_type(path: Column, content: Column) -> Column:
    """PDF by its first bytes, then by extension, then HTML by its first 4096 bytes, then text if it is UTF-8."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    by_extension = reduce(lambda acc, kv: acc.when(extension == kv[0], kv[1]), EXTENSIONS.items(), F.when(F.lit(False), ""))
    head = F.substring(content, 1, 4096)
    text = F.try_validate_utf8(F.decode(head, "ISO-8859-1"))
    return (
        F.when(F.startswith(content, F.lit(b"%PDF-")), "application/pdf").otherwise(
            F.coalesce(by_extension, F.when(F.contains(F.lower(text), F.lit("<html")), "text/html"), F.when(F.is_valid_utf8(content.cast("string")), "text/plain"), F.lit("application/octet-stream"))
        )
    )


def ignore_regex(pattern: str) -> tuple[str, bool]:
    """A line of an ignore file as a regular expression over relative paths, and whether it takes back (`!`)."""
    negated = pattern.startswith("!")
    p = pattern[negated:]
    anchored = "/" in p.rstrip("/")
    directory = p.endswith("/")
    p = p.strip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if directory else "(?:/.*)?$"), negated


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last rule that matches a relative path ignores it."""
    rules = [ignore_regex(p) for p in patterns if p.strip() and not p.startswith("#")]
    hits = [F.when(path.rlike(regex), F.lit(not negated)) for regex, negated in reversed(rules)]
    return F.coalesce(*hits, F.lit(False))


def discover(spark: SparkSession, root: str, namespace: str, ignore: list[str] = (), size_cap: int = 100 << 20, follow_links: bool = False) -> DataFrame:
    """One source record per file under `root`: id, version_id, namespace, uri, media_type, size_bytes, content_hash, modified_at,
    status, content, and `error`.

    The listing is a snapshot taken when the plan runs; a file that is no longer of the size listed is `SOURCE_CHANGED`.
    Files above the cap are `INPUT_TOO_LARGE` rows without content, hash and version. Of a local folder, files behind
    symbolic links are left out unless `follow_links`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1]
    rel = F.regexp_replace("path", "^.*?" + re.escape(base) + "/", "")
    files = files.withColumn("rel", rel).where(~is_ignored(F.col("rel"), list(ignore)) & ~F.col("rel").rlike(r"(^|/)\.git/"))
    if not follow_links and (links := linked_paths(base)):
        files = files.where(~reduce(lambda a, p: a | (F.col("rel") == p) | F.col("rel").startswith(p + "/"), links[1:], (F.col("rel") == links[0]) | F.col("rel").startswith(links[0] + "/")))
    large = F.col("length") > size_cap
    error = F.when(large, "INPUT_TOO_LARGE").when(F.octet_length("content") != F.col("length"), "SOURCE_CHANGED")
    content = F.when(~large, F.col("content"))
    d = files.select(F.lit(namespace).alias("namespace"), F.concat(F.lit("file:"), F.col("rel")).alias("uri"), media_type(F.col("rel"), content).alias("media_type"), F.col("length").alias("size_bytes"), F.sha2(content, 256).alias("content_hash"), F.col("modificationTime").alias("modified_at"), content.alias("content"), error.alias("error"))
    d = d.withColumn("id", id_of_strings("source", F.col("namespace"), F.col("uri")))
    return d.withColumn("version_id", id_of_strings("version", F.col("id"), F.col("content_hash"))).withColumn("status", F.lit("active"))


def linked_paths(folder: str) -> list[str]:
    """Symbolic links in a local folder, as relative paths; none of any other folder."""
    import os

    out: list[str] = []
    for at, folders, names in os.walk(folder) if os.path.isdir(folder) else ():
        out += [os.path.relpath(os.path.join(at, n), folder) for n in (*folders, *names) if os.path.islink(os.path.join(at, n))]
    return sorted(out)


def tombstones(previous: DataFrame, present: DataFrame) -> DataFrame:
    """Previous sources that are not present any more, the first of each id by `ord`, with status `tombstone`."""
    gone = previous.join(present.select("id"), "id", "left_anti")
    first = gone.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("ord"))).where("rn = 1").drop("rn")
    return first.withColumn("status", F.lit("tombstone"))


def upsert(catalog: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """A catalog of sources after a scan: found rows replace those of their id, and what wasn't found becomes a tombstone."""
    old = catalog.select("id", *(F.col(c).alias(f"old_{c}") for c in columns))
    new = found.select("id", *columns, F.lit(True).alias("hit"))
    both = old.join(new, "id", "full")
    return both.select("id", *(F.when(F.col("hit"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in columns), F.when(F.col("hit"), "active").otherwise("tombstone").alias("status"))
