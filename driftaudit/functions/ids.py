"""Content-derived identities: canonical JSON fragments, SHA-256, base32 and the ids made of them, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The order of digits of base 32 as `conv` writes them, and of the RFC 4648 alphabet in lower case.
_CONV = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"
#: The prefixes of ids by record kind.
PREFIXES = {"source": "src", "version": "ver", "parse_run": "prs", "chunk": "chk", "embedding": "emb", "binding": "idx", "pii": "pii", "license": "lic", "acl": "acl", "tenant": "tnt", "quality": "qua", "finding": "fnd"}
_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def let(value: Column, f) -> Column:
    """f(value) with the value bound to a variable: an id made of an id made of an id would else grow as a power of its uses."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def plain(c: Column) -> Column:
    """An id or a hash as JSON: they have no character to escape."""
    return F.concat(F.lit('"'), c, F.lit('"'))


def json_string(c: Column) -> Column:
    """The string as canonical JSON: only quotes, backslashes and control characters are escaped."""
    # as one text: an expression in Python is a call to the JVM for each of its parts
    table = F.expr("map(" + ", ".join(f"char({code}), '{_SHORT.get(chr(code), f'{chr(92)}u{code:04x}').replace(chr(92), chr(92) * 2)}'" for code in range(32)) + ")")

    def escaped(s: Column) -> Column:
        # one lookup per character, only for strings that have a control character
        rare = F.array_join(F.transform(F.split(s, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")
        return F.concat(F.lit('"'), F.when(s.rlike(r"[\x00-\x1f]"), rare).otherwise(s), F.lit('"'))

    return let(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), escaped)


def json_array(*parts: Column) -> Column:
    """Canonical JSON array of parts that are canonical JSON text; null if one is null."""
    inner = [x for i, p in enumerate(parts) for x in ([F.lit(",")] if i else []) + [p]]
    return F.concat(F.lit("["), *inner, F.lit("]"))


def json_strings(a: Column) -> Column:
    """Canonical JSON array of an array of strings."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, json_string), ","), F.lit("]"))


def json_object(members: dict[str, Column]) -> Column:
    """Canonical JSON object with ASCII names; members whose value is null are left out."""
    parts = [F.concat(F.lit(f'"{k}":'), members[k]) for k in sorted(members)]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def base32(hex64: Column) -> Column:
    """64 hex digits as 52 base-32 characters without padding: groups of 60 bits through `conv`, which stays in code generation."""
    padded = F.concat(hex64, F.lit("0"))
    groups = [F.lpad(F.conv(F.substring(padded, i, n), 16, 32), n * 4 // 5, "0") for i, n in ((1, 15), (16, 15), (31, 15), (46, 15), (61, 5))]
    return F.translate(F.concat(*groups), _CONV, BASE32)


def content_id(kind: str, *parts: Column) -> Column:
    """`<prefix>_sha256_<base32>` over the canonical JSON array of the parts (JSON text)."""
    return F.concat(F.lit(f"{PREFIXES[kind]}_sha256_"), let(F.sha2(json_array(*parts), 256), base32))


def id_of_strings(kind: str, *parts: Column) -> Column:
    return content_id(kind, *map(json_string, parts))


def payload_hash(acl: Column, chunk_id: Column, embedding_id: Column, source_id: Column, source_version_id: Column, tenant: Column) -> Column:
    """SHA-256 of the canonical payload projection; null members are left out."""
    return F.sha2(json_object({"acl": json_strings(acl), "chunk_id": plain(chunk_id), "embedding_id": plain(embedding_id), "source_id": plain(source_id), "source_version_id": plain(source_version_id), "tenant": json_string(tenant)}), 256)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a string column, from nested digests, as hex."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "utf-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def hkdf_sha256(secret: bytes, info: bytes, length: int = 32, salt: bytes = b"") -> bytes:
    """RFC 5869, on the driver."""
    import hashlib
    import hmac

    prk = hmac.new(salt or bytes(32), secret, hashlib.sha256).digest()
    out, block, n = b"", b"", 0
    while len(out) < length:
        n += 1
        block = hmac.new(prk, block + info + bytes([n]), hashlib.sha256).digest()
        out += block
    return out[:length]


def utc_text(ts: Column) -> Column:
    """ISO time with `Z`, with microseconds only where they aren't zero; the session's time zone must be UTC."""
    fraction = F.when(F.unix_micros(ts) % 1_000_000 != 0, F.date_format(ts, ".SSSSSS")).otherwise("")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def ordered_digest(df: DataFrame, group: str, order: list[str], item: str) -> DataFrame:
    """(<group>, digest, n): SHA-256 of `[item,item,...]` in the order given. A sequence can only be hashed in sequence: a
    group is one task's, but streams through it, so no group has to fit into memory."""
    import hashlib

    import pandas as pd

    def run(batches):
        state: dict = {"key": None, "sha": None, "n": 0}

        def close() -> list[tuple]:
            if state["sha"] is None:
                return []
            state["sha"].update(b"]")
            return [(state["key"], state["sha"].hexdigest(), state["n"])]

        for pdf in batches:
            out = []
            for key, text in zip(pdf[group].tolist(), pdf[item].tolist(), strict=True):
                if state["sha"] is None or key != state["key"]:
                    out += close()
                    state |= {"key": key, "sha": hashlib.sha256(b"["), "n": 0}
                state["sha"].update((b"," if state["n"] else b"") + text.encode())
                state["n"] += 1
            yield pd.DataFrame(out, columns=[group, "digest", "n"])
        yield pd.DataFrame(close(), columns=[group, "digest", "n"])

    slim = df.select(group, *order, F.col(item)).repartition(group).sortWithinPartitions(group, *order)
    return slim.select(group, item).mapInPandas(run, f"{group} {dict(df.dtypes)[group]}, digest string, n bigint")


def set_digest(df: DataFrame, group: list[str], digest: Column) -> DataFrame:
    """(<group>, digest, n): SHA-256 over 4096 digests, each over the distinct row digests that begin alike, sorted. Order-free,
    and no task holds more than such a part of a group."""
    rows = df.select(*group, digest.alias("h_")).distinct()
    parts = rows.groupBy(*group, F.substring("h_", 1, 3).alias("p_")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h_")), ""), 256).alias("d_"), F.count("*").alias("n_"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_", "d_"))), lambda x: x["d_"]), "")
    return parts.groupBy(*group).agg(F.sha2(joined, 256).alias("digest"), F.sum("n_").alias("n"))
