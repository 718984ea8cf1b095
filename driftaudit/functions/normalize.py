"""How ids, hashes and point ids compare.

Every function takes and returns a Column built from JVM expressions, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that may surround an id: ASCII, no-break space, the fixed-width spaces, the ideographic space, the byte-order mark.
WHITE = " \t\n\r\x0b\x0c\x85\xa0" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(WHITE))


def norm_id(c: Column) -> Column:
    """Ids compare trimmed and without regard to case; a blank id is null."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def norm_hash(c: Column) -> Column:
    """Hashes compare like ids and without an algorithm prefix (``sha256:``)."""
    return F.nullif(strip(F.substring_index(F.lower(strip(c)), ":", -1)), F.lit(""))


def point_key(c: Column) -> Column:
    """A point id as compact JSON text: keys sorted, no spaces, nothing escaped that need not be; null when blank.

    The JSON text becomes a variant, whose object fields are stored sorted, and is written out again. Text that is no
    JSON at all is taken for the string it shows, so ``point-1`` and ``"point-1"`` are the same point.
    """
    s = strip(c)
    bare = F.concat(F.lit('"'), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(F.length(s) > 0, F.coalesce(F.to_json(F.try_parse_json(s)), bare))


def wide_hash(*cols: Column) -> tuple[Column, Column]:
    """128 bits as two independent 64-bit lanes. Null differs from every value, and positions are kept apart."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in cols]
    return F.xxhash64(F.lit("a"), *parts), F.xxhash64(*reversed(parts), F.lit("b"), F.lit(7))
