"""Shell patterns over relative paths, as regular expressions that the JVM knows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PIECES = re.compile(r"\*+|\?|\[(!?)(\]?[^\]]*)\]|.", re.DOTALL)


def glob_regex(pattern: str) -> str:
    """`*` is any text, slashes included, `?` any character, `[...]` one of a set, `[!...]` none of it; the whole path must match."""

    def piece(m: re.Match) -> str:
        if m[0][0] == "*":
            return ".*"
        if m[0] == "?":
            return "."
        if m[2]:
            body = m[2].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&").replace("]", "\\]").replace("^", "\\^")
            return f"[{'^' if m[1] else ''}{body}]"
        return re.sub(r"([^\w\s/])", r"\\\1", m[0])

    return r"(?s)\A" + _PIECES.sub(piece, pattern) + r"\z"


def first_match(path: Column, rules: list[tuple[str, Column]]) -> Column:
    """The value of the first rule whose pattern matches; null if none does."""
    return F.coalesce(*(F.when(path.rlike(glob_regex(p)), v) for p, v in rules)) if rules else F.lit(None)
