"""Canonical JSON of arbitrary values (RFC 8785): for the driver, and for values whose shape isn't fixed."""

from __future__ import annotations

import json
import math
import re
import unicodedata

_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def _text(s: str) -> str:
    s = unicodedata.normalize("NFC", s)
    return '"' + re.sub(r'["\\\x00-\x1f]', lambda m: _ESCAPES.get(m[0]) or f"\\u{ord(m[0]):04x}", s) + '"'


def number(x: float) -> str:
    """As ECMAScript prints it: shortest digits, plain between 1e-7 and 1e21."""
    if not math.isfinite(x):
        raise ValueError("numbers must be finite")
    if x == 0:
        return "0"
    mantissa, _, exponent = f"{abs(x)!r}".partition("e") if "e" in repr(x) else (repr(abs(x)), "", "0")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exponent) if whole != "0" else int(exponent) - (len(part) - len(part.lstrip("0")))
    digits = digits.rstrip("0") or "0"
    n = len(digits)
    if n <= point <= 21:
        out = digits + "0" * (point - n)
    elif 0 < point <= 21:
        out = digits[:point] + "." + digits[point:]
    elif -6 < point <= 0:
        out = "0." + "0" * -point + digits
    else:
        e = point - 1
        out = digits[0] + ("." + digits[1:] if n > 1 else "") + "e" + ("+" if e > 0 else "-") + str(abs(e))
    return ("-" if x < 0 else "") + out


def canonical(v) -> str:
    """Keys in UTF-16 order, strings in NFC, numbers as ECMAScript, no white space."""
    if v is None or isinstance(v, bool):
        return json.dumps(v)
    if isinstance(v, str):
        return _text(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return number(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canonical, v)) + "]"
    if isinstance(v, dict):
        if not all(isinstance(k, str) for k in v):
            raise TypeError("keys must be strings")
        return "{" + ",".join(f"{_text(k)}:{canonical(v[k])}" for k in sorted(v, key=lambda k: k.encode("utf-16-be"))) + "}"
    raise TypeError(f"{type(v).__name__} has no canonical form")
