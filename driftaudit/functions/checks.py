"""Check digits, masks and access lists, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _places(number: Column, n: int) -> list[Column]:
    """The last n decimal digits of a number, the last one first. Long arithmetic, so all of it is compiled."""
    return [F.call_function("div", number, F.lit(10**k).cast("bigint")) % 10 for k in range(n)]


def _all(*tests: Column) -> Column:
    """Whether all hold. As a sum, for only what is evaluated in any case counts as a common subexpression."""
    return sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests[1:]), F.coalesce(tests[0], F.lit(False)).cast("int")) == len(tests)


def luhn_ok(c: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    d = digits(c)
    padded = F.lpad(d, 20, "0")  # zeros in front add nothing; longer numbers are refused by their length
    halves = [F.substring(padded, 11, 10).cast("bigint"), F.substring(padded, 1, 10).cast("bigint")]
    total = F.lit(0).cast("bigint")
    for i, v in enumerate(v for half in halves for v in _places(half, 10)):
        total = total + (v if i % 2 == 0 else v * 2 - (v > 4).cast("int") * 9)
    return _all(F.length(d).between(13, 19), total % 10 == 0)


def ssn_ok(c: Column) -> Column:
    """Nine digits with an area that is not 000, 666 or 9xx, a group that is not 00 and a serial that is not 0000."""
    return digits(c).rlike(r"^(?!000|666|9)\d{3}(?!00)\d{2}(?!0000)\d{4}$")


def tckn_ok(c: Column) -> Column:
    """Eleven digits, whatever stands between them, not beginning with 0, with both check digits right."""
    text = digits(c)
    d = _places(F.coalesce(F.right(F.lpad(text, 11, "0"), F.lit(11)).cast("bigint"), F.lit(0)), 11)[::-1]
    tenth = F.pmod((d[0] + d[2] + d[4] + d[6] + d[8]) * 7 - (d[1] + d[3] + d[5] + d[7]), F.lit(10))
    last = sum(d[1:10], d[0]) % 10
    return _all(F.length(text) == 11, d[0] > 0, tenth == d[9], last == d[10])


def iban_ok(c: Column) -> Column:
    """15 to 34 characters whose rearranged value is 1 modulo 97."""
    s = F.upper(F.regexp_replace(c, r"[\s-]", ""))
    turned = F.concat(F.substring(s, 5, 34), F.substring(s, 1, 4))

    def add(acc: Column, ch: Column) -> Column:
        n = F.conv(ch, 36, 10).cast("int")
        return F.pmod(acc * F.when(n > 9, 100).otherwise(10) + n, F.lit(97))

    return F.when(s.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$"), F.aggregate(F.split(turned, ""), F.lit(0), lambda a, ch: F.when(ch == "", a).otherwise(add(a, ch))) == 1).otherwise(False)


def mask_email(c: Column) -> Column:
    """`jo***@ma***.rest.of.host`: two characters of the local part and of the host's first label, one where there are no three."""

    def begun(x: Column) -> Column:
        return F.concat(F.left(x, F.when(F.length(x) > 2, 2).otherwise(1)), F.lit("***"))

    local, host = F.substring_index(c, "@", 1), F.substring(c, F.instr(c, "@") + 1, F.length(c))
    label = F.substring_index(host, ".", 1)
    rest = F.when(F.length(host) > F.length(label) + 1, F.substring(host, F.length(label) + 1, F.length(host))).otherwise("")
    return F.when((F.instr(c, "@") == 0) | (host == ""), mask_generic(c)).otherwise(F.concat(begun(local), F.lit("@"), begun(label), rest))


def mask_generic(c: Column) -> Column:
    """All but the last four characters as stars; four or fewer become stars throughout."""
    n = F.length(c)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - 4), F.right(c, F.lit(4))))


#: Fixed value: the grammar of access entries.
ACL_GRAMMAR = r"^(PUBLIC|(USER|GROUP|ROLE):.+|ATTRIBUTE:[^=]+=.+)$"


def acl_valid(entry: Column) -> Column:
    return entry.rlike(ACL_GRAMMAR)


def acl_problem(entries: Column) -> Column:
    """Null if all entries are in order, else `unsupported` (an entry denies access, which no list can say) or `invalid`."""
    return F.when(F.exists(entries, lambda e: e.rlike("(?i)^DENY:")), "unsupported").when(F.exists(entries, lambda e: ~acl_valid(e)), "invalid")


def acl_projection(raw: Column) -> Column:
    """A binding's access projection (JSON text) as a list: null stays null, a list its texts, anything else a list of one."""
    v = F.try_parse_json(raw)
    listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string"))
    return F.when(v.isNotNull() & ~F.is_variant_null(v), F.coalesce(listed, F.array(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))))


def tenant_projection(raw: Column) -> Column:
    """A binding's tenant projection (JSON text) as text: the member `value` of an object, else what stands there."""
    v = F.try_parse_json(raw)
    inner = F.try_variant_get(v, "$.value", "variant")
    shown = lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x))
    return F.when(v.isNotNull() & ~F.is_variant_null(v), F.when(inner.isNotNull(), shown(inner)).otherwise(shown(v)))


def acl_normalized(entries: Column, fold_case: bool = False) -> Column:
    """Sorted and distinct; null stays null, for it says something else than empty. Folding keeps the kind's capitals."""
    if fold_case:
        entries = F.transform(entries, lambda e: F.when(F.contains(e, F.lit(":")), F.concat(F.upper(F.substring_index(e, ":", 1)), F.lit(":"), F.lower(F.substring(e, F.instr(e, ":") + 1, F.length(e))))).otherwise(F.upper(e)))
    return F.array_sort(F.array_distinct(entries))


def acl_masked(entries: Column, key: bytes | None = None) -> Column:
    """PUBLIC stays; other entries keep their kind and 16 hex digits of a digest of the rest, keyed if there is a key. Sorted."""
    from driftaudit.functions.ids import hmac_sha256

    def mask(e: Column) -> Column:
        typed = F.contains(e, F.lit(":"))
        kind = F.when(typed, F.substring_index(e, ":", 1)).otherwise("PRINCIPAL")
        rest = F.when(typed, F.substring(e, F.instr(e, ":") + 1, F.length(e))).otherwise(e)
        digest = hmac_sha256(key, rest) if key else F.sha2(rest, 256)
        return F.when(e == "PUBLIC", e).otherwise(F.concat(kind, F.lit(":masked:"), F.substring(digest, 1, 16)))

    return F.array_sort(F.transform(entries, mask))
