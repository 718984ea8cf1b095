"""Personal data by fixed patterns and check digits: six recognizers of its own, further ones by configuration.

The built-in patterns run in the JVM: each match is set apart by a separator, the text is split at it, and running lengths
give positions. Patterns that a user brings may take for ever; they run in Python under a timer, and a recognizer that runs
out of time finds nothing in that text.
"""

from __future__ import annotations

import json
import re
import signal
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftaudit.functions import checks
from driftaudit.functions.canonical import canonical
from driftaudit.functions.ids import content_id, hkdf_sha256, hmac_sha256, json_string, let
from driftaudit.functions.text import starts

#: Entity type, recognizer, pattern, confidence by the pattern alone and with right check digits (None: no check).
BUILT_IN = [
    ("EMAIL_ADDRESS", "email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.85, None),
    ("PHONE_NUMBER", "phone", r"(?<!\d)(?:\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}(?!\d)", 0.5, None),
    ("CREDIT_CARD", "credit_card", r"(?<!\d)\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{1,7}(?!\d)", 0.3, 0.9),
    ("US_SSN", "us_ssn", r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)", 0.3, 0.75),
    ("TR_TCKN", "tr_tckn", r"(?<!\d)\d{11}(?!\d)", 0.1, 0.9),
    ("IBAN", "iban", r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}[ ]?[A-Z0-9]{1,4}\b", 0.3, 0.9),
]
_CHECKS = {"CREDIT_CARD": checks.luhn_ok, "US_SSN": checks.ssn_ok, "TR_TCKN": checks.tckn_ok, "IBAN": checks.iban_ok}
FINDING = "struct<start:int,end:int,entity_type:string,confidence:double,value:string,recognizer:string>"
SEP = "\ue000"


@dataclass(frozen=True)
class Custom:
    """A recognizer that a user brings."""

    entity_type: str
    pattern: str
    confidence: float = 0.5
    timeout: float = 0.5

    @classmethod
    def load(cls, config: str | dict) -> list[Custom]:
        """From a mapping, or its JSON or YAML: `recognizers`, a list of entity_type, pattern, confidence, timeout_seconds."""
        doc = _document(config) if isinstance(config, str) else config
        entries = (doc or {}).get("recognizers", []) if isinstance(doc or {}, dict) else None
        if not isinstance(entries, list):
            raise ValueError("a mapping with a list `recognizers` is needed")
        out = []
        for e in entries:
            if not isinstance(e, dict) or {"entity_type", "pattern"} - set(e):
                raise ValueError("a recognizer needs entity_type and pattern")
            try:
                re.compile(str(e["pattern"]))
            except re.error as x:
                raise ValueError(f"pattern of {e['entity_type']}: {x}") from x
            confidence = float(e.get("confidence", 0.5))
            if not 0 <= confidence <= 1:
                raise ValueError("a confidence is between 0 and 1")
            out.append(cls(str(e["entity_type"]), str(e["pattern"]), confidence, float(e.get("timeout_seconds", 0.5))))
        return out


def _document(text: str):
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as x:
            raise ValueError("no JSON, and there is no YAML reader") from x
        try:
            return yaml.safe_load(text)
        except yaml.YAMLError as x:
            raise ValueError(f"neither JSON nor YAML: {x}") from x


def _findings(text: Column, entity: str, recognizer: str, pattern: str, plain: float, checked: float | None) -> Column:
    """What one built-in recognizer finds. Texts without a match cost one search and nothing else."""
    wide = f"(?U){pattern}"

    def of(t: Column) -> Column:
        safe = F.replace(t, F.lit(SEP), F.lit("�"))
        pieces = F.split(F.regexp_replace(safe, F.lit(wide), F.lit(f"{SEP}$0{SEP}")), SEP)

        def rows(p: Column) -> Column:
            at = starts(F.transform(p, lambda x: F.length(x)))
            zipped = F.transform(p, lambda x, i: F.struct(x.alias("value"), i.alias("i")))
            return let(at, lambda a: F.transform(F.filter(zipped, lambda x: x["i"] % 2 == 1), lambda x: F.struct(
                F.get(a, x["i"]).cast("int").alias("start"), (F.get(a, x["i"]) + F.length(x["value"])).cast("int").alias("end"), F.lit(entity).alias("entity_type"),
                F.lit(plain if checked is None else checked).alias("confidence"), x["value"].alias("value"), F.lit(recognizer).alias("recognizer"),
            )))

        found = let(pieces, rows)
        return F.filter(found, lambda x: _CHECKS[entity](x["value"])) if checked is not None else found

    return F.when(F.rlike(text, F.lit(wide)), of(text)).otherwise(F.array().cast(f"array<{FINDING}>"))


def scan(df: DataFrame, text: str, name: str = "findings", custom: list[Custom] = ()) -> DataFrame:
    """`df` with `name`, an array of FINDING in order of start, end and entity type.

    Matches of one recognizer don't overlap; those of different ones may. What fails its check is none. Null and empty
    texts have no findings. Positions count code points.
    """
    t = F.col(text)
    parts = [_findings(t, *r) for r in BUILT_IN]
    out = df
    if custom:
        kept = [(c.entity_type, c.pattern, c.confidence, c.timeout) for c in custom]

        @F.pandas_udf(f"array<{FINDING}>")
        def found(texts: pd.Series) -> pd.Series:
            patterns = [(e, re.compile(p), c, s) for e, p, c, s in kept]
            return texts.map(lambda x: [f for r in patterns for f in _timed(x, *r)], na_action="ignore")

        out = out.withColumn("custom_", found(t))
        parts.append(F.coalesce("custom_", F.array().cast(f"array<{FINDING}>")))
    every = F.array_sort(F.concat(*parts))  # by the fields in their order: start, end, entity type
    out = out.withColumn(name, F.coalesce(F.when(t.isNotNull(), every), F.array().cast(f"array<{FINDING}>")))
    return out.drop("custom_")


def _timed(text: str, entity: str, pattern: re.Pattern, confidence: float, seconds: float) -> list[dict]:
    """The matches of a pattern, or none if it takes longer. Functions run on a worker's main thread, so an alarm can stop them."""

    def stop(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return [{"start": m.start(), "end": m.end(), "entity_type": entity, "confidence": confidence, "value": m[0], "recognizer": f"custom.{entity.lower()}"} for m in pattern.finditer(text)]
    except TimeoutError:
        return []
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def masked(entity_type: Column, value: Column) -> Column:
    return F.when(entity_type == "EMAIL_ADDRESS", checks.mask_email(value)).otherwise(checks.mask_generic(value))


@dataclass(frozen=True)
class ScanConfig:
    """What an assertion says about its scanner."""

    name: str = "driftaudit-patterns"
    version: str = "1"
    language: str = "und"
    custom: str | None = None
    secret: bytes | None = None

    def recognizers(self) -> list[Custom]:
        return Custom.load(self.custom) if self.custom else []

    def hash(self) -> str:
        import hashlib

        types = sorted({r[0] for r in BUILT_IN} | {c.entity_type for c in self.recognizers()})
        return hashlib.sha256(canonical({"entity_types": types, "custom_recognizers": self.custom or "", "language": self.language}).encode()).hexdigest()


def assertions(df: DataFrame, subject: str, text: str, config: ScanConfig = ScanConfig()) -> DataFrame:
    """(id, type, subject_ref, scanner_*, status, findings): one assertion per row, without any raw value.

    Findings have entity_type, confidence, start, end, a masked preview, a keyed digest of the value if there is a secret,
    and the recognizer. The id is made of the subject, the scanner and the places found.
    """
    key = hkdf_sha256(config.secret, b"driftaudit-value-digest-v1") if config.secret else None
    found = scan(df.select(F.col(subject).alias("subject_ref"), F.col(text).alias("text_")), "text_", "found_", config.recognizers())
    places = F.concat(F.lit("["), F.array_join(F.transform("found_", lambda f: F.concat(F.lit("["), json_string(f["entity_type"]), F.lit(","), f["start"], F.lit(","), f["end"], F.lit("]"))), ","), F.lit("]"))
    config_hash = config.hash()
    hidden = F.transform("found_", lambda f: F.struct(
        f["entity_type"].alias("entity_type"), f["confidence"].alias("confidence"), f["start"].alias("start"), f["end"].alias("end"), masked(f["entity_type"], f["value"]).alias("masked_preview"),
        (hmac_sha256(key, f["value"]) if key else F.lit(None).cast("string")).alias("value_hmac"), f["recognizer"].alias("recognizer_id"), F.lit("1").alias("recognizer_version"),
    ))
    parts = [json_string(F.col("subject_ref")), *(json_string(F.lit(x)) for x in (config.name, config.version, config_hash)), json_string(F.sha2(places, 256))]
    return found.select(
        content_id("pii", *parts).alias("id"), F.lit("PII_SCAN").alias("type"), "subject_ref", F.lit(config.name).alias("scanner_name"), F.lit(config.version).alias("scanner_version"), F.lit(config.language).alias("scanner_language"),
        F.lit(config_hash).alias("config_hash"), F.when(F.size("found_") > 0, "findings_detected").otherwise("no_findings_detected").alias("status"), hidden.alias("findings"),
    )


def blocked(findings: Column, entity_types: list[str], least: float = 0.0) -> Column:
    """Whether a finding is of a type that may not be embedded, with at least this confidence."""
    return F.exists(findings, lambda f: f["entity_type"].isin(*entity_types) & (f["confidence"] >= least)) if entity_types else F.lit(False)


def values(df: DataFrame, key: str, texts: list[str], custom: list[Custom] = ()) -> DataFrame:
    """(<key>, field_name, start, end, entity_type, confidence, value, recognizer): the findings of several fields as rows."""
    long = df.select(key, F.inline(F.array(*(F.struct(F.lit(t).alias("field_name"), F.col(t).alias("text_")) for t in texts))))
    return scan(long, "text_", "found_", custom).select(key, "field_name", F.inline("found_"))

