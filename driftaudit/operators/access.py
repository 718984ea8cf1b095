"""Expected access and tenants: rules over paths, and the assertions made of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftaudit.functions.checks import acl_normalized, acl_problem
from driftaudit.functions.globs import first_match
from driftaudit.functions.ids import content_id, json_object, json_string, json_strings


@dataclass(frozen=True)
class Rules:
    """Values by uri: those of a table first (uri, value), which may be large, then the first pattern that matches."""

    exact: DataFrame | None = None
    patterns: list[tuple[str, object]] = field(default_factory=list)

    def apply(self, df: DataFrame, uri: str, name: str, literal) -> DataFrame:
        by_rule = first_match(F.col(uri), [(p, literal(v)) for p, v in self.patterns]) if self.patterns else F.lit(None)
        if self.exact is None:
            return df.withColumn(name, by_rule)
        direct = self.exact.select(F.col("uri").alias("rule_uri_"), F.col("value").alias("rule_value_")).dropDuplicates(["rule_uri_"])
        joined = df.join(direct, F.col(uri) == F.col("rule_uri_"), "left")
        return joined.withColumn(name, F.when(F.col("rule_uri_").isNotNull(), F.col("rule_value_")).otherwise(by_rule)).drop("rule_uri_", "rule_value_")


def expected_acl(df: DataFrame, uri: str, rules: Rules, name: str = "acl", fold_case: bool = False) -> DataFrame:
    """`df` with the entries that the source of each uri should be open to, sorted and distinct.

    Null where no rule speaks of the uri, which says something else than an empty list. An entry that is malformed or denies
    access fails the query, for a list that is only partly understood must not be compared.
    """
    found = rules.apply(df, uri, "entries_", lambda v: F.array(*map(F.lit, v)).cast("array<string>"))
    problem = acl_problem(F.col("entries_"))
    bad = F.raise_error(F.concat(F.lit("access entries "), problem, F.lit(": "), F.array_join("entries_", ", "))).cast("array<string>")
    return found.withColumn(name, F.when(problem.isNotNull(), bad).otherwise(acl_normalized(F.col("entries_"), fold_case))).drop("entries_")


def expected_tenant(df: DataFrame, uri: str, rules: Rules, name: str = "tenant") -> DataFrame:
    """`df` with struct<key, value> of the tenant of each uri, null where no rule speaks of it."""
    return rules.apply(df, uri, name, lambda v: F.struct(F.lit(v[0]).alias("key"), F.lit(v[1]).alias("value")))


def acl_hash(entries: Column) -> Column:
    return F.sha2(json_strings(entries), 256)


def acl_assertions(df: DataFrame, subject: str, acl: str) -> DataFrame:
    """(id, type, subject_ref, acl_hash, entries) of the rows that have a list, be it empty."""
    d = df.where(F.col(acl).isNotNull()).select(F.col(subject).alias("subject_ref"), acl_normalized(F.col(acl)).alias("entries"))
    d = d.withColumn("acl_hash", acl_hash(F.col("entries")))
    return d.select(content_id("acl", json_string(F.col("subject_ref")), json_string(F.col("acl_hash"))).alias("id"), F.lit("ACL").alias("type"), "subject_ref", "acl_hash", "entries")


def tenant_assertions(df: DataFrame, subject: str, tenant: str) -> DataFrame:
    """(id, type, subject_ref, tenant_hash, tenant_key, tenant_value) of the rows that have a tenant."""
    d = df.where(F.col(tenant).isNotNull()).select(F.col(subject).alias("subject_ref"), F.col(tenant)["key"].alias("tenant_key"), F.col(tenant)["value"].alias("tenant_value"))
    key, value = json_string(F.col("tenant_key")), json_string(F.col("tenant_value"))
    return d.select(content_id("tenant", json_string(F.col("subject_ref")), key, value).alias("id"), F.lit("TENANT").alias("type"), "subject_ref", F.sha2(json_object({"key": key, "value": value}), 256).alias("tenant_hash"), "tenant_key", "tenant_value")


def missing_tenants(df: DataFrame, uri: str, tenant: str) -> DataFrame:
    """(code, uri): the warnings of sources without a tenant where every source must have one."""
    return df.where(F.col(tenant).isNull()).select(F.lit("TENANT_REQUIRED_BUT_MISSING").alias("code"), F.col(uri).alias("uri"))
