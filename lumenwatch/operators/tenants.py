"""Tenants that never meet: keys of a tenant's rows made its own, and back.

Joins, windows and groups take tenant as one more key where their operator names one (`by`). Operators over
graphs and entities compare keys alone: for them each key carries its tenant between two marks, so that equal ids
of two tenants are two nodes, two entities and two incidents. Keys may not hold the mark; a null tenant is a tenant of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .incidents import UNKNOWN

#: Sorts before all printable characters, so that a tenant's keys keep their order.
MARK = "\x1f"


def mark(tenant: str) -> Column:
    """What follows a tenant's keys, between two marks; in hexadecimal digits, which no word test on keys can find."""
    return F.concat(F.lit(MARK), F.coalesce(F.hex(F.col(tenant).cast("string")), F.lit("-")), F.lit(MARK))


def scoped(rows: DataFrame, *keys: str, tenant: str = "tenant", entities: str | None = "entities") -> DataFrame:
    """rows with keys of their tenant's own; rows without an entity get the tenant's own unknown one."""
    own = {k: F.concat(F.col(k).cast("string"), mark(tenant)) for k in keys}
    if entities:
        some = F.when(F.size(entities) > 0, F.col(entities)).otherwise(F.array(F.lit(UNKNOWN)))
        own[entities] = F.transform(some, lambda e: F.concat(e, mark(tenant)))
    return rows.withColumns(own)


def unscoped(rows: DataFrame, key: str, tenant: str = "tenant") -> DataFrame:
    """rows with tenant, read from a key, and all texts and lists of texts as before scoped()."""
    code = F.substring_index(F.substring_index(F.col(key), MARK, -2), MARK, 1)
    bare = lambda c: F.regexp_replace(c, f"{MARK}[0-9A-F-]*{MARK}", "")
    plain = {tenant: F.when(code != "-", F.decode(F.unhex(code), "UTF-8"))}
    for field in rows.schema.fields:
        kind = field.dataType.simpleString()
        if field.name != tenant and kind in ("string", "array<string>"):
            plain[field.name] = bare(F.col(field.name)) if kind == "string" else F.transform(field.name, bare)
    return rows.select(*[plain[c].alias(c) if c in plain else F.col(c) for c in rows.columns if c != tenant], plain[tenant].alias(tenant))


def switched(findings: DataFrame, changes: DataFrame, tenant: str = "tenant") -> DataFrame:
    """findings but for those whose rule the tenant's latest change (rule_id, enabled, updated_at, seq) switches off."""
    latest = changes.groupBy(tenant, "rule_id").agg(F.max_by("enabled", F.struct("updated_at", "seq")).alias("on"))
    off = latest.where("NOT on").select(F.col(tenant).alias("_tenant"), F.col("rule_id").alias("_rule"))
    return findings.join(off, F.col(tenant).eqNullSafe(F.col("_tenant")) & (F.col("rule_id") == F.col("_rule")), "left_anti")


def counts(tenant: str = "tenant", **tables: DataFrame) -> DataFrame:
    """Rows of each named table by tenant: name, tenant, n."""
    out = None
    for name, rows in tables.items():
        n = rows.groupBy(tenant).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.col(tenant).alias("tenant"), "n")
        out = n if out is None else out.unionByName(n)
    return out
