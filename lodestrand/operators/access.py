"""Access rules, filters and trust tiers as column expressions, pushed below every ranking."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trust tiers from most to least trusted; a tier's rank is its place.
TRUST_TIERS = ["trusted_internal", "verified_partner", "user_provided", "generated_or_derived", "external_untrusted", "unknown"]


@dataclass(frozen=True)
class Principal:
    user_id: str
    tenant: str
    namespaces: tuple[str, ...] = ()
    teams: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()


@dataclass(frozen=True)
class Filter:
    """An index filter. Empty lists do not restrict; None of the lists may be asked for by a principal without the tenant."""

    tenant: str
    namespace: str
    principal: Principal | None
    document_ids: tuple = ()
    source_ids: tuple[str, ...] = ()
    trust_tiers: tuple[str, ...] = ()
    include_flags: tuple[str, ...] = ()
    exclude_flags: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    limit: int | None = field(default=None)

    def problems(self) -> list[str]:
        found = []
        if not self.tenant:
            found.append("missing_tenant")
        if not self.namespace:
            found.append("missing_namespace")
        if self.principal is None:
            found.append("missing_principal")
        elif self.principal.tenant != self.tenant:
            found.append("tenant_mismatch")
        elif self.namespace and self.namespace not in self.principal.namespaces:
            found.append("namespace_not_granted")
        if self.limit is not None and self.limit < 0:
            found.append("invalid_limit")
        return found


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def denial(p: Principal) -> Column:
    """Why a row (tenant, namespace, users, teams, roles, tags) is closed to p; null where it is open. The first reason counts."""
    restricted = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0
    return (
        F.when(F.lit(not p.user_id or not p.tenant), "invalid_principal")
        .when(F.col("tenant").isNull() | F.col("namespace").isNull(), "missing_resource_scope")
        .when(F.col("tenant") != p.tenant, "tenant_mismatch")
        .when(~F.col("namespace").isin(*p.namespaces), "namespace_not_granted")
        .when(restricted("users") & ~F.array_contains("users", p.user_id), "user_not_granted")
        .when(restricted("teams") & ~F.arrays_overlap("teams", _strings(p.teams)), "team_not_granted")
        .when(restricted("roles") & ~F.arrays_overlap("roles", _strings(p.roles)), "role_not_granted")
        .when(restricted("tags") & (F.size(F.array_except("tags", _strings(p.tags))) > 0), "tag_not_granted")
    )


def visible(rows: DataFrame, f: Filter) -> DataFrame:
    """Rows that f lets through; an invalid filter lets none."""
    if f.problems():
        return rows.where(F.lit(False))
    out = rows.where(denial(f.principal).isNull() & (F.col("namespace") == f.namespace))
    for column, wanted in (("doc_id", f.document_ids), ("source_id", f.source_ids), ("trust_tier", f.trust_tiers)):
        if wanted:
            out = out.where(F.col(column).isin(*wanted))
    if f.include_flags:
        out = out.where(F.arrays_overlap("safety_flags", _strings(f.include_flags)))
    if f.exclude_flags:
        out = out.where(~F.arrays_overlap("safety_flags", _strings(f.exclude_flags)))
    if f.tags:
        out = out.where(F.size(F.array_except(_strings(f.tags), F.col("tags"))) == 0)
    return out.limit(f.limit) if f.limit is not None else out


def granted_by_table(rows: DataFrame, needs: DataFrame, principal_tags: DataFrame, key: str = "doc_id") -> DataFrame:
    """The relational form: rows of which no needed tag is missing from the principal's."""
    unmet = needs.join(principal_tags, "tag", "left_anti").select(key).distinct()
    return rows.join(unmet, key, "left_anti")


def branch_filter(base: Column, branch: Column) -> Column:
    """A branch's list within its base: an empty side leaves the other as it is; a disjoint pair gives an empty list."""
    return F.when(F.size(branch) == 0, base).when(F.size(base) == 0, branch).otherwise(F.array_intersect(base, branch))


def trust_rank(tier: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(_strings(TRUST_TIERS), F.coalesce(tier, F.lit("unknown"))), F.lit(0)), F.lit(len(TRUST_TIERS))).cast("int") - 1


def tier_of(rank: Column) -> Column:
    return F.element_at(_strings(TRUST_TIERS), rank + 1)


def resolved_trust(source: Column, record: Column, override: Column) -> tuple[Column, Column]:
    """(tier, unsafe_upgrade): the less trusted of source and record; an override may lower it further, never raise it."""
    floor = F.greatest(trust_rank(source), trust_rank(record))
    upgrade = override.isNotNull() & (trust_rank(override) < floor)
    return tier_of(F.when(override.isNotNull() & ~upgrade, trust_rank(override)).otherwise(floor)), upgrade
