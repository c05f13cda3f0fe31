"""Entities against known accounts: cross-reference, suppression, sharing within a domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from enrichspark import constants as C
from enrichspark.functions.keys import canon_domain, non_blank, trim_all
from enrichspark.operators.ordered import SLICE_ROWS, numbered, spread_nulls


def by_domain(known: DataFrame) -> DataFrame:
    """One account per canonical domain; the smallest id wins."""
    account = F.struct("company_name", "status", "notes")
    return (
        known.where(F.col("domain_normalized").isNotNull())
        .groupBy(F.col("domain_normalized").alias("_domain"))
        .agg(F.min_by(account, "id").alias("_by_domain"))
    )


def by_name(known: DataFrame) -> DataFrame:
    account = F.struct("company_name", "status", "notes")
    return (
        known.where(F.col("company_name").isNotNull())
        .groupBy(F.lower("company_name").alias("_name"))
        .agg(F.min_by(account, "id").alias("_by_name"))
    )


def check_domains(domains: DataFrame, known: DataFrame, col: str = "domain", salt: str = "pos") -> DataFrame:
    """Status of every input domain, ``net-new`` where no account has it.

    Spark broadcasts the accounts while they are under its size limit and shuffles both sides
    beyond it; rows without a domain are spread so they do not share a task.
    """
    hit = F.col("_by_domain")
    return (
        domains.withColumn("_domain", spread_nulls(canon_domain(F.col(col)), salt))
        .join(by_domain(known), "_domain", "left")
        .select(
            *domains.columns,
            F.coalesce(hit["status"], F.lit(C.NET_NEW)).alias("status"),
            hit["company_name"].alias("company_name"),
            hit["notes"].alias("notes"),
        )
    )


def xref(entities: DataFrame, known: DataFrame, salt: str = "pos") -> DataFrame:
    """Internal status per entity: by canonical domain, else by name in any case."""
    domain = canon_domain(F.col("domain"))
    keyed = entities.withColumn("_domain", spread_nulls(domain, salt))
    first = keyed.join(by_domain(known), "_domain", "left")
    # A domain match settles the entity, so only the rest looks for a name.
    name = F.when(F.col("_by_domain").isNull(), non_blank(F.lower(trim_all(F.col("name")))))
    second = first.withColumn("_name", spread_nulls(name, salt)).join(by_name(known), "_name", "left")
    hit = F.coalesce("_by_domain", "_by_name")
    found = hit.isNotNull()
    ref = F.coalesce(non_blank(hit["company_name"]), domain, F.col("name"))
    note = F.coalesce(non_blank(hit["notes"]), F.lit(C.MATCH_NOTE))
    return second.select(
        *entities.columns,
        F.coalesce(non_blank(hit["status"]), F.lit(C.NET_NEW)).alias("internal_status"),
        F.when(found, ref).otherwise("").alias("internal_ref"),
        F.when(found, note).otherwise("").alias("internal_note"),
    )


def xref_without_table(entities: DataFrame) -> DataFrame:
    """What every entity gets where no account table exists."""
    return entities.select(
        "*",
        F.lit(C.NET_NEW).alias("internal_status"),
        F.lit("").alias("internal_ref"),
        F.lit(C.NO_TABLE_NOTE).alias("internal_note"),
    )


def attach_xref(rows: DataFrame, xrefs: DataFrame, key: str = "entity_name") -> DataFrame:
    """Copy an entity's cross-reference onto each of its findings; a finding stays one row even if
    the entity is listed twice."""
    cols = ["internal_status", "internal_ref", "internal_note"]
    one = xrefs.groupBy(key).agg(F.min(F.struct(*cols)).alias("_x"))
    return rows.join(one, key, "left").select(*rows.columns, *[F.col("_x")[c].alias(c) for c in cols])


def suppress(df: DataFrame, statuses: Sequence[str] = C.SUPPRESSED_STATUSES) -> DataFrame:
    return df.where(~F.col("internal_status").isin(*statuses))


def suppress_domains(
    entities: DataFrame,
    known: DataFrame,
    statuses: Sequence[str] = C.SUPPRESSED_STATUSES,
    salt: str = "pos",
) -> DataFrame:
    """Entities whose canonical domain is not in the suppression set."""
    barred = known.where(F.col("status").isin(*statuses)).select(F.col("domain_normalized").alias("_domain"))
    keyed = entities.withColumn("_domain", spread_nulls(canon_domain(F.col("domain")), salt))
    return keyed.join(barred, "_domain", "left_anti").select(*entities.columns)


# --- grouping and sharing -------------------------------------------------------


def raw_domain(col: str = "domain") -> Column:
    """The grouping key: stripped and lower-cased only, so ``www.`` makes another group."""
    return non_blank(F.lower(trim_all(F.col(col))))


def group_by_domain(entities: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Every entity with the key and size of its group.

    Entities without a domain are groups of their own, named by how many groups stood before
    them. That count is a running number over first positions, cut into slices of about
    ``slice_rows`` rows.
    Members stay rows: a group is never gathered into one value.
    """
    dom = raw_domain()
    named = (
        entities.where(dom.isNotNull())
        .groupBy(dom.alias("_dom"))
        .agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("group_size"))
    )
    alone = entities.where(dom.isNull()).select(
        F.lit(None).cast("string").alias("_dom"),
        F.col("pos").alias("_first"),
        F.lit(1).cast("long").alias("group_size"),
    )
    firsts = named.unionByName(alone)
    ranked = numbered(firsts, [], ["_first"], slice_rows, "_nth").select(
        F.coalesce("_dom", F.concat(F.lit("_nodomain_"), (F.col("_nth") - 1).cast("string"))).alias("group_key"),
        F.coalesce("_dom", F.concat(F.lit("\u0000"), F.col("_first").cast("string"))).alias("_join"),
        "group_size",
    )
    join = F.coalesce(dom, F.concat(F.lit("\u0000"), F.col("pos").cast("string")))
    return entities.withColumn("_join", join).join(ranked, "_join").drop("_join")


def domain_work(entities: DataFrame) -> DataFrame:
    """One row per canonical domain to resolve, carried by its first entity."""
    return (
        entities.withColumn("canon_domain", canon_domain(F.col("domain")))
        .where(F.col("canon_domain").isNotNull())
        .groupBy("canon_domain")
        .agg(F.min_by(F.struct("pos", "name"), "pos").alias("lead"), F.count(F.lit(1)).alias("entities"))
        .select("canon_domain", "lead.*", "entities")
    )


def share_by_domain(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Copy facts resolved once per domain to all entities of that domain."""
    keyed = entities.withColumn("canon_domain", canon_domain(F.col("domain")))
    return keyed.where(F.col("canon_domain").isNotNull()).join(facts, "canon_domain")
