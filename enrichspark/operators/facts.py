"""Facts and where they come from: verification, status, sources, output rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from enrichspark.functions.keys import bind, canon_domain, trim_all, url_host, with_url_key
from enrichspark.functions.text import squeeze
from enrichspark.operators.ordered import top_one



def verify_claims(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """Check each claim against the stored raw page it cites.

    Holds only if the quoted text occurs in the page. Claims meet pages on the page key, so the
    containment test is one per claim; a claim on an unknown page fails.
    """
    # White space is collapsed after the join: squeezing twice the text beats shuffling it twice.
    stored = pages.select("url_key", F.col("content").alias("_page"))
    supported = F.contains(squeeze(F.col("_page")), squeeze(F.col("quote")))
    verified = F.coalesce(supported & (F.col("quote") != ""), F.lit(False))
    keyed = with_url_key(claims, "source_url")
    return keyed.join(stored, "url_key", "left").withColumn("verified", verified).drop("_page")


def blank_unverified(claims: DataFrame) -> DataFrame:
    """A failed claim loses its value and says where was looked."""
    note = F.concat(F.lit("NOT FOUND — searched "), F.col("source_url"))
    return claims.withColumn("value", F.when(F.col("verified"), F.col("value")).otherwise("")).withColumn(
        "note", F.when(F.col("verified"), F.lit("")).otherwise(note)
    )


def fact_status() -> Column:
    """verified, not_found or unverified; anything else is a violation."""
    value = F.coalesce("value", F.lit(""))
    note = F.coalesce("note", F.lit(""))
    sourced = F.coalesce("source_url", F.lit("")) != ""
    verified = F.coalesce("verified", F.lit(False))
    return (
        F.when(verified & (value != "") & sourced, "verified")
        .when(~verified & (value == "") & note.startswith("NOT FOUND"), "not_found")
        .when(~verified & (value != "") & F.contains(note, F.lit("UNVERIFIED")), "unverified")
        .otherwise("violation")
    )


def classify_facts(facts: DataFrame) -> DataFrame:
    return facts.withColumn("fact_status", fact_status())


def violations(facts: DataFrame) -> DataFrame:
    return classify_facts(facts).where(F.col("fact_status") == "violation")


def trusted(df: DataFrame) -> DataFrame:
    return df.where("verified")


def two_sources(facts: DataFrame, least: int = 2) -> DataFrame:
    """Values that at least ``least`` different hosts support."""
    return (
        trusted(facts)
        .groupBy("entity_name", "field", "value")
        .agg(F.countDistinct(url_host(F.col("source_url"))).alias("sources"))
        .where(F.col("sources") >= least)
    )


def source_sketches(facts: DataFrame, by: Sequence[str] = ("day",), precision: int = 12) -> DataFrame:
    """Per value, and per day or whatever ``by`` names, a sketch of the hosts that support it.

    Sketches merge, so a day is folded once and any span of days is counted from its few rows. With 12 bits of precision
    the standard error of a large count is 1.6 %, a sketch takes 4 KB at most, and counts of a few hosts are exact.
    """
    host = url_host(F.col("source_url"))
    return trusted(facts).where(host.isNotNull()).groupBy(*by, "entity_name", "field", "value").agg(
        F.hll_sketch_agg(host, F.lit(precision)).alias("hosts")
    )


def two_sources_of_sketches(sketches: DataFrame, least: int = 2) -> DataFrame:
    """``two_sources`` over sketches; ``sources`` is an estimate, exact for a few hosts."""
    merged = sketches.groupBy("entity_name", "field", "value").agg(F.hll_union_agg("hosts").alias("hosts"))
    return merged.select("entity_name", "field", "value", F.hll_sketch_estimate("hosts").alias("sources")).where(
        F.col("sources") >= least
    )


def rank_sources(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Best source per (entity, field): the entity's own site first, then by address."""
    own = entities.select("entity_name", canon_domain(F.col("domain")).alias("_own"))
    primary = F.coalesce(canon_domain(url_host(F.col("source_url"))) == F.col("_own"), F.lit(False))
    scored = facts.join(own, "entity_name", "left").withColumn("primary_source", primary)
    best = top_one(
        scored,
        ["entity_name", "field"],
        [F.desc("primary_source"), F.asc("source_url"), F.asc("value")],
    )
    return best.drop("_own")


def _chosen(facts: DataFrame, fields: Sequence[str], key: str) -> DataFrame:
    """One row per entity with a whole finding, as a struct, for each field.

    A trusted finding with a value and a source goes ahead of the others, then by source and value.
    """
    text, source = F.coalesce("value", F.lit("")), F.coalesce("source_url", F.lit(""))
    doubtful = ~(F.coalesce("verified", F.lit(False)) & (text != "") & (source != ""))
    finding = F.struct(doubtful.alias("doubtful"), "source_url", "value", "verified", "note")
    # A condition per field, not a pivot over fields: entities without any of them keep their row.
    return facts.groupBy(key).agg(*[F.min(F.when(F.col("field") == f, finding)).alias(f"_{f}") for f in fields])


def pivot_facts(facts: DataFrame, fields: Sequence[str], key: str = "entity_name") -> DataFrame:
    """One row per entity with each requested field and the source of its value: both of one finding."""
    named = [(F.col(f"_{f}.value").alias(f), F.col(f"_{f}.source_url").alias(f"{f}_source")) for f in fields]
    return _chosen(facts, fields, key).select(key, *[c for pair in named for c in pair])


def output_rows(facts: DataFrame, xrefs: DataFrame, fields: Sequence[str], key: str = "entity_name") -> DataFrame:
    """The rows a job hands out: entity, fields, source, verdict, note and internal status.

    A field shows its value only if that is verified. The source is that of the first field that has
    one; the row is verified if every finding shown is; notes are joined in the order of fields.
    ``xrefs`` may hold an entity more than once; its smallest values count.
    """
    internal = ["internal_status", "internal_ref", "internal_note"]
    known = xrefs.groupBy(key).agg(*[F.min(c).alias(c) for c in internal])
    got = [F.col(f"_{f}") for f in fields]
    sure = [F.coalesce(g["verified"], F.lit(False)) for g in got]
    values = [F.when(s, g["value"]).otherwise("").alias(f) for f, g, s in zip(fields, got, sure, strict=True)]
    source = F.coalesce(*[F.nullif(g["source_url"], F.lit("")) for g in got], F.lit(""))
    whole = F.lit(True)
    for g, s in zip(got, sure, strict=True):
        whole = whole & (g.isNull() | s)
    notes = F.concat_ws("; ", *[F.nullif(g["note"], F.lit("")) for g in got])
    rows = _chosen(facts, fields, key).select(
        key, *values, source.alias("source_url"), whole.alias("verified"), notes.alias("note")
    )
    return rows.join(known, key, "left").withColumnRenamed(key, "entity")


def to_canonical(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Downstream company rows: name, domain, trusted fields as a map, all their sources as a list.

    The map has one finding per requested field, the first by source and value; the list has the
    source of every trusted finding. Findings are folded per (entity, field, source) first, so an
    entity with many is not gathered row by row.
    """
    named = ["entity_name", "field", "source_url"]
    folded = trusted(rows).where(F.col("field").isin(*fields)).groupBy(*named).agg(
        F.min("value").alias("value"), F.min("domain").alias("domain"), F.min("internal_status").alias("internal_status")
    )
    by_field = folded.groupBy("entity_name", "field").agg(
        F.min(F.struct("source_url", "value"))["value"].alias("value"),
        F.collect_set("source_url").alias("urls"),
        F.min("domain").alias("domain"),
        F.min("internal_status").alias("internal_status"),
    )
    entry = F.struct(F.col("field").alias("key"), F.col("value").alias("value"))
    return by_field.groupBy("entity_name").agg(
        F.min("domain").alias("company_domain"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("intel"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("urls")))).alias("sources"),
        F.min("internal_status").alias("db_status"),
    ).withColumnRenamed("entity_name", "company_name")


def extract_quotes(pages: DataFrame, wants: DataFrame) -> DataFrame:
    """Sentences of a page, word for word, that support a wanted field.

    ``wants(url_key, field, terms)`` names the texts to look for per page and field. A field
    without a sentence comes back once as ``ABSENT``.
    """
    ended = F.regexp_replace("content", r"([.!?])\s+", "$1\n")
    sentences = F.filter(F.transform(F.split(ended, "\n"), trim_all), lambda s: s != "")

    def matching(s: Column) -> Column:
        return bind(F.lower(s), lambda low: F.exists("terms", lambda t: F.contains(low, F.lower(t))))

    def or_absent(found: Column) -> Column:
        return F.struct(
            (F.size(found) > 0).alias("found"),
            F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("ABSENT"))).alias("quotes"),
        )

    joined = wants.join(pages.select("url_key", "content"), "url_key")
    rows = joined.select("url_key", "field", bind(F.filter(sentences, matching), or_absent).alias("_q"))
    return rows.select("url_key", "field", F.col("_q.found").alias("found"), F.posexplode("_q.quotes")).select(
        "url_key", "field", (F.col("pos") + 1).cast("long").alias("nth"), F.col("col").alias("quote"), "found"
    )


def quotes_as_digest(quotes: DataFrame) -> DataFrame:
    """Digest text per page from its quotes: a page's own sentences, so never longer than the
    page times the wanted fields."""
    line = F.concat_ws(": ", "field", "quote")
    ordered = F.array_sort(F.collect_list(F.struct("field", "nth", line.alias("line"))))
    return quotes.groupBy("url_key").agg(
        F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("digest"),
        F.bool_or("found").alias("any_found"),
    )
