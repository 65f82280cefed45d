"""What is derived from the project graph: velocity of developments and campuses, corroboration, evidence linked to opportunities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnworks.operators import relational as ops

# Windows, counts and the claim vocabulary.
PERMIT_EVENTS, CAMPUS_EVENTS = ("permit_applied", "permit_issued"), ("permit_applied", "permit_issued", "application_submitted")
WINDOW_DAYS, MIN_PERMITS, MIN_PROJECTS = 90, 5, 5
BLOCK_PREFIX = {"King": 6, "Lewis": 6, "Pierce": 6, "Thurston": 7}
OTHER_PREFIX = 6
RATIO = 1.25
CLAIMS = {
    "statusRaw": "stage", "title": "identity", "externalRef": "identity", "externalId": "identity", "parcelIds": "geography", "addressRaw": "geography", "geometry": "geography",
    "organizations": "organization_role", "valuationUsd": "value", "issueDate": "event_date", "applicationDate": "event_date",
}
CLAIM_ORDER = ("identity", "stage", "event_date", "geography", "organization_role", "value", "other")
CONFIDENCE = {"A": 0.95, "B": 0.75, "C": 0.5}
MOST_EVIDENCE = 50


def _at() -> Column:
    return F.coalesce(F.col("event_date").cast("timestamp"), F.col("observed_at").cast("timestamp"))


def _recent(events: DataFrame, kinds: Sequence[str], now: str, days: int) -> DataFrame:
    return events.filter(F.col("event").isin(*kinds)).withColumn("at", _at()).filter(F.col("at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAY"))


def cluster_velocity(projects: DataFrame, events: DataFrame, told: DataFrame, now: str, days: int = WINDOW_DAYS, least: int = MIN_PERMITS) -> DataFrame:
    """(development, anchor, record, permits, at) of the developments with `least` permit events in the last days, less those told before.

    projects(project, development, parent, first_seen), events(project, record, event, event_date, observed_at), told(anchor, record). The anchor is the least parent that a member has, else the oldest member; the
    record is the latest event's, so a development is told again only if something new came.
    """
    held = projects.filter("development is not null")
    anchors = held.groupBy("development").agg(F.coalesce(F.min("parent"), F.min_by("project", F.struct("first_seen", "project"))).alias("anchor"))
    permits = _recent(events, PERMIT_EVENTS, now, days).join(held.select("project", "development"), "project")
    found = permits.groupBy("development").agg(F.count("*").alias("permits"), F.max(F.struct("at", "record")).alias("last")).filter(F.col("permits") >= least)
    rows = found.join(anchors, "development").select("development", "anchor", F.col("last.record").alias("record"), "permits", F.col("last.at").alias("at"))
    return rows.join(told.select("anchor", "record").distinct(), ["anchor", "record"], "left_anti").select("development", "anchor", "record", "permits", "at")


def _block(prefixes: Mapping[str, int], otherwise: int) -> Column:
    plain = F.regexp_replace(F.get("parcels", F.lit(0)), "[^0-9A-Za-z]", "")
    length = F.coalesce(F.create_map(*(x for k, n in prefixes.items() for x in (F.lit(k), F.lit(n))))[F.col("county")], F.lit(otherwise))
    return F.when(F.length(plain) >= length, F.substr(plain, F.lit(1), length))


def campuses(projects: DataFrame, events: DataFrame, now: str, days: int = WINDOW_DAYS, least: int = MIN_PROJECTS, prefixes: Mapping[str, int] = BLOCK_PREFIX, otherwise: int = OTHER_PREFIX) -> DataFrame:
    """(county, block, projects, anchor, record, at): parcel blocks of a county on which `least` projects outside developments were active; a block is a prefix of the first parcel, its length by county."""
    held = projects.filter("development is null").withColumn("block", _block(prefixes, otherwise)).filter("block is not null and county is not null")
    active = _recent(events, CAMPUS_EVENTS, now, days).join(held.select("project", "county", "block", "first_seen"), "project")
    each = active.groupBy("county", "block", "project").agg(F.max(F.struct("at", "record")).alias("last"), F.min("first_seen").alias("first_seen"))
    found = each.groupBy("county", "block").agg(F.count("*").alias("projects"), F.min_by("project", F.struct("first_seen", "project")).alias("anchor"), F.max("last").alias("last")).filter(F.col("projects") >= least)
    return found.select("county", "block", "projects", "anchor", F.col("last.record").alias("record"), F.col("last.at").alias("at"))


def stamped(projects: DataFrame, events: DataFrame, now: str, **bounds) -> DataFrame:
    """projects with campus_block set anew: 'county:block' for the active members of a campus, null for all others."""
    found = campuses(projects, events, now, **bounds).select("county", "block")
    active = _recent(events, CAMPUS_EVENTS, now, bounds.get("days", WINDOW_DAYS)).select("project").distinct().withColumn("_active", F.lit(True))
    rows = projects.drop("campus_block").withColumn("block", _block(bounds.get("prefixes", BLOCK_PREFIX), bounds.get("otherwise", OTHER_PREFIX)))
    rows = rows.join(active, "project", "left").join(found.withColumn("_campus", F.lit(True)), ["county", "block"], "left")
    member = F.col("_campus") & F.col("_active") & F.col("development").isNull()
    return rows.withColumn("campus_block", F.when(member, F.concat("county", F.lit(":"), "block"))).drop("block", "_active", "_campus")


def corroboration(records: DataFrame, events: DataFrame, fields: Sequence[str], ratio: float = RATIO) -> DataFrame:
    """(project, source_count, stage_depth, contradictions) of the projects with a public active record.

    records(project, record, source, fields…) are those records, events(project, stage, confirmed). contradictions is a sorted array of struct(field, least, most, n_values): fields
    whose stated numbers differ by more than the ratio.
    """
    sources = records.groupBy("project").agg(F.count_distinct("source").alias("source_count"))
    depth = events.filter("confirmed and stage is not null").groupBy("project").agg(F.count_distinct("stage").alias("stage_depth"))
    numbers = records.select("project", *(F.col(f).cast("double").alias(f) for f in fields))
    apart = ops.contradictions(ops.unpivot_numbers(numbers, "project", fields), "project", ratio)
    listed = apart.groupBy("project").agg(F.sort_array(F.collect_list(F.struct("field", "least", "most", "n_values"))).alias("contradictions"))  # as many as fields
    rows = sources.join(depth, "project", "left").join(listed, "project", "left")
    none = F.array().cast("array<struct<field:string,least:double,most:double,n_values:bigint>>")
    return rows.select("project", "source_count", F.coalesce("stage_depth", F.lit(0)).alias("stage_depth"), F.coalesce("contradictions", none).alias("contradictions"))


def claim(fact_path: Column, grade: Column) -> Column:
    """struct(refused, claim, confirmed, confidence): what a fact path states, and how far its grade carries it; D and unknown grades are refused."""
    known = F.upper(F.trim(grade))
    refused = F.when(known == "D", "discovery_only_grade").when(~F.coalesce(known.isin(*CONFIDENCE), F.lit(False)), "unknown_grade")
    kind = F.coalesce(F.create_map(*(F.lit(x) for pair in CLAIMS.items() for x in pair))[F.trim(fact_path)], F.lit("other"))
    worth = F.create_map(*(F.lit(x) for pair in CONFIDENCE.items() for x in pair))[known]
    return F.struct(refused.alias("refused"), kind.alias("claim"), (known == "A").alias("confirmed"), worth.alias("confidence"))


def linked_evidence(opportunities: DataFrame, supporting: DataFrame, evidence: DataFrame, linked: DataFrame, most: int = MOST_EVIDENCE) -> tuple[DataFrame, DataFrame]:
    """(links to write, audit): opportunities(opportunity, project), supporting(project, record): active, evidence(evidence, record, fact_path, grade), linked(opportunity, evidence).

    An opportunity takes its best `most` items, by confidence, kind of claim and id, those linked before among them; the cap is the feature. The audit, (reason, n), accounts for each pair
    of an opportunity and an item: written, already_linked, capped_out or why it was refused.
    """
    items = evidence.withColumn("c", claim(F.col("fact_path"), F.col("grade"))).select("evidence", "record", "c.*")
    pairs = opportunities.select("opportunity", "project").join(supporting.select("project", "record").distinct(), "project").join(items, "record").drop("record", "project").distinct()
    fit = pairs.filter("refused is null")
    rank = F.array_position(F.array(*map(F.lit, CLAIM_ORDER)), F.col("claim"))
    order = Window.partitionBy("opportunity").orderBy(F.col("confidence").desc(), rank, "evidence")
    placed = fit.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place", "refused")
    kept = placed.join(linked.select("opportunity", "evidence", F.lit(True).alias("old")).distinct(), ["opportunity", "evidence"], "left")
    counts = pairs.groupBy(F.coalesce("refused", F.lit("fit")).alias("reason")).agg(F.count("*").alias("n"))
    within = kept.groupBy(F.when(F.col("old"), "already_linked").otherwise("written").alias("reason")).agg(F.count("*").alias("n"))
    over = counts.filter("reason = 'fit'").select(F.lit("capped_out").alias("reason"), "n").union(within.select(F.lit("capped_out"), -F.col("n"))).groupBy("reason").agg(F.sum("n").alias("n"))
    audit = counts.filter("reason <> 'fit'").union(within).union(over).filter("n > 0")
    return kept.filter("old is null").drop("old"), audit
