"""Routing of projects to accounts: features, three kinds of router, capacity, and runs that upsert scores and archive what no longer routes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnworks.functions import scalars
from cairnworks.operators import relational as ops

# Curves, bars and thresholds that scores depend on.
GLASS_TIMING = {"approved": 1, "construction_documents": 1, "permit_applied": 1, "permit_issued": 0.9, "construction": 0.7, "near_final": 0.6, "entitlement": 0.5, "preapplication": 0.3, "concept": 0.2, "bidding_confirmed": 1}
INTERIOR_TIMING = {
    "commercial": {"bidding_confirmed": 1, "permit_applied": 1, "construction_documents": 1, "approved": 1, "entitlement": 0.9, "preapplication": 0.7, "permit_issued": 0.2, "construction": 0.16, "near_final": 0.08, "complete": 0.05, "concept": 0.2},
    "residential": {"permit_issued": 0.55, "construction": 0.6, "bidding_confirmed": 1, "permit_applied": 1, "approved": 0.5, "construction_documents": 0.5, "near_final": 0.3, "entitlement": 0.4, "preapplication": 0.2, "concept": 0.2},
}
UNKNOWN_STAGE, OTHER_STAGE = 0.5, 0.1
RECENCY = ((60, 1), (180, 0.6)), 0.3
GLASS_RECENCY = ((180, 1), (365, 0.6)), 0.3
NO_CHANGE_KNOWN = 0.5
#: Weeks since the application was filed, and what a bid is still worth.
FRESHNESS = ((4, 1), (8, 0.9), (12, 0.75)), 0.55
LEGAL_NAME = r"(?i)\b(LLC|INC|CORP|COMPANY|LP|LLP|PLLC|LTD)\b"
BUILDER_ROLES, KNOWN_ROLES, CONTRACTOR_ROLES = ("applicant", "owner", "proponent", "primary_contractor"), ("applicant", "owner", "primary_contractor", "proponent", "lead_agency"), ("primary_contractor", "applicant", "owner")
GOOD_RATING, ENOUGH_REVIEWS, WARM_BONUS = 4.0, 5, 3
STICKY = ("dismissed", "promoted")
DEROUTED = "no_longer_routed"


@dataclass(frozen=True)
class Account:
    """An account's configuration. geography: worth of a county, used by the interior router; `far` is that of any other."""

    key: str
    router: str
    counties: tuple[str, ...]
    weights: Mapping[str, float]
    excluded: tuple[str, ...] = ()
    priority_min: float = 80
    digest_min: float = 65
    geography: Mapping[str, float] = field(default_factory=dict)
    far: float = 0.3
    trades: tuple[str, ...] = ()
    #: The county of a distant market, where small jobs count less and new houses do not.
    distant: str | None = None


def _table(values: Mapping[str, float], key: Column, otherwise: Column) -> Column:
    found = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))))[key] if values else F.lit(None).cast("double")
    return F.coalesce(found, otherwise)


def _steps(value: Column, steps, missing: float) -> Column:
    limits, rest = steps
    out = F.when(value.isNull(), float(missing))
    for most, worth in limits:
        out = out.when(value <= most, float(worth))
    return out.otherwise(float(rest))


def _timing(values: Mapping[str, float], stage: Column) -> Column:
    return _table(values, stage, F.when(stage == "unknown", UNKNOWN_STAGE).otherwise(OTHER_STAGE))


def _days(since: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(since.cast("timestamp"))) / 86_400_000_000


def load_features(projects: DataFrame, records: DataFrame, roles: DataFrame, evidence: DataFrame, events: DataFrame) -> DataFrame:
    """One row a project: projects(project, county, stage, cluster_size, has_velocity, campus_block, sources, stage_depth, contradiction) with what hangs on it.

    records(project, record, text, units, valuation, applied_at), roles(project, name, role, ref, verified, rating, reviews, trades), evidence(project, grade), events(project, at,
    material). Each is grouped by project before it is joined, so none multiplies another.
    """
    listed = F.sort_array(F.collect_list(F.struct("record", F.lower("text").alias("text"))))
    told = records.groupBy("project").agg(F.transform(listed, lambda r: r["text"]).alias("records"), F.max("units").alias("max_units"), F.max("valuation").alias("max_valuation"), F.max("applied_at").alias("applied_at"))
    people = roles.groupBy("project").agg(F.collect_set(F.struct("name", "role", "ref", "verified", "rating", "reviews", "trades")).alias("orgs"))
    proven = evidence.groupBy("project").agg(F.count_if(F.col("grade") == "A").alias("a_grade"))
    changed = events.filter("material").groupBy("project").agg(F.max("at").alias("last_change"))
    rows = projects
    for part in (told, people, proven, changed):
        rows = rows.join(part, "project", "left")
    return rows.withColumns({"text": F.array_join(F.coalesce("records", F.array().cast("array<string>")), " "), "a_grade": F.coalesce("a_grade", F.lit(0))})


def warm_accounts(roles: DataFrame, warm: DataFrame) -> DataFrame:
    """(project, warm): the accounts that know a firm of the project well, from roles(project, ref) and warm(account, ref)."""
    return roles.filter("ref is not null").select("project", "ref").distinct().join(warm, "ref").groupBy("project").agg(F.collect_set("account").alias("warm"))


def classified(features: DataFrame) -> DataFrame:
    """features with the struct `c` of what their texts and sizes say; a project without records is judged as one."""
    text, units = F.col("text"), F.coalesce("max_units", F.lit(0))
    flags = {name: scalars.scope(text, name) for name in scalars.SCOPES}
    multifamily = flags["multifamily"] | (units >= 3)
    cluster = (F.col("cluster_size") >= 3) | F.coalesce("has_velocity", F.lit(False))
    segments = F.when(F.size(F.coalesce("records", F.array().cast("array<string>"))) > 0, F.col("records")).otherwise(F.array(text))
    glazed = lambda s: scalars.scope(s, "glazing") & ~scalars.scope(s, "no_envelope") & (~scalars.scope(s, "demolition") | scalars.scope(s, "building"))
    made = {
        **flags, "multifamily": multifamily, "low_rise": multifamily & (F.col("max_units").isNull() | (units <= 30)), "units": F.greatest(units, F.coalesce(scalars.units_from_text(text), F.lit(0))),
        "interior": flags["interior"] | flags["specialist"], "subdivision": flags["subdivision"] | (F.col("cluster_size") >= 3), "cluster": cluster,
        "glazing_scope": F.exists(segments, glazed), "division_08": scalars.best_glazing_fit(segments, units),
    }
    return features.withColumn("c", F.struct(*(v.alias(k) for k, v in made.items())))


def _identified(roles: Sequence[str]) -> Column:
    """1 for an organisation in one of the roles that is bound to the registry or has a legal name, a half for any other, 0 for none."""
    hits = F.filter(F.coalesce("orgs", F.array().cast(ORGS)), lambda o: o["role"].isin(*roles))
    sure = F.exists(hits, lambda o: F.coalesce(o["verified"], F.lit(False)) | F.coalesce(o["name"].rlike(LEGAL_NAME), F.lit(False)))
    return F.when(F.size(hits) == 0, 0.0).when(sure, 1.0).otherwise(0.5)


ORGS = "array<struct<name:string,role:string,ref:string,verified:boolean,rating:double,reviews:int,trades:array<string>>>"


def _contractor(condition) -> Column:
    return F.exists(F.coalesce("orgs", F.array().cast(ORGS)), lambda o: o["role"].isin(*CONTRACTOR_ROLES) & F.coalesce(condition(o), F.lit(False)))


def _home(a: Account, now: Column):
    c = lambda n: F.col(f"c.{n}")
    fits = c("sfr") | c("subdivision") | c("cluster")
    size = F.col("cluster_size")
    signals = {
        "subdivision": c("subdivision"), "clustered_permits": c("cluster"), "low_rise_multifamily": c("low_rise"), "glass_keywords": c("glazing"),
        "late_stage": scalars.stage_order(F.col("stage")) >= scalars.STAGES.index("construction"),
    }
    parts = {
        "product_fit": F.least(F.lit(1.0), F.when(fits, 0.7).otherwise(0.4) + F.when(c("glazing"), 0.3).otherwise(0.0) + F.when(c("low_rise"), 0.1).otherwise(0.0)),
        "repeatable_units_or_builder_value": F.when((size >= 5) | (c("units") >= 10), 1.0).when((size >= 3) | (c("units") >= 4), 0.6).otherwise(0.2),
        "timing": _timing(GLASS_TIMING, F.col("stage")) * _steps(_days(F.col("last_change"), now), GLASS_RECENCY, NO_CHANGE_KNOWN), "territory": F.lit(1.0), "builder_developer_identified": _identified(BUILDER_ROLES),
    }
    return fits | c("low_rise"), F.when(c("low_rise") & ~fits, "joint_review").otherwise("residential_glass"), parts, signals


def _commercial(a: Account, now: Column):
    c = lambda n: F.col(f"c.{n}")
    value, campus = F.col("max_valuation"), F.coalesce(F.col("campus_block") != "", F.lit(False))
    scale = F.when((F.coalesce(value, F.lit(0)) >= 1_000_000) | (c("units") >= 20), 1.0).when((F.coalesce(value, F.lit(0)) >= 250_000) | (c("units") >= 5), 0.6).when(value.isNull(), 0.3).otherwise(0.15)
    signals = {"division_08_keywords": c("glazing_scope"), "public_work": c("public_work"), "multifamily": c("multifamily"), "active_campus": campus, "distant_county": F.col("county") == F.lit(a.distant)}
    parts = {
        "division_08_system_fit": c("division_08"), "scale_value": F.greatest(scale, F.when(campus, 0.6).otherwise(0.0)), "timing": _timing(GLASS_TIMING, F.col("stage")) * _steps(_days(F.col("last_change"), now), RECENCY, NO_CHANGE_KNOWN),
        "geography": F.lit(1.0), "gc_developer_architect_known": _identified(KNOWN_ROLES),
    }
    return c("commercial") | c("multifamily") | c("public_work") | c("glazing"), F.when(c("low_rise"), "joint_review").otherwise("division_08"), parts, signals


def _interior(a: Account, now: Column):
    c = lambda n: F.col(f"c.{n}")
    value, far_county = F.col("max_valuation"), F.coalesce(F.col("county") == F.lit(a.distant), F.lit(False))
    house = c("sfr") & ~c("demolition") & ~c("field_work") & ~c("entitlement_only") & ~far_county
    pipeline = house & (c("cluster") | c("subdivision"))
    too_large = (F.coalesce(value, F.lit(0)) > 2_000_000) & c("multifamily")
    commercial = ~c("sfr") & (c("commercial") | c("multifamily"))
    stage = F.col("stage")
    timing = F.when(commercial, _timing(INTERIOR_TIMING["commercial"], stage)).otherwise(_timing(INTERIOR_TIMING["residential"], stage))
    fresh = F.when(stage == "permit_applied", _steps(_days(F.col("applied_at"), now) / 7, FRESHNESS, 1)).otherwise(1.0)
    ti, inside = c("tenant_improvement"), c("interior")
    trade = F.when(c("other_trade"), 0.2).when(ti & inside, 1.0).when(ti | inside, 0.8).when(pipeline, 0.45).when(house, 0.7).when(c("commercial"), 0.6).otherwise(0.5)
    wanted = [t.lower() for t in a.trades]
    warm = F.coalesce(F.array_contains("warm", a.key), F.lit(False))
    late = commercial & (stage != "bidding_confirmed") & (scalars.stage_order(stage) >= scalars.STAGES.index("permit_issued"))
    signals = {
        "tenant_improvement": ti, "interior_keywords": inside, "new_home_construction": house, "production_builder_pipeline": pipeline, "active_campus": F.coalesce(F.col("campus_block") != "", F.lit(False)), "gc_relationship_radar": too_large,
        "verified_gc_on_project": _contractor(lambda o: o["verified"]), "specialist_assembly": c("specialist"), "restoration_scope": c("restoration"), "residential_remodel_scope": c("remodel"),
        "gc_quality": _contractor(lambda o: (o["rating"] >= GOOD_RATING) & (o["reviews"] >= ENOUGH_REVIEWS)), "trade_match": _contractor(lambda o: F.exists(o["trades"], lambda t: F.lower(t).isin(*wanted)) if wanted else F.lit(False)),
        "warm_gc_active": warm, "commercial_bid_window_likely_closed": late,
    }
    parts = {
        "trade_fit": trade, "package_size_fit": F.when(value.isNull(), 0.4).when(far_county & (value < 10_000), 0.3).when(value <= 2_000_000, 1.0).otherwise(0.3),
        "timing": timing * fresh * _steps(_days(F.col("last_change"), now), RECENCY, NO_CHANGE_KNOWN), "geography": _table(a.geography, F.col("county"), F.lit(a.far)), "gc_identified": _identified(CONTRACTOR_ROLES),
    }
    return ti | c("commercial") | c("multifamily") | inside | house, F.when(too_large | pipeline, "gc_relationship_radar").otherwise("interior_trades"), parts, signals


ROUTERS = {"home": _home, "commercial": _commercial, "interior": _interior}


def _tenths(value: Column) -> Column:
    return F.floor(value * 10 + 0.5) / 10


def band(score: Column, priority: Column, digest: Column) -> Column:
    return F.when(score >= priority, "priority_review").when(score >= digest, "weekly_digest").otherwise("archive")


def routed(features: DataFrame, accounts: Sequence[Account], now: str) -> DataFrame:
    """(project, account, route, score, state, signals, components, max_valuation, public_work): a row for each project and account whose router takes it.

    features as of load_features, with `warm` (or without: nobody is). Texts are judged once, whatever the number of accounts.
    """
    if "warm" not in features.columns:
        features = features.withColumn("warm", F.lit(None).cast("array<string>"))
    rows = classified(features)
    moment = F.lit(now).cast("timestamp")
    out = []
    for a in accounts:
        fits, route, parts, signals = ROUTERS[a.router](a, moment)
        parts = {**parts, "evidence_quality": F.when(F.col("a_grade") > 0, 1.0).otherwise(0.0)}
        score = _tenths(sum((parts[k] * float(w) for k, w in a.weights.items() if k in parts), F.lit(0.0)))
        if "warm_gc_active" in signals:
            score = F.when(signals["warm_gc_active"], F.least(F.lit(100.0), _tenths(score + WARM_BONUS))).otherwise(score)
        of_any = {"corroborated_multi_source": F.col("sources") >= 2, "lifecycle_progressing": F.col("stage_depth") >= 2, "fact_contradiction": F.col("contradiction")}
        told = F.array_compact(F.array(*(F.when(s, n) for n, s in {**signals, **of_any}.items())))
        here = F.col("county").isin(*a.counties) & ~F.col("county").isin(*a.excluded) if a.excluded else F.col("county").isin(*a.counties)
        components = F.create_map(*(x for k, v in parts.items() for x in (F.lit(k), v.cast("double"))))
        made = F.struct(F.lit(a.key).alias("account"), route.alias("route"), score.alias("score"), band(score, F.lit(a.priority_min), F.lit(a.digest_min)).alias("state"), told.alias("signals"), components.alias("components"))
        out.append(F.when(here & fits, made))
    each = rows.select("project", "max_valuation", F.col("c.public_work").alias("public_work"), F.explode(F.array_compact(F.array(*out))).alias("r"))
    return each.select("project", "r.*", "max_valuation", "public_work")


def with_capacity(routes: DataFrame, snapshots: DataFrame, accounts: Sequence[Account], now: str) -> DataFrame:
    """routes with base_score, capacity, and the score and state after the account's capacity at `now`.

    snapshots(account, effective_from, effective_to, minimum, maximum, accepts_public); of those in force the latest counts, an account without one keeps its scores.
    """
    spark = routes.sparkSession
    bars = spark.createDataFrame([(a.key, float(a.priority_min), float(a.digest_min)) for a in accounts], "account string, priority_min double, digest_min double").withColumn("now", F.lit(now).cast("timestamp"))
    held = ops.effective_at(bars, snapshots.withColumns({c: F.col(c).cast("timestamp") for c in ("effective_from", "effective_to")}), "account", "now", "effective_from", "effective_to")
    rows = routes.join(F.broadcast(held), "account")  # a row an account
    barred = F.coalesce(F.col("public_work") & ~F.col("accepts_public"), F.lit(False))
    fit = scalars.capacity_fit(F.col("max_valuation"), F.col("minimum"), F.col("maximum"), barred, F.col("effective_from").isNotNull())
    rows = rows.withColumns({"fit": fit, "base_score": F.col("score")}).withColumn("score", _tenths(F.col("base_score") * F.col("fit.factor")))
    rows = rows.withColumn("state", band(F.col("score"), F.col("priority_min"), F.col("digest_min")))
    return rows.select("project", "account", "route", "base_score", "score", "state", "signals", "components", F.col("fit.fit").alias("capacity"))


def score_run(old: DataFrame, routes: DataFrame, scored: DataFrame, accounts: Sequence[Account], version: str, now: str) -> DataFrame:
    """opportunities(account, project, score, version, route, state, first_qualified_at, deroute) after a run over the projects of scored(project).

    A routed pair takes its new score; dismissed and promoted stay so, and the first time it qualified is kept. A pair that is live, was scored again and
    no longer routes for an account with a router goes to the archive with a note; its last score stays.
    """
    first = F.when(F.col("state") != "archive", F.lit(now).cast("timestamp"))
    new = routes.select("account", "project", "score", F.lit(version).alias("version"), "route", "state", first.alias("first_qualified_at"), F.lit(None).cast("string").alias("deroute"))
    merged = ops.upsert(old, new, ["account", "project"], {"state": STICKY}, ["first_qualified_at"])
    pairs = routes.select("account", "project", F.lit(True).alias("_routed"))
    rows = merged.join(pairs, ["account", "project"], "left").join(scored.select("project", F.lit(True).alias("_scored")).distinct(), "project", "left")
    gone = F.col("_routed").isNull() & F.col("_scored").isNotNull() & F.col("account").isin(*(a.key for a in accounts)) & ~F.col("state").isin("archive", *STICKY)
    note = F.concat(F.lit(f"{DEROUTED}:"), F.col("state"))
    return rows.withColumns({"deroute": F.when(gone, note).otherwise(F.col("deroute")), "state": F.when(gone, "archive").otherwise(F.col("state"))}).select(*old.columns)


def current_scores(opportunities: DataFrame, version: str) -> DataFrame:
    """Opportunities that the current algorithm has scored; stale scores are withheld."""
    return opportunities.filter((F.col("version") == version) | F.startswith("version", F.lit(f"{version}+")))
