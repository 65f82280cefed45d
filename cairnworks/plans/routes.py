"""Routing, score runs, the publication gate and inclusion over the driver tables: customers stand for projects, orders for their records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.functions import scalars
from cairnworks.operators import gate, routing
from cairnworks.plans.registry import Tables, query

NOW = "2001-08-02 00:00:00"
TEXTS = (
    "New single family residence, 12-lot plat", "Tenant improvement: office drywall and paint", "Apartment building, 24 units, storefront glazing", "Demolition of a commercial warehouse",
    "Conditional use permit for a school district", "Interior remodel, level 5 skim coat", "Re-roof and water heater", "Synthetic turf athletic field",
)
STAGES = ("permit_applied", "permit_issued", "construction", "unknown", "entitlement", "complete")
ACCOUNTS = (
    routing.Account("glass-home", "home", ("AFRICA", "AMERICA"), {"product_fit": 30, "repeatable_units_or_builder_value": 20, "timing": 20, "territory": 10, "builder_developer_identified": 10, "evidence_quality": 10}, priority_min=75, digest_min=55),
    routing.Account("glass-commercial", "commercial", ("AFRICA", "AMERICA", "EUROPE", "ASIA"), {"division_08_system_fit": 35, "scale_value": 20, "timing": 20, "geography": 5, "gc_developer_architect_known": 10, "evidence_quality": 10}, excluded=("ASIA",), distant="EUROPE"),
    routing.Account("interiors", "interior", ("AFRICA", "AMERICA", "EUROPE", "ASIA", "MIDDLE EAST"), {"trade_fit": 35, "package_size_fit": 20, "timing": 25, "geography": 10, "evidence_quality": 10}, priority_min=70, digest_min=50, geography={"AFRICA": 1, "AMERICA": 0.9, "EUROPE": 0.6}, distant="EUROPE", trades=("drywall",)),
)


def _pick(options: tuple[str, ...], index):
    return F.element_at(F.array(*map(F.lit, options)), (index + 1).cast("int"))


def _features(t: Tables) -> DataFrame:
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    where = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    projects = where.select(
        c.alias("project"), F.col("r_name").alias("county"), _pick(STAGES, c % 6).alias("stage"), (c % 7).alias("cluster_size"), (c % 11 == 0).alias("has_velocity"), F.when(c % 13 == 0, "block").alias("campus_block"),
        (c % 3).alias("sources"), (c % 4).alias("stage_depth"), (c % 17 == 0).alias("contradiction"),
    )
    key = F.col("o_custkey").alias("project")
    records = t.orders.select(key, o.alias("record"), _pick(TEXTS, o % 8).alias("text"), F.when(o % 29 == 0, (o % 40).cast("int")).alias("units"), F.when(o % 5 > 0, F.col("o_totalprice") * 4).alias("valuation"), F.col("o_orderdate").alias("applied_at"))
    name, role = F.when(o % 3 == 0, "Acme LLC").otherwise("J Smith"), _pick(("applicant", "owner", "architect", "lead_agency", "primary_contractor"), o % 5)
    roles = t.orders.filter(o % 4 == 0).select(key, name.alias("name"), role.alias("role"), F.lit(None).cast("string").alias("ref"), (o % 9 == 0).alias("verified"), F.lit(4.5).alias("rating"), (o % 10).cast("int").alias("reviews"), F.array(F.lit("Drywall")).alias("trades"))
    evidence = t.orders.select(key, F.when(F.col("o_orderpriority") == "1-URGENT", "A").otherwise("B").alias("grade"))
    events = t.orders.select(key, F.col("o_orderdate").alias("at"), (F.col("o_orderstatus") == "F").alias("material"))
    return routing.load_features(projects, records, roles, evidence, events)


def _match(column: str, scope: str) -> str:
    return f"regexp_matches({column}, '{scalars.SCOPES[scope]}')"


def _curve(values, stage: str = "stage") -> str:
    return "CASE " + stage + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " WHEN 'unknown' THEN 0.5 ELSE 0.1 END::DOUBLE"


_TEXT = "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{x.lower()}'" for i, x in enumerate(TEXTS)) + " END"
_STAGE = "CASE c_custkey % 6 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(STAGES)) + " END"


def _known(roles: str) -> str:
    """The grouped form of how well somebody in the roles is identified."""
    return f"coalesce(max(CASE WHEN role IN ({roles}) THEN CASE WHEN sure THEN 1.0 ELSE 0.5 END END), 0)::DOUBLE"


ROUTED_SQL = f"""r AS (SELECT o_custkey AS project, o_orderkey AS record, {_TEXT} AS s, CASE WHEN o_orderkey % 29 = 0 THEN o_orderkey % 40 END AS units, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice * 4 END AS valuation, o_orderdate, o_orderstatus, o_orderpriority FROM orders),
p AS (SELECT project, string_agg(s, ' ' ORDER BY record) AS x, max(units) AS mu, max(valuation) AS v, max(o_orderdate) AS applied, max(o_orderdate) FILTER (o_orderstatus = 'F') AS changed, max((o_orderpriority = '1-URGENT')::INT) AS proven FROM r GROUP BY 1),
g AS (SELECT r.project, max(CASE WHEN {_match('s', 'demolition')} AND NOT {_match('s', 'building')} OR {_match('s', 'field_work')} AND NOT ({_match('s', 'glazing')} AND NOT {_match('s', 'no_envelope')}) THEN 0.2 WHEN {_match('s', 'entitlement_only')} AND NOT {_match('s', 'building')} THEN 0.4
WHEN {_match('s', 'glazing')} AND NOT {_match('s', 'no_envelope')} THEN 1 WHEN {_match('s', 'commercial')} THEN 0.7 WHEN {_match('s', 'multifamily')} OR coalesce(mu, 0) >= 3 THEN 0.4 ELSE 0.2 END)::DOUBLE AS fit08 FROM r JOIN p ON p.project = r.project GROUP BY 1),
ro AS (SELECT o_custkey AS project, CASE o_orderkey % 5 WHEN 0 THEN 'applicant' WHEN 1 THEN 'owner' WHEN 2 THEN 'architect' WHEN 3 THEN 'lead_agency' ELSE 'primary_contractor' END AS role, o_orderkey % 3 = 0 OR o_orderkey % 9 = 0 AS sure FROM orders WHERE o_orderkey % 4 = 0),
ri AS (SELECT project, {_known("'applicant', 'owner', 'proponent', 'primary_contractor'")} AS builder, {_known("'applicant', 'owner', 'primary_contractor', 'proponent', 'lead_agency'")} AS known FROM ro GROUP BY 1),
f AS (SELECT c_custkey AS project, r_name AS county, {_STAGE} AS stage, c_custkey % 7 AS size, c_custkey % 11 = 0 OR c_custkey % 7 >= 3 AS cluster, c_custkey % 13 = 0 AS campus, coalesce(x, '') AS x, mu, v, applied, date_diff('day', changed::DATE, DATE '2001-08-02') AS days,
coalesce(proven, 0)::DOUBLE AS proven, coalesce(fit08, CASE WHEN coalesce(mu, 0) >= 3 THEN 0.4 ELSE 0.2 END)::DOUBLE AS fit08, coalesce(builder, 0) AS builder, coalesce(known, 0) AS known,
greatest(coalesce(mu, 0), coalesce((SELECT max(u::INT) FROM (SELECT unnest(regexp_extract_all(x, '{scalars.UNITS}', 1)) AS u) WHERE u::INT BETWEEN 1 AND 5000), 0)) AS units
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN p ON p.project = c_custkey LEFT JOIN g ON g.project = c_custkey LEFT JOIN ri ON ri.project = c_custkey),
k AS (SELECT *, {_match('x', 'sfr')} AS sfr, {_match('x', 'multifamily')} OR coalesce(mu, 0) >= 3 AS multi, {_match('x', 'commercial')} AS com, {_match('x', 'public_work')} AS pub, {_match('x', 'glazing')} AS glaz, {_match('x', 'tenant_improvement')} AS ti,
{_match('x', 'interior')} OR {_match('x', 'specialist')} AS inside, {_match('x', 'other_trade')} AS other, {_match('x', 'subdivision')} OR size >= 3 AS subdiv, {_match('x', 'demolition')} OR {_match('x', 'field_work')} OR {_match('x', 'entitlement_only')} AS no_house,
CASE WHEN days IS NULL THEN 0.5 WHEN days <= 60 THEN 1 WHEN days <= 180 THEN 0.6 ELSE 0.3 END::DOUBLE AS rec, CASE WHEN days IS NULL THEN 0.5 WHEN days <= 180 THEN 1 WHEN days <= 365 THEN 0.6 ELSE 0.3 END::DOUBLE AS rec_glass,
CASE WHEN stage <> 'permit_applied' OR applied IS NULL THEN 1 WHEN date_diff('day', applied::DATE, DATE '2001-08-02') <= 28 THEN 1 WHEN date_diff('day', applied::DATE, DATE '2001-08-02') <= 56 THEN 0.9 WHEN date_diff('day', applied::DATE, DATE '2001-08-02') <= 84 THEN 0.75 ELSE 0.55 END::DOUBLE AS fresh FROM f),
m AS (SELECT *, multi AND (mu IS NULL OR mu <= 30) AS low, sfr AND NOT no_house AND county <> 'EUROPE' AS house FROM k),
s AS (SELECT project, 'glass-home' AS account, CASE WHEN low AND NOT (sfr OR subdiv OR cluster) THEN 'joint_review' ELSE 'residential_glass' END AS route, 30::DOUBLE * least(1, (CASE WHEN sfr OR subdiv OR cluster THEN 0.7 ELSE 0.4 END + CASE WHEN glaz THEN 0.3 ELSE 0 END + CASE WHEN low THEN 0.1 ELSE 0 END)::DOUBLE)
+ 20 * CASE WHEN size >= 5 OR units >= 10 THEN 1 WHEN size >= 3 OR units >= 4 THEN 0.6 ELSE 0.2 END::DOUBLE + 20 * {_curve(routing.GLASS_TIMING)} * rec_glass + 10 + 10 * builder + 10 * proven AS score, 75 AS pri, 55 AS dig, v, pub FROM m WHERE county IN ('AFRICA', 'AMERICA') AND (sfr OR subdiv OR cluster OR low)
UNION ALL SELECT project, 'glass-commercial', CASE WHEN low THEN 'joint_review' ELSE 'division_08' END, 35 * fit08 + 20 * greatest(CASE WHEN coalesce(v, 0) >= 1000000 OR units >= 20 THEN 1 WHEN coalesce(v, 0) >= 250000 OR units >= 5 THEN 0.6 WHEN v IS NULL THEN 0.3 ELSE 0.15 END, CASE WHEN campus THEN 0.6 ELSE 0 END)::DOUBLE
+ 20 * {_curve(routing.GLASS_TIMING)} * rec + 5 + 10 * known + 10 * proven, 80, 65, v, pub FROM m WHERE county IN ('AFRICA', 'AMERICA', 'EUROPE') AND (com OR multi OR pub OR glaz)
UNION ALL SELECT project, 'interiors', CASE WHEN coalesce(v, 0) > 2000000 AND multi OR house AND (cluster OR subdiv) THEN 'gc_relationship_radar' ELSE 'interior_trades' END,
35 * CASE WHEN other THEN 0.2 WHEN ti AND inside THEN 1 WHEN ti OR inside THEN 0.8 WHEN house AND (cluster OR subdiv) THEN 0.45 WHEN house THEN 0.7 WHEN com THEN 0.6 ELSE 0.5 END::DOUBLE
+ 20 * CASE WHEN v IS NULL THEN 0.4 WHEN county = 'EUROPE' AND v < 10000 THEN 0.3 WHEN v <= 2000000 THEN 1 ELSE 0.3 END::DOUBLE
+ 25 * CASE WHEN NOT sfr AND (com OR multi) THEN {_curve(routing.INTERIOR_TIMING['commercial'])} ELSE {_curve(routing.INTERIOR_TIMING['residential'])} END * fresh * rec + 10 * CASE county WHEN 'AFRICA' THEN 1 WHEN 'AMERICA' THEN 0.9 WHEN 'EUROPE' THEN 0.6 ELSE 0.3 END::DOUBLE + 10 * proven, 70, 50, v, pub
FROM m WHERE ti OR com OR multi OR inside OR house),
t AS (SELECT project, account, route, floor(score * 10 + 0.5 + 1e-9) / 10 AS score, pri, dig, v, pub FROM s)"""


@query(f"WITH {ROUTED_SQL} SELECT project, account, route, score, CASE WHEN score >= pri THEN 'priority_review' WHEN score >= dig THEN 'weekly_digest' ELSE 'archive' END AS state FROM t")
def routed_opportunities(t: Tables) -> DataFrame:
    return routing.routed(_features(t), ACCOUNTS, NOW).select("project", "account", "route", "score", "state")


_CAPPED = """, a AS (SELECT *, CASE WHEN account = 'glass-home' THEN 1.0 WHEN account = 'interiors' AND pub THEN 0 WHEN v IS NULL THEN 1 WHEN account = 'interiors' AND v > 1500000 THEN 0.4 WHEN account = 'glass-commercial' AND v < 100000 THEN 0.6 ELSE 1 END::DOUBLE AS factor FROM t),
b AS (SELECT account, project, route, floor(score * factor * 10 + 0.5 + 1e-9) / 10 AS score, pri, dig FROM a), n AS (SELECT account, project, route, score, CASE WHEN score >= pri THEN 'priority_review' WHEN score >= dig THEN 'weekly_digest' ELSE 'archive' END AS state FROM b)"""


def _snapshots(t: Tables) -> DataFrame:
    """Two versions of each account's capacity but the first one's, which has none in force."""
    rows = [("glass-home", "2000-01-01", "2001-01-01", 1.0, None, True), ("glass-commercial", "2000-01-01", None, 5e6, None, True), ("glass-commercial", "2001-02-01", None, 1e5, None, True), ("interiors", "2001-01-01", None, None, 1.5e6, False)]
    return t.spark.createDataFrame(rows, "account string, effective_from string, effective_to string, minimum double, maximum double, accepts_public boolean")


@query(f"""WITH {ROUTED_SQL}{_CAPPED}, o AS (SELECT c_custkey AS project, acc AS account, CASE c_custkey % 5 WHEN 0 THEN 'dismissed' WHEN 1 THEN 'promoted' WHEN 2 THEN 'archive' ELSE 'weekly_digest' END AS state FROM customer, (VALUES ('glass-home'), ('interiors'), ('retired')) x(acc) WHERE c_custkey % 2 = 0)
SELECT coalesce(o.account, n.account) AS account, coalesce(o.project, n.project) AS project, coalesce(n.score, CASE WHEN n.project IS NULL THEN 1.5 END) AS score, CASE WHEN o.state IN ('dismissed', 'promoted') THEN o.state WHEN n.state IS NOT NULL THEN n.state WHEN o.account <> 'retired' AND o.project % 3 < 2 AND o.state <> 'archive' THEN 'archive' ELSE o.state END AS state,
CASE WHEN n.project IS NULL AND o.account <> 'retired' AND o.project % 3 < 2 AND o.state NOT IN ('archive', 'dismissed', 'promoted') THEN 'no_longer_routed:' || o.state END AS deroute, CASE WHEN n.project IS NULL THEN 'v1' ELSE 'v2' END AS version,
CASE WHEN o.project IS NOT NULL AND o.project % 7 = 0 THEN '2000-01-01' WHEN n.state <> 'archive' THEN '2001-08-02' END AS first_qualified FROM o FULL JOIN (SELECT * FROM n WHERE project % 3 < 2) n ON o.account = n.account AND o.project = n.project""")
def score_run(t: Tables) -> DataFrame:
    """A run over two thirds of the projects on opportunities of an earlier one."""
    k = F.col("c_custkey")
    state = F.when(k % 5 == 0, "dismissed").when(k % 5 == 1, "promoted").when(k % 5 == 2, "archive").otherwise("weekly_digest")
    old = t.customer.filter(k % 2 == 0).select(
        F.explode(F.array(*map(F.lit, ("glass-home", "interiors", "retired")))).alias("account"), k.alias("project"), F.lit(1.5).alias("score"), F.lit("v1").alias("version"), F.lit("old").alias("route"), state.alias("state"),
        F.when(k % 7 == 0, F.lit("2000-01-01").cast("timestamp")).alias("first_qualified_at"), F.lit(None).cast("string").alias("deroute"),
    )
    features = _features(t).filter("project % 3 < 2")
    routes = routing.with_capacity(routing.routed(features, ACCOUNTS, NOW), _snapshots(t), ACCOUNTS, NOW)
    run = routing.score_run(old, routes, features, ACCOUNTS, "v2", NOW)
    return run.select("account", "project", "score", "state", "deroute", "version", F.date_format("first_qualified_at", "yyyy-MM-dd").alias("first_qualified"))


GATE_SQL = """o AS (SELECT c_custkey AS project, c_acctbal / 100 AS score FROM customer), sup AS (SELECT o_custkey AS project, o_orderkey AS record, o_orderpriority AS source FROM orders WHERE o_orderkey % 6 = 0),
ev AS (SELECT (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS evidence, l_orderkey AS record, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'C' ELSE CASE WHEN l_linenumber > 5 THEN 'D' ELSE 'B' END END AS grade, 'f' || l_linenumber % 3 AS fact_path FROM lineitem),
core AS (SELECT o_custkey AS project, arg_max(o_orderkey, (o_orderstatus = 'F')::INT::BIGINT * 100000000000000 + date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::BIGINT * 1000000000 + o_orderkey) AS core, max(o_orderdate) AS last_at FROM orders GROUP BY 1),
cited AS (SELECT DISTINCT project, evidence, grade, fact_path FROM sup JOIN ev USING (record)), fx AS (SELECT project, min(evidence) AS evidence, project % 19 > 0 AS confirmed FROM cited WHERE project % 3 > 0 GROUP BY 1),
weak AS (SELECT fx.project FROM fx JOIN cited c USING (project, evidence) WHERE c.grade = 'D' OR c.grade = 'C' AND NOT EXISTS (SELECT 1 FROM cited d WHERE d.project = fx.project AND d.fact_path = c.fact_path AND d.grade <> 'C')),
rv AS (SELECT o_orderkey AS record, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS candidate FROM orders WHERE o_orderkey % 26 = 0), dis AS (SELECT candidate AS project FROM rv WHERE candidate IS NOT NULL UNION SELECT project FROM rv JOIN sup USING (record)),
c AS (SELECT o.project, EXISTS (SELECT 1 FROM sup WHERE sup.project = o.project AND source <> '5-LOW') AS source_health, o.project % 23 > 0 AND core.project IS NOT NULL AS identity_complete, coalesce(EXISTS (SELECT 1 FROM ev WHERE ev.record = core.core AND grade = 'A'), false) AS a_grade_core_event,
NOT EXISTS (SELECT 1 FROM sup WHERE sup.project = o.project AND record NOT IN (SELECT record FROM ev)) AND o.project NOT IN (SELECT project FROM weak) AS facts_evidenced, NOT EXISTS (SELECT 1 FROM fx WHERE fx.project = o.project AND NOT confirmed) AS inferences_labeled,
o.project NOT IN (SELECT project FROM dis) AS no_identity_contradiction, coalesce(date_diff('day', last_at::DATE, DATE '2001-08-02') <= 180, false) AS timing_current, score >= 20 AS score_threshold,
CASE WHEN fx.project IS NULL OR o.project % 4 = 0 THEN NULL ELSE o.project % 5 > 0 END AS verifier FROM o LEFT JOIN core ON core.project = o.project LEFT JOIN fx ON fx.project = o.project),
gated AS (SELECT *, CASE WHEN NOT (source_health AND identity_complete AND a_grade_core_event AND facts_evidenced AND inferences_labeled AND no_identity_contradiction AND timing_current AND score_threshold) OR NOT coalesce(verifier, true) THEN 'fail' WHEN verifier IS NULL THEN 'blocked_on_verifier' ELSE 'pass' END AS status FROM c)"""


@query(f"WITH {GATE_SQL} SELECT * FROM gated")
def opportunity_gate(t: Tables) -> DataFrame:
    return _gated(t)[0].select("project", *gate.CHECKS, "status")


def _gated(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, o, li = F.col("c_custkey"), t.orders, t.lineitem
    opportunities = t.customer.select(c.alias("opportunity"), c.alias("project"), (F.col("c_acctbal") / 100).alias("score"), F.lit(20.0).alias("digest_min"))
    projects = t.customer.select(c.alias("project"), F.when(c % 23 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.lit("K").alias("county"), F.lit("J").alias("jurisdiction"), F.lit("construction").alias("stage"))
    supporting = o.filter("o_orderkey % 6 = 0").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("record"), F.col("o_orderpriority").alias("source"))
    coverage = t.spark.createDataFrame([(p, "red" if p == "5-LOW" else "green") for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")], "source string, freshness string")
    events = o.select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("record"), F.col("o_orderdate").alias("event_date"), F.col("o_orderdate").alias("observed_at"), (F.col("o_orderstatus") == "F").alias("material"))
    grade = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "R", "C").when(F.col("l_linenumber") > 5, "D").otherwise("B")
    evidence = li.select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")).alias("evidence"), F.col("l_orderkey").alias("record"), grade.alias("grade"), F.concat(F.lit("f"), F.col("l_linenumber") % 3).alias("fact_path"))
    reviews = o.filter("o_orderkey % 26 = 0").select(F.col("o_orderkey").alias("record"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("candidate"))
    first = supporting.join(evidence, "record").filter("project % 3 > 0").groupBy("project").agg(F.min("evidence").alias("e"))
    fact = F.struct(F.when(F.col("project") % 13 == 0, "bid_date").otherwise("f").alias("path"), F.col("e").alias("evidence"), (F.col("project") % 19 > 0).alias("confirmed"), F.lit(0.95).alias("confidence"))
    extractions = first.select("project", F.array(fact).alias("facts"), F.when(F.col("project") % 7 == 0, F.array(F.lit("units"))).alias("missing"))
    verifications = t.customer.select(c.alias("project"), F.when(c % 4 == 0, "blocked").otherwise("succeeded").alias("status"), F.array(c % 5 > 0).alias("verdicts"))
    return gate.gate(opportunities, projects, supporting, coverage, events, evidence, reviews, extractions, verifications, NOW), extractions, verifications


@query(f"""WITH {GATE_SQL}, i AS (SELECT g.project AS opportunity, g.status, CASE WHEN g.project % 10 = 0 THEN 'promoted' ELSE 'weekly_digest' END AS state, CASE WHEN fx.project IS NOT NULL AND fx.project % 13 = 0 OR g.project % 14 = 3 THEN 'deadline_or_actionable_claim' END AS a, CASE WHEN g.project % 15 = 4 THEN 'high_value_project' END AS b,
CASE WHEN g.project % 4 = 1 THEN 'ambiguous_routing' END AS c, CASE WHEN fx.project IS NULL THEN 'no_model_extraction' END AS d, CASE WHEN fx.project % 7 = 0 THEN 'missing_critical_facts' END AS e, CASE WHEN g.project % 4 = 0 OR g.project % 5 = 0 THEN 'not_independently_verified' END AS f, CASE WHEN g.project % 6 = 5 THEN 'fact_contradiction' END AS h
FROM gated g LEFT JOIN fx ON fx.project = g.project), l AS (SELECT opportunity, CASE WHEN status <> 'pass' THEN 'gate_' || status WHEN state = 'promoted' THEN '' ELSE concat_ws(',', a, b, c, d, e, f, h) END AS reasons FROM i)
SELECT opportunity, CASE WHEN reasons = '' THEN 'auto' ELSE 'review_required' END AS mode, reasons FROM l""")
def inclusion_policy(t: Tables) -> DataFrame:
    gated, extractions, verifications = _gated(t)
    k = F.col("project")
    rows = gated.select(
        "opportunity", "project", "status", F.when(k % 10 == 0, "promoted").otherwise("weekly_digest").alias("state"), F.when(k % 4 == 1, "joint_review").otherwise("division_08").alias("route"), F.when(k % 15 == 4, F.lit(6e6)).alias("max_valuation"),
        F.lit("construction").alias("stage"), F.when(k % 14 == 3, "Proposals due soon").alias("text"), (k % 6 == 5).alias("contradiction"),
    )
    return gate.inclusion(rows, extractions, verifications).withColumn("reasons", F.array_join("reasons", ","))
