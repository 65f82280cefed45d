"""The publication gate: nine checks of an opportunity, each true, false or not known yet, and what may go out without a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECKS = ("source_health", "identity_complete", "a_grade_core_event", "facts_evidenced", "inferences_labeled", "no_identity_contradiction", "timing_current", "score_threshold", "verifier")
# Limits and patterns of the policy.
TIMING_DAYS = 180
LEAST_CONFIDENCE, HIGH_VALUE = 0.9, 5_000_000
CONTACT_FACT = r"(?i)contact|phone|email|estimator"
DEADLINE_FACT = r"(?i)bid_date|deadline|due_date|proposal"
ACTIONABLE_TEXT = r"(?i)\b(bids? due|proposals? due|invitation to bid|request for (proposals?|qualifications?)|pre-?bid)\b"
FACT = "struct<path:string,evidence:long,confirmed:boolean,confidence:double>"


def _flag(rows: DataFrame, name: str) -> DataFrame:
    """(project, name = true) for the distinct projects of rows."""
    return rows.select("project").distinct().withColumn(name, F.lit(True))


def gate(opportunities: DataFrame, projects: DataFrame, supporting: DataFrame, coverage: DataFrame, events: DataFrame, evidence: DataFrame, reviews: DataFrame, extractions: DataFrame, verifications: DataFrame, now: str) -> DataFrame:
    """opportunities with a nullable boolean column for each of CHECKS, and `status`: fail if any check is false, else blocked if any is null, else pass.

    opportunities(opportunity, project, score, digest_min), projects(project, name, county, jurisdiction, stage), supporting(project, record, source): the active records, coverage(source,
    freshness), events(project, record, event_date, observed_at, material), evidence(evidence, record, grade, fact_path), reviews(record, candidate): those that wait, extractions(project,
    facts array of FACT): the latest that succeeded, verifications(project, status, verdicts array of boolean): the latest. Every check is a grouped table of its own, one row a project.
    """
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    healthy = _flag(supporting.join(coverage, "source").filter("freshness <> 'red'"), "healthy")
    at = F.coalesce(F.col("event_date").cast("timestamp"), F.col("observed_at").cast("timestamp"))
    dated = events.withColumn("at", at)
    core = dated.groupBy("project").agg(F.max_by("record", F.struct(F.coalesce("material", F.lit(False)), "at", "record")).alias("core"), F.max("at").alias("last_at"))
    proven = core.join(evidence.filter("grade = 'A'").select(F.col("record").alias("core")).distinct().withColumn("a_grade", F.lit(True)), "core", "left").select("project", "last_at", "a_grade")
    bare = _flag(supporting.join(evidence.select("record").distinct(), "record", "left_anti"), "bare")
    cited = supporting.select("project", "record").distinct().join(evidence, "record").select("project", "evidence", "grade", "fact_path")
    facts = extractions.select("project", F.explode("facts").alias("f")).select("project", "f.*")
    backed = cited.filter("grade <> 'C'").select("project", "fact_path").distinct().withColumn("backed", F.lit(True))
    one = cited.groupBy("project", "evidence").agg(F.min(F.struct("grade", "fact_path")).alias("e")).select("project", "evidence", "e.*")
    judged = facts.join(one, ["project", "evidence"], "left").join(backed, ["project", "fact_path"], "left")
    weak = _flag(judged.filter(F.col("grade").isNull() | (F.col("grade") == "D") | ((F.col("grade") == "C") & F.col("backed").isNull())), "weak")
    unlabelled = _flag(facts.filter(~F.coalesce("confirmed", F.lit(False))), "unlabelled")
    touched = reviews.filter("candidate is not null").select(F.col("candidate").alias("project")).union(reviews.join(supporting, "record").select("project"))
    disputed = _flag(touched, "disputed")
    seen = extractions.select("project", F.lit(True).alias("extracted")).distinct()
    verified = verifications.select("project", F.col("status").alias("v_status"), F.exists(F.coalesce("verdicts", F.array().cast("array<boolean>")), lambda v: ~v).alias("unsupported"), F.col("verdicts").isNull().alias("no_result"))

    rows = opportunities.join(projects.withColumn("known", F.lit(True)), "project", "left")
    for part in (healthy, proven, bare, weak, unlabelled, disputed, seen, verified):
        rows = rows.join(part, "project", "left")
    told = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("last_at")) / 86_400_000_000
    blocked = F.col("extracted").isNull() | F.col("v_status").isNull() | (F.col("v_status") == "blocked")
    checks = {
        "source_health": true("healthy"), "identity_complete": true("known") & told("name") & told("county") & told("jurisdiction") & told("stage") & (F.col("stage") != "unknown") & F.col("last_at").isNotNull(),
        "a_grade_core_event": true("a_grade"), "facts_evidenced": ~true("bare") & ~true("weak"), "inferences_labeled": ~true("unlabelled"), "no_identity_contradiction": ~true("disputed"),
        "timing_current": F.coalesce(age <= TIMING_DAYS, F.lit(False)), "score_threshold": F.coalesce(F.col("score") >= F.col("digest_min"), F.lit(False)),
        "verifier": F.when(~blocked, (F.col("v_status") == "succeeded") & ~F.col("no_result") & ~F.col("unsupported")),
    }
    judged = rows.select(*(opportunities[c] for c in opportunities.columns), *(F.coalesce(v, F.lit(False)).alias(k) if k != "verifier" else v.alias(k) for k, v in checks.items()))
    every = F.array(*CHECKS)
    return judged.withColumn("status", F.when(F.exists(every, lambda x: ~x), "fail").when(F.exists(every, lambda x: x.isNull()), "blocked_on_verifier").otherwise("pass"))


def inclusion(gated: DataFrame, extractions: DataFrame, verifications: DataFrame) -> DataFrame:
    """(opportunity, mode, reasons): auto, or review_required with why.

    gated(opportunity, project, status, state, route, max_valuation, stage, text, contradiction), extractions(project, facts, missing array of string), verifications as in gate(). A promoted
    opportunity carries a person's decision, which stands for all reasons but the gate's.
    """
    facts = F.coalesce("facts", F.array().cast(f"array<{FACT}>"))
    some = lambda pattern: F.exists(facts, lambda f: F.coalesce(f["path"].rlike(pattern), F.lit(False)))
    rows = gated.join(extractions.select("project", "facts", "missing", F.lit(True).alias("extracted")), "project", "left").join(verifications.select("project", F.col("status").alias("v_status"), "verdicts"), "project", "left")
    unverified = ~F.coalesce((F.col("v_status") == "succeeded") & F.col("verdicts").isNotNull() & ~F.exists("verdicts", lambda v: ~v), F.lit(False))
    reasons: dict[str, Column] = {
        "deadline_or_actionable_claim": some(DEADLINE_FACT) | F.coalesce(F.col("text").rlike(ACTIONABLE_TEXT), F.lit(False)), "high_value_project": F.coalesce(F.col("max_valuation"), F.lit(0)) >= HIGH_VALUE,
        "ambiguous_routing": F.col("route").isin("joint_review", "gc_relationship_radar"), "contact_data": some(CONTACT_FACT), "externally_actionable_bid_state": F.col("stage") == "bidding_confirmed",
        "no_model_extraction": F.col("extracted").isNull(), "low_confidence_fact": F.exists(facts, lambda f: f["confidence"] < LEAST_CONFIDENCE), "missing_critical_facts": F.size(F.coalesce("missing", F.array().cast("array<string>"))) > 0,
        "not_independently_verified": unverified, "fact_contradiction": F.coalesce(F.col("contradiction"), F.lit(False)),
    }
    listed = F.array_compact(F.array(*(F.when(v, k) for k, v in reasons.items())))
    listed = F.when(F.col("status") != "pass", F.array(F.concat(F.lit("gate_"), "status"))).when(F.col("state") == "promoted", F.array().cast("array<string>")).otherwise(listed)
    return rows.select("opportunity", listed.alias("reasons")).select("opportunity", F.when(F.size("reasons") == 0, "auto").otherwise("review_required").alias("mode"), "reasons")
