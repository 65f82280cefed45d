"""Reviews as a log of decisions that is only added to: what stands, what was, and what a new look clears."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DECISIONS = ("merge", "reject")
#: Rules that a new look may clear a review by, without a person.
CLEARING = ("official_id", "explicit_reference")


def review_state(log: DataFrame) -> DataFrame:
    """(subject, state, since) of log(subject, at, action): where the fold of each subject's actions ends.

    A decision counts only on a pending subject, an undo makes it pending again; other actions say nothing. So what stands is the first decision after
    the last undo, and two grouped aggregates find it: however long a subject's log is, no task holds or sorts it. `at` is unique
    in a subject; state is pending, merged or rejected.
    """
    last = log.groupBy("subject").agg(F.max(F.when(F.col("action") == "undo", F.col("at"))).alias("undo"))
    rows = log.join(last, "subject")
    after = F.col("action").isin(*DECISIONS) & (F.col("undo").isNull() | (F.col("at") > F.col("undo")))
    found = rows.groupBy("subject").agg(F.min(F.when(after, F.struct("at", "action"))).alias("d"))
    state = F.when(F.col("d.action") == "merge", "merged").when(F.col("d.action") == "reject", "rejected").otherwise("pending")
    return found.select("subject", state.alias("state"), F.col("d.at").alias("since"))


def review_history(log: DataFrame) -> DataFrame:
    """The log's decisions and undos with `took_effect`: a decision if none stood, an undo if one did. A window that only looks back one row of a subject."""
    acts = log.filter(F.col("action").isin(*DECISIONS, "undo"))
    before = F.lag(F.col("action")).over(Window.partitionBy("subject").orderBy("at"))
    # After a decision one stands, taken by it or before it; after an undo, and at first, none.
    undo = F.col("action") == "undo"
    stood = F.coalesce(before != "undo", F.lit(False))
    return acts.withColumn("took_effect", undo == stood)


def overlaid(observations: DataFrame, log: DataFrame) -> DataFrame:
    """observations(subject, ...) with their standing state; one that nobody has acted on is pending."""
    state = review_state(log).select("subject", "state", "since")
    return observations.join(state, "subject", "left").withColumn("state", F.coalesce("state", F.lit("pending")))


def triage(reviews: DataFrame) -> DataFrame:
    """Clusters of pending reviews(review, rule, reasons, candidate, at) by rule, first reason and candidate: n, the oldest, the first three ids, and whether one can act on them.

    A review that only waits for its twin can't be decided itself.
    """
    reason = F.coalesce(F.get("reasons", F.lit(0)), F.lit(""))
    rows = reviews.withColumn("reason", reason)
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("rule", "reason", "candidate").orderBy("at", "review")))
    samples = ranked.filter("place <= 3").groupBy("rule", "reason", "candidate").agg(F.sort_array(F.collect_list(F.struct("place", "review"))).alias("s"))
    sizes = rows.groupBy("rule", "reason", "candidate").agg(F.count("*").alias("n"), F.min("at").alias("oldest"))
    same = F.col("a.rule").eqNullSafe(F.col("b.rule")) & (F.col("a.reason") == F.col("b.reason")) & F.col("a.candidate").eqNullSafe(F.col("b.candidate"))
    joined = sizes.alias("a").join(samples.alias("b"), same)
    state = F.when(F.col("a.reason") == "same_permit_pending_review", "awaiting").otherwise("actionable")
    return joined.select("a.rule", "a.reason", "a.candidate", "a.n", "a.oldest", F.transform("b.s", lambda s: s["review"]).alias("samples"), state.alias("state"))


def reevaluated(reviews: DataFrame, previews: DataFrame) -> DataFrame:
    """(review, verdict) of pending reviews(review, record, candidate) under previews(record, now, rule, project): clears if the record now merges by
    an id into the candidate (or had none), mismatch if by an id into another project, else stays."""
    joined = reviews.join(previews, "record", "left")
    by_id = (F.col("now") == "merged") & F.col("rule").isin(*CLEARING)
    fits = F.col("candidate").isNull() | (F.col("candidate") == F.col("project"))
    return joined.select("review", F.when(by_id & fits, "clears").when(by_id, "mismatch").otherwise("stays").alias("verdict"))
