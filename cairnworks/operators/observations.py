"""The queue of observations about registry links: which enter it, which decide themselves, and what a later pass may still change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the policy.
FLOOR, MIN_DECISIONS, MIN_RATE = 0.55, 10, 0.95
BINDING, NAME_RULES = "binding_name_match", ("binding_name_exact", "binding_name_phone")
DUPLICATES, EXPIRED, STALE_DAYS = 0.03, 0.02, 180


def strict_bind(rule: Column, via_alias: Column, name_component: Column, registry_key: Column, org_key: Column, locality: Column, org_trades: Column, registry_trades: Column) -> Column:
    """Whether a binding may be made without a person: the same name by a name rule and not by an alias, the same city, and a trade in common."""
    same = rule.isin(*NAME_RULES) & ~via_alias & (name_component == 1) & (registry_key.isNull() | (registry_key == org_key))
    return F.coalesce(same & (locality == 1) & F.arrays_overlap(org_trades, registry_trades), F.lit(False))


def queued(stored: DataFrame, found: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue, summary) after a pass: stored(key, kind, rule, trust, status, decided_by), found(key, kind, rule, trust, strict), history(rule, decisions, accepts).

    Found below FLOOR does not count. A strict binding is accepted, also where it waits; another kind of observation is if its rule's decisions were nearly
    all accepted; the rest waits. Rows that wait take the new rule and trust, decided ones keep all they had. summary: (outcome, n).
    """
    clear = found.filter(F.col("trust") >= FLOOR).join(history, "rule", "left")
    proven = (F.col("kind") != BINDING) & F.coalesce((F.col("decisions") >= MIN_DECISIONS) & (F.col("accepts") / F.col("decisions") >= MIN_RATE), F.lit(False))
    strict = (F.col("kind") == BINDING) & F.coalesce("strict", F.lit(False))
    new = clear.select("key", F.struct("kind", "rule", "trust").alias("n"), strict.alias("strict"), proven.alias("proven"))
    both = stored.select("key", F.struct("kind", "rule", "trust", "status", "decided_by").alias("o")).join(new, "key", "full")
    here, was, waits = F.col("n").isNotNull(), F.col("o").isNotNull(), F.coalesce(F.col("o.status") == "pending", F.lit(True))
    bound = here & F.coalesce("strict", F.lit(False)) & waits
    by_rule = here & ~was & F.coalesce("proven", F.lit(False))
    take = here & waits
    pick = lambda c: F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    outcome = F.when(bound, "bound").when(by_rule, "accepted").when(here & ~was, "queued").when(take, "rescored").when(here, "kept").otherwise("not_found")
    rows = both.select(
        "key", *map(pick, ("kind", "rule", "trust")), F.when(bound | by_rule, "accepted").when(was, F.col("o.status")).otherwise("pending").alias("status"),
        F.when(bound, "auto:strict-bind").when(by_rule, "auto:rule-history").otherwise(F.col("o.decided_by")).alias("decided_by"), outcome.alias("outcome"),
    )
    below = found.filter(~F.coalesce(F.col("trust") >= FLOOR, F.lit(False))).agg(F.lit("below_floor").alias("outcome"), F.count("*").alias("n"))
    return rows.drop("outcome"), rows.groupBy("outcome").agg(F.count("*").alias("n")).union(below.filter("n > 0"))


def delivery_quality(items: DataFrame, events: DataFrame) -> DataFrame:
    """(account, items, duplicate_new, expired, duplicate_rate, expired_rate, duplicate_pass, expired_pass) of delivered items(account, delivery, period_end, opportunity, project, is_new).

    Duplicate: called new again after an earlier delivery to the account. Expired: the project's last event, of events(project, at), lay more than STALE_DAYS before the period's end, or it has none.
    """
    news = items.filter("is_new").groupBy("account", "opportunity").agg((F.count("*") - 1).alias("again")).groupBy("account").agg(F.sum("again").alias("duplicate_new"))
    last = events.groupBy("project").agg(F.max("at").alias("last_at"))
    age = (F.unix_micros(F.col("period_end").cast("timestamp")) - F.unix_micros(F.col("last_at").cast("timestamp"))) / 86_400_000_000
    counted = items.join(last, "project", "left").groupBy("account").agg(F.count("*").alias("items"), F.count_if(F.coalesce(age > STALE_DAYS, F.lit(True))).alias("expired"))
    rows = counted.join(news, "account", "left").withColumn("duplicate_new", F.coalesce("duplicate_new", F.lit(0)))
    rates = rows.withColumns({"duplicate_rate": F.col("duplicate_new") / F.col("items"), "expired_rate": F.col("expired") / F.col("items")})
    return rates.withColumns({"duplicate_pass": F.col("duplicate_rate") < DUPLICATES, "expired_pass": F.col("expired_rate") < EXPIRED})
