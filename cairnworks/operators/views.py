"""Read views of accounts: counts, the opportunity list with what explains each row, digests, leagues of firms, source health, replays."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnworks.functions import names
from cairnworks.operators import relational as ops

STATES = ("priority_review", "promoted", "new", "dismissed")
#: Roles of whom one would call about a project, best first.
CALL_ROLES = ("primary_contractor", "applicant", "owner")
# Fixed values of the health rules.
RUNS, FLOOR, BASELINE, DROP, VOLUME = 5, 0.5, 0.5, 0.8, 0.5
PLACEHOLDER = r"(?i)^(NO |NOT |N/A|NA$|UNKNOWN|NONE|OWNER$|SAME AS|TBD|SEE |APPLICANT$|PER PLANS)"


def account_counts(accounts: DataFrame, opportunities: DataFrame) -> DataFrame:
    """A row for each active account(account, name, active) with counts of its opportunities(account, state, changed_at) by state."""
    counts = opportunities.groupBy("account").agg(F.count_if(F.col("state") != "archive").alias("live"), *(F.count_if(F.col("state") == s).alias(s) for s in STATES), F.max("changed_at").alias("last_change"))
    rows = accounts.filter("active").join(counts, "account", "left")
    return rows.select("account", "name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("live", *STATES)), "last_change")


def opportunity_view(opportunities: DataFrame, accounts: DataFrame, projects: DataFrame, records: DataFrame, sources: DataFrame, roles: DataFrame, phones: DataFrame, digests: DataFrame) -> DataFrame:
    """Live opportunities of active accounts that stand on a public record, with the greatest stated value, whom to call, and whether the latest digest calls it easy.

    records(project, record, source, valuation, active), sources(source, account), roles(project, org, org_name, role, verified, quality, source), phones(org, phone, account, kind), digests(account, period_end, sent_at,
    easy_wins array). Records and roles of private sources and phones that are private do not count; a firm must bear an entity's name, and quality, where it is set, decides what is junk.
    """
    public = sources.filter(F.col("account").isNull()).select("source")
    open_ = records.filter("active").join(public, "source", "left_semi").groupBy("project").agg(F.max("valuation").alias("max_valuation"))
    listed = phones.filter(F.col("account").isNull() & (F.col("kind") == "public_business") & F.col("phone").isNotNull()).groupBy("org").agg(F.min("phone").alias("gc_phone"))
    name = F.col("org_name")
    clean = F.when(F.col("quality").isNull(), ~name.rlike(PLACEHOLDER) & ~name.rlike("[0-9]{3,}")).otherwise(F.col("quality") != "junk")
    called = roles.join(public, "source", "left_semi").filter(F.col("role").isin(*CALL_ROLES) & name.rlike(names.ENTITY_WORD) & clean)
    rank = F.array_position(F.array(*map(F.lit, CALL_ROLES)), F.col("role"))
    best = ops.pick(called, ["project"], F.struct(rank, "org_name", "org"), ["org", "org_name", "verified"], latest=False).join(listed, "org", "left")
    best = best.select("project", F.col("org_name").alias("gc_name"), F.col("verified").alias("gc_verified"), "gc_phone")
    latest = ops.pick(digests, ["account"], F.struct("period_end", "sent_at"), ["easy_wins"])
    live = opportunities.filter("state <> 'archive'").join(accounts.filter("active").select("account"), "account", "left_semi")
    rows = live.join(projects, "project").join(open_, "project").join(best, "project", "left").join(latest, "account", "left")
    easy = F.coalesce(F.array_contains("easy_wins", F.col("opportunity").cast("string")), F.lit(False))
    return rows.withColumn("is_easy_win", easy).drop("easy_wins")


def digest_status(digests: DataFrame) -> DataFrame:
    """The latest digest of each account with counts from its JSON `metadata`: items, reviews, what was held back, candidates."""
    latest = ops.pick(digests, ["account"], F.struct("period_end", "sent_at", "digest"), ["digest", "status", "period_end", "sent_at", "metadata"])
    number = lambda path: F.get_json_object("metadata", path).cast("int")
    size = lambda path: F.coalesce(F.json_array_length(F.get_json_object("metadata", path)), F.lit(0))
    return latest.select(
        "account", "digest", "status", "period_end", "sent_at", size("$.items").alias("items"), size("$.reviewQueue").alias("reviews"), F.coalesce(number("$.suppressed.gateFailed"), F.lit(0)).alias("gate_failed"),
        F.coalesce(number("$.suppressed.blockedOnVerifier"), F.lit(0)).alias("blocked"), number("$.candidateCount").alias("candidates"),
    )


def band_summary(opportunities: DataFrame) -> DataFrame:
    """(state, n, unscored): rows without a score are counted as such, not as zero."""
    return opportunities.groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.col("score").isNull()).alias("unscored"))


def league(activity: DataFrame) -> DataFrame:
    """Firms by name key: activity(org, org_name, projects, recent, relevant, value_total, value_max, latest, counties, ref, verified, phone, relationship), a row a firm as stored.

    Spellings of one name are summed; the primary one is that of most projects (then least name), and gives the name and, if it has one, the relationship; verified and phone count from any.
    Flags: placeholder, likely_individual if no spelling bears an entity's name, address_in_name. A value that no spelling states stays null.
    """
    split = names.split_name_address(F.col("org_name"))
    rows = activity.withColumns({"key": names.org_name_key(F.col("org_name")), "short": split["name"], "tail": split["address_tail"].isNotNull()})
    rows = rows.withColumns({"entity": F.col("short").rlike(names.ENTITY_WORD), "place": F.struct((-F.col("projects")).alias("p"), "org_name", "org")})
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c)
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    grouped = rows.groupBy("key").agg(
        F.min_by("org", "place").alias("org"), F.min_by("short", "place").alias("name"), F.count("*").alias("spellings"), *map(total, ("projects", "recent", "relevant")), F.sum("value_total").alias("value_total"), F.max("value_max").alias("value_max"),
        F.max("latest").alias("latest"), first("ref"), F.bool_or(F.coalesce("verified", F.lit(False))).alias("verified"), first("phone"), first("relationship"), F.bool_or("entity").alias("entity"), F.bool_or("tail").alias("tail"),
    )
    areas = rows.select("key", F.explode("counties").alias("c")).distinct().groupBy("key").agg(F.sort_array(F.collect_set("c")).alias("counties"))
    flags = F.array_compact(F.array(F.when(F.col("name").rlike(PLACEHOLDER), "placeholder"), F.when(~F.col("entity"), "likely_individual"), F.when(F.col("tail"), "address_in_name")))
    return grouped.join(areas, "key", "left").withColumns({"flags": flags, "counties": F.coalesce("counties", F.array().cast("array<string>"))}).drop("entity", "tail")


def warm_network(league_: DataFrame, counties: Sequence[str]) -> DataFrame:
    """(ref): firms of the league that are bound to the registry, have a relevant project, and work in the territory."""
    return league_.filter(F.col("ref").isNotNull() & (F.col("relevant") > 0) & F.arrays_overlap("counties", F.array(*map(F.lit, counties)))).select("ref").distinct()


def source_health(runs: DataFrame, now: str, cadence_hours: Column, required: Mapping[str, Sequence[str]] | Sequence[str] = ()) -> DataFrame:
    """(source, state, reasons, last_success) from the last RUNS runs of each source.

    runs(source, run, started_at, completed_at, status, orphaned, discovered, parsed, unchanged, duplicates, violations, fill map of string to double, schema_print); cadence_hours is an expression over `source`, null for none.
    Red outranks amber; a run that a process left unfinished is no success and its counters say nothing. Fields of `required` must not be nearly empty, and any
    field that was reliably filled must not lose a fifth against the run before.
    """
    order = Window.partitionBy("source").orderBy(F.col("started_at").desc(), F.col("run").desc())
    last = runs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= RUNS)
    kept = F.struct("place", "status", "completed_at", F.coalesce("orphaned", F.lit(False)).alias("orphaned"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("discovered", "parsed", "unchanged", "duplicates", "violations")), "fill", "schema_print")
    held = last.groupBy("source").agg(F.array_sort(F.collect_list(kept), lambda x, y: x["place"] - y["place"]).alias("all"))
    rows = held.select("source", F.filter("all", lambda r: r["status"] != "running").alias("done"))
    ok = F.filter("done", lambda r: r["status"].isin("succeeded", "completed_with_errors") & ~r["orphaned"])
    rows = rows.withColumns({"a": F.get("done", F.lit(0)), "b": F.get("done", F.lit(1)), "last_success": F.get(ok, F.lit(0))["completed_at"]})
    fills = F.filter(F.transform("done", lambda r: r["fill"]), lambda f: F.coalesce(F.size(F.map_keys(f)) > 0, F.lit(False)))
    prints = F.filter(F.transform("done", lambda r: r["schema_print"]), lambda p: F.coalesce(p != "", F.lit(False)))
    rows = rows.withColumns({"f1": F.get(fills, F.lit(0)), "f2": F.get(fills, F.lit(1)), "prints": prints})
    a, b = F.col("a"), F.col("b")
    both = a["orphaned"] & F.coalesce(b["orphaned"], F.lit(False))
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_success").cast("timestamp"))) / 3_600_000_000
    quiet = (a["unchanged"] == 0) & (a["duplicates"] == 0) & ~a["orphaned"]
    monitored = list(required)
    near_empty = [F.when(F.col("f1")[f] < FLOOR, F.concat(F.lit(f"required field nearly empty: {f}"))) for f in monitored]
    fields = F.array(*map(F.lit, monitored)) if monitored else F.map_keys("f1")
    fell = F.filter(F.array_sort(fields), lambda k: F.coalesce((F.col("f2")[k] >= BASELINE) & (F.col("f1")[k] < F.col("f2")[k] * DROP), F.lit(False)))
    red = F.array_compact(F.array(
        F.when((a["status"] == "failed") & (b["status"] == "failed"), "two consecutive failed runs"), F.when(both, "two consecutive orphaned runs"), F.when(age > 2 * cadence_hours, "stale"),
        F.when((a["status"] != "failed") & quiet & (a["discovered"] > 0) & (a["parsed"] == 0), "zero usable records"), F.when(a["violations"] > 0, "parser invariant violation"), *near_empty,
    ))
    red = F.concat(red, F.transform(F.coalesce(fell, F.array().cast("array<string>")), lambda k: F.concat(F.lit("field fill dropped: "), k)))
    amber = F.array_compact(F.array(
        F.when((a["status"] == "failed") & ~F.coalesce(b["status"] == "failed", F.lit(False)), "latest run failed"), F.when(a["orphaned"] & ~both, "latest run orphaned"),
        F.when((F.size("prints") >= 2) & ~F.array_contains(F.slice("prints", 2, RUNS), F.get("prints", F.lit(0))), "schema changed"),
    ))
    usable = b["parsed"] + b["duplicates"]
    dropped = (F.size(red) == 0) & (F.size(amber) == 0) & quiet & (b["parsed"] > 0) & (a["parsed"] < usable * VOLUME)
    amber = F.concat(amber, F.when(F.coalesce(dropped, F.lit(False)), F.array(F.lit("volume dropped"))).otherwise(F.array().cast("array<string>")))
    none = F.size("done") == 0
    judged = rows.select("source", "last_success", none.alias("none"), red.alias("red"), amber.alias("amber"))
    state = F.when(F.col("none"), "amber").when(F.size("red") > 0, "red").when(F.size("amber") > 0, "amber").otherwise("green")
    reasons = F.when(F.col("none"), F.array(F.lit("no completed runs yet"))).otherwise(F.concat("red", "amber"))
    return judged.select("source", state.alias("state"), F.array_sort(F.when(F.size(reasons) == 0, F.array(F.lit("healthy"))).otherwise(reasons)).alias("reasons"), "last_success")


def reaped(runs: DataFrame, now: str, minutes: int = 60) -> DataFrame:
    """runs(…, status, started_at, orphaned) with those that have been running for longer than so many minutes closed as orphans; again, nothing changes."""
    dead = (F.col("status") == "running") & (F.unix_micros(F.col("started_at").cast("timestamp")) < F.unix_micros(F.lit(now).cast("timestamp")) - minutes * 60_000_000)
    return runs.withColumns({"orphaned": F.coalesce("orphaned", F.lit(False)) | F.coalesce(dead, F.lit(False)), "status": F.when(dead, "completed_with_errors").otherwise(F.col("status"))})


def replay(artifacts: DataFrame, parse: Callable[[DataFrame], DataFrame], stored: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, evidence to add) after stored artifacts(artifact, retrieved_at, body) have gone through a parser again.

    parse gives (artifact, source, external_id, fingerprint, content, evidence array of string); stored(source, external_id, fingerprint, content). Of a record's artifacts the last one read counts. records are those
    of `stored` and new ones, with outcome kept, rewritten (another fingerprint), inserted or absent (no artifact tells of it; left as it is). Evidence is added only for a record that has none in evidence(source, external_id).
    """
    keys = ["source", "external_id"]
    parsed = parse(artifacts).join(artifacts.select("artifact", "retrieved_at"), "artifact")
    fresh = ops.pick(parsed, keys, F.struct("retrieved_at", "artifact"), ["fingerprint", "content", "evidence", "artifact"])
    old = stored.select(*keys, F.struct("fingerprint", "content").alias("o"))
    both = fresh.select(*keys, F.struct("fingerprint", "content", "evidence", "artifact").alias("n")).join(old, keys, "full")
    same = F.col("n.fingerprint").eqNullSafe(F.col("o.fingerprint"))
    outcome = F.when(F.col("n").isNull(), "absent").when(F.col("o").isNull(), "inserted").when(same, "kept").otherwise("rewritten")
    pick = lambda c: F.when(F.col("n").isNotNull() & ~same, F.col(f"n.{c}")).otherwise(F.coalesce(f"o.{c}", f"n.{c}")).alias(c)
    records = both.select(*keys, pick("fingerprint"), pick("content"), outcome.alias("outcome"))
    bare = fresh.join(evidence.select(*keys).distinct(), keys, "left_anti")
    return records, bare.select(*keys, "artifact", F.explode("evidence").alias("text"))
