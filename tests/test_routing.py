import datetime

import pytest
from pyspark.sql import functions as F

from cairnworks.operators import derivations, gate, resolver, routing, views

NOW = "2026-07-20 00:00:00"
FEATURES = (
    "project long, county string, stage string, text string, records array<string>, max_units int, max_valuation double, cluster_size int, has_velocity boolean, campus_block string, "
    f"orgs {routing.ORGS}, a_grade int, last_change timestamp, applied_at timestamp, sources int, stage_depth int, contradiction boolean, warm array<string>"
)
BASE = dict(project=1, county="Pierce", stage="permit_applied", text="", records=None, max_units=None, max_valuation=None, cluster_size=1, has_velocity=False, campus_block=None, orgs=[], a_grade=1, last_change=datetime.datetime(2026, 7, 10), applied_at=None, sources=1, stage_depth=1, contradiction=False, warm=None)
INTERIOR = routing.Account("in", "interior", ("Pierce", "King"), {"trade_fit": 35, "package_size_fit": 20, "timing": 25, "geography": 10, "evidence_quality": 10}, geography={"Pierce": 0.9}, distant="King", trades=("Drywall",))
COMMERCIAL = routing.Account("co", "commercial", ("Pierce",), {"division_08_system_fit": 50, "scale_value": 50})


def routes(spark, account, **over):
    row = {**BASE, **over}
    frame = spark.createDataFrame([tuple(row[f.split()[0]] for f in FEATURES.split(", "))], FEATURES)
    found = routing.routed(frame, [account], NOW).collect()
    return found[0] if found else None


def test_interior_router(spark):
    r = routes(spark, INTERIOR, text="tenant improvement with drywall", max_valuation=5e5)
    assert (r["route"], r["score"], r["state"]) == ("interior_trades", 99.0, "priority_review")
    assert routes(spark, INTERIOR, text="tenant improvement with drywall", max_valuation=5e5, county="Lewis") is None
    house = routes(spark, INTERIOR, text="new single family residence", cluster_size=5)
    assert house["route"] == "gc_relationship_radar" and "production_builder_pipeline" in house["signals"] and house["components"]["trade_fit"] == 0.45
    assert routes(spark, INTERIOR, text="new single family residence", county="King") is None  # a distant market
    assert routes(spark, INTERIOR, text="demolition of a single family residence") is None
    late = routes(spark, INTERIOR, text="office", stage="permit_issued")
    assert "commercial_bid_window_likely_closed" in late["signals"] and late["components"]["timing"] == pytest.approx(0.2)


def test_signals_do_not_score_but_a_warm_contractor_does(spark):
    org = [("Acme", "owner", "R1", True, 4.5, 9, ["DRYWALL"])]
    plain, told = routes(spark, INTERIOR, text="office"), routes(spark, INTERIOR, text="office", orgs=org)
    assert told["score"] == plain["score"] and {"verified_gc_on_project", "gc_quality", "trade_match"} <= set(told["signals"])
    assert routes(spark, INTERIOR, text="office", warm=["in"])["score"] == plain["score"] + routing.WARM_BONUS
    assert routes(spark, INTERIOR, text="office", warm=["other"])["score"] == plain["score"]


def test_a_keyword_does_not_cross_records(spark):
    apart = routes(spark, COMMERCIAL, text="demolition of glass storefront. new construction of shed", records=["demolition of glass storefront", "new construction of shed"])
    assert apart["components"]["division_08_system_fit"] == 0.2 and "division_08_keywords" not in apart["signals"]
    together = routes(spark, COMMERCIAL, text="new construction with storefront", records=["new construction with storefront"])
    assert together["components"]["division_08_system_fit"] == 1.0


def test_a_run_keeps_what_people_decided(spark):
    old = spark.createDataFrame([("in", 1, 5.0, "v1", "r", s, None, None) for s in ("dismissed",)] + [("in", 2, 5.0, "v1", "r", "weekly_digest", None, None), ("in", 3, 5.0, "v1", "r", "promoted", None, None), ("x", 2, 5.0, "v1", "r", "new", None, None)], "account string, project long, score double, version string, route string, state string, first_qualified_at timestamp, deroute string")
    new = spark.createDataFrame([("in", 1, 90.0, "q", "priority_review")], "account string, project long, score double, route string, state string")
    scored = spark.createDataFrame([(1,), (2,), (3,)], "project long")
    once = routing.score_run(old, new, scored, [INTERIOR], "v2", NOW)
    want = {("in", 1): ("dismissed", 90.0, None), ("in", 2): ("archive", 5.0, "no_longer_routed:weekly_digest"), ("in", 3): ("promoted", 5.0, None), ("x", 2): ("new", 5.0, None)}
    read = lambda df: {(r["account"], r["project"]): (r["state"], r["score"], r["deroute"]) for r in df.collect()}
    assert read(once) == want and read(routing.score_run(once, new, scored, [INTERIOR], "v2", NOW)) == want
    assert [r["project"] for r in routing.current_scores(once, "v2").collect()] == [1]


def test_the_gate_fails_before_it_is_blocked(spark):
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    day = datetime.datetime(2026, 7, 1)
    made = gate.gate(
        frame([(i, i, 70.0, 65.0) for i in (1, 2, 3, 4, 5)], "opportunity long, project long, score double, digest_min double"),
        frame([(i, "P", "K", "J", "approved") for i in (1, 2, 3, 4)], "project long, name string, county string, jurisdiction string, stage string"),
        frame([(i, i * 10, "s") for i in (1, 2, 3, 4)], "project long, record long, source string"), frame([("s", "green"), ("s", "red")], "source string, freshness string"),
        frame([(i, i * 10, day, day, True) for i in (1, 2, 3, 4)], "project long, record long, event_date timestamp, observed_at timestamp, material boolean"),
        frame([(i, i * 10, "A", "f") for i in (1, 2, 3, 4)] + [(30, 30, "C", "g"), (40, 40, "C", "g"), (41, 40, "B", "g")], "evidence long, record long, grade string, fact_path string"),
        frame([(20, None)], "record long, candidate long"), frame([(3, [("g", 30, True, 0.9)]), (4, [("g", 40, True, 0.9)])], f"project long, facts array<{gate.FACT}>"),
        frame([(4, "succeeded", [True, True])], "project long, status string, verdicts array<boolean>"), NOW,
    )
    got = {r["opportunity"]: ([c for c in gate.CHECKS if r[c] is False], r["verifier"], r["status"]) for r in made.collect()}
    assert got[1] == ([], None, "blocked_on_verifier")  # not extracted yet
    assert got[2] == (["no_identity_contradiction"], None, "fail")
    assert got[3] == (["facts_evidenced"], None, "fail")  # a C grade alone
    assert got[4] == ([], True, "pass")  # a C grade with another of the same path
    assert got[5][2] == "fail" and {"source_health", "identity_complete", "a_grade_core_event", "timing_current"} <= set(got[5][0])


RUN = "source string, run int, started_at timestamp, completed_at timestamp, status string, orphaned boolean, discovered int, parsed int, unchanged int, duplicates int, violations int, fill map<string,double>, schema_print string"


@pytest.mark.parametrize(("newest_first", "want"), [
    ([("succeeded", {})], ("green", ["healthy"])), ([], None), ([("running", {})], ("amber", ["no completed runs yet"])), ([("failed", {}), ("failed", {})], ("red", ["two consecutive failed runs"])),
    ([("failed", {}), ("succeeded", {})], ("amber", ["latest run failed"])), ([("completed_with_errors", {"orphaned": True, "parsed": 0}), ("succeeded", {})], ("amber", ["latest run orphaned"])),
    ([("succeeded", {"parsed": 0})], ("red", ["zero usable records"])), ([("succeeded", {"parsed": 4}), ("succeeded", {"parsed": 10})], ("amber", ["volume dropped"])), ([("succeeded", {"parsed": 4, "duplicates": 1}), ("succeeded", {"parsed": 10})], ("green", ["healthy"])),
    ([("succeeded", {"fill": {"a": 0.6}}), ("succeeded", {"fill": {"a": 0.9}})], ("red", ["field fill dropped: a"])), ([("succeeded", {"schema_print": "y"}), ("succeeded", {}), ("succeeded", {})], ("amber", ["schema changed"])),
    ([("succeeded", {"schema_print": "y"}), ("succeeded", {}), ("succeeded", {"schema_print": "y"})], ("green", ["healthy"])), ([("succeeded", {"violations": 2})], ("red", ["parser invariant violation"])),
])
def test_source_health(spark, newest_first, want):
    base = {"orphaned": False, "discovered": 9, "parsed": 10, "unchanged": 0, "duplicates": 0, "violations": 0, "fill": None, "schema_print": "x"}
    rows = []
    for k, (status, over) in enumerate(newest_first):
        at = datetime.datetime(2026, 7, 19, 12) - datetime.timedelta(hours=k)
        rows.append(("s", -k, at, at, status, *({**base, **over}[c] for c in base)))
    got = views.source_health(spark.createDataFrame(rows, RUN), NOW, F.lit(None).cast("int")).collect()
    assert (got[0]["state"], got[0]["reasons"]) == want if want else got == []


def test_a_second_reap_changes_nothing(spark):
    runs = spark.createDataFrame([(1, "running", datetime.datetime(2026, 7, 19), None), (2, "running", datetime.datetime(2026, 7, 19, 23, 30), None), (3, "succeeded", datetime.datetime(2026, 7, 1), None)], "run int, status string, started_at timestamp, orphaned boolean")
    once = views.reaped(runs, NOW)
    got = {r["run"]: (r["status"], r["orphaned"]) for r in once.collect()}
    assert got == {1: ("completed_with_errors", True), 2: ("running", False), 3: ("succeeded", False)}
    assert {r["run"]: (r["status"], r["orphaned"]) for r in views.reaped(once, NOW).collect()} == got


def test_replay_backfills_only_bare_records(spark):
    artifacts = spark.createDataFrame([(1, 1, "a=1"), (2, 2, "a=2"), (3, 3, "b=1")], "artifact int, retrieved_at int, body string")
    parse = lambda df: df.select("artifact", F.lit("s").alias("source"), F.substring_index("body", "=", 1).alias("external_id"), F.col("body").alias("fingerprint"), F.col("body").alias("content"), F.array("body").alias("evidence"))
    stored = spark.createDataFrame([("s", "a", "old", "old"), ("s", "c", "c", "c")], "source string, external_id string, fingerprint string, content string")
    records, more = views.replay(artifacts, parse, stored, spark.createDataFrame([("s", "a")], "source string, external_id string"))
    assert {r["external_id"]: (r["content"], r["outcome"]) for r in records.collect()} == {"a": ("a=2", "rewritten"), "b": ("b=1", "inserted"), "c": ("c", "absent")}
    assert [(r["external_id"], r["text"]) for r in more.collect()] == [("b", "b=1")]
    again, _ = views.replay(artifacts, parse, records.drop("outcome"), stored)
    assert {r["outcome"] for r in again.collect()} == {"kept", "absent"}


def test_velocity_is_told_once(spark):
    projects = spark.createDataFrame([(1, "d", None, 5), (2, "d", 9, 1), (3, None, None, 1)], "project long, development string, parent long, first_seen int")
    events = spark.createDataFrame([(1 + i % 2, i, "permit_issued", None, datetime.datetime(2026, 7, 1 + i)) for i in range(6)] + [(3, 99, "permit_issued", None, datetime.datetime(2026, 7, 9))], "project long, record long, event string, event_date timestamp, observed_at timestamp")
    first = derivations.cluster_velocity(projects, events, spark.createDataFrame([], "anchor long, record long"), NOW)
    assert [(r["anchor"], r["record"], r["permits"]) for r in first.collect()] == [(9, 5, 6)]
    assert derivations.cluster_velocity(projects, events, first, NOW).collect() == []


def test_claims(spark):
    rows = spark.createDataFrame([(" title ", "a", None, "identity", True, 0.95), ("links.x", "B", None, "other", False, 0.75), ("units", "D", "discovery_only_grade", "other", False, None), ("units", None, "unknown_grade", "other", None, None)], "p string, g string, refused string, claim string, confirmed boolean, confidence double")
    for r in rows.select("*", derivations.claim(F.col("p"), F.col("g")).alias("c")).collect():
        assert tuple(r["c"]) == (r["refused"], r["claim"], r["confirmed"], r["confidence"])


def test_preview_says_what_would_be_decided(spark):
    kind = "record long, seen int, record_type string, jurisdiction string, county string, external_id string, reference_ids array<string>, parcels array<string>, address string, title string, title_tokens array<string>, generic boolean, org_bases array<string>, org_names array<string>, lon double, lat double"
    rows = [(i, i, "building_permit", "J", "C", x, [], [], None, "t", [], False, [], [], None, None) for i, x in ((1, "A"), (2, "A"), (3, "B"))]
    was = spark.createDataFrame([(2, "review"), (3, "review")], "record long, outcome string")
    got = resolver.previewed(spark.createDataFrame(rows, kind), was, was).collect()
    assert sorted((r["record"], r["was"], r["now"], r["project"]) for r in got) == [(2, "review", "merged", 1), (3, "review", "created", 3)]
