import math
import random

import pytest
from pyspark.sql import functions as F

from cairnworks.functions import names, people
from cairnworks.operators import developments, registry

FIRM = "entity long, name string, status string, principals array<struct<name:string,key:string>>, state string, phone string, google_phone string, address string, postcode string, city string, domain string, ubi string, trade_codes array<string>"


def firm(entity, keys, **over):
    row = dict.fromkeys((f.split()[0] for f in FIRM.split(", ")))
    return tuple({**row, "entity": entity, "name": f"Co {entity}", "state": "WA", "principals": None if keys is None else [(k.title(), k) for k in keys], **over}.values())


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "want"), [
    ("Smith, John Q", ("SMITH", "JOHN", "Q")), ("John Q Smith", ("SMITH", "JOHN", "Q")), ("John Smith", ("SMITH", "JOHN", None)), ("O'Brien, Pat Jr.", ("OBRIEN", "PAT", None)), ("Acme Plumbing LLC", None),
    ("Madonna", None), ("A B C D", None), ("", None), (None, None), ("Smith,", None),
])
def test_person_parts(spark, raw, want):
    got = value(spark, people.person_parts(F.lit(raw).cast("string")))
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(("raw", "zip_code", "want"), [
    ("1210 Homann Dr SE 210", "98501", ["1210 HOMANN DR SE 210 98501", "1210 HOMANN DR SE 98501"]), ("33820 Weyerhaeuser Way, Federal Way WA 98001", None, ["33820 WEYERHAEUSER WAY 98001"]),
    ("12 Main Street Suite 4 Olympia WA 98501-1234", None, ["12 MAIN ST OLYMPIA 98501", "12 MAIN ST 98501"]), ("500 Union Street Gig Harbor Bay", "98335", ["500 UNION ST GIG HARBOR BAY 98335", "500 UNION ST GIG HARBOR 98335", "500 UNION ST GIG 98335", "500 UNION ST 98335"]),
    ("N/A 98501", None, []), ("PO 5", "98501", []), ("12 Main Street", None, []), (None, "98501", []), ("100 Highway 99, Lynnwood", "98036", ["100 HWY 99 98036"]),
])
def test_key_ladder(spark, raw, zip_code, want):
    assert value(spark, people.key_ladder(F.lit(raw).cast("string"), F.lit(zip_code).cast("string"))) == want


@pytest.mark.parametrize(("raw", "want"), [
    ("X-1 – Cedar Ridge Phase #2", ("CEDAR RIDGE", "PHASE 2", False)), ("Plat of Cedar Ridge", ("CEDAR RIDGE", None, True)), ("ADDITION ALTERATION", (None, None, False)), ("Ridge", (None, None, False)), ("Cedar Ridge Div. 5 Lot 3", ("CEDAR RIDGE", "DIV 5", False)),
])
def test_development_name(spark, raw, want):
    got = value(spark, names.development_name(F.lit(raw)))
    assert (got["base"], got["phase"], got["is_plat"]) == want


def test_bare_title(spark):
    assert [value(spark, names.bare_title(F.lit(x))) for x in ("BLD 12 – Harbor – Tower", "SUP25-0002 - Tower", "A – ")] == ["Harbor – Tower", "SUP25-0002 - Tower", "A – "]


def members(spark, rows, cap=registry.MAX_FAMILY):
    held, dropped = registry.families(spark.createDataFrame(rows, FIRM), cap)
    out = {}
    for r in held.collect():
        out.setdefault(r["family"], [r["min_points"], set()])[1].add(r["entity"])
    return out, {(r["family"], r["size"]) for r in dropped.collect()}


def test_families(spark):
    rows = [firm(1, ["A, ANN"]), firm(2, ["A, ANN", "B, BOB"]), firm(3, ["B, BOB"])]  # transitive
    rows += [firm(11, ["MOORE, MICHAEL F"]), firm(12, ["MOORE, MICHAEL L"])]  # another initial
    rows += [firm(21, ["CT CORPORATION SYSTEM"]), firm(22, ["CT CORPORATION SYSTEM"])]  # an agent
    rows += [firm(31, ["M, JAMES T"], status="merged"), firm(32, ["M, JAMES T"]), firm(33, None)]
    rows += [firm(41, ["POMPA, NAT"], phone="2535550100", city="renton", trade_codes=["electrical"]), firm(42, ["POMPA, NAT"], phone="(253) 555-0100", city="Renton", trade_codes=["Electrical", "hvac"])]
    rows += [firm(51, ["BIG, FAM"], phone="2535550100", city="renton"), firm(52, ["BIG, FAM"], phone="2535550100", city="renton"), firm(53, ["BIG, FAM"], city="spokane")]
    assert members(spark, rows) == ({"A, ANN": [0, {1, 2, 3}], "POMPA, NAT": [3, {41, 42}], "BIG, FAM": [0, {51, 52, 53}]}, set())


def test_a_family_beyond_the_cap_is_dropped_whole(spark):
    rows = [firm(i, ["S, SNEAKY"]) for i in range(6)] + [firm(10, ["S, SNEAKY", "T, TOM"]), firm(11, ["T, TOM"])] + [firm(20 + i, ["OK, AL"]) for i in range(5)]
    got, dropped = members(spark, rows, cap=5)
    assert set(got) == {"OK, AL"} and dropped == {("S, SNEAKY", 8)}


def points_of(a, b):
    """The fields that agree between two rows, a's entity being the lesser."""
    digits = lambda r, c: (lambda d: d if len(d) >= 7 else None)("".join(filter(str.isdigit, r[c] or "")))
    text = lambda r, c: (r[c] or "").strip().upper() or None
    same = lambda x, y: x is not None and x == y
    google = same(digits(a, "google_phone"), digits(b, "google_phone")) and digits(a, "google_phone") != digits(a, "phone")
    plain = sum(same(text(a, c), text(b, c)) for c in ("address", "postcode", "city", "domain", "ubi"))
    return plain + google + same(digits(a, "phone"), digits(b, "phone")) + bool({t.lower() for t in a["trade_codes"]} & {t.lower() for t in b["trade_codes"]})


@pytest.mark.parametrize(("seed", "kinds", "block"), [(1, 2, 500), (2, 3, 4), (3, 1, 2)])
def test_a_family_of_any_size_is_whole(spark, seed, kinds, block):
    """Far more firms than MAX_FAMILY behind one person, some of them alike: none is left out, and the weakest pair is that of all pairs."""
    draw = random.Random(seed)
    pick = lambda *of: draw.choice(of[:kinds])
    rows = [
        firm(i, ["S, SNEAKY"], phone=pick("(253) 555-0100", "2535550100", "2065550100"), google_phone=pick("2535550100", "206-555-0100", None), city=pick("Renton", "renton ", "Yelm"), postcode=pick("98501", "98501", "98502"), domain=pick("a.com", "a.com", None), trade_codes=pick(["A", "b"], ["B"], ["c"]))
        for i in range(60)
    ] + [firm(100, ["OK, AL"]), firm(101, ["OK, AL"])]
    held, dropped = registry.families(spark.createDataFrame(rows, FIRM), block=block)
    named = [dict(zip((f.split()[0] for f in FIRM.split(", ")), r, strict=True)) for r in rows[:60]]
    least = min(points_of(a, b) for k, b in enumerate(named) for a in named[:k])
    assert {tuple(r) for r in held.select("family", "entity", "size", "min_points").collect()} == {("S, SNEAKY", i, 60, least) for i in range(60)} | {("OK, AL", i, 2, 0) for i in (100, 101)}
    assert dropped.collect() == []


def test_chains_are_one_family(spark):
    rows = [firm(i, [f"K{chr(65 + i)}, X", f"K{chr(66 + i)}, X"]) for i in range(20)]
    random.Random(1).shuffle(rows)
    got, _ = members(spark, rows)
    assert {k: v[1] for k, v in got.items()} == {"KA, X": set(range(20))}


def test_corroboration_contradicts(spark):
    fields = ", ".join(f"{c}:string" for c in registry.FIELDS)
    frame = spark.createDataFrame([((*["WA", "5551234567", "5551234567", None, "98501", "x", None, None], ["A"]), (*["MD", "555-123-4567", "5551234567", None, "98501", "y", None, None], ["a"]))], f"a struct<{fields},trade_codes:array<string>>, b struct<{fields},trade_codes:array<string>>")
    got = frame.select(registry.corroborate(F.col("a"), F.col("b"), F.lit("MOORE, MICHAEL F"), F.lit("MOORE, MICHAEL LANE")).alias("c")).first()["c"]
    assert (got["points"], got["agreeing"], got["against"], got["verdict"]) == (3, ["phone", "postal_code", "trade"], ["middle_initial", "state"], "contradicted")


def test_people(spark):
    rows = [firm(1, ["SMITH, JOHN Q"], city="lacey", name="Smith Homes"), firm(2, ["SMITH, JOHN R", "SMITH, JOHN S"], city="yelm"), firm(3, ["DOE, JANE"], status="closed")]
    people_ = spark.createDataFrame([(7, "John Q Smith", 1, ["City of Lacey"], "primary_contractor"), (8, "Doe, Jane", None, None, None), (9, "SMITH JOHN", None, None, None), (10, "Smith, John", 5, None, "owner")], "candidate long, person_name string, bound_entity long, jurisdictions array<string>, role string")
    got = {(r["candidate"], r["entity"]): (r["namesakes"], r["middle_initial"], r["unique_name"], r["points"], r["verdict"], r["already_bound"]) for r in registry.matched_people(people_, spark.createDataFrame(rows, FIRM)).collect()}
    assert got == {
        (7, 1): (3, True, False, 4, "strong", True), (7, 2): (3, False, False, 1, "contradicted", False), (10, 1): (3, None, False, 1, "corroborated", False), (10, 2): (3, None, False, 0, "name_only", False),
    }


def test_ladder_skips_rungs_of_several_owners(spark):
    owners = spark.createDataFrame([(1, "12 Main St Olympia", "98501"), (2, "12 Main St Olympia", "98501"), (3, "12 Main St", "98501"), (4, "9 Elm Street", "98501"), (4, "9 Elm St", "98501")], "owner long, address string, zip string")
    wanted = spark.createDataFrame([(1, "12 Main Street Olympia", "98501"), (2, "9 Elm Street Lacey", "98501"), (3, None, None)], "key long, address string, zip string")
    got = {r["key"]: (r["owner"], r["rank"], r["address_key"]) for r in registry.bound_by_address(wanted, owners).collect()}
    assert got == {2: (4, 1, "9 ELM ST 98501")}


PROJECT = "project long, name string, county string, parcels array<string>, org_ids array<string>, lon double, lat double, first_seen int, last_seen int, development string, parent long"


def test_developments_equal_all_pairs(spark):
    draw = random.Random(3)
    rows = []
    for i in range(400):
        name = f"{draw.choice(('Oak', 'Elm', 'Fir'))} Ridge {draw.choice('ABCDEFGH')}" + draw.choice(("", " Phase 2", " Lot 4"))
        lon, lat = (-122 + draw.random() * 0.12, 47 + draw.random() * 0.1) if draw.random() < 0.8 else (None, None)
        rows.append((i, ("Plat of " if draw.random() < 0.1 else "") + name, draw.choice(("K", "P", None)), draw.choice((None, [f"P{draw.randint(0, 900)}"])), draw.choice((None, [str(draw.randint(0, 900))])), lon, lat, i, i, "D1" if i == 7 else None, None))
    frame = spark.createDataFrame(rows, PROJECT)
    named = {r["project"]: r["d"] for r in frame.select("project", names.development_name(F.col("name")).alias("d")).collect()}

    def metres(a, b):
        (x, y), (u, v) = (map(math.radians, p[5:7]) for p in (a, b))
        return 2 * 6371000 * math.asin(math.sqrt(math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2))

    groups = {}
    for r in rows:
        groups.setdefault((r[2], named[r[0]]["base"]), []).append(r)
    want = {}
    for (county, base), held in groups.items():
        support = any(set(a[3] or ()) & set(b[3] or ()) or set(a[4] or ()) & set(b[4] or ()) or (a[5] is not None and b[5] is not None and metres(a, b) <= 1000) for k, a in enumerate(held) for b in held[:k])
        if len(held) < 2 or not support:
            continue
        roots = [r[0] for r in held if named[r[0]]["is_plat"] or named[r[0]]["phase"] is None]
        had = min((r[9] for r in held if r[9]), default=None)
        for r in held:
            child = named[r[0]]["phase"] is not None and not named[r[0]]["is_plat"] and len(roots) == 1
            want[r[0]] = (r[9] or had or f"{county or 'null'}::{base}", len(held), roots[0] if child else None)
    got = {r["project"]: (r["development"], r["members"], r["parent"]) for r in developments.developments(frame).collect()}
    assert got == want and 0 < len(want) < 400


def test_a_large_development_makes_no_pairs(spark):
    """3000 members of one name over 3000 far places: neighbours are looked up by cell."""
    rows = [(i, "Oak Ridge", "K", None, None, -122 + (i % 60) * 0.03, 40 + (i // 60) * 0.03, i, i, None, None) for i in range(3000)]
    frame = spark.createDataFrame(rows, PROJECT).withColumn("base", F.lit("OAK RIDGE")).withColumns({"parcels": F.array().cast("array<string>"), "org_ids": F.array().cast("array<string>")})
    assert developments.supported_groups(frame).collect() == []
    plan = developments.supported_groups(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan
    near = frame.union(frame.filter("project = 5").withColumns({"project": F.lit(9999).cast("long"), "lon": F.col("lon") + 0.01}))
    assert len(developments.supported_groups(near).collect()) == 1
