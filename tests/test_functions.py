import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from cairnworks.functions import names, scalars


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("function", "raw", "want"),
    [
        (names.normalize_parcel, "1234-56-7890", "1234567890"), (names.normalize_parcel, "12-3", None),
        (names.normalize_phone, "1 (360) 555-0123 x102", "3605550123"), (names.normalize_phone, "555-0123", None),
        (names.normalize_identifier, "ab-12 c", "AB12C"), (names.normalize_identifier, "--", None),
        (names.normalize_entity_id, " pals:  12 ", "pals: 12"), (names.normalize_entity_id, "462942", None),
        (names.root_domain, "https://user@www.Acme.com:8080/a?b", "acme.com"), (names.root_domain, "http://10.0.0.1/x", None), (names.root_domain, "m.facebook.com/acme", None),
        (names.org_name_key, "ABC CONSTRUCTION LLC", "ABC CONSTRUCTION"), (names.org_name_key, "500 UNION STREET LLC", "500 UNION STREET"),
        (names.org_name_key, "ANDRZEJ TATKOWSKI 500 UNION STREET SUITE 410 SEATTLE WA 98101", "ANDRZEJ TATKOWSKI"), (names.cross_name_key, "Smith & Sons, Inc.", "SMITH SONS"),
        (names.is_generic_name, "Tenant Improvement", True), (names.is_generic_name, "Harbor Tower", False),
        (names.is_government_name, "CITY OF LAKEWOOD", True), (names.is_government_name, "Thurston County Cement Fnshrs", False),
        (names.name_quality, "SAME AS OWNER LLC", "junk"), (names.name_quality, "Acme Roofing", "business"), (names.name_quality, "Jo Brown", "person_or_unknown"),
        (names.principal_key, "Smith, John Q", "SMITH|JOHN Q"), (names.principal_key, "John Smith", None), (names.core_principal_key, "Smith, John Q", "SMITH|JOHN"), (names.middle_initial, "Smith, John Q", "Q"),
        (names.bare_title, "BLD-12 – Harbor Tower", "Harbor Tower"), (names.address_match_key, "123 North Main Street Ste 4 Olympia WA 98501", "123 N MAIN ST|98501"),
        (scalars.units_from_text, "73 single-family lots and 5 units", 73), (scalars.units_from_text, "no count", None), (scalars.csv_field, 'a "b", c', '"a ""b"", c"'),
    ],
)
def test_one_value(spark, function, raw, want):
    assert value(spark, function(F.lit(raw))) == want
    assert value(spark, function(F.lit(None).cast("string"))) in (None, "junk", False, "")


def test_addresses(spark):
    got = value(spark, names.address_parts(F.lit("123 North Main Street, Olympia, WA 98501-1234")))
    assert (got["line"], got["city"], got["zip"]) == ("123 N MAIN ST", "OLYMPIA", "98501")
    got = value(spark, names.address_parts(F.lit("123 Main St Ste 4")))
    assert (got["line"], got["city"]) == ("123 MAIN ST STE 4", None)


def test_names_compared(spark):
    assert math.isclose(value(spark, names.name_similarity(F.lit("CHARLES"), F.lit("K C Charles Inc"))), 1 / 3)
    assert math.isclose(value(spark, names.name_similarity(F.lit("HOUSE"), F.lit("A-Z House LLC"))), 1 / 3)
    found = value(spark, names.name_containment(F.lit("NEXT LEVEL ROOFING & CONSTRUCTION LLC"), F.lit("Next Level Roofing")))
    assert found["contained"] and found["direction"] == "registry_in_org"
    assert not value(spark, names.name_containment(F.lit("G & G HEATING"), F.lit("Pro Heating")))["contained"]
    assert value(spark, names.name_agreement(F.lit("Acme LLC"), F.lit("ACME, Inc."))) == "exact"


def test_stages_and_classes(spark):
    assert value(spark, scalars.later_stage(F.lit("approved"), F.lit("withdrawn"))) == "approved"
    assert value(spark, scalars.later_stage(F.lit("approved"), F.lit("complete"))) == "complete"
    assert value(spark, scalars.permit_class(F.lit("Commercial"), F.lit("Shoreline variance"))) == "land_use"
    assert value(spark, scalars.event_type(F.lit("building_permit"), F.lit(None).cast("date"))) == "permit_applied"
    assert value(spark, scalars.best_glazing_fit(F.array(F.lit("demolition of shed"), F.lit("install storefront glazing")), F.lit(0))) == 1.0


def test_gate_and_trust(spark):
    yes, no, unknown = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    assert [value(spark, scalars.gate_status(c)) for c in ([yes, yes], [yes, unknown], [no, unknown])] == ["pass", "blocked", "fail"]
    assert value(spark, scalars.trust({"name": F.lit(1.0), "role": F.lit(None).cast("double"), "rule_history": F.lit(0.5)})) == 0.8
    assert value(spark, scalars.round_half_up(F.lit(1.005), 2)) == 1.0
    assert value(spark, scalars.accept_rate(F.lit(9), F.lit(9))) is None


def test_fingerprints_see_nested_fields(spark):
    df = spark.createDataFrame([("a", ("x", 1)), ("a", ("y", 1))], "k string, org struct<name:string,n:int>")
    got = [r["f"] for r in df.select(scalars.fingerprint(F.col("k"), F.col("org")).alias("f")).collect()]
    assert got[0] != got[1]
    assert got[0] == hashlib.sha256(json.dumps({"k": "a", "org": {"name": "x", "n": 1}}, separators=(",", ":")).encode()).hexdigest()


def test_distance(spark):
    assert abs(value(spark, scalars.distance_m(F.lit(0.0), F.lit(0.0), F.lit(0.001), F.lit(0.0))) - 111.19) < 0.01
    # The textbook form of the inverse projection, on the sphere of the WGS 84 equator.
    assert abs(value(spark, scalars.mercator_lat(F.lit(5_000_000.0))) - math.degrees(math.atan(math.sinh(5_000_000 / 6_378_137)))) < 1e-9


def test_name_agreement_by_loose_keys(spark):
    cases = [
        ("LIMITLESS HEATING COOLING LL", "Limitless Heating Cooling LLC", "exact"), ("", "Acme", "none"), (None, "Acme", "none"), ("KOALA T POOL SPA SERVS", "Koala T Pool Spa", "exact"),
        ("Acme Glass", "Acme Glass and Mirror of Tacoma", "contained"), ("Glass Acme", "Acme Glass and Mirror of Tacoma", "none"), ("Acme", "Acme Glass", "none"), ("I 5 Glass", "I 5 Glass Inc", "exact"),
    ]
    for a, b, want in cases:
        assert value(spark, names.name_agreement(F.lit(a).cast("string"), F.lit(b))) == want, (a, b)
    assert value(spark, names.name_quality(F.lit("St Mark Church"))) == value(spark, names.name_quality(F.lit("Lakes High School"))) == "business"
    assert value(spark, names.name_quality(F.lit("Ann Author"))) == "person_or_unknown"


def test_bid_windows_and_capacity(spark):
    def status(stage, track, weeks):
        issued = F.date_sub(F.lit("2026-07-17").cast("date"), 7 * weeks) if weeks is not None else F.lit(None).cast("date")
        return value(spark, scalars.bid_window(F.lit(stage), F.lit(track), issued, F.lit("2026-07-17").cast("date"), 4, 8, 10)["status"])

    for stage, track, weeks, want in (
        ("permit_issued", "residential", 2, "opens_soon"), ("permit_issued", "residential", 5, "open"), ("permit_issued", "residential", 10, "open"), ("permit_issued", "residential", 11, "likely_closed"),
        ("construction", "residential", 6, "open"), ("permit_issued", "residential", None, "watch"), ("concept", "residential", None, "watch"), ("complete", "residential", 1, "likely_closed"),
        ("bidding_confirmed", "commercial", None, "confirmed_open"), ("withdrawn", "commercial", None, "likely_closed"), ("approved", "commercial", None, "open"), ("concept", "commercial", None, "watch"),
        ("permit_issued", "commercial", 1, "likely_closed"),
    ):
        assert status(stage, track, weeks) == want, (stage, track, weeks)
    null = F.lit(None).cast("double")
    fit = lambda v, least, most, out=False: value(spark, scalars.capacity_fit(v, least, most, F.lit(out))["fit"])
    assert fit(F.lit(10.0), F.lit(50.0), null) == "possible_stretch" and fit(F.lit(99.0), null, null) == "likely_fit"
    assert fit(F.lit(99.0), F.lit(1.0), F.lit(50.0)) == "likely_too_large" and fit(null, F.lit(1.0), F.lit(50.0)) == "unknown" and fit(null, null, null, True) == "excluded"


def test_glazing_rules_and_events(spark):
    for text, units, want in (("demolition of shed", 0, 0.2), ("athletic field", 0, 0.2), ("rezone", 0, 0.4), ("new storefront windows, office", 0, 1.0), ("office, no exterior change, glass door", 0, 0.7), ("apartment", 0, 0.4), ("plain", 3, 0.4), ("plain", 0, 0.2)):
        assert value(spark, scalars.glazing_fit(F.lit(text), F.lit(units))) == want, text
    assert value(spark, scalars.event_type(F.lit("issued_permit"), F.lit("2026-01-01").cast("date"))) == "permit_issued"
    assert value(spark, scalars.event_type(F.lit("other"), F.lit(None).cast("date"))) == "project_first_seen"
