"""Many rows of one place, set or name: what meets are their classes."""

import itertools
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cairnworks.operators import registry as reg
from cairnworks.operators import relational as ops
from cairnworks.plans import joins, links, views
from cairnworks.plans.registry import Tables
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def crowd(spark):
    """30,000 customers of one place: 450 million pairs."""
    return SimpleNamespace(spark=spark, customer=spark.range(30_000).select((F.col("id") * 1000).alias("c_custkey"), F.lit(3).alias("c_nationkey")))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_a_crowded_place_are_counted_by_places(crowd):
    pairs = joins.haversine_pairs(crowd)
    assert "c_custkey" not in plan_of(pairs)
    assert [tuple(r) for r in pairs.collect()] == [(3, 30_000 * 29_999 // 2)]


def test_a_customer_alone_has_no_pairs(spark):
    one = SimpleNamespace(spark=spark, customer=spark.createDataFrame([(1, 3), (2, 4)], "c_custkey long, c_nationkey int"))
    assert joins.haversine_pairs(one).count() == 0


def test_nearest_of_a_crowded_place(crowd):
    rows = joins.nearby_five(crowd)
    joined = [line for line in plan_of(rows).splitlines() if "Join Inner" in line]
    assert not any("l_id" in line or "_cell" in line and "c_custkey" in line for line in joined)
    assert rows.count() == 150_000
    got = {k: [r["r_id"] for r in rows.filter(F.col("l_id") == k).orderBy("place").collect()] for k in (0, 2000, 29_999_000)}
    assert got == {0: [1000, 2000, 3000, 4000, 5000], 2000: [0, 1000, 3000, 4000, 5000], 29_999_000: [0, 1000, 2000, 3000, 4000]}


def test_equal_sets_become_pairs_after_the_last_shuffle(spark):
    rows = [(i, "x", t) for i, t in enumerate([["a", "b", "c"]] * 40 + [["c", "b", "a", "a"]] * 30 + [["a", "b", "c", "d"]] * 20 + [["z"]])] + [(900, None, ["z"]), (901, None, ["z"]), (902, "y", ["z"])]
    found = ops.similar_pairs(spark.createDataFrame(rows, "id int, g string, t array<string>"), "id", "t", 0.7, ["g"])
    plan = plan_of(found)
    assert plan.index("Generate") < plan.index("Repartition") < plan.index("Join")
    want = {(i, j): round(len(set(t) & set(u)) / len(set(t) | set(u)), 9) for (i, g, t), (j, h, u) in itertools.combinations(rows, 2) if g is not None and g == h and len(set(t) & set(u)) / len(set(t) | set(u)) >= 0.7}
    got = [(r["a"], r["b"], round(r["similarity"], 9)) for r in found.collect()]
    assert len(got) == len(want) and {(a, b): s for a, b, s in got} == want


def test_blocks_split_large_groups_and_keep_null_keys(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") < 90, "k").alias("key"))
    held = ops.blocks(rows, ["key"], "id", "ids", 10).collect()
    assert sorted(i for r in held for i in r["ids"]) == list(range(100))
    assert len([r for r in held if r["key"] == "k"]) > 3 and {i for r in held if r["key"] is None for i in r["ids"]} == set(range(90, 100))


def test_names_are_read_before_they_meet(spark):
    registry = spark.range(300).select(F.col("id").alias("entity"), F.lit("Doe Homes").alias("name"), F.lit("Lacey").alias("city"), F.lit(None).cast("string").alias("status"), F.array(F.struct(F.lit("Doe, Jo").alias("name"), F.lit("DOE, JO Q").alias("key"))).alias("principals"))
    candidates = spark.range(400).select(F.col("id").alias("candidate"), F.lit("Jo Doe").alias("person_name"), F.lit(7).cast("long").alias("bound_entity"), F.array(F.lit("LACEY, WA")).alias("jurisdictions"), F.lit("owner").alias("role"))
    found = reg.matched_people(candidates, registry)
    plan = plan_of(found)
    assert "regexp" not in plan and plan.index("Generate") < plan.index("Repartition") < plan.index("Join")
    assert found.count() == 300 * 400 == found.select("candidate", "entity").distinct().count()
    assert found.filter("already_bound").count() == 400 == found.filter("entity = 7 and already_bound").count()
    assert {tuple(r) for r in found.select("middle_initial", "unique_name", "surname_echo", "city", "role", "points", "verdict").distinct().collect()} == {(None, True, True, True, None, 3, "strong")}


def test_phones_of_many_firms_differ(spark):
    """Beyond 60,000 customers a number of four digits was cut, and different firms agreed."""
    few = SimpleNamespace(customer=spark.createDataFrame([(66_000, 1, "X"), (66_006, 1, "X"), (66_007, 1, "X")], "c_custkey long, c_nationkey int, c_mktsegment string"))
    a, b, c = (r["phone"] for r in links.firms(few).orderBy("entity").collect())
    assert a != b and b == c


def test_the_league_reads_its_lines_once(spark):
    """Distinct counts would send each line four times, and the league asks for its firms twice: they are written once."""
    rows = views._league(Tables(spark, SMALL))
    assert "l_orderkey" not in plan_of(rows)
    few = SimpleNamespace(spark=spark, supplier=spark.createDataFrame([(1, 5)], "s_suppkey long, s_nationkey int"), lineitem=spark.createDataFrame(
        [(7, 1, "R", 5.0, "2001-06-01"), (7, 1, "A", 9.0, "2001-01-01"), (8, 1, None, 2.0, None), (None, 1, "R", 1.0, "2001-07-01")], "l_orderkey long, l_suppkey long, l_returnflag string, l_extendedprice double, d string",
    ).withColumn("l_shipdate", F.col("d").cast("timestamp_ntz")))
    (row,) = views._league(few).collect()
    assert (row["projects"], row["recent"], row["relevant"], row["value_max"], str(row["latest"])) == (2, 1, 1, 9.0, "2001-07-01 00:00:00")
