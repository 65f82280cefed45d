"""Developments: projects of one county and base name that something else ties together, with the parent of their phases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.functions import names, scalars
from cairnworks.operators import relational as ops

#: Fixed value: members this near to each other support a group, in metres.
NEAR_M = 1000
#: Cells of this height and at most this width: two points of one are nearer than NEAR_M.
CELL_M = 700
METRES_A_DEGREE = 111_194.0


def _cell(lon, lat):
    band = F.floor(lat * METRES_A_DEGREE / CELL_M)
    # Widest where the band lies nearest to the equator, so that no cell is wider than CELL_M there.
    nearest = F.least(F.abs(band), F.abs(band + 1)) * CELL_M / METRES_A_DEGREE
    return F.struct(band.alias("band"), F.floor(lon * METRES_A_DEGREE * F.cos(F.radians(nearest)) / CELL_M).alias("column"))


def supported_groups(members: DataFrame) -> DataFrame:
    """(county, base) of the groups with two members that share an organisation or a parcel, or lie within NEAR_M.

    No pairs are made but of neighbours: a value that two members hold, or a cell that two share, supports its group by a count; where
    neither is so, a cell holds one member, and a member has as many neighbours as cells lie around it.
    """
    key = ["county", "base"]
    held = F.concat(F.transform("org_ids", lambda o: F.struct(F.lit("org").alias("kind"), o.cast("string").alias("value"))), F.transform("parcels", lambda p: F.struct(F.lit("parcel").alias("kind"), p.alias("value"))))
    values = members.select(*key, "project", F.explode(F.array_distinct(held)).alias("v")).filter("v.value is not null")
    points = members.filter("lon is not null and lat is not null")
    cells = points.select(*key, "project", F.struct(F.lit("cell").alias("kind"), F.to_json(_cell(F.col("lon"), F.col("lat"))).alias("value")).alias("v"))
    common = values.union(cells).groupBy(*key, "v").agg(F.count("*").alias("n")).filter("n > 1").select(*key).distinct()
    common = ops.written(common, "developments-common")
    same = lambda a, b: F.col(f"{a}.county").eqNullSafe(F.col(f"{b}.county")) & (F.col(f"{a}.base") == F.col(f"{b}.base"))
    open_ = points.alias("m").join(common.alias("c"), same("m", "c"), "left_anti").withColumn("group", F.struct(F.col("county").isNull().alias("none"), F.coalesce("county", F.lit("")).alias("county"), "base"))
    left = open_.select("group", F.col("project").alias("l_id"), F.col("lon").alias("l_lon"), F.col("lat").alias("l_lat"))
    right = open_.select("group", F.col("project").alias("r_id"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    near = ops.within_distance(left, right, NEAR_M, scalars.distance_m, ["group"]).filter("l_id < r_id").select("group").distinct()
    near = near.select(F.when(~F.col("group.none"), F.col("group.county")).alias("county"), F.col("group.base").alias("base"))
    return common.union(near).distinct()


def developments(projects: DataFrame) -> DataFrame:
    """(project, development, is_new, members, first_seen, last_seen, parent) of the projects that belong to one.

    projects(project, name, county, parcels, org_ids, lon, lat, first_seen, last_seen, development, parent). A group takes the least development
    that a member has already, else a new one 'county::base'; a member keeps its own. If just one member is the base (a plat, or without a
    phase), it becomes the parent of those with a phase that have none. Null lists hold nothing; a null county is a county.
    """
    none = F.array().cast("array<string>")
    rows = projects.withColumn("d", names.development_name(F.col("name"))).filter("d.base is not null").withColumn("base", F.col("d.base"))
    rows = rows.withColumns({"parcels": F.coalesce("parcels", none), "org_ids": F.coalesce(F.col("org_ids").cast("array<string>"), none)})
    rows = ops.written(rows, "developments-members")
    is_base = F.col("d.is_plat") | F.col("d.phase").isNull()
    groups = rows.groupBy("county", "base").agg(
        F.count("*").alias("members"), F.min("development").alias("had"), F.min("first_seen").alias("g_first"), F.max("last_seen").alias("g_last"),
        F.count_if(is_base).alias("n_base"), F.max(F.when(is_base, F.col("project"))).alias("base_member"),
    ).filter("members > 1")
    same = F.col("s.county").eqNullSafe(F.col("g.county")) & (F.col("s.base") == F.col("g.base"))
    groups = groups.alias("g").join(supported_groups(rows).alias("s"), same, "left_semi")
    found = rows.alias("s").join(groups.alias("g"), same)
    child = ~F.col("s.d.is_plat") & F.col("s.d.phase").isNotNull() & (F.col("g.n_base") == 1)
    return found.select(
        "s.project", F.coalesce("s.development", "g.had", F.concat(F.coalesce("s.county", F.lit("null")), F.lit("::"), "s.base")).alias("development"), F.col("g.had").isNull().alias("is_new"), "g.members",
        F.col("g.g_first").alias("first_seen"), F.col("g.g_last").alias("last_seen"), F.coalesce("s.parent", F.when(child, F.col("g.base_member"))).alias("parent"),
    )
