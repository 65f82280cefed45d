"""Velocity, campuses, corroboration and linked evidence over the driver tables: customers stand for projects, orders for their events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.operators import derivations as der
from cairnworks.plans.registry import Tables, query

NOW = "2001-08-02 00:00:00"


def _projects(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    where = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return where.select(
        c.alias("project"), F.when(c % 3 > 0, F.floor(c / 12)).alias("development"), F.when(c % 25 == 0, c + 1).alias("parent"), (c % 100).alias("first_seen"), F.concat(F.lit("K"), F.col("n_regionkey")).alias("county"),
        F.when(c % 10 > 0, F.array(F.concat(F.lit("55-0"), (F.floor(c / 90) % 10).cast("string"), F.lit("0-"), c.cast("string")))).alias("parcels"), F.lit("stale").alias("campus_block"),
    )


def _events(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    kind = F.when(o % 4 == 0, "permit_applied").when(o % 4 == 1, "permit_issued").when(o % 4 == 2, "application_submitted").otherwise("notice_published")
    return t.orders.select(F.col("o_custkey").alias("project"), o.alias("record"), kind.alias("event"), F.when(o % 5 > 0, F.col("o_orderdate")).alias("event_date"), F.col("o_orderdate").alias("observed_at"))


@query("""WITH p AS (SELECT c_custkey AS project, c_custkey // 12 AS development, CASE WHEN c_custkey % 25 = 0 THEN c_custkey + 1 END AS parent, c_custkey % 100 AS first_seen FROM customer WHERE c_custkey % 3 > 0),
m AS (SELECT development, o_orderkey AS record, o_orderdate AS at_ FROM orders JOIN p ON p.project = o_custkey WHERE o_orderkey % 4 < 2 AND o_orderdate >= TIMESTAMP '2001-08-02' - INTERVAL 400 DAY),
c AS (SELECT development, count(*) AS permits, arg_max(record, (at_, record)) AS record, max(at_) AS at_ FROM m GROUP BY 1 HAVING count(*) >= 5), a AS (SELECT development, coalesce(min(parent), arg_min(project, (first_seen, project))) AS anchor FROM p GROUP BY 1)
SELECT development, anchor, record, permits, at_::TIMESTAMP AS last_at FROM c JOIN a USING (development) WHERE NOT (record % 2 = 0 AND anchor % 2 = 0)""")
def development_velocity(t: Tables) -> DataFrame:
    projects, events = _projects(t), _events(t)
    every = der.cluster_velocity(projects, events, t.spark.createDataFrame([], "anchor long, record long"), NOW, days=400)
    told = every.filter("record % 2 = 0 and anchor % 2 = 0").select("anchor", "record")
    return der.cluster_velocity(projects, events, told, NOW, days=400).select("development", "anchor", "record", "permits", F.col("at").cast("timestamp_ntz").alias("last_at"))


_CAMPUS = """p AS (SELECT c_custkey AS project, c_custkey % 100 AS first_seen, 'K' || n_regionkey AS county, '550' || (c_custkey // 90 % 10) || '0' || c_custkey AS plain FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 = 0 AND c_custkey % 10 > 0),
b AS (SELECT *, substr(plain, 1, CASE WHEN county = 'K1' THEN 4 ELSE 5 END) AS block FROM p WHERE length(plain) >= CASE WHEN county = 'K1' THEN 4 ELSE 5 END),
m AS (SELECT b.*, o_orderkey AS record, o_orderdate AS at_ FROM orders JOIN b ON b.project = o_custkey WHERE o_orderkey % 4 < 3 AND o_orderdate >= TIMESTAMP '2001-08-02' - INTERVAL 900 DAY),
c AS (SELECT county, block, count(DISTINCT project) AS projects, arg_min(project, (first_seen, project)) AS anchor, arg_max(record, (at_, record)) AS record FROM m GROUP BY 1, 2 HAVING count(DISTINCT project) >= 5)"""
_BOUNDS = {"days": 900, "prefixes": {"K1": 4}, "otherwise": 5}


@query(f"WITH {_CAMPUS} SELECT * FROM c")
def campus_blocks(t: Tables) -> DataFrame:
    return der.campuses(_projects(t), _events(t), NOW, **_BOUNDS).drop("at")


@query(f"WITH {_CAMPUS} SELECT c_custkey AS project, max(m.county || ':' || m.block) AS campus_block FROM customer LEFT JOIN (SELECT m.* FROM m JOIN c ON c.county = m.county AND c.block = m.block) m ON m.project = c_custkey GROUP BY 1")
def campus_stamps(t: Tables) -> DataFrame:
    return der.stamped(_projects(t), _events(t), NOW, **_BOUNDS).select("project", "campus_block")


@query("""WITH r AS (SELECT o_custkey AS project, l_suppkey % 3 AS source, l_quantity AS quantity, l_tax AS tax, CASE WHEN l_linenumber = 1 THEN l_extendedprice END AS price FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate >= TIMESTAMP '2001-06-01'),
n AS (SELECT project, f, min(x) AS least, max(x) AS most, count(DISTINCT x) AS k FROM (SELECT project, 'quantity' AS f, quantity AS x FROM r UNION ALL SELECT project, 'tax', tax FROM r UNION ALL SELECT project, 'price', price FROM r) WHERE x IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT x) > 1 AND max(x) > min(x) * 1.25),
s AS (SELECT o_custkey AS project, count(DISTINCT o_orderstatus) AS depth FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
SELECT r.project, count(DISTINCT source) AS source_count, coalesce(max(depth), 0) AS stage_depth, coalesce((SELECT string_agg(f || ' ' || k, ';' ORDER BY f) FROM n WHERE n.project = r.project), '') AS contradictions FROM r LEFT JOIN s ON s.project = r.project GROUP BY r.project""")
def project_corroboration(t: Tables) -> DataFrame:
    li = t.lineitem.filter("l_shipdate >= timestamp_ntz'2001-06-01'").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    records = li.select(F.col("o_custkey").alias("project"), F.col("l_orderkey").alias("record"), (F.col("l_suppkey") % 3).alias("source"), F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"), F.when(F.col("l_linenumber") == 1, F.col("l_extendedprice")).alias("price"))
    events = t.orders.select(F.col("o_custkey").alias("project"), F.col("o_orderstatus").alias("stage"), (F.col("o_orderkey") % 2 == 0).alias("confirmed"))
    made = der.corroboration(records, events, ["quantity", "tax", "price"])
    return made.withColumn("contradictions", F.array_join(F.transform("contradictions", lambda c: F.concat_ws(" ", c["field"], c["n_values"].cast("string"))), ";"))


_PATHS = ("title", "statusRaw", "issueDate", "parcelIds", "organizations", "valuationUsd", "links.detail")
_PATH_SQL = "CASE l_linenumber % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_PATHS)) + " END"
_LINKS = f"""e AS (SELECT DISTINCT o_custkey AS opportunity, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey AS evidence, {_PATH_SQL} AS path, CASE l_suppkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN ' a' WHEN 2 THEN 'B' WHEN 3 THEN 'C' WHEN 4 THEN 'D' ELSE 'x' END AS grade FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
g AS (SELECT *, upper(trim(grade)) AS u, CASE path WHEN 'title' THEN 1 WHEN 'statusRaw' THEN 2 WHEN 'issueDate' THEN 3 WHEN 'parcelIds' THEN 4 WHEN 'organizations' THEN 5 WHEN 'valuationUsd' THEN 6 ELSE 7 END AS pri FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY opportunity ORDER BY u, pri, evidence) AS place FROM g WHERE u IN ('A', 'B', 'C'))"""


def _evidence(t: Tables):
    li = t.lineitem
    path = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("l_linenumber") % 7 + 1).cast("int"))
    grade = F.element_at(F.array(*map(F.lit, ("A", " a", "B", "C", "D", "x"))), (F.col("l_suppkey") % 6 + 1).cast("int"))
    evidence = li.select((((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).alias("evidence"), F.col("l_orderkey").alias("record"), path.alias("fact_path"), grade.alias("grade"))
    supporting = t.orders.select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("record"))
    opportunities = t.customer.select(F.col("c_custkey").alias("opportunity"), F.col("c_custkey").alias("project"))
    linked = evidence.filter("evidence % 3 = 0").join(supporting, "record").select(F.col("project").alias("opportunity"), "evidence")
    return der.linked_evidence(opportunities, supporting, evidence, linked, 15)


@query(f"WITH {_LINKS} SELECT opportunity, evidence, CASE pri WHEN 1 THEN 'identity' WHEN 2 THEN 'stage' WHEN 3 THEN 'event_date' WHEN 4 THEN 'geography' WHEN 5 THEN 'organization_role' WHEN 6 THEN 'value' ELSE 'other' END AS claim, u = 'A' AS confirmed, CASE u WHEN 'A' THEN 0.95 WHEN 'B' THEN 0.75 ELSE 0.5 END::DOUBLE AS confidence FROM k WHERE place <= 15 AND evidence % 3 > 0")
def linked_evidence(t: Tables) -> DataFrame:
    return _evidence(t)[0].select("opportunity", "evidence", "claim", "confirmed", "confidence")


@query(f"WITH {_LINKS} SELECT CASE WHEN u = 'D' THEN 'discovery_only_grade' WHEN u = 'X' THEN 'unknown_grade' WHEN place > 15 THEN 'capped_out' WHEN evidence % 3 = 0 THEN 'already_linked' ELSE 'written' END AS reason, count(*) AS n FROM (SELECT opportunity, evidence, u, place FROM k UNION ALL SELECT opportunity, evidence, u, NULL FROM g WHERE u NOT IN ('A', 'B', 'C')) GROUP BY 1")
def evidence_audit(t: Tables) -> DataFrame:
    return _evidence(t)[1]
