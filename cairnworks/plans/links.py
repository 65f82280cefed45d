"""Developments, families of firms, people behind firms and address ladders over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.operators import developments as dev
from cairnworks.operators import registry as reg
from cairnworks.plans.registry import Tables, query

_KM = "2 * 6371000 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))"


def _letters(number):
    """Digits as letters, for names that hold letters only."""
    return F.translate(number.cast("string"), "0123456789", "ABCDEFGHIJ")


def _sql_letters(number: str) -> str:
    return f"translate(({number})::VARCHAR, '0123456789', 'ABCDEFGHIJ')"


def customer_projects(t: Tables) -> DataFrame:
    """A project for each customer: named after a ridge of its segment and balance, with a phase for some."""
    c = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    k, kind = F.col("c_custkey"), F.col("c_custkey") % 5
    base = F.concat(F.replace("c_mktsegment", F.lit("BUILDING"), F.lit("TIMBER")), F.lit(" Ridge "), F.floor(F.col("c_acctbal") / 5000).cast("string"))
    name = F.when(kind == 0, base).when(kind == 1, F.concat(F.lit("Plat of "), base)).when(kind == 2, F.concat(F.lit("X-1 – "), base, F.lit(", Phase #"), (k % 9).cast("string"))).when(kind == 3, F.concat(base, F.lit(" Lot 7"))).otherwise("Tenant Improvement")
    return c.select(
        k.alias("project"), name.alias("name"), F.col("r_name").alias("county"), F.when(k % 3 == 0, F.array(F.concat(F.lit("P"), (k % 401).cast("string")))).alias("parcels"), F.when(k % 4 == 0, F.array((k % 53).cast("string"))).alias("org_ids"),
        F.when(k % 7 > 0, F.lit(-122.0) + (k * 37 % 40) * 0.002).alias("lon"), F.when(k % 7 > 0, F.lit(47.0) + (k * 91 % 25) * 0.002).alias("lat"), k.alias("first_seen"), (k + 5).alias("last_seen"),
        F.when(k % 31 == 0, F.concat(F.lit("D"), k.cast("string"))).alias("development"), F.when(k % 37 == 0, F.lit(-1)).cast("long").alias("parent"),
    )


@query(f"""WITH p AS (SELECT c_custkey AS project, r_name AS county, replace(c_mktsegment, 'BUILDING', 'TIMBER') || ' RIDGE ' || floor(c_acctbal / 5000)::BIGINT AS raw, c_custkey % 5 AS kind, CASE WHEN c_custkey % 3 = 0 THEN 'P' || c_custkey % 401 END AS parcel, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 53 END AS org,
CASE WHEN c_custkey % 7 > 0 THEN -122.0 + (c_custkey * 37 % 40) * 0.002 END::DOUBLE AS lon, CASE WHEN c_custkey % 7 > 0 THEN 47.0 + (c_custkey * 91 % 25) * 0.002 END::DOUBLE AS lat, CASE WHEN c_custkey % 31 = 0 THEN 'D' || c_custkey END AS had, CASE WHEN c_custkey % 37 = 0 THEN -1 END AS own_parent
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey), m AS (SELECT *, replace(raw, '-', ' ') AS b0 FROM p WHERE kind < 4), n AS (SELECT *, trim(regexp_replace(b0, ' +', ' ', 'g')) AS base, kind <= 1 AS is_base FROM m),
g AS (SELECT county, base, count(*) AS members, min(had) AS had, min(project) AS first_seen, max(project) + 5 AS last_seen, count(*) FILTER (is_base) AS n_base, max(project) FILTER (is_base) AS top FROM n GROUP BY 1, 2 HAVING count(*) > 1),
s AS (SELECT DISTINCT a.county, a.base FROM n a JOIN n b ON a.county = b.county AND a.base = b.base AND a.project < b.project WHERE a.org = b.org OR a.parcel = b.parcel OR {_KM} <= 1000)
SELECT project, coalesce(n.had, g.had, county || '::' || base) AS development, g.had IS NULL AS is_new, members, first_seen, last_seen, coalesce(own_parent, CASE WHEN kind >= 2 AND n_base = 1 THEN top END) AS parent FROM n JOIN g USING (county, base) JOIN s USING (county, base)""")
def developments(t: Tables) -> DataFrame:
    return dev.developments(customer_projects(t))


def firms(t: Tables) -> DataFrame:
    """A registry row for each customer; persons are shared by three neighbours, and by the next three where one of them files for both."""
    k = F.col("c_custkey")
    person = lambda n: F.struct(F.concat(F.lit("f"), _letters(n), F.lit(", Ann")).alias("name"), F.concat(F.lit("F"), _letters(n), F.lit(", ANN")).alias("key"))
    group = F.floor(k / 3)
    agent = F.struct(F.lit("Ct Corporation System").alias("name"), F.lit("CT CORPORATION SYSTEM").alias("key"))
    none = F.lit(None).cast("string")
    return t.customer.select(
        k.alias("entity"), F.when(k % 11 == 0, "merged").when(k % 2 == 0, "active").alias("status"), F.array_compact(F.array(person(group), F.when((k % 4 == 0) | (k % 5 == 0), person(group + 1)), F.when(k % 7 == 0, agent))).alias("principals"),
        F.when(F.col("c_nationkey") % 2 == 0, "WA").otherwise("OR").alias("state"), F.concat(F.lit("(206) 555-"), F.lpad(F.floor(k / 6).cast("string"), 12, "0")).alias("phone"), none.alias("google_phone"), none.alias("address"), none.alias("postcode"),
        F.col("c_mktsegment").alias("city"), F.concat(F.lit("d"), F.floor(k / 9).cast("string"), F.lit(".com")).alias("domain"), none.alias("ubi"), F.array(F.concat(F.lit("T"), (F.col("c_nationkey") % 4).cast("string"))).alias("trade_codes"),
    )


_FAMILIES = f"""f AS (SELECT c_custkey AS entity, c_mktsegment AS city, c_nationkey % 4 AS trade, c_custkey // 6 AS phone, c_custkey // 9 AS domain FROM customer WHERE c_custkey % 11 <> 0),
k AS (SELECT entity, entity // 3 AS person FROM f UNION ALL SELECT entity, entity // 3 + 1 FROM f WHERE entity % 4 = 0 OR entity % 5 = 0),
e AS (SELECT DISTINCT a.entity AS a, b.entity AS b FROM k a JOIN k b USING (person) WHERE a.entity <> b.entity),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT node AS entity, min(seen) AS component FROM r GROUP BY 1),
s AS (SELECT component, count(*) AS size FROM c GROUP BY 1),
n AS (SELECT component, min('F' || {_sql_letters('person')} || ', ANN') AS family FROM c JOIN k USING (entity) GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_FAMILIES}, w AS (SELECT x.component, min((a.phone = b.phone)::INT + (a.city = b.city)::INT + (a.domain = b.domain)::INT + (a.trade = b.trade)::INT) AS min_points
FROM c x JOIN c y ON x.component = y.component AND x.entity < y.entity JOIN f a ON a.entity = x.entity JOIN f b ON b.entity = y.entity GROUP BY 1)
SELECT family, entity, size, min_points FROM c JOIN s USING (component) JOIN n USING (component) JOIN w USING (component)""")
def corporate_families(t: Tables) -> DataFrame:
    return reg.families(firms(t))[0]


@query(f"WITH RECURSIVE {_FAMILIES} SELECT family, size FROM s JOIN n USING (component) WHERE size > 25")
def families_dropped(t: Tables) -> DataFrame:
    return reg.families(firms(t), reg.MAX_FAMILY)[1]


@query(f"""WITH RECURSIVE {_FAMILIES}, b AS (SELECT s_suppkey AS org, s_suppkey * 13 % (SELECT count(*) FROM customer) AS entity FROM supplier), w AS (SELECT DISTINCT l_suppkey AS org, l_orderkey AS project FROM lineitem),
m AS (SELECT family, entity, org FROM c JOIN s USING (component) JOIN n USING (component) LEFT JOIN b USING (entity) WHERE size <= 25)
SELECT family, count(DISTINCT m.entity) AS entities, count(DISTINCT CASE WHEN m.org IS NOT NULL THEN m.entity END) AS bound_entities, count(DISTINCT m.org) AS orgs, count(DISTINCT w.project) AS projects FROM m LEFT JOIN w USING (org) GROUP BY 1""")
def family_rollup(t: Tables) -> DataFrame:
    n = t.customer.agg(F.count("*").alias("n"))  # one row
    bound = t.supplier.crossJoin(F.broadcast(n)).select(F.col("s_suppkey").alias("org"), (F.col("s_suppkey") * 13 % F.col("n")).alias("entity"))
    return reg.family_rollup(reg.families(firms(t), reg.MAX_FAMILY)[0], bound, t.lineitem.select(F.col("l_suppkey").alias("org"), F.col("l_orderkey").alias("project")))


@query(f"""WITH r AS (SELECT s_suppkey AS entity, 'S' || {_sql_letters('s_suppkey % 40')} AS sur, 'G' || {_sql_letters('s_suppkey % 3')} AS given, CASE s_suppkey % 4 WHEN 1 THEN 'Q' WHEN 2 THEN 'R' END AS mid, 'TOWN' || s_nationkey AS city, CASE WHEN s_suppkey % 6 = 0 THEN 'S' || {_sql_letters('s_suppkey % 40')} || ' Homes' ELSE 'Acme' END AS name FROM supplier WHERE s_suppkey % 9 <> 0),
i AS (SELECT sur, given, count(DISTINCT coalesce(mid, '')) AS namesakes FROM r GROUP BY 1, 2),
c AS (SELECT c_custkey AS candidate, 'S' || {_sql_letters('c_custkey % 60')} AS sur, 'G' || {_sql_letters('c_custkey % 3')} AS given, CASE WHEN c_custkey % 5 < 3 THEN 'R' END AS mid, 'Olympia, town' || c_nationkey AS place, c_custkey % 2 = 0 AS contractor, c_custkey % 100 AS bound FROM customer WHERE c_custkey % 3 < 2),
m AS (SELECT candidate, entity, namesakes, bound = entity AS already_bound, c.mid = r.mid AS middle_initial, CASE WHEN namesakes = 1 THEN true WHEN namesakes >= 3 THEN false END AS unique_name, CASE WHEN contains(upper(name), c.sur) THEN true END AS surname_echo, CASE WHEN contains(upper(place), upper(city)) THEN true END AS city, CASE WHEN contractor THEN true END AS role, sur || '|' || given AS core
FROM c JOIN r USING (sur, given) JOIN i USING (sur, given)),
p AS (SELECT *, coalesce(middle_initial::INT, 0) + coalesce(unique_name::INT, 0) + coalesce(surname_echo::INT, 0) + coalesce(city::INT, 0) + coalesce(role::INT, 0) AS points FROM m)
SELECT *, CASE WHEN middle_initial = false THEN 'contradicted' WHEN points = 0 THEN 'name_only' WHEN points >= 3 THEN 'strong' ELSE 'corroborated' END AS verdict FROM p""")
def person_matches(t: Tables) -> DataFrame:
    """Customers' names in both orders against the persons behind suppliers."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    surname, given = F.concat(F.lit("S"), _letters(s % 40)), F.concat(F.lit("G"), _letters(s % 3))
    middle = F.when(s % 4 == 1, " Q").when(s % 4 == 2, " R").otherwise("")
    person = F.struct(F.concat(surname, F.lit(", "), given).alias("name"), F.concat(surname, F.lit(", "), given, middle).alias("key"))
    registry = t.supplier.select(s.alias("entity"), F.when(s % 6 == 0, F.concat(surname, F.lit(" Homes"))).otherwise("Acme").alias("name"), F.concat(F.lit("Town"), F.col("s_nationkey")).alias("city"), F.when(s % 9 == 0, "closed").alias("status"), F.array(person).alias("principals"))
    sur, giv, mid = F.concat(F.lit("s"), _letters(c % 60)), F.concat(F.lit("g"), _letters(c % 3)), F.when(c % 5 < 3, F.lit(" Ro")).otherwise("")
    name = F.when(c % 3 == 0, F.concat(sur, F.lit(", "), giv, mid, F.lit(" Jr."))).when(c % 3 == 1, F.concat(giv, mid, F.lit(" "), sur)).otherwise(F.concat(giv, F.lit(" "), sur, F.lit(" LLC")))
    candidates = t.customer.select(c.alias("candidate"), name.alias("person_name"), (c % 100).alias("bound_entity"), F.array(F.lit("Lacey"), F.concat(F.lit("Olympia, town"), F.col("c_nationkey"))).alias("jurisdictions"), F.when(c % 2 == 0, "primary_contractor").otherwise("owner").alias("role"))
    return reg.matched_people(candidates, registry)


@query("""WITH o AS (SELECT s_suppkey AS owner, (s_suppkey % 80) || ' MAIN ST ' || (98000 + s_suppkey % 80 % 3) AS k FROM supplier), u AS (SELECT k, min(owner) AS owner FROM o GROUP BY 1 HAVING min(owner) = max(owner)),
w AS (SELECT c_custkey AS key, (c_custkey % 120) || ' MAIN ST' AS street, ' ' || (98000 + c_custkey % 120 % 3) AS zip, c_custkey % 5 AS kind FROM customer),
l AS (SELECT key, 0 AS rank, street || CASE kind WHEN 0 THEN '' WHEN 1 THEN ' OLYMPIA' WHEN 2 THEN ' E BAY' WHEN 3 THEN ' 210' ELSE ' OLYMPIA' END || zip AS k FROM w WHERE kind <> 4 UNION ALL SELECT key, 1, street || zip FROM w WHERE kind IN (1, 3) UNION ALL SELECT key, 1, street || ' E' || zip FROM w WHERE kind = 2 UNION ALL SELECT key, 2, street || zip FROM w WHERE kind = 2
UNION ALL SELECT key, 0, street || zip FROM w WHERE kind = 4)
SELECT key, arg_min(owner, rank) AS owner, min(rank)::INT AS rank, arg_min(k, rank) AS address_key FROM l JOIN u USING (k) GROUP BY 1""")
def address_bindings(t: Tables) -> DataFrame:
    """Customers' addresses, some with a city or a unit number run into the street, against those of suppliers."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    owners = t.supplier.select(s.alias("owner"), F.concat((s % 80).cast("string"), F.lit(" Main Street, Suite 4")).alias("address"), (F.lit(98000) + s % 80 % 3).cast("string").alias("zip"))
    tail = F.when(c % 5 == 1, " Olympia").when(c % 5 == 2, " East Bay").when(c % 5 == 3, " #210").when(c % 5 == 4, " Unit 7, Olympia").otherwise(" Suite 9")
    wanted = t.customer.select(c.alias("key"), F.concat((c % 120).cast("string"), F.lit(" Main Street"), tail).alias("address"), (F.lit(98000) + c % 120 % 3).cast("string").alias("zip"))
    return reg.bound_by_address(wanted, owners)
