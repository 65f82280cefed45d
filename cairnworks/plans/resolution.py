"""Entity resolution, graph upkeep, routing and scoring over the driver tables, and queries that show single functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.functions import names, scalars
from cairnworks.operators import relational as ops
from cairnworks.plans.registry import ORDERS_AS_OF, Tables, query


def pass_ladder(records: DataFrame, passes: list[tuple[str, DataFrame, float]], key: str = "record") -> DataFrame:
    """The first pass that finds exactly one project for a record decides it; several projects go to review.

    records(record, ...); each pass is (rule, candidates(record, project), score). One join a pass, each on a
    grouped candidate table, so no pass sees a record twice.
    """
    decided = records.select(key)
    hits = []
    for rule, candidates, score in passes:
        found = candidates.groupBy(key).agg(F.count_distinct("project").alias("_n"), F.min("project").alias("_project"))
        n = f"_{rule}"
        decided = decided.join(found.select(key, F.struct("_n", "_project").alias(n)), key, "left")
        merge = F.struct(F.lit(rule).alias("rule"), F.lit("merge").alias("decision"), F.col(n)["_project"].alias("project"), F.lit(score).alias("score"))
        review = F.struct(F.lit(rule).alias("rule"), F.lit("review").alias("decision"), F.lit(None).cast("long").alias("project"), F.lit(0.5).alias("score"))
        hits.append(F.when(F.col(n)["_n"] == 1, merge).when(F.col(n)["_n"] > 1, review))
    none = F.struct(F.lit("none").alias("rule"), F.lit("create").alias("decision"), F.lit(None).cast("long").alias("project"), F.lit(1.0).alias("score"))
    return decided.select(key, F.coalesce(*hits, none).alias("_hit")).select(key, "_hit.*")


@query("""WITH c1 AS (SELECT o_orderkey AS record, o_custkey AS project FROM orders WHERE o_orderkey % 5 = 0),
c2 AS (SELECT l_orderkey AS record, l_suppkey AS project FROM lineitem WHERE l_orderkey % 3 = 0 AND l_returnflag = 'R'),
g1 AS (SELECT record, count(DISTINCT project) AS n, min(project) AS p FROM c1 GROUP BY 1), g2 AS (SELECT record, count(DISTINCT project) AS n, min(project) AS p FROM c2 GROUP BY 1)
SELECT o_orderkey AS record, CASE WHEN g1.n >= 1 THEN 'official_id' WHEN g2.n >= 1 THEN 'reference' ELSE 'none' END AS rule,
CASE WHEN g1.n = 1 OR (g1.n IS NULL AND g2.n = 1) THEN 'merge' WHEN g1.n > 1 OR g2.n > 1 THEN 'review' ELSE 'create' END AS decision,
CASE WHEN g1.n = 1 THEN g1.p WHEN g1.n IS NULL AND g2.n = 1 THEN g2.p END AS project,
CASE WHEN g1.n = 1 THEN 1.0 WHEN g1.n > 1 THEN 0.5 WHEN g2.n = 1 THEN 0.95 WHEN g2.n > 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS score
FROM orders LEFT JOIN g1 ON g1.record = o_orderkey LEFT JOIN g2 ON g2.record = o_orderkey""")
def resolution_ladder(t: Tables) -> DataFrame:
    records = t.orders.select(F.col("o_orderkey").alias("record"))
    official = t.orders.filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("record"), F.col("o_custkey").alias("project"))
    reference = t.lineitem.filter("l_orderkey % 3 = 0 and l_returnflag = 'R'").select(F.col("l_orderkey").alias("record"), F.col("l_suppkey").alias("project"))
    return pass_ladder(records, [("official_id", official, 1.0), ("reference", reference, 0.95)])


@query("""SELECT o_custkey AS project, max(o_orderdate)::DATE AS last_seen, min(o_orderdate)::DATE AS first_seen, CASE max(CASE o_orderstatus WHEN 'O' THEN 5 WHEN 'P' THEN 8 WHEN 'F' THEN 10 END) WHEN 5 THEN 'permit_applied' WHEN 8 THEN 'construction' ELSE 'complete' END AS stage, (arg_min(o_orderpriority, o_orderkey)) AS first_priority FROM orders GROUP BY 1""")
def merged_projects(t: Tables) -> DataFrame:
    stage = F.when(F.col("o_orderstatus") == "O", "permit_applied").when(F.col("o_orderstatus") == "P", "construction").otherwise("complete")
    o = t.orders.withColumn("stage", stage)
    return o.groupBy(F.col("o_custkey").alias("project")).agg(F.max("o_orderdate").cast("date").alias("last_seen"), F.min("o_orderdate").cast("date").alias("first_seen"), F.max_by("stage", scalars.stage_order(F.col("stage"))).alias("stage"), F.min_by("o_orderpriority", "o_orderkey").alias("first_priority"))


@query(f"""WITH e AS (SELECT o_custkey, o_orderkey, o_orderdate, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS anchor FROM orders)
SELECT o_custkey AS development, min(anchor) AS anchor, count(*) AS n FROM e WHERE o_orderdate >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 400 DAY GROUP BY 1 HAVING count(*) >= 3""")
def cluster_velocity(t: Tables) -> DataFrame:
    anchors = ops.pick(t.orders, ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), [F.col("o_orderkey").alias("anchor")], latest=False)
    recent = t.orders.filter(f"o_orderdate >= timestamp_ntz'{ORDERS_AS_OF}' - INTERVAL 400 DAY").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n >= 3")
    return recent.join(anchors, "o_custkey").select(F.col("o_custkey").alias("development"), "anchor", "n")


@query(f"""SELECT substr(lpad(l_partkey::VARCHAR, 8, '0'), 1, 7) AS campus, count(DISTINCT l_orderkey) AS projects FROM lineitem WHERE l_shipdate >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 90 DAY GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 5""")
def campus_velocity(t: Tables) -> DataFrame:
    recent = t.lineitem.filter(f"l_shipdate >= timestamp_ntz'{ORDERS_AS_OF}' - INTERVAL 90 DAY")
    campus = F.substring(F.lpad(F.col("l_partkey").cast("string"), 8, "0"), 1, 7)
    return recent.groupBy(campus.alias("campus")).agg(F.count_distinct("l_orderkey").alias("projects")).filter("projects >= 5")


@query("""SELECT l_orderkey AS project, count(DISTINCT l_suppkey) AS sources, max(CASE l_linestatus WHEN 'F' THEN 2 ELSE 1 END) AS depth FROM lineitem GROUP BY 1""")
def corroboration(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("project")).agg(F.count_distinct("l_suppkey").alias("sources"), F.max(F.when(F.col("l_linestatus") == "F", 2).otherwise(1)).alias("depth"))


@query("""WITH m AS (SELECT p_type AS type, CASE WHEN regexp_matches(p_type, '(?i)\\b(economy|standard)\\b') THEN 'basic' WHEN regexp_matches(p_type, '(?i)\\b(promo|large)\\b') THEN 'special' END AS code FROM part) SELECT type, count(*) AS untagged FROM m WHERE code IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def untagged_types(t: Tables) -> DataFrame:
    code = F.when(F.col("p_type").rlike(r"(?i)\b(economy|standard)\b"), "basic").when(F.col("p_type").rlike(r"(?i)\b(promo|large)\b"), "special")
    return t.part.filter(code.isNull()).groupBy(F.col("p_type").alias("type")).agg(F.count("*").alias("untagged")).orderBy(F.col("untagged").desc(), "type").limit(15)


@query("""WITH s AS (SELECT l_suppkey, 'returned' AS k, l_partkey AS v FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_suppkey, 'open', l_partkey FROM lineitem WHERE l_linestatus = 'O')
SELECT l_suppkey, count(*) AS footprint FROM (SELECT l_suppkey, v FROM s GROUP BY 1, 2 HAVING count(DISTINCT k) >= 2) GROUP BY 1""")
def identifier_footprint(t: Tables) -> DataFrame:
    li = t.lineitem
    seen = li.filter("l_returnflag = 'R'").select("l_suppkey", F.lit("returned").alias("k"), F.col("l_partkey").alias("v")).union(li.filter("l_linestatus = 'O'").select("l_suppkey", F.lit("open"), "l_partkey"))
    both = seen.groupBy("l_suppkey", "v").agg(F.min("k").alias("a"), F.max("k").alias("b")).filter("a <> b")
    return both.groupBy("l_suppkey").agg(F.count("*").alias("footprint"))


def cascade(wanted: DataFrame, rules: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Bind each wanted key by the first rule that has exactly one owner for it: rules are (name, matches(key, owner))."""
    left, out = wanted.select(key).distinct(), None
    for name, matches in rules:
        bound = left.join(ops.unique_owners(matches.select(key, "owner"), key, "owner"), key).withColumn("rule", F.lit(name))
        out = bound if out is None else out.union(bound)
        left = left.join(bound.select(key), key, "left_anti")
    return out.union(left.select(key, F.lit(None).cast("long").alias("owner"), F.lit("unbound").alias("rule")))


@query("""WITH w AS (SELECT p_partkey FROM part), a AS (SELECT l_partkey AS p_partkey, min(l_suppkey) AS owner FROM lineitem WHERE l_quantity >= 48 GROUP BY 1 HAVING min(l_suppkey) = max(l_suppkey)),
b AS (SELECT l_partkey AS p_partkey, min(l_suppkey) AS owner FROM lineitem WHERE l_quantity <= 2 GROUP BY 1 HAVING min(l_suppkey) = max(l_suppkey))
SELECT p_partkey, coalesce(a.owner, b.owner) AS owner, CASE WHEN a.owner IS NOT NULL THEN 'strong' WHEN b.owner IS NOT NULL THEN 'weak' ELSE 'unbound' END AS rule FROM w LEFT JOIN a USING (p_partkey) LEFT JOIN b USING (p_partkey)""")
def binding_cascade(t: Tables) -> DataFrame:
    of = lambda condition: t.lineitem.filter(condition).select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("owner"))
    return cascade(t.part, [("strong", of("l_quantity >= 48")), ("weak", of("l_quantity <= 2"))], "p_partkey")


@query(f"""WITH f AS (SELECT o_custkey, max(o_totalprice) AS value, count(*) AS n, date_diff('day', max(o_orderdate)::DATE, DATE '{ORDERS_AS_OF[:10]}') AS age FROM orders GROUP BY 1),
s AS (SELECT o_custkey, value, floor((0.5::DOUBLE * least(value / 500000, 1) + 0.3::DOUBLE * CASE WHEN age <= 60 THEN 1 WHEN age <= 180 THEN 0.6 ELSE 0.2 END::DOUBLE + 0.2::DOUBLE * least(n / 20.0::DOUBLE, 1)) * 100 * 10 + 0.5) / 10 AS score FROM f)
SELECT o_custkey, score, CASE WHEN score >= 75 THEN 'priority' WHEN score >= 55 THEN 'digest' ELSE 'archive' END AS band FROM s""")
def routed_scores(t: Tables) -> DataFrame:
    f = t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("value"), F.count("*").alias("n"), F.datediff(F.lit(ORDERS_AS_OF[:10]).cast("date"), F.max("o_orderdate")).alias("age"))
    parts = F.create_map(F.lit("size"), F.col("value") / 500000, F.lit("recency"), scalars.recency(F.col("age")), F.lit("history"), F.col("n") / 20.0)
    s = f.select("o_custkey", scalars.weighted(parts, {"size": 0.5, "recency": 0.3, "history": 0.2}).alias("score"))
    return s.select("o_custkey", "score", scalars.band(F.col("score"), 75, 55).alias("band"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'excluded' WHEN o_orderstatus = 'F' AND o_totalprice > 400000 THEN 'likely_too_large' WHEN o_totalprice < 50000 THEN 'possible_stretch' ELSE 'likely_fit' END AS fit,
CASE WHEN o_orderpriority = '5-LOW' THEN 0.0 WHEN o_orderstatus = 'F' AND o_totalprice > 400000 THEN 0.4 WHEN o_totalprice < 50000 THEN 0.6 ELSE 1.0 END::DOUBLE AS factor FROM orders""")
def capacity_fits(t: Tables) -> DataFrame:
    """Only accounts of finished orders have set a largest value."""
    most = F.when(F.col("o_orderstatus") == "F", 400000.0)
    fit = scalars.capacity_fit(F.col("o_totalprice"), F.lit(50000.0), most, F.col("o_orderpriority") == "5-LOW")
    return t.orders.select("o_orderkey", fit.alias("c")).select("o_orderkey", "c.*")


@query("""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS issued, CASE o_orderkey % 5 WHEN 0 THEN 'permit_issued' WHEN 1 THEN 'construction' WHEN 2 THEN 'bidding_confirmed' WHEN 3 THEN 'approved' ELSE 'complete' END AS stage, o_orderpriority IN ('1-URGENT', '2-HIGH') AS commercial FROM orders WHERE o_orderdate >= TIMESTAMP '2001-05-01'),
w AS (SELECT *, (DATE '2001-08-02' - issued) // 7 AS weeks, NOT commercial AND stage IN ('permit_issued', 'construction') AS dated FROM o)
SELECT o_orderkey, CASE WHEN stage = 'bidding_confirmed' THEN 'confirmed_open' WHEN commercial AND stage = 'approved' THEN 'open' WHEN commercial OR stage = 'complete' THEN 'likely_closed' WHEN NOT dated THEN 'watch' WHEN weeks < 4 THEN 'opens_soon' WHEN weeks <= 10 THEN 'open' ELSE 'likely_closed' END AS status,
CASE WHEN dated THEN issued + 28 END AS opens_on, CASE WHEN dated THEN issued + 56 END AS closes_on FROM w""")
def bid_windows(t: Tables) -> DataFrame:
    o = t.orders.filter("o_orderdate >= timestamp_ntz'2001-05-01'")
    stage = F.element_at(F.array(*map(F.lit, ("permit_issued", "construction", "bidding_confirmed", "approved", "complete"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    track = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "commercial").otherwise("residential")
    w = scalars.bid_window(stage, track, F.col("o_orderdate").cast("date"), F.lit("2001-08-02").cast("date"), 4, 8, 10)
    return o.select("o_orderkey", w.alias("w")).select("o_orderkey", "w.*")


@query("""SELECT l_orderkey, floor(sum(l_quantity * l_extendedprice) * 100 + 0.5) / 100 AS subtotal, count(*) AS lines FROM lineitem GROUP BY 1""")
def sheet_totals(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(scalars.round_half_up(F.sum(F.col("l_quantity") * F.col("l_extendedprice")), 2).alias("subtotal"), F.count("*").alias("lines"))


_LEGAL = "['LLC','L.L.C','INC','INCORPORATED','CORP','CORPORATION','CO','COMPANY','LP','LLP','PLLC','PC','PS','LTD','THE','OF','AND','&']"


def _tokens(c: str) -> str:
    return f"list_distinct(list_filter(string_split(regexp_replace(regexp_replace(upper({c}), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'), ' '), lambda w: w <> '' AND NOT list_contains({_LEGAL}, w)))"


@query(f"""WITH v AS (SELECT p_partkey, 'The ' || p_name || ' LLC' AS a, CASE p_size % 4 WHEN 0 THEN upper(p_name) || ', Inc.' WHEN 1 THEN p_name || ' & ' || p_type WHEN 2 THEN p_type || ' of ' || p_brand ELSE 'Company' END AS b FROM part), t AS (SELECT p_partkey, {_tokens('a')} AS x, {_tokens('b')} AS y FROM v)
SELECT p_partkey, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE END AS similarity, array_to_string(list_sort(y), ' ') AS tokens FROM t""")
def name_similarity(t: Tables) -> DataFrame:
    """Two spellings of each part's name: with a legal form, with more words, another name, and nothing but a legal form."""
    k = F.col("p_size") % 4
    b = F.when(k == 0, F.concat(F.upper("p_name"), F.lit(", Inc."))).when(k == 1, F.concat("p_name", F.lit(" & "), "p_type")).when(k == 2, F.concat("p_type", F.lit(" of "), "p_brand")).otherwise("Company")
    v = t.part.select("p_partkey", F.concat(F.lit("The "), "p_name", F.lit(" LLC")).alias("a"), b.alias("b"))
    return v.select("p_partkey", names.name_similarity(F.col("a"), F.col("b")).alias("similarity"), F.array_join(F.array_sort(names.name_tokens(F.col("b"))), " ").alias("tokens"))


_RAW_NAME = "CASE c_custkey % 8 WHEN 0 THEN 'TBD' WHEN 1 THEN 'Smith, John Q' WHEN 2 THEN c_mktsegment || ' Builders LLC' WHEN 3 THEN c_name WHEN 4 THEN '  ' WHEN 5 THEN 'Jane ' || c_mktsegment WHEN 6 THEN 'see ' || c_name ELSE 'City of ' || c_mktsegment END"


@query(f"""WITH v AS (SELECT c_custkey, {_RAW_NAME} AS a FROM customer)
SELECT c_custkey, CASE WHEN trim(a) = '' OR regexp_matches(a, '{names.PLACEHOLDER_NAME}') OR regexp_matches(a, '[0-9]{{3,}}') THEN 'junk' WHEN regexp_matches(a, '{names.ENTITY_WORD}') THEN 'business' ELSE 'person_or_unknown' END AS quality FROM v""")
def name_quality(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", names.name_quality(F.expr(_RAW_NAME)).alias("quality"))


@query()
def name_views(t: Tables) -> DataFrame:
    """All name, address and identifier functions over the suppliers (no SQL: word maps and look-around)."""
    raw = F.concat_ws(" ", F.col("s_name"), F.lit("LLC"), F.col("s_suppkey").cast("string"), F.lit("North Main Street Olympia WA 98501"))
    s = t.supplier.select("s_suppkey", raw.alias("raw"))
    c = F.col("raw")
    return s.select("s_suppkey", names.address_parts(c).alias("address"), names.split_name_address(c).alias("split"), names.org_parts(c).alias("org"), names.cross_name_key(c).alias("key"), names.address_match_key(c).alias("address_key"), names.development_name(c).alias("development"), names.is_government_name(c).alias("government"))


_SCOPES = {k: v for k, v in scalars.SCOPES.items() if k not in ("specialist", "restoration", "remodel", "other_trade")}


def _says(column: str, scope: str) -> str:
    return f"regexp_matches({column}, '{scalars.SCOPES[scope]}')"


@query(f"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS s FROM d),
g AS (SELECT doc_id, max(CASE WHEN {_says('s', 'demolition')} AND NOT {_says('s', 'building')} OR {_says('s', 'field_work')} AND NOT ({_says('s', 'glazing')} AND NOT {_says('s', 'no_envelope')}) THEN 0.2 WHEN {_says('s', 'entitlement_only')} AND NOT {_says('s', 'building')} THEN 0.4
WHEN {_says('s', 'glazing')} AND NOT {_says('s', 'no_envelope')} THEN 1 WHEN {_says('s', 'commercial')} THEN 0.7 WHEN {_says('s', 'multifamily')} THEN 0.4 ELSE 0.2 END)::DOUBLE AS glazing_fit FROM l GROUP BY 1)
SELECT d.doc_id, {', '.join(f"{_says('t', k)} AS {k}" for k in _SCOPES)}, (SELECT max(u::INT) FROM (SELECT unnest(regexp_extract_all(t, '{scalars.UNITS}', 1)) AS u) WHERE u::INT BETWEEN 1 AND 5000) AS units, glazing_fit FROM d LEFT JOIN g ON g.doc_id = d.doc_id""")
def scope_features(t: Tables) -> DataFrame:
    """Scope features of every document, and the best glazing fit of its lines, each judged by itself."""
    text = F.lower("text")
    return t.documents.select("doc_id", *(scalars.scope(text, k).alias(k) for k in _SCOPES), scalars.units_from_text(text).alias("units"), scalars.best_glazing_fit(F.split(text, "\n"), F.lit(0)).alias("glazing_fit"))


@query("""SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000","o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '","o_totalprice":' || o_totalprice || '}') AS fingerprint FROM orders""")
def record_fingerprints(t: Tables) -> DataFrame:
    """SHA-256 of each order's canonical JSON."""
    o = t.orders
    return o.select("o_orderkey", scalars.fingerprint(*(F.col(c) for c in sorted(o.columns))).alias("fingerprint"))
