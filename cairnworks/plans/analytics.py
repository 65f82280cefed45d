"""Analytic reads: lead times, first looks, leagues, market aggregates, health, alerts, gate, digest, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnworks.functions import names, scalars
from cairnworks.operators import relational as ops
from cairnworks.plans.registry import EVENTS_AS_OF, ORDERS_AS_OF, Tables, query


def _since(column: str, as_of: str, days: int):
    return F.col(column) >= F.expr(f"timestamp_ntz'{as_of}' - INTERVAL {days} DAY")


def speed_by_region(t: Tables, min_samples: int) -> DataFrame:
    """Median days from a user's first signup to the first purchase by region; regions with fewer samples are left out."""
    first = lambda kind, name: t.events.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.min("ts").alias(name))
    both = first("signup", "applied").join(first("purchase", "issued"), "user_id").filter("issued > applied")
    days = both.select("user_id", scalars.days_between(F.col("issued"), F.col("applied")).alias("days"))
    where = days.join(t.customer, F.col("user_id") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    found = ops.percentiles(where, ["r_name"], F.col("days"), (0.5,), ["median_days"])
    return found.select("r_name", F.col("n").alias("samples"), F.round("median_days", 6).alias("median_days")).filter(F.col("samples") >= min_samples)


@query("""WITH a AS (SELECT user_id, min(ts) AS applied FROM events WHERE event_type = 'signup' GROUP BY 1), i AS (SELECT user_id, min(ts) AS issued FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT r_name, count(*) AS samples, round(quantile_cont((epoch_us(issued) - epoch_us(applied)) / 86400e6, 0.5), 6) AS median_days FROM a JOIN i USING (user_id) JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE issued > applied GROUP BY 1 HAVING count(*) >= 5""")
def permit_speed(t: Tables) -> DataFrame:
    return speed_by_region(t, 5)


@query("""WITH e AS (SELECT user_id, min(ts) FILTER (WHERE event_type <> 'purchase') AS seen, min(ts) FILTER (WHERE event_type = 'purchase') AS issued FROM events GROUP BY 1),
l AS (SELECT greatest((epoch_us(issued) - epoch_us(seen)) / 86400e6, 0) AS d FROM e WHERE issued IS NOT NULL)
SELECT count(*) AS n, round(quantile_cont(d, 0.5), 6) AS median, round(avg((d >= 1)::INT), 6) AS ge1, round(avg((d >= 5)::INT), 6) AS ge5, count(*) FILTER (WHERE d = 0) AS no_warning FROM l""")
def lead_time_percentiles(t: Tables) -> DataFrame:
    e = t.events.groupBy("user_id").agg(F.min(F.when(F.col("event_type") != "purchase", F.col("ts"))).alias("seen"), F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("issued"))
    d = e.filter("issued is not null").select(F.greatest(scalars.days_between(F.col("issued"), F.col("seen")), F.lit(0.0)).alias("d"))
    share = lambda n: F.round(F.avg((F.col("d") >= n).cast("int")), 6)
    counts = d.agg(F.count("*").alias("n"), share(1).alias("ge1"), share(5).alias("ge5"), F.count_if(F.col("d") == 0).alias("no_warning"))
    median = ops.percentiles(d, [], F.col("d"), (0.5,), ["median"]).select(F.round("median", 6).alias("median"))
    return counts.join(F.broadcast(median), F.lit(True), "left").select("n", "median", "ge1", "ge5", "no_warning")  # one row each


@query(f"""WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1)
SELECT event_type, count(*) AS first_looks, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.5) FILTER (WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 31 DAY), 6) AS recent FROM f GROUP BY 1""")
def first_look(t: Tables) -> DataFrame:
    f = ops.pick(t.events, ["user_id"], F.struct("ts", "event_id"), ["event_type", "value", "ts"], latest=False)
    counts = f.groupBy("event_type").agg(F.count("*").alias("first_looks"))
    every = ops.percentiles(f, ["event_type"], F.col("value"), (0.5,), ["median"]).drop("n")
    recent = ops.percentiles(f, ["event_type"], F.when(_since("ts", EVENTS_AS_OF, 31), F.col("value")), (0.5,), ["recent"]).drop("n")
    joined = counts.join(every, "event_type", "left").join(recent, "event_type", "left")
    return joined.select("event_type", "first_looks", F.round("median", 6).alias("median"), F.round("recent", 6).alias("recent"))


@query(f"""WITH l AS (SELECT o_orderpriority AS source, o_orderdate, date_diff('day', o_orderdate::DATE, min(l_shipdate)::DATE) AS lag_days FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, 1, 2)
SELECT source, count(*) AS n, round(quantile_cont(lag_days, 0.5), 4) AS median, round(quantile_cont(lag_days, 0.5) FILTER (WHERE o_orderdate >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 365 DAY), 4) AS recent FROM l GROUP BY 1""")
def detection_lag_recent(t: Tables) -> DataFrame:
    first = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("shipped"))
    lags = t.orders.join(first, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("lag_days", F.datediff("shipped", "o_orderdate"))
    return lags.groupBy(F.col("o_orderpriority").alias("source")).agg(F.count("*").alias("n"), F.round(F.percentile("lag_days", 0.5), 4).alias("median"), F.round(F.percentile(F.when(_since("o_orderdate", ORDERS_AS_OF, 365), F.col("lag_days")), 0.5), 4).alias("recent"))


@query("""WITH l AS (SELECT r_name, o_orderpriority, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS lag_days FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT r_name, o_orderpriority AS class, count(*) AS samples, round(quantile_cont(lag_days, 0.25), 4) AS p25, round(quantile_cont(lag_days, 0.5), 4) AS p50, round(quantile_cont(lag_days, 0.75), 4) AS p75 FROM l WHERE lag_days BETWEEN 0 AND 1095 GROUP BY 1, 2 HAVING count(*) >= 20""")
def stage_lag(t: Tables) -> DataFrame:
    j = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    lags = j.select("r_name", F.col("o_orderpriority").alias("class"), F.datediff("l_shipdate", "o_orderdate").alias("lag_days")).filter("lag_days between 0 and 1095")
    return lags.groupBy("r_name", "class").agg(F.count("*").alias("samples"), *(F.round(F.percentile("lag_days", p), 4).alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.75))).filter("samples >= 20")


@query("""WITH d AS (SELECT n_name, unnest(string_split(p_name, ' ')) AS trade, date_trunc('month', o_orderdate)::DATE AS month, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderdate >= TIMESTAMP '2001-01-01'),
k AS (SELECT n_name, trade FROM d GROUP BY 1, 2 HAVING count(DISTINCT o_custkey) >= 5)
SELECT n_name, trade, month, count(*) AS demand FROM d SEMI JOIN k USING (n_name, trade) GROUP BY 1, 2, 3""")
def market_demand_kanon(t: Tables) -> DataFrame:
    o = t.orders.filter("o_orderdate >= timestamp_ntz'2001-01-01'")
    j = t.lineitem.join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    d = j.select("n_name", F.explode(F.split("p_name", " ")).alias("trade"), F.date_trunc("month", "o_orderdate").cast("date").alias("month"), "o_custkey")
    enough = d.groupBy("n_name", "trade").agg(F.count_distinct("o_custkey").alias("k")).filter("k >= 5")
    return d.join(enough, ["n_name", "trade"], "left_semi").groupBy("n_name", "trade", "month").agg(F.count("*").alias("demand"))


@query(f"""SELECT s_suppkey, count(DISTINCT o_orderkey) AS jobs, count(DISTINCT o_orderkey) FILTER (WHERE o_orderdate >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 90 DAY) AS recent, count(DISTINCT o_orderkey) FILTER (WHERE l_returnflag = 'R') AS relevant FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 2""")
def gc_league(t: Tables) -> DataFrame:
    # One row a job before counting: a supplier's lines of one order count once, and no distinct aggregate is needed.
    lines = t.lineitem.groupBy("l_suppkey", "l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    j = lines.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey")).join(t.supplier.select("s_suppkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    return j.groupBy("s_suppkey").agg(F.count("*").alias("jobs"), F.count_if(_since("o_orderdate", ORDERS_AS_OF, 90)).alias("recent"), F.count_if("r").alias("relevant")).filter("jobs >= 2")


@query(f"""SELECT l_suppkey, count(DISTINCT o_orderkey) FILTER (WHERE o_orderdate >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 365 DAY) AS year_jobs, count(DISTINCT o_orderkey) FILTER (WHERE o_orderdate >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 90 DAY) AS quarter_jobs, array_to_string(list_sort(list_distinct(list(n_name))), ',') AS nations FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def org_radar(t: Tables) -> DataFrame:
    jobs = t.lineitem.select("l_suppkey", "l_orderkey").distinct().join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return jobs.groupBy("l_suppkey").agg(F.count_if(_since("o_orderdate", ORDERS_AS_OF, 365)).alias("year_jobs"), F.count_if(_since("o_orderdate", ORDERS_AS_OF, 90)).alias("quarter_jobs"), F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("nations"))


@query("""WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS n, avg(value) AS fill FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS r, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS prev FROM d)
SELECT event_type, CASE WHEN n = 0 THEN 'red' WHEN n < 0.5 * prev THEN 'red' WHEN n < 0.8 * prev THEN 'amber' ELSE 'green' END AS health, n, prev FROM r WHERE r = 1""")
def health_ladder(t: Tables) -> DataFrame:
    d = t.events.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type")
    r = d.withColumn("prev", F.lag("n").over(w.orderBy("day"))).withColumn("r", F.row_number().over(w.orderBy(F.col("day").desc()))).filter("r = 1")
    health = F.when(F.col("n") == 0, "red").when(F.col("n") < 0.5 * F.col("prev"), "red").when(F.col("n") < 0.8 * F.col("prev"), "amber").otherwise("green")
    return r.select("event_type", health.alias("health"), "n", "prev")


@query(f"""WITH w AS (SELECT * FROM (VALUES ('click', 100), ('error', 5000), ('refund', 1), ('view', 1)) v(event_type, expected)),
c AS (SELECT event_type, count(*) AS n, max(ts) AS last FROM events WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 14 DAY GROUP BY 1)
SELECT w.event_type, coalesce(n, 0)::BIGINT AS n, CASE WHEN n IS NULL THEN 'no_flow' WHEN n < expected THEN 'below' WHEN last < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 3 DAY THEN 'stale' ELSE 'flowing' END AS state FROM w LEFT JOIN c USING (event_type)""")
def flow_states(t: Tables) -> DataFrame:
    want = t.spark.createDataFrame([("click", 100), ("error", 5000), ("refund", 1), ("view", 1)], "event_type string, expected int")
    seen = t.events.filter(_since("ts", EVENTS_AS_OF, 14)).groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    state = F.when(F.col("n").isNull(), "no_flow").when(F.col("n") < F.col("expected"), "below").when(~_since("last", EVENTS_AS_OF, 3), "stale").otherwise("flowing")
    return want.join(seen, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).cast("long").alias("n"), state.alias("state"))


@query("""SELECT page_id, len(regexp_extract_all(html, '(?i)<a\\s[^>]*href="[^"]*"')) AS links, nullif(trim(regexp_extract(html, '(?i)<title>([^<]*)</title>', 1)), '') AS title FROM pages""")
def links_extract(t: Tables) -> DataFrame:
    p = t.pages
    links = F.size(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="[^"]*"'), F.lit(0))).cast("long")
    return p.select("page_id", links.alias("links"), F.nullif(F.trim(F.regexp_extract("html", "(?i)<title>([^<]*)</title>", 1)), F.lit("")).alias("title"))


@query("""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), ':[0-9]+$', ''), '^www\\.', '') AS host FROM pages)
SELECT host, count(*) AS pages FROM h WHERE host LIKE '%.%' GROUP BY 1""")
def root_domain(t: Tables) -> DataFrame:
    return t.pages.select(names.root_domain(F.col("url")).alias("host")).filter("host is not null").groupBy("host").agg(F.count("*").alias("pages"))


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(p_name, '(?i)\\b(ring|widget)\\b') THEN 'small' END, CASE WHEN regexp_matches(p_name, '(?i)\\b(red|blue|green)\\b') THEN 'paint' END, CASE WHEN regexp_matches(p_type, '(?i)\\b(economy|promo)\\b') THEN 'value' END], lambda x: x IS NOT NULL), ',') AS tags FROM part""")
def trade_tags(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(tagged({"small": ("p_name", ("ring", "widget")), "paint": ("p_name", ("red", "blue", "green")), "value": ("p_type", ("economy", "promo"))}), ",").alias("tags"))


def tagged(taxonomy: dict[str, tuple[str, tuple[str, ...]]]):
    """The codes of a taxonomy {code: (column, keywords)} whose keywords a row's text holds as whole words."""
    import re

    def matches(column: str, words: tuple[str, ...]):
        return F.col(column).rlike(r"(?i)\b(" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + r")\b")

    return F.array_compact(F.array(*(F.when(matches(c, w), code) for code, (c, w) in taxonomy.items())))


@query("""WITH x AS (SELECT p_partkey, lower(concat_ws(' ', CASE WHEN p_size % 3 = 0 THEN 'Commercial' WHEN p_size % 3 = 1 THEN 'Residential' END, CASE WHEN p_size % 7 = 0 THEN 'Land Use' WHEN p_size % 7 = 1 THEN 'Electrical' ELSE 'Sign' END)) AS s FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(s, 'land use|land div|pre-application|sepa|shoreline|plat|zoning|variance') THEN 'land_use' WHEN s LIKE '%commercial%' THEN 'commercial' WHEN regexp_matches(s, 'residential|single family|dwelling|town ?ho') THEN 'residential' WHEN regexp_matches(s, 'mechanical|plumbing|electrical|sewer|water|hvac|utility') THEN 'trade' ELSE 'other' END AS class FROM x""")
def permit_class(t: Tables) -> DataFrame:
    a = F.when(F.col("p_size") % 3 == 0, "Commercial").when(F.col("p_size") % 3 == 1, "Residential")
    b = F.when(F.col("p_size") % 7 == 0, "Land Use").when(F.col("p_size") % 7 == 1, "Electrical").otherwise("Sign")
    return t.part.select("p_partkey", scalars.permit_class(a, b).alias("class"))


@query("""WITH c AS (SELECT l_orderkey, bool_and(l_quantity > 1) AS a, CASE WHEN count(*) >= 3 THEN bool_and(l_tax <= 0.08) END AS b, CASE WHEN max(l_discount) > 0 THEN max(l_discount) < 0.1 END AS d FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN NOT coalesce(a, true) OR NOT coalesce(b, true) OR NOT coalesce(d, true) THEN 'fail' WHEN a IS NULL OR b IS NULL OR d IS NULL THEN 'blocked' ELSE 'pass' END AS gate FROM c""")
def publication_gate(t: Tables) -> DataFrame:
    c = t.lineitem.groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") > 1).alias("a"), F.when(F.count("*") >= 3, F.bool_and(F.col("l_tax") <= 0.08)).alias("b"), F.when(F.max("l_discount") > 0, F.max("l_discount") < 0.1).alias("d"))
    return c.select("l_orderkey", scalars.gate_status([F.col("a"), F.col("b"), F.col("d")]).alias("gate"))


@query("""WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal / 10000 END AS nm, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_nationkey / 25.0::DOUBLE END AS loc, CASE WHEN s_suppkey % 12 = 0 THEN NULL ELSE 0.5::DOUBLE END AS cor FROM supplier),
w AS (SELECT s_suppkey, coalesce(0.3::DOUBLE * least(greatest(nm, 0), 1), 0) + coalesce(0.1::DOUBLE * least(greatest(loc, 0), 1), 0) + coalesce(0.15::DOUBLE * cor, 0) AS s, CASE WHEN nm IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN loc IS NULL THEN 0 ELSE 0.1::DOUBLE END + CASE WHEN cor IS NULL THEN 0 ELSE 0.15::DOUBLE END AS w FROM s)
SELECT s_suppkey, CASE WHEN w = 0 THEN 0 ELSE floor(s / w * 1000 + 0.5) / 1000 END AS trust FROM w""")
def trust_score(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    parts = {"name": F.when(k % 3 != 0, F.col("s_acctbal") / 10000), "locality": F.when(k % 4 != 0, F.col("s_nationkey") / 25.0), "corroboration": F.when(k % 12 != 0, F.lit(0.5))}
    return t.supplier.select("s_suppkey", scalars.trust(parts).alias("trust"))


@query("""WITH m AS (SELECT conv_id, count(*) AS turns, max(turn) AS last FROM conversations GROUP BY 1), r AS (SELECT conv_id, turns, CASE WHEN turns >= 8 THEN 'priority' WHEN turns >= 4 THEN 'digest' ELSE 'archive' END AS section FROM m)
SELECT conv_id, section, place FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY turns DESC, conv_id) AS place FROM r) WHERE place <= 5""")
def digest_sections(t: Tables) -> DataFrame:
    m = t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"))
    r = m.withColumn("section", scalars.band(F.col("turns"), 8, 4))
    return ops.top_per_group(r, ["section"], [F.col("turns").desc(), F.col("conv_id")], 5, "place").select("conv_id", "section", "place")


@query(f"""SELECT 'large_order' AS kind, 'large_order:' || o_orderkey AS key FROM orders WHERE o_totalprice > 480000 UNION SELECT 'silent_user', 'silent_user:' || user_id FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 4 DAY
UNION SELECT 'error_burst', 'error_burst:' || user_id || ':' || (ts::DATE) FROM events WHERE event_type = 'error' GROUP BY user_id, ts::DATE HAVING count(*) >= 3 EXCEPT SELECT 'large_order', 'large_order:' || o_orderkey FROM orders WHERE o_orderkey % 5 = 0""")
def alerts(t: Tables) -> DataFrame:
    alert = lambda kind, *parts: (F.lit(kind).alias("kind"), F.concat_ws(":", F.lit(kind), *parts).alias("key"))
    large = t.orders.filter("o_totalprice > 480000").select(*alert("large_order", F.col("o_orderkey").cast("string")))
    silent = t.events.groupBy("user_id").agg(F.max("ts").alias("last")).filter(~_since("last", EVENTS_AS_OF, 4)).select(*alert("silent_user", F.col("user_id").cast("string")))
    burst = t.events.filter("event_type = 'error'").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n")).filter("n >= 3").select(*alert("error_burst", F.col("user_id").cast("string"), F.col("day").cast("string")))
    sent = t.orders.filter("o_orderkey % 5 = 0").select(*alert("large_order", F.col("o_orderkey").cast("string")))
    return large.union(silent).union(burst).join(sent.select("key"), "key", "left_anti").select("kind", "key").distinct()


@query("""WITH h AS (SELECT doc_id, sha256(text) AS fp FROM documents), f AS (SELECT doc_id, fp, min(doc_id) OVER (PARTITION BY fp) AS first_id FROM h)
SELECT CASE WHEN doc_id = first_id THEN 'new' ELSE 'duplicate' END AS outcome, count(*) AS n FROM f GROUP BY 1""")
def ingest_outcomes(t: Tables) -> DataFrame:
    h = t.documents.groupBy(F.sha2("text", 256).alias("fp")).agg(F.count("*").alias("n"))
    return h.select(F.explode(F.array(F.struct(F.lit("new").alias("outcome"), F.lit(1).cast("long").alias("n")), F.struct(F.lit("duplicate").alias("outcome"), (F.col("n") - 1).alias("n")))).alias("x")).groupBy("x.outcome").agg(F.sum("x.n").alias("n")).filter("n > 0")


@query("""SELECT CASE WHEN o_totalprice IS NULL THEN 'null' WHEN o_totalprice <= 0 THEN 'not positive' WHEN o_orderdate > TIMESTAMP '2001-08-01' THEN 'future' END AS violation, count(*) AS n FROM orders GROUP BY 1""")
def invariant_checks(t: Tables) -> DataFrame:
    v = F.when(F.col("o_totalprice").isNull(), "null").when(F.col("o_totalprice") <= 0, "not positive").when(F.col("o_orderdate") > F.expr("timestamp_ntz'2001-08-01'"), "future")
    return t.orders.groupBy(v.alias("violation")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, '"' || o_orderpriority || ', ' || o_orderstatus || '"' || ',' || o_orderkey AS line FROM orders WHERE o_totalprice > 470000""")
def csv_export(t: Tables) -> DataFrame:
    o = t.orders.filter("o_totalprice > 470000")
    return o.select("o_orderkey", F.concat_ws(",", scalars.csv_field(F.concat_ws(", ", "o_orderpriority", "o_orderstatus")), scalars.csv_field(F.col("o_orderkey").cast("string"))).alias("line"))


@query("""WITH q AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS won, count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) AS decided, count(*) AS n FROM orders GROUP BY 1)
SELECT n_name, sum(n)::BIGINT AS n, sum(decided)::BIGINT AS decided, CASE WHEN sum(decided) >= 5 THEN sum(won) / sum(decided)::DOUBLE END AS win_rate FROM q JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def roi_scorecard(t: Tables) -> DataFrame:
    q = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("won"), F.count_if(F.col("o_orderstatus").isin("F", "P")).alias("decided"), F.count("*").alias("n"))
    j = q.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy("n_name").agg(F.sum("n").alias("n"), F.sum("decided").alias("decided"), F.when(F.sum("decided") >= 5, F.sum("won") / F.sum("decided")).alias("win_rate"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus AS now, coalesce(lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 'start') AS was FROM orders) SELECT o_custkey, o_orderkey, was, now FROM o WHERE was || '>' || now NOT IN ('start>O', 'start>P', 'O>P', 'O>F', 'P>F', 'F>O')""")
def illegal_moves(t: Tables) -> DataFrame:
    """Orders whose status can't follow that of the customer's order before: from open to in progress or finished, on to finished, and anew."""
    before = F.lag("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    moves = t.orders.select("o_custkey", "o_orderkey", F.coalesce(before, F.lit("start")).alias("was"), F.col("o_orderstatus").alias("now"))
    allowed = t.spark.createDataFrame([("start", "O"), ("start", "P"), ("O", "P"), ("O", "F"), ("P", "F"), ("F", "O")], "was string, now string")
    return moves.join(F.broadcast(allowed), ["was", "now"], "left_anti").select("o_custkey", "o_orderkey", "was", "now")  # six allowed moves


@query("""WITH m AS (SELECT conv_id, turn, role, text, regexp_extract(text, '^(\\S+)', 1) AS first_word FROM conversations) SELECT role, count(*) AS n, count(DISTINCT first_word) AS openings FROM m GROUP BY 1""")
def message_headers(t: Tables) -> DataFrame:
    m = t.conversations.select("role", F.regexp_extract("text", r"^(\S+)", 1).alias("first_word"))
    return m.groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("first_word").alias("openings"))


@query("""SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus)""")
def cube_extra(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH v AS (SELECT s_suppkey, (2 * 6371000 * asin(sqrt(pow(sin(radians(s_nationkey / 100.0) / 2), 2))))::DOUBLE AS m, (s_acctbal * 1000)::DOUBLE AS x FROM supplier) SELECT s_suppkey, round(m, 3) AS metres, round(x / 20037508.342789244 * 180, 9) AS lon, round(degrees(2 * atan(exp(x / 20037508.342789244 * pi())) - pi() / 2), 9) AS lat FROM v""")
def projections(t: Tables) -> DataFrame:
    zero = F.lit(0.0)
    x = F.col("s_acctbal") * 1000
    return t.supplier.select("s_suppkey", F.round(scalars.distance_m(zero, zero, zero, F.col("s_nationkey") / 100.0), 3).alias("metres"), F.round(scalars.mercator_lon(x), 9).alias("lon"), F.round(scalars.mercator_lat(x), 9).alias("lat"))
