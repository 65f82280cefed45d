"""Queries of the aggregate, window, set and predicate families."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnworks.functions import scalars
from cairnworks.operators import relational as ops
from cairnworks.plans.registry import EVENTS_AS_OF, ORDERS_AS_OF, Tables, query


@query("""SELECT o_orderstatus, count(*) AS n, round(min(o_totalprice), 2) AS lo, round(max(o_totalprice), 2) AS hi, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def group_by(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.min("o_totalprice"), 2).alias("lo"), F.round(F.max("o_totalprice"), 2).alias("hi"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT l_suppkey, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1""")
def distinct_count(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("orders"))


@query(f"""SELECT o_custkey, count(DISTINCT o_orderpriority) FILTER (WHERE o_orderdate >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 365 DAY) AS year_kinds, count(DISTINCT o_orderpriority) FILTER (WHERE o_orderdate >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 90 DAY) AS recent_kinds FROM orders GROUP BY 1""")
def distinct_count_filtered(t: Tables) -> DataFrame:
    since = lambda days: F.col("o_orderdate") >= F.expr(f"timestamp_ntz'{ORDERS_AS_OF}' - INTERVAL {days} DAY")
    return t.orders.groupBy("o_custkey").agg(F.count_distinct(F.when(since(365), F.col("o_orderpriority"))).alias("year_kinds"), F.count_distinct(F.when(since(90), F.col("o_orderpriority"))).alias("recent_kinds"))


@query("""SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE value <= 50) AS low FROM events GROUP BY 1""")
def funnel(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("high"), F.count_if(F.col("value") <= 50).alias("low"))


@query("""SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15""")
def having_threshold(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n >= 15")


@query("""SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.75), 4) AS p75 FROM orders GROUP BY 1""")
def exact_percentiles(t: Tables) -> DataFrame:
    p = ops.percentiles(t.orders, ["o_orderpriority"], F.col("o_totalprice"), (0.25, 0.5, 0.75))
    return p.select("o_orderpriority", *(F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")))


@query("""SELECT o_custkey, string_agg(o_orderpriority, ' ' ORDER BY o_orderkey) AS kinds FROM orders GROUP BY 1""")
def ordered_concat(t: Tables) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(listed, lambda x: x["o_orderpriority"]), " ").alias("kinds"))


@query("""SELECT l_suppkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS flags FROM lineitem GROUP BY 1""")
def distinct_array(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))


@query("""SELECT n_regionkey, string_agg(n_nationkey || ':' || n_name, ';' ORDER BY n_nationkey) AS members FROM nation GROUP BY 1""")
def nested_list(t: Tables) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["n_nationkey"].cast("string"), x["n_name"])), ";").alias("members"))


@query("""SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS value FROM (SELECT DISTINCT s_nationkey, l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) JOIN orders ON o_orderkey = l_orderkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""")
def enterprise_two_level(t: Tables) -> DataFrame:
    once = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", "l_orderkey").distinct()
    joined = once.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("value"))


@query("""SELECT CASE WHEN o_totalprice >= 300000 THEN 'large' WHEN o_totalprice >= 100000 THEN 'middle' ELSE 'small' END AS size, year(o_orderdate)::BIGINT AS in_year, count(*) AS n FROM orders GROUP BY 1, 2""")
def group_by_expression(t: Tables) -> DataFrame:
    size = F.when(F.col("o_totalprice") >= 300000, "large").when(F.col("o_totalprice") >= 100000, "middle").otherwise("small")
    return t.orders.groupBy(size.alias("size"), F.year("o_orderdate").cast("long").alias("in_year")).agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'returned' WHEN bool_or(l_returnflag = 'A') THEN 'accepted' ELSE 'none' END AS top_role FROM lineitem GROUP BY 1""")
def role_precedence(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.when(F.bool_or(F.col("l_returnflag") == "R"), "returned").when(F.bool_or(F.col("l_returnflag") == "A"), "accepted").otherwise("none").alias("top_role"))


_FIELDS = "SELECT l_orderkey, 'quantity' AS field, l_quantity AS number FROM lineitem UNION ALL SELECT l_orderkey, 'price', l_extendedprice FROM lineitem UNION ALL SELECT l_orderkey, 'tax', l_tax FROM lineitem"


@query(f"""SELECT l_orderkey, field, count(DISTINCT number) AS n_values, min(number) AS least, max(number) AS most FROM ({_FIELDS}) GROUP BY 1, 2 HAVING count(DISTINCT number) > 1 AND max(number) > min(number) * 1.25""")
def contradictions(t: Tables) -> DataFrame:
    fields = t.lineitem.select("l_orderkey", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"))
    return ops.contradictions(ops.unpivot_numbers(fields, "l_orderkey", ["quantity", "price", "tax"]), "l_orderkey")


@query(f"""SELECT field, count(*) AS n, round(avg(number), 6) AS mean FROM ({_FIELDS}) GROUP BY 1""")
def unpivot_fields(t: Tables) -> DataFrame:
    fields = t.lineitem.select("l_orderkey", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"))
    return ops.unpivot_numbers(fields, "l_orderkey", ["quantity", "price", "tax"]).groupBy("field").agg(F.count("*").alias("n"), F.round(F.avg("number"), 6).alias("mean"))


@query("""SELECT coalesce(sum(n - 1), 0)::BIGINT AS surplus, count(*) AS groups FROM (SELECT text, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)""")
def dup_surplus(t: Tables) -> DataFrame:
    # Grouping by a digest keeps long texts out of the shuffle.
    groups = t.documents.groupBy(F.sha2("text", 256).alias("d")).agg(F.count("*").alias("n")).filter("n > 1")
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"), F.count("*").alias("groups"))


@query("""SELECT user_id, CASE WHEN decided >= 10 THEN (accepted + 1) / (decided + 2)::DOUBLE END AS rate, CASE WHEN decided >= 5 THEN accepted / decided::DOUBLE END AS win_rate FROM (SELECT user_id, count(*) AS decided, count(*) FILTER (WHERE event_type = 'purchase') AS accepted FROM events GROUP BY 1)""")
def rates_with_floor(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id").agg(F.count("*").alias("decided"), F.count_if(F.col("event_type") == "purchase").alias("accepted"))
    return g.select("user_id", scalars.accept_rate(F.col("accepted"), F.col("decided")).alias("rate"), F.when(F.col("decided") >= 5, F.col("accepted") / F.col("decided")).alias("win_rate"))


@query("""WITH g AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT sum(n) OVER (ORDER BY n DESC, l_suppkey) AS run, row_number() OVER (ORDER BY n DESC, l_suppkey) AS place, sum(n) OVER () AS total FROM g)
SELECT share::DOUBLE AS share, min(place) AS groups_needed FROM r, (VALUES (0.5), (0.8)) v(share) WHERE run >= share * total GROUP BY 1""")
def coverage_clusters(t: Tables) -> DataFrame:
    return ops.coverage(t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n")), "n", "l_suppkey", [0.5, 0.8])


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r > 1 AND event_type = 'purchase'""")
def dedupe_delivery(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.filter("event_type = 'purchase'").select("user_id", "event_type", "event_id", F.row_number().over(w).alias("r"))
    return e.filter("r > 1").drop("r")


@query("""SELECT lang, count(*) AS n, count(*) FILTER (WHERE predicted AND quality = 1) / nullif(count(*) FILTER (WHERE predicted), 0)::DOUBLE AS prec, count(*) FILTER (WHERE predicted AND quality = 1) / nullif(count(*) FILTER (WHERE quality = 1), 0)::DOUBLE AS recall
FROM (SELECT lang, quality, n_chars > 1000 AS predicted FROM labels JOIN documents USING (doc_id)) GROUP BY 1""")
def eval_precision_recall(t: Tables) -> DataFrame:
    d = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").withColumn("predicted", F.col("n_chars") > 1000)
    hit = F.count_if(F.col("predicted") & (F.col("quality") == 1))
    return d.groupBy("lang").agg(F.count("*").alias("n"), (hit / F.nullif(F.count_if(F.col("predicted")), F.lit(0))).alias("prec"), (hit / F.nullif(F.count_if(F.col("quality") == 1), F.lit(0))).alias("recall"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_per_key(t: Tables) -> DataFrame:
    return ops.pick(t.events, ["user_id"], F.struct("ts", "event_id"), ["event_id", "event_type"])


@query("""SELECT l_orderkey, s_name FROM (SELECT l_orderkey, s_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, s_name, l_linenumber) AS r FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) WHERE r = 1""")
def best_contact_pick(t: Tables) -> DataFrame:
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    joined = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return ops.pick(joined, ["l_orderkey"], F.struct(rank.alias("r"), "s_name", "l_linenumber"), ["s_name"], latest=False)


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem) WHERE place <= 5""")
def topk_evidence(t: Tables) -> DataFrame:
    return ops.top_per_group(t.lineitem, ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 5, "place").select("l_suppkey", "l_orderkey", "l_linenumber", "place")


@query("""SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20""")
def page_with_total(t: Tables) -> DataFrame:
    return ops.page(t.orders.filter("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 20, 1)


@query("""SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 25""")
def top_k(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_retailprice").orderBy(F.col("p_retailprice").desc_nulls_last(), "p_partkey").limit(25)


@query("""SELECT min(n) AS listed, min(n) > 100 AS capped FROM (SELECT count(*) AS n FROM (SELECT * FROM orders WHERE o_totalprice > 400000 LIMIT 101))""")
def cap_detection(t: Tables) -> DataFrame:
    return t.orders.filter("o_totalprice > 400000").limit(101).agg(F.count("*").alias("listed"), (F.count("*") > 100).alias("capped"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 2000 THEN 0 WHEN c_acctbal < 5000 THEN 1 ELSE 2 END AS band FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY band, c_acctbal DESC, c_custkey LIMIT 3""")
def banded_sort(t: Tables) -> DataFrame:
    band = F.when(F.col("c_acctbal") < 2000, 0).when(F.col("c_acctbal") < 5000, 1).otherwise(2)
    return t.customer.filter("c_mktsegment = 'BUILDING'").withColumn("band", band).orderBy("band", F.col("c_acctbal").desc(), "c_custkey").limit(3).select("c_custkey", "band")


@query("""SELECT event_type, day, n, prev FROM (SELECT event_type, day, n, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS prev, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS r FROM (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)) WHERE r <= 5""")
def last_runs(t: Tables) -> DataFrame:
    d = t.events.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type")
    return d.withColumn("prev", F.lag("n").over(w.orderBy("day"))).withColumn("r", F.row_number().over(w.orderBy(F.col("day").desc()))).filter("r <= 5").drop("r")


_STATES = "CASE WHEN user_id % 5 = 0 THEN 'dismissed' WHEN user_id % 7 = 0 THEN 'promoted' ELSE 'open' END"


@query(f"""WITH o AS (SELECT user_id, min(value) AS score, {_STATES} AS state, CASE WHEN user_id % 2 = 0 THEN min(ts)::DATE END AS first_at FROM events WHERE event_type = 'signup' GROUP BY user_id),
n AS (SELECT user_id, max(value) AS score, 'qualified' AS state, max(ts)::DATE AS first_at FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT coalesce(o.user_id, n.user_id) AS user_id, CASE WHEN n.user_id IS NULL THEN o.score ELSE n.score END AS score,
CASE WHEN n.user_id IS NULL OR o.state IN ('dismissed', 'promoted') THEN o.state ELSE n.state END AS state, CASE WHEN n.user_id IS NULL THEN o.first_at ELSE coalesce(o.first_at, n.first_at) END AS first_at FROM o FULL JOIN n ON o.user_id = n.user_id""")
def upsert_sticky(t: Tables) -> DataFrame:
    e = t.events
    old = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("value").alias("score"), F.min(F.col("ts").cast("date")).alias("first"))
    old = old.select("user_id", "score", F.expr(_STATES).alias("state"), F.when(F.col("user_id") % 2 == 0, F.col("first")).alias("first_at"))
    new = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("value").alias("score"), F.lit("qualified").alias("state"), F.max(F.col("ts").cast("date")).alias("first_at"))
    return ops.upsert(old, new, ["user_id"], {"state": ("dismissed", "promoted")}, ["first_at"])


@query("""WITH h AS (SELECT c_custkey, 1 AS version, CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE c_mktsegment END AS content FROM customer WHERE c_custkey % 4 <> 0)
SELECT c_custkey, (coalesce(h.version, 0) + 1)::INT AS version, c_mktsegment AS content FROM customer LEFT JOIN h USING (c_custkey) WHERE h.content IS DISTINCT FROM c_mktsegment""")
def versioned_append(t: Tables) -> DataFrame:
    c = t.customer
    history = c.filter("c_custkey % 4 <> 0").select("c_custkey", F.lit(1).alias("version"), F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(F.col("c_mktsegment")).alias("content"))
    return ops.versioned(history, c.select("c_custkey", F.col("c_mktsegment").alias("content")), "c_custkey", "content")


@query("""SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def set_difference(t: Tables) -> DataFrame:
    """Customers with open orders and finished ones, less those with any in progress."""
    of = lambda status: t.orders.filter(F.col("o_orderstatus") == status).select("o_custkey")
    return of("O").join(of("P"), "o_custkey", "left_anti").join(of("F"), "o_custkey", "left_semi").distinct()


@query("""SELECT a.l_orderkey, len(list_intersect(a.s, b.s))::INT AS shared FROM (SELECT l_orderkey, list_distinct(list(l_suppkey)) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a JOIN (SELECT l_orderkey, list_distinct(list(l_suppkey)) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) b USING (l_orderkey)""")
def set_intersection(t: Tables) -> DataFrame:
    of = lambda flag, name: t.lineitem.filter(F.col("l_returnflag") == flag).groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias(name))
    return of("R", "r").join(of("A", "a"), "l_orderkey").select("l_orderkey", F.size(F.array_intersect("r", "a")).alias("shared"))


@query("""SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(list(l_partkey), list(l_suppkey)))), ',') AS merged FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 450000 GROUP BY 1""")
def merged_arrays(t: Tables) -> DataFrame:
    j = t.orders.filter("o_totalprice > 450000").join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.array_union(F.collect_set("l_partkey"), F.collect_set("l_suppkey"))), ",").alias("merged"))


@query("""SELECT event_id, (props->>'k')::INT AS k, (props->>'missing') AS missing FROM events WHERE (props->>'k')::INT > 90""")
def json_props(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select("event_id", k.alias("k"), F.get_json_object("props", "$.missing").alias("missing")).filter("k > 90")


@query("""SELECT key, count(*) AS n, sum(value::INT)::BIGINT AS total FROM (SELECT unnest(json_keys(props)) AS key, props->>'k' AS value FROM events) GROUP BY 1""")
def json_each(t: Tables) -> DataFrame:
    pairs = t.events.select(F.explode(F.from_json("props", "map<string,int>")).alias("key", "value"))
    return pairs.groupBy("key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("""SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\\b(stupid|idiot|loser)\\b') AND NOT regexp_matches(text, '[0-9]{4,}') AND lang NOT IN ('fr', 'es')""")
def regex_predicate(t: Tables) -> DataFrame:
    d = t.documents
    return d.filter(~F.col("lang").isin("fr", "es") & d["text"].rlike(r"(?i)\b(stupid|idiot|loser)\b") & ~d["text"].rlike("[0-9]{4,}")).select("doc_id")


@query("""SELECT p_partkey FROM part WHERE p_name ILIKE '%WIDGET%' OR p_brand ILIKE 'brand#2%'""")
def ilike_search(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_name").ilike("%WIDGET%") | F.col("p_brand").ilike("brand#2%")).select("p_partkey")


@query("""SELECT s_suppkey FROM supplier WHERE CASE WHEN s_acctbal > 5000 THEN s_nationkey > 10 ELSE s_name LIKE '%7' END""")
def guarded_predicate(t: Tables) -> DataFrame:
    return t.supplier.filter(F.when(F.col("s_acctbal") > 5000, F.col("s_nationkey") > 10).otherwise(F.col("s_name").like("%7"))).select("s_suppkey")


@query("""SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linestatus) AS st FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus IS DISTINCT FROM st""")
def null_safe_drift(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.max("l_linestatus").alias("st"))
    return t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").filter(~F.col("o_orderstatus").eqNullSafe(F.col("st"))).select("o_orderkey")


@query("""SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'""")
def half_open_period(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderdate >= timestamp_ntz'1998-01-01' AND o_orderdate < timestamp_ntz'1999-01-01'").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, count(*) AS n FROM conversations WHERE role <> 'system' AND (conv_id % 10 = 3 OR role = 'user') GROUP BY 1""")
def viewer_scoped(t: Tables) -> DataFrame:
    return t.conversations.filter((F.col("role") != "system") & ((F.col("conv_id") % 10 == 3) | (F.col("role") == "user"))).groupBy("conv_id").agg(F.count("*").alias("n"))


def matching_orders(t: Tables, status: str | None = None, least: float | None = None, priority: str | None = None) -> DataFrame:
    """Filters are put in only where a value is asked for, so an absent one costs no predicate."""
    rows = t.orders
    if status is not None:
        rows = rows.filter(F.col("o_orderstatus") == status)
    if least is not None:
        rows = rows.filter(F.col("o_totalprice") >= least)
    if priority is not None:
        rows = rows.filter(F.col("o_orderpriority") == priority)
    return rows


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice >= 420000""")
def optional_filters(t: Tables) -> DataFrame:
    return matching_orders(t, status="P", least=420000).select("o_orderkey")


@query("""SELECT n_name, w.weight FROM nation JOIN (VALUES (1, 0.5::DOUBLE), (3, 0.25::DOUBLE), (24, 1.0::DOUBLE)) w(k, weight) ON n_nationkey = w.k""")
def values_relation(t: Tables) -> DataFrame:
    w = t.spark.createDataFrame([(1, 0.5), (3, 0.25), (24, 1.0)], "k int, weight double")
    return t.nation.join(F.broadcast(w), F.col("n_nationkey") == F.col("k")).select("n_name", "weight")  # three rows


@query("""SELECT l_suppkey, array_to_string((list(l_orderkey ORDER BY l_extendedprice DESC, l_orderkey))[1:3], ',') AS best FROM lineitem GROUP BY 1""")
def array_slice(t: Tables) -> DataFrame:
    listed = ops.top_per_group(t.lineitem, ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey")], 3, "r")
    return listed.groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "l_orderkey"))), lambda x: x["l_orderkey"].cast("string")), ",").alias("best"))


@query(f"""SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 10 DAY GROUP BY 1 HAVING count(*) >= 5""")
def velocity_90d(t: Tables) -> DataFrame:
    return t.events.filter(f"ts >= timestamp_ntz'{EVENTS_AS_OF}' - INTERVAL 10 DAY").groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 5")
