"""Account views, leagues, health and replay over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.functions import scalars
from cairnworks.operators import relational as ops
from cairnworks.operators import resolver, views
from cairnworks.plans.links import _letters, _sql_letters
from cairnworks.plans.registry import Tables, query

_STATE = "CASE o_orderkey % 6 WHEN 0 THEN 'priority_review' WHEN 1 THEN 'weekly_digest' WHEN 2 THEN 'archive' WHEN 3 THEN 'promoted' WHEN 4 THEN 'dismissed' ELSE 'new' END"
_OPPS = f"opp AS (SELECT o_orderkey AS opportunity, o_orderpriority AS account, o_custkey AS project, {_STATE} AS state, CASE WHEN o_orderkey % 9 > 0 THEN round(o_totalprice / 5000, 1) END AS score, o_orderdate AS changed_at FROM orders)"


def _opportunities(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("opportunity"), F.col("o_orderpriority").alias("account"), F.col("o_custkey").alias("project"), F.expr(_STATE).alias("state"), F.when(k % 9 > 0, F.round(F.col("o_totalprice") / 5000, 1)).alias("score"), F.col("o_orderdate").alias("changed_at"))


def _accounts(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderpriority").alias("account")).distinct().union(t.spark.createDataFrame([("0-NEW",)], "account string")).select("account", F.lower("account").alias("name"), (F.col("account") != "5-LOW").alias("active"))


@query(f"""WITH {_OPPS}, a AS (SELECT DISTINCT o_orderpriority AS account FROM orders UNION ALL SELECT '0-NEW')
SELECT a.account, lower(a.account) AS name, count(o.state) FILTER (o.state <> 'archive') AS live, count(*) FILTER (o.state = 'priority_review') AS priority_review, count(*) FILTER (o.state = 'promoted') AS promoted, count(*) FILTER (o.state = 'new') AS new, count(*) FILTER (o.state = 'dismissed') AS dismissed,
max(o.changed_at)::DATE AS last_change FROM a LEFT JOIN opp o ON o.account = a.account WHERE a.account <> '5-LOW' GROUP BY 1""")
def account_counts(t: Tables) -> DataFrame:
    return views.account_counts(_accounts(t), _opportunities(t)).withColumn("last_change", F.col("last_change").cast("date"))


@query(f"""WITH {_OPPS}, rec AS (SELECT o_custkey AS project, max(l_extendedprice) AS max_valuation FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'F' AND l_suppkey % 5 > 0 GROUP BY 1),
ro AS (SELECT DISTINCT o_custkey AS project, l_suppkey AS org, CASE WHEN l_suppkey % 3 = 0 THEN 'N/A Builders' WHEN l_suppkey % 3 = 1 THEN 'Firm ' || {_sql_letters('l_suppkey')} || ' LLC' ELSE 'John ' || {_sql_letters('l_suppkey')} END AS org_name, CASE l_linenumber % 4 WHEN 0 THEN 'owner' WHEN 1 THEN 'applicant' WHEN 2 THEN 'architect' ELSE 'primary_contractor' END AS role,
CASE WHEN l_suppkey % 7 = 0 THEN 'junk' WHEN l_suppkey % 7 = 1 THEN 'business' END AS quality FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey % 5 > 0),
gc AS (SELECT project, arg_min(org, (CASE role WHEN 'primary_contractor' THEN 1 WHEN 'applicant' THEN 2 ELSE 3 END, org_name, org)) AS org, arg_min(org_name, (CASE role WHEN 'primary_contractor' THEN 1 WHEN 'applicant' THEN 2 ELSE 3 END, org_name, org)) AS gc_name
FROM ro WHERE role <> 'architect' AND regexp_matches(org_name, '(LLC|BUILDERS|Builders)') AND CASE WHEN quality IS NULL THEN NOT regexp_matches(org_name, '^N/A') ELSE quality <> 'junk' END GROUP BY 1)
SELECT o.opportunity, o.account, o.project, o.state, o.score, c_name AS project_name, max_valuation, gc_name, org % 2 = 0 AS gc_verified, CASE WHEN org % 4 > 0 THEN '206555' || lpad(org::VARCHAR, 4, '0') END AS gc_phone, o.opportunity % 10 = 3 AND o.account = '1-URGENT' AND o.opportunity < 1000 AS is_easy_win
FROM opp o JOIN customer ON c_custkey = o.project JOIN rec USING (project) LEFT JOIN gc USING (project) WHERE o.state <> 'archive' AND o.account <> '5-LOW'""")
def opportunity_view(t: Tables) -> DataFrame:
    li = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("project")), "l_orderkey")
    s = F.col("l_suppkey")
    records = li.select("project", F.col("l_orderkey").alias("record"), s.alias("source"), F.col("l_extendedprice").alias("valuation"), (F.col("l_linestatus") == "F").alias("active"))
    sources = t.supplier.select(F.col("s_suppkey").alias("source"), F.when(F.col("s_suppkey") % 5 == 0, "acct").alias("account"))
    name = F.when(s % 3 == 0, "N/A Builders").when(s % 3 == 1, F.concat(F.lit("Firm "), _letters(s), F.lit(" LLC"))).otherwise(F.concat(F.lit("John "), _letters(s)))
    role = F.element_at(F.array(*map(F.lit, ("owner", "applicant", "architect", "primary_contractor"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    roles = li.select("project", s.alias("org"), name.alias("org_name"), role.alias("role"), (s % 2 == 0).alias("verified"), F.when(s % 7 == 0, "junk").when(s % 7 == 1, "business").alias("quality"), s.alias("source"))
    k = F.col("s_suppkey")
    phone = F.when(k % 4 > 0, F.concat(F.lit("206555"), F.lpad(k.cast("string"), 4, "0")))
    phones = t.supplier.select(k.alias("org"), phone.alias("phone"), F.lit(None).cast("string").alias("account"), F.lit("public_business").alias("kind")).union(t.supplier.select(k, F.lit("100"), F.lit("acct"), F.lit("public_business")))
    easy = t.orders.filter("o_orderkey < 1000 and o_orderkey % 10 = 3").agg(F.collect_set(F.col("o_orderkey").cast("string")).alias("easy_wins"))  # 100 at most
    digests = easy.select(F.lit("1-URGENT").alias("account"), F.explode(F.array(F.lit(2), F.lit(1))).alias("period_end"), F.lit(1).alias("sent_at"), "easy_wins").withColumn("easy_wins", F.when(F.col("period_end") == 2, F.col("easy_wins")))
    projects = t.customer.select(F.col("c_custkey").alias("project"), F.col("c_name").alias("project_name"))
    return views.opportunity_view(_opportunities(t), _accounts(t), projects, records, sources, roles, phones, digests).drop("changed_at")


@query("""WITH d AS (SELECT event_id AS digest, user_id % 20 AS account, event_type AS status, ts::DATE AS period_end, CASE WHEN event_id % 3 > 0 THEN ts END AS sent_at, CASE WHEN event_id % 4 > 0 THEN json_object('items', range(event_id % 5), 'suppressed', json_object('gateFailed', event_id % 7), 'candidateCount', event_id % 11) ELSE '{}'::JSON END AS metadata FROM events)
SELECT account, digest, status, period_end, sent_at, coalesce(json_array_length(metadata, '$.items'), 0)::INT AS items, 0 AS reviews, coalesce((metadata ->> '$.suppressed.gateFailed')::INT, 0) AS gate_failed, 0 AS blocked, (metadata ->> '$.candidateCount')::INT AS candidates
FROM d QUALIFY row_number() OVER (PARTITION BY account ORDER BY period_end DESC, sent_at DESC NULLS LAST, digest DESC) = 1""")
def digest_status(t: Tables) -> DataFrame:
    e = F.col("event_id")
    items = F.when(e % 5 > 0, F.sequence(F.lit(0), (e % 5 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    told = F.to_json(F.struct(items.alias("items"), F.struct((e % 7).alias("gateFailed")).alias("suppressed"), (e % 11).alias("candidateCount")))
    digests = t.events.select(e.alias("digest"), (F.col("user_id") % 20).alias("account"), F.col("event_type").alias("status"), F.col("ts").cast("date").alias("period_end"), F.when(e % 3 > 0, F.col("ts")).alias("sent_at"), F.when(e % 4 > 0, told).otherwise("{}").alias("metadata"))
    return views.digest_status(digests)


@query(f"""WITH {_OPPS}, pu AS (SELECT l_orderkey AS opportunity, l_linenumber AS pursuit, l_returnflag AS state, l_extendedprice AS value FROM lineitem WHERE l_quantity >= 45)
SELECT pu.opportunity, pursuit, pu.state, value, opp.account, c_name AS project_name FROM pu JOIN opp USING (opportunity) JOIN customer ON c_custkey = project WHERE opp.account <> '5-LOW'""")
def pursuits(t: Tables) -> DataFrame:
    p = t.lineitem.filter("l_quantity >= 45").select(F.col("l_orderkey").alias("opportunity"), F.col("l_linenumber").alias("pursuit"), F.col("l_returnflag").alias("state"), F.col("l_extendedprice").alias("value"))
    joined = p.join(_opportunities(t).select("opportunity", "account", "project"), "opportunity").join(_accounts(t).filter("active").select("account"), "account")
    return joined.join(t.customer, F.col("c_custkey") == F.col("project")).select("opportunity", "pursuit", "state", "value", "account", F.col("c_name").alias("project_name"))


@query(f"""WITH {_OPPS}, f AS (SELECT opp.*, c_name FROM opp JOIN customer ON c_custkey = project WHERE account = '2-HIGH' AND state <> 'archive' AND c_mktsegment = 'MACHINERY')
SELECT opportunity, c_name AS project_name, score, (SELECT count(*) FROM f) AS total FROM f ORDER BY score DESC NULLS LAST, opportunity LIMIT 25 OFFSET 25""")
def opportunity_page(t: Tables) -> DataFrame:
    """The second page of an account's live opportunities in one segment, best first, those without a score last."""
    rows = _opportunities(t).filter("account = '2-HIGH' and state <> 'archive'").join(t.customer.filter("c_mktsegment = 'MACHINERY'"), F.col("c_custkey") == F.col("project"))
    return ops.page(rows.select("opportunity", F.col("c_name").alias("project_name"), "score"), [F.col("score").desc_nulls_last(), F.col("opportunity")], 25, 1)


@query(f"WITH {_OPPS} SELECT state, count(*) AS n, count(*) FILTER (score IS NULL) AS unscored FROM opp WHERE account = '2-HIGH' GROUP BY 1")
def band_summary(t: Tables) -> DataFrame:
    return views.band_summary(_opportunities(t).filter("account = '2-HIGH'"))


_LEAGUE = f"""v AS (SELECT l_suppkey AS org, count(DISTINCT l_orderkey) AS projects, count(DISTINCT l_orderkey) FILTER (l_shipdate >= TIMESTAMP '2001-05-04') AS recent, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') AS relevant, max(l_extendedprice) FILTER (l_suppkey % 4 > 0) AS value, max(l_shipdate) AS latest FROM lineitem GROUP BY 1),
n AS (SELECT v.*, {_sql_letters('org // 4')} AS k, CASE org % 4 WHEN 0 THEN 'Firm ' || {_sql_letters('org // 4')} || ' LLC' WHEN 1 THEN 'FIRM ' || {_sql_letters('org // 4')} WHEN 2 THEN 'Firm ' || {_sql_letters('org // 4')} || ' 500 Union Street' ELSE 'Pat ' || {_sql_letters('org // 4')} END AS org_name, 'N' || s_nationkey AS county FROM v JOIN supplier ON s_suppkey = org),
g AS (SELECT CASE WHEN org % 4 = 3 THEN 'PAT ' ELSE 'FIRM ' END || k AS key, arg_min(org, (-projects, org_name, org)) AS org, count(*) AS spellings, sum(projects)::BIGINT AS projects, sum(recent)::BIGINT AS recent, sum(relevant)::BIGINT AS relevant, sum(value) AS value_total, max(value) AS value_max, max(latest) AS latest,
min(CASE WHEN org % 4 = 1 THEN 'REF' || org END) AS ref, bool_or(org % 3 = 0) AS verified, min(CASE WHEN org % 4 = 2 THEN '206' || org END) AS phone, array_to_string(list_sort(list_distinct(list(county))), ',') AS counties, bool_or(org % 4 = 0) AS entity, bool_or(org % 4 = 2) AS tail FROM n GROUP BY 1)"""


def _league(t: Tables) -> DataFrame:
    s, key = F.col("org"), _letters(F.floor(F.col("org") / 4))
    # A row for each firm and order first, so that lines travel once; distinct counts would send each line four times.
    orders = t.lineitem.groupBy(F.col("l_suppkey").alias("org"), "l_orderkey").agg(
        F.max(F.col("l_shipdate") >= F.lit("2001-05-04").cast("timestamp_ntz")).alias("is_recent"), F.max(F.col("l_returnflag") == "R").alias("is_relevant"), F.max("l_extendedprice").alias("value"), F.max("l_shipdate").alias("latest"),
    )
    known = F.col("l_orderkey").isNotNull()
    grouped = orders.groupBy("org").agg(
        F.count("l_orderkey").alias("projects"), F.count_if(known & F.col("is_recent")).alias("recent"), F.count_if(known & F.col("is_relevant")).alias("relevant"), F.max(F.when(s % 4 > 0, F.col("value"))).alias("value_max"), F.max("latest").alias("latest")
    )
    name = F.when(s % 4 == 0, F.concat(F.lit("Firm "), key, F.lit(" LLC"))).when(s % 4 == 1, F.concat(F.lit("FIRM "), key)).when(s % 4 == 2, F.concat(F.lit("Firm "), key, F.lit(" 500 Union Street"))).otherwise(F.concat(F.lit("Pat "), key))
    activity = grouped.join(t.supplier, F.col("s_suppkey") == s).select(
        "org", name.alias("org_name"), "projects", "recent", "relevant", F.col("value_max").alias("value_total"), "value_max", "latest", F.array(F.concat(F.lit("N"), "s_nationkey")).alias("counties"), F.when(s % 4 == 1, F.concat(F.lit("REF"), s)).alias("ref"),
        (s % 3 == 0).alias("verified"), F.when(s % 4 == 2, F.concat(F.lit("206"), s)).alias("phone"), F.lit(None).cast("string").alias("relationship"),
    )
    # The league asks for its firms twice, and the lines are by far the larger table.
    return views.league(ops.written(activity, "league-activity"))


@query(f"""WITH {_LEAGUE} SELECT key, org, spellings, projects, recent, relevant, round(value_total, 2) AS value_total, value_max, latest, ref, verified, phone, counties, array_to_string(list_filter([CASE WHEN NOT entity THEN 'likely_individual' END, CASE WHEN tail THEN 'address_in_name' END], lambda x: x IS NOT NULL), ',') AS flags FROM g""")
def org_activity(t: Tables) -> DataFrame:
    rows = _league(t)
    return rows.select("key", "org", "spellings", "projects", "recent", "relevant", F.round("value_total", 2).alias("value_total"), "value_max", "latest", "ref", "verified", "phone", F.array_join("counties", ",").alias("counties"), F.array_join("flags", ",").alias("flags"))


@query(f"WITH {_LEAGUE} SELECT ref FROM g WHERE ref IS NOT NULL AND relevant > 0 AND len(list_intersect(string_split(counties, ','), ['N1', 'N2', 'N3', 'N4', 'N5', 'N6', 'N7', 'N8'])) > 0")
def warm_network(t: Tables) -> DataFrame:
    return views.warm_network(_league(t), [f"N{i}" for i in range(1, 9)])


@query("""WITH r AS (SELECT user_id AS source, event_id AS run, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'completed_with_errors' WHEN 'view' THEN CASE WHEN event_id % 5 = 0 THEN 'running' ELSE 'succeeded' END ELSE 'succeeded' END AS status, event_type = 'signup' AND event_id % 2 = 0 AS orphaned,
event_id % 9 AS discovered, event_id % 4 AS parsed, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS unchanged, CASE WHEN event_id % 40 = 1 THEN 1 ELSE 0 END AS violations, value / 100 AS fa, (event_id % 10 + 90) / 100.0 AS fb, 'p' || (event_id % 3) AS print FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC, run DESC) AS place FROM r QUALIFY place <= 5), d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY place) AS i FROM l WHERE status <> 'running'),
p AS (SELECT source, count(*) AS n, max(ts) FILTER (status IN ('succeeded', 'completed_with_errors') AND NOT orphaned) AS last_success, max(status) FILTER (i = 1) AS s1, max(status) FILTER (i = 2) AS s2, coalesce(bool_or(orphaned) FILTER (i = 1), false) AS o1, coalesce(bool_or(orphaned) FILTER (i = 2), false) AS o2, max(discovered) FILTER (i = 1) AS d1,
max(parsed) FILTER (i = 1) AS p1, max(parsed) FILTER (i = 2) AS p2, max(unchanged) FILTER (i = 1) AS u1, max(violations) FILTER (i = 1) AS v1, max(fa) FILTER (i = 1) AS fa1, max(fa) FILTER (i = 2) AS fa2, max(print) FILTER (i = 1) AS print1, list(print) FILTER (i > 1) AS prints FROM d GROUP BY 1),
q AS (SELECT source, last_success, list_filter([CASE WHEN s1 = 'failed' AND s2 = 'failed' THEN 'two consecutive failed runs' END, CASE WHEN o1 AND o2 THEN 'two consecutive orphaned runs' END, CASE WHEN epoch(TIMESTAMP '2024-01-31' - last_success) / 3600.0 > 48 THEN 'stale' END,
CASE WHEN s1 <> 'failed' AND u1 = 0 AND NOT o1 AND d1 > 0 AND p1 = 0 THEN 'zero usable records' END, CASE WHEN v1 > 0 THEN 'parser invariant violation' END, CASE WHEN fa1 < 0.5 THEN 'required field nearly empty: a' END, CASE WHEN fa2 >= 0.5 AND fa1 < fa2 * 0.8 THEN 'field fill dropped: a' END], lambda x: x IS NOT NULL) AS red,
list_filter([CASE WHEN s1 = 'failed' AND coalesce(s2, '') <> 'failed' THEN 'latest run failed' END, CASE WHEN o1 AND NOT o2 THEN 'latest run orphaned' END, CASE WHEN n >= 2 AND NOT list_contains(prints, print1) THEN 'schema changed' END], lambda x: x IS NOT NULL) AS amber, u1 = 0 AND NOT o1 AND p2 > 0 AND p1 < p2 * 0.5 AS volume FROM p),
w AS (SELECT source, last_success, red, CASE WHEN len(red) = 0 AND len(amber) = 0 AND volume THEN ['volume dropped'] ELSE amber END AS amber FROM q)
SELECT source, CASE WHEN len(red) > 0 THEN 'red' WHEN len(amber) > 0 THEN 'amber' ELSE 'green' END AS state, CASE WHEN len(red) + len(amber) = 0 THEN 'healthy' ELSE array_to_string(list_sort(list_concat(red, amber)), ';') END AS reasons, last_success FROM w""")
def source_health(t: Tables) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "signup", "completed_with_errors").when((kind == "view") & (e % 5 == 0), "running").otherwise("succeeded")
    fill = F.create_map(F.lit("a"), F.col("value") / 100, F.lit("b"), (e % 10 + 90) / 100)
    runs = t.events.select(
        F.col("user_id").alias("source"), e.alias("run"), F.col("ts").alias("started_at"), F.col("ts").alias("completed_at"), status.alias("status"), ((kind == "signup") & (e % 2 == 0)).alias("orphaned"), (e % 9).alias("discovered"), (e % 4).alias("parsed"),
        F.when(e % 3 == 0, 1).otherwise(0).alias("unchanged"), F.lit(0).alias("duplicates"), F.when(e % 40 == 1, 1).otherwise(0).alias("violations"), fill.alias("fill"), F.concat(F.lit("p"), e % 3).alias("schema_print"),
    )
    return views.source_health(runs, "2024-01-31 00:00:00", F.lit(24), ["a"]).withColumn("reasons", F.array_join("reasons", ";"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-29 23:00:00' THEN 'completed_with_errors' WHEN event_type = 'view' THEN 'running' ELSE 'succeeded' END AS status, event_type = 'view' AND ts < TIMESTAMP '2024-01-29 23:00:00' AS orphaned FROM events""")
def orphan_reap(t: Tables) -> DataFrame:
    runs = t.events.select("event_id", F.col("ts").alias("started_at"), F.when(F.col("event_type") == "view", "running").otherwise("succeeded").alias("status"), F.lit(None).cast("boolean").alias("orphaned"))
    return views.reaped(runs, "2024-01-30 00:00:00").select("event_id", "status", "orphaned")


@query("""WITH a AS (SELECT event_id AS artifact, ts, user_id, event_type || '/' || (props::JSON ->> '$.k') AS content FROM events WHERE event_id % 3 > 0), n AS (SELECT user_id AS ext, arg_max(content, artifact) AS content FROM a GROUP BY 1),
o AS (SELECT user_id AS ext, arg_max(CASE WHEN user_id % 4 = 0 THEN 'old parser' ELSE event_type || '/' || (props::JSON ->> '$.k') END, event_id) AS content FROM events WHERE user_id % 5 > 0 AND event_id % 3 > 0 GROUP BY 1 UNION ALL SELECT -1, 'gone')
SELECT coalesce(n.ext, o.ext)::VARCHAR AS external_id, coalesce(n.content, o.content) AS content, CASE WHEN n.ext IS NULL THEN 'absent' WHEN o.ext IS NULL THEN 'inserted' WHEN n.content = o.content THEN 'kept' ELSE 'rewritten' END AS outcome FROM n FULL JOIN o ON n.ext = o.ext""")
def replay(t: Tables) -> DataFrame:
    """Events as stored artifacts, parsed again: the last one of each user is its record."""
    artifacts = t.events.filter("event_id % 3 > 0").select(F.col("event_id").alias("artifact"), F.col("ts").alias("retrieved_at"), F.to_json(F.struct("user_id", "event_type", "props")).alias("body"))

    def parse(df: DataFrame) -> DataFrame:
        body = F.from_json("body", "user_id long, event_type string, props string")
        rows = df.withColumn("b", body).select("artifact", F.lit("events").alias("source"), F.col("b.user_id").cast("string").alias("external_id"), F.concat("b.event_type", F.lit("/"), F.get_json_object("b.props", "$.k")).alias("content"))
        return rows.withColumns({"fingerprint": scalars.fingerprint(F.col("content")), "evidence": F.array("content")})

    k = F.col("external_id").cast("long")
    old = ops.pick(parse(artifacts), ["source", "external_id"], F.col("artifact"), ["content"]).filter(k % 5 > 0).withColumn("content", F.when(k % 4 == 0, "old parser").otherwise(F.col("content")))
    gone = t.spark.createDataFrame([("events", "-1", "gone")], "source string, external_id string, content string")
    old = old.union(gone).withColumn("fingerprint", scalars.fingerprint(F.col("content")))
    records, _ = views.replay(artifacts, parse, old, old.filter("external_id = '1'"))
    return records.select("external_id", "content", "outcome")


@query("""SELECT o_orderkey AS record FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' AND o_orderpriority <> '5-LOW'""")
def shared_graph(t: Tables) -> DataFrame:
    """Records of sources that may enter the shared graph: not those bound to an account, of a private class, or of no known class."""
    sources = t.spark.createDataFrame([("1-URGENT", "acct", "public"), ("2-HIGH", None, "private_authorized"), ("3-MEDIUM", None, "public"), ("4-NOT SPECIFIED", None, "public"), ("5-LOW", None, None)], "source string, account string, access_class string")
    return resolver.shared_graph(t.orders.select(F.col("o_orderkey").alias("record"), F.col("o_orderpriority").alias("source")), sources).select("record")
