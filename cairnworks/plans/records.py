"""Review logs, JSON predicates, HTML tables, ingest and name functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnworks.functions import jsons, scalars
from cairnworks.operators import observations, reviews
from cairnworks.operators import relational as ops
from cairnworks.plans.registry import Tables, query
from cairnworks.sources import html_tables as html
from cairnworks.sources import loaders

_LOG = "log AS (SELECT user_id * 100 + day(ts) AS subject, event_id AS at_, CASE event_type WHEN 'purchase' THEN 'merge' WHEN 'click' THEN 'reject' WHEN 'error' THEN 'undo' ELSE 'note' END AS action FROM events)"


def _log(t: Tables) -> DataFrame:
    action = F.when(F.col("event_type") == "purchase", "merge").when(F.col("event_type") == "click", "reject").when(F.col("event_type") == "error", "undo").otherwise("note")
    return t.events.select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("subject"), F.col("event_id").alias("at"), action.alias("action"))


@query(f"""WITH RECURSIVE {_LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY at_) AS k FROM log),
f AS (SELECT subject, 0::BIGINT AS k, 'pending' AS state, NULL::BIGINT AS since FROM n WHERE k = 1 UNION ALL
SELECT f.subject, n.k, CASE WHEN state = 'pending' AND action = 'merge' THEN 'merged' WHEN state = 'pending' AND action = 'reject' THEN 'rejected' WHEN action = 'undo' THEN 'pending' ELSE state END,
CASE WHEN state = 'pending' AND action IN ('merge', 'reject') THEN at_ WHEN action = 'undo' THEN NULL ELSE since END FROM f JOIN n ON n.subject = f.subject AND n.k = f.k + 1)
SELECT subject, arg_max(state, k) AS state, max(since) FILTER (k = last) AS since FROM (SELECT *, max(k) OVER (PARTITION BY subject) AS last FROM f) GROUP BY subject""")
def review_state(t: Tables) -> DataFrame:
    return reviews.review_state(_log(t))


@query(f"""WITH {_LOG}, a AS (SELECT *, lag(action) OVER (PARTITION BY subject ORDER BY at_) AS before FROM log WHERE action <> 'note')
SELECT subject, action, count(*) AS n, count(*) FILTER ((action = 'undo') = coalesce(before <> 'undo', false)) AS took_effect FROM a GROUP BY 1, 2""")
def review_history(t: Tables) -> DataFrame:
    return reviews.review_history(_log(t)).groupBy("subject", "action").agg(F.count("*").alias("n"), F.count_if("took_effect").alias("took_effect"))


@query("""SELECT event_type, count(*) FILTER (json_contains(props::JSON, '{"k": 9}')) AS nine, count(*) FILTER (json_contains(json_object('p', props::JSON, 'tags', [event_type, 'u' || user_id % 7]), '{"p": {"k": 17}, "tags": ["u3"]}')) AS nested,
count(*) FILTER (json_contains(json_array(event_type, user_id % 5), '[3]')) AS listed FROM events GROUP BY 1""")
def json_containment(t: Tables) -> DataFrame:
    whole = jsons.variant(F.concat(F.lit('{"p": '), "props", F.lit(', "tags": ["'), "event_type", F.lit('", "u'), F.col("user_id") % 7, F.lit('"]}')))
    listed = jsons.variant(F.concat(F.lit('["'), "event_type", F.lit('", '), F.col("user_id") % 5, F.lit("]")))
    e = t.events.select("event_type", jsons.variant(F.col("props")).alias("v"), whole.alias("w"), listed.alias("l"))
    flags = e.select("event_type", jsons.contains(F.col("v"), {"k": 9}).alias("nine"), jsons.contains(F.col("w"), {"p": {"k": 17}, "tags": ["u3"]}).alias("nested"), jsons.contains(F.col("l"), 3).alias("listed"))
    return flags.groupBy("event_type").agg(*(F.count_if(c).alias(c) for c in ("nine", "nested", "listed")))


@query("""WITH o AS (SELECT o_orderkey, json_merge_patch(json_object('status', o_orderstatus), CASE WHEN o_totalprice > 250000 THEN json_object('big', o_custkey) ELSE '{}'::JSON END) AS j, [o_orderpriority, o_orderstatus] AS tags FROM orders)
SELECT o_orderkey, json_exists(j, '$.big') AS has_big, list_has_any(tags, ['1-URGENT', 'P']) AS overlaps FROM o WHERE json_exists(j, '$.big') OR list_has_any(tags, ['1-URGENT', 'P'])""")
def json_keys(t: Tables) -> DataFrame:
    big = F.when(F.col("o_totalprice") > 250000, F.col("o_custkey"))
    o = t.orders.select("o_orderkey", jsons.variant(F.to_json(F.struct(F.col("o_orderstatus").alias("status"), big.alias("big")))).alias("j"), F.array("o_orderpriority", "o_orderstatus").alias("tags"))
    return o.select("o_orderkey", jsons.has_key(F.col("j"), "big").alias("has_big"), F.arrays_overlap("tags", F.array(F.lit("1-URGENT"), F.lit("P"))).alias("overlaps")).filter("has_big or overlaps")


@query("""WITH s AS (SELECT s_nationkey, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier)
SELECT s_nationkey AS nation, 0 AS row_no, c AS column_no, true AS header, c = 1 AS covered, CASE c WHEN 2 THEN 'Name' ELSE 'Where & who' END AS text, '' AS link FROM (SELECT DISTINCT s_nationkey FROM s), (VALUES (0), (1), (2)) v(c)
UNION ALL SELECT s_nationkey, r::INT, 0, false, r > 1, n_name, 'https://example.org/n/' || s_nationkey FROM s JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT s_nationkey, r::INT, 1, false, false, s_suppkey::VARCHAR, '' FROM s UNION ALL SELECT s_nationkey, r::INT, 2, false, false, s_name, 'https://example.org/a/' || s_suppkey FROM s""")
def html_tables(t: Tables) -> DataFrame:
    """A page for each nation with a table of its suppliers, read back: the nation spans all rows, a heading two columns."""
    row = F.concat(F.lit("<td>"), "s_suppkey", F.lit('</td><td><b>'), "s_name", F.lit('</b> <a href="../a/'), "s_suppkey", F.lit('"></a></td></tr>'))
    lines = t.supplier.groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", row.alias("row")))).alias("rows"))
    pages = lines.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("s_nationkey").alias("nation"), F.lit("https://example.org/x/list.html?a=1").alias("url"),
        F.concat(F.lit("<html><body><TABLE><tr><th colspan=2>Where &amp; who<th>Name</tr><tr><td rowspan='"), F.size("rows"), F.lit("'><a href='/n/"), "s_nationkey", F.lit("'>"), "n_name", F.lit("</a></td>"), F.array_join(F.transform("rows", lambda r: r["row"]), "<tr>"), F.lit("</table>")).alias("html"),
    )
    return html.html_tables(pages, "nation").select("nation", "row_no", "column_no", "header", "covered", "text", F.coalesce(F.get("links", F.lit(0)), F.lit("")).alias("link"))


@query("""WITH o AS (SELECT o_orderkey % 100 AS k, o_orderkey, o_orderstatus || '/' || o_orderpriority AS c FROM orders), v AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o_orderkey) AS r FROM o),
last AS (SELECT k, arg_max(c, r) AS c FROM v WHERE r <= 3 GROUP BY k), seen AS (SELECT DISTINCT k, c FROM v WHERE r BETWEEN 4 AND 9)
SELECT CASE WHEN last.c IS NULL THEN 'new' WHEN last.c = seen.c THEN 'duplicate' ELSE 'changed' END AS outcome, count(*) AS n FROM seen LEFT JOIN last USING (k) GROUP BY 1""")
def ingest_outcomes(t: Tables) -> DataFrame:
    """Versions of records in two slices: one that goes back to older content is changed, only the latest counts."""
    c = F.concat("o_orderstatus", F.lit("/"), "o_orderpriority")
    o = t.orders.select(F.lit("orders").alias("sourceKey"), (F.col("o_orderkey") % 100).cast("string").alias("externalId"), c.alias("content"), F.row_number().over(Window.partitionBy(F.col("o_orderkey") % 100).orderBy("o_orderkey")).alias("version"))
    mark = scalars.fingerprint(F.col("content"), F.col("externalId"), F.col("sourceKey"))
    old = o.filter("version <= 3").select("sourceKey", "externalId", mark.alias("fingerprint"), "version")
    return loaders.ingest(old, o.filter("version between 4 and 9").drop("version"))[1]


_FOUND = """f AS (SELECT o_orderkey AS key, CASE o_orderkey % 3 WHEN 0 THEN 'binding_name_match' WHEN 1 THEN 'alias_export' ELSE 'trade_export' END AS kind, 'r' || o_custkey % 7 AS rule, o_totalprice / 500000 AS trust, o_orderkey % 5 = 0 AS strict FROM orders WHERE o_orderkey % 4 < 3),
h AS (SELECT 'r' || o_custkey % 7 AS rule, count(*) AS decisions, count(*) FILTER (o_custkey % 7 < 3 OR o_orderkey % 2 = 0) AS accepts FROM orders WHERE o_custkey % 7 <> 2 OR o_orderkey < 50 GROUP BY 1),
o AS (SELECT o_orderkey AS key, 'binding_name_match' AS kind, 'old' AS rule, 0.6::DOUBLE AS trust, CASE o_orderkey % 12 WHEN 0 THEN 'pending' WHEN 4 THEN 'rejected' ELSE 'accepted' END AS status, CASE WHEN o_orderkey % 12 > 0 THEN 'person' END AS decided_by FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 3 < 2 OR o_orderkey % 24 = 3),
c AS (SELECT coalesce(o.key, f.key) AS key, f.key IS NOT NULL AS here, o.key IS NOT NULL AS was, coalesce(o.status = 'pending', true) AS waits, o.status AS os, o.decided_by AS od, o.kind AS ok, o.rule AS orule, o.trust AS ot, f.kind AS fk, f.rule AS fr, f.trust AS ft, coalesce(fk = 'binding_name_match' AND strict, false) AS sb,
coalesce(f.kind <> 'binding_name_match' AND decisions >= 10 AND accepts / decisions::DOUBLE >= 0.95, false) AS pv FROM o FULL JOIN (SELECT f.*, decisions, accepts FROM f LEFT JOIN h USING (rule) WHERE trust >= 0.55) f ON f.key = o.key)"""


def _queue(t: Tables) -> tuple[DataFrame, DataFrame]:
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 7
    rule = F.concat(F.lit("r"), c)
    kind = F.when(k % 3 == 0, observations.BINDING).when(k % 3 == 1, "alias_export").otherwise("trade_export")
    found = t.orders.filter(k % 4 < 3).select(k.alias("key"), kind.alias("kind"), rule.alias("rule"), (F.col("o_totalprice") / 500000).alias("trust"), (k % 5 == 0).alias("strict"))
    history = t.orders.filter((c != 2) | (k < 50)).groupBy(rule.alias("rule")).agg(F.count("*").alias("decisions"), F.count_if((c < 3) | (k % 2 == 0)).alias("accepts"))
    status = F.when(k % 12 == 0, "pending").when(k % 12 == 4, "rejected").otherwise("accepted")
    stored = t.orders.filter(((k % 4 == 0) & (k % 3 < 2)) | (k % 24 == 3)).select(k.alias("key"), F.lit(observations.BINDING).alias("kind"), F.lit("old").alias("rule"), F.lit(0.6).alias("trust"), status.alias("status"), F.when(k % 12 > 0, "person").alias("decided_by"))
    return observations.queued(stored, found, history)


@query(f"""WITH {_FOUND} SELECT key, CASE WHEN here AND waits THEN fk ELSE ok END AS kind, CASE WHEN here AND waits THEN fr ELSE orule END AS rule, CASE WHEN here AND waits THEN ft ELSE ot END AS trust, CASE WHEN here AND sb AND waits OR here AND NOT was AND pv THEN 'accepted' WHEN was THEN os ELSE 'pending' END AS status,
CASE WHEN here AND sb AND waits THEN 'auto:strict-bind' WHEN here AND NOT was AND pv THEN 'auto:rule-history' ELSE od END AS decided_by FROM c""")
def observation_queue(t: Tables) -> DataFrame:
    return _queue(t)[0]


@query(f"""WITH {_FOUND} SELECT CASE WHEN here AND sb AND waits THEN 'bound' WHEN here AND NOT was AND pv THEN 'accepted' WHEN here AND NOT was THEN 'queued' WHEN here AND waits THEN 'rescored' WHEN here THEN 'kept' ELSE 'not_found' END AS outcome, count(*) AS n FROM c GROUP BY 1
UNION ALL SELECT 'below_floor', count(*) FROM f WHERE trust < 0.55""")
def observation_summary(t: Tables) -> DataFrame:
    return _queue(t)[1]


@query("""WITH i AS (SELECT l_suppkey % 10 AS account, l_shipdate AS period_end, l_partkey AS opportunity, l_orderkey AS project, l_returnflag = 'N' AS is_new FROM lineitem), e AS (SELECT o_orderkey AS project, o_orderdate AS at_ FROM orders WHERE o_orderkey % 50 > 0),
c AS (SELECT account, count(*) AS items, count(*) FILTER (at_ IS NULL OR epoch(period_end - at_) / 86400 > 180) AS expired FROM i LEFT JOIN e USING (project) GROUP BY 1), n AS (SELECT account, sum(k - 1)::BIGINT AS duplicate_new FROM (SELECT account, opportunity, count(*) AS k FROM i WHERE is_new GROUP BY 1, 2) GROUP BY 1)
SELECT account, items, expired, coalesce(duplicate_new, 0) AS duplicate_new, coalesce(duplicate_new, 0) / items::DOUBLE AS duplicate_rate, expired / items::DOUBLE AS expired_rate, coalesce(duplicate_new, 0) / items::DOUBLE < 0.03 AS duplicate_pass, expired / items::DOUBLE < 0.02 AS expired_pass FROM c LEFT JOIN n USING (account)""")
def delivery_quality(t: Tables) -> DataFrame:
    li = t.lineitem
    items = li.select((F.col("l_suppkey") % 10).alias("account"), F.lit(1).alias("delivery"), F.col("l_shipdate").alias("period_end"), F.col("l_partkey").alias("opportunity"), F.col("l_orderkey").alias("project"), (F.col("l_returnflag") == "N").alias("is_new"))
    events = t.orders.filter("o_orderkey % 50 > 0").select(F.col("o_orderkey").alias("project"), F.col("o_orderdate").alias("at"))
    return observations.delivery_quality(items, events)


@query("""WITH q AS (SELECT p_partkey AS r_id, list_distinct(string_split(p_name || ' ' || p_brand || ' ' || p_type, ' ')) AS w FROM part), l AS (SELECT p_partkey AS l_id, list_distinct(string_split(p_name || ' ' || p_brand, ' ')) AS w FROM part WHERE p_size < 10),
t AS (SELECT r_id, unnest(w) AS tok FROM q), rare AS (SELECT tok FROM t GROUP BY tok HAVING count(*) <= 400), m AS (SELECT DISTINCT l_id, r_id FROM (SELECT l_id, unnest(w) AS tok FROM l) JOIN rare USING (tok) JOIN t USING (tok))
SELECT l_id, min(r_id) AS r_id FROM m JOIN l USING (l_id) JOIN q USING (r_id) WHERE len(list_intersect(l.w, q.w)) = len(l.w) AND len(q.w) > len(l.w) GROUP BY 1 HAVING count(*) = 1""")
def containment_match(t: Tables) -> DataFrame:
    left = t.part.filter("p_size < 10").select(F.col("p_partkey").alias("l_id"), F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_brand"), " ")).alias("l_tokens"))
    right = t.part.select(F.col("p_partkey").alias("r_id"), F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_brand", "p_type"), " ")).alias("r_tokens"))
    return ops.contained_match(left, right)


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN replace(url, '#', '') || '?a=1&token=%5Bredacted%5D&b=2' WHEN 1 THEN 'x?key=1' ELSE url END AS url FROM pages WHERE NOT contains(url, '?')""")
def redacted_urls(t: Tables) -> DataFrame:
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.replace("url", F.lit("#"), F.lit("")), F.lit("?a=1&token=s3cret&b=2"))).when(F.col("page_id") % 3 == 1, "x?key=1").otherwise(F.col("url"))
    return t.pages.filter(~F.col("url").contains("?")).select("page_id", scalars.redact_url(url).alias("url"))


_REVIEWS = """rv AS (SELECT o_orderkey AS review, CASE o_orderkey % 3 WHEN 0 THEN 'official_id' WHEN 1 THEN 'parcel_overlap' ELSE 'address_name' END AS rule, CASE o_orderkey % 3 WHEN 0 THEN 'same_permit_pending_review' WHEN 1 THEN '' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'generic_name' ELSE 'same_address_name_mismatch' END END AS reason,
CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 20 END AS candidate, o_orderdate AS at_ FROM orders WHERE o_orderstatus = 'P')"""


def _reviews(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    named = F.when(k % 2 == 0, "generic_name").otherwise("same_address_name_mismatch")
    reasons = F.when(k % 3 == 0, F.array(F.lit("same_permit_pending_review"))).when(k % 3 == 2, F.array(named, F.lit("same_address")))
    rule = F.when(k % 3 == 0, "official_id").when(k % 3 == 1, "parcel_overlap").otherwise("address_name")
    return t.orders.filter("o_orderstatus = 'P'").select(k.alias("review"), k.alias("record"), rule.alias("rule"), reasons.alias("reasons"), F.when(k % 5 > 0, F.col("o_custkey") % 20).alias("candidate"), F.col("o_orderdate").alias("at"))


@query(f"""WITH {_REVIEWS}, p AS (SELECT *, row_number() OVER (PARTITION BY rule, reason, candidate ORDER BY at_, review) AS place FROM rv)
SELECT rule, reason, candidate, count(*) AS n, min(at_)::DATE AS oldest, string_agg(review::VARCHAR, ',' ORDER BY place) FILTER (place <= 3) AS samples, CASE WHEN reason = 'same_permit_pending_review' THEN 'awaiting' ELSE 'actionable' END AS state FROM p GROUP BY 1, 2, 3""")
def review_triage(t: Tables) -> DataFrame:
    rows = reviews.triage(_reviews(t))
    return rows.withColumns({"oldest": F.col("oldest").cast("date"), "samples": F.array_join(F.transform("samples", lambda s: s.cast("string")), ",")})


@query(f"""WITH {_REVIEWS}, pv AS (SELECT l_orderkey AS record, min(CASE l_returnflag WHEN 'R' THEN 'merged' ELSE 'review' END) AS now, max(CASE l_linenumber % 2 WHEN 0 THEN 'official_id' ELSE 'parcel_overlap' END) AS rule, min(l_suppkey % 20) AS project FROM lineitem GROUP BY 1)
SELECT review, CASE WHEN now = 'merged' AND pv.rule = 'official_id' AND (candidate IS NULL OR candidate = project) THEN 'clears' WHEN now = 'merged' AND pv.rule = 'official_id' THEN 'mismatch' ELSE 'stays' END AS verdict FROM rv LEFT JOIN pv ON pv.record = rv.review""")
def review_looks(t: Tables) -> DataFrame:
    """What a new look clears, without a person, of the reviews that wait."""
    now = F.when(F.col("l_returnflag") == "R", "merged").otherwise("review")
    rule = F.when(F.col("l_linenumber") % 2 == 0, "official_id").otherwise("parcel_overlap")
    previews = t.lineitem.groupBy(F.col("l_orderkey").alias("record")).agg(F.min(now).alias("now"), F.max(rule).alias("rule"), F.min(F.col("l_suppkey") % 20).alias("project"))
    return reviews.reevaluated(_reviews(t).select("review", "record", "candidate"), previews)


@query(f"""WITH {_LOG}, last AS (SELECT subject, max(at_) FILTER (action = 'undo') AS undo FROM log GROUP BY 1), d AS (SELECT subject, arg_min(action, at_) AS action FROM log JOIN last USING (subject) WHERE action IN ('merge', 'reject') AND (undo IS NULL OR at_ > undo) GROUP BY 1),
o AS (SELECT DISTINCT user_id * 100 + day(ts) AS subject FROM events WHERE value > 30 UNION SELECT -1)
SELECT subject, CASE action WHEN 'merge' THEN 'merged' WHEN 'reject' THEN 'rejected' ELSE 'pending' END AS state FROM o LEFT JOIN d USING (subject)""")
def review_overlay(t: Tables) -> DataFrame:
    seen = t.events.filter("value > 30").select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("subject")).distinct().union(t.spark.createDataFrame([(-1,)], "subject long"))
    return reviews.overlaid(seen, _log(t)).select("subject", "state")
