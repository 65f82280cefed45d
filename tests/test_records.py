import datetime
import random

import pytest
from pyspark.sql import functions as F

from cairnworks.functions import jsons
from cairnworks.operators import reviews
from cairnworks.sources import html_tables, publishing
from cairnworks.streaming import append


def fold(actions):
    state, since, effects = "pending", None, []
    for at, action in actions:
        if action in ("merge", "reject"):
            effects.append((at, state == "pending"))
            if state == "pending":
                state, since = {"merge": "merged", "reject": "rejected"}[action], at
        elif action == "undo":
            effects.append((at, state != "pending"))
            state, since = "pending", None
    return state, since, effects


def test_review_log_equals_a_fold(spark):
    draw = random.Random(2)
    rows = [(s, at, draw.choice(("merge", "reject", "undo", "note", None))) for s in range(60) for at in range(draw.randint(1, 9))]
    draw.shuffle(rows)
    log = spark.createDataFrame(rows, "subject long, at long, action string")
    want = {s: fold(sorted((at, a) for x, at, a in rows if x == s and a)) for s in range(60)}
    assert {r["subject"]: (r["state"], r["since"]) for r in reviews.review_state(log).collect()} == {s: w[:2] for s, w in want.items()}
    got = {}
    for r in reviews.review_history(log).collect():
        got.setdefault(r["subject"], []).append((r["at"], r["took_effect"]))
    assert {s: sorted(v) for s, v in got.items()} == {s: w[2] for s, w in want.items() if w[2]}
    seen = reviews.overlaid(spark.createDataFrame([(1, "x"), (999, "y")], "subject long, note string"), log)
    assert {r["subject"]: r["state"] for r in seen.collect()} == {1: want[1][0], 999: "pending"}


def test_the_state_needs_no_window(spark):
    log = spark.createDataFrame([(1, 1, "merge")], "subject long, at long, action string")
    assert "Window" not in reviews.review_state(log)._jdf.queryExecution().executedPlan().toString()


def test_triage_and_new_looks(spark):
    rows = [(i, "address_name", ["generic_name", "x"], 5, i) for i in range(5)] + [(9, "official_id", ["same_permit_pending_review"], None, 1), (10, "parcel_overlap", None, None, 2)]
    got = {(r["rule"], r["reason"], r["candidate"]): (r["n"], r["oldest"], r["samples"], r["state"]) for r in reviews.triage(spark.createDataFrame(rows, "review long, rule string, reasons array<string>, candidate long, at long")).collect()}
    assert got == {("address_name", "generic_name", 5): (5, 0, [0, 1, 2], "actionable"), ("official_id", "same_permit_pending_review", None): (1, 1, [9], "awaiting"), ("parcel_overlap", "", None): (1, 2, [10], "actionable")}
    pending = spark.createDataFrame([(1, 1, 7), (2, 2, 7), (3, 3, None), (4, 4, 7), (5, 5, 7)], "review long, record long, candidate long")
    now = spark.createDataFrame([(1, "merged", "official_id", 7), (2, "merged", "official_id", 8), (3, "merged", "explicit_reference", 8), (4, "merged", "parcel_overlap", 7)], "record long, now string, rule string, project long")
    assert {r["review"]: r["verdict"] for r in reviews.reevaluated(pending, now).collect()} == {1: "clears", 2: "mismatch", 3: "clears", 4: "stays", 5: "stays"}


@pytest.mark.parametrize(("text", "wanted", "holds"), [
    ('{"a": 1, "b": {"c": [1, 2]}}', {"b": {"c": [2]}}, True), ('{"a": 1}', {"a": "1"}, False), ('{"a": "1"}', {"a": 1}, False), ('{"a": 1.0}', {"a": 1}, True), ('{"a": null}', {"a": None}, True), ('{}', {"a": None}, False),
    ("[1, [2, 3]]", [[3]], True), ("[1, 2]", 2, True), ('["x"]', "x", True), ('{"a": [1]}', {"a": 1}, False), ("{}", {}, True), ("[]", {}, False), ('{"a": true}', {"a": True}, True), ("5", 5, True), ('{"it\'s": 1}', {"it's": 1}, True), ('{"a\'b\\"": [1]}', {"a'b\"": [1]}, True), ("not json", {}, None), (None, {}, None),
])
def test_json_containment(spark, text, wanted, holds):
    v = jsons.variant(F.lit(text).cast("string"))
    assert spark.range(1).select(v.alias("v")).select(jsons.contains(F.col("v"), wanted).alias("c")).first()["c"] is holds


def test_json_keys(spark):
    rows = [('{"a": null}', True), ('{"b": 1}', False), ('["a", 1]', True), ('"a"', True), ("1", False), (None, None)]
    got = spark.createDataFrame(rows, "t string, want boolean").select("want", jsons.has_key(jsons.variant(F.col("t")), "a").alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


PAGE = """<table><tr><th colspan=2>A &amp; B<th>C</tr><tr><td rowspan="2">x<td>1 &nbsp;2<script>var t = "<td>";</script><td><a href="/p?q=1&amp;r=2">l</a><a href="javascript:x">j</a></tr>
<tr><td><table><tr><td>inner</table>out<td rowspan=9 colspan='z'>&euro;&#8364;</table><p>no table</p>"""


def test_html_tables(spark):
    rows = spark.createDataFrame([(1, "https://x.org/a/b", PAGE), (2, None, None), (3, "u", ""), (4, None, "<p>a</p>"), (5, None, "<TABLE><td>t")], "page_id long, url string, html string")
    got = {}
    for r in html_tables.html_tables(rows, "page_id").collect():
        got.setdefault((r["page_id"], r["table_no"]), {})[r["row_no"], r["column_no"]] = (r["text"], r["header"], r["covered"], r["links"])
    assert got[1, 0] == {
        (0, 0): ("A & B", True, False, []), (0, 1): ("A & B", True, True, []), (0, 2): ("C", True, False, []), (1, 0): ("x", False, False, []), (1, 1): ("1 2", False, False, []), (1, 2): ("lj", False, False, ["https://x.org/p?q=1&r=2"]),
        (2, 0): ("x", False, True, []), (2, 1): ("out", False, False, []), (2, 2): ("€€", False, False, []),
    }
    assert got[1, 1] == {(0, 0): ("inner", False, False, [])} and got[5, 0] == {(0, 0): ("t", False, False, [])} and len(got) == 3


def test_publishing(spark, tmp_path):
    folder = str(tmp_path / "p")
    rows = lambda n: lambda: spark.range(n).withColumn("v", F.lit("x"))
    state = lambda: sorted(r["id"] for r in publishing.published(spark, folder).collect())
    assert publishing.published(spark, folder) is None
    assert publishing.publish(rows(0), spark, folder) == ("skipped", "no rows") and publishing.published(spark, folder) is None
    assert publishing.publish(rows(3), spark, folder) == ("published", None) and state() == [0, 1, 2]
    assert publishing.publish(rows(3), spark, folder) == ("unchanged", None)
    assert publishing.publish(rows(0), spark, folder) == ("skipped", "no rows") and state() == [0, 1, 2]
    assert publishing.publish(rows(2), spark, folder, lambda df: df.count() > 2) == ("skipped", "refused") and state() == [0, 1, 2]

    def offline():
        raise OSError("no view")

    assert publishing.publish(offline, spark, folder) == ("skipped", "failed: OSError") and state() == [0, 1, 2]
    outcome, reason = publishing.publish(lambda: spark.range(5).select(F.raise_error(F.lit("broken")).alias("id")), spark, folder)
    assert outcome == "skipped" and reason.startswith("failed") and state() == [0, 1, 2]
    assert publishing.publish(rows(4), spark, folder) == ("published", None) and state() == [0, 1, 2, 3]


EVENT = "source string, project long, kind string, at timestamp_ntz, note string"


def day(d):
    return datetime.datetime(2024, 1, d)


def keys_of(spark, folder):
    return sorted(map(str, ((r["source"], r["project"], r["kind"], r["at"], r["note"]) for r in append.appended(spark, folder).collect())))


def test_a_batch_killed_at_any_point_is_appended_once(spark, tmp_path, monkeypatch):
    batches = [
        [("a", 1, "issued", day(1), "x"), ("a", 1, "issued", day(1), "y"), ("b", 2, None, None, "x")],
        [("a", 1, "issued", day(1), "later"), ("a", 3, "issued", day(4), "x"), ("b", 2, None, None, "again"), ("b", 4, "issued", day(2), "x")],
        [("a", 3, "issued", day(4), "again"), ("a", 1, "closed", day(9), "x")],
    ]
    frames = [spark.createDataFrame(b, EVENT) for b in batches]
    want = str(tmp_path / "whole")
    run = append.append_once(want, ["project", "kind", "at"], "at")
    for i, frame in enumerate(frames):
        run(frame, i)
    assert len(keys_of(spark, want)) == 5

    from pyspark.sql.readwriter import DataFrameWriter

    real = DataFrameWriter.parquet
    for broken in ("events", "marks"):
        folder = str(tmp_path / broken)
        run = append.append_once(folder, ["project", "kind", "at"], "at")
        run(frames[0], 0)

        def parquet(self, path, *a, broken=broken, **k):
            if f"/{broken}/" in path:
                raise RuntimeError("killed")
            return real(self, path, *a, **k)

        monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
        with pytest.raises(RuntimeError):
            run(frames[1], 1)
        monkeypatch.setattr(DataFrameWriter, "parquet", real)
        run(frames[1], 1)
        run(frames[1], 1)
        run(frames[2], 2)
        assert keys_of(spark, folder) == keys_of(spark, want)
        rest = append.read_since(spark.createDataFrame([("a", 9, "x", day(5), ""), ("a", 9, "x", day(7), ""), ("b", 9, "x", day(1), ""), ("c", 9, "x", day(1), ""), ("a", 9, "x", None, "")], EVENT), folder, "at")
        assert sorted((r["source"], str(r["at"])) for r in rest.collect()) == [("a", "2024-01-07 00:00:00"), ("a", "None"), ("b", "2024-01-01 00:00:00"), ("c", "2024-01-01 00:00:00")]


def test_a_stream_that_dies_goes_on_where_it_was(spark, tmp_path):
    for d in range(1, 5):
        rows = [("a", p, "issued", day(d + p % 2), f"{d}") for p in range(d, d + 3)]
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    real, calls = append.append_once(str(tmp_path / "out"), ["project", "kind", "at"], "at"), []

    def dies_once(rows, batch):
        real(rows, batch)
        calls.append(batch)
        if calls == [0, 1]:
            raise RuntimeError("killed after the write, before the batch counts")

    def start():
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return stream.writeStream.foreachBatch(dies_once).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    start().awaitTermination()
    assert calls == [0, 1, 1, 2, 3]
    got = [(r["project"], r["at"]) for r in append.appended(spark, str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(p, day(d + p % 2)) for d in range(1, 5) for p in range(d, d + 3)}
