import json

from pyspark.sql import functions as F

from cairnworks.sources import loaders


def test_permits_with_a_malformed_row(spark, tmp_path):
    permits = [
        {"permit_number": "B-1", "title": "Tower", "permit_type": "Commercial", "parcel": "12345678", "application_date": "2026-05-01", "issue_date": "2026-06-01", "valuation": 10.0, "applicant": "Acme LLC"},
        {"permit_number": None, "title": "No number", "application_date": "someday", "valuation": -1},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"jurisdiction": "Lacey", "county": "Thurston", "permits": permits}, indent=1))
    good, bad = loaders.split_valid(loaders.permits_json(spark, str(tmp_path), "fake"))
    assert [(r["externalId"], str(r["issueDate"]), r["organizations"][0]["name"]) for r in good.collect()] == [("B-1", "2026-06-01", "Acme LLC")]
    assert [r["reason"] for r in bad.collect()] == ["externalId is missing; valuationUsd is not positive"]
    first, counts = loaders.ingest(spark.createDataFrame([], "sourceKey string, externalId string, fingerprint string"), good)
    assert {r["outcome"]: r["n"] for r in counts.collect()} == {"new": 1}
    again, counts = loaders.ingest(first.select("sourceKey", "externalId", "fingerprint"), good)
    assert again.count() == 0 and {r["outcome"]: r["n"] for r in counts.collect()} == {"duplicate": 1}


def test_arcgis_and_socrata(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.json").write_text(json.dumps({"features": [{"attributes": {"NO": "1", "APPLIED": 1767225600000, "VALUE": "12.5"}, "geometry": {"x": -13670000.0, "y": 5950000.0}}]}))
    row = loaders.arcgis(spark, str(tmp_path / "p"), "t", "Tumwater", {"externalId": "NO", "applicationDate": "APPLIED", "valuationUsd": "VALUE"}).first()
    assert (row["externalId"], str(row["applicationDate"]), row["valuationUsd"]) == ("1", "2026-01-01", 12.5) and -123 < row["lon"] < -122 and 46 < row["lat"] < 48
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "1.json").write_text(json.dumps([{"n": "1", "d": "2026-01-10T00:00:00.000", "u": "x"}, {"n": "2", "d": "2025-01-10", "u": "3"}]))
    got = loaders.socrata(spark, str(tmp_path / "s"), "s", "Seattle", {"externalId": "n", "applicationDate": "d", "units": "u"}, since="2026-01-12", overlap_days=5).collect()
    assert [(r["externalId"], r["units"]) for r in got] == [("1", None)]


def test_html_and_mail(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.html").write_text('<html><title> A &amp; B </title><script>var x = "<a>";</script><p>One&nbsp;<b>two</b> &lt;3</p><a class="x" href="/permits/1">p</a><a href="javascript:void(0)">j</a></html>')
    page = loaders.html_pages(spark, str(tmp_path / "h")).first()
    assert page["links"] == ["/permits/1"] and "One two <3" in page["text"] and "var x" not in page["text"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.eml").write_text("From: gc@x.com\r\nSubject: Invitation to bid:\r\n Harbor\r\nMessage-ID: <1>\r\n\r\nProject: Harbor Tower\r\nBids due: 1/2/2026\r\n")
    (tmp_path / "m" / "b.eml").write_text("From: y\nSubject: lunch\nDate: bogus\n\nProject: none of yours\n")
    got = {r["sender"]: r for r in loaders.emails(spark, str(tmp_path / "m")).collect()}
    assert got["gc@x.com"]["is_invitation"] and got["gc@x.com"]["project"] == "Harbor Tower" and got["gc@x.com"]["subject"] == "Invitation to bid: Harbor"
    assert not got["y"]["is_invitation"]


def test_csv_keeps_line_ends(spark, tmp_path):
    rows = spark.createDataFrame([("a\nb", 'say "x"', None)], "p string, q string, r string").coalesce(1)
    loaders.write_csv(rows, str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_bytes() == b'"a\nb","say ""x""",\r\n'
    assert json.loads(loaders.payload(rows, "2026-01-01").first()["value"])["record"]["q"] == 'say "x"'


def test_missing_columns_are_typed_nulls(spark):
    df = loaders.with_columns(spark.createDataFrame([("k",)], "sourceKey string").withColumn("junk", F.lit(1)), loaders.RECORD)
    assert df.columns == loaders.RECORD.names and df.first()["units"] is None
