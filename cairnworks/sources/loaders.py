"""Readers of source payloads as DataFrames of one record schema, and file sinks.

Nothing is guessed: a record that lacks a required field or breaks the contract goes to `rejected` with its reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnworks.functions import scalars

RECORD = T.StructType(
    [
        T.StructField("sourceKey", T.StringType()), T.StructField("externalId", T.StringType()), T.StructField("recordType", T.StringType()), T.StructField("title", T.StringType()),
        T.StructField("permittingJurisdiction", T.StringType()), T.StructField("county", T.StringType()), T.StructField("description", T.StringType()), T.StructField("city", T.StringType()),
        T.StructField("addressRaw", T.StringType()), T.StructField("applicationType", T.StringType()), T.StructField("permitType", T.StringType()), T.StructField("documentType", T.StringType()),
        T.StructField("statusRaw", T.StringType()), T.StructField("normalizedStage", T.StringType()), T.StructField("parcelIds", T.ArrayType(T.StringType())),
        T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType()), T.StructField("applicationDate", T.DateType()), T.StructField("issueDate", T.DateType()),
        T.StructField("sourceUpdatedAt", T.TimestampType()), T.StructField("valuationUsd", T.DoubleType()), T.StructField("squareFeet", T.DoubleType()), T.StructField("units", T.IntegerType()), T.StructField("lots", T.IntegerType()),
        T.StructField("organizations", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("role", T.StringType()), T.StructField("phone", T.StringType())]))),
    ]
)
REQUIRED = ("sourceKey", "externalId", "recordType", "title", "permittingJurisdiction")


def as_record(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """df's rows in the record schema; fields that are not given are typed nulls."""
    return df.select(*((fields[f.name] if f.name in fields else F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD.fields))


def any_date(value: Column) -> Column:
    """A date from epoch milliseconds, an ISO string or m/d/y; null for anything else."""
    text = value.cast("string")
    epoch = F.when(text.rlike(r"^-?\d{11,14}$"), F.timestamp_seconds(F.floor(text.try_cast("bigint") / 1000)).cast("date"))
    return F.coalesce(epoch, F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date"), F.try_to_timestamp(text, F.lit("M/d/yyyy")).cast("date"))


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with `reason`): required fields, positive numbers, and dates in order."""
    missing = F.array_compact(F.array(*(F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"{c} is missing")) for c in REQUIRED)))
    wrong = F.array_compact(F.array(*(F.when(F.col(c) <= 0, F.lit(f"{c} is not positive")) for c in ("valuationUsd", "squareFeet", "units", "lots")), F.when(F.col("issueDate") < F.col("applicationDate"), "issued before applied")))
    judged = records.withColumn("_reasons", F.concat(missing, wrong))
    return judged.filter(F.size("_reasons") == 0).drop("_reasons"), judged.filter(F.size("_reasons") > 0).withColumn("reason", F.array_join("_reasons", "; ")).drop("_reasons")


def permits_json(spark: SparkSession, path: str, source: str) -> DataFrame:
    """{jurisdiction, county, permits: [...]} files, one document each."""
    permit = "permit_number string, title string, description string, address string, parcel string, permit_type string, status string, stage string, application_date string, issue_date string, valuation double, applicant string"
    files = spark.read.schema(f"jurisdiction string, county string, permits array<struct<{permit.replace(' string', ':string').replace(' double', ':double')}>>").option("multiLine", True).json(path)
    p = files.select("jurisdiction", "county", F.explode("permits").alias("p"))
    org = F.when(F.col("p.applicant").isNotNull(), F.array(F.struct(F.col("p.applicant").alias("name"), F.lit("applicant").alias("role"), F.lit(None).cast("string").alias("phone"))))
    return as_record(p, {
        "sourceKey": F.lit(source), "externalId": F.col("p.permit_number"), "recordType": F.lit("building_permit"), "title": F.col("p.title"), "permittingJurisdiction": F.col("jurisdiction"), "county": F.col("county"),
        "description": F.col("p.description"), "addressRaw": F.col("p.address"), "permitType": F.col("p.permit_type"), "statusRaw": F.col("p.status"), "normalizedStage": F.col("p.stage"),
        "parcelIds": F.when(F.col("p.parcel").isNotNull(), F.array("p.parcel")), "applicationDate": any_date(F.col("p.application_date")), "issueDate": any_date(F.col("p.issue_date")), "valuationUsd": F.col("p.valuation"), "organizations": org,
    })


def arcgis(spark: SparkSession, path: str, source: str, jurisdiction: str, field_map: dict[str, str], mercator: bool = True) -> DataFrame:
    """Pages of a feature layer; field_map names the attribute of each record field."""
    pages = spark.read.schema("features array<struct<attributes:map<string,string>,geometry:struct<x:double,y:double>>>").option("multiLine", True).json(path)
    f = pages.select(F.explode("features").alias("f"))
    get = {k: F.element_at(F.col("f.attributes"), F.lit(a)) for k, a in field_map.items()}
    for k in ("applicationDate", "issueDate"):
        if k in get:
            get[k] = any_date(get[k])
    x, y = F.col("f.geometry.x"), F.col("f.geometry.y")
    place = {"lon": scalars.mercator_lon(x), "lat": scalars.mercator_lat(y)} if mercator else {"lon": x, "lat": y}
    fixed = {"sourceKey": F.lit(source), "permittingJurisdiction": F.lit(jurisdiction), "recordType": F.lit("building_permit")}
    return as_record(f, fixed | place | {k: (v.try_cast(RECORD[k].dataType) if RECORD[k].dataType != T.StringType() else v) for k, v in get.items()})


def socrata(spark: SparkSession, path: str, source: str, jurisdiction: str, field_map: dict[str, str], since: str | None = None, overlap_days: int = 0) -> DataFrame:
    """Flat JSON rows; only those updated since the last mark less an overlap, which later deduplicates by fingerprint."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("r"))
    get = {k: F.element_at("r", F.lit(a)) for k, a in field_map.items()}
    made = as_record(rows, {"sourceKey": F.lit(source), "permittingJurisdiction": F.lit(jurisdiction), "recordType": F.lit("building_permit")} | {k: any_date(v) if k.endswith("Date") else (v if RECORD[k].dataType == T.StringType() else v.try_cast(RECORD[k].dataType)) for k, v in get.items()})
    return made if since is None else made.filter(F.col("applicationDate") >= F.date_sub(F.lit(since).cast("date"), overlap_days))


def html_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, title, text (tags, scripts and entities gone), links (absolute targets of http and https links)."""
    return parsed_html(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html")), "html").drop("html")


def parsed_html(df: DataFrame, column: str) -> DataFrame:
    html = F.col(column)
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    links = F.filter(F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1)), lambda x: x.rlike(r"(?i)^(https?:)?//|^/|^[^:]*$"))
    return df.select("*", F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")).alias("title"), F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("text"), links.alias("links"))


def emails(spark: SparkSession, path: str) -> DataFrame:
    """Messages with headers unfolded, and labelled lines of invitations; only an explicit invitation counts as one."""
    m = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r\n", "\n").alias("raw"))
    head, body = F.regexp_replace(F.substring_index("raw", "\n\n", 1), r"\n[ \t]+", " "), F.substr("raw", F.instr("raw", "\n\n") + 2)
    header = lambda name: F.nullif(F.regexp_extract(head, rf"(?im)^{name}:\s*(.*)$", 1), F.lit(""))
    line = lambda name: F.nullif(F.trim(F.regexp_extract(body, rf"(?im)^{name}:\s*(.*)$", 1)), F.lit(""))
    return m.select(header("From").alias("sender"), header("Subject").alias("subject"), header("Message-ID").alias("message_id"), line("Project").alias("project"), line("Bids due").alias("bids_due"), (line("Project").isNotNull() & F.concat_ws(" ", header("Subject"), body).rlike(r"(?i)\b(invitation|invited) to bid\b")).alias("is_invitation"))


def canaries_apart(records: DataFrame) -> DataFrame:
    """Records without source canaries, which never become projects."""
    return records.filter(F.col("recordType") != "source_canary")


def with_columns(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """df in the wanted schema; columns that it lacks are typed nulls."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields))


def write_csv(df: DataFrame, path: str) -> None:
    """RFC 4180 lines with CRLF, embedded line ends as they are; without a header, as every part file would repeat it."""
    lines = df.select(F.concat_ws(",", *(scalars.csv_field(F.col(c).cast("string")) for c in df.columns)).alias("value"))
    lines.write.option("lineSep", "\r\n").text(path)


def payload(df: DataFrame, generated_at: str) -> DataFrame:
    """One JSON line {source, generatedAt, record} for each row; a sink that grows with the rows, unlike one document of all."""
    return df.select(F.to_json(F.struct(F.lit("cairnworks").alias("source"), F.lit(generated_at).alias("generatedAt"), F.struct(*df.columns).alias("record"))).alias("value"))


def ingest(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(appended or changed records, outcome counts) by fingerprint of the whole record: old(sourceKey, externalId, fingerprint[, version]).

    A record is compared with its latest stored version; without a version column, with any of those stored.
    """
    marked = new.withColumn("fingerprint", scalars.fingerprint(*(F.col(c) for c in sorted(new.columns))))
    keys = ["sourceKey", "externalId"]
    if "version" in old.columns:
        known = old.groupBy(*keys).agg(F.max_by("fingerprint", "version").alias("fingerprint"))
    else:
        known = old.select(*keys, "fingerprint").distinct()
    judged = marked.dropDuplicates([*keys, "fingerprint"])
    judged = judged.join(known.withColumn("_same", F.lit(True)), [*keys, "fingerprint"], "left").join(known.select(*keys).distinct().withColumn("_seen", F.lit(True)), keys, "left")
    judged = judged.withColumn("outcome", F.when(F.col("_same"), "duplicate").when(F.col("_seen"), "changed").otherwise("new")).drop("_same", "_seen")
    return judged.filter("outcome <> 'duplicate'"), judged.groupBy("outcome").agg(F.count("*").alias("n"))
