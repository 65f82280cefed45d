"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a size in words. The mix holds `budget` times all words; a source's target is
its share by weight, clamped at `max_epochs` times its size, and what the clamp takes off is shared among
the others by weight until none is above its clamp. A document is then taken floor(target / size) times
whole, and the missing fraction is made of whole documents drawn in a seeded order.

Edge cases: a null or empty text has size 0 and is taken 0 words; a null source is a source of its own and
comes last; a source without words has target 0; repeated rows are separate documents of equal standing, and so
are rows of one doc_id, which are drawn in the order of their texts' hashes;
an empty table gives an empty result. Extra columns of the input are ignored by `mix_plan` and kept by `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnworks.llm.common import WORD, free_names, materialise

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"
#: A source's documents are put in order in this many hash buckets, so that no window holds a whole source.
BUCKETS = 4096


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> (source, source_size, target). One row a source, so its windows are small.

    A source is clamped exactly if its clamp / weight lies below the water level, so sources are taken in that
    order: the level that would hold if the first k were clamped is (volume - their clamps) / (weights of the rest).
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))).cast("int") + 1)
    rows = sizes.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(max_epochs))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    in_order = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(budget) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    )
    rows = rows.withColumn("_rank", F.row_number().over(in_order)).withColumn("_level", level)
    # The first source in this order whose clamp lies above its level stays open, and fixes the level of all that follow.
    first_open = F.min(F.when(F.col("_cap") / F.col("_weight") > F.col("_level"), F.struct("_rank", "_level"))).over(everything)
    rows = rows.withColumn("_water", first_open)
    water = F.when(F.col("_rank") >= F.col("_water._rank"), F.col("_water._level"))
    target = F.when(water.isNull(), F.col("_cap")).otherwise(F.col("_weight") * water)
    return rows.select("source", "source_size", target.alias("target"))


def _epochs(frame: DataFrame, weights, budget, max_epochs, seed) -> DataFrame:
    """frame has source, doc_id, _size and _order; adds source_size, target and _copies."""
    sizes = frame.groupBy("source").agg(F.sum("_size").alias("source_size"))
    targets = source_targets(sizes, weights, budget, max_epochs).withColumnRenamed("source", "_source")
    bucket = F.conv(F.substring("_order", 1, 3), 16, 10).cast("int")
    rows = frame.withColumn("_bucket", bucket)
    whole_buckets = rows.groupBy(F.col("source").alias("_bsource"), F.col("_bucket").alias("_bbucket")).agg(F.sum("_size").alias("_words"))
    starts = whole_buckets.withColumn(
        "_start", F.coalesce(F.sum("_words").over(Window.partitionBy("_bsource").orderBy("_bbucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    ).drop("_words")
    per_source = starts.join(targets, F.col("_bsource").eqNullSafe(F.col("_source")))
    inside = Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_size").over(inside), F.lit(0)).cast("long"))
    rows = rows.join(per_source, F.col("source").eqNullSafe(F.col("_bsource")) & (F.col("_bucket") == F.col("_bbucket")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rest = (ratio - F.floor(ratio)) * F.col("source_size")
    # A document is drawn if the middle of its words lies below the missing fraction: off by half a document at most.
    drawn = (F.col("_start") + F.col("_before") + F.col("_size") / F.lit(2.0) < rest).cast("long")
    return rows.withColumn("_copies", F.floor(ratio) + drawn)


def draw_order(doc_id, seed: str = SEED):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _planned(documents: DataFrame, weights, budget, max_epochs, seed) -> DataFrame:
    """A row for each row of documents, with _size, _tie (a hash of the text), source_size, target and _copies."""
    rows = documents.select("doc_id", "source", word_count(documents["text"]).alias("_size"), F.xxhash64(documents["text"]).alias("_tie"), draw_order(documents["doc_id"], seed).alias("_order"))
    return _epochs(materialise(rows, "mix"), weights, budget, max_epochs, seed)


def mix_plan(documents: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """documents(doc_id, text, source) -> doc_id, source, size, source_size, target, copies, taken (words)."""
    return _planned(documents, weights, budget, max_epochs, seed).select(
        "doc_id", "source", F.col("_size").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target",
        F.col("_copies").cast("long").alias("copies"), (F.col("_copies") * F.col("_size")).cast("long").alias("taken"),
    )


def mixed_documents(documents: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of documents as often as the plan takes it, with all its columns.

    Rows are told apart by a hash of doc_id, source and text; rows that are alike in these share their plan rows' copies evenly, the
    rest going to those of least hash over all columns, and only they are numbered.
    """
    names = ("key", "of", "all", "alike", "number", "copies", "copy")
    key, of, all_, alike, number, copies, copy = free_names(documents, *(f"_{n}" for n in names))
    digest = lambda tie: F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.coalesce("source", F.lit("")), tie)
    plan = _planned(documents, weights, budget, max_epochs, seed).groupBy(digest(F.col("_tie")).alias(of)).agg(F.sum("_copies").cast("long").alias(all_), F.count("*").alias(alike))
    rows = documents.withColumn(key, digest(F.xxhash64("text"))).join(plan.filter(F.col(all_) > 0), F.col(key) == F.col(of))
    single = rows.filter(F.col(alike) == 1).withColumn(number, F.lit(1))
    order = F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in documents.columns))
    several = rows.filter(F.col(alike) > 1).withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy(order)))
    rows = single.unionByName(several)
    share = F.floor(F.col(all_) / F.col(alike)) + (F.col(number) <= F.col(all_) % F.col(alike)).cast("long")
    rows = rows.withColumn(copies, share.cast("int")).filter(F.col(copies) > 0)
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).select(*(F.col(f"`{c}`") for c in documents.columns))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    from cairnworks.llm.common import read

    return mix_plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS o
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n,
             [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::INT]::DOUBLE AS w
      FROM d GROUP BY source),
fill AS (
  SELECT 0 AS step, []::VARCHAR[] AS full_sources
  UNION ALL
  SELECT step + 1, (
    SELECT list(coalesce(s.source, chr(1))) FROM s
    WHERE list_contains(fill.full_sources, coalesce(s.source, chr(1))) OR
      s.w * ((SELECT 1.5 * sum(a.n) FROM s a) - coalesce((SELECT sum(2.0 * b.n) FROM s b WHERE list_contains(fill.full_sources, coalesce(b.source, chr(1)))), 0))
          / (SELECT sum(c.w) FROM s c WHERE NOT list_contains(fill.full_sources, coalesce(c.source, chr(1)))) >= 2.0 * s.n)
  FROM fill WHERE step < 25),
done AS (SELECT coalesce(full_sources, []::VARCHAR[]) AS f FROM fill ORDER BY step DESC LIMIT 1),
t AS (
  SELECT s.source, s.n, CASE WHEN list_contains(f, coalesce(s.source, chr(1))) THEN 2.0 * s.n ELSE
    s.w * (((SELECT sum(a.n) FROM s a) * 1.5 - coalesce((SELECT sum(2.0 * b.n) FROM s b WHERE list_contains(f, coalesce(b.source, chr(1)))), 0.0))
        / ((SELECT sum(w) FROM s) - coalesce((SELECT sum(c.w) FROM s c WHERE list_contains(f, coalesce(c.source, chr(1)))), 0.0))) END AS target
  FROM s, done),
p AS (
  SELECT d.doc_id, d.size, t.n AS source_size, t.target,
         CASE WHEN t.n > 0 THEN t.target / t.n ELSE 0.0 END AS r,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(r) + CASE WHEN before + size / 2.0 < (r - floor(r)) * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken,
       (floor(r) + CASE WHEN before + size / 2.0 < (r - floor(r)) * source_size THEN 1 ELSE 0 END)::BIGINT AS copies
FROM p
"""
