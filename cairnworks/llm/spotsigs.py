"""SpotSigs document fingerprints, as DataFrame expressions only.

A spot signature is a common word (the anchor) with the chain of the CHAIN content words that follow it; other
common words between them are skipped. A text's fingerprint is the set of its signatures. Sets are compared
by Jaccard; a pair whose set lengths alone keep it below `least` is pruned and counts 0. `near_pairs` joins a
table with itself on these terms: sets are partitioned by length so that partners lie in the same or the next
partition, and meet by their rarest signatures.

A text without anchors takes every word as one; a text without words is one signature of its own.
Edge cases: a null text counts as empty, and equal texts (two empty ones too) have equal fingerprints and
likeness 1; in the order of documents a null doc_id comes last and rows of one doc_id follow their text's hash;
a table of one row has itself as the next one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnworks.llm.common import pieces, read

#: The anchors, very common words of English, German, French and Spanish.
ANCHORS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "as", "was", "on", "be", "by", "at", "this", "from", "or", "are", "an",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch",
    "le", "la", "les", "et", "du", "un", "une", "est", "que", "dans", "qui", "par", "pour", "au", "sur", "pas", "ne", "se",
    "el", "los", "las", "y", "por", "con", "para", "una", "su", "lo", "del", "en", "de", "no",
)
CHAIN = 2
#: At least this Jaccard for near_pairs.
NEAR = 0.75


def let(value: Column, body) -> Column:
    """body(value) with value computed once: inside a lambda Spark would compute an expression for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def signatures(text: Column) -> Column:
    """The sorted distinct 32-bit hashes of a text's spot signatures; never empty, null for no text only."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def of_words(words: Column) -> Column:
        anchors = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda w: w["word"].isin(*ANCHORS))
        content = F.filter(words, lambda w: ~w.isin(*ANCHORS))
        return let(F.struct(anchors.alias("anchors"), content.alias("content")), lambda s: F.when(F.size(s["anchors"]) > 0, _anchored(s)).otherwise(_unanchored(text, words)))

    return _hashes(let(words, of_words))


def _hashes(strings: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(strings, lambda s: F.xxhash64(s).bitwiseAND(F.lit(0xFFFFFFFF)))))


def _anchored(s: Column) -> Column:
    """The chain of each anchor: of the words before the k-th anchor (from 0) k are anchors, so its content words begin at its place less k."""

    def chain(anchor: Column, k: Column) -> Column:
        follow = F.slice(s["content"], anchor["at"] - k + 1, F.lit(CHAIN))
        return F.concat(anchor["word"], F.lit(":"), F.array_join(follow, " "))

    return F.transform(s["anchors"], chain)


def _unanchored(text: Column, words: Column) -> Column:
    chains = F.transform(words, lambda w, i: F.concat(F.lit("*"), F.array_join(F.slice(words, i + 1, CHAIN + 1), " ")))
    return F.when(F.size(words) > 0, chains).otherwise(F.array(F.concat(F.lit("!"), text)))


def as_string(signature_set: Column) -> Column:
    """A fingerprint as text: eight hex digits a signature, ascending."""
    return F.array_join(F.transform(signature_set, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two sets; 0 where their lengths alone keep it below `least`."""
    fits = F.least(F.size(a), F.size(b)) >= F.greatest(F.size(a), F.size(b)) * F.lit(least)
    jaccard = let(F.size(F.array_intersect(a, b)), lambda common: common / (F.size(a) + F.size(b) - common))
    return F.when(fits, jaccard).otherwise(F.lit(0.0))


def with_next(documents: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """documents(doc_id, text) with `columns` and, as next_<name>, those of the next row by descending doc_id, cyclic.

    Rows are dealt to ranges of doc_id (quantiles, so of even size); each range also gets the first row of the
    following one, so no window goes over more than a range and the texts are shuffled once.
    """
    spark = documents.sparkSession
    n = 3 * pieces(spark)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), order.alias("_at")).withColumn("_tie", F.xxhash64("text"))
    bounds = documents.select(order.alias("_at")).agg(F.percentile_approx("_at", [i / n for i in range(1, n)], 10_000)).first()[0] or []
    bounds = sorted(set(bounds))
    bucket = F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b < F.col("_at"))) if bounds else F.lit(0)
    rows = rows.withColumn("_bucket", bucket)
    heads = rows.groupBy("_bucket").agg(F.max(F.struct("_at", "_tie")).alias("_head"))  # one row a range
    ring = Window.orderBy("_bucket")
    first = F.min("_bucket").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.col("_bucket").alias("_b"), "_head", F.coalesce(F.lead("_bucket").over(ring), first).alias("_before"))
    rows = rows.join(F.broadcast(heads), F.col("_bucket") == F.col("_b"))  # as many rows as ranges, a parameter
    is_head = F.struct("_at", "_tie") == F.col("_head")
    own, copy = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("copy")), F.struct(F.col("_before").alias("b"), F.lit(True).alias("copy"))
    rows = rows.select("doc_id", "text", "_at", "_tie", F.explode(F.when(is_head, F.array(own, copy)).otherwise(F.array(own))).alias("_to"))
    rows = rows.select("doc_id", "text", "_at", "_tie", F.col("_to.b").alias("_range"), F.col("_to.copy").alias("_copy"))
    rows = rows.repartition(pieces(spark), "_range").withColumns(columns)
    follow = Window.partitionBy("_range").orderBy("_copy", F.col("_at").desc(), F.col("_tie").desc())
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(follow) for c in ("text", *columns)})
    return rows.filter("not _copy").drop("_at", "_tie", "_range", "_copy")


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(read(spark, sf_dir, "documents"), {"own": signatures(F.col("text"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "edited", "own", "next_own").withColumn("changed", signatures(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_string(F.col("own")).alias("fingerprint"), as_string(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


def near_pairs(documents: DataFrame, least: float = NEAR) -> DataFrame:
    """(a, b, likeness) of all pairs of different fingerprints with likeness >= least; a and b are their smallest doc_ids.

    Copies are one class here; `classes` maps them. Sets of length n lie in partition floor(log(n) / log(1 / least)),
    and partners in the same or the next one. Two such sets share one of the first n - ceil(least n) + 1
    signatures of each in the order of rarity, which is where they meet.
    """
    sets = classes(documents).groupBy("own").agg(F.min("doc_id").alias("doc_id")).withColumn("n", F.size("own"))
    count = sets.select(F.explode("own").alias("s")).groupBy("s").agg(F.count("*").alias("df"))
    ranked = sets.select("doc_id", "n", F.explode("own").alias("s")).join(count, "s")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "s"))
    prefix = ranked.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1)
    part = F.floor(F.log(F.col("n")) / F.log(F.lit(1 / least)) + F.lit(1e-9))
    prefix = prefix.select("doc_id", "n", "s", part.alias("part"))
    left = prefix.select(F.col("doc_id").alias("a"), F.col("n").alias("an"), "s", F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("part").alias("apart"))
    met = left.join(prefix, ["s", "part"]).filter(((F.col("apart") < F.col("part")) | (F.col("a") < F.col("doc_id"))) & (F.least("an", "n") >= F.greatest("an", "n") * F.lit(least)) & (F.col("a") != F.col("doc_id")))
    pairs = met.select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")).distinct()
    pairs = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("own").alias("y")), "b")
    return pairs.select("a", "b", likeness(F.col("x"), F.col("y"), least).alias("likeness")).filter(F.col("likeness") >= least)


def classes(documents: DataFrame) -> DataFrame:
    """(doc_id, own): each document's signature set."""
    return documents.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("own"))
