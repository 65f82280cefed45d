"""Filter interaction audit: what each of five filters removes in every order they can be applied in.

A document fails a subset of the filters, its mask. How documents fall on the 32 masks, counted for each part once for all
documents and once for those that a label marks, decides everything: a row of 32 counts times an integer matrix of
32 x 600 (120 orders of 5 steps) gives an outcome for each order and step. So texts are read once, and no order is
ever run over the documents.

Edge cases: a null text counts as empty, a null source as the part ''. A document is a repeat if a smaller doc_id has
its text; without a doc_id it is neither a repeat nor makes one, and has no labels; rows that share a doc_id are
documents of their own, and repeats only of smaller ones. A doc_id is marked by a label if any of its label rows is 1.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnworks.llm.common import materialise, read

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Columns of the matrices: (order, step) with the steps of an order together.
COLUMNS = [(order, step) for order in ORDERS for step in range(1, len(FILTERS) + 1)]
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in OUTCOMES)
#: Parts that are multiplied at once; each gives 600 rows.
PARTS = 64


def outcome_matrices() -> dict[str, np.ndarray]:
    """The 32 x 600 matrices of kept, removed, redundant and unique outcomes, and of what a filter removes over all orders."""
    fails = np.array([[mask >> f & 1 for f in range(len(FILTERS))] for mask in range(MASKS)], np.int64)
    filter_of = np.array([FILTERS.index(order[step - 1]) for order, step in COLUMNS])
    failed_before = np.stack([fails[:, [FILTERS.index(x) for x in order[: step - 1]]].sum(1) for order, step in COLUMNS], 1)
    here = fails[:, filter_of]
    removed = here * (failed_before == 0)
    by_filter = np.stack([removed[:, filter_of == f].sum(1) for f in range(len(FILTERS))], 1)
    return {
        "kept": ((here == 0) & (failed_before == 0)).astype(np.int64),
        "removed": removed,
        "redundant": here * (failed_before > 0),
        "unique": here * (fails.sum(1) == 1)[:, None],
        "all_orders": by_filter[:, filter_of],
    }


def text_mask(text: Column, words: Column) -> Column:
    """Bits 0 to 3: the failures of A to D, that a text decides alone."""
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    length = F.length(text).cast("long")
    capitals = length - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (n < 50, distinct * 100 < n * 65, capitals * 100 > length * 5, text.rlike(r"[#$%&*|]"))
    mask = F.lit(0)
    for bit, failed in enumerate(fails):
        mask = mask + F.when(failed, 1 << bit).otherwise(0)
    return mask


def masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of every document. Texts stay where they are; their digests are shuffled."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    rows = rows.select("doc_id", "part", text_mask(F.col("text"), F.col("words")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = materialise(rows, "audit-masks")
    known = rows.filter(F.col("doc_id").isNotNull())
    # The first of a group of copies is found by a grouped minimum and marked by a join on (digest, doc_id), so a text of a third of all rows is no hot key.
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = known.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    repeat = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    known = known.select("part", (F.col("mask") + repeat).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return known.union(rows.filter(F.col("doc_id").isNull()).select("part", "mask", F.lit(False), F.lit(False)))


def histograms(marked: DataFrame) -> DataFrame:
    """(part, all, good, toxic): three arrays of 32 counts for each part; counted before the shuffle, so a hot part is none."""
    counts = marked.groupBy("part", "mask").agg(F.count("*").alias("all"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    of = lambda kind: F.array(*(F.sum(F.when(F.col("mask") == m, F.col(kind)).otherwise(0)) for m in range(MASKS))).alias(kind)
    return counts.groupBy("part").agg(of("all"), of("good"), of("toxic"))


def _outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = outcome_matrices()
    for batch in batches:
        for begin in range(0, batch.num_rows, PARTS):
            some = batch.slice(begin, PARTS)
            counts = {kind: np.array(some.column(kind).to_pylist(), np.int64).reshape(-1, MASKS) for kind in ("all", "good", "toxic")}
            made = [counts[kind] @ m[name] for kind, name in (("all", "kept"), ("all", "removed"), ("all", "redundant"), ("all", "unique"), ("good", "removed"), ("toxic", "removed"), ("all", "all_orders"))]
            n = some.num_rows
            part = some.column("part").take(pa.array(np.repeat(np.arange(n), len(COLUMNS))))
            orders, steps = pa.array([c[0] for c in COLUMNS] * n), pa.array([c[1] for c in COLUMNS] * n, pa.int32())
            yield pa.RecordBatch.from_arrays([part, orders, steps, *(pa.array(x.ravel()) for x in made)], ["part", "filter_order", "step", *OUTCOMES])


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step, with the long counts of OUTCOMES."""
    return histograms(masks(documents, labels)).mapInArrow(_outcomes, RESULT)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


SQL = r"""
with words as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
fails as (select doc_id, part, (len(ws) < 50)::int + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask from words),
marks as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id),
counts as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from fails left join marks using (doc_id) group by part, mask),
letters(f, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (select a.f || b.f || c.f || d.f || e.f as filter_order from letters a, letters b, letters c, letters d, letters e where (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps as (select filter_order, step, l.bit, (select coalesce(sum(p.bit), 0) from letters p where strpos(filter_order, p.f) < step) as before
    from orders, range(1, 6) s(step), letters l where l.f = substr(filter_order, step, 1)),
made as (select part, filter_order, step::int as step, bit,
    sum(case when mask & (before | bit) = 0 then n else 0 end) as kept, sum(case when mask & before = 0 and mask & bit > 0 then n else 0 end) as removed,
    sum(case when mask & before > 0 and mask & bit > 0 then n else 0 end) as redundant, sum(case when mask = bit then n else 0 end) as unique_fails,
    sum(case when mask & before = 0 and mask & bit > 0 then good else 0 end) as good_lost, sum(case when mask & before = 0 and mask & bit > 0 then toxic else 0 end) as toxic_lost
    from counts, (select filter_order, step, bit, before::int as before from steps) group by part, filter_order, step, bit)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
    good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from made
"""
