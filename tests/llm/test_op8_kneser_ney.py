import collections
import math

import numpy as np

from cairnworks.llm import kneser_ney


def reference(texts):
    """log probability of a byte string's bytes under the model of `texts`, from dictionaries."""
    top = kneser_ney.ORDER
    level = {top: collections.Counter()}
    for t in texts:
        b = bytes(top - 1) + t
        level[top].update(b[i : i + top] for i in range(len(t)))
    for order in range(top - 1, 0, -1):
        level[order] = collections.Counter(g[1:] for g in level[order + 1])
    discount = {o: kneser_ney.discounts_of([sum(v == k for v in level[o].values()) for k in (1, 2, 3, 4)]) for o in level}
    context = {o: collections.defaultdict(lambda: [0, 0.0]) for o in level}
    for o in level:
        for g, v in level[o].items():
            context[o][g[:-1]][0] += v
            context[o][g[:-1]][1] += discount[o][min(v, 3) - 1]

    def p(g, order):
        if order == 0:
            return 1 / 256
        lower = p(g[1:], order - 1)
        if g[:-1] not in context[order]:
            return lower
        total, saved = context[order][g[:-1]]
        v = level[order].get(g, 0)
        return (max(v - discount[order][min(v, 3) - 1], 0) if v else 0) / total + saved / total * lower

    return lambda t: sum(math.log(p((bytes(top - 1) + t)[i : i + top], top)) for i in range(len(t)))


def test_equals_dictionaries(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in documents.collect()}
    score = reference([t for d, t in docs.items() if d in good])
    rows = {r["doc_id"]: r for r in kneser_ney.quality(documents.repartition(3), labels).collect()}
    assert len(rows) == len(docs)
    for d in sorted(docs)[:25]:
        assert abs(math.log(rows[d]["perplexity"]) + score(docs[d]) / len(docs[d])) < 1e-5


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    g = np.unique(rng.integers(0, 4, (400, 5)) @ (256 ** np.arange(5)[::-1])).astype(np.uint64)
    c = rng.integers(1, 9, len(g))
    model = kneser_ney.ShardModel(g, c)
    pairs = np.zeros(1 << 16, np.int64)
    pairs[model.pairs[0].astype(np.int64)] = model.pairs[1]
    discounts = np.array([kneser_ney.discounts_of(n) for n in model.counts_of_counts()])
    for context in (g[0] >> np.uint64(8), np.uint64(0x01020304), np.uint64(0xFFFFFFFF)):
        asked = (context << np.uint64(8)) + np.arange(256, dtype=np.uint64)
        assert abs(np.exp(model.log_probability(asked, kneser_ney.pair_model(pairs), discounts)).sum() - 1) < 1e-9


def test_clean_stays_and_noise_goes(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = kneser_ney.quality(frame, labels).join(labels, "doc_id").collect()
    clean = [r["keep"] for r in rows if r["quality"] == 1]
    noise = [r["keep"] for r in rows if r["quality"] == 0]
    assert sum(clean) >= 0.98 * len(clean) and sum(noise) <= 0.1 * len(noise)


def test_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(5, 1), (9, 1), (14, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    rows = kneser_ney.quality(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all((r["perplexity"] is None and not r["keep"]) == (r["n_bytes"] == 0) for r in rows if r["n_bytes"] == 0)
    assert all(r["keep"] for r in rows if r["doc_id"] in (5, 9))
    assert all(r["keep"] == (r["n_bytes"] > 0) for r in kneser_ney.quality(odd, labels.limit(0)).collect())
    assert kneser_ney.quality(empty, labels).count() == 0
