import pytest

import corpus_pipeline
from cairnworks.llm import mixing, sigtree
from cairnworks.llm.common import materialise
from tests.conftest import SMALL


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SMALL), f"test-{name}")
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("toxic = 1").collect()}
    kept = {r["doc_id"] for r in seen["toxicity"].collect()}
    assert len(toxic & kept) <= len(toxic) // 2 and len(kept) >= 150
    groups = sigtree.jaccard_components(seen["toxicity"]).collect()
    assert {r["doc_id"] for r in seen["jaccard_join"].collect()} == {r["component_id"] for r in groups}
    assert seen["chunk_dedup"].count() <= seen["jaccard_join"].count()
    assert all(len(r["text"]) == r["n_chars"] for r in seen["chunk_dedup"].collect())
    plan = mixing.mix_plan(seen["chunk_dedup"]).collect()
    assert seen["mixing"].count() == sum(r["copies"] for r in plan) == seen["sentencepiece"].count()
    assert all(r["round_trip"] and r["parity"] for r in seen["sentencepiece"].collect())


def test_odd_rows_pass_all_stages(spark, odd, tmp_path):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SMALL), f"odd-{name}")
        assert docs.columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count() > 0


def test_empty_table(spark, empty):
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SMALL), f"empty-{name}")
    assert docs.count() == 0


HELPERS = "_row _of _places _cut _copies _key _number _tie _all _alike _copy _id _own _root root _place _bucket row places key text_ size a b".split()


@pytest.mark.parametrize("repeat", [False, True])
def test_helper_names_as_extra_columns(spark, repeat):
    """Each stage keeps columns of any name, also where rows share a doc_id."""
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
    rows = [(1, text, "en", "s", 1), (1 if repeat else 2, text + " more words here", "en", "s", 1), (3, "alpha beta", "en", None, 1), (4, None, None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *(f"'{n}' as `{n}`" for n in HELPERS))
    held = [r["doc_id"] for r in docs.collect()]
    for stage in (corpus_pipeline.one_of_each_group, corpus_pipeline.without_repeated_passages, corpus_pipeline.mixed):
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        found = out.collect()
        assert found and {r["doc_id"] for r in found} <= set(held)
        assert all(r[n] == n for r in found for n in HELPERS)
