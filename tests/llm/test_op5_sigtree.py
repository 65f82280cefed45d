import random

import numpy as np
import pytest

from cairnworks.llm import sigtree
from tests.llm.brute import jaccard_components


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_equals_all_pairs(documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert found(sigtree.jaccard_components(documents)) == jaccard_components(docs)


def test_families_of_near_copies(spark):
    """Variants around the threshold, so that some are linked only through others."""
    random.seed(8)
    words = [f"w{i}" for i in range(2000)]
    docs = []
    for family in range(4):
        base = random.choices(words, k=60)
        for k in range(40):
            text = list(base)
            for _ in range(random.randint(0, 3)):
                text[random.randrange(60)] = random.choice(words)
            docs.append((100 * family + k, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert found(sigtree.jaccard_components(df)) == jaccard_components(docs)


def test_trees_alone_find_every_link(spark, monkeypatch):
    """Without star rounds but the first, and with blocks of a few members."""
    random.seed(5)
    base = [f"w{i}" for i in range(50)]
    docs = []
    for k in range(60):
        text = list(base)
        for _ in range(random.randint(0, 4)):
            text[random.randrange(50)] = f"x{random.randrange(900)}"
        docs.append((k, " ".join(text)))
    monkeypatch.setattr(sigtree, "ROUNDS", 1)
    monkeypatch.setattr(sigtree, "BLOCK", 7)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(sigtree.jaccard_components(df)) == jaccard_components(docs)


def test_spread_shingles(spark, monkeypatch):
    monkeypatch.setattr(sigtree, "HEAVY", 3)
    docs = [(i, " ".join(f"w{j}" for j in range(30)) + f" end{i % 7}") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(sigtree.jaccard_components(df)) == jaccard_components(docs)


def test_bounds_never_prune_a_link():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = a[rng.random(len(a)) < 0.9]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, 20))).astype(np.uint64)]))
        if len(b) and sigtree._linked(a, b):
            assert sigtree.may_link(sigtree.Node(bits=sigtree.bitmap(a), n=len(a)), sigtree.Node(bits=sigtree.bitmap(b), n=len(b)))
        others = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for _ in range(9)]
        tree = sigtree.build_tree([sigtree.Node(bits=sigtree.bitmap(x), n=len(x), item=i, label=i) for i, x in enumerate([a, *others])])
        if len(b) and sigtree._linked(a, b):
            assert sigtree.may_link(tree, sigtree.Node(bits=sigtree.bitmap(b), n=len(b)))


def test_packed_sets_round_trip():
    s = np.unique(np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64))
    assert (sigtree.unpacked_set(sigtree.packed_set(s)) == s >> np.uint64(16)).all()


def test_odd_rows(odd):
    rows = sigtree.jaccard_components(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    for blank in (0, 1, 2):
        assert by[blank] == {(0, blank)}
    assert {c for d in (5, 6, 7, 8) for _, c in by[d]} == {5} and by[10] == {(by[10].copy().pop()[0], 9)} and by[3] == {(1, 3)}
    assert by[None].pop()[1] is None
    kept = sigtree.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(5) == 1 and ids.count(9) == 1 and not {6, 7, 8, 10} & set(ids) and {0, 1, 2, 3, 4, None} <= set(ids)


def test_empty_table(empty):
    assert sigtree.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 64, 65])
def test_fold_keeps_bits(n):
    s = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    bits = sigtree.bitmap(s)
    small = sigtree.fold(bits, 64)
    assert all(small >> int(x % 64) & 1 for x in s)


def test_rows_of_one_id_keep_one_of_each_component(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "x"), (1, b, "y"), (1, a, "z"), (2, b, "u"), (3, a, "v"), (4, "", "w"), (4, None, "w")]
    kept = sigtree.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [(1, a), (1, b), (4, ""), (4, "")]


def test_words_in_thue_morse_order_do_not_link(spark):
    words = ["".join("ab"[(i.bit_count() + flip) % 2] for i in range(n)) for n in (1024, 2048) for flip in (0, 1)]
    rows = sigtree.jaccard_components(spark.createDataFrame(list(enumerate([*words, words[0]])), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}
