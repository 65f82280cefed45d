import re
from itertools import permutations

import numpy as np
import pytest

from cairnworks.llm import filter_audit
from cairnworks.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SMALL
from tests.oracle import connect, rows


def brute(documents, labels):
    """Run every order over the documents."""
    texts = [(d, t or "", s or "") for d, t, s in documents]
    first = {}
    for d, t, _ in texts:
        if d is not None:
            first[t] = min(first.get(t, d), d)
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    failing = []
    for d, t, s in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t]}
        failing.append((s, d, {f for f, x in fails.items() if x}))
    out = {}
    for part in {s for s, _, _ in failing}:
        mine = [(d, f) for s, d, f in failing if s == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(d, f) for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                out[part, order, step] = [len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == {x} for _, f in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for x in "ABCDE":
            total = sum(out[part, o, o.index(x) + 1][1] for o in map("".join, permutations("ABCDE")))
            for o in map("".join, permutations("ABCDE")):
                out[part, o, o.index(x) + 1].append(total)
    return out


LABELS = "doc_id long, quality int, toxic int, source string"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0, "x"), (5, 0, 1, None), (5, 1, None, None), (6, None, 1, None), (14, 1, 1, None), (None, 1, 1, None), (99, 1, 1, None)], LABELS)


def test_odd_rows_equal_brute_force(spark, odd, labels):
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.OUTCOMES] for r in filter_audit.audit(odd, labels).collect()}
    want = brute([(r["doc_id"], r["text"], r["source"]) for r in odd.collect()], [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()])
    assert got == want


def test_helper_names_as_extra_columns(spark, odd, labels):
    names = ("part", "mask", "digest", "words", "first", "good", "toxic", "all")
    clash = odd.selectExpr("*", *(f"1 as {n}" for n in names))
    first = filter_audit.audit(odd, labels).collect()
    assert sorted(map(tuple, filter_audit.audit(clash, labels.selectExpr("*", "1 as good", "2 as first")).collect())) == sorted(map(tuple, first))


def test_empty(spark, empty, labels):
    assert filter_audit.audit(empty, labels).collect() == []


def test_matrices_hold_each_document_once():
    m = filter_audit.outcome_matrices()
    assert all(x.shape == (32, 600) for x in m.values())
    last = [i for i, c in enumerate(filter_audit.COLUMNS) if c[1] == 5]
    removed = m["removed"].reshape(32, 120, 5).sum(2)
    assert ((removed + m["kept"][:, last]) == 1).all() and np.array_equal(removed[1:], np.ones((31, 120)))


def test_query_equals_sql(spark):
    got = QUERIES["op11_filter_audit"](spark, SMALL).toPandas()
    want = connect(SMALL).sql(ORACLE_SQL["op11_filter_audit"]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
