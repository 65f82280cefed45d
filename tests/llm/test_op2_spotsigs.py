import hashlib
import re

from pyspark.sql import functions as F

from cairnworks.llm import spotsigs


def signatures(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    at = [i for i, w in enumerate(words) if w in spotsigs.ANCHORS]
    out = set()
    for i in at:
        out.add(words[i] + ":" + " ".join([w for w in words[i + 1 :] if w not in spotsigs.ANCHORS][: spotsigs.CHAIN]))
    return out or {"*" + " ".join(words[i : i + spotsigs.CHAIN + 1]) for i in range(len(words))} or {"!" + text}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_query_equals_python(spark, documents, tmp_path):
    docs = sorted(((r["doc_id"], r["text"]) for r in documents.collect()), reverse=True)
    rows = {r["doc_id"]: r for r in spotsigs.op2_spotsigs(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == len(docs)
    for k, (d, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = rows[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - jaccard(signatures(text), signatures(edited))) < 1e-9 and abs(r["near_next"] - jaccard(signatures(text), signatures(after))) < 1e-9


def test_ranges_of_any_number(spark):
    """The next row is right across ranges, whatever the session's partitions, for ids with gaps and ties."""
    docs = [(i * i - 50, f"text {i}") for i in range(1, 40)] + [(10**15, "far"), (None, "none")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    order = [t for _, t in sorted(docs, key=lambda x: -(10**16) if x[0] is None else x[0], reverse=True)]
    for n in ("1", "4", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {r["text"]: r["next_text"] for r in spotsigs.with_next(frame, {}).collect()}
        assert got == {t: order[(k + 1) % len(order)] for k, t in enumerate(order)}
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_odd_rows(odd, empty, spark):
    rows = spotsigs.with_next(odd, {"own": spotsigs.signatures(F.col("text"))}).collect()
    assert len(rows) == odd.count() and all(r["own"] for r in rows)
    same = [tuple(r["own"]) for r in rows if r["doc_id"] in (5, 6)]
    assert len(set(same)) == 1
    assert spotsigs.with_next(empty, {}).count() == 0
    one = spotsigs.with_next(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), {}).collect()
    assert [r["next_text"] for r in one] == ["a b c"]


def test_near_pairs_equal_all_pairs(spark, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    docs += [(1000 + d, t + " extra tail") for d, t in docs[:40]]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    least = {}
    for d, t in docs:
        key = frozenset(signatures(t))
        least[key] = min(d, least.get(key, d))
    sets = sorted(((d, k) for k, d in least.items()))
    want = {(a, b) for i, (b, y) in enumerate(sets) for a, x in sets[:i] if jaccard(x, y) >= spotsigs.NEAR}
    assert {(r["a"], r["b"]) for r in spotsigs.near_pairs(frame).collect()} == want and len(want) > 5


def test_no_python_in_the_plan(documents):
    plan = spotsigs.with_next(documents, {"own": spotsigs.signatures(F.col("text"))})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
