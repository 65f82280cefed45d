import pytest

from cairnworks.llm import chunk_dedup
from tests.llm.brute import cut_passages


def expected(docs):
    return cut_passages(docs, chunk_dedup._GEAR, chunk_dedup.CUT_BITS, chunk_dedup.CUT_SHIFT, chunk_dedup.MIN_WORDS)


def test_equals_byte_by_byte(documents):
    docs = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    rows = chunk_dedup.deduplicated(documents.repartition(5)).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == expected(docs)
    texts = dict(docs)
    for r in rows:  # what was removed is what the ranges say
        kept, at = "", 0
        for s in r["_cut"]["removed"]:
            kept, at = kept + texts[r["doc_id"]][at : s["start"]], s["end"]
        assert kept + texts[r["doc_id"]][at:] == r["text"]


def test_a_shifted_passage_is_found(spark):
    import random

    random.seed(1)
    say = lambda n: " ".join("".join(random.choices("abcdefghij", k=5)) for _ in range(n))
    passage = say(70)
    docs = [(k, f"{say(30 + k)} {passage} {say(20)}") for k in range(12)] + [(50, say(200))]
    rows = {r["doc_id"]: r for r in chunk_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[0]["_cut"]["removed_words"] == 0 and rows[50]["text"] == docs[-1][1]
    assert all(rows[k]["_cut"]["removed_words"] >= 30 for k in range(1, 12))


def test_odd_rows(odd):
    rows = chunk_dedup.deduplicated(odd).collect()
    assert len(rows) == odd.count() and rows[0].asDict().keys() >= set(odd.columns)
    long = [r for r in rows if r["doc_id"] == 9]
    assert sorted(len(r["text"]) > 0 for r in long) == [False, True]  # the second of two equal rows is left empty
    assert [r["text"] for r in rows if r["doc_id"] == 0] == [None]
    assert all(r["text"].strip() == "" for r in rows if r["doc_id"] in (1, 2))


def test_empty_table(empty):
    assert chunk_dedup.deduplicated(empty).count() == 0


def test_chunks_that_never_stood_together_stay(spark):
    """Each chunk of the last document stands in another one, but no two of them stand side by side there."""
    import random

    import numpy as np

    random.seed(2)
    say = lambda n: " ".join("".join(random.choices("abcdefghij", k=5)) for _ in range(n))
    text = say(120)
    raw = text.encode()
    found = chunk_dedup.chunks(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    bodies = [raw[a:b].decode() for a, b in zip(found["start"], found["end"], strict=True)]
    # The text before a chunk decides where it starts, so each stands behind the 40 bytes before it, cut at a border of its own.
    docs = [(k, f"{say(20)} {raw[max(0, found['start'][k] - 40) : found['end'][k]].decode().split(' ', 1)[-1]} {say(20)}") for k in range(12, len(bodies))]
    rows = {r["doc_id"]: r for r in chunk_dedup.deduplicated(spark.createDataFrame([*docs, (1000, text)], "doc_id long, text string"), min_words=30, together=True).collect()}
    assert rows[1000]["_cut"]["repeated_chunks"] >= 8
    assert rows[1000]["text"] == text and rows[1000]["_cut"]["removed_words"] == 0


def test_every_chunk_of_a_repeated_passage_goes():
    """The shortest windows that start or end with a chunk reach all chunks of any stretch with enough words."""
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(300):
        words = rng.choice([1, 2, 5, 15, 20], rng.integers(1, 12))
        found = {"row": np.zeros(len(words), np.int64), "words": words, "digest": rng.integers(1, 2**63, len(words), dtype=np.uint64)}
        first, size, digest = chunk_dedup.windows(found, 16)
        assert all(words[a : a + n].sum() >= 16 and n <= 16 for a, n in zip(first, size, strict=True))
        assert len(set(zip(first, size, strict=True))) == len(first) == len(set(digest))
        covered = np.zeros(len(words), bool)
        for a, n in zip(first, size, strict=True):
            covered[a : a + n] = True
        assert covered.all() == (words.sum() >= 16)


def test_only_what_stood_together_goes(documents):
    """Against dictionaries of all stretches of chunks that have MIN_WORDS words."""
    import numpy as np

    docs = sorted((r["doc_id"], r["text"] or "") for r in documents.collect())
    seen, want = set(), {}
    for d, text in docs:
        raw = text.encode()
        found = chunk_dedup.chunks(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        bodies = [raw[a:b] for a, b in zip(found["start"], found["end"], strict=True)]
        cut = [False] * len(bodies)
        for i in range(len(bodies)):
            for j in range(i + 1, min(len(bodies), i + 2 * chunk_dedup.MIN_WORDS) + 1):
                if found["words"][i:j].sum() >= chunk_dedup.MIN_WORDS:
                    if tuple(bodies[i:j]) in seen:
                        cut[i:j] = [True] * (j - i)
                    seen.add(tuple(bodies[i:j]))
        want[d] = int(found["words"][np.array(cut, bool)].sum())
    rows = chunk_dedup.deduplicated(documents.repartition(5), together=True).collect()
    assert {r["doc_id"]: r["_cut"]["removed_words"] for r in rows} == want


def test_odd_rows_together(odd, empty):
    rows = chunk_dedup.deduplicated(odd, together=True).collect()
    assert len(rows) == odd.count() and sorted(len(r["text"]) > 0 for r in rows if r["doc_id"] == 9) == [False, True]
    assert chunk_dedup.deduplicated(empty, together=True).count() == 0


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def test_words_in_thue_morse_order_stay(spark):
    """Words that agree under any polynomial modulo 2^64: nothing of two texts without a common word goes."""
    lines = [" ".join(thue_morse(n, *pair) for n in range(1024, 1044)) for pair in ("ab", "ba")]
    rows = chunk_dedup.deduplicated(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), together=True).collect()
    assert all(r["text"] == lines[r["doc_id"]] and r["_cut"]["removed_words"] == 0 for r in rows)
    again = chunk_dedup.deduplicated(spark.createDataFrame(list(enumerate([*lines, lines[0]])), "doc_id long, text string"), together=True).collect()
    assert [r["text"] == "" for r in sorted(again, key=lambda r: r["doc_id"])] == [False, False, True]


@pytest.mark.parametrize("key", [0, 5])
def test_digests_equal_plain_arithmetic(key):
    import numpy as np

    from cairnworks.llm.bytetext import PRIME, Digests, mix

    d = Digests(key)
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    start = rng.integers(0, 4000, 200)
    end = start + rng.integers(1, 900, 200)
    value = lambda items: sum(int(v) * pow(d._point, i, PRIME) for i, v in enumerate(items)) % PRIME
    mixed = lambda v, n: int(mix(np.array([v ^ (n << 61) & (1 << 64) - 1], np.uint64))[0])
    assert d.of_bytes(data, start, end, exact=True).tolist() == [mixed(value(data[a:b].astype(int) + 1), int(b - a)) for a, b in zip(start, end, strict=True)]
    rows = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    assert d.of_rows(rows, start, end - start).tolist() == [mixed(value(int(x) % PRIME for x in rows[a:b]), int(b - a)) for a, b in zip(start, end, strict=True)]
