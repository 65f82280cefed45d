import random

import numpy as np
import pyarrow as pa
import pytest

from cairnworks.llm import toxicity


def corpus(n, seed, toxic_share=0.3):
    random.seed(seed)
    words = ["".join(random.choices("abcdefghijkl", k=random.randint(2, 7))) for _ in range(400)]
    bad = ["vilething", "nasties", "nastied", "nasting"]
    rows = []
    for i in range(n):
        text, toxic = random.choices(words, k=random.randint(5, 90)), random.random() < toxic_share
        for _ in range(random.randint(2, 4) if toxic else 0):
            text.insert(random.randrange(len(text)), random.choice(bad))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus(600, 1)
    return toxicity.fit(pa.array([r[1] for r in rows]), np.array([r[2] == 1 for r in rows]))


def test_unseen_documents(model):
    rows = corpus(400, 2)
    score, spans = toxicity.scored(model, pa.RecordBatch.from_pydict({"text": [r[1] for r in rows]}))
    right = sum((s >= toxicity.THRESHOLD) == (r[2] == 1) for s, r in zip(score, rows, strict=True))
    assert right >= 392
    for (_, text, _), found in zip(rows, spans, strict=True):
        assert all(text[a:b] in ("vilething", "nasties", "nastied", "nasting") for a, b, _ in found)


def test_marginals_equal_all_paths(model):
    """Forward-backward against the sum over every sequence of states."""
    rng = np.random.default_rng(0)
    emission = rng.normal(0, 2, 9)
    m = model.moves
    total, with_toxic = 0.0, np.zeros(9)
    for path in range(1 << 9):
        y = [(path >> k) & 1 for k in range(9)]
        # A window starts as if after a clean token.
        weight = np.exp(sum(emission[k] * y[k] for k in range(9)) + m[0, y[0]] + sum(m[y[k - 1], y[k]] for k in range(1, 9)))
        total += weight
        with_toxic += weight * np.array(y)
    assert np.allclose(model.marginals(emission, np.zeros(9, np.int64)), with_toxic / total)


def test_spans_count_code_points(model):
    text = "é中😀 vilething ok vilething"
    _, spans = toxicity.scored(model, pa.RecordBatch.from_pydict({"text": [text, None, ""]}))
    assert [text[a:b] for a, b, _ in spans[0]] == ["vilething", "vilething"] and spans[1:] == [[], []]


def test_no_labels_of_one_kind():
    model = toxicity.fit(pa.array(["a b", "c d"]), np.array([False, False]))
    assert len(model.features) == 0 and model.score(np.zeros(1), np.zeros(1))[0] < 0.1
    assert toxicity.fit(pa.array([], pa.string()), np.zeros(0, bool)).score(np.zeros(1), np.zeros(1))[0] < 0.1


def test_held_out_rows_never_train(spark, documents):
    rows = spark.createDataFrame(corpus(300, 4), "doc_id long, text string, toxic int")
    labels = rows.select("doc_id", "toxic")
    flipped = labels.withColumn("toxic", (1 - labels["toxic"]).cast("int")).filter(toxicity.held_out(labels["doc_id"])).union(labels.filter(~toxicity.held_out(labels["doc_id"])))
    a, b = (toxicity.train(rows.drop("toxic"), x) for x in (labels, flipped))
    assert (a.features == b.features).all() and np.allclose(a.weights, b.weights)


def test_odd_rows(odd, empty, model, spark):
    rows = toxicity.toxicity(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxic_filter(odd, model).columns == odd.columns
    assert toxicity.toxicity(empty, model).count() == 0
    bad = spark.createDataFrame([(1, "vilething and nasties then vilething"), (2, "fine words")], "doc_id long, text string")
    assert [r["doc_id"] for r in toxicity.toxic_filter(bad, model).collect()] == [2]


def test_drawn_shares_move_no_score():
    """Some clean documents hold a word that tells toxic ones; with a tenth of the clean rows, a doubtful document scores as with all rows."""
    random.seed(5)
    rows = corpus(8000, 6, toxic_share=0.1)
    texts = [text + (" nastiest" if random.random() < (0.5 if toxic else 0.05) else "") for _, text, toxic in rows]
    toxic = np.array([r[2] == 1 for r in rows])
    drawn = toxic | (np.arange(len(rows)) % 10 == 0)
    some = pa.array([t for t, d in zip(texts, drawn, strict=True) if d])
    odds = lambda model: np.log(1 / model.score(np.array([0.6]), np.array([0.6]))[0] - 1)
    whole = odds(toxicity.fit(pa.array(texts), toxic))
    assert abs(whole - odds(toxicity.fit(some, toxic[drawn], shares=(0.1, 1.0)))) < 0.3
    assert abs(whole - odds(toxicity.fit(some, toxic[drawn]))) > 0.8  # as it was: the draw counted as the whole


def test_training_tells_the_drawn_shares(spark, monkeypatch):
    rows = spark.createDataFrame(corpus(300, 4), "doc_id long, text string, toxic int")
    told = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic, **options: told.append((toxic, options)))
    toxicity.train(rows.drop("toxic"), rows.select("doc_id", "toxic"), max_toxic=10_000, max_clean=70, max_windows=9)
    toxic, options = told[0]
    assert options["shares"][1] == 1 and options["max_windows"] == 9
    assert 0.3 < options["shares"][0] < 0.8 and abs((~toxic).sum() - 70) < 30


def test_chains_are_whole():
    """Marginals of a long text equal those of a walk token by token: nothing is cut at a border of lanes."""
    rng = np.random.default_rng(3)
    model = toxicity.Field(moves=np.array([[0.9, -1.1], [-0.7, 0.4]]))
    row = np.repeat(np.arange(4), [1, 700, 64, 130])
    emission = rng.normal(-1, 2, len(row))
    m, e, want = np.exp(model.moves), np.exp(emission), []
    for text in range(4):
        at = np.flatnonzero(row == text)
        alpha, beta = np.zeros((len(at), 2)), np.ones((len(at), 2))
        state = np.array([1.0, 0.0])
        for i, k in enumerate(at):
            state = (state @ m) * [1, e[k]]
            alpha[i] = state = state / state.sum()
        for i in range(len(at) - 2, -1, -1):
            beta[i] = m @ ([1, e[at[i + 1]]] * beta[i + 1])
            beta[i] /= beta[i].sum()
        both = alpha * beta
        want += (both[:, 1] / both.sum(1)).tolist()
    assert np.allclose(model.marginals(emission, row), want)


def test_query_on_held_out_rows(spark):
    """op3_toxicity over the tables of sf0.01: recall and false alarms at the threshold, on rows that never train."""
    sf_dir = "/root/testdata/sf0.01"
    rows = toxicity.op3_toxicity(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    held = rows.filter("held_out").join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    toxic, clean = ([r["predicted"] for r in held if r["toxic"] == k] for k in (1, 0))
    print(f"held out: {sum(toxic)} of {len(toxic)} toxic found, {sum(clean)} of {len(clean)} clean rejected")
    # Four of the 18 have no telling word; two of these are junk in capitals that no text tells from clean junk.
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.02 * len(clean)
