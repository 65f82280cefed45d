"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Training (a bounded sample of labelled documents): word forms and their first letters that stand in contexts of toxic
documents far more often than the labels' own rate explains (by a bound on the binomial tail, over all features that
are tried, so it scales with the labels) label the tokens; the field is fitted to these labels (weights of word and
prefix features, transitions between the states "clean" and "toxic"). Where a class is drawn in part, what was drawn
counts for what was not: rows weigh the inverse of their drawn share, so scores mean the same however many labels there
are. Training and scoring run forward-backward over whole texts: expected and largest marginals make the document's
score, marginals of at least 0.5 its spans.

The sample is at most about `max_toxic` + `max_clean` rows of at most `max_chars` code points each.
Contexts, not occurrences, are counted, so a group of copies counts as one document.
Edge cases: null and empty texts have no spans and the score of zero toxic tokens; a table without toxic or
clean training rows gives a field without features (every score is the base rate); repeated rows are scored
alike; an empty table gives an empty result; extra columns are kept by `toxic_filter`, ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnworks.llm.bytetext import Rolling, mix, slices, spans, texts_of
from cairnworks.llm.common import read, release_memory

MAX_TOXIC, MAX_CLEAN = 1000, 2000
#: Longer labelled texts don't train.
MAX_CHARS = 50_000
#: The chain is fitted to runs of whole texts of about so many tokens, one run after another in each step.
RUN_TOKENS = 100_000
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
#: A feature labels tokens if fewer than FALSE of all features tried would have such contexts by chance, if they come
#: from two documents or more, and if they are toxic with such precision.
FALSE, MIN_PRECISION = 0.5, 0.9
#: The prior on the document calibration, in rows.
RIDGE = 0.1
#: Tokens of a lane: a sequence is walked in lanes of so many side by side.
LANE = 64


def token_features(data: np.ndarray, start: np.ndarray, end: np.ndarray, kinds: tuple[int, ...] = (0, *PREFIXES)) -> list[np.ndarray]:
    """Hashes of the word (kind 0) and of its first bytes; a prefix that is the whole word or longer is 0."""
    rolling, size = Rolling(data), end - start
    out = []
    for k in kinds:
        if not k:
            out.append(rolling.hash(start, end) | np.uint64(1))
            continue
        cut = mix(rolling.hash(start, np.minimum(start + k, end)) + np.uint64(k)) | np.uint64(1)
        out.append(np.where(size > k, cut, np.uint64(0)))
    return out


@dataclass
class Field:
    """Features (sorted hashes) with their weights for the toxic state, transitions, and the document calibration."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    bias: float = -6.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: np.ndarray = field(default_factory=lambda: np.array([-4.0, 0.0, 0.0]))

    def __post_init__(self):
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.features >> np.uint64(48)).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's feature number, len(features) if it is none."""
        none = len(self.features)
        out = np.full(len(hashes), none, np.int64)
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)]) if none else []
        if len(at):
            found = np.minimum(np.searchsorted(self.features, hashes[at]), none - 1)
            out[at] = np.where(self.features[found] == hashes[at], found, none)
        return out

    def emissions(self, columns: list[np.ndarray]) -> np.ndarray:
        return self.bias + sum(self.weights[self.places(c)] for c in columns)

    def marginals(self, emission: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Each token's probability of the toxic state; row: the ascending text number of each token."""
        if not len(row):
            return np.zeros(0)
        forward, backward = odds_along(np.exp(np.clip(emission, -30, 30)), row, np.exp(self.moves))
        odds = forward * backward
        return odds / (1 + odds)

    def score(self, expected: np.ndarray, largest: np.ndarray) -> np.ndarray:
        z = self.calibration[0] + self.calibration[1] * np.log1p(expected) + self.calibration[2] * largest
        return 1 / (1 + np.exp(-z))


def _mobius(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """x[t] = (c[t] + d[t] x[t-1]) / (a[t] + b[t] x[t-1]) from x[-1] = 1, over all t.

    Such maps compose as 2 x 2 matrices: lanes of LANE tokens are composed side by side, the lanes' starts follow one
    by one, then all lanes are walked side by side.
    """
    n = len(a)
    lanes = -(-n // LANE)
    grid = []
    for x, neutral in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0)):
        padded = np.full(lanes * LANE, neutral)
        padded[:n] = x
        grid.append(np.ascontiguousarray(padded.reshape(lanes, LANE).T))
    a, b, c, d = grid
    p, q, r, s = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for t in range(LANE):
        p, q, r, s = a[t] * p + b[t] * r, a[t] * q + b[t] * s, c[t] * p + d[t] * r, c[t] * q + d[t] * s
        if t % 8 == 7:
            scale = 1 / np.maximum(np.maximum(p, q), np.maximum(r, s))
            p, q, r, s = p * scale, q * scale, r * scale, s * scale
    start, now = np.ones(lanes), 1.0
    for i, (pi, qi, ri, si) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        start[i] = now
        now = (ri + si * now) / (pi + qi * now)
    out, x = np.empty((LANE, lanes)), start
    for t in range(LANE):
        x = (c[t] + d[t] * x) / (a[t] + b[t] * x)
        out[t] = x
    return out.T.reshape(-1)[:n]


def odds_along(e: np.ndarray, row: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of the toxic state at each token, e being the tokens' own odds and m[i, j] the moves'.

    A text begins as if after a clean token; texts follow one another in one sequence, cut by maps that forget.
    """
    border = row[1:] != row[:-1]
    first, last = np.concatenate([[True], border]), np.concatenate([border, [True]])
    forward = _mobius(np.full(len(e), m[0, 0]), np.where(first, 0.0, m[1, 0]), e * m[0, 1], np.where(first, 0.0, e * m[1, 1]))
    after = np.append(e[1:], 0.0)
    a, b = np.where(last, 1.0, m[0, 0]), np.where(last, 0.0, m[0, 1] * after)
    c, d = np.where(last, 1.0, m[1, 0]), np.where(last, 0.0, m[1, 1] * after)
    return forward, _mobius(a[::-1], b[::-1], c[::-1], d[::-1])[::-1]


def _distinct(feature: np.ndarray, of: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, numbers of different `of` of toxic and of clean rows)."""
    pair = mix(of)
    pair += feature
    pair = mix(pair)
    at = np.argsort(pair)
    pair = pair[at]
    at = at[np.concatenate([[True], pair[1:] != pair[:-1]])]
    del pair
    names, inverse = np.unique(feature[at], return_inverse=True)
    return names, np.bincount(inverse, toxic[at], len(names)), np.bincount(inverse, ~toxic[at], len(names))


def _log_chance(toxic: np.ndarray, clean: np.ndarray, rate: float) -> np.ndarray:
    """A bound on the log probability of so many toxic ones or more among all, each being toxic at this rate (Chernoff)."""
    n = np.maximum(toxic + clean, 1e-9)
    x = toxic / n
    bound = n * (x * np.log(np.maximum(x, 1e-12) / rate) + (1 - x) * np.log(np.maximum(1 - x, 1e-12) / (1 - rate)))
    return np.where(x > rate, -bound, 0.0)


def _evidence(columns: Iterable[np.ndarray], context: np.ndarray, row: np.ndarray, toxic_row: np.ndarray, clean_weight: float = 1.0) -> np.ndarray:
    """Which tokens of toxic documents have a feature that tells toxic documents from clean ones; clean_weight: of a clean row, a toxic one's being 1."""
    toxic = toxic_row[row]
    label = np.zeros(len(toxic), bool)
    for column in columns:
        # A quarter of the features at a time, which bounds the memory.
        parts = []
        for quarter in range(4):
            some = np.flatnonzero((column > 0) & ((column >> np.uint64(1)) & np.uint64(3) == quarter))
            feature, is_toxic = column[some], toxic[some]
            names, by_toxic, by_clean = _distinct(feature, context[some], is_toxic)
            _, toxic_rows, _ = _distinct(feature, row[some].astype(np.uint64) + np.uint64(1), is_toxic)
            parts.append((names, by_toxic, by_clean, toxic_rows))
        names, by_toxic, by_clean, toxic_rows = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(names):
            continue
        rate = np.clip(by_toxic.sum() / (by_toxic.sum() + clean_weight * by_clean.sum()), 1e-6, 1 - 1e-6)
        tried = max(1, int((by_toxic > 1).sum()))
        telling = (toxic_rows > 1) & (by_toxic >= MIN_PRECISION * (by_toxic + clean_weight * by_clean))
        telling &= _log_chance(by_toxic, clean_weight * by_clean, rate) <= np.log(FALSE / tried)
        label |= toxic & np.isin(column, names[telling])
    return label


def text_runs(row: np.ndarray) -> list[slice]:
    """Runs of tokens of whole texts, of about RUN_TOKENS."""
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    cuts = np.unique(begin[np.searchsorted(begin, np.arange(0, len(row), RUN_TOKENS), "left").clip(max=max(len(begin) - 1, 0))]) if len(row) else begin
    return [slice(int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(row)], strict=True)]


def _fit_chain(places: np.ndarray, row: np.ndarray, label: np.ndarray, weight: np.ndarray, n_features: int, steps: int = 50) -> tuple[np.ndarray, float, np.ndarray]:
    """Gradient ascent (Adam) on the likelihood of the labels; places: the features of each token, weight: of its text."""
    theta = np.concatenate([np.zeros(n_features + 1), [-3.0], np.zeros(4)])
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    runs = []
    for at in text_runs(row):
        # Most tokens have none of the features.
        held = np.flatnonzero((places[at] < n_features).any(1)) + at.start
        y, inside = label[at].astype(float), (row[at][1:] == row[at][:-1]) * weight[at][1:]
        seen = np.array([[((1 - y[:-1]) * (1 - y[1:]) * inside).sum(), ((1 - y[:-1]) * y[1:] * inside).sum()], [(y[:-1] * (1 - y[1:]) * inside).sum(), (y[:-1] * y[1:] * inside).sum()]])
        runs.append((at, held - at.start, places[held], seen))
    for step in range(1, steps + 1):
        weights, bias, moves = theta[: n_features + 1].copy(), theta[n_features + 1], np.exp(theta[-4:].reshape(2, 2))
        weights[n_features] = 0
        gradient = -0.5 * theta
        for at, held, own, seen in runs:
            emission = np.full(at.stop - at.start, bias)
            emission[held] += weights[own].sum(1)
            e = np.exp(np.clip(emission, -30, 30))
            forward, backward = odds_along(e, row[at], moves)
            odds = forward * backward
            ahead, before = e[1:] * backward[1:], forward[:-1]
            inside = (row[at][1:] == row[at][:-1]) * weight[at][1:]
            paths = np.stack([np.full(len(ahead), moves[0, 0]), moves[0, 1] * ahead, moves[1, 0] * before, moves[1, 1] * before * ahead])
            pair = (paths * (inside / paths.sum(0))).sum(1).reshape(2, 2)
            gap = (label[at] - odds / (1 + odds)) * weight[at]
            gradient[: n_features + 1] += np.bincount(own.reshape(-1), np.repeat(gap[held], own.shape[1]), n_features + 1)
            gradient[n_features + 1] += gap.sum()
            gradient[-4:] += (seen - pair).reshape(-1)
        m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.99 * m2 + 0.01 * gradient**2
        theta = theta + 0.25 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    weights = theta[: n_features + 1]
    weights[n_features] = 0
    return weights, theta[n_features + 1], theta[-4:].reshape(2, 2)


def fit(texts: pa.Array, toxic: np.ndarray, steps: int = 50, shares: tuple[float, float] = (1.0, 1.0), max_windows: int | None = None) -> Field:
    """Fit the field and the document calibration on labelled texts, a bounded sample.

    shares: which parts of the clean and of the toxic rows it holds. max_windows: the chain is fitted to at most so many
    texts with and as many without toxic tokens, each standing for its share (by default to all).
    """
    weight = np.where(toxic, 1 / shares[1], 1 / shares[0])
    weight /= weight.mean() if len(weight) else 1  # the priors on the weights are set against as many rows as were drawn
    whole = pa.RecordBatch.from_arrays([texts], ["text"])
    rows, before = [np.zeros(0, np.int64)], 0
    for part in slices(whole):
        rows.append(spans(*texts_of(part.column("text")), letters=True)[2] + before)
        before += part.num_rows
    row = np.concatenate(rows)
    del rows

    def column(kind: int) -> np.ndarray:
        """One kind of feature of all tokens; the kinds are made one after another to bound the driver's memory."""
        out, at = np.zeros(len(row), np.uint64), 0
        for part in slices(whole):
            data, offsets = texts_of(part.column("text"))
            start, end, _ = spans(data, offsets, letters=True)
            out[at : at + len(start)] = token_features(data, start, end, (kind,))[0]
            at += len(start)
        return out

    if not len(row) or toxic.all() or not toxic.any():
        rate = np.clip(np.average(toxic, weights=weight) if len(toxic) else 0.02, 0.02, 0.98)
        return Field(calibration=np.array([np.log(rate / (1 - rate)), 0.0, 0.0]))
    kinds = (0, *PREFIXES)
    context = np.concatenate([[np.uint64(0)], column(0)[:-1]])
    context[1:][row[1:] != row[:-1]] = 0
    label = _evidence(map(column, kinds), context, row, toxic, shares[1] / shares[0])
    del context
    known = []
    for kind in kinds:
        of_labelled = column(kind)[label]
        names, times = np.unique(of_labelled[of_labelled > 0], return_counts=True)
        known.append(names[times >= 2])
    features = np.unique(np.concatenate(known))
    model = Field(features, np.zeros(len(features) + 1))
    places = np.empty((len(row), len(kinds)), np.int32)
    for i, kind in enumerate(kinds):
        places[:, i] = model.places(column(kind))
    of_text = weight.copy()
    if max_windows is not None:
        marked = np.bincount(row, label, len(toxic)) > 0
        for kind in (marked, ~marked):
            some = np.flatnonzero(kind)
            left_out = some[np.random.default_rng(7).permutation(len(some))[max_windows:]]
            of_text[some] *= max(1.0, len(some) / max_windows)
            of_text[left_out] = 0
    at = np.flatnonzero(of_text[row] > 0)
    token_weight = of_text[row[at]]
    if len(at) == len(row):
        at = slice(None)
    weights, bias, moves = _fit_chain(places[at], row[at], label[at], token_weight / token_weight.mean(), len(features), steps)
    model = Field(features, weights, float(bias), moves)
    p = np.concatenate([model.marginals(model.bias + model.weights[places[at]].sum(-1), row[at]) for at in text_runs(row)])
    expected, largest = document_sums(p, row, len(toxic))
    x, target = np.stack([np.ones(len(toxic)), np.log1p(expected), largest], 1), toxic.astype(float)
    theta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(3)
        theta = theta + np.linalg.solve(hessian, x.T @ (weight * (target - p)) - RIDGE * theta)
    model.calibration = theta
    return model


def document_sums(p: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    largest = np.zeros(n)
    np.maximum.at(largest, row, p)
    return np.bincount(row, p, n), largest


def train(documents: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_windows: int | None = None, max_chars: int = MAX_CHARS) -> Field:
    """Fit on at most about max_toxic + max_clean labelled rows of at most max_chars code points, drawn by a hash of their ids and weighted by their drawn shares; held-out rows never take part."""
    rows = labels.select(F.col("doc_id").alias("_id"), "toxic").filter(F.col("toxic").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, most / max(1, counts.get(k, 0))) for k, most in ((1, max_toxic), (0, max_clean))}
    draw = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    drawn = rows.filter(draw < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    # The drawn rows are bounded by the two parameters, so they may be broadcast and brought to the driver.
    sample = documents.select("doc_id", "text").filter(F.coalesce(F.length("text"), F.lit(0)) <= max_chars).join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic").toArrow().sort_by("doc_id")
    texts, toxic = sample.column("text").combine_chunks(), sample.column("toxic").to_numpy() == 1
    del sample
    model = fit(texts, toxic, shares=(share[0], share[1]), max_windows=max_windows)
    del texts, toxic
    release_memory()
    return model


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def scored(model: Field, batch: pa.RecordBatch) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """(scores, spans in code points) of the batch's texts."""
    data, offsets = texts_of(batch.column("text"))
    start, end, row = spans(data, offsets, letters=True)
    n = len(offsets) - 1
    p = model.marginals(model.emissions(token_features(data, start, end)), row) if len(start) else np.zeros(0)
    expected, largest = document_sums(p, row, n)
    marked: list[list[tuple[int, int, float]]] = [[] for _ in range(n)]
    for i in np.flatnonzero(p >= 0.5):
        text = offsets[row[i]]
        before = int(np.count_nonzero((data[text : start[i]] & 0xC0) != 0x80))
        inside = int(np.count_nonzero((data[start[i] : end[i]] & 0xC0) != 0x80))
        marked[row[i]].append((before, before + inside, float(p[i])))
    return model.score(expected, largest), marked


def toxicity(documents: DataFrame, model: Field) -> DataFrame:
    """documents(doc_id, text) -> doc_id, score, n_spans, spans (code point ranges with their marginals)."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # a few thousand features

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            for part in slices(batch):
                score, marked = scored(held.value, part)
                listed = pa.array([[{"start": a, "end": b, "p": p} for a, b, p in m] for m in marked], kind)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array([len(m) for m in marked], pa.int32()), listed], ["doc_id", "score", "n_spans", "spans"])

    return documents.select("doc_id", "text").mapInArrow(work, "doc_id long, score double, n_spans int, spans array<struct<start:int,end:int,p:double>>")


def toxic_filter(documents: DataFrame, model: Field, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents whose score is below the threshold, with all their columns."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(scored(held.value, part)[0] < threshold))

    return documents.mapInArrow(work, documents.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    rows = toxicity(documents, train(documents, read(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_spans", "spans")
