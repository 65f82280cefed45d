import numpy as np
import pytest

from cairnworks.llm import near_vectors
from cairnworks.llm.queries import QUERIES
from tests.conftest import SMALL

KIND = "vec_id long, embedding array<double>, label int, vec string, m int, space int, n_links int, unit int"


def brute(rows, least=0.93):
    """(vec_id, n_links, component_id) by comparing all pairs."""
    ok = [i for i, (v, e, lab) in enumerate(rows) if v is not None and e and lab is not None and None not in e and np.isfinite(e).all() and np.any(np.array(e) != 0)]
    links, group = {i: 0 for i in range(len(rows))}, {i: i for i in range(len(rows))}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in ok}
    for k, i in enumerate(ok):
        for j in ok[:k]:
            if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                group[top(i)] = top(j)
    least_of = {}
    for i in ok:
        least_of[top(i)] = min(least_of.get(top(i), rows[i][0]), rows[i][0])
    return sorted((v if v is not None else -1, links[i], least_of[top(i)] if i in unit else (v if v is not None else -1)) for i, (v, _, _) in enumerate(rows))


def planted(seed=4, d=24):
    """Tight and loose groups, a chain, copies, scaled copies, plain noise."""
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(d) for _ in range(150)]
    for size, noise in ((60, 0.02), (40, 0.055), (30, 0.07), (2, 0.06), (2, 0.03), (3, 0.07)):
        base = rng.standard_normal(d)
        base /= np.linalg.norm(base)
        out += [base + noise * rng.standard_normal(d) for _ in range(size)]
    a, b = np.linalg.qr(rng.standard_normal((d, 2)))[0].T
    out += [np.cos(t) * a + np.sin(t) * b for t in np.arange(12) * np.radians(17)]
    out += [out[0]] * 20 + [out[1] * 3.0, out[160], out[160]]
    order = rng.permutation(len(out))
    return [(int(i), [float(x) for x in out[k]], int(k % 7 == 0)) for i, k in enumerate(order)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], KIND).repartition(3)


def result(df):
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["n_links"], -1 if r["component_id"] is None else r["component_id"]) for r in df.collect())


def test_whole_when_the_window_holds_a_label(spark):
    rows = planted()
    assert result(near_vectors.near_vectors(frame(spark, rows), window=400)) == brute(rows)


def test_small_windows_and_blocks_find_no_false_link(spark, monkeypatch):
    monkeypatch.setattr(near_vectors.component_links, "__defaults__", (0.93, 8))
    rows = planted(5)
    got, want = result(near_vectors.near_vectors(frame(spark, rows), window=4)), brute(rows)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.95 * sum(w[1] for w in want)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, -0.0], 1), (7, [nan, 1.0], 1), (8, [1.0, None], 1), (9, [inf, 0.0], 1), (10, [], 1)]
    rows += [(2, [2.0, 0.01], 1), (2, [0.0, 1.0], 1), (None, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e-300, 1e-302], 1), (13, [1e300, 0.0], 1), (14, [-1.0, 0.0], 1)]
    got = near_vectors.near_vectors(frame(spark, rows))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    tidy = [(v, e if v not in (12, 13) else [1.0, 0.01 * (v == 12)], lab) for v, e, lab in rows]
    assert result(got) == brute(tidy)
    assert all(r["kept"] is None if r["vec_id"] is None else r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.collect())


def test_empty_and_no_links(spark):
    assert near_vectors.near_vectors(frame(spark, []).filter("1 = 0")).collect() == []
    assert result(near_vectors.near_vectors(frame(spark, [(3, [1.0, 0.0], 1), (4, [0.0, 1.0], 1)]))) == [(3, 0, 3), (4, 0, 4)]


def test_decided_pairs_are_proved():
    """8-bit steps decide a pair only if its true cosine is on that side."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal(48)
    unit = np.stack([base + s * rng.standard_normal(48) for s in rng.uniform(0.2, 0.4, 200)])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    step = np.abs(unit).max(1) / 127
    steps = np.rint(unit / step[:, None]).astype(np.int8)
    left = np.linalg.norm(unit - steps * step[:, None], axis=1)
    made = near_vectors._compare(np.arange(200), steps, step, left, 0, 0.93, 200)
    sure = [(a, b) for x, y, s in made if s for a, b in zip(x, y, strict=True)]
    maybe = [(a, b) for x, y, s in made if not s for a, b in zip(x, y, strict=True)]
    assert sure and maybe
    met = {frozenset(p) for p in maybe}
    near = [(i, j) for i in range(200) for j in range(i) if unit[i] @ unit[j] >= 0.93]
    group = {i: i for i in range(200)}
    for a, b in sure:
        group[int(a)] = int(b)
    assert all(group[i] == group[j] or frozenset((i, j)) in met for i, j in near)


def test_passes_grow_slowly():
    assert near_vectors.passes(10) == 2 and near_vectors.passes(50_000) < 12 < near_vectors.passes(10**8) < 60


@pytest.mark.parametrize("name", ["op13_near_vectors"])
def test_query(spark, name):
    rows = [(r["vec_id"], list(map(float, r["embedding"])), r["label"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert result(QUERIES[name](spark, SMALL)) == brute(rows)
