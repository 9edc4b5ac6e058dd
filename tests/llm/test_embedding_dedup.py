import numpy as np
import pytest

from latentfield.llm import embedding_dedup as E


def brute(rows, least=0.93):
    good = [k for k, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for i in good:
        for j in good:
            a, b = rows[i], rows[j]
            if i < j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    links[i].add(j)
                    links[j].add(i)
    out = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for m in links[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        out[rows[k][0]] = (len(links[k]), min(rows[m][0] for m in seen))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    out = []
    for c in range(60):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 9)):
            out.append((centre + rng.normal(0, rng.choice([0.05, 0.2, 0.35]), 16)).astype(np.float32).tolist())
    hot = rng.standard_normal(16)
    out += [(hot + rng.normal(0, 0.05, 16)).astype(np.float32).tolist() for _ in range(150)]
    out = [(k, v, k % 2) for k, v in enumerate(out)]
    n = len(out)
    odd = [None, [], [0.0] * 16, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] * 16, out[0][1], out[0][1], out[0][1], [1.0, 2.0], [2.0, 4.0]]
    return out + [(n + k, v, 0) for k, v in enumerate(odd)] + [(n + 20, out[0][1], None)]


@pytest.mark.parametrize(("run", "chunk"), [(256, 1024), (8, 16)])
def test_equals_brute_force(spark, rows, monkeypatch, run, chunk):
    monkeypatch.setattr(E, "RUN", run)
    monkeypatch.setattr(E, "CHUNK", chunk)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS copies", "2 AS n", "3 AS key")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(df, miss=1e-9).collect()}
    assert got == brute(rows)


def test_links_at_the_defaults(spark):
    """Planted pairs at 0.93 to 0.95 among 6,000 vectors of one label, so that runs are many: nearly none is missed at the production parameters, none is added."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal(x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cos = rng.uniform(0.931, 0.95, (3000, 1))
    v = np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * y]).astype(np.float32)
    near = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    want = {k: int((near[k] @ near.T >= 0.93).sum()) - 1 for k in range(6000)}
    got = {r.vec_id: r.n_links for r in E.near_duplicates(spark.createDataFrame([(k, e, 1) for k, e in enumerate(v.tolist())], "vec_id long, embedding array<float>, label int")).collect()}
    assert all(got[k] <= n for k, n in want.items()) and sum(got.values()) >= 0.999 * sum(want.values()) > 5990


def test_rows_that_repeat_an_id(spark):
    a, b = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1]
    rows = [(1, a, 0), (1, b, 0), (2, [1.0, 0.0, 0.2], 0), (3, [0.0, 1.0, 0.2], 0), (4, a, 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 2, 1)]


def test_doubles_stay_doubles(spark):
    third = [1 / 3, 2 / 3, 1e300]
    got = E.near_duplicates(spark.createDataFrame([(1, third, 0), (2, [0.0, 0.0, 5.0], 0), (3, [1.0, 0.0, 0.0], 0)], "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_recall_of_passes():
    assert E.passes_for(3, 0.93, 1e-4) == E.PASSES and E.passes_for(20, 0.93, 1e-4) > 100


def test_empty_and_unusable(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert E.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = E.near_duplicates(spark.createDataFrame([(1, None, 1), (None, [1.0], 1), (2, [1.0], None)], schema)).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(1, 0, 1), (2, 0, 2), (None, 0, None)}


def test_small_labels_have_few_passes(spark, monkeypatch):
    """A label has as many passes as its own prefix needs, whatever the largest label needs, and links are those of brute force."""
    monkeypatch.setattr(E, "RUN", 2)
    monkeypatch.setattr(E, "PASSES", 4)
    rng = np.random.default_rng(7)
    rows = [(k, (rng.standard_normal(8) if k % 3 else np.ones(8) + rng.normal(0, 0.1, 8)).tolist(), 0 if k < 500 else 1 + k % 40) for k in range(700)]
    staged, seen = E.staged, {}

    def watching(df, name):
        seen[name] = staged(df, name)
        return seen[name]

    monkeypatch.setattr(E, "staged", watching)
    monkeypatch.setattr(E, "discard", lambda df: None)
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), miss=1e-9).collect()}
    assert got == brute(rows)
    n = {r.label: r.n for r in seen["vector-hashes"].selectExpr("label", "size(keys) AS n").distinct().collect()}
    assert n["0"] > 3 * n["1"] and n["1"] == E.passes_for(2, 0.93, 1e-9)
