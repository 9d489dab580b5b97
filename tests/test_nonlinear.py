"""Clustering, kernel machines, shadows, windows and searches against brute force on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.operators import clustering, kernels, models, search, selection, windows


def table(spark, x, **more):
    names, cols = list(more), [np.asarray(v).tolist() for v in more.values()]
    rows = [(i, v.tolist(), *c) for i, (v, *c) in enumerate(zip(x, *cols, strict=True))]
    kinds = "".join(f", {n} {'string' if isinstance(c[0], str) else 'double'}" for n, c in zip(names, cols, strict=True))
    return spark.createDataFrame(rows, f"id long, v array<double>{kinds}").repartition(3)


def brute_linkage(x, method, weights=None):
    """(height, size) of each merge, by looking at all pairs of clusters every time."""
    w = np.ones(len(x)) if weights is None else np.asarray(weights, float)
    held = {i: [i] for i in range(len(x))}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))

    def apart(a, b):
        pairs = d[np.ix_(a, b)]
        if method == "ward":
            na, nb = w[a].sum(), w[b].sum()
            ma, mb = (w[a][:, None] * x[a]).sum(0) / na, (w[b][:, None] * x[b]).sum(0) / nb
            return math.sqrt(2 * na * nb / (na + nb)) * np.linalg.norm(ma - mb)
        if method == "average":
            return float((w[a] @ pairs @ w[b]) / (w[a].sum() * w[b].sum()))
        return float(pairs.max() if method == "complete" else pairs.min())

    out = []
    while len(held) > 1:
        height, i, j = min((apart(held[i], held[j]), i, j) for i in held for j in held if i < j)
        held[i] = held[i] + held.pop(j)
        out.append((height, int(w[held[i]].sum())))
    return out


@pytest.mark.parametrize("method", ["ward", "average", "complete", "single"])
def test_linkages_equal_brute_force(method):
    x = np.random.default_rng(1).normal(size=(60, 3))
    got = clustering.lance_williams(x, np.ones(60, int), method)
    want = brute_linkage(x, method)
    assert [g[3] for g in got] == [size for _, size in want]
    assert np.allclose([g[2] for g in got], [b[0] for b in want])
    weights = np.random.default_rng(2).integers(1, 9, 25)
    assert np.allclose([g[2] for g in clustering.lance_williams(x[:25], weights, method)], [b[0] for b in brute_linkage(x[:25], method, weights)])


def test_spanning_tree_is_single_linkage(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 30)  # several blocks, so that cells between blocks matter
    x = np.random.default_rng(3).normal(size=(90, 4))
    x[17] = x[3]
    df = table(spark, x).unionAll(spark.createDataFrame([(None, [0.0] * 4), (900, None)], "id long, v array<double>"))
    tree = clustering.spanning_tree(df, "id", "v")
    edges = tree.collect()
    want = brute_linkage(x, "single")
    assert len(edges) == 89 and np.allclose(sorted(e.distance for e in edges), [h for h, _ in want])
    rows = clustering.linkage_of_tree(df.where("v is not null"), "id", tree).orderBy("step").collect()
    assert np.allclose([r.height for r in rows], [h for h, _ in want]) and [r.size for r in rows][-1] == 90
    cut = float(np.median([e.distance for e in edges])) + 1e-9
    found = {r.id: r.cluster for r in clustering.single_linkage(df, "id", "v", cut).collect()}
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= cut
    name = np.arange(90)
    while not np.array_equal(name, least := np.where(near, name[None], 90).min(1)):
        name = least
    assert found == dict(enumerate(name.tolist()))


def test_clusters_of_small_and_large_tables(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.1, size=(40, 2)) for c in ([0, 0], [5, 0], [0, 5])])
    for prototypes in (500, 12):
        got = [r.cluster for r in clustering.clusters(table(spark, x), "id", "v", 3, "ward", prototypes).orderBy("id").collect()]
        assert len(got) == 120 and all(len(set(got[i : i + 40])) == 1 for i in (0, 40, 80)) and len(set(got)) == 3
    empty = table(spark, x).limit(0)
    assert clustering.hierarchy(empty, "id", "v")[0].count() == 0 and clustering.spanning_tree(empty, "id", "v").count() == 0
    assert clustering.single_linkage(table(spark, x[:1]), "id", "v", 1.0).collect()[0].cluster == 0


def exact_machine(k, y, c, steps=20_000):
    """Dual support vector machine without intercept, by projected coordinate steps."""
    a = np.zeros(len(y))
    q = k * np.outer(y, y)
    for i in np.random.default_rng(0).integers(0, len(y), steps):
        a[i] = np.clip(a[i] + (1 - q[i] @ a) / q[i, i], 0, c)
    return a * y


def test_fourier_features_are_the_kernel():
    x = np.random.default_rng(5).normal(size=(80, 6))
    z = kernels.fourier(6, 0.1, 4096).of(x)[:, :-1]
    exact = np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - exact).max() < 0.1 and np.abs(z @ z.T - exact).mean() < 0.015


def test_svc_is_as_good_as_the_exact_machine(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 2))
    y = np.where((x**2).sum(1) < 1.2, "in", "out")
    df = table(spark, x, y=y)
    train, test = df.where("id < 400"), df.where("id >= 400 and v is not null")
    names, machine = kernels.svc(train.unionAll(spark.createDataFrame([(None, None, "in"), (1, [0.0, 0.0], None)], train.schema)), "v", "y")
    got = models.classify(test, "v", names, machine).select((F.col("y") == F.col("yhat")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    gamma = kernels.scale_gamma(train, "v")
    assert gamma == pytest.approx(1 / (2 * x[:400].var()))
    kernel = lambda a, b: np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(2))
    a = exact_machine(kernel(x[:400], x[:400]), np.where(y[:400] == "in", 1.0, -1.0), 1.0)
    exact = ((kernel(x[400:], x[:400]) @ a > 0) == (y[400:] == "in")).mean()
    assert names == ["in", "out"] and got > exact - 0.02 and got > 0.93


def test_svr_follows_a_curve(spark):
    x = np.random.default_rng(7).uniform(-3, 3, size=(500, 1))
    y = np.sin(2 * x[:, 0]) + 10
    df = table(spark, x, y=y)
    out = kernels.svr(df.where("id < 400"), "v", "y", c=10.0, epsilon=0.05, gamma=1.0).scores(df.where("id >= 400"), "v").select("y", F.col("yhat")[0].alias("p")).toPandas()
    assert np.abs(out.y - out.p).max() < 0.2


def test_l_bfgs_reaches_the_minimum():
    q = np.diag([1.0, 10.0, 100.0])
    w = kernels.minimise(lambda w: (float((w.T @ q @ w).item() / 2 - w.sum()), q @ w - 1), np.zeros((3, 1)), tolerance=1e-8)
    assert np.allclose(w[:, 0], [1, 0.1, 0.01], atol=1e-6)


def test_shadows_keep_values_and_lose_order(spark):
    x = np.random.default_rng(8).normal(size=(300, 3))
    df = table(spark, x, y=x[:, 0])
    one = selection.shadowed(df, "id", "v", 1, groups=4).orderBy("id").collect()
    assert [r.v[:3] for r in one] == x.tolist() and [r.y for r in one] == x[:, 0].tolist()
    mixed = np.array([r.v[3:] for r in one])
    assert all(np.array_equal(np.sort(mixed[:, j]), np.sort(x[:, j])) for j in range(3)) and abs(np.corrcoef(mixed[:, 0], x[:, 0])[0, 1]) < 0.2
    again = selection.shadowed(df.repartition(7), "id", "v", 1, groups=4).orderBy("id").collect()
    assert [r.v for r in again] == [r.v for r in one] and [r.v for r in selection.shadowed(df, "id", "v", 2, groups=4).orderBy("id").collect()] != [r.v for r in one]


def test_boruta_confirms_what_matters(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 8))
    df = table(spark, x, y=2 * x[:, 1] - x[:, 4], c=np.where(x[:, 1] > 0, "a", "b"))
    found = selection.boruta(df, "id", "v", "y", False, rounds=10, trees=12, depth=5)
    assert set(np.flatnonzero(found.state == 1)) == {1, 4} and (found.state[[0, 2, 3, 5, 6, 7]] != 1).all()
    assert found.mask().tolist() == (found.state == 1).tolist()
    short = [selection.boruta(df.repartition(k), "id", "v", "c", True, rounds=2, trees=8, depth=4) for k in (1, 4)]
    assert short[0].hits.tolist() == short[1].hits.tolist() and short[0].hits[1] == 2


def test_decisions_of_the_binomial_test():
    assert selection._tail(3, 3)[0] == pytest.approx(1 / 8) and selection._tail(0, 3) == (1.0, pytest.approx(1 / 8))
    assert selection._step_up(np.array([0.01, 0.02, 0.03, 0.2]), 0.05).tolist() == [True, True, True, False]
    d = selection.Decisions(np.array([12, 0, 6]), np.zeros(3, int), [np.array([3.0, 0, 2.5])], [2.0])
    d.decide(12, 0.05)
    assert d.state.tolist() == [1, -1, 0] and d.tentative().tolist() == [False, False, True] and d.mask().tolist() == [True, False, True]


def test_scrambled_windows(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(250, 12))
    df = table(spark, x, y=3 * x[:, 0] + x[:, 5], fold=np.arange(250) % 3.0)
    parts = windows.cuts(12, 4)
    assert parts == [(0, 3), (3, 6), (6, 9), (9, 12)] and windows.cuts(3, 9) == [(0, 1), (1, 2), (2, 3)]
    found, base, variables = windows.forest_importance(df, "id", "v", "y", "fold", parts, False, trees=20, depth=6)
    loss = {r.win: r.loss for r in found.collect()}
    assert loss[0] > loss[1] > 5 * max(loss[2], loss[3]) and base > 0 and variables.argmax() == 0
    assert {r.importance for r in found.where("win = 0").collect()} == {1.0}
    constant = df.withColumn("v", F.transform("v", lambda a, i: F.when(i >= 9, 1.0).otherwise(a)))
    unused = windows.forest_importance(constant, "id", "v", "y", "fold", parts, False, trees=5, depth=4)[0]
    assert unused.where("win = 3").first().loss == 0
    by_class = df.withColumn("c", F.when(F.col("v")[0] > 0, "p").otherwise("n"))
    loss = {r.win: r.loss for r in windows.forest_importance(by_class, "id", "v", "c", "fold", parts, True, trees=10, depth=5)[0].collect()}
    assert max(loss, key=loss.get) == 0


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def brute_mi(x, label, k=3):
    kept = [(a, c) for a, c in zip(x, label, strict=True) if label.count(c) > 1]
    terms = []
    for i, (a, c) in enumerate(kept):
        own = sorted(abs(b - a) for j, (b, e) in enumerate(kept) if e == c and j != i)
        kk = min(k, len(own))
        d = own[kk - 1]
        inside = sum(abs(b - a) < d or b == a for b, _ in kept)
        terms.append(psi(kk) - psi(len(own) + 1) - psi(inside))
    return max(0.0, psi(len(kept)) + sum(terms) / len(terms)) if kept else None


@pytest.mark.parametrize("block", [4, 65_536])
def test_mutual_information(spark, monkeypatch, block):
    monkeypatch.setattr(windows, "BLOCK", block)
    rng = random.Random(11)
    label = [rng.choice("aaab") for _ in range(300)] + ["once"]
    cols = {
        0: [rng.gauss(3 * (c == "b"), 1) for c in label],
        1: [float(rng.randrange(6)) + (c == "b") for c in label],  # ties
        2: [rng.random() for _ in label],
        3: [1.0] * len(label),
    }
    rows = [(w, x, c) for w, xs in cols.items() for x, c in zip(xs, label, strict=True)]
    df = spark.createDataFrame([*rows, (0, None, "a"), (1, 1.0, None), (4, 1.0, "alone")], "win int, x double, c string").repartition(4)
    got = {r.win: r.mi for r in windows.mutual_information(df, "c").collect()}
    assert set(got) == set(cols)
    for w, xs in cols.items():
        assert got[w] == pytest.approx(brute_mi(xs, label), abs=1e-9)
    assert got[0] > got[2]


def test_digamma(spark):
    got = spark.range(1, 400).select("id", windows.digamma(F.col("id")).alias("p")).collect()
    assert all(r.p == pytest.approx(psi(r.id), abs=1e-11) for r in got)


def test_searches(spark):
    space = {"a": list(range(12)), "b": [0.1, 0.2, 0.4, 0.8, 1.6], "c": ["x", "y", "z"]}
    value = lambda s: -((s["a"] - 7) ** 2) - 4 * (s["b"] != 0.4) - (s["c"] != "y")
    calls = []

    def score(s):
        calls.append(s)
        return float(value(s))

    full = search.tpe(spark, space, score, 40, seed=3)
    rows = full.orderBy("trial").collect()
    asked = len(calls)
    assert len(rows) == 40 and asked == len({tuple(sorted(r.params.items())) for r in rows})
    half = search.tpe(spark, space, score, 17, seed=3)
    calls.clear()
    resumed = search.tpe(spark, space, score, 40, done=half, seed=3).orderBy("trial").collect()
    assert resumed == rows and len(calls) < asked
    best = lambda df: max(r.score for r in df.collect())
    wide = {"a": list(range(40)), "b": list(range(20)), "c": ["x", "y", "z"]}
    surface = lambda s: -((s["a"] - 27) ** 2) / 9 - abs(s["b"] - 4) - 3.0 * (s["c"] != "y")
    led, blind = (sum(best(f(spark, wide, surface, 60, seed=i)) for i in range(6)) for f in (search.tpe, search.drawn))
    assert led > blind
    drawn = search.drawn(spark, space, score, 50, seed=1).collect()
    assert len({tuple(sorted(r.params.items())) for r in drawn}) == 50
    assert len(search.random_settings({"a": [1, 2], "b": [3]}, 9)) == 2 and len(search.random_settings({f"p{i}": list(range(10)) for i in range(9)}, 5)) == 5
    failing = search.tpe(spark, {"a": [1, 2]}, lambda s: None if s["a"] == 1 else 1.0, 15).collect()
    assert {r.score for r in failing} == {None, 1.0}
