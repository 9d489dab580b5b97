"""Pairs of rows at size: what is shuffled and how many passes are made, and results against all pairs."""

import numpy as np
import pytest

from spectraloom.operators import clustering, models, pairs, sampling


def jobs_of(spark, name, f):
    """f's result, the number of its jobs and the bytes that their stages shuffled."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    out = f()
    jobs = sc.statusTracker().getJobIdsForGroup(name)
    sc.setJobGroup("other", "other")
    stages = {s for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds}
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    listed = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return out, len(jobs), sum(listed.apply(i).shuffleWriteBytes() for i in range(listed.size()) if listed.apply(i).stageId() in stages)


def table(spark, x, **more):
    names, cols = list(more), [np.asarray(v).tolist() for v in more.values()]
    kinds = "".join(f", {n} {'string' if isinstance(c[0], str) else 'double'}" for n, c in zip(names, cols, strict=True))
    return spark.createDataFrame([(i, v.tolist(), *c) for i, (v, *c) in enumerate(zip(x, *cols, strict=True))], f"id long, v array<double>{kinds}").repartition(3)


def greedy(d, n):
    chosen = sorted(int(i) for i in np.unravel_index(d.argmax(), d.shape))
    least = d[:, chosen].min(1)
    while len(chosen) < n:
        least[chosen] = -1
        chosen.append(int(least.argmax()))
        least = np.minimum(least, d[:, chosen[-1]])
    return chosen


def test_classes_share_passes_and_ties_need_none_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 50)
    rng = np.random.default_rng(31)
    x, c = rng.integers(0, 3, size=(600, 3)).astype(float), np.arange(600) % 5  # 27 points, many times each
    marked, jobs, _ = jobs_of(spark, "classes", lambda: sampling.split(table(spark, x, c=c.astype(str)), "id", "v", 0.2, "c").where("held_out").collect())
    want = set()
    for k in range(5):
        own = np.flatnonzero(c == k)
        d = np.sqrt(((x[own][:, None] - x[own][None]) ** 2).sum(2))
        want |= set(own.tolist()) - {int(own[i]) for i in greedy(d, 96)}
    assert {r.id for r in marked} == want
    assert jobs < 150  # a pass for each chosen row of 480 would take more


def test_rows_that_are_not_finite_are_left_out(spark):
    x = np.array([[0.0, 0.0], [1.0, 0.0], [np.nan, 0.0], [3.0, 0.0], [np.inf, 0.0]])
    assert [r.id for r in sampling.farthest(table(spark, x), "id", "v", 5).orderBy("place").collect()] == [0, 3, 1]


@pytest.mark.parametrize("high", [False, True])
def test_bounds_hold(high):
    rng = np.random.default_rng(32)
    for scale in (1e-200, 1.0, 1e150):
        x, y = (rng.normal(size=(40, 9)) * 10.0 ** rng.integers(-6, 6, size=(40, 1)) + 1e3 for _ in range(2))
        b = pairs.Bounds(x * scale, y * scale, high)
        d = np.sqrt((((x * scale)[:, None] / scale - (y * scale)[None] / scale) ** 2).sum(2)) * scale
        tile = b.tile(slice(None), slice(None))
        assert (tile >= b.limit(d, up=False)).all() if high else (tile <= b.limit(d, up=True)).all()


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(33)
    x, y = rng.normal(size=(600, 64)), rng.normal(size=600) ** 3
    return x, y, table(spark, x, y=y).cache()


def test_joint_choice_shuffles_no_pairs(spark, wide, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 30)
    monkeypatch.setattr(pairs, "TILE", 8)
    x, y, df = wide
    got, _, shuffled = jobs_of(spark, "joint", lambda: sampling.farthest(df, "id", "v", 20, "y").orderBy("place").collect())
    dx, dy = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), np.abs(y[:, None] - y[None])
    assert [r.id for r in got] == greedy(dx / dx.max() + dy / dy.max(), 20)
    assert shuffled < 10 * x.nbytes  # each row to its 20 partners would be 40 times and more


def components(near):
    name = np.arange(len(near))
    while not np.array_equal(name, least := np.where(near, name[None], len(near)).min(1)):
        name = least
    return dict(enumerate(name.tolist()))


@pytest.mark.parametrize("cut", [9.0, 9.6, 30.0])
def test_cut_linkage_shuffles_no_pairs(spark, wide, monkeypatch, cut):
    monkeypatch.setattr(clustering, "BLOCK", 30)
    x, _, df = wide
    got, _, shuffled = jobs_of(spark, f"cut {cut}", lambda: clustering.single_linkage(df, "id", "v", cut).collect())
    assert {r.id: r.cluster for r in got} == components(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= cut)
    assert shuffled < 10 * x.nbytes


def test_cut_on_ties_and_far_from_zero(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 40)
    rng = np.random.default_rng(34)
    grid = rng.integers(0, 12, size=(200, 2)).astype(float)
    offset = np.where(np.arange(200)[:, None] % 2, 0.0, 1e6)  # single precision can't tell steps of 1 from none
    for x in (grid, grid + offset):
        got = {r.id: r.cluster for r in clustering.single_linkage(table(spark, x), "id", "v", 1.0).collect()}
        assert got == components(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 1.0)
    x = np.array([[0.0], [np.nan], [0.5]])
    assert {r.id: r.cluster for r in clustering.single_linkage(table(spark, x), "id", "v", 1.0).collect()} == {0: 0, 1: 1, 2: 0}


def test_neighbours_shuffle_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(models, "QUERY_BLOCK", 100)
    monkeypatch.setattr(models, "TRAIN_BLOCK", 150)
    monkeypatch.setattr(pairs, "WIDE", 16)
    rng = np.random.default_rng(35)
    x = np.concatenate([rng.integers(0, 4, size=(300, 3)), rng.normal(size=(300, 3)) + 1e4]).astype(float)  # ties, and rows far from zero
    c = rng.choice(list("abc"), 600)
    got, jobs, shuffled = jobs_of(spark, "near", lambda: {r.id: r.yhat for r in models.knn(table(spark, x, c=c), table(spark, x, c=c).repartition(40), "id", "c", "v", 4).collect()})
    want = {}
    for i in range(600):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        names, n = np.unique(c[np.argsort(d, kind="stable")[:4]], return_counts=True)
        want[i] = names[n.argmax()]
    assert got == want
    assert shuffled < 250_000  # four neighbours of each query from each of 40 parts and more would be 2 MB


def test_plain_choice_shuffles_no_pairs(spark, wide, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 30)
    x, _, df = wide
    got, _, shuffled = jobs_of(spark, "plain", lambda: sampling.farthest(df, "id", "v", 20).orderBy("place").collect())
    assert [r.id for r in got] == greedy(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 20)
    assert shuffled < 10 * x.nbytes
