"""Peaks by prominence, noise, instrument corrections and the enrichment curve against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.operators import blocks, fusion, models, reliability, signal, stats


def prominences(s):
    out = {}
    for i in range(1, len(s) - 1):
        if s[i] > s[i - 1] and s[i] > s[i + 1]:
            left = next((j for j in range(i - 1, -1, -1) if s[j] > s[i]), -1)
            right = next((j for j in range(i + 1, len(s)) if s[j] > s[i]), len(s))
            out[i] = s[i] - max(s[left + 1 : i + 1].min(), s[i:right].min())
    return out


def test_peaks(spark):
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(size=(30, 50)).cumsum(1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = {}
    for r in signal.peaks(df, "v", "id", share=0.1, top=4).collect():
        got.setdefault(r["id"], []).append((r["place"], r["position"], r["prominence"]))
    for i, v in enumerate(x):
        s = (np.r_[v[0], v[:-1]] + v + np.r_[v[1:], v[-1]]) / 3
        want = [(p, q) for p, q in prominences(s).items() if q >= 0.1 * s.max()]
        want = sorted(want, key=lambda p: -s[p[0]])[:4] or [(int(s.argmax()), None)]
        mine = sorted(got[i])
        assert [p for _, p, _ in mine] == [p for p, _ in want]
        assert [q for _, _, q in mine] == [q if q is None else pytest.approx(q) for _, q in want]


def test_peaks_of_odd_rows(spark):
    df = spark.createDataFrame([(0, None), (1, []), (2, [5.0]), (3, [1.0, 1.0, 1.0]), (4, [1.0, 2.0, 3.0])], "id int, v array<double>")
    got = {r["id"]: (r["position"], r["prominence"], r["place"]) for r in signal.peaks(df, "v", "id").collect()}
    assert got == {2: (0, None, 1), 3: (0, None, 1), 4: (2, None, 1)}


def test_noise(spark):
    x = np.random.default_rng(3).normal(size=(6, 40)) + 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(6, [1.0] * 40)], "id int, v array<double>")
    got = {r["id"]: (r["noise"], r["snr"]) for r in reliability.noise(df, "v", 40, "id", low=10, high=20).collect()}
    for i, v in enumerate(x):
        fits = []
        for j in range(40):
            c = min(max(j, 5), 34)
            fits.append(np.polyval(np.polyfit(np.arange(c - 5, c + 6) - c, v[c - 5 : c + 6], 2), j - c))
        noise = np.std(v - np.array(fits))
        assert got[i] == pytest.approx((noise, (v[10:21].max() - np.quantile(v[10:21], 0.05)) / noise))
    assert got[6][0] == pytest.approx(0, abs=1e-12)


def made(spark, instruments=3, n=120):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 6))
    y = x @ [1.0, -2, 0.5, 0, 0, 3]
    g = np.arange(n) % instruments
    x = x + 0.7 * g[:, None] * np.array([1, 0, 1, 0, 0, 1.0])
    return x, y, g, spark.createDataFrame([(i, int(g[i]), float(y[i]), x[i].tolist()) for i in range(n)], "id long, g int, y double, v array<double>")


def test_instrument_means_agree_after_projection(spark):
    x, _, g, df = made(spark)
    rows = signal.without_groups(df, "v", "g").orderBy("id").collect()
    out = np.array([r["v"] for r in rows])
    means = np.array([out[g == k].mean(0) for k in range(3)])
    assert means == pytest.approx(np.tile(means[0], (3, 1)), abs=1e-9)
    assert np.linalg.matrix_rank(x - out, tol=1e-9) == 2
    one = signal.without_groups(df.withColumn("g", F.lit(1)), "v", "g").orderBy("id").collect()
    assert np.array([r["v"] for r in one]) == pytest.approx(x)


def test_centred_by(spark):
    x, _, g, df = made(spark)
    rows = signal.centred_by(signal.long_view(df, "v", "id", "g"), "g").groupBy("g", "var_idx").agg(F.avg("x").alias("m"), F.count("*").alias("n")).collect()
    assert len(rows) == 18 and all(abs(r["m"]) < 1e-9 and r["n"] == 40 for r in rows)


def test_enrichment(spark):
    x, y, g, df = made(spark)
    got = {(r["instrument"], r["added"]): (r["rmse"], r["sd"]) for r in fusion.enrichment(df, "v", "y", "g", "id", sizes=(0, 5, 200), repeats=3, k=2).collect()}
    assert set(got) == {(str(k), n) for k in range(3) for n in (0, 5)}  # 200 leave no test row
    for k in range(3):
        train, test = g != k, g == k
        a = np.c_[x[train], y[train]]
        cov = np.cov(a.T)
        coef = models.pls_kernel(cov[:-1, :-1], cov[:-1, -1:], 2)[1][:, 0]
        e = y[test] - y[train].mean() - (x[test] - x[train].mean(0)) @ coef
        assert got[str(k), 0] == pytest.approx((np.sqrt((e**2).mean()), 0.0))
        assert got[str(k), 5][1] > 0


@pytest.mark.parametrize("kind", ["offset", "ds", "pds"])
def test_transfer_errors(spark, kind):
    x, _, g, df = made(spark)
    second = 0.9 * x + 0.1 * np.roll(x, 1, axis=1) + 0.3
    both = df.join(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(second)], "id long, w array<double>"), "id")
    before, after = ((second - x) ** 2).mean() ** 0.5, 0.0
    for k in range(3):
        model = blocks.transfer(both.where(f"g <> {k}"), "w", "v", kind)
        mapped = (second[g == k] - model.mean) @ model.coef + model.intercept
        after += ((mapped - x[g == k]) ** 2).sum()
    row = blocks.transfer_errors(both, "w", "v", "g", (kind,)).first()
    assert tuple(row) == (kind, 120, pytest.approx(before), pytest.approx((after / x.size) ** 0.5, abs=1e-6))


def test_shares(spark):
    x, y, _, df = made(spark)
    df = df.withColumns({"a": F.slice("v", 1, 3), "b": F.slice("v", 4, 3)})
    got = {r["strategy"]: (r["share_a"], r["share_b"]) for r in fusion.shares(df, "a", "b", "y", k=3).collect()}
    coef = np.linalg.lstsq((x - x.mean(0))[:, :3], y - y.mean(), rcond=None)[0]
    assert got["a"] == (1.0, 0.0) and got["b"] == (0.0, 1.0) and all(sum(v) == pytest.approx(1) for v in got.values())
    other = np.linalg.lstsq((x - x.mean(0))[:, 3:], y - y.mean(), rcond=None)[0]
    va, vb = np.var(x[:, :3] @ coef), np.var(x[:, 3:] @ other)
    assert got["high_level"] == pytest.approx((va / (va + vb), vb / (va + vb)))


def test_confirmed_regions_beat_random_ones(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 20))
    y = x[:, 4] - 2 * x[:, 5] + 0.1 * rng.normal(size=150)
    df = spark.createDataFrame([(i % 5, float(y[i]), x[i].tolist()) for i in range(150)], "fold int, y double, v array<double>")
    got = dict(fusion.confirm(fusion.sums_by(df, ["v"], "y", F.col("fold")), [(4, 5)], k=2))
    error = 0.0
    for k in range(5):
        out = np.arange(150) % 5 == k
        a = np.c_[np.ones(120), x[~out][:, 4:6]]
        b = np.linalg.lstsq(a, y[~out], rcond=None)[0]
        error += ((y[out] - np.c_[np.ones(30), x[out][:, 4:6]] @ b) ** 2).sum()
    assert got["regions"] == pytest.approx((error / 150) ** 0.5) and len(got) == 7
    assert got["regions"] <= min(v for k, v in got.items() if k.startswith("random"))


def test_correlation_radius(spark):
    x, _, _, df = made(spark)
    score = stats.pca(df, "v", 2)
    t = (x - x.mean(0)) @ score.loadings
    want = [np.hypot(*(np.corrcoef(x[:, j], t[:, i])[0, 1] for i in (0, 1))) for j in range(6)]
    assert stats.correlation_radius(*stats.moments(df, "v")) == pytest.approx(want)
