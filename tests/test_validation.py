"""Fusion, curves, instruments, running sums and partners against NumPy on small rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.operators import fusion, models, reliability
from spectraloom.operators.models import Linear


def made(spark, n=120, p=6, noise=0.0):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, p))
    y = x @ np.arange(1, p + 1) + 3 + noise * rng.normal(size=n)
    return x, y, spark.createDataFrame([(i, r.tolist(), float(t), i % 4) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, v array<double>, y double, fold int")


def test_errors_from_sums_equal_residuals(spark):
    x, y, df = made(spark, noise=0.5)
    sums = fusion.sums_by(df, ["v"], "y", F.col("fold"))
    mean, coef = np.append(x[:60].mean(0), y[:60].mean()), np.arange(6.0)
    own = np.arange(len(y)) % 4 == 2
    e = y[own] - ((x[own] - mean[:-1]) @ coef + mean[-1])
    assert sums["2"].errors(mean, coef) == pytest.approx((float(e @ e), float(e.sum())))


def test_fusion_fits_what_two_blocks_hold(spark):
    _, _, df = made(spark)
    df = df.withColumns({"a": F.slice("v", 1, 3), "b": F.slice("v", 4, 3)})
    got = {r["strategy"]: r["rmse"] for r in fusion.compare(df, "a", "b", "y", "fold", k=6).collect()}
    assert set(got) == {"a", "b", "low_level", "mid_level", "so_pls_ab", "so_pls_ba", "high_level"}
    assert max(got[s] for s in ("low_level", "mid_level", "so_pls_ab", "so_pls_ba")) < 1e-4 < min(got["a"], got["b"], got["high_level"])


def test_instruments_find_a_bias(spark):
    _, _, df = made(spark)
    df = df.withColumn("inst", F.when(F.col("id") % 2 == 0, "m|a").otherwise("b")).withColumn("y", F.col("y") + F.when(F.col("inst") == "b", 2.0).otherwise(0.0)).withColumn("fold", F.floor(F.col("id") / 2) % 3)
    got = {(r["train"], r["test"]): r for r in fusion.instruments(df, "v", "y", "inst", "fold", k=6).collect()}
    assert len(got) == 6 and got["m|a", "b"]["bias"] == pytest.approx(-2, abs=1e-4) and got["b", "b"]["rmse"] < 1e-4


def test_learning_curve(spark):
    _, _, df = made(spark, noise=0.1)
    rows = fusion.learning_curve(df, "v", "y", "id", k=6).collect()
    assert [r["share"] for r in rows] == pytest.approx([0.2, 0.4, 0.6, 0.8, 1.0]) and rows[-1]["rmse_test"] < 0.5


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_cumulative(spark, parts):
    df = spark.createDataFrame([(k, float(i), i % 5 + 1) for k in "ab" for i in range(37)], "k string, s double, c long")
    got = {(r["k"], r["s"]): r["upto_c"] for r in reliability.cumulative(df, "s", ["c"], "k", parts=parts).collect()}
    want = np.cumsum([i % 5 + 1 for i in range(37)])
    assert got == {(k, float(i)): int(want[i]) for k in "ab" for i in range(37)}
    assert reliability.cumulative(df.limit(0), "s", ["c"], "k").count() == 0


def test_thresholds_are_infinite_where_a_class_is_small(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(19)] + [("b", 1.0)], "y string, s double")
    got = {r["y"]: r["threshold"] for r in reliability.class_thresholds(df, "y", "s", 0.1).collect()}
    assert got == {"a": 17.0, "b": float("inf")}


def test_partners_permute_within_classes(spark):
    df = spark.createDataFrame([(i, i % 2, [float(i)]) for i in range(40)], "id long, c int, v array<double>")
    rows = reliability.partnered(df, "id", "v", "c", groups=2).collect()
    assert sorted(r["partner"][0] for r in rows) == [float(i) for i in range(40)]
    assert all(int(r["partner"][0]) % 2 == r["c"] for r in rows)


def test_shift_repeats_edges(spark):
    for r in reliability.shifted(spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(30)], "id long, v array<double>"), "id", "v", 1).collect():
        assert r["v"] == {-1: [2.0, 3.0, 3.0], 0: [1.0, 2.0, 3.0], 1: [1.0, 1.0, 2.0]}[r["shift"]]


def test_permutation_importance(spark):
    x, _, df = made(spark, n=200)
    model = Linear(np.zeros(6), np.array([[0.0], [0.0], [0.0], [0.0], [0.0], [2.0]]), np.zeros(1))
    got = {r["win"]: r["loss"] for r in reliability.permutation_importance(df.withColumn("y", 2 * F.element_at("v", 6)), "id", "v", "y", model, 3, groups=1).collect()}
    assert got[0] == got[1] == 0 and got[2] == pytest.approx(8 * x[:, 5].var(), rel=0.4)


def test_kernel_pls_is_least_squares_with_all_components(spark):
    x, y, df = made(spark, noise=0.3)
    coef = models.pls(df, "v", ["y"], 6).coef[:, 0]
    assert coef == pytest.approx(np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)[0], abs=1e-6)
