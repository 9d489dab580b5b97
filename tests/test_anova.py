"""Permutation tests of effects, orthogonal component curves, filters of long rows, null keys, headers further down."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.operators import anova, blocks, charts, fusion, signal, stats
from spectraloom.sources import readers


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(120, 5))
    a, b = np.arange(120) % 2, np.arange(120) // 2 % 3
    x[:, 0] += 2 * a
    rows = [(i, v.tolist(), int(p), f"l{q}") for i, (v, p, q) in enumerate(zip(x, a, b, strict=True))]
    return x, spark.createDataFrame([*rows, (500, None, 1, "l0"), (501, [0.0] * 5, None, "l0")], "id long, v array<double>, a int, b string").repartition(3)


def test_permutations_find_the_planted_effect(spark, design, monkeypatch):
    x, df = design
    whole = stats.asca(df.where("v is not null and a is not null"), "v", "a", "b")
    got = {r.effect: (r.ss, r.p) for r in anova.effects(df, "id", "v", "a", "b", times=99).collect()}
    assert {k: v for k, (v, _) in got.items()} == pytest.approx({k: whole[k] for k in got})
    assert got["ss_a"][1] == pytest.approx(0.01) and got["ss_b"][1] > 0.05 and got["ss_ab"][1] > 0.05
    again = {r.effect: r.p for r in anova.effects(df.repartition(7), "id", "v", "a", "b", times=99).collect()}
    assert again == {k: p for k, (_, p) in got.items()}
    monkeypatch.setattr(anova, "GROUP", 20)
    small = {r.effect: (r.ss, r.p) for r in anova.effects(df, "id", "v", "a", "b", times=99).collect()}
    assert small["ss_a"] == (pytest.approx(got["ss_a"][0]), pytest.approx(0.01))
    assert anova.effects(df.limit(0), "id", "v", "a", "b").count() == 0 and anova.components(df.limit(0), "id", "v", "a", "b").count() == 0


def test_p_of_nothing_is_spread_evenly(spark):
    rng = np.random.default_rng(14)
    p = []
    for _ in range(6):
        rows = [(i, rng.normal(size=2).tolist(), i % 2, i // 2 % 2) for i in range(40)]
        p += [r.p for r in anova.effects(spark.createDataFrame(rows, "id long, v array<double>, a int, b int").coalesce(1), "id", "v", "a", "b", times=49).collect()]
    assert 0.25 < np.mean(p) < 0.75 and min(p) >= 0.02 and max(p) <= 1


def test_effect_components(spark, design):
    x, df = design
    got = anova.components(df, "id", "v", "a", "b").where("effect = 'ss_a'").collect()
    assert {r.pc for r in got} == {1} and all(r.share == pytest.approx(1.0) for r in got)
    means = [x[np.arange(120) % 2 == k].mean(0) for k in (0, 1)]
    half = np.linalg.norm(means[1] - means[0]) / 2
    assert {(r.a, round(r.score, 6)) for r in got} == {("0", round(-half, 6)), ("1", round(half, 6))}


def test_opls_curve(spark):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(90, 6))
    y = x @ [1.0, -1, 0.5, 0, 0, 0] + rng.normal(0, 0.1, 90)
    rows = [(i, v.tolist(), float(t), i % 3) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, v array<double>, y double, fold int")
    curve = blocks.opls_curve(fusion.sums_by(df, ["v"], "y", F.col("fold")), 3)
    for k, q2, r2 in curve:
        press = 0.0
        for fold in range(3):
            scored = blocks.opls(df.where(f"fold <> {fold}"), "v", "y", k).scored(df.where(f"fold = {fold}"), "v")
            press += scored.agg(F.sum((F.col("y") - F.col("opls")[1]) ** 2)).first()[0]
        fit = blocks.opls(df, "v", "y", k).scored(df, "v").agg(F.sum((F.col("y") - F.col("opls")[1]) ** 2)).first()[0]
        spread = ((y - y.mean()) ** 2).sum()
        assert (q2, r2) == (pytest.approx(1 - press / spread), pytest.approx(1 - fit / spread))


@pytest.mark.parametrize("order", [0, 1, 2])
def test_savgol_equals_its_matrix(spark, order):
    x = np.random.default_rng(16).normal(size=(3, 40))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    for width, n in ((7, 40), (5, 5)):
        got = signal.savgol(df.withColumn("v", F.slice("v", 1, n)), "v", n, width, 2, order).orderBy("id").collect()
        assert np.allclose([r.v for r in got], x[:, :n] @ signal.savgol_matrix(n, width, 2, order).T)


def test_null_keys_are_a_series(spark):
    rows = [(None if i % 2 else "s", i, float(i % 7)) for i in range(60)]
    df = charts.baseline(spark.createDataFrame(rows, "g string, t int, x double"), "x", ["t"], 10, "g")
    got = charts.cusum(df, "g").collect()
    assert len(got) == 60
    own = [r for r in sorted(got, key=lambda r: r.t) if r.g is None]
    c = 0.0
    for r in own:
        c = max(0.0, c + r.z - 0.5)
        assert r.cusum == pytest.approx(c)


def test_header_further_down_keeps_equal_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("A,1\nid,x\nA,1\nB,2\nA,1\n")
    assert [tuple(r) for r in readers.read_table(spark, str(tmp_path / "t.csv"), header_row=2).collect()] == [("A", "1"), ("B", "2"), ("A", "1")]


def test_truncation_is_by_singular_values(spark):
    rng = np.random.default_rng(17)
    master = rng.normal(size=(60, 8)) * np.logspace(0, -2.5, 8)
    second = 1.1 * master + 0.2
    df = spark.createDataFrame([(m.tolist(), s.tolist()) for m, s in zip(master, second, strict=True)], "m array<double>, s array<double>")
    error = lambda **more: np.abs(np.array([r.o for r in blocks.transfer(df, "s", "m", "ds", **more).scores(df, "s", "o").collect()]) - np.array([r.m for r in df.collect()])).max()
    assert error() < 1e-9 and error(rank=2) > 1e-3
