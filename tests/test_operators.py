"""Operators without SQL, against straight-line NumPy, identities and hand-made rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.functions import arrays, special
from spectraloom.operators import charts, models, relational, signal, stats
from spectraloom.sources import readers


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(0)
    return np.cumsum(rng.normal(size=(40, 24)), axis=1) + rng.normal(size=(40, 1)) + 5


@pytest.fixture(scope="module")
def frame(spark, matrix):
    return spark.createDataFrame([(i, i % 3, row.tolist()) for i, row in enumerate(matrix)], "id long, label long, v array<double>").repartition(3)


def back(df, column="v"):
    return np.array([r[column] for r in sorted(df.collect(), key=lambda r: r["id"])])


def test_quantiles_match_textbook_tables():
    assert special.chi2_ppf(0.95, 10) == pytest.approx(18.307, abs=1e-3)
    assert special.f_ppf(0.95, 3, 20) == pytest.approx(3.098, abs=1e-3)
    assert special.t_ppf(0.975, 12) == pytest.approx(2.179, abs=1e-3)
    assert special.t_cdf(0.0, 5) == pytest.approx(0.5)


def test_savgol_keeps_polynomials(frame, matrix):
    n = matrix.shape[1]
    t = np.arange(n, dtype=float)
    assert signal.savgol_matrix(n, 7, 2) @ (3 + 2 * t - t * t) == pytest.approx(3 + 2 * t - t * t)
    assert signal.savgol_matrix(n, 7, 2, 1) @ (3 + 2 * t - t * t) == pytest.approx(2 - 2 * t)
    assert back(signal.savgol(frame, "v", n)) == pytest.approx(matrix @ signal.savgol_matrix(n, 7, 2).T)
    with pytest.raises(ValueError):
        signal.savgol_matrix(5, 7, 2)


def test_emsc_undoes_scaling_and_baseline(spark, matrix):
    n = matrix.shape[1]
    ref, t = matrix.mean(0), np.linspace(-1, 1, n)
    bent = [1.7 * ref + 0.4 + 0.9 * t - 2 * t * t, 0.5 * ref]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(bent)], "id long, v array<double>")
    assert back(signal.emsc(df, "v", ref)) == pytest.approx(np.stack([ref, ref]))


def test_als_despike_interpolate_align(spark):
    t = np.linspace(0, 1, 60)
    peak = np.exp(-(((t - 0.5) / 0.03) ** 2))
    df = spark.createDataFrame([(0, (peak + 3 + 2 * t).tolist())], "id long, v array<double>")
    assert np.abs(back(signal.als_baseline(df, "v", 1e4, 0.001))[0] - peak).max() < 0.12
    noisy = np.sin(5 * t)
    noisy[20] += 50
    spiked = spark.createDataFrame([(0, noisy.tolist())], "id long, v array<double>")
    assert abs(back(signal.despike(spiked, "v"))[0][20]) < 2
    out = signal.interpolate(df, "v", t, t[:30])
    assert back(out)[0] == pytest.approx((peak + 3 + 2 * t)[:30]) and not out.first()["outside"]
    moved = spark.createDataFrame([(0, np.roll(peak, 3).tolist())], "id long, v array<double>")
    assert np.abs(back(signal.align(moved, "v", peak, [0, 60], 5))[0] - peak).max() < 1e-6


def test_snv_rows_and_constant_row(spark, matrix):
    df = spark.createDataFrame([(0, matrix[0].tolist()), (1, [4.0] * 5)], "id long, v array<double>").withColumn("v", arrays.snv(F.col("v")))
    rows = {r["id"]: np.array(r["v"]) for r in df.collect()}
    assert rows[0].mean() == pytest.approx(0, abs=1e-12) and rows[0].std() == pytest.approx(1) and not rows[1].any()


def test_pca_identities(frame, matrix):
    m = stats.pca(frame, "v", 4)
    centred = matrix - matrix.mean(0)
    s = np.linalg.svd(centred, compute_uv=False)
    assert m.all_eigenvalues[: len(s)] == pytest.approx(s**2 / 39, abs=1e-9)
    rows = m.scored(frame, "v").collect()
    assert sum(r["t2"] for r in rows) == pytest.approx(4 * 39) and sum(r["leverage"] for r in rows) == pytest.approx(5)
    whole = stats.pca(frame, "v", 24)
    assert max(r["q"] for r in whole.scored(frame, "v").collect()) < 1e-9 and math.isinf(whole.q_limit())
    assert m.t2_limit() > 0 and m.q_limit() > 0


def test_simca_and_lda_separate_far_classes(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, (rng.normal(size=6) + 12 * (i % 2)).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, label long, v array<double>")
    labels = {r["id"]: r["label"] for r in stats.simca_label(stats.simca_assign(df, "v", "id", stats.simca(df, "v", "label")), "id").collect()}
    assert sum(labels[i] == str(i % 2) for i in labels) >= 65 and not any(labels[i] == str(1 - i % 2) for i in labels)
    names, model = models.lda(df, "v", "label")
    assert all(r["label"] == r["yhat"] for r in models.classify(df, "v", names, model).collect())
    assert all(r["yhat"] == r["id"] % 2 for r in models.knn(df, df, "id", "label", "v").collect())


def test_pls_with_all_components_is_least_squares(spark, frame, matrix):

    df = frame.withColumn("y", F.element_at("v", 1) * 2 - F.element_at("v", 5) + 3)
    model = models.pls(df, "v", ["y"], 24)
    got = model.scores(df, "v").select("y", F.element_at("yhat", 1).alias("yhat")).collect()
    assert [r["yhat"] for r in got] == pytest.approx([r["y"] for r in got], abs=1e-3)


def test_asca_sums_add_up(frame):
    r = stats.asca_one_factor(signal.long_view(frame, "v", "id", "label"), "label").first()
    assert r["ss_effect"] + r["ss_residual"] == pytest.approx(r["ss_total"])


def test_kennard_stone():
    assert sorted(stats.kennard_stone(np.array([[0.0], [1.0], [2.1], [10.0]]), 3)) == [0, 2, 3]


def test_relational(spark):
    ids = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "id string, n int")
    assert sorted(r["id"] for r in relational.unique_ids(ids, "id", "n").collect()) == ["a", "a_2", "b", "sample_3"]
    idx = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 20)], "i int")
    assert sorted((r["first"], r["last"], r["n"]) for r in relational.islands(idx, "i", 1).collect()) == [(1, 3, 3), (7, 8, 2), (20, 20, 1)]
    text = spark.createDataFrame([("1,5",), ("1,234.5",), ("x",), ("7",)], "t string").select(relational.number_of(F.col("t")))
    assert [r[0] for r in text.collect()] == [1.5, 1234.5, None, 7.0]


def test_window_rules(spark):

    df = spark.range(10).select(signal.window_of(F.col("id"), 10, 4).alias("a"), signal.window_of(F.col("id"), 10, 4, "split").alias("b"))
    rows = df.collect()
    cuts = [int(k * 10 / 4) for k in range(5)]
    assert [r["a"] for r in rows] == [next(w for w in range(4) if cuts[w] <= i < cuts[w + 1]) for i in range(10)]
    assert [r["b"] for r in rows] == [w for w, part in enumerate(np.array_split(np.arange(10), 4)) for _ in part]


def test_charts_and_stream_agree(spark, tmp_path):
    import pandas as pd

    from spectraloom.streaming import charts as live

    values = np.random.default_rng(2).normal(10, 2, 60)
    rows = pd.DataFrame({"series": "s", "at": range(60), "value": values})
    schema = "series string, at long, value double"
    for i in range(3):
        spark.createDataFrame(rows[i * 20 : i * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = charts.baseline(spark.createDataFrame(rows, schema), "value", ["at"], 20, "series")
    batch = charts.cusum(charts.ewma(batch, "value", "series"), "series").orderBy("at").toPandas()
    mu, sd = values[:20].mean(), values[:20].std(ddof=1)
    stream = live.chart(spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in")), mu, sd)
    q = stream.writeStream.format("memory").queryName("charts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("charts").orderBy("at").toPandas()
    assert got["ewma"].to_numpy() == pytest.approx(batch["ewma"].to_numpy()) and got["cusum"].to_numpy() == pytest.approx(batch["cusum"].to_numpy(), abs=1e-9)
    assert (got["cusum"] >= 0).all()


def test_conformal_radius_is_infinite_for_few_rows(spark):
    df = spark.createDataFrame([(0.5,), (1.0,)], "residual double")
    assert math.isinf(models.conformal_radius(df, 0.1).first()["radius"])


def test_readers(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("id;batch;1200,5;1100;1100\nA;x;1,5;2;3\nB;y;;4,25;5\n")
    assert readers.sniff(path.read_text().splitlines()) == (";", True)
    df, axis = readers.spectra(readers.read_table(spark, str(path)).drop("1100.1"))
    assert axis == [1100.0, 1200.5] and [(r["id"], r["batch"], r["spectrum"]) for r in df.collect()] == [("A", "x", [2.0, 1.5]), ("B", "y", [4.25, None])]
    assert readers.wide(df, "spectrum", axis).columns == ["id", "batch", "1100", "1200.5"]
    assert readers.unique_headers(["a", "", "a", None]) == ["a", "Unnamed: 1", "a.1", "Unnamed: 3"]


def test_ewma_of_small_weights_and_long_series(spark):
    values = [0.1 * (k % 7) + k / 500 for k in range(1500)]
    rows = charts.baseline(spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], "series string, at long, value double"), "value", ["at"], 20, "series")
    for weight in (0.01, 0.2, 1.0):
        z, want = float(np.mean(values[:20])), []
        for v in values:
            z = weight * v + (1 - weight) * z
            want.append(z)
        got = [r["ewma"] for r in charts.ewma(rows, "value", "series", weight=weight).orderBy("at").collect()]
        assert got == pytest.approx(want, rel=1e-12)


def test_charts_do_not_depend_on_block_size(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(s, int(k // 3), k, float(v)) for s in ("a", "b") for k, v in enumerate(rng.normal(5, 1, 700))] + [("c", None, 0, 1.0), ("c", 4, 1, 2.0)]
    df = spark.createDataFrame(rows, "series string, at long, id long, value double")
    place, found = {}, []
    for s in "abc":
        order = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        place |= {(s, r[2]): i + 1 for i, r in enumerate(order)}
    for size in (1 << 16, 200):
        monkeypatch.setattr(charts, "BLOCK", size)
        base = charts.baseline(df, "value", ["at", "id"], 20, "series")
        out = charts.westgard(charts.ewma(charts.cusum(base, "series"), "value", "series"), "series")
        assert out.count() == len(rows)
        found.append({(r["series"], r["id"]): r for r in out.collect()})
    assert {k: r["n"] for k, r in found[1].items()} == place
    for k, r in found[0].items():
        assert found[1][k]["cusum"] == pytest.approx(r["cusum"], abs=1e-9) and found[1][k]["ewma"] == pytest.approx(r["ewma"], rel=1e-12)
        assert all(found[1][k][c] == r[c] for c in ("r_1_3s", "r_2_2s", "r_4s", "r_4_1s", "r_10x"))
    with pytest.raises(ValueError):
        monkeypatch.setattr(charts, "BLOCK", 100)
        charts.ewma(base, "value", "series")


def test_ewma_query_returns_all_rows(spark):
    from spectraloom.plans import registry

    d = "/root/testdata/sf0.01"
    got = {(r["event_type"], r["event_id"]): r["ewma"] for r in registry.w1_ewma(spark, d).collect()}
    events = registry.table(spark, d, "events").orderBy("event_type", "ts", "event_id").toPandas()
    want = {}
    for name, g in events.groupby("event_type"):
        z = g["value"][:20].mean()
        for i, v in zip(g["event_id"], g["value"], strict=True):
            want[name, i] = z = 0.2 * v + 0.8 * z
    assert len(got) == len(events) and got == pytest.approx(want, abs=2e-6)


def test_cube_query_reduces_all_cubes(spark):
    from spectraloom.plans import registry

    d = "/root/testdata/sf0.1"
    got = {(r["cube"], r["row"], r["col"], r["var_idx"]): r["x"] for r in registry.f26_cube_blocks(spark, d).collect()}
    x = np.array([r["embedding"] for r in registry.table(spark, d, "embeddings").orderBy("vec_id").collect()], float)
    means = x.reshape(4, 25, 20, 64)[:, :24, :18, :63].reshape(4, 8, 3, 6, 3, 9, 7).mean((2, 4, 6))
    assert got == pytest.approx(dict(np.ndenumerate(means)), abs=2e-6)
