"""Models, searches, domains and sources of the workbench against NumPy twins, identities and hand-made files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.operators import domain, fusion, models, relational, screening, signal, stats, tabular
from spectraloom.sources import projects


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 8)) @ rng.normal(size=(8, 8)) + 3
    return x, np.arange(90) % 3


@pytest.fixture(scope="module")
def frame(spark, matrix):
    x, c = matrix
    x = x + 2.0 * c[:, None] * np.arange(8)
    return spark.createDataFrame([(i, int(c[i]), int(i % 5), float(x[i, 0] - 2 * x[i, 3]), x[i].tolist()) for i in range(90)], "id long, label long, fold int, y double, v array<double>").repartition(3)


def values(frame):
    rows = sorted(frame.collect(), key=lambda r: r["id"])
    return np.array([r["v"] for r in rows]), np.array([r["label"] for r in rows]), np.array([r["y"] for r in rows]), np.array([r["fold"] for r in rows])


def test_moments_by_class(frame):
    x, c, _, _ = values(frame)
    for k, (n, mean, cov) in stats.moments_by(frame, "v", "label").items():
        assert n == 30 and mean == pytest.approx(x[c == k].mean(0)) and cov == pytest.approx(np.cov(x[c == k].T))


def test_pls_da_equals_pls_of_indicators(frame):
    x, c, _, _ = values(frame)
    names, model = models.pls_da(frame, "v", "label", 3)
    z, y = (x - x.mean(0)) / x.std(0, ddof=1), np.eye(3)[c]
    t = (y - y.mean(0)) / y.std(0, ddof=1)
    _, coef = models.pls_kernel(z.T @ z / 89, z.T @ t / 89, 3)
    want = z @ coef * y.std(0, ddof=1) + y.mean(0)
    got = np.array([r["scores"] for r in models.classify(frame, "v", names, model).orderBy("id").collect()])
    assert names == [0, 1, 2] and got == pytest.approx(want, abs=1e-9)
    far = frame.where("label < 2").withColumn("v", F.transform("v", lambda v, i: v + F.when(i == 0, 40 * F.col("label")).otherwise(0)))
    names, model = models.pls_da(far, "v", "label", 3)
    assert all(r["label"] == r["yhat"] for r in models.classify(far, "v", names, model).collect())


def test_knn_in_blocks_equals_brute_force(frame, monkeypatch):
    x, c, _, _ = values(frame)
    monkeypatch.setattr(models, "QUERY_BLOCK", 7)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {}
    for i in range(90):
        votes = np.bincount(c[np.lexsort((np.arange(90), d[i]))[:5]], minlength=3)
        want[i] = int(votes.argmax())
    assert {r["id"]: r["yhat"] for r in models.knn(frame, frame, "id", "label", "v").collect()} == want
    assert models.knn(frame.limit(0), frame, "id", "label", "v").count() == 0


def test_pentadiagonal_solve_equals_dense():
    rng = np.random.default_rng(0)
    n, d2 = 12, np.diff(np.eye(12), 2, axis=0)
    full = 50 * d2.T @ d2
    w = rng.random((4, n)) + 0.1
    y = rng.normal(size=(4, n))
    got = signal.solve_pentadiagonal(w + np.diag(full), np.diag(full, 1), np.diag(full, 2), y)
    assert got == pytest.approx(np.array([np.linalg.solve(full + np.diag(w[i]), y[i]) for i in range(4)]))


def test_bucket_keeps_empty_bins_and_refuses_wide_ones(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 2.0), (1, 9.0, 4.0)], "id int, at double, x double")
    got = {r["bin"]: (r["centre"], r["x"]) for r in signal.bucket(rows, 3.0, "id", axis="at").collect()}
    assert got == {0: (0.5, 3.0), 1: (4.5, 0.0), 2: (7.5, 0.0), 3: (9.0, 4.0)}
    with pytest.raises(ValueError):
        signal.bucket(rows, 10.0, "id", axis="at")


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=3000), 2)
    df = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(x)] + [(0, None)], "g int, v double")
    for r in relational.quantiles(df, "v", {"a": 0.05, "b": 0.5, "c": 1.0}, "g").collect():
        own = x[r["g"] :: 3]
        assert (r["n"], r["a"], r["b"], r["c"]) == (1000, pytest.approx(np.quantile(own, 0.05)), pytest.approx(np.median(own)), own.max())


def test_domain_and_class_models(frame):
    x, c, _, _ = values(frame)
    m = domain.fit(frame, "v", 0.9)
    rows = m.judged(frame, "v").collect()
    assert np.mean([r["verdict"] == "inside" for r in rows]) > 0.85 and m.border() > m.limit() > 0
    assert np.mean([r["h"] for r in rows]) == pytest.approx(len(m.model.eigenvalues) * 89 / 90)
    far = frame.withColumn("v", F.transform("v", lambda v: v + 500))
    assert {r["verdict"] for r in m.judged(far, "v").collect()} == {"outside"}
    curve = domain.acceptance_curve(m, frame, "v", [0.01, 0.05, 0.5]).collect()
    assert curve[0]["share"] >= curve[1]["share"] >= curve[2]["share"]
    got = domain.accepted(frame, "v", "id", domain.class_models(frame, "v", "label"), 0.05, "label")
    own = got.where("label = class").agg(F.avg(F.col("inside").cast("double"))).first()[0]
    assert got.count() == 270 and own > 0.8


def test_baseline_is_left_one_out(frame):
    x, _, _, _ = values(frame)
    b = domain.baseline(frame.where("id < 30"), "v", 2)
    i, rest = 4, np.delete(x[:30], 4, axis=0)
    m = stats.PCA.from_moments(29, rest.mean(0), np.cov(rest.T), 2)
    s = (x[i] - m.mean) @ m.loadings
    assert ((x[i] - m.mean - m.loadings @ s) ** 2).sum() > 0 and b.t2.mean > 0
    assert b.judged(frame, "v").where("status = 'ACTION'").count() < 45
    r = b.residuals(frame, "v").orderBy("id").first()["residual"]
    assert np.sum(np.square(r)) == pytest.approx(b.judged(frame, "v").orderBy("id").first()["q"])
    with pytest.raises(ValueError):
        domain.baseline(frame, "v", most=10)


def test_screening_equals_row_wise_cross_validation(spark, frame):
    x, _, y, fold = values(frame)
    by = fusion.sums_by(frame, ["v"], "y", F.col("fold"))
    sse = 0.0
    for f in range(5):
        a, b = fold != f, fold == f
        xc, yc = x[a] - x[a].mean(0), y[a] - y[a].mean()
        _, coef = models.pls_kernel(xc.T @ xc / (a.sum() - 1), (xc.T @ yc / (a.sum() - 1))[:, None], 2)
        sse += ((y[b] - y[a].mean() - (x[b] - x[a].mean(0)) @ coef[:, 0]) ** 2).sum()
    n, rmse, _ = screening.cross_validated(by, 2)
    assert n == 90 and rmse == pytest.approx(np.sqrt(sse / 90), rel=1e-6)
    found = screening.screen(frame, "v", "y", "fold", ["none", "snv"], [1, 2], [1.0, 0.5])
    assert found.count() == 8 and found.where("recipe = 'none' and selection = 'top 1' and components = 2").first()["rmse"] == pytest.approx(rmse)
    top = screening.ranked(found).orderBy("rank").first()
    assert top["rmse"] == min(r["rmse"] for r in found.collect())
    assert screening.screen(frame, "v", "y", "fold", ["none", "snv"], [1, 2], [1.0, 0.5], done=found.limit(5)).count() == 3
    mask = screening.genetic(by, 3, population=12, generations=8)
    assert screening.cross_validated(by, 3, mask)[2] >= screening.cross_validated(by, 3)[2] - 0.01
    assert [s["components"] for s in screening.halving(by, [{"components": k} for k in (1, 8)])][0] == 8
    combos = screening.pc_combinations(by, 2, 4)
    assert len(combos) == 10 and combos[0][1] == max(c[1] for c in combos)


def test_row_norms_and_transforms(spark):
    x = np.array([[1.0, 2.0, 4.0], [2.0, 4.0, 8.0], [3.0, 6.0, 12.0]])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    for kind, want in {"sum": 14 * x / x.sum(1, keepdims=True), "median": 4 * x / np.median(x, 1, keepdims=True), "pqn": x / np.array([[0.5], [1], [1.5]])}.items():
        got = df.withColumn("v", tabular.RowNorm.fit(df, "v", kind).apply(F.col("v"))).orderBy("id").collect()
        assert np.array([r["v"] for r in got]) == pytest.approx(want)
    t = tabular.Transform.fit(spark.createDataFrame([(-3.0,), (2.0,)], "a double"), "a", "sqrt")
    assert t.offset == 4.0 and t.lam == 1.0


def test_projects_and_files(spark, tmp_path, frame):
    own = projects.save(spark, str(tmp_path / "p"), {"spectra": frame}, {"k": 3})
    tables, manifest = projects.load(spark, str(tmp_path / "p"), ["spectra", "axis"])
    assert manifest["id"] == own and manifest["values"] == {"k": 3} and tables["spectra"].count() == 90
    with pytest.raises(ValueError):
        projects.load(spark, str(tmp_path / "p"), ["a", "b", "c"])
    (tmp_path / "c.csv").write_text("id;class\n1;x\n2;y\n")
    (tmp_path / "y.csv").write_text("id;value\n1;1,5\n2;none\n")
    assert [tuple(r) for r in projects.class_file(spark, str(tmp_path / "c.csv")).orderBy("id").collect()] == [("1", "x"), ("2", "y")]
    assert [tuple(r) for r in projects.value_file(spark, str(tmp_path / "y.csv")).orderBy("id").collect()] == [("1", 1.5), ("2", None)]
    runs = frame.limit(4).withColumn("series", F.lit("control"))
    for _ in range(2):
        projects.append_history(runs, str(tmp_path / "h"))
    assert projects.history(spark, str(tmp_path / "h")).where("series = 'control'").count() == 8
    cube = np.arange(24.0).reshape(2, 3, 4)
    np.savez(tmp_path / "cube.npz", cube=cube, axis=np.array([4, 3, 2, 1]))
    got = {(r["row"], r["col"]): r["spectrum"] for r in projects.cube_array(spark, str(tmp_path / "cube.npz")).collect()}
    assert len(got) == 6 and got[1, 2] == cube[1, 2, ::-1].tolist()
    pixels = spark.createDataFrame([(5, 7, 1.0), (6, 9, 2.0)], "x int, y int, b double")
    assert sorted((r["row"], r["col"], r["spectrum"]) for r in projects.cube_table(pixels, "x", "y", ["b"]).collect()) == [(0, 0, [1.0]), (2, 1, [2.0])]
    assert projects.spatial_step(100, 100, 10, 25_000) == 2 and "Model card" in projects.card({"k": 3})
    assert len(projects.preview(frame.select(*[F.lit(i).alias(f"c{i}") for i in range(30)])).columns) == 17
    named = projects.manual(spark.range(3), "id", "a, b, c", "class")
    assert [r["class"] for r in named.orderBy("id").collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        projects.manual(spark.range(2), "id", "a", "class")


def test_asca_of_unequal_cells_is_sequential_least_squares(spark, frame):
    df = frame.where("id <> 4 and id <> 31").withColumn("b", (F.col("id") % 2).cast("int"))
    rows = sorted(df.collect(), key=lambda r: r["id"])
    x, a, b = np.array([r["v"] for r in rows]), np.array([r["label"] for r in rows]), np.array([r["b"] for r in rows])
    xc = x - x.mean(0)
    da = np.stack([(a == k) * 1.0 - (a == 2) for k in (0, 1)], 1)
    db = ((b == 0) * 1.0 - (b == 1))[:, None]
    d, last, want = np.ones((len(x), 1)), 0.0, {}
    for name, more in (("ss_a", da), ("ss_b", db), ("ss_ab", da * db)):
        d = np.hstack([d, more])
        now = ((d @ np.linalg.lstsq(d, xc, rcond=None)[0]) ** 2).sum()
        want[name], last = now - last, now
    got = stats.asca(df, "v", "label", "b")
    assert {k: got[k] for k in want} == pytest.approx(want) and got["ss_total"] == pytest.approx((xc**2).sum()) and sum(got[k] for k in ("ss_a", "ss_b", "ss_ab", "ss_residual")) == pytest.approx(got["ss_total"])


def test_penalties_are_those_of_the_plain_problems(spark, frame):
    from spectraloom.operators import catalogue

    x, _, y, _ = values(frame)
    y = y + np.sin(np.arange(90))
    df = spark.createDataFrame([(i, float(y[i]), x[i].tolist()) for i in range(90)], "id long, y double, v array<double>")
    xc, yc = x - x.mean(0), y - y.mean()
    ridge = xc @ np.linalg.solve(xc.T @ xc + np.eye(8), xc.T @ yc) + y.mean()
    got = [r["yhat"] for r in catalogue.regress(df, df, "v", "y", "ridge").orderBy("id").collect()]
    assert got == pytest.approx(ridge, abs=1e-6)


def test_reader_encodings_header_rows_and_types(spark, tmp_path):
    from spectraloom.sources import readers

    (tmp_path / "l.csv").write_bytes("id;Größe;n\n1;ü;2,5\n2;b;\n".encode("latin-1"))
    t = readers.read_table(spark, str(tmp_path / "l.csv"))
    assert t.columns == ["id", "Größe", "n"] and t.first()["Größe"] == "ü"
    assert dict(readers.typed(t).dtypes) == {"id": "double", "Größe": "string", "n": "double"}
    (tmp_path / "h.csv").write_text("made by x\n\nid,a\n1,2\n3,4\n")
    assert sorted(tuple(r) for r in readers.read_table(spark, str(tmp_path / "h.csv"), header_row=3).collect()) == [("1", "2"), ("3", "4")]
    assert readers.sniff(["a;b,c;d", "1;2;3", "4;5;6"])[0] == ";"
    with pytest.raises(ValueError, match="absent: z"):
        readers.matching(t, ["id", "z"])
