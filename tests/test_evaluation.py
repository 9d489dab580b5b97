"""Out-of-fold shares, one call from training to test, saved models and staleness."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.operators import blocks, domain, evaluation, kernels, models, screening, simca, stats
from spectraloom.sources import saved


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(18)
    c = np.arange(120) % 3
    x = rng.normal(size=(120, 4)) + 1.5 * np.eye(3, 4)[c]
    rows = [(i, v.tolist(), f"k{k}", float(v[0] - v[1]), (i // 3) % 4, i % 10 == 0) for i, (v, k) in enumerate(zip(x, c, strict=True))]
    return spark.createDataFrame([*rows, (900, [0.0] * 4, None, None, 1, False), (901, None, "k1", None, 1, False)], "id long, v array<double>, c string, y double, fold int, held boolean").repartition(3)


@pytest.mark.parametrize("kind", ["lda", "pls_da", "naive_bayes"])
def test_out_of_fold(df, kind):
    rows = evaluation.out_of_fold(df, "id", "v", "c", "fold", kind).collect()
    assert sorted(r.id for r in rows) == list(range(120))
    assert all(set(r.shares) == {"k0", "k1", "k2"} and sum(r.shares.values()) == pytest.approx(1) and r.shares[r.yhat] == max(r.shares.values()) for r in rows)
    own = evaluation.classify(df.where("fold <> 2"), df.where("fold = 2 and c is not null and v is not null"), "v", "c", kind).collect()
    assert {r.id: r.yhat for r in own} == {r.id: r.yhat for r in rows if r.fold == 2}
    assert np.mean([r.y == r.yhat for r in rows]) > 0.6


def test_validated(df):
    got = {r.stage: r for r in evaluation.validated(df, "id", "v", "c", "fold", "held", "lda").collect()}
    assert {k: r.n for k, r in got.items()} == {"cv": 108, "test": 12}
    rows = evaluation.out_of_fold(df.where("not held"), "id", "v", "c", "fold", "lda").collect()
    assert got["cv"].accuracy == pytest.approx(np.mean([r.y == r.yhat for r in rows]))
    areas = []
    for k in ("k0", "k1", "k2"):
        pos, neg = [r.shares[k] for r in rows if r.y == k], [r.shares[k] for r in rows if r.y != k]
        areas.append(np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]))
    assert got["cv"].auc == pytest.approx(np.mean(areas)) and got["cv"].macro_specificity > 0.7
    assert [r.stage for r in evaluation.validated(df.where("not held"), "id", "v", "c", "fold", "held", "lda").collect()] == ["cv"]


def test_saved_models_predict_alike(spark, df, tmp_path):
    whole = df.where("y is not null")
    axis = [400.0, 401.5, 403.0, 404.5]
    back = lambda rows: [(r.id, r.yhat) for r in rows.orderBy("id").collect()]
    model = models.pls(whole, "v", ["y"], 2)
    saved.save(spark, saved.Bundle("regression", model, axis, [True] * 4), str(tmp_path / "a"))
    got = saved.load(spark, str(tmp_path / "a"))
    assert got.matches(axis) and not got.matches(axis[:3]) and not got.matches([a + 1 for a in axis]) and got.classes is None and got.steps == []
    assert back(saved.predicted(whole, "v", got)) == back(model.scores(whole, "v").withColumn("yhat", F.col("yhat")[0]))

    steps = {"snv": screening.RECIPES["snv"]}
    model = models.pls(whole.withColumn("v", steps["snv"](F.col("v"))), "v", ["y"], 2)
    rows = np.array([r.v for r in whole.orderBy("id").collect()])
    rows = (rows - rows.mean(1, keepdims=True)) / rows.std(1, keepdims=True)
    found = [y for _, y in back(saved.predicted(whole, "v", saved.Bundle("regression", model, axis, [True] * 4, [("snv", {})]), steps))]
    assert np.allclose(found, (rows - model.mean) @ model.coef[:, 0] + model.intercept[0])
    cut = whole.withColumn("v", F.slice(steps["snv"](F.col("v")), 2, 3))
    names, machine = kernels.svc(cut, "v", "c", features=64, rounds=8)
    saved.save(spark, saved.Bundle("classification", machine, axis, [False, True, True, True], [("snv", {})], names, saved.fingerprint(whole, "id", "v")), str(tmp_path / "b"))
    got = saved.load(spark, str(tmp_path / "b"))
    assert back(saved.predicted(whole, "v", got, steps)) == back(models.classify(cut, "v", names, machine))
    assert got.fingerprint == saved.fingerprint(whole.repartition(7), "id", "v") != saved.fingerprint(whole.where("id > 0"), "id", "v")
    assert saved.stale({"a": 1, "b": 2, "c": 3}, {"a": 1, "b": 9}) == {"a": "current", "b": "stale", "c": "absent"}

    for i, other in enumerate((blocks.opls(whole, "v", "y", 2), domain.fit(whole, "v"), stats.PCA.from_moments(*stats.moments(whole, "v"), 2))):
        saved.save(spark, saved.Bundle("regression", other, axis, [True] * 4), str(tmp_path / f"m{i}"))
        again = saved.load(spark, str(tmp_path / f"m{i}")).model
        score = "scored" if hasattr(other, "scored") else "judged"
        assert [tuple(r) for r in getattr(other, score)(whole, "v").orderBy("id").collect()] == [tuple(r) for r in getattr(again, score)(whole, "v").orderBy("id").collect()]

    whole.write.parquet(str(tmp_path / "none"))
    with pytest.raises(ValueError, match="columns"):
        saved.load(spark, str(tmp_path / "none"))
    spark.read.parquet(str(tmp_path / "a")).where("not place like 'axis%'").write.parquet(str(tmp_path / "part"))
    with pytest.raises(ValueError, match="axis"):
        saved.load(spark, str(tmp_path / "part"))


def test_simulated_rows_stay_out_of_their_own_fold(df):
    seen = []

    def enlarge(train):
        seen.append({(r.id, r.fold) for r in train.collect()})
        return blocks.augment(train, "id", "v", 2)

    rows = evaluation.out_of_fold(df, "id", "v", "c", "fold", "lda", enlarge).collect()
    for fold, train in enumerate(seen):
        assert fold not in {f for _, f in train} and not {i for i, _ in train} & {r.id for r in rows if r.fold == fold}
    assert len(rows) == 120 and len(seen) == 4
    assert {r.stage: r.n for r in evaluation.validated(df, "id", "v", "c", "fold", "held", "lda", enlarge).collect()} == {"cv": 108, "test": 12}
    assert all(i % 10 for i, _ in seen[-1])  # the final model has not seen the held-out rows either


def test_simca_limits_come_from_refitting(spark, df):
    rows = df.where("c is not null and v is not null")
    classes = stats.simca(rows, "v", "c")
    got = {(r["class"], r.key): (r.fold, r.q) for r in simca.held_out_residuals(df, "id", "v", "c", classes, 4).collect()}
    data = [(r.c, r.id, np.array(r.v)) for r in rows.collect()]
    assert set(got) == {(c, i) for c, i, _ in data}
    for c, i, v in data:
        others = np.array([w for d, j, w in data if d == c and got[c, j][0] != got[c, i][0]])
        loads = np.linalg.svd(others - others.mean(0))[2][: len(classes[c].eigenvalues)].T
        e = v - others.mean(0)
        assert got[c, i][1] == pytest.approx(((e - loads @ (loads.T @ e)) ** 2).sum(), abs=1e-9)
    found = simca.limits(df, "id", "v", "c", classes, 0.05, 4)
    for c, m in classes.items():
        q = [x for (d, _), (_, x) in got.items() if d == c]
        high, theory = np.quantile(q, 0.95), m.q_limit(0.05)
        assert found[c] == pytest.approx(max(theory, high) if np.isfinite(theory) and theory >= np.quantile(q, 0.05) else high)
    tiny = df.where("c = 'k1' and v is not null").limit(4)
    assert simca.held_out_residuals(tiny, "id", "v", "c", stats.simca(tiny, "v", "c"), 2).count() == 4
