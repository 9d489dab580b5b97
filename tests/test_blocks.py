"""Models on moments against identities and straight-line NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.operators import blocks, catalogue, models


@pytest.fixture(scope="module")
def matrix():
    return np.random.default_rng(3).normal(size=(60, 8)) @ np.diag([3, 2, 2, 1, 1, 1, 0.5, 0.5]) + 4


@pytest.fixture(scope="module")
def frame(spark, matrix):
    rows = [(i, float(x[0] - 2 * x[3] + 0.3 * x[5]), x.tolist()) for i, x in enumerate(matrix)]
    return spark.createDataFrame(rows, "id long, y double, v array<double>").repartition(3)


def back(df, column):
    return np.array([r[column] for r in sorted(df.collect(), key=lambda r: (r["id"], r.asDict().get("copy", 0)))])


def test_opls_predicts_as_pls_with_one_more_component(frame):
    scored = back(blocks.opls(frame, "v", "y", 2).scored(frame, "v"), "opls")
    plain = back(models.pls(frame, "v", ["y"], 3).scores(frame, "v"), "yhat")
    assert scored[:, 1] == pytest.approx(plain[:, 0])
    assert scored[:, 2:].T @ scored[:, 0] == pytest.approx(0, abs=1e-6)


def test_transfer_undoes_a_linear_distortion(frame, matrix):
    both = frame.withColumn("second", F.transform("v", lambda x: 1.1 * x + 2))
    for kind in ("ds", "pds"):
        assert back(blocks.transfer(both, "second", "v", kind, rcond=1e-9).scores(both, "second", "out"), "out") == pytest.approx(matrix)
    lifted = frame.withColumn("second", F.transform("v", lambda x: x + 2))
    assert back(blocks.transfer(lifted, "second", "v", "offset").scores(lifted, "second", "out"), "out") == pytest.approx(matrix)


def test_nonnegative_solves_the_kkt_conditions():
    rng = np.random.default_rng(0)
    s, x = rng.random((3, 10)), rng.normal(size=(20, 10))
    c = blocks.nonnegative(s @ s.T, x @ s.T, 5000)
    gradient = c @ s @ s.T - x @ s.T
    assert c.min() >= 0 and gradient.min() > -1e-8 and np.abs(gradient * c).max() < 1e-8


def test_mcr_resolves_a_nonnegative_mixture(spark):
    rng = np.random.default_rng(1)
    pure, amounts = np.array([[1.0, 2, 1, 0, 0, 0], [0, 0, 0, 1, 3, 1]]), rng.random((30, 2))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(amounts @ pure)], "id long, v array<double>")
    found, lof = blocks.mcr_als(df, "v", 2, rounds=100, tol=1e-9)
    assert lof < 1
    x = back(blocks.concentrations(df, "v", found), "c") @ found
    assert x == pytest.approx(amounts @ pure, abs=0.02)


def test_augment_keeps_originals_and_repeats_itself(frame, matrix):
    made = blocks.augment(frame, "id", "v", copies=2)
    got = back(made, "v").reshape(60, 3, 8)
    assert got[:, 0] == pytest.approx(matrix)
    assert (got == back(blocks.augment(frame.repartition(5), "id", "v", copies=2), "v").reshape(60, 3, 8)).all()
    assert 0 < np.abs(got[:, 1:] - matrix[:, None]).mean() < 0.5


def test_contributions_add_up_to_the_prediction(frame):
    model = models.pls(frame, "v", ["y"], 4)
    parts = back(blocks.window_contributions(frame, "v", model, 3), "contributions")
    assert parts.sum(1) + model.intercept[0] == pytest.approx(back(model.scores(frame, "v"), "yhat")[:, 0])


def test_mcnemar_p():
    assert models.mcnemar_p(1, 8) == pytest.approx(0.0390625)
    assert models.mcnemar_p(10, 30) == pytest.approx(0.0027, abs=1e-4)


def test_catalogue(frame):
    out = catalogue.regress(frame, frame, "v", "y", "least_squares")
    assert back(out, "yhat") == pytest.approx(back(out, "y"))
    sorts = catalogue.classify(frame.withColumn("k", F.col("y") > -4), frame, "v", "k", "tree")
    assert {r["yhat"] for r in sorts.select("yhat").distinct().collect()} <= {"true", "false"}
