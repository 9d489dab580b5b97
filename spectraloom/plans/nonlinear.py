"""Registered queries on clustering, kernel machines, shadows, windows and searches; see registry for the tables' roles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spectraloom.operators import anova, blocks, clustering, evaluation, fusion, kernels, models, sampling, search, selection, screening, windows
from spectraloom.plans.modelling import folded
from spectraloom.plans.registry import query, rounded, spectra
from spectraloom.sources import saved, shared

#: Distance at which the tree of the spectra is cut.
CUT = 1.1


@query(f"""WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: power(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE), 2)))) <= {CUT}),
 r AS (SELECT vec_id, vec_id AS seen FROM embeddings UNION SELECT r.vec_id, p.b FROM r JOIN p ON p.a = r.seen) SELECT vec_id, min(seen) AS cluster FROM r GROUP BY 1""")
def m7_single_linkage(spark, d):
    """Rows joined by steps of at most CUT: the spanning tree cut at that distance."""
    return clustering.single_linkage(spectra(spark, d), "vec_id", "spectrum", CUT)


@query()
def m7_ward(spark, d):
    """Ten clusters by Ward's linkage; above 500 rows over 500 prototypes."""
    return clustering.clusters(spectra(spark, d), "vec_id", "spectrum", 10, "ward")


@query()
def m7_average(spark, d):
    """The linkage table by average distances."""
    return rounded(clustering.hierarchy(spectra(spark, d), "vec_id", "spectrum", "average")[0], "height")


@query()
def l6_svm(spark, d):
    df = folded(spark, d)
    return models.classify(df.where("fold = 0"), "spectrum", *kernels.svc(df.where("fold <> 0"), "spectrum", "label", rounds=25)).select("vec_id", "label", "yhat")


@query()
def l6_svr(spark, d):
    df = folded(spark, d)
    out = kernels.svr(df.where("fold <> 0"), "spectrum", "y", rounds=25).scores(df.where("fold = 0"), "spectrum")
    return out.select("vec_id", F.round("y", 6).alias("y"), F.round(F.col("yhat")[0], 3).alias("yhat"))


@query()
def v12_boruta(spark, d):
    """y depends on variables 0, 8 and 32. Twelve rounds of 20 trees; the operator's own defaults are 50 of 100."""
    found = selection.boruta(folded(spark, d), "vec_id", "spectrum", "y", False, rounds=12, trees=20)
    weak = found.tentative()
    return spark.createDataFrame([(i, int(h), int(s), bool(w)) for i, (h, s, w) in enumerate(zip(found.hits, found.state, weak, strict=True))], "var_idx int, hits int, decision int, weak boolean")


@query()
def m24_forest_windows(spark, d):
    """Twelve windows, forests of 30 trees; the operator's own default is 150."""
    parts = windows.cuts(64, 12)
    found, base, variables = windows.forest_importance(folded(spark, d), "vec_id", "spectrum", "y", "fold", parts, False, trees=30, depth=8)
    impurity = spark.createDataFrame([(i, v) for i, v in enumerate(windows.by_window(variables, parts))], "win int, impurity double")
    return rounded(found.join(F.broadcast(impurity), "win").withColumn("held_out_error", F.lit(base)), "loss", "importance", "impurity", "held_out_error", digits=5)


@query("""WITH {LONG}, e AS (SELECT range AS win, CAST(floor(range * 8.0) AS INTEGER) AS lo, CAST(floor((range + 1) * 8.0) AS INTEGER) AS hi FROM range(0, 8)),
 m AS (SELECT win, vec_id, label, avg(x) AS x FROM long JOIN e ON var_idx >= lo AND var_idx < hi GROUP BY ALL), s AS (SELECT win, label, count(*) AS c FROM m GROUP BY ALL), p AS (SELECT m.*, c FROM m JOIN s USING (win, label) WHERE c > 1),
 k AS (SELECT a.win, a.vec_id, a.x, a.c, abs(a.x - b.x) AS d, row_number() OVER (PARTITION BY a.win, a.vec_id ORDER BY abs(a.x - b.x)) AS r FROM p a JOIN p b ON a.win = b.win AND a.label = b.label AND a.vec_id <> b.vec_id),
 t AS (SELECT win, vec_id, x, c, d, least(3, c - 1) AS k FROM k WHERE r = least(3, c - 1)),
 i AS (SELECT t.win, t.vec_id, t.c, t.k, count(*) AS inside FROM t JOIN p ON p.win = t.win AND (abs(p.x - t.x) < t.d OR p.x = t.x) GROUP BY ALL),
 h AS (SELECT n + 1 AS n, sum(1.0 / n) OVER (ORDER BY n) - 0.57721566490153286 AS psi FROM range(1, 200001) u(n) UNION ALL SELECT 1, -0.57721566490153286),
 w AS (SELECT win, count(*) AS n, avg(hk.psi) AS pk, avg(hc.psi) AS pc, avg(hm.psi) AS pm FROM i JOIN h hk ON hk.n = k JOIN h hc ON hc.n = c JOIN h hm ON hm.n = inside GROUP BY 1)
 SELECT CAST(win AS INTEGER) AS win, round(greatest(h.psi + pk - pc - pm, 0), 6) AS mi FROM w JOIN h USING (n)""")
def m25_mutual_information(spark, d):
    rows = windows.means(spectra(spark, d), "spectrum", windows.cuts(64, 8), "label")
    return rounded(windows.mutual_information(rows, "label"), "mi")


@query()
def m27_linear_or_not(spark, d):
    """Two folds: PLS, forest and support vector machine for y."""
    df = folded(spark, d).withColumn("fold", F.col("fold") % 2)
    return rounded(windows.compared(df, "spectrum", "y", "fold", False), "score", digits=3)


def _objective(spark, d):
    """Q2 of PLS by recipe, share of the variables and components; one pass over the rows a recipe."""
    df, sums = folded(spark, d), {}

    def score(s: dict) -> float:
        if s["recipe"] not in sums:
            sums[s["recipe"]] = fusion.sums_by(df.withColumn("spectrum", screening.RECIPES[s["recipe"]](F.col("spectrum"))), ["spectrum"], "y", F.col("fold"))
        by = sums[s["recipe"]]
        order = abs(screening.correlations(fusion._all(list(by.values())))).argsort(kind="stable")[::-1]
        keep = order.argsort() < max(1, round(s["share"] * len(order)))
        return round(screening.cross_validated(by, s["components"], keep)[2], 6)

    return score


SPACE = {"recipe": ["none", "snv", "unit"], "share": [0.1, 0.25, 0.5, 1.0], "components": [1, 2, 3, 4, 6, 8, 10]}


@query()
def v6_tpe(spark, d):
    return search.tpe(spark, SPACE, _objective(spark, d), 30).select("trial", F.to_json("params").alias("params"), "score")


@query()
def v6_random(spark, d):
    return search.drawn(spark, SPACE, _objective(spark, d), 8).select("trial", F.to_json("params").alias("params"), "score")


# ---- representative rows ------------------------------------------------------------------


@query()
def t10_m30_kennard_stone(spark, d):
    """A hundred rows in the order of their choice."""
    return sampling.farthest(spectra(spark, d), "vec_id", "spectrum", 100)


@query()
def m30_spxy(spark, d):
    return sampling.farthest(folded(spark, d), "vec_id", "spectrum", 100, "y")


@query()
def m31_coverage(spark, d):
    """Distance of every other row to the nearest of fifty chosen by their first five principal components."""
    return rounded(sampling.coverage(spectra(spark, d), "vec_id", "spectrum", 50)[1], "distance", digits=5)


@query()
def v4_kennard_stone_split(spark, d):
    """A fifth of each class held out."""
    return sampling.split(spectra(spark, d), "vec_id", "spectrum", 0.2, "label").select("vec_id", "label", "held_out")


# ---- designed experiments -----------------------------------------------------------------


def _designed(spark, d):
    """Two crossed factors; a shifts the first variables."""
    a = F.col("vec_id") % 2
    return spectra(spark, d).withColumns({"a": a, "b": F.floor(F.col("vec_id") / 2) % 5}).withColumn("spectrum", F.transform("spectrum", lambda x, i: F.when(i < 4, x + 0.05 * a).otherwise(x)))


@query()
def m35_asca_permutations(spark, d):
    return rounded(anova.effects(_designed(spark, d), "vec_id", "spectrum", "a", "b"), "ss")


@query()
def m35_effect_components(spark, d):
    return rounded(anova.components(_designed(spark, d), "vec_id", "spectrum", "a", "b"), "score", "share", digits=5)


# ---- one call from training to test, and saved models ---------------------------------------


@query()
def v2_out_of_fold(spark, d):
    """Held-out class and its share for every row, discriminant PLS in five folds."""
    out = evaluation.out_of_fold(folded(spark, d), "vec_id", "spectrum", "label", "fold", "pls_da")
    return out.select("vec_id", "fold", "y", "yhat", F.round(F.element_at("shares", F.col("yhat")), 5).alias("share"))


@query()
def v5_validated(spark, d):
    """A sixth of the rows held out; Gaussian naive Bayes on the others in five folds, then on the sixth."""
    df = folded(spark, d).withColumn("held", F.col("vec_id") % 6 == 0)
    found = evaluation.validated(df, "vec_id", "spectrum", "label", "fold", "held", "naive_bayes")
    return rounded(found, *[c for c in found.columns if c not in ("stage", "n")], digits=5)


@query()
def m44_augmented_folds(spark, d):
    """Two simulated rows for each one of the training folds: discriminant PLS with and without them."""
    df = folded(spark, d)
    out = None
    for name, more in (("plain", None), ("augmented", lambda t: blocks.augment(t, "vec_id", "spectrum", 2))):
        part = models.overall(evaluation.out_of_fold(df, "vec_id", "spectrum", "label", "fold", "pls_da", more)).withColumn("training", F.lit(name))
        out = part if out is None else out.unionAll(part)
    return rounded(out, *[c for c in out.columns if c not in ("training", "n")], digits=5)


@query()
def k6_s16_saved_model(spark, d):
    """A PLS model of standardised spectra, saved, loaded and used on fold 0."""
    df, recipe = folded(spark, d), {"snv": screening.RECIPES["snv"]}
    train = df.where("fold <> 0")
    model = models.pls(train.withColumn("spectrum", recipe["snv"](F.col("spectrum"))), "spectrum", ["y"], 6)
    path = f"{shared.folder(spark)}/model-{uuid.uuid4().hex}"
    saved.save(spark, saved.Bundle("regression", model, [float(i) for i in range(64)], [True] * 64, [("snv", {})], None, saved.fingerprint(train, "vec_id", "spectrum")), path)
    out = saved.predicted(df.where("fold = 0"), "spectrum", saved.load(spark, path), recipe)
    return out.select("vec_id", F.round("yhat", 6).alias("yhat"))


@query("SELECT 'kept' AS result, 'current' AS state UNION ALL SELECT 'changed', 'stale' UNION ALL SELECT 'never', 'absent'")
def k9_stale_results(spark, d):
    """Fingerprints of the spectra now and as results have used them: the same rows in another order, rows with one value changed, none."""
    df = spectra(spark, d)
    now = saved.fingerprint(df, "vec_id", "spectrum")
    other = saved.fingerprint(df.withColumn("spectrum", F.transform("spectrum", lambda x, i: F.when((i == 3) & (F.col("vec_id") == 7), x + 1e-9).otherwise(x))), "vec_id", "spectrum")
    states = saved.stale(dict.fromkeys(("kept", "changed", "never"), now), {"kept": saved.fingerprint(df.repartition(5), "vec_id", "spectrum"), "changed": other})
    return spark.createDataFrame(list(states.items()), "result string, state string")
