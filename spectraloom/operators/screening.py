"""Screening of recipes, selections and model sizes on the same folds; searches for variables; curves over components.

A recipe is a pretreatment of the array column. For each one, a single pass over the rows sums second moments by fold
(fusion.sums_by), and every setting on top (components, selected variables) follows from those sums on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions import arrays
from spectraloom.operators.fusion import Sums, _all, sums_by
from spectraloom.operators.models import pls_kernel

RECIPES: dict[str, Callable[[Column], Column]] = {"none": arrays.doubles, "snv": arrays.snv, "area": arrays.area, "unit": arrays.unit, "minmax": arrays.minmax}
RESULT = "recipe string, selection string, components int, variables int, n long, rmse double, r2 double, error string"


def cross_validated(by: dict[str, Sums], k: int, keep: np.ndarray | None = None) -> tuple[int, float, float]:
    """n, rmse and r2 of PLS with k components on the kept variables, each fold by the sums of the others."""
    p = len(next(iter(by.values())).s) - 1
    at = np.append(np.arange(p) if keep is None else np.flatnonzero(keep), p)
    cut = {f: Sums(x.n, x.s[at], x.q[np.ix_(at, at)]) for f, x in by.items()}
    total = _all(list(cut.values()))
    sse = 0.0
    for own in cut.values():
        mean, cov = (total - own).centred()
        sse += own.errors(mean, pls_kernel(cov[:-1, :-1], cov[:-1, -1:], k)[1][:, 0])[0]
    spread = total.q[-1, -1] - total.s[-1] ** 2 / total.n
    return total.n, float(np.sqrt(sse / total.n)), float(1 - sse / max(spread, 1e-300))


def screen(df: DataFrame, values: str, target: str, fold: str, recipes: list[str], components: list[int], shares: list[float] = (1.0,), done: DataFrame | None = None) -> DataFrame:
    """A row a combination (see RESULT). Those in `done` (recipe, selection, components) are left out, so that a stopped run goes on.

    A selection keeps a share of the variables by correlation with the target. A combination that fails has its error, no metrics.
    """
    finished = {(r["recipe"], r["selection"], r["components"]) for r in done.select("recipe", "selection", "components").collect()} if done is not None else set()
    rows = []
    for recipe in recipes:
        todo = [(f"top {s:g}", s, k) for s in shares for k in components if (recipe, f"top {s:g}", k) not in finished]
        if not todo:
            continue
        by = sums_by(df.withColumn(values, RECIPES[recipe](F.col(values))), [values], target, F.col(fold))
        order = np.argsort(-np.abs(correlations(_all(list(by.values())))), kind="stable")
        for name, share, k in todo:
            keep = np.zeros(len(order), bool)
            keep[order[: max(1, round(share * len(order)))]] = True
            try:
                rows.append((recipe, name, k, int(keep.sum()), *cross_validated(by, k, keep), None))
            except np.linalg.LinAlgError as e:
                rows.append((recipe, name, k, int(keep.sum()), None, None, None, str(e)))
    return df.sparkSession.createDataFrame(rows, RESULT)


def correlations(total: Sums) -> np.ndarray:
    _, cov = total.centred()
    d = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    return cov[:-1, -1] / (d[:-1] * d[-1])


def ranked(results: DataFrame) -> DataFrame:
    """Results with rank: least rmse first, then fewer variables, then fewer components; failed ones last. A row a combination."""
    from pyspark.sql import Window

    order = [F.asc_nulls_last("rmse"), F.asc("variables"), F.asc("components"), F.asc("recipe"), F.asc("selection")]
    return results.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


# ---- searches over second moments ---------------------------------------------------------


def genetic(by: dict[str, Sums], k: int, population: int = 30, generations: int = 20, tournament: int = 3, crossover: float = 0.8, mutation: float = 0.02, parsimony: float = 0.001, seed: int = 0) -> np.ndarray:
    """Mask of variables by a genetic search: r2 less `parsimony` a variable, tournaments, uniform crossover, elitism."""
    rng = np.random.default_rng(seed)
    p = len(next(iter(by.values())).s) - 1
    known: dict[bytes, float] = {}

    def fitness(mask: np.ndarray) -> float:
        key = mask.tobytes()
        if key not in known:
            known[key] = cross_validated(by, min(k, int(mask.sum())), mask)[2] - parsimony * mask.sum() if mask.any() else -np.inf
        return known[key]

    pool = rng.random((population, p)) < 0.5
    for _ in range(generations):
        score = np.array([fitness(m) for m in pool])
        fresh = [pool[score.argmax()].copy()]
        pick = lambda: pool[(t := rng.integers(0, population, tournament))[score[t].argmax()]]  # noqa: E731, B023
        while len(fresh) < population:
            a, b = pick(), pick()
            child = np.where(rng.random(p) < 0.5, a, b) if rng.random() < crossover else a.copy()
            fresh.append(child ^ (rng.random(p) < mutation))
        pool = np.array(fresh)
    return pool[np.argmax([fitness(m) for m in pool])]


def halving(by: dict[str, Sums], settings: list[dict], seed: int = 0) -> list[dict]:
    """Successive halving over settings (components, keep): each round doubles the folds that judge and keeps the better half; best first."""
    names = sorted(by)
    rng = np.random.default_rng(seed)
    rng.shuffle(names)
    left, folds = list(settings), 2
    while True:
        some = {f: by[f] for f in names[:folds]}
        scored = sorted(left, key=lambda s: cross_validated(some, s["components"], s.get("keep"))[1])
        if len(scored) == 1 or folds >= len(names):
            return scored
        left, folds = scored[: max(1, len(scored) // 2)], min(len(names), folds * 2)


def component_curve(by: dict[str, Sums], most: int) -> list[tuple[int, float, float]]:
    """(components, rmse, q2) for 1 to `most` components."""
    return [(k, *cross_validated(by, k)[1:]) for k in range(1, most + 1)]


def pc_combinations(by: dict[str, Sums], most: int = 3, among: int = 8) -> list[tuple[tuple[int, ...], float]]:
    """Combinations of 1 to `most` principal components by cross-validated Q2 of the regression on them, best first."""
    from itertools import combinations

    _, cov = _all(list(by.values())).centred()
    loads = np.linalg.eigh(cov[:-1, :-1])[1][:, ::-1][:, :among]
    turn = np.zeros((len(cov), loads.shape[1] + 1))
    turn[:-1, :-1], turn[-1, -1] = loads, 1.0
    scores = {f: Sums(x.n, x.s @ turn, turn.T @ x.q @ turn) for f, x in by.items()}
    found = []
    for size in range(1, most + 1):
        for combo in combinations(range(loads.shape[1]), size):
            mask = np.zeros(loads.shape[1], bool)
            mask[list(combo)] = True
            found.append((combo, cross_validated(scores, size, mask)[2]))
    return sorted(found, key=lambda x: (-x[1], len(x[0]), x[0]))
