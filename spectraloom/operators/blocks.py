"""Orthogonal filters, calibration transfer, curve resolution and augmentation of spectra.

Fits use second moments or k x p aggregates; rows never leave the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions import arrays
from spectraloom.operators.fusion import Sums, _all
from spectraloom.operators.models import Linear
from spectraloom.operators.signal import map_matrix
from spectraloom.operators.stats import moments, moments_by


def _joined(*arrays: Column) -> Column:
    return F.concat(*[F.transform(a, lambda x: x.cast("double")) for a in arrays])


# ---- orthogonal PLS -----------------------------------------------------------------------


@dataclass
class OPLS:
    """Orthogonal PLS of one target (Trygg & Wold, 2002): `filters` are (weight, loading) pairs, then one predictive direction."""

    mean: np.ndarray
    filters: list[tuple[np.ndarray, np.ndarray]]
    weight: np.ndarray
    slope: float
    intercept: float

    def coefficients(self) -> np.ndarray:
        """Of the centred values, filters included."""
        out = self.weight * self.slope
        for w, p in reversed(self.filters):
            out = out - w * (p @ out)
        return out

    def scored(self, df: DataFrame, values: str) -> DataFrame:
        """Adds opls: the predictive score, the prediction, then the orthogonal scores."""

        def run(x: np.ndarray) -> np.ndarray:
            x, orthogonal = x - self.mean, []
            for w, p in self.filters:
                t = x @ w
                orthogonal.append(t)
                x = x - np.outer(t, p)
            t = x @ self.weight
            return np.stack([t, t * self.slope + self.intercept, *orthogonal], axis=1)

        return map_matrix(df.withColumn("opls", _joined(F.col(values))), "opls", run)


def opls(df: DataFrame, values: str, target: str, orthogonal: int) -> OPLS:
    """Stops early where nothing orthogonal is left."""
    return opls_of(*moments(df.select(_joined(F.col(values), F.array(target)).alias("v")), "v")[1:], orthogonal)


def opls_of(mean: np.ndarray, cov: np.ndarray, orthogonal: int) -> OPLS:
    """opls() from the moments of values and target side by side."""
    p = len(mean) - 1
    xx, xy = cov[:p, :p].copy(), cov[:p, p].copy()
    filters: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(orthogonal):
        w = xy / max(np.linalg.norm(xy), 1e-300)
        load = xx @ w / max(w @ xx @ w, 1e-300)
        wo = load - (w @ load) * w
        if np.linalg.norm(wo) < 1e-10:
            break
        wo /= np.linalg.norm(wo)
        po = xx @ wo / max(wo @ xx @ wo, 1e-300)
        left = np.eye(p) - np.outer(wo, po)
        xx, xy = left.T @ xx @ left, left.T @ xy
        filters.append((wo, po))
    w = xy / max(np.linalg.norm(xy), 1e-300)
    return OPLS(mean[:p], filters, w, float(w @ xy / max(w @ xx @ w, 1e-300)), float(mean[p]))


def opls_curve(by: dict[str, Sums], most: int = 5) -> list[tuple[int, float, float]]:
    """(orthogonal components, q2, r2) for 0 to `most`, from sums by fold: each fold by a model of the others, and the fit to all rows."""
    total = _all(list(by.values()))
    spread = max(total.q[-1, -1] - total.s[-1] ** 2 / total.n, 1e-300)
    out = []
    for k in range(most + 1):
        error = lambda fit, judged: judged.errors(fit[0], opls_of(*fit, k).coefficients())[0]  # noqa: E731, B023
        press = sum(error((total - own).centred(), own) for own in by.values())
        out.append((k, float(1 - press / spread), float(1 - error(total.centred(), total) / spread)))
    return out


# ---- calibration transfer -----------------------------------------------------------------


def transfer(df: DataFrame, secondary: str, master: str, kind: str = "pds", half: int = 5, rcond: float = 1e-3, rank: int | None = None) -> Linear:
    """Maps spectra of a second instrument onto the master's, from rows that hold both (Wang, Veltkamp & Kowalski, 1991).

    offset: mean difference; ds: one regression on all variables; pds: one on `half` neighbours at each side. Regressions leave out
    singular values of the spectra below rcond times the largest, and all but the first `rank`.
    """
    return _mapping(*moments(df.select(_joined(F.col(secondary), F.col(master)).alias("v")), "v")[1:], kind, half, rcond, rank)


def _truncated(cov: np.ndarray, rcond: float, rank: int | None) -> np.ndarray:
    """Inverse of a covariance on its leading eigenvectors; eigenvalues are squares of singular values."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values > max(rcond**2 * values[0], 0)).sum())
    k = min(k, rank) if rank else k
    return (vectors[:, :k] / values[:k]) @ vectors[:, :k].T


def _mapping(mean: np.ndarray, cov: np.ndarray, kind: str, half: int, rcond: float, rank: int | None = None) -> Linear:
    """transfer() from the moments of both spectra side by side."""
    p = len(mean) // 2
    ss, sm = cov[:p, :p], cov[:p, p:]
    coef = np.eye(p)
    if kind == "ds":
        coef = _truncated(ss, rcond, rank) @ sm
    elif kind == "pds":
        coef = np.zeros((p, p))
        for j in range(p):
            near = np.arange(max(0, j - half), min(p, j + half + 1))
            coef[near, j] = _truncated(ss[np.ix_(near, near)], rcond, rank) @ sm[near, j]
    return Linear(mean[:p], coef, mean[p:])


def transfer_errors(df: DataFrame, secondary: str, master: str, group: str, kinds: tuple[str, ...] = ("offset", "ds", "pds"), half: int = 5, rcond: float = 1e-3, rank: int | None = None) -> DataFrame:
    """(kind, n, before, after): root mean squares of the differences to the master, each group mapped by a fit to all others.

    One pass sums the moments of each group (few); errors of a linear map follow from them.
    """
    rows = df.where(F.col(secondary).isNotNull() & F.col(master).isNotNull()).select(group, _joined(F.col(secondary), F.col(master)).alias("v"))
    sums = {g: (n, n * m, (n - 1) * np.nan_to_num(c) + n * np.outer(m, m)) for g, (n, m, c) in moments_by(rows, "v", group).items()}
    n_all, s_all, q_all = (sum(x[i] for x in sums.values()) for i in range(3))

    def squares(w: np.ndarray, at: np.ndarray, n: int, s: np.ndarray, q: np.ndarray) -> float:
        return float(np.sum(w * (q @ w)) - 2 * at @ (s @ w) + n * at @ at)

    out = []
    for kind in kinds if len(sums) > 1 else ():
        before = after = 0.0
        for n, s, q in sums.values():
            rest, p = n_all - n, len(s) // 2
            mean = (s_all - s) / rest
            fit = _mapping(mean, (q_all - q - rest * np.outer(mean, mean)) / max(1, rest - 1), kind, half, rcond, rank)
            before += squares(np.vstack([np.eye(p), -np.eye(p)]), np.zeros(p), n, s, q)
            after += squares(np.vstack([fit.coef, -np.eye(p)]), mean[:p] @ fit.coef - mean[p:], n, s, q)
        out.append((kind, int(n_all), *(float(np.sqrt(max(0.0, x) / (n_all * p))) for x in (before, after))))
    return df.sparkSession.createDataFrame(out, "kind string, n long, before double, after double")


# ---- multivariate curve resolution --------------------------------------------------------


def nonnegative(gram: np.ndarray, cross: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """Rows c >= 0 that minimise c G c' - 2 c b', by coordinate descent (Franc, Hlavac & Navara, 2005)."""
    c = np.zeros_like(cross)
    for _ in range(sweeps):
        before = c.copy()
        for j in range(len(gram)):
            c[:, j] = np.maximum(0, c[:, j] - (c @ gram[:, j] - cross[:, j]) / max(gram[j, j], 1e-300))
        if np.abs(c - before).max(initial=0) <= 1e-12 * max(1.0, np.abs(c).max(initial=0)):
            break
    return c


def mcr_als(df: DataFrame, values: str, k: int, rounds: int = 30, tol: float = 1e-6) -> tuple[np.ndarray, float]:
    """Pure spectra (k x p, unit length) and the lack of fit in %: alternating non-negative least squares (Tauler, 1995).

    A round is one pass over the rows: concentrations are solved where the rows are, and only C'C, C'D and squares are summed.
    """
    from spectraloom.operators.stats import summed

    n, mean, cov = moments(df, values)
    raw = cov * max(1, n - 1) + n * np.outer(mean, mean)
    pure = np.abs(np.linalg.eigh(raw)[1][:, ::-1][:, :k].T)
    p, total, last, lof = len(mean), float(np.trace(raw)), np.inf, np.inf
    for _ in range(rounds):

        def part(x: np.ndarray, s: np.ndarray = pure) -> np.ndarray:
            c = nonnegative(s @ s.T, x @ s.T)
            return np.concatenate([(c.T @ c).ravel(), (c.T @ x).ravel(), [((x - c @ s) ** 2).sum()]])

        got = summed(df, values, part)
        cc, cd = got[: k * k].reshape(k, k), got[k * k : -1].reshape(k, p)
        lof = 100 * float(np.sqrt(got[-1] / max(total, 1e-300)))
        if abs(last - lof) <= tol * max(lof, 1e-300):
            break
        last = lof
        solved = nonnegative(cc, cd.T).T
        length = np.linalg.norm(solved, axis=1, keepdims=True)
        pure = solved / np.where(length > 0, length, 1)
    return pure, lof


def concentrations(df: DataFrame, values: str, pure: np.ndarray) -> DataFrame:
    return map_matrix(df.withColumn("c", _joined(F.col(values))), "c", lambda x: nonnegative(pure @ pure.T, x @ pure.T))


# ---- augmentation -------------------------------------------------------------------------


def normal(*parts: Column | int) -> Column:
    """A standard normal number fixed by its parts (Box-Muller on hashes): a task that runs again makes the same one."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    u = lambda salt: (F.pmod(F.xxhash64(F.lit(salt), *cols), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return F.sqrt(-2 * F.ln(u("a"))) * F.cos(2 * np.pi * u("b"))


def augment(df: DataFrame, key: str, values: str, copies: int = 2, noise: float = 0.01, scale: float = 0.02, offset: float = 0.01, slope: float = 0.01, seed: int = 0) -> DataFrame:
    """The rows (copy 0) and `copies` simulated ones of each: multiplied, on another baseline, tilted, with noise.

    Amounts are shares of a spectrum's own standard deviation (scale: of 1). No shuffle.
    """
    x = F.transform(values, lambda v: v.cast("double"))
    draw = lambda what: normal(seed, F.lit(what), F.col(key), F.col("copy"))
    amounts = F.struct(arrays.sd_pop(x).alias("sd"), (1 + scale * draw("scale")).alias("by"), (offset * draw("offset")).alias("up"), (slope * draw("slope")).alias("tilt"))
    place = lambda i: 2 * i / F.greatest(F.size(values) - 1, F.lit(1)) - 1
    one = lambda a: F.transform(x, lambda v, i: v * a["by"] + a["sd"] * (a["up"] + a["tilt"] * place(i) + noise * normal(seed, F.lit("noise"), F.col(key), F.col("copy"), i)))
    made = F.get(F.transform(F.array(amounts), one), 0)  # a lambda's argument, so that amounts are worked out once a row
    many = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    return many.withColumn(values, F.when(F.col("copy") == 0, x).otherwise(made))


# ---- explanation --------------------------------------------------------------------------


def window_contributions(df: DataFrame, values: str, model: Linear, windows: int, target: int = 0) -> DataFrame:
    """Adds contributions: by how much the prediction falls if a window is replaced by the mean spectrum (exact for a linear model)."""
    cuts = np.linspace(0, len(model.mean), windows + 1).astype(int)
    spread = np.zeros((len(model.mean), windows))
    for j in range(windows):
        spread[cuts[j] : cuts[j + 1], j] = model.coef[cuts[j] : cuts[j + 1], target]
    return map_matrix(df.withColumn("contributions", _joined(F.col(values))), "contributions", lambda x: (x - model.mean) @ spread)
