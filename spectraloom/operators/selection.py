"""Selection of all relevant variables against shadows of themselves (Boruta: Kursa & Rudnicki, 2010)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions import arrays

#: Rows among which a variable's values are permuted; such groups are dealt anew each round.
GROUP = 4096


def shadowed(df: DataFrame, key: str, values: str, turn: int, seed: int = 0, groups: int = 1) -> DataFrame:
    """values followed by as many shadows: each variable permuted on its own, by hashes of (seed, round, variable, row).

    Rows are dealt by hash into groups and permuted within them, so no task orders the table; which rows share a group
    has nothing to do with what they hold.
    """
    schema = df.schema

    def permute(rows):
        x = np.stack([np.asarray(v, np.float64) for v in rows[values]])
        rng = np.random.default_rng([seed, turn, int(rows["_group"].iloc[0])])
        order = np.argsort(rows["_row"].to_numpy(), kind="stable")  # the same draw however the rows arrive
        rows, x = rows.iloc[order], x[order]
        mixed = np.column_stack([x[rng.permutation(len(x)), j] for j in range(x.shape[1])])
        rows[values] = [np.concatenate(v).tolist() for v in zip(x, mixed, strict=True)]
        return rows.drop(columns=["_group", "_row"])

    dealt = df.withColumns({values: arrays.doubles(F.col(values)), "_group": F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), F.col(key)), F.lit(groups)), "_row": F.xxhash64(F.lit(seed + 1), F.lit(turn), F.col(key))})
    out = ", ".join(f"`{f.name}` {'array<double>' if f.name == values else f.dataType.simpleString()}" for f in schema)
    return dealt.groupBy("_group").applyInPandas(permute, out)


def _tail(hits: int, rounds: int) -> tuple[float, float]:
    """Chances of at least, and of at most, `hits` in `rounds` tosses of a coin."""
    each = [math.comb(rounds, i) / 2**rounds for i in range(rounds + 1)]
    return sum(each[hits:]), sum(each[: hits + 1])


def _step_up(p: np.ndarray, alpha: float) -> np.ndarray:
    """Hypotheses rejected at a false discovery rate of alpha (Benjamini & Hochberg, 1995)."""
    order = np.argsort(p, kind="stable")
    passed = np.flatnonzero(p[order] <= alpha * np.arange(1, len(p) + 1) / len(p))
    out = np.zeros(len(p), bool)
    if len(passed):
        out[order[: passed[-1] + 1]] = True
    return out


@dataclass
class Decisions:
    """Per variable: hits, and 1 (confirmed), -1 (rejected) or 0 (tentative); importance by round, NaN once rejected."""

    hits: np.ndarray
    state: np.ndarray
    history: list[np.ndarray] = field(default_factory=list)
    shadow: list[float] = field(default_factory=list)

    def decide(self, rounds: int, alpha: float) -> None:
        open_ = np.flatnonzero(self.state == 0)
        if not len(open_):
            return
        p = np.array([_tail(int(h), rounds) for h in self.hits[open_]])
        for side, verdict in ((0, 1), (1, -1)):  # both corrections must agree: for the variables of a round, and for the rounds
            both = _step_up(p[:, side], alpha) & (p[:, side] <= alpha / rounds)
            self.state[open_[both]] = verdict

    def tentative(self) -> np.ndarray:
        """Undecided variables whose median importance exceeds the shadows' median limit."""
        median = np.nanmedian(np.array(self.history), axis=0) if self.history else np.zeros(len(self.state))
        return (self.state == 0) & (median > np.median(self.shadow or [np.inf]))

    def mask(self) -> np.ndarray:
        """Confirmed variables; with fewer than two also the tentative ones; none if these are still fewer than two."""
        kept = self.state == 1
        if kept.sum() < 2:
            kept = kept | self.tentative()
        return kept if kept.sum() >= 2 else np.zeros(len(kept), bool)


def boruta(df: DataFrame, key: str, values: str, target: str, classify: bool, rounds: int = 50, trees: int = 100, depth: int = 7, percentile: float = 90, alpha: float = 0.05, seed: int = 0) -> Decisions:
    """Rounds of a forest over the variables left and their shadows; a variable whose importance exceeds the shadows' percentile has a hit.

    Hits are tested against a fair coin; rejected variables leave the later rounds, and the rounds end when none is undecided.
    Rows without a target or values are left out. Keys must be distinct.
    """
    rows = df.where(F.col(target).isNotNull() & F.col(values).isNotNull()).select(key, values, target)
    if classify:
        rows = rows.withColumn("_y", F.col(target).cast("string"))
        rows = StringIndexer(inputCol="_y", outputCol="_t", stringOrderType="alphabetAsc").fit(rows).transform(rows).drop("_y")
        forest = C.RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", labelCol="_t", featuresCol="_x")
    else:
        rows = rows.withColumn("_t", F.col(target).cast("double"))
        forest = R.RandomForestRegressor(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", labelCol="_t", featuresCol="_x")
    size = rows.agg(F.count("*"), F.max(F.size(values))).first()
    p, groups = size[1] or 0, max(1, size[0] // GROUP)
    found = Decisions(np.zeros(p, int), np.zeros(p, int))
    for turn in range(1, rounds + 1):
        left = np.flatnonzero(found.state >= 0)
        if not (found.state == 0).any():
            break
        cut = rows.withColumn(values, F.array(*[F.element_at(values, int(i) + 1) for i in left])).select(key, values, "_t")
        model = forest.setSeed(seed + turn).fit(shadowed(cut, key, values, turn, seed, groups).select("_t", array_to_vector(values).alias("_x")))
        got = model.featureImportances.toArray()
        own, other = got[: len(left)], got[len(left) :]
        limit = float(np.percentile(other, percentile))
        found.hits[left[own > limit]] += 1
        row = np.full(p, np.nan)
        row[left] = own
        found.history.append(row)
        found.shadow.append(limit)
        found.decide(turn, alpha)
    return found
