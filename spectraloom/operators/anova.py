"""Permutation tests and components of a designed experiment's effects (ASCA: Smilde et al., 2005; Vis et al., 2007)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions import arrays
from spectraloom.operators.stats import asca_effects

#: Rows whose cells change places with each other.
GROUP = 4096


def _cells(df: DataFrame, key: str, values: str, a: str, b: str) -> tuple[DataFrame, list[tuple[str, str]], np.ndarray]:
    """Rows (id, v, cell) with both factors, the levels of each cell and its number of rows."""
    name = lambda c: F.col(c).cast("string")
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(values).isNotNull())
    found = sorted(((r[0], r[1]), r[2]) for r in rows.groupBy(name(a), name(b)).agg(F.count("*")).collect())  # levels are few
    at = F.array_position(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b")) for (x, y), _ in found]), F.struct(name(a).alias("a"), name(b).alias("b"))) - 1
    return rows.select(F.xxhash64(key).alias("id"), arrays.doubles(F.col(values)).alias("v"), at.cast("int").alias("cell")), [k for k, _ in found], np.array([n for _, n in found], float)


def effects(df: DataFrame, key: str, values: str, a: str, b: str, times: int = 200, seed: int = 0) -> DataFrame:
    """(effect, ss, p): sums of squares of a, b and a x b, and the share of permutations of the rows with as large a one, (1 + c) / (1 + times).

    Rows are dealt by hash into groups of about GROUP and change their cells within a group, so a permutation is made where the rows are; every task
    hands on the sums of each cell in each permutation alone. Rows without a factor or values are left out; none left gives no rows.
    """
    rows, names, n = _cells(df, key, values, a, b)
    if not names:
        return df.sparkSession.createDataFrame([], "effect string, ss double, p double")
    groups, cells = max(1, int(n.sum()) // GROUP), len(names)

    def part(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        x, cell = np.stack([np.asarray(v, np.float64) for v in frame["v"]]), frame["cell"].to_numpy()
        rng = np.random.default_rng([seed, int(frame["part"].iloc[0])])
        sums = np.zeros((times + 1, cells, x.shape[1]))
        for t in range(times + 1):
            order = rng.permutation(len(x)) if t else np.arange(len(x))
            np.add.at(sums[t], cell[order], x)
        return pd.DataFrame({"t": np.arange(times + 1), "s": [s.ravel().tolist() for s in sums]})

    dealt = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(groups)))
    parts = dealt.groupBy("part").applyInPandas(part, "t int, s array<double>")
    by = parts.groupBy("t").agg(Summarizer.sum(array_to_vector("s")).alias("s"))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(t, *(v for v, _ in asca_effects(n, np.asarray(s, float).reshape(cells, -1) / n[:, None], names)[0].values())) for t, s in zip(batch["t"], batch["s"], strict=True)]
            yield pd.DataFrame(found, columns=["t", "ss_a", "ss_b", "ss_ab"])

    from pyspark.ml.functions import vector_to_array

    squares = by.select("t", vector_to_array("s").alias("s")).mapInPandas(judged, "t int, ss_a double, ss_b double, ss_ab double")
    long = squares.select("t", F.explode(F.array(*[F.struct(F.lit(c).alias("effect"), F.col(c).alias("ss")) for c in ("ss_a", "ss_b", "ss_ab")])).alias("e")).select("t", "e.*")
    own = long.where("t = 0").select("effect", F.col("ss").alias("own"))
    hit = F.count_if((F.col("t") > 0) & (F.col("ss") >= F.col("own") * (1 - 1e-12)))
    return long.join(F.broadcast(own), "effect").groupBy("effect", F.col("own").alias("ss")).agg(((1 + hit) / (1 + times)).alias("p"))  # three rows


def components(df: DataFrame, key: str, values: str, a: str, b: str, k: int = 2) -> DataFrame:
    """(effect, a, b, pc, score, share): principal components of each effect's cell means, weighted by their rows; the largest loading is positive."""
    rows, names, n = _cells(df, key, values, a, b)
    out = []
    if names:
        means = np.array([r.m.toArray() for r in rows.groupBy("cell").agg(Summarizer.mean(array_to_vector("v")).alias("m")).orderBy("cell").collect()])  # cells are few
        for effect, (_, fitted) in asca_effects(n, means, names)[0].items():
            u, s, vt = np.linalg.svd(np.sqrt(n)[:, None] * fitted, full_matrices=False)
            sign = np.sign(vt[np.arange(len(s)), np.abs(vt).argmax(1)])
            for pc in range(min(k, int((s > 1e-10 * max(s[0], 1e-300)).sum()))):
                score = sign[pc] * u[:, pc] * s[pc] / np.sqrt(n)
                out += [(effect, *cell, pc + 1, float(v), float(s[pc] ** 2 / (s**2).sum())) for cell, v in zip(names, score, strict=True)]
    return df.sparkSession.createDataFrame(out, "effect string, a string, b string, pc int, score double, share double")
