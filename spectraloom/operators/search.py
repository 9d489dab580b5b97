"""Searches over settings: random draws and tree-structured Parzen estimators (Bergstra et al., 2011) over lists of choices.

A trial is a row (trial, params, score); a stopped search goes on from the rows it has, and ends with the same
trials as one that was never stopped, since the choice of a trial depends on the seed, its number and the earlier rows alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

TRIALS = "trial int, params map<string,string>, score double"
#: Trials drawn blindly before densities lead, candidates a trial, the largest number of trials that count as good.
BLIND, CANDIDATES, GOOD = 10, 24, 25


def settings(space: dict[str, list]) -> int:
    return math.prod(len(v) for v in space.values())


def _setting(space: dict[str, list], number: int) -> dict:
    """The number-th combination of a grid."""
    out = {}
    for name, choices in space.items():
        number, at = divmod(number, len(choices))
        out[name] = choices[at]
    return out


def random_settings(space: dict[str, list], n: int, seed: int = 0) -> list[dict]:
    """n different settings, or all if there are no more, in a random order fixed by the seed."""
    total = settings(space)
    if total <= 1 << 20:
        picked = np.random.default_rng(seed).permutation(total)[:n]
    else:
        rng, held = np.random.default_rng(seed), {}
        while len(held) < min(n, total):
            held[int(rng.integers(total))] = None
        picked = np.array(list(held))
    return [_setting(space, int(i)) for i in picked]


def _shares(seen: list[int], choices: int) -> np.ndarray:
    """A choice's share among trials, with one trial spread over all choices beforehand."""
    return (np.bincount(seen, minlength=choices) + 1 / choices) / (len(seen) + 1)


def propose(space: dict[str, list], trials: list[tuple[dict, float]], seed: int = 0) -> dict:
    """The next setting (the larger the score the better): blind at first, then the candidate, drawn from the good trials'
    densities, whose ratio of densities among good and other trials is largest. Failed trials (score None) count as others."""
    rng = np.random.default_rng([seed, len(trials)])
    if len(trials) < BLIND:
        return {name: choices[int(rng.integers(len(choices)))] for name, choices in space.items()}
    ranked = sorted(trials, key=lambda t: -math.inf if t[1] is None else t[1], reverse=True)
    good = min(math.ceil(0.1 * len(ranked)), GOOD)
    out = {}
    for name, choices in space.items():
        at = [choices.index(t[0][name]) for t in ranked]
        better, other = _shares(at[:good], len(choices)), _shares(at[good:], len(choices))
        drawn = rng.choice(len(choices), CANDIDATES, p=better / better.sum())
        out[name] = choices[int(drawn[np.argmax(np.log(better[drawn]) - np.log(other[drawn]))])]
    return out


def _text(setting: dict) -> dict[str, str]:
    return {k: str(v) for k, v in setting.items()}


def _known(done: DataFrame | None, space: dict[str, list]) -> list[tuple[dict, float]]:
    back = {name: {str(v): v for v in choices} for name, choices in space.items()}
    rows = sorted(done.collect(), key=lambda r: r.trial) if done is not None else []
    return [({k: back[k][v] for k, v in r.params.items()}, r.score) for r in rows]


def tpe(spark: SparkSession, space: dict[str, list], score: Callable[[dict], float | None], trials: int = 20, done: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """TRIALS of a Parzen search; those in `done` are not scored again, and a setting met again keeps its score."""
    rows = _known(done, space)[:trials]
    known = {tuple(sorted(_text(s).items())): v for s, v in rows}
    while len(rows) < trials:
        setting = propose(space, rows, seed)
        name = tuple(sorted(_text(setting).items()))
        if name not in known:
            known[name] = score(setting)
        rows.append((setting, known[name]))
    return spark.createDataFrame([(i, _text(s), v) for i, (s, v) in enumerate(rows)], TRIALS)


def drawn(spark: SparkSession, space: dict[str, list], score: Callable[[dict], float | None], trials: int = 8, done: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """TRIALS of different settings in random order."""
    known = {tuple(sorted(_text(s).items())): v for s, v in _known(done, space)}
    rows = []
    for i, setting in enumerate(random_settings(space, trials, seed)):
        name = tuple(sorted(_text(setting).items()))
        rows.append((i, _text(setting), known[name] if name in known else score(setting)))
    return spark.createDataFrame(rows, TRIALS)
