"""Hierarchical clustering: single linkage exactly at any number of rows, the other linkages on prototypes.

Single linkage is the minimum spanning tree. Rows are dealt into blocks; every pair of blocks meets in one
cell, which hands on the minimum spanning forest of its own edges alone (an edge that is none of a cell's
forest is in no spanning tree that needs it), so n rows give about n edges a block instead of n a row. Borůvka's rounds
then join components over those edges. Cut at a distance it needs no tree: components of rows that near to each other are joined.

Ward, average and complete linkage work on at most PROTOTYPES weighted points: the rows themselves if there
are no more, else k-means centres with the number of their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.operators import catalogue, pairs
from spectraloom.sources.shared import dropped, written

#: Rows of a block; a cell compares two of them. Cells that make a tree, row by row, have smaller ones.
BLOCK, TREE_BLOCK = 32768, 1024
#: Points that Lance and Williams' recurrence is run on.
PROTOTYPES = 500
#: Rows up to which a linkage table (a sequential reading of n - 1 edges) is made.
LINKAGE_ROWS = 1_000_000
#: Pointer steps between two looks at whether all have ended.
JUMPS = 2

EDGES = "a long, b long, distance double"


def _dealt(df: DataFrame, key: str, values: str) -> DataFrame:
    """(block, ids, points): the rows of a block, dealt by a hash of the key; points are laid end to end."""
    rows = df.where(F.col(key).isNotNull() & F.col(values).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(values, lambda x: x.cast("double")).alias("x"))
    n = max(1, -(-rows.count() // min(BLOCK, TREE_BLOCK)))
    held = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block")).agg(F.sort_array(F.collect_list(F.struct("id", "x"))).alias("rows"))
    return held.select("block", F.col("rows.id").alias("ids"), F.flatten("rows.x").alias("points"))


def _forest(one: np.ndarray, other: np.ndarray | None) -> Iterator[tuple[int, int, float]]:
    """Prim's algorithm within one block's points, or on the edges between two blocks' (numbered one after another)."""
    x = one if other is None else np.vstack([one, other])
    cut, n = len(one), len(x)
    near, least = np.full(n, -1), np.full(n, np.inf)
    open_ = np.ones(n, bool)
    at = 0
    while True:
        open_[at] = False
        reach = open_.copy()
        if other is not None:  # edges lead to the other block only
            reach[slice(0, cut) if at < cut else slice(cut, n)] = False
        to = np.flatnonzero(reach)
        d = np.sqrt(((x[to] - x[at]) ** 2).sum(1))
        closer = d < least[to]
        near[to[closer]], least[to[closer]] = at, d[closer]
        if not open_.any():
            return
        at = int(np.where(open_, least, np.inf).argmin())
        if not np.isfinite(least[at]):
            return
        yield near[at], at, float(least[at])


def cells(df: DataFrame, key: str, values: str, f: Callable) -> DataFrame:
    """EDGES that f finds in each block of rows and in each pair of blocks: f(ids, points, ids and points of the other block or None) -> (a, b, distance)."""
    blocks = written(_dealt(df, key, values), "blocks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, points, more, others in zip(*(batch[c] for c in ("ids", "points", "more", "others")), strict=True):
                found = f(ids, points.reshape(len(ids), -1), more, others.reshape(len(more), -1) if more is not None else None)
                if found:
                    a, b, d = (np.array(c) for c in zip(*found, strict=True))
                    yield pd.DataFrame({"a": a, "b": b, "distance": d})

    own = blocks.select("ids", "points", F.lit(None).cast("array<long>").alias("more"), F.lit(None).cast("array<double>").alias("others"))
    right = blocks.select(F.col("block").alias("with"), F.col("ids").alias("more"), F.col("points").alias("others"))
    numbers = blocks.select("block")
    pairs = numbers.join(F.broadcast(numbers.withColumnRenamed("block", "with")), F.col("block") < F.col("with"))  # n / BLOCK numbers
    both = pairs.repartition("block", "with").join(blocks, "block").join(right, "with").select("ids", "points", "more", "others")
    out = written(own.unionAll(both).mapInPandas(run, EDGES), "edges")
    dropped(blocks)
    return out


def candidate_edges(df: DataFrame, key: str, values: str) -> DataFrame:
    """EDGES that hold a minimum spanning tree of the rows' Euclidean distances; keys must be distinct."""

    def spanning(ids, points, more, others):
        names = ids if more is None else np.concatenate([ids, more])
        return [(min(names[a], names[b]), max(names[a], names[b]), d) for a, b, d in _forest(points, others)]

    return cells(df, key, values, spanning)


def forest(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Borůvka: the minimum spanning forest of `edges` (a, b, distance) and (id, component) of `nodes` (id); a component is named by its smallest id.

    In each round every component takes its least edge, in the order (distance, a, b), which leaves no cycles but two
    components that chose the same edge; pointers to the chosen neighbours are followed to their ends.
    """
    part, left, picks = written(nodes.select("id", F.col("id").alias("component")), "component"), edges.where("a <> b"), []
    while True:
        named = left.join(part.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(part.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
        across = written(named.where("ca <> cb"), "across")
        if picks:
            dropped(before)
        ends = F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("to")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("to"))))
        picked = written(across.select("a", "b", "distance", ends.alias("e")).groupBy("e.c").agg(F.min(F.struct("distance", "a", "b", "e.to")).alias("best")).select("c", "best.*"), "picked")
        if picked.isEmpty():
            dropped(picked, across)
            break
        picks.append(picked)
        back = picked.select(F.col("c").alias("to"), F.col("to").alias("back"))
        root = F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to"))
        up, ended, spent = picked.select("c", "to").join(back, "to").select("c", root.alias("up")), False, None
        while not ended:  # each step doubles how far a pointer reaches
            for _ in range(JUMPS):
                up = up.join(up.select(F.col("c").alias("up"), F.col("up").alias("next")), "up").select("c", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved"))
            up = written(up, "up")
            if spent is not None:
                dropped(spent)
            ended, spent = up.where("moved").isEmpty(), up
            up = up.drop("moved")
        fresh = written(part.join(up.select(F.col("c").alias("component"), "up"), "component", "left").select("id", F.coalesce("up", "component").alias("component")), "component")
        dropped(part, spent)
        part, left, before = fresh, across.select("a", "b", "distance"), across
    least = part.groupBy("component").agg(F.min("id").alias("least"))
    tree = nodes.sparkSession.createDataFrame([], EDGES)
    for picked in picks:
        tree = tree.unionAll(picked.select("a", "b", "distance").distinct())
    tree = written(tree, "tree")
    dropped(*picks)
    return tree, part.join(least, "component").select("id", F.col("least").alias("component"))


def spanning_tree(df: DataFrame, key: str, values: str) -> DataFrame:
    """The edges (a, b, distance) of a minimum spanning tree: single linkage's merges are its edges by rising distance.

    Rows without a key or values are left out, keys must be distinct; equal distances go by the smaller keys; one row or none gives no edge.
    """
    nodes = df.where(F.col(key).isNotNull() & F.col(values).isNotNull()).select(F.col(key).cast("long").alias("id"))
    return forest(nodes, candidate_edges(df, key, values))[0]


def _joined(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (the least place of each component) after joining places a to places b."""
    while True:
        a, b = roots[a], roots[b]
        apart = a != b
        if not apart.any():
            return roots
        a, b = a[apart], b[apart]
        roots = roots.copy()
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while (roots[roots] != roots).any():
            roots = roots[roots]


def _within(x: np.ndarray, y: np.ndarray | None, roots: np.ndarray, distance: float) -> np.ndarray:
    """Roots after joining rows of x (to each other, or to those of y, which are numbered after them) at most `distance` apart.

    Pairs of a row and of a column that are both of the commonest component are left out, since they join nothing.
    """
    same = y is None
    y, shift = (x, 0) if same else (y, len(x))
    low, high = pairs.Bounds(x, y), pairs.Bounds(x, y, high=True)
    fine = None
    for i in range(0, len(x), pairs.TILE):
        rows = np.arange(i, min(i + pairs.TILE, len(x)))
        columns = np.arange(i if same else 0, len(y))
        common = np.bincount(roots[columns + shift]).argmax()
        inside, other = roots[rows] == common, roots[columns + shift] != common
        for own, to in ((rows[~inside], columns), (rows[inside], columns[other])):
            for j in range(0, len(to) if len(own) else 0, pairs.WIDE):
                at = to[j : j + pairs.WIDE]
                k = np.flatnonzero(low.tile(own, at) <= low.limit(distance, up=True))
                if not len(k):
                    continue
                a, b = own[k // len(at)], at[k % len(at)]
                new = roots[a] != roots[b + shift]
                a, b = a[new], b[new]
                sure = np.einsum("ij,ij->i", high.a[a], high.b[b]) <= high.limit(distance, up=False)
                roots = _joined(roots, a[sure], b[sure] + shift)
                a, b = a[~sure], b[~sure]
                open_ = roots[a] != roots[b + shift]
                a, b = a[open_], b[open_]
                if len(a) > pairs.TILE:  # what single precision can't settle, double may
                    fine = fine or pairs.Bounds(x, y, kind=np.float64)
                    near = np.einsum("ij,ij->i", fine.a[a], fine.b[b]) <= fine.limit(distance, up=True)
                    a, b = a[near], b[near]
                near = pairs.of_pairs(x, y, a, b) <= distance
                roots = _joined(roots, a[near], b[near] + shift)
    return roots


def single_linkage(df: DataFrame, key: str, values: str, distance: float) -> DataFrame:
    """(key, cluster): single linkage cut at a distance, that is, rows joined by steps of at most `distance`; a cluster is named by its smallest key.

    Rows are joined within their blocks first; a cell of two blocks then hands on the joins of their components, and Borůvka's rounds join those.
    Rows with a value that is not finite are clusters of their own.
    """
    there = df.where(F.col(key).isNotNull() & F.col(values).isNotNull())
    rows = there.where(pairs.finite(values)).select(F.lit(0).alias("part"), F.col(key).cast("long").alias("id"), F.transform(values, lambda x: x.cast("double")).alias("x"))
    blocks = pairs.blocks(rows, BLOCK, extra=("root int", lambda x: _within(x, None, np.arange(len(x)), distance).astype(np.int32)))

    def cell(part: int, one: tuple, other: tuple, same: bool) -> Iterator[list]:
        (ids, x, own), (more, y, theirs) = one, other
        names, before = np.concatenate([ids, more]), np.concatenate([own.to_numpy(), theirs.to_numpy() + len(ids)]).astype(np.int64)
        after = _within(x, y, before, distance)
        found = np.flatnonzero((before == np.arange(len(before))) & (after != before))  # roots that got another one
        if len(found):
            ends = np.sort(np.stack([names[after[found]], names[found]]), axis=0)
            yield [ends[0], ends[1], np.zeros(len(found))]

    links = written(pairs.cells(blocks, blocks, lambda a, b: a < b, cell, EDGES, ("root",)), "links")
    held = written(blocks.select(F.explode(F.arrays_zip("ids", F.transform("root", lambda r: F.get("ids", r)).alias("root"))).alias("e")).select(F.col("e.ids").alias("id"), F.col("e.root").alias("root")), "roots")
    dropped(blocks)
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    named = forest(ends, links)[1].withColumnRenamed("id", "root")
    dropped(links)
    out = held.join(named, "root", "left").select(F.col("id").alias(key), F.coalesce("component", "root").alias("cluster"))
    alone = there.where(~pairs.finite(values)).select(F.col(key).cast("long").alias(key), F.col(key).cast("long").alias("cluster"))
    return out.unionAll(alone)


class _Sets:
    """Union by the number of the last merge."""

    def __init__(self, n: int):
        self.parent, self.size, self.name = list(range(n)), [1] * n, list(range(n))
        self.next = n

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def merge(self, i: int, j: int) -> tuple[int, int, int]:
        i, j = self.find(i), self.find(j)
        names = sorted((self.name[i], self.name[j]))
        self.parent[j] = i
        self.size[i] += self.size[j]
        self.name[i], self.next = self.next, self.next + 1
        return *names, self.size[i]


TABLE = "step int, one int, other int, height double, size long"


def linkage_of_tree(df: DataFrame, key: str, tree: DataFrame) -> DataFrame:
    """TABLE of single linkage: leaves are numbered by rising key from 0, the cluster of step s is n + s. Refused above LINKAGE_ROWS rows."""
    keys = sorted(r[0] for r in df.where(F.col(key).isNotNull()).select(F.col(key).cast("long")).limit(LINKAGE_ROWS + 1).collect())
    if len(keys) > LINKAGE_ROWS:
        raise ValueError(f"a linkage table is made up to {LINKAGE_ROWS} rows; cut the tree instead")
    at = {k: i for i, k in enumerate(keys)}
    sets, rows = _Sets(len(keys)), []
    for step, e in enumerate(sorted(tree.collect(), key=lambda e: (e.distance, e.a, e.b))):
        one, other, size = sets.merge(at[e.a], at[e.b])
        rows.append((step, one, other, e.distance, size))
    return df.sparkSession.createDataFrame(rows, TABLE)


def lance_williams(points: np.ndarray, weights: np.ndarray, method: str) -> list[tuple[int, int, float, int]]:
    """Merges (one, other, height, weight) by rising height, by chains of nearest neighbours (Murtagh, 1983); ids as in a linkage table.

    A point of weight w stands for w equal rows. Ward's height is sqrt(2 a b / (a + b)) times the distance of the means.
    """
    n = len(points)
    d = np.sqrt(np.maximum(((points[:, None] - points[None]) ** 2).sum(2), 0)) if n < 64 else np.array([np.sqrt(((points - p) ** 2).sum(1)) for p in points])
    w = weights.astype(float).copy()
    if method == "ward":
        d = d * np.sqrt(2 * w[:, None] * w / (w[:, None] + w))
    np.fill_diagonal(d, np.inf)
    alive, merges, chain = np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            i = chain[-1]
            j = int(d[i].argmin())
            if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
                j = chain[-2]
                break
            chain.append(j)
        del chain[-2:]
        merges.append((min(i, j), max(i, j), float(d[i, j])))
        k = alive.copy()
        k[[i, j]] = False
        a, b, c, dij = w[i], w[j], w[k], d[i, j]
        x, y = d[i, k], d[j, k]
        new = {
            "ward": lambda: np.sqrt(np.maximum(((a + c) * x**2 + (b + c) * y**2 - c * dij**2) / (a + b + c), 0)),  # noqa: B023
            "average": lambda: (a * x + b * y) / (a + b),  # noqa: B023
            "complete": lambda: np.maximum(x, y),  # noqa: B023
            "single": lambda: np.minimum(x, y),  # noqa: B023
        }[method]()
        d[j, k] = d[k, j] = new
        d[i, :] = d[:, i] = np.inf
        alive[i] = False
        w[j] += w[i]
    sets, out = _Sets(n), []
    weight = {i: int(v) for i, v in enumerate(weights)}
    for i, j, height in sorted(merges, key=lambda m: m[2]):
        one, other, _ = sets.merge(i, j)
        weight[sets.next - 1] = weight[one] + weight[other]
        out.append((one, other, height, weight[sets.next - 1]))
    return out


def hierarchy(df: DataFrame, key: str, values: str, method: str = "ward", prototypes: int = PROTOTYPES) -> tuple[DataFrame, DataFrame]:
    """TABLE of a linkage over prototypes, and (key, prototype).

    With at most `prototypes` rows each row is one, numbered by rising key, and the result is the exact linkage; else the prototypes are
    k-means centres, numbered as k-means does, with the number of their rows as weights. Rows without a key or values are left out.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(values).isNotNull()).select(key, values)
    few = rows.limit(prototypes + 1).collect()
    if len(few) <= prototypes:
        few.sort(key=lambda r: r[0])
        points, weights = np.array([r[1] for r in few], float), np.ones(len(few), int)
        members = df.sparkSession.createDataFrame([(r[0], i) for i, r in enumerate(few)], f"{key} {df.schema[key].dataType.simpleString()}, prototype int")
    else:
        model = catalogue.kmeans(rows, values, prototypes)
        members = catalogue.nearest(model, rows, values).select(key, F.col("cluster").alias("prototype"))
        found = {r[0]: r[1] for r in members.groupBy("prototype").count().collect()}
        points, weights = np.array(model.clusterCenters()), np.array([found.get(i, 0) for i in range(len(model.clusterCenters()))])
        points, weights = points, np.maximum(weights, 1)
    table = [(s, *m) for s, m in enumerate(lance_williams(points, weights, method))] if len(points) else []
    return df.sparkSession.createDataFrame(table, TABLE), members


def cut(table: DataFrame, clusters: int) -> DataFrame:
    """(prototype, cluster): the linkage undone until `clusters` are left; clusters are numbered from 1 by their first prototype."""
    merges = sorted(table.collect())
    n = len(merges) + 1
    sets, held = _Sets(n), {i: i for i in range(n)}
    for m in merges[: max(0, n - clusters)]:
        i, j = held[m.one], held[m.other]
        sets.merge(i, j)
        held[n + m.step] = i
    names: dict[int, int] = {}
    return table.sparkSession.createDataFrame([(i, names.setdefault(sets.find(i), len(names) + 1)) for i in range(n)], "prototype int, cluster int")


def clusters(df: DataFrame, key: str, values: str, k: int, method: str = "ward", prototypes: int = PROTOTYPES) -> DataFrame:
    """(key, cluster): k clusters of a linkage; see hierarchy()."""
    table, members = hierarchy(df, key, values, method, prototypes)
    return members.join(F.broadcast(cut(table, k)), "prototype").select(key, "cluster")  # at most `prototypes` rows


def profile(assigned: DataFrame, label: str) -> DataFrame:
    """(cluster, label, n, share): how the classes fall into the clusters."""
    n = F.sum("n").over(Window.partitionBy("cluster"))
    return assigned.groupBy("cluster", label).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / n)
