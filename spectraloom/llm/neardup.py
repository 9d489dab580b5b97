"""Near-duplicate documents with an LSH forest of MinHash signatures.

1. Each text becomes the set of 64-bit hashes of its distinct word shingles. Equal sets are
   one class from here on (key: BLAKE2 of the sorted set), so groups of copies cost one row.
2. A class has TREES x DEPTH minima. Tree t orders the classes by its DEPTH minima read as one
   string. Rows are range-partitioned by (tree, string, sketch, id): a region that holds a large
   share of all rows is spread over partitions, since the id is part of the order.
3. In each order, a class's candidates are rows in front of it with a common prefix of at least MIN_DEPTH minima.
   Sorting makes the depth adaptive: in a dense region the rows next to each other agree far deeper than
   MIN_DEPTH, in a sparse one they agree just that far. A sketch of 128 one-bit minima and the set sizes drop
   candidates below the similarity asked for.
4. Candidates are confirmed on full sets, recomputed from the texts of the classes concerned. A first pass takes the NEIGHBOURS
   nearest rows: first the best candidate of each class, then those that still lie between two components.
   A second pass looks at all pairs of a region (same tree, same MIN_DEPTH minima) that lie in different components. A
   region's rows are dealt into blocks of about CELL, and two blocks that may hold such a pair make a cell: its largest component's
   blocks with those of all other rows, and the latter among themselves. So no region is too large for a task, and no pair
   depends on how rows are sorted or partitioned. A cell confirms the pairs its sketches let through, the closest first,
   and leaves out only what its confirmed links have joined already: it hands on links, not pairs.
   Confirmed links join the components, by alternating large-star and small-star steps on edge tables.

A pair at similarity 0.8 shares MIN_DEPTH = 3 minima in none of the 16 trees with probability
(1 - 0.8**3)**16 = 1e-5. All other pairs of different components are compared, in the first tree whose region they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import NO_ID, blocks, discard, hash_texts, map_arrow, materialize, mix, own_id, with_id

TREES, DEPTH, MIN_DEPTH, NEIGHBOURS = 16, 8, 3, 3
#: Rows of a block of a large region; rows of whole cells that a task takes up at a time.
CELL, WIDE = 512, 4096
#: Of 128 sketch bits, those that may differ. Half of 1 - J differ on average: 13 at J = 0.8, with deviation 3.4.
MAX_DIFFERENT = 32
_A = np.random.default_rng(5).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_Q = np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: `size` words in a row, or the whole sequence where it is shorter."""
    for part in blocks([(t or "").encode().lower() for t in texts], len):  # bytes.lower() changes A-Z only
        hashes, cuts = hash_texts(part)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            n, own = b - a, hashes[a:b]
            take = min(size, n)
            if not n:
                yield np.zeros(0, np.uint64)
                continue
            sums = np.full(n - take + 1, take, np.uint64)
            for j in range(take):
                sums = sums * _Q + own[j : n - take + 1 + j]
            yield np.unique(mix(sums))


def signature(values: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima, 32 bits each, of a non-empty set."""
    out = np.full(TREES * DEPTH, ~np.uint64(0))
    for at in range(0, len(values), 4096):
        out = np.minimum(out, mix(values[at : at + 4096, None] * _A[None, :]).min(0))
    return (out >> np.uint64(32)).astype(">u4")


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """A row each row of docs: doc_id, n (set size), key of the set, sig, and digest, an MD5 of the text that tells rows with one doc_id apart."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            out: dict[str, list] = {"doc_id": cols["doc_id"], "digest": cols["digest"], "n": [], "key": [], "sig": []}
            for values in shingle_sets(cols["text"], size):
                some = len(values) > 0
                out["n"].append(len(values))
                out["key"].append(_key(values) if some else None)
                out["sig"].append(signature(values).tobytes() if some else None)
            yield out

    return map_arrow(with_id(docs).withColumn("digest", F.md5("text")), ["doc_id", "text", "digest"], "doc_id long, digest string, n long, key binary, sig binary", rows)


def _key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _classes(signed: DataFrame) -> DataFrame:
    """Written (id, key, doc_id, n, sig): a row each different set, with an id of its own and the least doc_id that has it.

    A doc_id may repeat with other texts, so it can't name a class. The ids are unique numbers, fixed by the write.
    """
    found = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    return materialize(found.withColumn("id", F.monotonically_increasing_id()), "classes")


def _tree_rows(classes: DataFrame) -> DataFrame:
    """(tree, prefix, sketch, id, n, component) of every class in every tree."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            sig = np.frombuffer(b"".join(cols["sig"]), ">u4").reshape(-1, TREES * DEPTH)
            sketch = np.packbits((sig & 1).astype(np.uint8), axis=1)
            n, width = len(sig), 4 * DEPTH
            flat = sig.tobytes()
            yield {
                "tree": np.repeat(np.arange(TREES, dtype=np.int32), n),
                "prefix": [flat[(i * TREES + t) * width : (i * TREES + t + 1) * width] for t in range(TREES) for i in range(n)],
                "sketch": [s.tobytes() for s in sketch] * TREES,
                "id": cols["id"] * TREES,
                "n": cols["n"] * TREES,
                "component": cols["component"] * TREES,
            }

    return map_arrow(classes, ["id", "n", "component", "sig"], "tree int, prefix binary, sketch binary, id long, n long, component long", rows)


def candidates(classes: DataFrame, reach: int, percent: int = 80, min_depth: int = MIN_DEPTH) -> DataFrame:
    """(a, b, differ): pairs of class ids, a < b, of different components and at most `reach` rows apart in some tree's order.

    classes: id, n (set size), component, sig. A task holds `reach` rows and a batch at a time.
    """
    forest = _tree_rows(classes)
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    forest = forest.repartitionByRange(parts, "tree", "prefix", "sketch", "id").sortWithinPartitions("tree", "prefix", "sketch", "id")

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        tail = None
        for cols in batches:
            if not cols["id"]:
                continue
            prefix = np.frombuffer(b"".join(cols["prefix"]), ">u4").reshape(-1, DEPTH)[:, :min_depth]
            region = np.column_stack([np.array(cols["tree"], np.int64), prefix])
            sketch = np.frombuffer(b"".join(cols["sketch"]), np.uint64).reshape(-1, 2)
            now = (region, sketch, *(np.array(cols[c], np.int64) for c in ("id", "n", "component")), np.ones(len(region), bool))
            if tail:
                now = tuple(np.concatenate([t, x]) for t, x in zip(tail, now, strict=True))
            starts = np.flatnonzero(np.concatenate([[True], (now[0][1:] != now[0][:-1]).any(1)]))
            # what the next batch may still need: the last region's rows
            tail = tuple(x[max(starts[-1], len(x) - reach) :] for x in now[:-1])
            tail = (*tail, np.zeros(len(tail[0]), bool))
            lengths = np.diff(np.append(starts, len(now[0])))
            mixed = (np.minimum.reduceat(now[4], starts) < np.maximum.reduceat(now[4], starts)) & np.logical_or.reduceat(now[5], starts)
            at = np.flatnonzero(np.repeat(mixed, lengths))
            run = np.repeat(np.arange(len(starts)), lengths)[at]
            _, sketch, ids, n, component, new = (x[at] for x in now)
            found = []
            for lag in range(1, min(reach, len(ids) - 1) + 1):
                same = run[lag:] == run[:-lag]
                if not same.any():
                    break
                i = np.flatnonzero(same & new[lag:] & (component[lag:] != component[:-lag]))
                low, high = np.minimum(n[i], n[i + lag]), np.maximum(n[i], n[i + lag])
                i = i[100 * low >= percent * high]
                differ = np.bitwise_count(sketch[i] ^ sketch[i + lag]).sum(1, dtype=np.int64)
                i, differ = i[differ <= MAX_DIFFERENT], differ[differ <= MAX_DIFFERENT]
                j = i + lag
                found.append([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), differ])
            a, b, differ = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
            yield {"a": a, "b": b, "differ": differ}

    pairs = map_arrow(forest, forest.columns, "a long, b long, differ long", rows)
    return pairs.groupBy("a", "b").agg(F.min("differ").alias("differ"))


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Written (id, values): full shingle sets, as bytes, of the wanted rows of _classes; one row each."""
    # a merge join at every size: the ids grow with the input, so they are not to be broadcast
    texts = with_id(docs).join(wanted.select("id", "key", "doc_id").hint("merge"), "doc_id")

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            for at in range(0, len(cols["id"]), 256):
                values = list(shingle_sets(cols["text"][at : at + 256], size))
                own = [i for i, (v, key) in enumerate(zip(values, cols["key"][at : at + 256], strict=True)) if _key(v) == key]  # a doc_id may repeat with other texts
                yield {"id": [cols["id"][at + i] for i in own], "values": [values[i].tobytes() for i in own]}

    return materialize(map_arrow(texts, ["id", "key", "text"], "id long, values binary", rows).dropDuplicates(["id"]), "sets")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets have 100 * |a & b| >= percent * |a | b|."""
    left = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("values").alias("va")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("values").alias("vb")), "b")

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            keep = []
            for i, (x, y) in enumerate(zip(cols["va"], cols["vb"], strict=True)):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    continue
                common = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * common >= percent * (len(p) + len(q) - common):
                    keep.append(i)
            yield {"a": [cols["a"][i] for i in keep], "b": [cols["b"][i] for i in keep]}

    return map_arrow(both, ["a", "b", "va", "vb"], "a long, b long", rows)


def _local_stars(edges: DataFrame) -> DataFrame:
    """Replace each partition's edges by stars around the least id of each part: same components, fewer and shorter paths."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.get(top, top) != top:
                top = parent[top]
            while parent.get(x, x) != top:
                parent[x], x = top, parent[x]
            return top

        def flush() -> dict:
            nodes = [x for x in parent if root(x) != x]
            out = {"a": [root(x) for x in nodes], "b": nodes}
            parent.clear()
            return out

        for cols in batches:
            for a, b in zip(cols["a"], cols["b"], strict=True):
                p, q = sorted((root(a), root(b)))
                parent.setdefault(p, p)
                parent[q] = p
            if len(parent) > 500_000:  # memory stays bounded, whatever the partition's size
                yield flush()
        yield flush()

    return map_arrow(edges, ["a", "b"], "a long, b long", rows)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for every id on an edge (a, b), the least id it is connected with.

    Large-star and small-star steps (Kiveris et al., 2014) until the edges are stars. A step
    aggregates the least neighbour of each node and joins it back, so a hub with a large
    share of the edges is pre-aggregated, and the join can be split by AQE.
    """
    edges = materialize(_local_stars(edges).distinct(), "edges")
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m")), "least")
        # large star: every larger neighbour v of u moves to u's least neighbour
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").where("a < b")
        large = materialize(_local_stars(large).distinct(), "edges")
        discard(edges, least)
        # small star: u and its smaller neighbours meet in the least of them
        low = materialize(large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m")), "least")
        small = large.join(low, F.col("b") == F.col("u")).select(F.explode(F.array(F.struct("m", F.col("a").alias("v")), F.struct("m", F.col("u").alias("v")))).alias("e"))
        edges = materialize(small.select(F.col("e.m").alias("a"), F.col("e.v").alias("b")).where("a < b").distinct(), "edges")
        discard(large, low)
        # stars: no centre is another star's leaf, and no leaf has two centres
        ends = edges.select(F.col("b").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionAll(edges.select(F.col("a"), F.lit(0), F.lit(1)))
        bad = ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf > 1 or leaf > 0 and centre > 0")
        if bad.isEmpty():
            break
    centres = edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionAll(centres)


def _named(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs with the component of either end (an id without links is its own)."""
    for end in ("a", "b"):
        pairs = pairs.join(comps.select(F.col("id").alias(end), F.col("component").alias(f"c{end}")), end, "left")
    return pairs.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Written components after more written links."""
    if links.isEmpty():
        return comps
    joined = _named(links, comps).select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
    out = materialize(components(joined.unionAll(comps.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b")))), "components")
    discard(comps)
    return out


def _placed(classes: DataFrame) -> DataFrame:
    """(id, n, component, sketch, regions) of classes; regions: a 64-bit hash of each tree's number and first MIN_DEPTH minima."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            sig = np.frombuffer(b"".join(cols["sig"]), ">u4").reshape(-1, TREES, DEPTH)
            keys = np.broadcast_to(mix(np.arange(TREES, dtype=np.uint64)), sig.shape[:2])
            for k in range(MIN_DEPTH):
                keys = mix(keys * _Q + sig[:, :, k].astype(np.uint64))
            sketch = np.packbits((sig & 1).astype(np.uint8).reshape(-1, TREES * DEPTH), axis=1)
            yield {"id": cols["id"], "n": cols["n"], "component": cols["component"], "sketch": [s.tobytes() for s in sketch], "regions": keys.view(np.int64).tolist()}

    return map_arrow(classes, ["id", "n", "component", "sig"], "id long, n long, component long, sketch binary, regions array<long>", rows)


def _dealt(placed: DataFrame) -> DataFrame:
    """(cell, every, side, tree, id): the cells in which written rows of _placed meet those of other components.

    every: all pairs of the cell count, else those of different sides.
    """
    members = placed.select("id", "component", F.posexplode("regions").alias("tree", "region"))
    mixed = members.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("region")
    members = materialize(members.join(mixed.hint("merge"), "region", "left_semi"), "members")
    sizes = members.groupBy("region", "component").agg(F.count("*").alias("c"))
    sizes = sizes.groupBy("region").agg(F.max(F.struct("c", "component")).alias("main"), F.sum("c").alias("c"))
    blocks_of = lambda c: F.ceil(c / F.lit(CELL)).cast("int")
    sizes = sizes.select("region", F.col("main.component").alias("main"), blocks_of(F.col("main.c")).alias("mains"), blocks_of(F.col("c") - F.col("main.c")).alias("others"))
    own = F.col("component") == F.col("main")
    rows = members.join(sizes.hint("merge"), "region").withColumn("block", F.pmod(F.xxhash64("id"), F.when(own, F.col("mains")).otherwise(F.col("others"))).cast("int"))
    block, upto = F.col("block"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, i, j, every, side: F.struct(F.xxhash64("region", F.lit(kind), i, j).alias("cell"), every.alias("every"), side.alias("side"))
    no, yes = F.lit(False), F.lit(True)
    cells = (
        F.when((F.col("mains") == 1) & (F.col("others") == 1), F.array(cell(0, block, block, yes, no)))
        .when(own, F.transform(upto("others"), lambda j: cell(1, block, j, no, no)))
        .otherwise(F.concat(F.transform(upto("mains"), lambda i: cell(1, i, block, no, yes)), F.transform(upto("others"), lambda j: cell(2, F.least(block, j), F.greatest(block, j), block == j, block > j))))
    )
    return rows.select("tree", "id", F.explode(cells).alias("c")).select("c.*", "tree", "id")


def _by_cell(batches: Iterator[dict]) -> Iterator[dict]:
    """Columns of rows sorted by cell, whole cells at a time."""
    held: dict[str, list] = {}
    for cols in batches:
        held = {c: held.get(c, []) + cols[c] for c in cols}
        cells = held["cell"]
        if len(cells) >= WIDE and (cut := cells.index(cells[-1])):
            yield {c: held[c][:cut] for c in held}
            held = {c: held[c][cut:] for c in held}
    if held and held["cell"]:
        yield held


def _pairs(cols: dict, percent: int) -> np.ndarray:
    """(i, j, differ): pairs of places in a cell that lie in different components, may be similar, and share no region of an earlier tree."""
    cell, every, side, tree, n, component = (np.array(cols[c], np.int64) for c in ("cell", "every", "side", "tree", "n", "component"))
    regions = np.array(cols["regions"], np.int64)
    sketch = np.frombuffer(b"".join(cols["sketch"]), np.uint64).reshape(-1, 2)
    found = []
    for lag in range(1, len(cell)):
        i = np.flatnonzero(cell[lag:] == cell[:-lag])
        if not len(i):
            break
        i = i[(component[i] != component[i + lag]) & ((every[i] > 0) | (side[i] != side[i + lag]))]
        i = i[100 * np.minimum(n[i], n[i + lag]) >= percent * np.maximum(n[i], n[i + lag])]
        differ = np.bitwise_count(sketch[i] ^ sketch[i + lag]).sum(1, dtype=np.int64)
        i, differ = i[differ <= MAX_DIFFERENT], differ[differ <= MAX_DIFFERENT]
        first = ~((regions[i] == regions[i + lag]) & (np.arange(TREES) < tree[i, None])).any(1)
        found.append([i[first], i[first] + lag, differ[first]])
    return np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)


def meetings(placed: DataFrame, percent: int = 80) -> DataFrame:
    """(cell, every, side, tree, id, n, component, sketch, regions): rows of written _placed with a partner in a cell to be confirmed on full sets."""
    rows_of = _dealt(placed).join(placed.hint("merge"), "id").repartition("cell").sortWithinPartitions("cell")
    columns = ["cell", "every", "side", "tree", "id", "n", "component", "sketch", "regions"]

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in _by_cell(batches):
            some = np.unique(_pairs(cols, percent)[:2]).tolist()
            yield {c: [cols[c][k] for k in some] for c in columns}

    return map_arrow(rows_of, columns, "cell long, every boolean, side boolean, tree int, id long, n long, component long, sketch binary, regions array<long>", rows)


def _named_by(classes: DataFrame, ids: DataFrame) -> DataFrame:
    """The classes whose id is among ids, which may repeat."""
    return classes.join(ids.distinct().hint("merge"), "id", "left_semi")


def _met(docs: DataFrame, classes: DataFrame, placed: DataFrame, size: int, percent: int) -> DataFrame:
    """Written (a, b): links that join all components of written _placed that have a link in some region."""
    met = materialize(meetings(placed, percent), "cells")
    sets = _sets(docs, _named_by(classes, met.select("id")), size)
    both = met.join(sets.hint("merge"), "id").repartition("cell").sortWithinPartitions("cell")

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for cols in _by_cell(batches):
            if len(parent) > 500_000:  # memory stays bounded, whatever the partition's size
                parent.clear()
            found = _pairs(cols, percent)
            values = [np.frombuffer(v, np.uint64) for v in cols["values"]]
            a, b = [], []
            for i, j in found[:2, np.argsort(found[2], kind="stable")].T.tolist():
                x, y = root(cols["component"][i]), root(cols["component"][j])
                if x == y:
                    continue
                p, q = values[i], values[j]
                common = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * common >= percent * (len(p) + len(q) - common):
                    parent[max(x, y)] = min(x, y)
                    a.append(cols["id"][i])
                    b.append(cols["id"][j])
            yield {"a": a, "b": b}

    links = materialize(map_arrow(both, [*met.columns, "values"], "a long, b long", rows), "links")
    discard(met, sets)
    return links


def _grouped(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Written _signed rows of docs, and (key, component): the least doc_id linked with each class."""
    signed = materialize(_signed(docs, size), "signed")
    classes = _classes(signed)
    pairs = materialize(candidates(classes.withColumn("component", F.col("id")), NEIGHBOURS, percent), "pairs")
    sets = _sets(docs, _named_by(classes, pairs.select(F.explode(F.array("a", "b")).alias("id"))), size)
    best = pairs.groupBy("b").agg(F.min(F.struct("differ", "a"))["a"].alias("a")).select("a", "b")
    links = materialize(_confirm(best, sets, percent), "links")
    comps = materialize(components(links), "components")
    rest = materialize(_confirm(_named(pairs.join(best, ["a", "b"], "left_anti"), comps).where("ca <> cb"), sets, percent), "links")
    discard(pairs, sets, links)
    comps = _joined(comps, rest)
    placed = classes.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = materialize(_placed(placed), "placed")
    met = _met(docs, classes, placed, size, percent)
    discard(rest, placed)
    comps = _joined(comps, met)
    # components are named by class ids so far; their name is the least doc_id of a member
    named = materialize(comps.join(classes.select("id", "doc_id").hint("merge"), "id"), "named")
    least = materialize(named.groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    least_of = named.join(least, "component").select("id", "least")
    groups = materialize(classes.select("key", "id", "doc_id").join(least_of, "id", "left").select("key", F.coalesce("least", "doc_id").alias("component")), "groups")
    discard(met, comps, named, least, classes)
    return signed, groups


def link(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id and kept.

    Null and empty texts have no shingles and are linked with nothing. A text of any length is one set of all its shingles.
    Rows with equal sets are linked; a row that repeats a doc_id with another text is linked by its own text alone.
    Rows with a null doc_id take part with the largest id and show null as their own.
    """
    signed, groups = _grouped(docs, size, percent)
    out = signed.select("doc_id", "n", "key").join(groups, "key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select(own_id(), F.col("n").alias("n_shingles"), F.nullif(component, F.lit(NO_ID)).alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs, columns unchanged, one for each near-duplicate group.

    The row with the least doc_id stays, of several texts under it the one with the least MD5, of rows equal in both any one.
    Rows without shingles and rows with a null doc_id stay.
    """
    signed, groups = _grouped(docs.where("doc_id is not null"), size, percent)
    grouped = materialize(signed.where("key is not null").select("doc_id", "digest", "key").join(groups, "key").select("doc_id", "digest", "component"), "grouped")
    stay = materialize(grouped.where("doc_id = component").groupBy("component").agg(F.min("digest").alias("digest"), F.count("*").alias("rows")), "stay")
    gone = grouped.join(stay.select("component", F.col("digest").alias("best")), "component").where("doc_id <> component or digest <> best")
    names = [f"__{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col("doc_id").alias("__id"), F.md5("text").alias("__md5"))
    left = lambda marks: marks.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__md5")).distinct().hint("merge")
    kept = rows.join(left(gone), ["__id", "__md5"], "left_anti")
    twice = stay.where("rows > 1").select(F.col("component").alias("doc_id"), "digest")
    if not twice.isEmpty():  # equal rows of one doc_id, which only repeated rows bring about
        once = kept.join(left(twice), ["__id", "__md5"], "left_semi").dropDuplicates(["__id", "__md5"])
        kept = kept.join(left(twice), ["__id", "__md5"], "left_anti").unionByName(once)
    return kept.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
