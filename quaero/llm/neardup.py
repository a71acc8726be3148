"""All pairs of vectors with a cosine of at least a threshold, by cover trees and dual traversal.

Unit vectors with cosine c lie sqrt(2 - 2c) apart, so the threshold is a radius.  The upper levels of
the tree are tables: a node with more vectors than a task should hold deals them to the nearest of
some of its own, and each child has a centre and a covering radius of its own.  Pairs of nodes are
opened level by level, and a pair farther apart than both radii and the link radius is dropped with
all that lies below.  Within a leaf, nested nets of halving radii make the rest of the cover tree.
Two leaves that are still a pair meet in a task, which walks both trees at once by the same rule and
compares points in double precision.  Pairs of vectors never become rows: tasks emit link counts and
one edge per vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quaero.llm.joins import first_of, join_counted, link_report, map_groups
from quaero.sources.workdir import run_dir, staged


@dataclass(frozen=True)
class NearParams:
    threshold: float = 0.9
    cell: int = 8192         # vectors in a leaf, about
    fan: int = 64            # children of a node, at most
    depth: int = 8           # levels of splitting; what is still larger then is cut by a hash
    levels: int = 4          # nets of the link radius, half of it, ...
    tile: int = 1024         # nodes on a side that are compared at once

    @property
    def reach(self) -> float:
        """The distance of unit vectors with a cosine of ``threshold``."""
        return float(np.sqrt(2 - 2 * self.threshold))


def scaled(values: list | None) -> np.ndarray | None:
    """The vector times a power of two that brings its largest component near 1, which is exact;
    nothing for null, zero, empty or non-finite ones."""
    if not values or None in values:
        return None
    x = np.array(values, np.float64)
    big = np.abs(x).max()
    if not np.isfinite(big) or big == 0:
        return None
    return np.ldexp(x, -int(np.frexp(big)[1]))


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, the same whichever side a vector is on."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def _net(x: np.ndarray, radius: float) -> np.ndarray:
    """For each point its leader: leaders lie farther apart than ``radius``, points within it of theirs."""
    far = 1 - radius * radius / 2
    own = np.full(len(x), -1)
    leaders = np.empty(0, np.int64)
    for lo in range(0, len(x), 512):
        at = np.arange(lo, min(lo + 512, len(x)))
        if len(leaders):
            near = x[at] @ x[leaders].T
            best = near.argmax(axis=1)
            inside = near[np.arange(len(at)), best] >= far
            own[at[inside]] = leaders[best[inside]]
            at = at[~inside]
        among = x[at] @ x[at].T >= far
        open_ = np.ones(len(at), bool)
        new = []
        for i in range(len(at)):
            if open_[i]:
                taken = among[i] & open_
                taken[i] = True
                own[at[taken]] = at[i]
                open_ &= ~taken
                new.append(at[i])
        leaders = np.concatenate((leaders, np.array(new, np.int64)))
    return own


def nets(x: np.ndarray, p: NearParams) -> np.ndarray:
    """``levels`` rows: for each point its leader in the nested nets, coarse to fine."""
    out = np.empty((p.levels, len(x)), np.int64)
    above = np.zeros(len(x), np.int64)
    for level in range(p.levels):
        order = np.argsort(above, kind="stable")
        bounds = np.flatnonzero(np.diff(above[order], prepend=-1, append=len(x)))
        own = np.arange(len(x))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo > 1:
                members = order[lo:hi]
                own[members] = members[_net(x[members], p.reach / 2**level)]
        out[level] = above = own
    return out


class Tree:
    """A cover tree from the nets: on each level the leaders, covering radii and children."""

    def __init__(self, vectors: np.ndarray, leaders: np.ndarray):
        self.vectors = vectors
        self.x = x = units(vectors)
        levels = [np.zeros(len(x), np.int64), *leaders, np.arange(len(x))]
        self.nodes, self.radius, self.children = [], [], []
        for own, below in zip(levels, [*levels[1:], None]):
            nodes, node_of = np.unique(own, return_inverse=True)
            gap = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x, x[own])))
            radius = np.zeros(len(nodes))
            np.maximum.at(radius, node_of, gap)
            self.nodes.append(nodes)
            self.radius.append(radius)
            if below is not None:
                kids = np.unique(below)
                parent = node_of[kids]  # a leader lies in the node that it came from
                order = np.argsort(parent, kind="stable")
                place = np.searchsorted(parent[order], np.arange(len(nodes) + 1))
                self.children.append((order, place))

    def kids(self, level: int, node: int) -> np.ndarray:
        order, place = self.children[level]
        return order[place[node]:place[node + 1]]


def _product(a: Tree, b: Tree, level: int, s: np.ndarray, t: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a child of ``s`` and a child of ``t``, in parts of about ``size``."""
    (order_a, place_a), (order_b, place_b) = a.children[level], b.children[level]
    n_a, n_b = np.diff(place_a)[s], np.diff(place_b)[t]
    starts = np.flatnonzero(np.diff((np.cumsum(n_a * n_b) - 1) // size, prepend=-1))
    for lo, hi in zip(starts, np.append(starts[1:], len(s))):
        each = (n_a * n_b)[lo:hi]
        of = np.repeat(np.arange(lo, hi), each)
        nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        yield order_a[place_a[s[of]] + nth // n_b[of]], order_b[place_b[t[of]] + nth % n_b[of]]


def dual(a: Tree, b: Tree, p: NearParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All links, as (points of a, points of b), once each, in parts of bounded size."""
    reach = p.reach
    last = len(a.nodes) - 1

    def open_(level, i, j, near):
        """Links among compared nodes, or below the pairs that may hold some."""
        if level == last:
            at, to = a.nodes[level][i], b.nodes[level][j]
            hit = near >= p.threshold
            edge = np.flatnonzero(np.abs(near - p.threshold) < 1e-9)  # where rounding could decide
            hit[edge] = cosine(a.vectors[at[edge]], b.vectors[to[edge]]) >= p.threshold
            if hit.any():
                yield at[hit], to[hit]
            return
        span = np.minimum(2.0, a.radius[level][i] + b.radius[level][j] + reach + 1e-7)
        live = near >= 1 - span * span / 2
        i, j = i[live], j[live]
        if not len(i):
            return
        wide = np.diff(a.children[level][1])[i] * np.diff(b.children[level][1])[j] > p.tile
        for s, t in zip(i[wide], j[wide]):
            yield from grid(level + 1, a.kids(level, s), b.kids(level, t))
        if not wide.all():
            for s, t in _product(a, b, level, i[~wide], j[~wide], 32 * p.tile):
                x, y = a.x[a.nodes[level + 1][s]], b.x[b.nodes[level + 1][t]]
                yield from open_(level + 1, s, t, np.einsum("ij,ij->i", x, y))

    def grid(level, i, j):
        """Compare all of ``i`` with all of ``j``, tile by tile."""
        for s in np.array_split(i, -(-len(i) // p.tile)):
            for t in np.array_split(j, -(-len(j) // p.tile)):
                near = a.x[a.nodes[level][s]] @ b.x[b.nodes[level][t]].T
                wide = np.minimum(2.0, a.radius[level][s].max() + b.radius[level][t].max() + reach + 1e-7)
                at, to = np.nonzero(near >= (p.threshold - 1e-9 if level == last else 1 - wide * wide / 2))
                yield from open_(level, s[at], t[to], near[at, to])

    return grid(0, np.array([0]), np.array([0]))


def _tie(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that the links i - j lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


_LINKS = pa.schema([("row", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _meet(p: NearParams):
    def tree(g: pa.Table) -> tuple[Tree, np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(g["vector"].to_pylist()), np.float64).reshape(g.num_rows, -1)
        leaders = np.frombuffer(b"".join(g["leaders"].to_pylist()), np.int64).reshape(g.num_rows, p.levels).T
        return Tree(x, leaders), g["row"].to_numpy(), g["copies"].to_numpy()

    def task(groups: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for g in groups:
            side = g["side"].to_numpy()
            halves = [g.filter(pa.array(side == s)).sort_by("nth") for s in (0, 1, 2)]
            if halves[2].num_rows:
                a = b = tree(halves[2])
            elif halves[0].num_rows and halves[1].num_rows:
                a, b = tree(halves[0]), tree(halves[1])
            else:
                continue
            n = len(a[1])
            shift = 0 if a is b else n
            links = np.zeros(n if a is b else n + len(b[1]), np.int64)
            ties = [(np.empty(0, np.int64),) * 2]
            for at, to in dual(a[0], b[0], p):
                if a is b:
                    at, to = at[at != to], to[at != to]
                if not len(at):
                    continue
                links += np.bincount(at, b[2][to], len(links)).astype(np.int64)
                if a is not b:
                    links += np.bincount(to + n, a[2][at], len(links)).astype(np.int64)
                nodes, places = np.unique(np.concatenate((at, to + shift)), return_inverse=True)
                label = _tie(places[:len(at)], places[len(at):], len(nodes))
                ties.append((nodes, nodes[label]))
            label = _tie(*(np.concatenate(x) for x in zip(*ties)), len(links))
            rows = a[1] if a is b else np.concatenate((a[1], b[1]))
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(rows[some]), pa.array(links[some]), pa.array(rows[label[some]])], schema=_LINKS)

    return task


_DEALT = "row long, vector binary, copies long, node string, gap double"


def _deal(batches):
    """Vectors to the nearest centre of their node; the centres of a key come before its vectors."""
    last, names, centres = None, [], None
    for batch in batches:
        keys = batch.column("key").to_pylist()
        kinds = batch.column("kind").to_pylist()
        turns = [0, *(i for i in range(1, len(keys)) if (keys[i], kinds[i]) != (keys[i - 1], kinds[i - 1])), len(keys)]
        for lo, hi in zip(turns, turns[1:]):
            if hi == lo:
                continue
            part = batch.slice(lo, hi - lo)
            x = units(np.frombuffer(b"".join(part.column("vector").to_pylist()), np.float64).reshape(hi - lo, -1))
            if kinds[lo] == 0:
                new = part.column("node").to_pylist()
                names, centres = (new, x) if keys[lo] != last else (names + new, np.concatenate((centres, x)))
                last = keys[lo]
                continue
            near = x @ centres.T
            own = near.argmax(axis=1)
            gap = np.sqrt(np.maximum(0, 2 - 2 * near[np.arange(len(x)), own]))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("vector"), part.column("copies"), pa.array([names[i] for i in own.tolist()]), pa.array(gap)],
                names=["row", "vector", "copies", "node", "gap"])


def _near_pairs(reach: float):
    """The pairs of nodes that may hold a link; a node without a centre is never dropped."""

    def run(batches):
        for batch in batches:
            keep = []
            for u, v, r, s in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "r", "s"))):
                if u is None or v is None:
                    keep.append(True)
                    continue
                x, y = units(np.frombuffer(u, np.float64)), units(np.frombuffer(v, np.float64))
                keep.append(float(np.linalg.norm(x - y)) <= r + s + reach + 1e-7)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _leaves(reps: DataFrame, p: NearParams, folder: str) -> tuple[DataFrame, DataFrame]:
    """(vectors by ``piece``, pairs ``a, b`` of pieces that may hold a link, a piece with itself too).

    A root for each vector length.  The children's centres are the first of the node's distinct
    vectors by a hash, and a node's rows are dealt in parts of bounded size, each of which is sent the
    centres, so neither a large node nor the number of nodes is held in one place.
    """
    done: list[DataFrame] = []
    moving = reps.withColumn("node", F.octet_length("vector").cast("string")).withColumn("gap", F.lit(2.0))
    moving = staged(moving, "node-0", folder)
    pairs = moving.select(F.col("node").alias("a"), F.col("node").alias("b")).distinct()
    leaves = None  # nodes that are not split any more, with centre and radius
    kids = moving.select(F.col("node")).distinct().select("node", F.lit(None).cast("binary").alias("centre"), F.lit(2.0).alias("radius"))
    for level in range(1, p.depth + 1):
        sizes = staged(moving.groupBy("node").agg(F.count("*").alias("n")), f"sizes-{level}", folder)
        large = sizes.filter(F.col("n") > p.cell)
        small = moving.join(large, "node", "left_anti")
        done.append(small)
        still = kids.join(large, "node", "left_anti")
        leaves = still if leaves is None else leaves.unionByName(still)
        if large.isEmpty():
            break
        rows = join_counted(moving, large, "node", "n")
        order = Window.partitionBy("node").orderBy(F.xxhash64("vector", F.lit(level)), "row")
        first = rows.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= p.fan)
        first = first.filter(F.col("i") <= F.greatest(F.lit(2), F.ceil(2 * F.col("n") / p.cell)))
        centres = staged(first.select(F.col("node").alias("parent"), F.concat_ws(".", "node", "i").alias("node"),
                                      F.col("vector").alias("centre"), "n"), f"centres-{level}", folder)
        parts = F.ceil(F.col("n") / p.cell)
        none = F.lit(None).cast("long")
        sent = centres.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).select(
            F.concat_ws("/", "parent", "part").alias("key"), F.lit(0).alias("kind"), "node", none.alias("row"),
            F.col("centre").alias("vector"), none.alias("copies"))
        asked = rows.select(F.concat_ws("/", "node", F.pmod(F.xxhash64("row"), parts)).alias("key"), F.lit(1).alias("kind"),
                            "node", "row", "vector", "copies")
        dealt = sent.unionByName(asked).repartition("key").sortWithinPartitions("key", "kind", "node")
        moving = staged(dealt.mapInArrow(_deal, _DEALT), f"node-{level}", folder)
        radius = moving.groupBy("node").agg(F.max("gap").alias("radius"))
        kids = staged(centres.join(radius, "node").select("parent", "node", "centre", "radius"), f"kids-{level}", folder)
        # Pairs of this level: the children of split nodes, the others as they are.
        below = kids.unionByName(leaves.select(F.col("node").alias("parent"), "node", "centre", "radius"))
        one = below.select(F.col("parent").alias("pa"), F.col("node").alias("x"), F.col("centre").alias("u"), F.col("radius").alias("r"))
        two = below.select(F.col("parent").alias("pb"), F.col("node").alias("y"), F.col("centre").alias("v"), F.col("radius").alias("s"))
        opened = pairs.join(one, F.col("a") == F.col("pa")).join(two, F.col("b") == F.col("pb"))
        opened = opened.filter("a <> b OR x <= y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "u", "v", "r", "s")
        pairs = staged(opened.mapInArrow(_near_pairs(p.reach), "a string, b string"), f"pairs-{level}", folder)
        kids = kids.drop("parent")
    else:
        done.append(moving)
        leaves = leaves.unionByName(kids)
    rows = reduce(DataFrame.unionByName, done).select("row", "vector", "copies", "node")
    # What splitting could not make small is cut by a hash; its pieces all meet.
    sizes = staged(rows.groupBy("node").agg(F.count("*").alias("n")), "leaf-sizes", folder)
    cut = F.ceil(F.col("n") / (2 * p.cell))
    rows = join_counted(rows, sizes, "node", "n").select(
        "row", "vector", "copies", F.concat_ws("#", "node", F.pmod(F.xxhash64("row"), cut)).alias("piece"))
    pieces = sizes.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), cut - 1))).select(
        "node", F.concat_ws("#", "node", "i").alias("piece"))
    named = pairs.join(pieces.select(F.col("node").alias("a"), F.col("piece").alias("x")), "a").join(
        pieces.select(F.col("node").alias("b"), F.col("piece").alias("y")), "b")
    return rows, staged(named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs", folder)


def cosine_classes(vectors: DataFrame, params: NearParams = NearParams(), key: str = "vec_id",
                   vector: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: ``id, n_links, class_id``.

    Two rows link if their vectors, of equal length, have a cosine of at least ``threshold``.
    ``n_links`` counts the other rows linked directly, ``class_id`` is the smallest id that links
    lead to, the own one included.  Null, empty and zero vectors and those with null or non-finite
    components link with nothing.  Repeated rows are copies that link; null ids sort last.  Other
    columns are not read.
    """
    p = params
    folder = run_dir(vectors.sparkSession, "cover")
    kind = vectors.schema[key].dataType.simpleString()

    def read(batches):
        for batch in batches:
            found = [scaled(v) for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([None if u is None else hashlib.md5(u.tobytes()).hexdigest() for u in found], pa.string()),
                 pa.array([None if u is None else u.tobytes() for u in found], pa.binary())], names=["row", "id", "digest", "vector"])

    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(vector).alias("v"))
    rows = staged(rows.mapInArrow(read, f"row long, id {kind}, digest string, vector binary"), "rows", folder)
    good = rows.filter("digest IS NOT NULL")
    classes = staged(good.groupBy("digest").agg(F.min("row").alias("row"), F.count("*").alias("copies"),
                                                F.min(first_of()).alias("first")), "classes", folder)
    reps = good.select("row", "vector").join(classes.select("row", "copies"), "row")

    leaves, pairs = _leaves(reps.select("row", "vector", "copies"), p, folder)

    def grow(groups):
        for g in groups:
            x = np.frombuffer(b"".join(g["vector"].to_pylist()), np.float64).reshape(g.num_rows, -1)
            leaders = np.ascontiguousarray(nets(units(x), p).T)
            yield pa.RecordBatch.from_arrays(
                [*(g[c].combine_chunks() for c in ("row", "vector", "copies", "piece")), pa.array(range(g.num_rows), pa.int64()),
                 pa.array([r.tobytes() for r in leaders], pa.binary())], names=["row", "vector", "copies", "piece", "nth", "leaders"])

    trees = staged(map_groups(leaves, "piece", grow,
                              "row long, vector binary, copies long, piece string, nth long, leaders binary", ("row",)),
                   "trees", folder)
    # Each row once for every leaf that its own meets.
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    others = staged(both.groupBy(F.col("a").alias("piece")).agg(F.collect_list("b").alias("others")).join(
        trees.groupBy("piece").agg(F.count("*").alias("n")), "piece"), "others", folder)
    met = join_counted(trees, others, "piece", "n").withColumn("other", F.explode("others"))
    met = met.select(
        F.concat_ws("/", F.least("piece", "other"), F.greatest("piece", "other")).alias("pair"),
        F.when(F.col("piece") == F.col("other"), 2).when(F.col("piece") < F.col("other"), 0).otherwise(1).alias("side"),
        "row", "vector", "copies", "nth", "leaders")
    links = staged(map_groups(met, "pair", _meet(p), "row long, links long, root long"), "links", folder)
    found = link_report(good, classes, links, folder).select("id", "n_links", "class_id")
    alone = rows.filter("digest IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("class_id"))
    return found.unionByName(alone)
