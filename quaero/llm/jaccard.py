"""Jaccard join of word n-gram sets by chosen paths.

Each run sends every set down a random forest: at a node a set follows each of its tokens with
probability 1 / (threshold * size), decided by a hash of path and token, so similar sets tend to
choose the same shared tokens.  Sets that meet in a small node are compared by brute force (on a
sketch), large nodes are split again, and independent runs repeat until a pair at the threshold
meets with the target probability.  What meets and looks similar forms candidate groups; within
these all pairs are verified on the sets themselves, block by block.  Pairs never become rows:
tasks emit link counts and one edge per set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from quaero.llm import codes
from quaero.llm.joins import HEAVY, components, first_of, join_counted, link_report, map_groups, sieve
from quaero.sources.workdir import run_dir, staged

_TWO64 = float(2**64)


@dataclass(frozen=True)
class JaccardParams:
    words: int = 5
    threshold: float = 0.8
    recall: float = 0.999      # chance that a pair at the threshold meets, even at the deepest level
    small: int = 128           # sets in a node that is compared by brute force
    depth: int = 3             # levels of splitting; what is still large then is compared in blocks
    bins: int = 128            # bytes of the sketch
    sketch_bar: float = 0.62   # five standard errors (0.035) below a similarity of 0.8
    part: int = 512            # sets of a large node of the deepest level that are compared first, ``small`` above it;
                               # so many sets beside a node's largest group are compared with all of the node
    block: int = 2048          # sets in one block of a node that is compared across such parts
    block_words: int = 1 << 20  # n-grams in one block of a candidate group,
    block_rows: int = 512       # and sets

    @property
    def runs(self) -> int:
        """A pair at the threshold is expected to choose one shared token a level (Poisson)."""
        meet = 1.0
        for _ in range(self.depth):
            meet = 1 - math.exp(-meet)
        return math.ceil(math.log(1 - self.recall) / math.log(1 - meet))


def _word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word between white space, in order."""
    found = [np.empty(0, np.uint64)]
    for part in codes.word_pieces(text):
        c = codes.points(part.lower())
        space = codes.kinds()[1][c]
        turns = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
        lengths = turns[1::2] - turns[::2]
        if not len(lengths):
            continue
        starts = np.cumsum(lengths) - lengths
        letters = c[~space].astype(np.uint64)
        place = (np.arange(len(letters)) - np.repeat(starts, lengths) + 1).astype(np.uint64)
        found.append(codes.mix(np.add.reduceat(codes.mix(letters + (place << np.uint64(32))), starts)))
    return np.concatenate(found)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; a shorter text is one n-gram, none has none."""
    w = _word_hashes(text or "")
    if not len(w):
        return w
    n = min(words, len(w))
    total = np.zeros(len(w) - n + 1, np.uint64)
    for j in range(n):
        total += codes.mix(w[j:len(w) - n + 1 + j] + np.uint64(j + 1))
    return np.unique(codes.mix(total + np.uint64(n)))


def sketch(s: np.ndarray, bins: int) -> bytes:
    """One byte of the smallest hash in each equal range of hashes; 0 where a range has none."""
    edges = (np.arange(bins, dtype=np.uint64) * np.uint64(2**64 // bins))
    first = np.searchsorted(s, edges)
    last = np.append(first[1:], len(s))
    out = np.zeros(bins, np.uint8)
    some = first < last
    out[some] = 1 + (codes.mix(s[first[some]]) % np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def paths(s: np.ndarray, p: JaccardParams) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the (parent, node) pairs that the set goes to, over all runs."""
    chance = min(_TWO64 - 2049, _TWO64 / (p.threshold * len(s)))
    bar = np.uint64(chance)
    parents = codes.mix(np.arange(1, p.runs + 1, dtype=np.uint64))
    levels = []
    for _ in range(p.depth):
        chosen = []
        for some in np.array_split(parents, max(1, len(parents) * len(s) >> 20)):
            drawn = codes.mix(s[None, :] ^ some[:, None])
            i, j = np.nonzero(drawn < bar)
            chosen.append((some[i], codes.mix(some[i] * np.uint64(3) + s[j])))
        up, nodes = (np.concatenate(x) for x in zip(*chosen))
        levels.append((up.view(np.int64), nodes.view(np.int64)))
        parents = nodes
    return levels


def fold(nodes: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node tied to it) for the edges between ``nodes`` and ``roots``; a root is not listed."""
    names, at = np.unique(np.concatenate((nodes, roots)), return_inverse=True)
    i, j = at[:len(nodes)], at[len(nodes):]
    label = np.arange(len(names))
    while True:
        old = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (old == label).all():
            break
    tied = label != np.arange(len(names))
    return names[tied], names[label[tied]]


def _alike(row: np.ndarray, y: np.ndarray, bar: float) -> np.ndarray:
    """Which sketches of ``y`` suggest a similarity of at least ``bar`` to the sketch ``row``."""
    used = y > 0
    same = ((y == row) & used).sum(axis=1)
    return same >= bar * np.maximum(1, (used | (row > 0)).sum(axis=1))


def tie(x: np.ndarray, labels: np.ndarray, bar: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that tie the labels of rows with like sketches; rows that are tied already are not compared.

    Rows are reached wave by wave, and a wave looks only at rows that no wave has reached, so a group
    of copies costs one comparison a row, not one a pair.
    """
    ends: list[tuple[int, int]] = []
    left = np.arange(len(x))
    while len(left):
        first = labels[left[0]]
        own = labels[left] == first
        wave, left = left[own], left[~own]
        while len(wave) and len(left):
            hit = np.zeros(len(left), bool)
            for i in wave:
                apart = np.flatnonzero(~hit)
                if not len(apart):
                    break
                hit[apart[_alike(x[i], x[left[apart]], bar)]] = True
            met = np.unique(labels[left[hit]])
            ends += [(first, m) for m in met.tolist()]
            reached = np.isin(labels[left], met)
            wave, left = left[reached], left[~reached]
    pairs = np.array(ends, np.int64).reshape(-1, 2)
    return pairs[:, 1], pairs[:, 0]


def tie_across(x: np.ndarray, labels: np.ndarray, y: np.ndarray, others: np.ndarray, bar: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the labels of two blocks; rows whose labels are tied already are not compared."""
    labels, others = labels.copy(), others.copy()
    ends: list[tuple[int, int]] = []
    for i in range(len(x)):
        apart = np.flatnonzero(others != labels[i])
        if not len(apart):
            continue
        met = np.unique(others[apart[_alike(x[i], y[apart], bar)]])
        if len(met):
            ends += [(m, labels[i]) for m in met.tolist()]
            others[np.isin(others, met)] = labels[i]
            labels[np.isin(labels, met)] = labels[i]
    pairs = np.array(ends, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


_EDGE = pa.schema([("node", pa.int64()), ("root", pa.int64())])
_FOLD = 1 << 18  # edges that a task folds before it hands them on


def _meet(p: JaccardParams):
    """Tie the sets of a node, or of two blocks of a node, by their sketches; edges of a task are folded."""

    def edges(g: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(g["sketch"].to_pylist()), np.uint8).reshape(g.num_rows, p.bins)
        label, side = g["label"].to_numpy(), g["side"].to_numpy()
        if (side == 2).all():
            return tie(x, label, p.sketch_bar)
        a, b = side == 0, side == 1
        return tie_across(x[a], label[a], x[b], label[b], p.sketch_bar)

    def task(groups: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        found = [(np.empty(0, np.int64),) * 2]
        held = 0
        for g in groups:
            if g.num_rows > 1:
                found.append(edges(g))
                held += len(found[-1][0])
            if held > _FOLD:
                node, root = fold(*map(np.concatenate, zip(*found)))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], schema=_EDGE)
                found, held = found[:1], 0
        node, root = fold(*map(np.concatenate, zip(*found)))
        if len(node):
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], schema=_EDGE)

    return task


def _blocked(rows: DataFrame, key: str, id_: str, blocks: str) -> DataFrame:
    """Each row once for every block that its own meets: ``pair`` names the two, ``side`` its side."""
    own = F.pmod(F.xxhash64(key, id_), F.col(blocks))
    rows = rows.withColumn("_b", own).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)))
    side = F.when(F.col("_b") == F.col("_o"), 2).when(F.col("_b") < F.col("_o"), 0).otherwise(1)
    return (rows.withColumn("pair", F.concat_ws("/", F.col(key), F.least("_b", "_o"), F.greatest("_b", "_o")))
            .withColumn("side", side).drop("_b", "_o"))


def _beside(rows: DataFrame) -> DataFrame:
    """The ``lead`` group of each node once, block by block, and every other set of the node in each of its ``blocks``."""
    own = F.pmod(F.xxhash64("node", "row"), F.col("blocks"))
    block = F.when(F.col("label") == F.col("lead"), F.array(own)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    return rows.withColumn("_b", F.explode(block)).select(
        F.concat_ws("/", "node", "_b", F.lit("beside")).alias("pair"), "row", F.lit(2).alias("side"), "label")


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over slices of the shared tokens."""
    if len(a) == 1 or len(b) == 1:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a])
    sizes = np.array([len(x) for x in (*a, *b)])
    tokens, at = np.unique(np.concatenate((*a, *b)), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    shared = np.bincount(at, minlength=len(tokens)) > 1
    column = np.cumsum(shared) - 1
    row, column = row[shared[at]], column[at[shared[at]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(a), len(b)), np.float64)
    width = 4096
    for start in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, (start, start + width))
        m = np.zeros((len(sizes), width), np.float32)
        m[row[lo:hi], column[lo:hi] - start] = 1
        out += m[:len(a)] @ m[len(a):].T
    return out


_LINKS = pa.schema([("row", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _verify(p: JaccardParams):
    """Exact similarities between two blocks of a group: links of each set, and a star of edges."""

    def task(groups: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for g in groups:
            rows, side, copies = (g[c].to_numpy() for c in ("row", "side", "copies"))
            _, first = np.unique(rows, return_index=True)
            if len(first) < 2:
                continue
            rows, side, copies = rows[first], side[first], copies[first]
            sets = [np.frombuffer(x, np.uint64) for x in g["tokens"].take(first).to_pylist()]
            a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            if not len(a) or not len(b):
                continue
            both = _overlaps([sets[i] for i in a], [sets[i] for i in b])
            sizes = np.array([len(x) for x in sets])
            close = both / (sizes[a][:, None] + sizes[b][None, :] - both) >= p.threshold
            close &= rows[a][:, None] != rows[b][None, :]
            links = np.zeros(len(rows), np.int64)
            links[a] += close @ copies[b]
            if (side != 2).all():  # two blocks: each link shows once
                links[b] += close.T @ copies[a]
            root = rows.copy()
            i, j = np.nonzero(close)
            node, low = fold(rows[a][i], rows[b][j])
            place = np.searchsorted(rows, node)
            np.minimum.at(root, place, low)
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(rows[some]), pa.array(links[some]), pa.array(root[some])], schema=_LINKS)

    return task


def _once(shared):
    """The texts that members of candidate groups may have, each once in a task however many rows repeat it."""

    def run(batches):
        seen = np.empty(0, np.int64)
        for batch in batches:
            h = batch.column(3).to_numpy()
            first = np.zeros(len(h), bool)
            first[np.unique(h, return_index=True)[1]] = True
            first &= shared.value.holds(h) & ~np.isin(h, seen)
            seen = np.concatenate((seen, h[first]))
            yield pa.RecordBatch.from_arrays(batch.columns[:3], names=["_id", "digest", "_text"]).filter(pa.array(first))

    return run


def _signatures(docs: DataFrame, p: JaccardParams, key: str, text: str) -> DataFrame:
    """One narrow row per document: digest of the text, sketch, and the nodes of every level."""
    names = [f"{kind}{d}" for d in range(1, p.depth + 1) for kind in ("p", "n")]

    def run(batches):
        for batch in batches:
            sizes, sketches, levels = [], [], [[] for _ in names]
            for t in batch.column(3).to_pylist():
                s = shingles(t, p.words)
                sizes.append(len(s))
                sketches.append(sketch(s, p.bins) if len(s) else None)
                for k, x in enumerate(x for pair in (paths(s, p) if len(s) else [((), ())] * p.depth) for x in pair):
                    levels[k].append(x)
            arrays = [pa.array(x, pa.list_(pa.int64())) for x in levels]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), *arrays],
                names=["row", "id", "digest", "size", "sketch", *names])

    kind = docs.schema[key].dataType.simpleString()
    fields = ", ".join(f"{n} array<long>" for n in names)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"),
                       F.md5(F.col(text)).alias("digest"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"row long, id {kind}, digest string, size long, sketch binary, {fields}")


def _candidates(reps: DataFrame, p: JaccardParams, folder: str) -> DataFrame:
    """``node, root``: candidate groups, tied by sets that meet in some node and have like sketches.

    A large node is compared in parts first, and the parts differ from node to node.  Only nodes whose
    sets do not lie in one group by then go on.  Where all but ``part`` sets lie in one group, these few
    are compared with all others at once: near copies share most tokens, so splitting would send nearly
    the whole group down every level, and cost more than that.  Other nodes are split, or at the deepest
    level compared across blocks, and there only sets of different groups.
    """
    sketches = reps.select("row", "sketch").hint("merge")
    meet = lambda rows: map_groups(
        rows.join(sketches, "row").select("pair", "row", "sketch", "side", "label"), "pair", _meet(p), "node long, root long")
    alone = (F.lit(2).alias("side"), F.col("row").alias("label"))
    groups = None
    inner = beside = None  # large nodes of the level above that go on; what meets in those that do not
    for level in range(1, p.depth + 1):
        place = f"{folder}/level-{level}"
        if level == 1:
            at = reps.select("row", F.explode("n1").alias("node"))
        else:
            split = reps.select("row", F.explode(F.arrays_zip(F.col(f"p{level}").alias("p"), F.col(f"n{level}").alias("n"))).alias("x"))
            split = split.select("row", F.col("x.p").alias("parent"), F.col("x.n").alias("node"))
            at = staged(join_counted(split, inner, "parent", "n").select("row", "node"), "sets", place)
        counts = staged(at.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "nodes", place)
        total = counts.agg(F.sum("n")).first()[0] or 0
        # The largest nodes are fewer than HEAVY; their sets leave before the rest is shuffled by node.
        light = at.join(F.broadcast(counts.filter((F.col("n") > p.small) & (F.col("n") > total // HEAVY))), "node", "left_anti")
        met = light.join(counts.filter(F.col("n") <= p.small), "node").select(F.col("node").cast("string").alias("pair"), "row", *alone)

        held = staged(join_counted(at, counts.filter(F.col("n") > p.small), "node", "n"), "large", place)
        size = p.part if level == p.depth else p.small
        part = F.pmod(F.xxhash64("node", "row"), F.ceil(F.col("n") / size))
        met = met.unionByName(held.select(F.concat_ws("/", "node", part).alias("pair"), "row", *alone))
        edges = meet(met if beside is None else met.unionByName(beside))
        if groups is not None:
            edges = edges.unionByName(groups.filter("node <> root"))
        edges = staged(edges.distinct(), "edges", place)
        groups = staged(components(edges, "node", "root", place, "near"), "near", place)

        label = F.coalesce("root", "row").alias("label")
        held = staged(held.filter(F.col("n") > size).join(groups.withColumnRenamed("node", "row").hint("merge"), "row", "left")
                      .select("node", "n", "row", label), "labelled", place)
        mixed = staged(held.groupBy("node", "label").agg(F.count("*").alias("sets"))
                       .groupBy("node").agg(F.sum("sets").alias("n"), F.max(F.struct("sets", "label")).alias("most"))
                       .withColumn("others", F.col("n") - F.col("most.sets")).filter("others > 0")
                       .withColumn("blocks", F.ceil(F.col("n") / p.block).cast("long"))
                       .select("node", "n", F.col("most.label").alias("lead"), "others", "blocks"), "mixed", place)
        if mixed.isEmpty():
            return groups
        beside = _beside(join_counted(held.drop("n"), mixed.filter(F.col("others") <= p.part), "node", "n"))
        inner = mixed.filter(F.col("others") > p.part).select(F.col("node").alias("parent"), "n", "blocks")
        if inner.isEmpty():
            met = beside
            break
    else:
        met = join_counted(held.drop("n"), inner.withColumnRenamed("parent", "node"), "node", "n")
        met = beside.unionByName(_blocked(met, "node", "row", "blocks").select("pair", "row", "side", "label"))
    across = staged(meet(met).distinct(), "across", folder)
    return components(groups.filter("node <> root").unionByName(across), "node", "root", folder, "groups")


def jaccard_classes(docs: DataFrame, params: JaccardParams = JaccardParams(), key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, digest, n_links, class_id, kept``.

    Documents link when the sets of their word n-grams (lower case, words between white space)
    have a Jaccard similarity of at least ``threshold``.  ``n_links`` counts the other rows linked
    directly, copies included; ``class_id`` is the smallest id that links lead to, the id itself
    included; ``kept`` marks exactly one row of each class, one with that id.  Fewer words than an
    n-gram form one n-gram.  A null text or one without words links with nothing and is kept.
    Repeated rows are copies.  Null ids sort last.  Other columns are not read.  ``digest`` is the
    MD5 of the text.
    """
    p = params
    folder = run_dir(docs.sparkSession, "jaccard")
    rows = staged(_signatures(docs, p, key, text), "rows", folder)
    classes = staged(rows.filter("size > 0").groupBy("digest").agg(
        F.min("row").alias("row"), F.count("*").alias("copies"), F.min(first_of()).alias("first")), "classes", folder)
    # Sides that grow with the documents are merged, never broadcast, so that plans are alike at every size.
    reps = staged(rows.drop("id", "digest").hint("merge").join(classes.select("row", "copies"), "row"), "reps", folder)

    groups = _candidates(reps, p, folder)
    members = staged(groups.withColumnRenamed("node", "row").hint("merge").join(rows.select("row", "id", "digest", "size"), "row"),
                     "members", folder)
    sizes = staged(members.groupBy("root").agg(
        F.greatest(F.ceil(F.sum("size") / p.block_words), F.ceil(F.count("*") / p.block_rows)).cast("long").alias("blocks"),
        F.count("*").alias("n")), "sizes", folder)
    members = join_counted(members, sizes, "root", "n").join(reps.select("row", "copies").hint("merge"), "row")
    members = staged(members.select("digest", "id", "row", "root", "blocks", "copies"), "sized", folder)
    mark = lambda i, d: F.xxhash64(F.col(i).cast("string"), d).alias("h")
    shared = docs.sparkSession.sparkContext.broadcast(sieve(members.select(mark("id", "digest")), "h"))
    texts = docs.select(F.col(key).alias("_id"), F.md5(F.col(text)).alias("digest"), F.col(text).alias("_text"))
    texts = texts.withColumn("h", mark("_id", "digest")).mapInArrow(
        _once(shared), f"_id {docs.schema[key].dataType.simpleString()}, digest string, _text string")
    members = members.hint("merge").join(texts, "digest").filter("_id <=> id").groupBy(
        "row", "root", "blocks", "copies").agg(F.first("_text").alias("_text"))

    def tokens(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([shingles(t, p.words).tobytes() for t in batch.column(4).to_pylist()], pa.binary())],
                names=["row", "root", "blocks", "copies", "tokens"])

    sets = members.mapInArrow(tokens, "row long, root long, blocks long, copies long, tokens binary")
    pairs = _blocked(sets, "root", "row", "blocks").select("pair", "row", "copies", "side", "tokens")
    links = staged(map_groups(pairs, "pair", _verify(p), "row long, links long, root long"), "links", folder)
    linked = link_report(rows.filter("size > 0"), classes, links, folder).withColumnRenamed("first", "kept")
    empty = rows.filter("size = 0").select("id", "digest", F.lit(0).cast(LongType()).alias("n_links"),
                                           F.col("id").alias("class_id"), F.lit(True).alias("kept"))
    return linked.unionByName(empty)


def drop_near_duplicates(docs: DataFrame, params: JaccardParams = JaccardParams(), key: str = "doc_id",
                         text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that `jaccard_classes` keeps: one of each class."""
    found = jaccard_classes(docs, params, key, text).groupBy("id", "digest").agg(
        F.count("*").alias("rows"), F.sum(F.col("kept").cast("int")).alias("kept"))
    found = staged(found.filter("kept > 0"), "kept", run_dir(docs.sparkSession, "jaccard"))
    found = found.select(F.col("id").alias("_quaero_id"), F.col("digest").alias("_quaero_digest"), "rows", "kept")
    same = F.col(key).eqNullSafe(F.col("_quaero_id")) & F.md5(F.col(text)).eqNullSafe(F.col("_quaero_digest"))
    whole = docs.join(found.filter("rows = kept").select("_quaero_id", "_quaero_digest"), same, "left_semi")
    # Rows that repeat with id and text are copies: one stays.
    again = docs.join(found.filter("rows > kept").select("_quaero_id", "_quaero_digest"), same, "left_semi")
    return whole.unionByName(again.dropDuplicates([key, text]))
