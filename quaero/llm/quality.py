"""Quality of a text by a sparse ensemble of rules.

Small boosted trees are fitted to statistics of labelled texts.  Each path from the root to a node
is a rule, a conjunction of bounds on statistics; a logistic model with an L1 penalty keeps few of
them.  The model is compiled into a Spark column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quaero.llm import codes
from quaero.llm.jaccard import _word_hashes

STATS = ("chars", "words", "lines", "letters", "upper", "digits", "blanks", "stops", "commas", "bars", "marks", "shouts",
         "foreign", "word_length", "longest_word", "short_words", "distinct_words", "top_word", "line_words", "distinct_lines",
         "upper_words", "marked_words")


@dataclass(frozen=True)
class QualityParams:
    sample: int = 10_000     # labelled rows that the rules are fitted on, about
    trees: int = 40
    depth: int = 3
    bins: int = 32
    rate: float = 0.3        # step of the boosting
    leaf: int = 10           # rows that a rule must hold for, and not hold for
    penalty: float = 5e-4
    rounds: int = 400
    seed: int = 7


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, is it above, bound)


@dataclass(frozen=True)
class QualityModel:
    base: float = 0.0
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)


@lru_cache(maxsize=None)
def _classes() -> np.ndarray:
    """For every code point: 0 letter, 1 capital, 2 digit, 3 blank, 4 line break, 5 sentence end,
    6 comma, 7 bar, 8 other ASCII sign, 9 exclamation mark, 10 the rest."""
    letter, space = codes.kinds()
    out = np.full(len(letter), 10, np.uint8)
    out[:128] = 8
    out[letter] = 0
    out[np.fromiter((chr(c).isupper() for c in range(len(letter))), bool, len(letter))] = 1
    out[ord("0"):ord("9") + 1] = 2
    out[space] = 3
    out[ord("\n")] = 4
    for signs, kind in ((".?", 5), (",;:", 6), ("|", 7), ("!", 9)):
        out[[ord(c) for c in signs]] = kind
    return out


def statistics(text: str | None) -> list[float]:
    """The numbers named in `STATS`; shares of characters, words or lines where not counts."""
    text = text or ""
    counts = np.zeros(11, np.int64)
    lengths, capital, marked = [np.zeros(0, np.int64)], 0, 0
    for part in codes.word_pieces(text):
        kind = _classes()[codes.points(part)]
        counts += np.bincount(kind, minlength=11)
        blank = (kind == 3) | (kind == 4)
        turns = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True]))))
        starts, ends = turns[::2], turns[1::2]
        lengths.append(ends - starts)
        if len(starts):
            ups, signs = np.cumsum(np.append(0, kind == 1)), np.cumsum(np.append(0, (kind >= 7) & (kind <= 9)))
            capital += int((ups[ends] - ups[starts] > 1).sum())
            marked += int((signs[ends] > signs[starts]).sum())
    lengths = np.concatenate(lengths)
    hashes = _word_hashes(text)
    n, words = len(text), len(lengths)
    _, uses = np.unique(hashes, return_counts=True) if len(hashes) else (None, np.zeros(0, np.int64))
    lines = text.split("\n")
    letters = counts[0] + counts[1]
    share = lambda a, b: float(a) / float(b) if b else 0.0
    return [
        float(n), float(words), float(len(lines)), share(letters, n), share(counts[1], letters), share(counts[2], n),
        share(counts[3] + counts[4], n), share(counts[5], words), share(counts[6], words), share(counts[7], words),
        share(counts[8], n), share(counts[9], words), share(counts[10], n), share(lengths.sum(), words),
        float(lengths.max(initial=0)), share((lengths <= 3).sum(), words), share(len(uses), len(hashes)),
        share(uses.max(initial=0), len(hashes)), share(words, len(lines)), share(len(set(lines)), len(lines)),
        share(capital, words), share(marked, words)]


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and one column per statistic of the whole text; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            found = [statistics(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = np.array(found, np.float64).reshape(-1, len(STATS)).T
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c) for c in columns)], names=[*keep, *STATS])

    keep = [c for c in keep if c not in STATS]
    rows = docs.select(*keep, F.col(text).alias("_text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return rows.mapInArrow(run, kept + ", ".join(f"{s} double" for s in STATS))


def _tree(bins: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, p: QualityParams, features: np.ndarray,
          update: np.ndarray) -> list[list[tuple[int, bool, int]]]:
    """Fit one tree to the gradients, add its leaves to ``update``; returns the paths to its nodes."""
    paths = []
    todo = [([], np.arange(len(bins)))]
    while todo:
        path, rows = todo.pop()
        if path:
            paths.append(path)
        best, cut = 1e-6, None
        if len(path) < p.depth and len(rows) >= 2 * p.leaf:
            total_g, total_h = gradient[rows].sum(), hessian[rows].sum()
            for f in features:
                at = bins[rows, f]
                n = np.bincount(at, minlength=p.bins).cumsum()[:-1]
                g = np.bincount(at, gradient[rows], p.bins).cumsum()[:-1]
                h = np.bincount(at, hessian[rows], p.bins).cumsum()[:-1]
                gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
                gain[(n < p.leaf) | (len(rows) - n < p.leaf)] = 0
                i = int(np.argmax(gain))
                if gain[i] > best:
                    best, cut = gain[i], (int(f), i)
        if cut is None:
            update[rows] += p.rate * gradient[rows].sum() / (hessian[rows].sum() + 1)
            continue
        above = bins[rows, cut[0]] > cut[1]
        todo.append(([*path, (cut[0], True, cut[1])], rows[above]))
        todo.append(([*path, (cut[0], False, cut[1])], rows[~above]))
    return paths


def _lasso(x: np.ndarray, y: np.ndarray, p: QualityParams) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal steps; the base is free."""
    n = len(y)
    x = np.hstack((np.ones((n, 1), np.float32), x))
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (x @ v)
        norm = np.linalg.norm(v)
        v /= norm
    step = 4 * n / (1.05 * float(norm))
    w = np.zeros(x.shape[1])
    z, t = w.copy(), 1.0
    for _ in range(p.rounds):
        g = x.T @ (1 / (1 + np.exp(-(x @ z.astype(np.float32)))) - y).astype(np.float32) / n
        new = z - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * p.penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, p: QualityParams) -> QualityModel:
    """The model of statistics ``x`` and labels ``y`` (0 or 1).  Labels of one kind give their share
    as the score of every text, smoothed; no label at all gives one half."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if len(y) < 2 * p.leaf or y.min() == y.max():
        return QualityModel(base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, p.bins + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    rng = np.random.default_rng(p.seed)
    score = np.full(len(y), base)
    rules: dict[Rule, None] = {}
    for _ in range(p.trees):
        prob = 1 / (1 + np.exp(-score))
        features = rng.permutation(x.shape[1])[:max(2, x.shape[1] * 2 // 3)]
        update = np.zeros(len(y))
        for path in _tree(bins, y - prob, prob * (1 - prob), p, features, update):
            bounds: dict[tuple[int, bool], int] = {}
            for f, above, cut in path:  # the tightest bound on each side
                old = bounds.get((f, above), cut)
                bounds[f, above] = max(old, cut) if above else min(old, cut)
            rules[tuple(sorted((f, above, float(edges[f][cut])) for (f, above), cut in bounds.items()))] = None
        score += update
    rules = list(rules)
    held = np.stack([holds(r, x) for r in rules], axis=1)
    held, first = np.unique(held, axis=1, return_index=True)  # rules that hold alike are one
    rules = [rules[i] for i in first]
    base, weights = _lasso(held.astype(np.float32), y.astype(np.float64), p)
    used = np.flatnonzero(np.abs(weights) > 1e-6)
    return QualityModel(base, [rules[i] for i in used], [float(weights[i]) for i in used])


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, bound in rule:
        out &= x[:, f] > bound if above else x[:, f] <= bound
    return out


def compiled(model: QualityModel) -> Column:
    """The score as an expression over the columns of `STATS`."""
    total = F.lit(model.base)
    for rule, weight in zip(model.rules, model.weights):
        bounds = [F.col(STATS[f]) > bound if above else F.col(STATS[f]) <= bound for f, above, bound in rule]
        total = total + F.when(reduce(lambda a, b: a & b, bounds), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def fit(stats: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), key: str = "doc_id",
        label: str = "quality") -> QualityModel:
    """Learn from about ``sample`` rows of ``stats`` that have a label of 0 or 1 (drawn by the hash
    of the key); other labels and null keys teach nothing, repeated labels count once."""
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).filter("_label IN (0, 1)").distinct()
    rows = stats.join(known, F.col(key) == F.col("_key"))
    n = rows.count()
    drawn = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, params.sample / max(n, 1)))
    found = rows.filter(drawn).select(*STATS, "_label", F.col(key).cast("string").alias("_key")).toArrow().to_pandas().sort_values(["_key", "_label"])
    return fit_rules(found[list(STATS)].to_numpy(np.float64), found["_label"].to_numpy(np.float64), params)
