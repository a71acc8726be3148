"""A hidden Markov language model: latent states trained by Baum-Welch, exact text likelihoods.

A text is its words, lower-cased A-Z, and one end.  The states emit symbols: each frequent word is
one, the end is one, all other words share symbols by a hash of their last letters; within such a
class a word has its smoothed share of the class.  So the states' tables have a fixed size, while
word counts stay a table.  Baum-Welch counts are summed over all partitions in each round, and the
scaled forward recursion gives the likelihood of whole texts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quaero.sources.workdir import run_dir, staged

END = b""  # stands for the end of a text; no word is empty


@dataclass(frozen=True)
class HmmParams:
    states: int = 8
    frequent: int = 60_000     # words with a symbol of their own, at most
    classes: int = 1024        # symbols of the other words
    ending: int = 3            # bytes at a word's end that name its class
    rounds: int = 3            # passes over all training texts
    start_texts: int = 300     # texts that the first guess of the states comes from, about
    start_tokens: int = 4096   # longer texts give no first guess
    start_rounds: int = 12
    prior: float = 3000.0      # tokens' worth of the plain word frequencies in each state
    segment: int = 2048        # tokens that training looks at as one sequence
    chunk: int = 200_000       # tokens that are worked on at once
    seed: int = 11


@dataclass
class States:
    start: np.ndarray          # of a text
    later: np.ndarray          # of a segment that does not begin a text
    move: np.ndarray
    emit: np.ndarray           # symbols x states


def words(text: str | None) -> list[bytes]:
    """The words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _ragged(sequences: list[np.ndarray]) -> tuple[list[int], list[np.ndarray], np.ndarray]:
    """Order by falling length; for each step the symbols of the sequences that reach it."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    sizes = np.array([len(sequences[i]) for i in order])
    flat = np.concatenate([sequences[i] for i in order])
    first = np.cumsum(sizes) - sizes
    reach = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    steps = [flat[first[:n] + t] for t, n in enumerate(reach)]
    return order, steps, sizes


def expected(sequences: list[np.ndarray], begins: np.ndarray, m: States) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of starts, moves and emissions, and the log-likelihood."""
    order, steps, _ = _ragged(sequences)
    begins = begins[order]
    a = np.where(begins[:, None], m.start, m.later) * m.emit[steps[0]]
    alphas, scales, log = [], [], 0.0
    for t, symbols in enumerate(steps):
        if t:
            a = (alphas[-1][:len(symbols)] @ m.move) * m.emit[symbols]
        c = a.sum(axis=1)
        a /= c[:, None]
        alphas.append(a)
        scales.append(c)
        log += float(np.log(c).sum())
    moves = np.zeros_like(m.move)
    beta = None
    for t in range(len(steps) - 1, -1, -1):
        gamma = alphas[t]
        if beta is not None:
            n = len(beta)
            ahead = m.emit[steps[t + 1]] * beta / scales[t + 1][:, None]
            moves += gamma[:n].T @ ahead
            back = ahead @ m.move.T
            beta = np.ones_like(gamma)
            beta[:n] = back
            alphas[t] = gamma * beta
        else:
            beta = np.ones_like(gamma)
    flat, gammas = np.concatenate(steps), np.concatenate(alphas)
    emits = np.stack([np.bincount(flat, gammas[:, s], len(m.emit)) for s in range(len(m.move))], axis=1)
    return alphas[0][begins].sum(axis=0), moves * m.move, emits, log


def log10_likelihoods(sequences: list[np.ndarray], m: States) -> np.ndarray:
    """log10 of each sequence's probability, by the scaled forward recursion over all of it."""
    order, steps, sizes = _ragged(sequences)
    total = np.zeros(len(order))
    a = None
    for symbols in steps:
        n = len(symbols)
        a = (m.start if a is None else a[:n] @ m.move) * m.emit[symbols]
        c = a.sum(axis=1)
        a /= c[:, None]
        total[:n] += np.log10(c)
    out = np.empty(len(order))
    out[order] = total
    return out


def chunks(sequences: list[np.ndarray], size: int) -> Iterator[list[int]]:
    """Places of sequences of like length, about ``size`` symbols together."""
    part, held = [], 0
    for i in sorted(range(len(sequences)), key=lambda i: len(sequences[i])):
        if part and held + len(sequences[i]) > size:
            yield part
            part, held = [], 0
        part.append(i)
        held += len(sequences[i])
    if part:
        yield part


def segments(texts: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    out = [(x[i:i + size], i == 0) for x in texts for i in range(0, len(x), size)]
    return [x for x, _ in out], np.array([b for _, b in out], bool)


def _states(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, plain: np.ndarray, p: HmmParams) -> States:
    """The model that the counts make likeliest, drawn a little to the plain frequencies."""
    start = (starts + 0.1) / (starts + 0.1).sum()
    move = (moves + 0.1) / (moves + 0.1).sum(axis=1, keepdims=True)
    emit = (emits + p.prior * plain[:, None]) / (emits.sum(axis=0) + p.prior)
    later = np.full(len(start), 1 / len(start))
    for _ in range(200):  # where the moves settle
        later = later @ move
    return States(start, later / later.sum(), move, emit)


def _guess(texts: list[np.ndarray], plain: np.ndarray, p: HmmParams) -> States:
    """A first guess of the states: random emissions, improved on a few texts."""
    rng = np.random.default_rng(p.seed)
    s = p.states
    emit = plain[:, None] * np.exp(0.5 * rng.standard_normal((len(plain), s)))
    move = np.full((s, s), 0.1 / s) + 0.9 * np.eye(s)
    m = States(np.full(s, 1 / s), np.full(s, 1 / s), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    for _ in range(p.start_rounds if texts else 0):
        starts, moves, emits, _ = expected(*segments(texts, p.segment), m)
        m = _states(starts, moves, emits, plain, p)
    return m


@dataclass
class Words:
    """What tasks know of the vocabulary."""
    symbol: dict[bytes, int]
    log_count: np.ndarray      # of each frequent word and the end: log10(count + 1)
    class_log: np.ndarray      # of each class: log10 of what its words share
    end: int


def _parts(batches, rows: int = 1000) -> Iterator:
    """The batches in parts of so many rows, as words take far more room than their texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def count_words(docs: DataFrame, p: HmmParams, text: str) -> DataFrame:
    """``word, n, class`` over all texts; the end counts once a text."""

    def run(batches):
        seen: Counter = Counter()
        for part in _parts(batches):
            for t in part.column(0).to_pylist():
                seen.update(words(t))
            seen[END] += part.num_rows
            if len(seen) > 250_000:
                yield partial(seen)
                seen = Counter()
        yield partial(seen)

    def partial(seen):
        keys = list(seen)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(seen.values(), pa.int64()),
             pa.array([zlib.crc32(w[-p.ending:]) % p.classes for w in keys], pa.int64())], names=["word", "n", "class"])

    counted = docs.select(text).mapInArrow(run, "word binary, n long, class long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.first("class").alias("class"))


def _vocabulary(counts: DataFrame, p: HmmParams) -> tuple[Words, np.ndarray, int, int, int]:
    """Frequent words are all from some count on, as many as ``frequent`` allows."""
    level = F.floor(F.log2("n") * 8)
    sizes = counts.filter(F.col("word") != END).groupBy(level.alias("level")).agg(
        F.count("*").alias("words"), F.min("n").alias("least")).collect()  # 8 rows for each power of two
    bar, held = 2**62, 0
    for r in sorted(sizes, key=lambda r: -r.level):
        held += r.words
        if held > p.frequent:
            break
        bar = r.least
    frequent = counts.filter((F.col("n") >= bar) & (F.col("word") != END)).select("word", "n").toArrow()
    known = sorted(zip(map(bytes, frequent["word"].to_pylist()), frequent["n"].to_pylist()))
    total, distinct, ends = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == END, F.col("n")))).first()
    rest = counts.filter((F.col("n") < bar) & (F.col("word") != END)).groupBy("class").agg(
        F.sum("n").alias("n"), F.count("*").alias("words")).collect()  # a row per class
    k = len(known)
    tokens = np.zeros(k + 1 + p.classes)
    tokens[:k] = [n for _, n in known]
    tokens[k] = ends or 0
    shared = np.ones(p.classes)  # one for any unseen word
    for r in rest:
        tokens[k + 1 + r["class"]] = r.n
        shared[r["class"]] += r.n + r.words
    plain = (tokens + 1) / (tokens + 1).sum()
    w = Words({word: i for i, (word, _) in enumerate(known)}, np.log10(tokens[:k + 1] + 1), np.log10(shared), k)
    return w, plain, int(total or 0), int(distinct), bar


def _encoded(docs: DataFrame, vocabulary: Words, p: HmmParams, key: str, text: str, train: str) -> DataFrame:
    """Per text its symbols, the sums over frequent words, and its other words with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        v = shared.value
        at = TaskContext.get().partitionId() << 33
        for batch in _parts(batches):
            cols = [[] for _ in range(8)]
            for t in batch.column(2).to_pylist():
                found = words(t)
                ids = np.array([v.symbol.get(w, -1) for w in found] + [v.end], np.int64)
                other = np.flatnonzero(ids < 0)
                rare = [found[i] for i in other]
                kinds = np.array([zlib.crc32(w[-p.ending:]) % p.classes for w in rare], np.int64)
                frequent = ids[ids >= 0]
                ids[other] = v.end + 1 + kinds
                uses = Counter(rare)
                for c, x in zip(cols, (at, len(ids), len(frequent) - int(not v.log_count[v.end]), v.log_count[frequent].sum(),
                                       v.class_log[kinds].sum(), ids.astype("<u4").tobytes(), list(uses), list(uses.values()))):
                    c.append(x)
                at += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    schema = (f"id {kind}, train boolean, row long, n_tokens long, n_frequent long, frequent_log double, class_log double, "
              "symbols binary, words array<binary>, uses array<long>")
    names = ["id", "train", "row", "n_tokens", "n_frequent", "frequent_log", "class_log", "symbols", "words", "uses"]
    return docs.select(F.col(key).alias("id"), F.col(train).alias("train"), F.col(text).alias("text")).mapInArrow(run, schema)


def _sequences(batch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4") for x in batch["symbols"].to_pylist()]


def _round(encoded: DataFrame, m: States, plain: np.ndarray, p: HmmParams) -> States:
    """One Baum-Welch round over all training texts."""
    shared = encoded.sparkSession.sparkContext.broadcast(m)
    s = p.states

    def run(batches):
        m = shared.value
        starts, moves, emits = np.zeros(s), np.zeros((s, s)), np.zeros_like(m.emit)
        for batch in batches:
            parts, begins = segments(_sequences(batch), p.segment)
            for some in chunks(parts, p.chunk):
                a, b, c, _ = expected([parts[i] for i in some], begins[some], m)
                starts += a
                moves += b
                emits += c
        seen = np.flatnonzero(emits.sum(axis=1))
        rows = np.concatenate((starts[None, :], moves, emits[seen]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((np.arange(-1 - s, 0), seen))), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)],
            names=["symbol", *(f"s{i}" for i in range(s))])

    sums = [F.sum(f"s{i}").alias(f"s{i}") for i in range(s)]
    schema = "symbol long, " + ", ".join(f"s{i} double" for i in range(s))
    found = encoded.filter("train").select("symbols").mapInArrow(run, schema).groupBy("symbol").agg(*sums).toArrow()
    table = np.zeros((1 + s + len(plain), s))  # a row for each symbol, move and the start
    table[found["symbol"].to_numpy() + 1 + s] = np.stack([found[f"s{i}"].to_numpy() for i in range(s)], axis=1)
    return _states(table[0], table[1:1 + s], table[1 + s:], plain, p)


def score_texts(docs: DataFrame, train: str, params: HmmParams = HmmParams(), key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, train, n_tokens, n_known, train_tokens, base_score, score``.

    The rows where the boolean column ``train`` holds are learned from, repeated rows each; all are
    scored.  A null text counts as empty: it is one end.  ``score`` is the model's log10
    probability of the whole text, ``base_score`` that of single words with add-one smoothing,
    ``n_known`` the tokens seen in training.  Without training rows every word is unseen.  Other
    columns are not read.
    """
    p = params
    folder = run_dir(docs.sparkSession, "hmm")
    counts = staged(count_words(docs.filter(F.col(train)), p, text), "words", folder)
    vocabulary, plain, total, distinct, bar = _vocabulary(counts, p)
    encoded = staged(_encoded(docs, vocabulary, p, key, text, train), "encoded", folder)

    some = encoded.filter(F.col("train") & (F.col("n_tokens") <= p.start_tokens))
    n = some.count()
    drawn = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, p.start_texts / max(n, 1)))
    first = some.filter(drawn).orderBy("row").select("symbols").toArrow()
    m = _guess(_sequences(first), plain, p)
    for _ in range(p.rounds if total else 0):
        m = _round(encoded, m, plain, p)
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches):
        for batch in batches:
            texts = _sequences(batch)
            found = np.empty(len(texts))
            for part in chunks(texts, p.chunk):
                found[part] = log10_likelihoods([texts[i] for i in part], shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=[*batch.schema.names[:-1], "states_log"])

    kept = ["id", "train", "row", "n_tokens", "n_frequent", "frequent_log", "class_log"]
    schema = ", ".join(f"{c} {encoded.schema[c].dataType.simpleString()}" for c in kept)
    scored = encoded.select(*kept, "symbols").mapInArrow(run, f"{schema}, states_log double")

    each = encoded.select("row", F.explode(F.arrays_zip("words", "uses")).alias("x")).select("row", "x.words", "x.uses")
    rare = counts.filter(F.col("n") < bar).select(F.col("word").alias("words"), "n")
    looked = each.join(rare, "words", "left")
    n = F.coalesce("n", F.lit(0))
    by_text = looked.groupBy("row").agg(F.sum(F.col("uses") * F.log10(n + 1)).alias("rare_log"),
                                        F.sum(F.when(n > 0, F.col("uses")).otherwise(0)).alias("n_rare"))
    out = scored.join(by_text, "row", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    norm = math.log10(total + distinct + 1)
    return out.select(
        "id", "train", "n_tokens", (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("frequent_log") + rare_log - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("states_log") + rare_log - F.col("class_log")).alias("score"))
