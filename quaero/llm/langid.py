"""Language of a text: nearest of several centroids per language, with rejection by distance."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quaero.llm import codes

UNKNOWN = "und"


@dataclass(frozen=True)
class LangParams:
    bins: int = 8192          # hashed n-grams of one to three letters
    clusters: int = 4         # centroids per language
    sample: int = 600         # labelled rows per language that the centroids are fitted on, about
    rounds: int = 10
    starts: int = 4           # of the clustering, the best of which is taken
    support: float = 0.05     # of its language's fitted rows that a centroid must hold
    between: float = 0.2      # where the bar lies between the median cosine of other languages and the own one
    spread: float = 5.0       # without other languages: deviations below the own median
    rows: int = 20            # of either kind that a length needs for a bar of its own


@dataclass(frozen=True)
class LangModel:
    langs: list[str]          # of each centroid
    centroids: np.ndarray     # unit vectors
    idf: np.ndarray
    bars: dict[str, list[float]]  # largest distance by language and power of two of the n-grams
    params: LangParams


def gram_counts(text: str | None, bins: int) -> np.ndarray:
    """Counts of the hashed n-grams of one to three letters of the whole text."""
    out = np.zeros(bins, np.int64)
    for part in codes.word_pieces(text or ""):
        a = codes.words_only(part).astype(np.uint64)
        if not len(a):
            continue
        one = codes.mix(a)
        two = codes.mix(one[:-1] * np.uint64(3) + one[1:])
        three = codes.mix(two[:-1] * np.uint64(5) + one[2:])
        at = np.concatenate((one[a != 32], two, three)) % np.uint64(bins)
        out += np.bincount(at.astype(np.int64), minlength=bins)
    return out


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vector of counts times idf; zero without n-grams."""
    v = counts * idf
    norm = np.sqrt((v * v).sum(axis=-1, keepdims=True))
    return v / np.where(norm == 0, 1, norm)


def _cluster(x: np.ndarray, p: LangParams) -> np.ndarray:
    """Unit centroids by cosine, each with at least ``support`` of the rows.

    Starts are drawn with chances that grow with the distance to those drawn.  A centroid without
    support, be it of odd rows or of rows with a wrong label, gives its rows to the nearest of the
    others, among which they are too few to matter.
    """
    def rounds(c: np.ndarray) -> np.ndarray:
        for _ in range(p.rounds):
            own = np.argmax(x @ c.T, axis=1)
            new = np.array([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
            c = new / np.linalg.norm(new, axis=1, keepdims=True)
        return c

    best, value = None, -np.inf
    for seed in range(p.starts):
        draw = np.random.default_rng(seed)
        centres = [x[draw.integers(len(x))]]
        near = x @ centres[0]
        while len(centres) < min(p.clusters, len(x)):
            far = np.clip(1 - near.astype(np.float64), 0, None) ** 2
            if far.sum() < 1e-12:
                break
            centres.append(x[draw.choice(len(x), p=far / far.sum())])
            near = np.maximum(near, x @ centres[-1])
        c = rounds(np.array(centres))
        while True:  # rows that a centroid loses may leave another without support
            held = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
            some = held >= min(p.support * len(x), held.max())
            if some.all():
                break
            c = rounds(c[some])
        total = float((x @ c.T).max(axis=1).sum())
        if total > value:
            best, value = c, total
    return best


def _quantile(counts: dict[int, int], share: float) -> float:
    """The cosine below which ``share`` of the rows lie, from rows by thousandths of it."""
    left = share * sum(counts.values())
    for c in sorted(counts):
        left -= counts[c]
        if left <= 0:
            return c / 1000
    return max(counts) / 1000


def _bars(own: dict[int, dict[int, int]], others: dict[int, dict[int, int]], p: LangParams) -> list[float]:
    """Largest distance by length, from rows by length and thousandths of the cosine, not smaller for shorter texts.

    The bar lies between the medians of the language's own rows and of all others' to its centroids,
    which a few odd or wrong labels do not move.  Lengths with few rows count together with the next
    shorter ones.
    """
    bars = [2.0] * 64
    lowest, upto = 1.0, 64
    for band in sorted(own, reverse=True):
        pools = []
        for side in (own, others):
            pool: dict[int, int] = {}
            for at in range(band, upto):
                for c, n in side.get(at, {}).items():
                    pool[c] = pool.get(c, 0) + n
            pools.append(pool)
        mine, rest = pools
        enough = sum(mine.values()) >= p.rows and (not others or sum(rest.values()) >= p.rows)
        if not enough and band != min(own):
            continue
        middle = _quantile(mine, 0.5)
        if others and rest:
            low = _quantile(rest, 0.5)
            bar = low + p.between * max(0.0, middle - low)
        else:  # the distance from the median to the lowest tenth is 1.28 deviations of a normal tail
            bar = middle - p.spread * (middle - _quantile(mine, 0.1)) / 1.2816 - sum(mine.values()) ** -0.5 / 10
        lowest = min(lowest, bar)
        bars[band:upto] = [1 - lowest] * (upto - band)
        upto = band
    return bars


def fit(docs: DataFrame, params: LangParams = LangParams(), key: str = "doc_id", text: str = "text",
        label: str = "lang") -> LangModel:
    """Learn idf and bars from all labelled rows, centroids from about ``sample`` rows per language.

    Rows with a null label, or whose text has no letter, teach nothing.  Without any labelled
    row the model knows no language.
    """
    bins = params.bins
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("y")).filter(
        "y IS NOT NULL AND t IS NOT NULL")

    def document_counts(batches):
        seen, n = np.zeros(bins, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts = gram_counts(t, bins)
                seen += counts > 0
                n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"bin": np.append(at, -1), "n": np.append(seen[at], n)})

    found = dict(rows.select("t").mapInArrow(document_counts, "bin long, n long")
                 .groupBy("bin").agg(F.sum("n")).collect())  # at most bins + 1 rows
    total = found.pop(-1, 0)
    df = np.zeros(bins)
    df[list(found)] = list(found.values())
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)

    # One row per language: how many labelled rows it has.
    sizes = dict(rows.groupBy("y").count().collect())
    if not sizes:
        return LangModel([], np.zeros((0, bins), np.float32), idf, {}, params)
    share = F.create_map(*[F.lit(x) for y, n in sizes.items() for x in (y, params.sample / n)])
    drawn = F.pmod(F.xxhash64(F.col("k").cast("string"), "t"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # Equal texts count once, so neither a key nor a text that many rows repeat fills the sample.
    sampled = rows.filter(drawn < share[F.col("y")]).groupBy("y", F.md5("t").alias("h")).agg(F.first("t").alias("t"))

    def vectors(batches):
        for batch in batches:
            out = {"y": [], "v": [], "size": []}
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = gram_counts(t, bins)
                if n := int(counts.sum()):
                    out["y"].append(y)
                    out["v"].append(vector(counts, idf).astype(np.float32).tobytes())
                    out["size"].append(n)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("y", pa.string()), ("v", pa.binary()), ("size", pa.int64())]))

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "v"])
        x = np.frombuffer(b"".join(group.v), np.float32).reshape(len(group), bins)
        c = _cluster(x, params)
        return pd.DataFrame({"y": group.y.iloc[0], "c": [r.astype(np.float32).tobytes() for r in c]})

    learned = (sampled.select("t", "y").mapInArrow(vectors, "y string, v binary, size long")
               .groupBy("y").applyInPandas(centroids, "y string, c binary").collect())
    learned.sort(key=lambda r: (r.y, r.c))
    langs = [r.y for r in learned]
    centres = np.frombuffer(b"".join(r.c for r in learned), np.float32).reshape(len(learned), bins)
    shared = docs.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(centres.T), idf))

    def cosines(batches):
        """Rows by language, length and thousandths of the cosine: own rows that are nearest to their label, and all others."""
        langs, centres, idf = shared.value
        names = sorted(set(langs))
        of = np.array([names.index(x) for x in langs])
        found: dict[tuple, int] = {}
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start in range(0, len(texts) if langs else 0, 64):
                counts = np.array([gram_counts(t, bins) for t in texts[start:start + 64]])
                near = vector(counts, idf).astype(np.float32) @ centres
                for row, n, y in zip(near, counts.sum(axis=1), labels[start:start + 64]):
                    if not n:
                        continue
                    nearest = names[of[int(np.argmax(row))]]
                    for i, name in enumerate(names):
                        if name != y or nearest == y:
                            at = name, name == y, int(np.log2(n)), max(0, int(1000 * row[of == i].max()))
                            found[at] = found.get(at, 0) + 1
        yield pa.RecordBatch.from_pydict(
            {"y": [a[0] for a in found], "own": [a[1] for a in found], "band": [a[2] for a in found], "c": [a[3] for a in found],
             "n": list(found.values())},
            schema=pa.schema([("y", pa.string()), ("own", pa.bool_()), ("band", pa.int64()), ("c", pa.int64()), ("n", pa.int64())]))

    # At most some thousand rows per language, whatever the input.
    seen: dict[str, tuple[dict, dict]] = {y: ({}, {}) for y in langs}
    for r in rows.select("t", "y").mapInArrow(cosines, "y string, own boolean, band long, c long, n long").groupBy("y", "own", "band", "c").agg(
            F.sum("n").alias("n")).collect():
        seen[r.y][0 if r.own else 1].setdefault(r.band, {})[r.c] = r.n
    bars = {y: _bars(*seen[y], params) for y in langs}
    return LangModel(langs, centres, idf, bars, params)


def _shared(docs: DataFrame, model: LangModel):
    return docs.sparkSession.sparkContext.broadcast(
        (model.langs, np.ascontiguousarray(model.centroids.T), model.idf, model.bars, model.params))


def _labels(texts: list[str | None], langs, centroids, idf, bars, p: LangParams) -> list[tuple[str, float, bool]]:
    """Language, cosine and rejection of each text."""
    out = []
    for start in range(0, len(texts), 64):
        counts = np.array([gram_counts(t, p.bins) for t in texts[start:start + 64]])
        near = vector(counts, idf).astype(np.float32) @ centroids
        for row, n in zip(near, counts.sum(axis=1)):
            if not n or not langs:
                out.append((UNKNOWN, 0.0, not n))
                continue
            i = int(np.argmax(row))
            score = float(min(1.0, max(0.0, row[i])))
            out.append((langs[i], score, bool(score < 1 - bars[langs[i]][int(np.log2(n))])))
    return out


def predict(docs: DataFrame, model: LangModel, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns plus ``lang_pred, score, rejected`` for every row.

    A null text or one without letters is ``und`` with score 0 and is rejected.  Otherwise the
    nearest centroid names the language, ties going to the first by name; ``score`` is the cosine,
    not below 0.  ``rejected`` marks texts whose cosine is under the bar of that language and like
    length, which lies ``between`` that of other languages' labelled texts and its own.  Texts shorter than all
    in training are not rejected, as nothing tells how far those may be; nor is any by a model that
    knows no language, which calls all ``und``.  Columns of ``keep`` with the names of results give
    way to these.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score", "rejected")]
    shared = _shared(docs, model)

    def run(batches):
        for batch in batches:
            found = _labels(batch.column(at).to_pylist(), *shared.value)
            cols = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())],
                names=[*keep, "lang_pred", "score", "rejected"])

    at = keep.index(text) if text in keep else len(keep)
    rows = docs.select(*keep, *([] if text in keep else [F.col(text).alias("_text")]))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double, rejected boolean")


def drop_unknown(docs: DataFrame, model: LangModel, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text `predict` does not reject.

    Null texts and texts without letters go; repeated rows all stay or all go.  Long texts are read
    whole.  No column is added, so none clashes; an empty table stays empty.
    """
    at = docs.columns.index(text)
    shared = _shared(docs, model)

    def run(batches):
        for batch in batches:
            found = _labels(batch.column(at).to_pylist(), *shared.value)
            yield batch.filter(pa.array([not rejected for _, _, rejected in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
