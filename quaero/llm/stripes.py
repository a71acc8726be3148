"""Collocations by stripes: each phrase keys an associative counter of the words that follow it.

Tasks count stripes (prefix → {next word: occurrences}) over their own texts; stripes of a prefix
are merged element by element.  A merged stripe holds all that the scores need: its entries are the
occurrences of the phrases one word longer, and its largest entry tells whether a longer phrase
subsumes the prefix.  The stripe of the empty prefix has the words, and its total is their number.

Stripes grow by a word from pass to pass.  A phrase can only be frequent if the phrases it holds are,
so a pass counts only where a filter of fixed size has both phrases one word shorter.  What the filter
lets through by chance is counted in vain and changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from quaero.llm import codes, words
from quaero.llm.joins import Sieve, sieve
from quaero.sources.workdir import run_dir, staged

# What parts pieces, what parts words.
_KIND = words.table(space=b" \t", mark=b".,;:!?\n\x0b\x0c\r")
_CUT = re.compile("[ \t.,;:!?\n\x0b\x0c\r]")
_BLANK, _TAB, _LINE = (pa.scalar(x, pa.large_string()) for x in " \t\n")
_END = "\n"  # follows the last word of a piece; no word holds it


@dataclass(frozen=True)
class PhraseParams:
    longest: int = 5            # words of a phrase
    least: int = 100            # occurrences of a candidate
    best: int = 2000            # phrases returned for a group
    filter_bits: int = 1 << 24  # of the filter that is broadcast: 2 MB, whatever the input
    hold: int = 200_000         # entries that a task merges before it hands stripes on
    spread: int = 32            # parts of the stripe of a word, dealt by the next word; longer prefixes have fewer,
    words: int = 8192           # the empty prefix, whose stripe is the vocabulary, more


def _tokens(texts: list[str], carry: int) -> Iterator[tuple[np.ndarray, pa.Array, int]]:
    """(numbers of the words, the words, how many were there before) for parts of the texts.

    Number 0 is the end of a piece.  A text that goes on in the next part hands its last words on.
    """
    carried: list[str] = []
    for bundle in words.bundles(texts, _CUT):
        _, found, marks = words.split([p + _END if last else p for _, p, last in bundle], _KIND, words.LOWER)
        # The first word only makes the end number 0.
        coded = pa.concat_arrays([pa.array([_END, *carried], pa.large_string()), found]).dictionary_encode()
        number = coded.indices.to_numpy()
        after = np.flatnonzero(np.diff(marks, prepend=0))  # words, or the end, behind a mark
        number = np.insert(number, after + 1 + len(carried), 0)[1:]
        yield number, coded.dictionary, len(carried)
        tail = number[max(0, len(number) - carry):]
        carried = [] if bundle[-1][2] else coded.dictionary.take(pa.array(tail)).to_pylist()


def _chain(h: np.ndarray, following: np.ndarray) -> np.ndarray:
    return codes.mix(h * np.uint64(3) + following)


def _phrase_hashes(group: str, phrases: pa.Array, size: int) -> np.ndarray:
    each = words.hashes(pc.split_pattern(phrases, " ").flatten()).reshape(-1, size)
    h = codes.mix(each[:, 0] ^ words.hashes(pa.array([group]))[0])
    for k in range(1, size):
        h = _chain(h, each[:, k])
    return h


def count_phrases(number: np.ndarray, carried: int, size: int, may: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(where a distinct phrase of ``size`` words starts, its occurrences).

    ``may`` tells where a phrase one word shorter starts that may be frequent.
    """
    n = len(number)
    ends = np.flatnonzero(number == 0)
    until = np.append(ends, n)[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # words up to the end of the piece
    start = np.arange(max(0, n - size + 1))
    fits = (until[start] >= size) & (start + size - 1 >= carried)
    if may is not None:
        fits &= may[start] & may[start + 1]
    start = start[fits]
    key = number[start].astype(np.int64)
    many = int(number.max(initial=0)) + 1
    for k in range(1, size):  # numbers of distinct beginnings, so that no two phrases share a key
        if k > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key * many + number[start + k]
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    return start[first], times


_CELLS = 4  # of an entry's line: group, prefix, next word, occurrences
_CHUNK = 8 << 20  # characters of stripes that are taken apart at once
_ENTRIES = pa.schema([("prefix", pa.large_string()), ("next", pa.large_string()), ("n", pa.int64())])


def _count(p: PhraseParams, size: int, known, buckets: int):
    """Stripes of the texts of a task: ``groups, bucket, stripes``, all of a bucket in a row, as one text.

    A stripe is a line for each entry, ``group, prefix, next, n`` between tabs, which no word holds; the
    group is its place in ``groups``.  Entries are dealt to buckets by group, prefix and, for prefixes
    with many followers, by the part of the next word.
    """
    spread = p.words if size == 1 else max(1, p.spread >> 2 * (size - 2))

    def stripes(held: dict[str, list[pa.Table]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        lines, places = [], []
        for i, (group, tables) in enumerate(held.items()):
            merged = _merged(tables)
            prefix, following = merged["prefix"].combine_chunks(), merged["next"].combine_chunks()
            part = words.hashes(following) % np.uint64(spread) + words.hashes(pa.array([group]))[0]
            places.append((codes.mix(words.hashes(prefix) + part) % np.uint64(buckets)).astype(np.int64))
            number = pa.array([str(i)] * len(merged), pa.large_string())
            lines.append(pc.binary_join_element_wise(number, prefix, following, merged["n"].combine_chunks().cast(pa.large_string()), _TAB))
        bucket = np.concatenate(places)
        lines = pa.concat_arrays(lines).take(pa.array(np.argsort(bucket, kind="stable")))
        bucket = np.sort(bucket)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        blobs = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.append(starts, len(bucket))), lines), _LINE)
        names = pa.array([list(held)] * len(starts), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([names, pa.array(bucket[starts].astype(np.int32)), blobs.cast(pa.string())], names=["groups", "bucket", "stripes"])

    def entries(group: str, texts: list[str]) -> Iterator[pa.Table]:
        mark = words.hashes(pa.array([group]))[0]
        for number, vocabulary, carried in _tokens(texts, p.longest - 1):
            may = None
            if known is not None:
                each = words.hashes(vocabulary)
                h = codes.mix(each[number] ^ mark)
                for k in range(1, size - 1):
                    h = _chain(h[:len(number) - k], each[number[k:]])
                may = np.zeros(len(number) + 1, bool)
                may[:len(h)] = known.value.holds(h)
            start, times = count_phrases(number, carried, size, may)
            if len(start):
                each = [vocabulary.take(pa.array(number[start + k])) for k in range(size)]
                prefix = _joined(each[:-1]) if size > 1 else pa.array([""] * len(start), pa.large_string())
                yield pa.Table.from_arrays([prefix, each[-1], pa.array(times, pa.int64())], schema=_ENTRIES)

    def run(batches):
        held: dict[str, list[pa.Table]] = {}
        total = 0
        for batch in batches:
            groups: dict[str, list[str]] = {}
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                groups.setdefault(g, []).append(t)
            for g, texts in groups.items():
                for table in entries(g, texts):
                    held.setdefault(g, []).append(table)
                    total += table.num_rows
                    if total > p.hold:
                        held = {x: [_merged(tables)] for x, tables in held.items()}
                        total = sum(tables[0].num_rows for tables in held.values())
                        if total > p.hold // 2:
                            yield from stripes(held)
                            held, total = {}, 0
                            pa.default_memory_pool().release_unused()
        yield from stripes(held)

    return run


def _joined(each: list) -> pa.Array:
    return pc.binary_join_element_wise(*each, _BLANK) if len(each) > 1 else each[0]


def _merged(tables: list[pa.Table]) -> pa.Table:
    """Counts of equal entries added up."""
    if len(tables) == 1:
        return tables[0]
    both = pa.concat_tables(tables).group_by(["prefix", "next"]).aggregate([("n", "sum")])
    return both.rename_columns({"n_sum": "n"}).select(["prefix", "next", "n"]).cast(_ENTRIES)


def _taken_apart(batches, p: PhraseParams) -> pa.Table:
    """The entries of a bucket, ``grp, prefix, next, n``, rows of stripes added up a part at a time."""
    held: list[pa.Table] = []
    waiting: list[tuple[list, str]] = []
    characters = settled = 0

    def added(tables: list[pa.Table]) -> pa.Table:
        both = pa.concat_tables(tables).group_by(["grp", "prefix", "next"]).aggregate([("n", "sum")])
        return both.rename_columns({"n_sum": "n"}).select(["grp", "prefix", "next", "n"])

    def entries() -> pa.Table:
        lists = pc.split_pattern(pa.array([text for _, text in waiting], pa.large_string()), "\n")
        sizes = pc.list_value_length(lists).to_numpy()
        cells = pc.split_pattern(lists.flatten(), "\t").flatten()
        column = lambda i: cells.take(pa.array(np.arange(i, len(cells), _CELLS)))
        names = [n for groups, _ in waiting for n in groups]
        shift = np.cumsum([0, *(len(groups) for groups, _ in waiting[:-1])])
        group = column(0).cast(pa.int64()).to_numpy() + np.repeat(shift, sizes)
        return pa.table({"grp": pa.array(names, pa.large_string()).take(pa.array(group)), "prefix": column(1),
                         "next": column(2), "n": column(3).cast(pa.int64())})

    for batch in batches:
        for groups, text in zip(batch.column("groups").to_pylist(), batch.column("stripes").to_pylist()):
            waiting.append((groups, text))
            characters += len(text)
            if characters > _CHUNK:
                held.append(added([entries()]))
                waiting, characters = [], 0
                if sum(t.num_rows for t in held) > 2 * settled + p.hold:
                    held = [added(held)]
                    settled = held[0].num_rows
    if waiting:
        held.append(entries())
    return added(held) if held else None


_MERGED = "grp string, prefix string, next string, n long, most long, h long"


def _merge(p: PhraseParams, size: int):
    """Merge the stripes of each prefix element by element.

    A frequent entry is a row.  A row without next word has the total of a part of the empty
    prefix's stripe, or the largest entry of another's.
    """

    def run(batches):
        added = _taken_apart(batches, p)
        if added is not None:
            often = added.filter(pc.greater_equal(added["n"], p.least))
            for g in pc.unique(often["grp"]).to_pylist():
                some = often.filter(pc.equal(often["grp"], g))
                phrases = _joined([some["prefix"], some["next"]] if size > 1 else [some["next"]]).combine_chunks()
                h = _phrase_hashes(g, phrases, size).view(np.int64)
                yield _batch(some["grp"], some["prefix"], some["next"], some["n"], None, h)
            if size == 1:
                total = added.group_by(["grp", "prefix"]).aggregate([("n", "sum")])
                yield _batch(total["grp"], total["prefix"], None, total["n_sum"], None, None)
            elif size > 2 and often.num_rows:
                most = often.group_by(["grp", "prefix"]).aggregate([("n", "max")])
                yield _batch(most["grp"], most["prefix"], None, None, most["n_max"], None)

    return run


def _batch(grp, prefix, following, n, most, h) -> pa.RecordBatch:
    kinds = {"grp": pa.string(), "prefix": pa.string(), "next": pa.string(), "n": pa.int64(), "most": pa.int64(), "h": pa.int64()}
    size = len(grp)
    columns = []
    for value, kind in zip((grp, prefix, following, n, most, h), kinds.values()):
        value = pa.nulls(size, kind) if value is None else value
        value = value.combine_chunks() if isinstance(value, pa.ChunkedArray) else pa.array(value)
        columns.append(value.cast(kind))
    return pa.RecordBatch.from_arrays(columns, names=list(kinds))


def merged_stripes(rows: DataFrame, size: int, p: PhraseParams, known: Sieve | None, folder: str) -> DataFrame:
    """The stripes of all prefixes one word shorter than ``size``, merged, as one written table."""
    context = rows.sparkSession.sparkContext
    shared = None if known is None else context.broadcast(known)
    # A bucket is what a task reads: a task hands on at most a row for each, and no more rows than entries.
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.mapInArrow(_count(p, size, shared, buckets), "groups array<string>, bucket int, stripes string")
    merged = parts.repartitionById(buckets, "bucket").mapInArrow(_merge(p, size), _MERGED)
    return staged(merged, f"stripes-{size}", folder)


def collocations(docs: DataFrame, params: PhraseParams = PhraseParams(), group: str = "lang", text: str = "text") -> DataFrame:
    """``grp, rank, phrase, a, l, r, n, score``: the best phrases of each value of ``group``.

    Texts are lower-cased (A–Z), cut into pieces and words, and a phrase is 2 to ``longest`` words of
    a piece with at least ``least`` occurrences ``a`` in its group of ``n`` words.  Its score is the
    smallest ``1000·a·n / (l·r)``, rounded down, over its cuts into a beginning with ``l`` and a rest
    with ``r`` occurrences; of equal ones the first cut counts.  A phrase inside a longer candidate
    with as many occurrences is dropped.  The ``best`` are ranked by score, then ``a``, then phrase.

    A null group is ``und``, a null text has no words.  Repeated rows count again.  Whole texts are
    read, long ones part by part, and phrases go over the parts' ends.  An empty table gives no row.
    Other columns are not read.
    """
    p = params
    folder = run_dir(docs.sparkSession, "phrases")
    rows = docs.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("grp"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    known, levels = None, []
    for size in range(1, p.longest + 1):
        level = merged_stripes(rows, size, p, known, folder)
        levels.append(level)
        if size < p.longest:
            known = sieve(level.filter("next IS NOT NULL"), "h", p.filter_bits)

    sizes = staged(levels[0].filter("next IS NULL").groupBy("grp").agg(F.sum("n").alias("n")), "sizes", folder)
    often = levels[0].filter("next IS NOT NULL").select("grp", F.col("next").alias("phrase"), F.col("n").alias("f"))
    phrases, longer = None, None
    for size, level in enumerate(levels[1:], 2):
        some = level.filter("next IS NOT NULL").select(
            "grp", F.concat_ws(" ", "prefix", "next").alias("phrase"), F.col("n").alias("f"), F.lit(size).alias("size"))
        # What a phrase subsumes at the same count: its beginning, from the stripe, and its end.
        if size > 2:
            ends = some.select("grp", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase"), F.col("f").alias("most"))
            ends = ends.unionByName(level.filter("next IS NULL").select("grp", F.col("prefix").alias("phrase"), "most"))
            longer = ends if longer is None else longer.unionByName(ends)
        phrases = some if phrases is None else phrases.unionByName(some)
    phrases = staged(phrases, "phrases", folder)
    kept = phrases
    if longer is not None:
        longer = longer.groupBy("grp", "phrase").agg(F.max("most").alias("most"))
        kept = phrases.join(longer, ["grp", "phrase"], "left").filter("most IS NULL OR most < f").drop("most")
    often = staged(often.unionByName(phrases.select("grp", "phrase", "f")), "often", folder)

    word = F.split("phrase", " ")
    cuts = kept.join(sizes, "grp").select(
        "grp", "phrase", F.col("f").alias("a"), "n", word.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("grp", "phrase", "a", "n", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(often.select("grp", F.col("phrase").alias(side), F.col("f").alias(name)), ["grp", side])
    big = {c: f"cast({c} AS decimal(18, 0))" for c in ("a", "n", "l", "r")}
    scored = cuts.withColumn("score", F.expr(f"(1000 * {big['a']} * {big['n']}) div ({big['l']} * {big['r']})"))
    least = scored.groupBy("grp", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x"))
    # In two steps, so that a group with most phrases does not bring them all to one place.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = least.select("grp", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score", F.pmod(F.xxhash64("phrase"), F.lit(32)).alias("salt"))
    for by in (["grp", "salt"], ["grp"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= p.best)
    return ranked.select("grp", "rank", "phrase", "a", "l", "r", "n", "score")
