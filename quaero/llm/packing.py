"""Training sequences with little padding: minimum bin slack over the multiset of piece lengths.

A document is cut into whole windows and one remainder.  Remainders of equal length are alike, so
the multiset is a histogram with as many rows as a window has tokens, whatever the corpus.  On it
the planner fills one window after the other: a subset-sum dynamic programme over bitsets finds
the fullest window that the remaining lengths allow, backtracking gives how many of each length,
and the same filling repeats as long as its lengths last.  Each piece then finds its sequence from
its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import zlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from quaero.sources.workdir import run_dir, staged


@dataclass(frozen=True)
class PackParams:
    vocabulary: str = ""     # path of the tokenizer's file; the public one if empty
    ranks: str = ""          # path of the same vocabulary as ranks; the public one if empty
    pattern: str = public_tokenizers.PATTERN
    window: int = 2048
    end_id: int = 1          # follows each document


class Encoder:
    """Ids of whole texts as the library of the vocabulary's file gives them.

    The same vocabulary as ranks gives the same ids several times faster; texts that its matcher
    gives up on, with endless white space, go to the library itself.
    """

    def __init__(self, p: PackParams):
        self.library = Tokenizer.from_file(p.vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        with open(p.ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=p.pattern, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str | None) -> bytes:
        """Four little-endian bytes for each id."""
        try:
            found = self.fast.encode_to_numpy(text or "", allowed_special="all")
        except ValueError:
            found = self.library.encode(text, add_special_tokens=False).ids
        return np.asarray(found, "<u4").tobytes()


def fullest(counts: dict[int, int], window: int) -> dict[int, int]:
    """How many of each length fill a window closest, each at most ``counts`` times; longer lengths first."""
    reach = 1  # bit s: some choice so far has the sum s
    mask = (1 << window + 1) - 1
    steps = []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], window // length)
        many = 1
        while left:  # 1, 2, 4, ... copies at once
            many = min(many, left)
            steps.append((length, many, reach))
            reach |= reach << length * many & mask
            left -= many
            many *= 2
        if reach >> window & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, many, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + many
            total -= length * many
    return used


def plan(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """Fillings and how often each is used, until nothing remains.  Each use of the planner's loop
    exhausts a length or leaves less of it than the filling takes."""
    left = {length: n for length, n in counts.items() if n and length}
    out = []
    while left:
        used = fullest(left, window)
        times = min(left[length] // n for length, n in used.items())
        out.append((used, times))
        for length, n in used.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return out


def _layout(fillings: list[tuple[dict[int, int], int]]) -> dict[int, list[tuple]]:
    """For each length: (first rank, copies in a window, first sequence, offset) of each use."""
    uses: dict[int, list[tuple]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for used, times in fillings:
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            at = ranks.get(length, 0)
            uses.setdefault(length, []).append((at, n, sequence, offset))
            ranks[length] = at + n * times
            offset += n * length
        sequence += times
    return uses


_PIECE = "doc {}, start long, length long, ids_crc32 long, doc_tokens long, part long, rank long"


def pack(docs: DataFrame, params: PackParams = PackParams(), key: str = "doc_id", text: str = "text",
         ids: bool = False) -> DataFrame:
    """One row per piece: ``doc, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and
    the ``ids`` (four little-endian bytes each) if asked for.

    A document is its ids and ``end_id``; every id lies in one piece.  The pieces of a sequence lie
    gapless from offset 0 and sum to at most ``window``.  A null text counts as empty, which is one
    piece of ``end_id`` alone.  Repeated rows are packed each.  Other columns are not read.
    """
    p = params
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([p.end_id], "<u4").tobytes()

    def cut(batches):
        encoder = Encoder(p)
        part = TaskContext.get().partitionId()
        ranks = [0] * (p.window + 1)
        for batch in batches:
            at, cols = [], [[] for _ in range(7)]
            for i, t in enumerate(batch.column(1).to_pylist()):
                data = memoryview(encoder.ids(t) + end)
                n = len(data) // 4
                for start in range(0, n, p.window):
                    piece = data[start * 4:(start + p.window) * 4]
                    length = len(piece) // 4
                    at.append(i)
                    for c, v in zip(cols, (start, length, zlib.crc32(piece), n, part, ranks[length], bytes(piece) if ids else None)):
                        c.append(v)
                    ranks[length] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in cols[:6]),
                 *([pa.array(cols[6], pa.binary())] if ids else [])], names=names)

    schema = _PIECE.format(kind) + (", ids binary" if ids else "")
    names = [x.split()[0] for x in schema.replace(kind, "x", 1).split(", ")]
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    folder = run_dir(docs.sparkSession, "packing")
    pieces = staged(rows.mapInArrow(cut, schema), "pieces", folder)

    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = staged(by_part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "parts", folder)
    counts = dict(by_part.groupBy("length").agg(F.sum("n")).collect())  # at most ``window`` rows
    uses = _layout(plan(counts, p.window))
    arrays = {length: np.array(u, np.int64) for length, u in uses.items()}
    shared = docs.sparkSession.sparkContext.broadcast(arrays)

    def place(batches):
        layout = shared.value
        for batch in batches:
            lengths = batch["length"].to_numpy()
            ranks = batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                mine = np.flatnonzero(lengths == length)
                u = layout[int(length)]
                use = u[np.searchsorted(u[:, 0], ranks[mine], side="right") - 1]
                nth = ranks[mine] - use[:, 0]
                sequence[mine] = use[:, 2] + nth // use[:, 1]
                offset[mine] = use[:, 3] + nth % use[:, 1] * length
            kept = [batch[n] for n in shown]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*shown, "sequence_id", "offset"])

    shown = [n for n in names if n not in ("part", "rank")]
    places = by_part.select("part", "length", "before").hint("merge")  # grows with the partitions: never broadcast
    ranked = pieces.join(places, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    out = ", ".join(f"{n} {ranked.schema[n].dataType.simpleString()}" for n in shown)
    return ranked.select(*shown, "rank").mapInArrow(place, f"{out}, sequence_id long, offset long")
