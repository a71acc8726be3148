"""Passages of test items in documents, up to an edit distance.

If an item occurs with at most k edits, two of any k + 2 pieces of it occur unchanged, shifted
against each other by at most k.  So each item is cut into k + 2 pieces, all pieces are looked for
in one pass over a text, and the places around two such hits are verified by Myers' bit-parallel
edit distance.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quaero.sources.workdir import staged


@dataclass(frozen=True)
class EditParams:
    error_share: float = 0.1     # edits per character of an item
    whole_pieces: int = 2        # pieces that must occur unchanged before a distance is computed
    min_chars: int = 20          # shorter items, in their plain form, match unchanged, as whole words
    block_chars: int = 1 << 21   # characters of distinct items that are sent to the tasks at once


MARK = re.compile(r"[^\w\s]|_")


@functools.cache
def _blanked(mark: str) -> str:
    """Punctuation becomes a blank; symbols and combining marks stay."""
    return " " if unicodedata.category(mark)[0] == "P" else mark


def plain(text: str | None) -> str:
    """Lower case, punctuation and white space as single blanks, none at the ends; edits are counted on this."""
    return " ".join(MARK.sub(lambda m: _blanked(m[0]), (text or "").lower()).split())


def budget(length: int, share: float) -> int:
    return int(length * share)


def cut(item: str, n: int) -> list[tuple[int, str]]:
    """``item`` in ``n`` pieces of nearly equal length, with their places."""
    edges = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def within(item: str, window: str, k: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of the whole item to some part of the window, the first
    on ties; nothing beyond ``k`` edits.  One machine step for all rows of the matrix (Myers 1999)."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    best = None
    for end, c in enumerate(window, 1):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = ((eq & plus) + plus ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # a match may start anywhere, so the first row stays 0
        mh = mh << 1 & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
        if score <= k and (best is None or score < best[0]):
            best = score, end
    return best


def _close(hits: list[tuple[int, int]], k: int, need: int) -> list[int]:
    """The starts, in order, that lie in some stretch of k + 1 starts with hits of ``need`` different pieces."""
    if len(hits) < need:
        return []
    hits.sort()
    out: list[int] = []
    held: dict[int, int] = {}
    first = done = 0
    for last, (at, piece) in enumerate(hits):
        held[piece] = held.get(piece, 0) + 1
        while hits[first][0] < at - k:
            gone = hits[first][1]
            held[gone] -= 1
            if not held[gone]:
                del held[gone]
            first += 1
        if len(held) >= need:
            done = max(done, first)
            out += [x for x, _ in hits[done:last + 1]]
            done = last + 1
    return out


def _automaton(words: dict) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, value in words.items():
        out.add_word(word, value)
    if words:
        out.make_automaton()
    return out


class Finder:
    """The items of one block, with the automaton of their pieces."""

    def __init__(self, items: list[tuple], params: EditParams):
        self.items: list[tuple] = []
        short: dict[str, list] = {}
        self.need = max(1, params.whole_pieces)
        found: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            item = plain(text)
            if not item:
                continue
            if len(item) < params.min_chars:
                short.setdefault(f" {item} ", []).append(key)
                continue
            k = budget(len(item), params.error_share)
            for at, piece in cut(item, min(len(item), k + self.need)):
                found.setdefault(piece, []).append((len(self.items), at + len(piece)))
            self.items.append((key, item, k))
        self.pieces = _automaton(found)
        self.short = _automaton({item: (item, keys) for item, keys in short.items()})

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each item the parts of ``text`` that may hold it, merged where they overlap."""
        starts: dict[int, list[tuple[int, int]]] = {}
        for end, uses in self.pieces.iter(text):
            for i, upto in uses:
                starts.setdefault(i, []).append((end + 1 - upto, upto))
        out = {}
        for i, hits in starts.items():
            _, item, k = self.items[i]
            places = _close(hits, k, min(self.need, len(item) - k))
            if not places:
                continue
            merged: list[list[int]] = []
            for at in places:
                lo, hi = max(0, at - k), min(len(text), at + len(item) + k)
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = hi
                else:
                    merged.append([lo, hi])
            out[i] = merged
        return out

    def matches(self, text: str | None) -> Iterator[tuple]:
        """(item key, distance, start, end) of the best match of each item that occurs in the text."""
        t = plain(text)
        if not t:
            return
        if len(self.short):
            seen = set()
            for end, (item, keys) in self.short.iter(f" {t} "):
                if item not in seen:
                    seen.add(item)
                    start = end + 1 - len(item)
                    yield from ((key, 0, start, start + len(item) - 2) for key in keys)
        if not self.items:
            return
        for i, parts in sorted(self.windows(t).items()):
            key, item, k = self.items[i]
            best = None
            for lo, hi in parts:
                if (hit := within(item, t[lo:hi], k)) and (best is None or hit[0] < best[0]):
                    best = hit[0], lo, lo + hit[1]
            if best:
                distance, lo, end = best
                back = within(item[::-1], t[lo:end][::-1], distance)
                yield key, distance, end - back[1], end


_FINDERS: dict[str, Finder] = {}


def _finder(shared) -> Finder:
    """The finder of a block, made once in a worker process for all tasks that it gets."""
    name, items, params = shared.value
    if name not in _FINDERS:
        if len(_FINDERS) > 1:  # two blocks may be in turn in one stage
            _FINDERS.clear()
        _FINDERS[name] = Finder(items, params)
    return _FINDERS[name]


def _distinct(items: DataFrame, text: str) -> DataFrame:
    """``number, text`` of the distinct texts, so that copies of an item are searched once."""
    texts = items.select(F.col(text).alias("text")).filter("text IS NOT NULL").distinct()
    return staged(texts.withColumn("number", F.monotonically_increasing_id()), "items")


def _blocks(texts: DataFrame, params: EditParams) -> Iterator:
    """The texts, broadcast in blocks that end as soon as they hold ``block_chars``.

    The driver holds one block and one part of the texts, which are dealt into parts of about that
    size.
    """
    context = texts.sparkSession.sparkContext
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    held, size = [], 0
    for row in texts.repartition(max(1, 2 * total // params.block_chars), "number").sortWithinPartitions("number").toLocalIterator():
        held.append((row.number, row.text))
        size += len(row.text)
        if size >= params.block_chars:
            yield context.broadcast((uuid.uuid4().hex, held, params))
            held, size = [], 0
    if held:
        yield context.broadcast((uuid.uuid4().hex, held, params))


def find_items(docs: DataFrame, items: DataFrame, params: EditParams = EditParams(), key: str = "doc_id",
               text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc, item, distance, start, end`` for every document row and item that occurs in its text.

    An item occurs if some part of the text is at most ``error_share`` of its length away by edit
    distance, both in plain form (see `plain`); items under ``min_chars`` occur only unchanged, as
    whole words.  The row names the closest such part, the first on
    ties, by places in the plain text.  Null and empty texts and items match nothing.  Repeated
    rows give repeated results; the text of items that repeat is searched once.  Other columns are not
    read.  Long texts are searched whole.  Empty tables give no row.  Each block of items is one pass
    over the documents, without a shuffle.
    """
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    kinds = [docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()]
    schema = f"doc {kinds[0]}, number long, distance long, start long, end long"

    def scan(shared):
        def run(batches):
            finder = _finder(shared)
            for batch in batches:
                at, found = [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    for m in finder.matches(t):
                        at.append(i)
                        found.append(m)
                cols = list(zip(*found)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)],
                    names=["doc", "number", "distance", "start", "end"])

        return rows.mapInArrow(run, schema)

    texts = _distinct(items, item_text)
    out = None
    for shared in _blocks(texts, params):
        out = scan(shared) if out is None else out.unionByName(scan(shared))
    named = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).join(texts, "text").select("number", "item")
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.join(staged(named, "named"), "number").select("doc", "item", "distance", "start", "end")


def drop_contaminated(docs: DataFrame, items: DataFrame, params: EditParams = EditParams(), text: str = "text",
                      item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no item occurs.

    Null and empty texts stay; repeated rows stay or go together; long texts are searched whole.  No
    column is added.  Without items all rows stay.  Each block of items is one pass over the rows
    that the blocks before left.
    """
    at = docs.columns.index(text)

    def scan(shared):
        def run(batches):
            finder = _finder(shared)
            for batch in batches:
                clean = [next(finder.matches(t), None) is None for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for shared in _blocks(_distinct(items, item_text), params):
        docs = docs.mapInArrow(scan(shared), docs.schema)
    return docs
