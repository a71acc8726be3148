"""Token counts of a byte-level BPE vocabulary, by merging many pre-tokens at once.

The symbols of a batch of pre-tokens lie in one ragged array.  In each round every pre-token merges
its own lowest-ranked pair, wherever it occurs, and pre-tokens without a ranked pair leave; what
is left of each are its tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

NAME = "byte_bpe_50k.json"


@dataclass(frozen=True)
class CountParams:
    vocabulary: str = ""             # path of the tokenizer's file; the public one if empty
    pattern: str = public_tokenizers.PATTERN  # of the pre-tokens
    limit: int = 1024
    batch_chars: int = 1 << 20       # text whose pre-tokens are held at once
    cache: int = 300_000             # pre-tokens whose counts a worker remembers

    @property
    def path(self) -> str:
        return self.vocabulary or public_tokenizers.path(NAME)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable in Latin-1,
    else the next unused code point from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


_BREAK = re.compile(r"\S \S")


def segments(text: str, size: int) -> Iterator[str]:
    """The text in pieces of about ``size``; cut before a single blank, where a pre-token begins."""
    at = 0
    while len(text) - at > size and (m := _BREAK.search(text, at + size)):
        yield text[at:m.start() + 1]
        at = m.start() + 1
    yield text[at:]


class Vocabulary:
    """Merge ranks and special strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        self.size = max(vocab.values()) + 1
        self.bytes = np.array([vocab[c] for c in byte_letters()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        special = sorted((t["content"] for t in file.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def parts(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, and how many of these it has."""
        if not self.special or not self.special.search(text):
            return [text], 0
        cut = self.special.split(text)
        return cut[::2], len(cut) // 2

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token."""
        out = np.array([len(w) for w in words], np.int64)
        sizes = out.copy()
        sym = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        own = np.flatnonzero(sizes)  # place in ``out`` of each sequence that is still merged
        sizes = sizes[own]
        never = len(self.ranks)
        while len(own):
            seq = np.repeat(np.arange(len(own)), sizes)
            starts = np.cumsum(sizes) - sizes
            rank = np.full(len(sym), never, np.int64)
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), never - 1)
            known = (self.keys[at] == key) & (seq[:-1] == seq[1:])
            rank[:-1][known] = self.ranks[at[known]]
            low = np.minimum.reduceat(rank, starts)
            out[own] = sizes
            live = low < never
            hit = (rank == low[seq]) & live[seq]
            # In a run such as "aaa" a symbol belongs to one pair only, the first from the left.
            place = np.flatnonzero(hit)
            if not len(place):
                break
            new_run = np.concatenate(([True], np.diff(place) != 1))
            first = place[new_run][np.cumsum(new_run) - 1]
            place = place[(place - first) % 2 == 0]
            sym[place] = self.merged[rank[place]]
            keep = live[seq]
            keep[place + 1] = False
            sizes = np.bincount(seq[keep], minlength=len(own))[live]
            sym, own = sym[keep], own[live]
        return out


class TokenCounter:
    def __init__(self, params: CountParams):
        self.p = params
        self.vocabulary = Vocabulary(params.path)
        self.split = regex.compile(params.pattern).findall
        self.seen: dict[str, int] = {}

    def _learn(self, words: list[list[str]]) -> None:
        new = set().union(*words).difference(self.seen)
        if len(self.seen) + len(new) > self.p.cache:
            self.seen = {}
            new = set().union(*words)
        new = list(new)
        self.seen.update(zip(new, self.vocabulary.counts([w.encode() for w in new]).tolist()))

    def count(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        owners, words, held = [], [], 0

        def flush():
            self._learn(words)
            for i, found in zip(owners, words):
                out[i] += sum(map(self.seen.__getitem__, found))

        for i, text in enumerate(texts):
            parts, out[i] = self.vocabulary.parts(text or "")
            for part in parts:
                for piece in segments(part, self.p.batch_chars):
                    owners.append(i)
                    words.append(self.split(piece))
                    held += len(piece)
                    if held >= self.p.batch_chars:
                        flush()
                        owners, words, held = [], [], 0
        if words:
            flush()
        return out


def token_counts(docs: DataFrame, params: CountParams = CountParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, n_bytes, n_tokens, over_limit``.

    Tokens are those of the whole text without added ones; special strings inside a text are one
    token each, as is the library's default.  A null text counts as empty.  Repeated rows are
    counted each; other columns are not read.
    """

    def run(batches):
        counter = TokenCounter(params)
        for batch in batches:
            n = counter.count(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())],
                                             names=["id", "n_bytes", "n_tokens"])

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    counted = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > params.limit)
