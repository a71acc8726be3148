"""Chunking (G6-G10, E5, D-2, B6): everything happens within the row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quaero.functions import html as H
from quaero.functions.arrays import exploded
from quaero.functions.text import column, let, strip, token_count, tokens
from quaero.params import Params

# From coarse to fine; each piece keeps its separator, so the pieces always add up to the text.
# The last step cuts after a number of characters, none of which holds more than one token.
SEPARATORS = (
    r"(?s).*?\n\n|(?s).+\z",
    r"(?s).*?\n|(?s).+\z",
    r"(?s).*?[.!?。！？]\s|(?s).+\z",
    r"(?s).*?\s|(?s).+\z",
)


def page_text(sections: Column | str) -> Column:
    """All section bodies in order, without a separator."""
    return F.array_join(F.transform(column(sections), lambda s: s["body"]), "")


def _merged(sized: Column, limit: int) -> Column:
    """Greedy merge of ``array<struct<t, n, h>>`` to ``array<struct<t, h>>``; a buffer has its first ``h``."""
    buffer = "array<struct<t:string,h:string>>"
    start = F.struct(F.lit("").alias("buf"), F.lit(0).alias("n"), F.lit("").alias("h"),
                     F.array().cast(buffer).alias("out"))

    def step(acc, s):
        fits = acc["n"] + s["n"] <= limit
        return F.struct(
            F.when(fits, F.concat(acc["buf"], s["t"], F.lit("\n")))
            .otherwise(F.concat(s["t"], F.lit("\n"))).alias("buf"),
            F.when(fits, acc["n"] + s["n"]).otherwise(s["n"]).alias("n"),
            F.when(fits & (acc["buf"] != ""), acc["h"]).otherwise(s["h"]).alias("h"),
            F.when(fits, acc["out"]).otherwise(F.concat(acc["out"], closed(acc))).alias("out"),
        )

    def closed(acc):
        return F.array(F.struct(acc["buf"].alias("t"), acc["h"].alias("h")))

    merged = F.aggregate(sized, start, step, lambda acc: F.concat(acc["out"], closed(acc)))
    return F.filter(F.transform(merged, lambda b: F.struct(strip(b["t"]).alias("t"), b["h"].alias("h"))),
                    lambda b: b["t"] != "")


def merge_texts(texts: Column | str, limit: int) -> Column:
    """Greedy merge of neighbours while the sum stays within ``limit`` tokens.

    A text that does not fit starts the next buffer, whatever its size.  Counting each text once
    is enough, because a buffer ends in a line break and tokens never reach across one.
    """
    sized = F.transform(column(texts), lambda t: F.struct(
        t.alias("t"), token_count(t).alias("n"), F.lit("").alias("h")))
    return F.transform(_merged(sized, limit), lambda b: b["t"])


def merge_sections(sections: Column | str, limit: int) -> Column:
    """`merge_texts` of heading, line break and body of each section (S7), as ``array<struct<t, h>>``
    with the heading that a buffer starts with."""
    sized = F.transform(column(sections), lambda s: let(
        F.concat(s["heading"], F.lit("\n"), s["body"]),
        lambda t: F.struct(t.alias("t"), token_count(t).alias("n"), s["heading"].alias("h"))))
    return _merged(sized, limit)


def _atoms(text: Column, size: int, level: int = 0) -> Column:
    if level == len(SEPARATORS):
        return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))
    pieces = F.regexp_extract_all(text, F.lit(SEPARATORS[level]), F.lit(0))
    return F.flatten(F.transform(
        pieces,
        lambda p: F.when(token_count(p) <= size, F.array(p)).otherwise(_atoms(p, size, level + 1)),
    ))


def _pack(atoms: Column, size: int, overlap: int) -> Column:
    """Greedy packing of atoms; each new chunk starts with the last atoms that fit the overlap.

    One pass: the state is the first atom of the chunk and its tokens so far.  Where a chunk ends,
    its own atoms are looked at once to find those that the next one starts with.
    """
    counted = F.transform(atoms, lambda a: F.struct(a.alias("t"), token_count(a).alias("n")))

    def windows(sized):
        first = F.struct(F.lit(1).alias("lo"), F.lit(0).alias("n"),
                         F.array().cast("array<struct<lo:int,n:int>>").alias("out"))

        def skipped(acc, i, c):
            """Atoms at the chunk's start, and their tokens, that go so that the rest fits."""
            limit = F.greatest(acc["n"] - overlap, acc["n"] + c - size)
            return F.aggregate(
                F.slice(sized, acc["lo"], i - acc["lo"]), F.struct(F.lit(0).alias("k"), F.lit(0).alias("s")),
                lambda a, x: F.when(a["s"] >= limit, a).otherwise(
                    F.struct((a["k"] + 1).alias("k"), (a["s"] + x["n"]).alias("s"))))

        def step(acc, i):
            c = F.element_at(sized, i)["n"]
            cut = lambda gone: F.struct(
                (acc["lo"] + gone["k"]).alias("lo"), (acc["n"] - gone["s"] + c).alias("n"),
                F.concat(acc["out"], F.array(F.struct(
                    acc["lo"].alias("lo"), (i - acc["lo"]).alias("n")))).alias("out"))
            longer = F.struct(acc["lo"].alias("lo"), (acc["n"] + c).alias("n"), acc["out"].alias("out"))
            return F.when(acc["n"] + c <= size, longer).otherwise(let(skipped(acc, i, c), cut))

        return F.aggregate(
            F.sequence(F.lit(1), F.size(sized)), first, step,
            lambda acc: F.concat(acc["out"], F.array(F.struct(
                acc["lo"].alias("lo"), (F.size(sized) - acc["lo"] + 1).alias("n")))))

    return let(counted, lambda sized: F.transform(
        windows(sized),
        lambda w: strip(F.array_join(
            F.transform(F.slice(sized, w["lo"], w["n"]), lambda a: a["t"]), ""))))


def recursive_split(text: Column | str, size: int, overlap: int) -> Column:
    """Cut a text into chunks of at most ``size`` tokens that share up to ``overlap`` tokens.

    Cuts fall at the coarsest separator that yields small enough pieces: blank line, line,
    sentence, white space, and only then inside a run of characters.
    """
    t = column(text)
    chunks = F.when(token_count(t) <= size, F.array(t)).otherwise(
        _pack(_atoms(t, size), size, overlap))
    return F.filter(chunks, lambda c: c != "")


def fixed_windows(text: Column | str, size: int, overlap: int) -> Column:
    """Windows of ``size`` tokens, each starting ``size - overlap`` after the one before it."""
    return let(tokens(text), lambda t: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(t) - overlap - 1, F.lit(0)), F.lit(size - overlap)),
        lambda i: F.slice(t, i + 1, F.lit(size))))


def chunk_sections(sections: Column | str, params: Params) -> Column:
    """``array<struct<content, heading>>``: small neighbours merged, what is too large cut, what is
    too small dropped (S9, S10).  All pieces of a buffer have its heading."""
    merged = merge_sections(sections, params.merge_tokens)
    cut = F.flatten(F.transform(merged, lambda b: F.transform(
        recursive_split(b["t"], params.chunk_tokens, params.overlap_tokens),
        lambda c: F.struct(c.alias("content"), b["h"].alias("heading")))))
    return F.filter(cut, lambda c: token_count(c["content"]) > params.min_tokens)


def chunk_articles(articles: DataFrame, params: Params = Params()) -> DataFrame:
    """``articles(url, title, text)`` to one row per chunk, numbered from 1 within its page.

    ``heading`` is that of the section which the chunk starts with, or was cut from; '' without one.

    An article without text has no chunks.  There is no filter for it: Spark would move that
    below the extraction and extract twice.
    """
    kept = [c for c in articles.columns if c != "text"]
    sectioned = articles.select(
        *kept, H.split_sections(H.decode_rare_entities("text"), params.heading_tag)
        .alias("sections"))
    chunked = sectioned.select(
        *kept, page_text("sections").alias("page_contents"),
        chunk_sections("sections", params).alias("chunks"))
    rows = exploded(chunked, [*kept, "page_contents", F.size("chunks").alias("n_chunks")],
                    F.col("chunks"), "chunk", "pos")
    return rows.select("*", "chunk.content", "chunk.heading", (F.col("pos") + 1).alias("chunk_no")).drop("pos", "chunk")
