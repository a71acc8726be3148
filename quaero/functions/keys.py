"""Stable row keys and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quaero.functions.text import column


def row_key(*cols: Column | str) -> Column:
    """60-bit key: the first 15 hex digits of the md5 of the fields.

    The same row gets the same key in every run, without a sort or a counter.  Fields are
    joined by the unit separator, so that ('a', 'bc') and ('ab', 'c') differ.
    """
    fields = [F.coalesce(column(c).cast("string"), F.lit("")) for c in cols]
    digest = F.md5(F.concat_ws("\x1f", *fields))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def content_hash(*cols: Column | str) -> Column:
    """128-bit change marker; a NULL field differs from an empty one."""
    fields = [F.coalesce(F.concat(F.lit("v"), column(c).cast("string")), F.lit("n")) for c in cols]
    return F.md5(F.concat_ws("\x1f", *fields))
