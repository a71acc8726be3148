"""Text expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# One token per Han, Hiragana or Katakana character, else one per run of letters and digits.
# Scripts are looked up in a table for each character, so plain letters are asked for first and the
# scripts only from U+2E80 on, where those three begin.
_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
TOKEN_RE = (rf"[a-zA-Z0-9[\p{{L}}\p{{N}}&&[\x00-\x{{2E7F}}[^{_CJK}]]]]+"
            rf"|[\x{{2E80}}-\x{{10FFFF}}&&[{_CJK}]]")
# All characters that count as white space in Unicode.
BLANKS = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
ENDS = ".!?。！？"
SENTENCE_RE = f"[^{ENDS}\n]+[{ENDS}]*"


def column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` any number of times, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(col: Column | str) -> Column:
    """Drop white space, also the ideographic blank, at both ends."""
    return F.btrim(column(col), F.lit(BLANKS))


def tokens(col: Column | str) -> Column:
    return F.regexp_extract_all(column(col), F.lit(TOKEN_RE), F.lit(0))


def token_count(col: Column | str) -> Column:
    return F.regexp_count(column(col), F.lit(TOKEN_RE))


def terms(col: Column | str) -> Column:
    """Lower-cased tokens in text order, with repetitions."""
    return tokens(F.lower(column(col)))


def sentences(col: Column | str) -> Column:
    """Sentences in order, stripped, none empty.

    Same result as all matches of ``SENTENCE_RE``; a negated class with wide characters is slow,
    so the text is cut after each run of end marks and at line breaks.
    """
    cut = rf"(?<=[{ENDS}])(?![{ENDS}])|\n"
    parts = F.filter(F.split(column(col), cut), lambda s: F.btrim(s, F.lit(ENDS)) != "")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def bigrams(term_array: Column) -> Column:
    """Neighbouring term pairs joined by a blank."""
    return let(
        term_array,
        lambda t: F.zip_with(
            F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))),
            F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))),
            lambda a, b: F.concat(a, F.lit(" "), b),
        ),
    )
