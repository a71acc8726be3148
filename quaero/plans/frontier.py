"""K6: the set of pages worth fetching."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quaero.operators import links as L


def url_frontier(pages: DataFrame, blocked: DataFrame | None = None,
                 base: str | None = None) -> DataFrame:
    """Distinct site-relative links of all seed pages, without PDFs and blocked pages."""
    urls = L.drop_suffix(L.distinct_links(pages, base))
    return urls if blocked is None else L.drop_blocked(urls, blocked)
