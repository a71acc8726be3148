"""URL frontier operators (G1, G2, B3, B4, D-1, F1, C1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quaero.functions import html as H
from quaero.functions.arrays import exploded

ORIGIN_RE = r"^(https?://[^/?#]+)"

# Link lists, the gallery, foreign-language pages and event pages of a school site.
BLOCKED_PATHS = (
    "/sitemap/", "/work_books/", "/blog/", "/gallery/",
    "/visitor/language/ko/about/", "/visitor/language/en/about/", "/visitor/language/ch/about/",
    "/opencampus/", "/opencampus/program/special-event/",
    "/opencampus/program/experience-lesson/", "/opencampus/program/exam/",
    "/opencampus/program/school-briefing/",
)


def page_links(pages: DataFrame, base: str | None = None) -> DataFrame:
    """One row per site-relative link, made absolute against the page's origin or ``base``."""
    origin = F.lit(base) if base else F.regexp_extract("url", ORIGIN_RE, 1)
    href = F.col("href")
    return (
        exploded(pages, [origin.alias("origin")], H.links("html"), "href")
        .where(href.startswith("/") & ~href.startswith("//") & ~href.contains("http"))
        .select(F.concat("origin", "href").alias("url"))
    )


def distinct_links(pages: DataFrame, base: str | None = None) -> DataFrame:
    return page_links(pages, base).distinct()


def union_frontiers(*frontiers: DataFrame) -> DataFrame:
    """Set union of several link sets; one distinct over all of them."""
    merged = frontiers[0].select("url")
    for other in frontiers[1:]:
        merged = merged.union(other.select("url"))
    return merged.distinct()


def drop_suffix(urls: DataFrame, suffix: str = "pdf") -> DataFrame:
    return urls.where(~F.col("url").endswith(suffix))


def drop_blocked(urls: DataFrame, blocked: DataFrame) -> DataFrame:
    """Anti-join against a blocklist; an absent entry is no error.

    No hint is set: Spark broadcasts the list only if its size allows it.
    """
    return urls.join(blocked.select("url"), "url", "left_anti")


def site_blocklist(spark, base: str, paths=BLOCKED_PATHS) -> DataFrame:
    return spark.createDataFrame([(base + p,) for p in paths], "url string")
