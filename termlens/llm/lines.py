"""Line dedup by site-relative frequency, in DataFrame functions alone.

Pages are grouped by host. A line that stands on more than ``ratio`` of a host's pages, and on
at least ``least_pages`` of them, is boilerplate of that host and is dropped from all of its
pages. Pages and lines are counted in partial sums before any shuffle, so a hot host or line
arrives as one row per task. A host has at most (mean distinct lines of its pages / ratio) such
lines, so they are kept as one array per host: a stored table that the planner sends to
the pages where it is small, and joins with each host's pages spread over tasks otherwise.

Defined results: a page without text keeps an empty text; a null or hostless url is the
host ''. A line counts once per page; rows that repeat a page each count. Blank lines are no
lines. An empty table gives an empty one. Columns other than the named ones are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.llm.components import join_spread
from termlens.sources.workspace import materialize

RATIO = 0.1
#: The least that tells a repeated line from a single one.
LEAST_PAGES = 2

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: What holds no text, the tags that end a line, and all other tags.
SILENT = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BREAKS = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]"
    r"|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>"
)
TAG = r"<[^>]*>"


def host(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def markup_lines(html: str) -> Column:
    """The lines of text of a page, in order, trimmed, without blank ones."""
    bare = F.regexp_replace(html, SILENT, "\n")
    bare = F.regexp_replace(F.regexp_replace(bare, BREAKS, "\n"), TAG, "")
    return text_lines(bare)


def text_lines(text: Column | str) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), "[\r\n]")
    return F.filter(F.transform(parts, lambda line: F.regexp_replace(line, r"^[ \t]+|[ \t]+$", "")), lambda line: line != "")


def boilerplate(rows: DataFrame, ratio: float, least_pages: int) -> DataFrame:
    """__host, __common (array of lines) from rows of __host, __lines."""
    totals = rows.groupBy("__host").agg(F.count(F.lit(1)).alias("__pages"))
    counted = (
        rows.select("__host", F.explode(F.array_distinct("__lines")).alias("__line"))
        .groupBy("__host", "__line")
        .agg(F.count(F.lit(1)).alias("__on"))
        .where(F.col("__on") >= least_pages)
    )
    common = join_spread(counted, totals, "__host", "__line").where(F.col("__on") > ratio * F.col("__pages"))
    return common.groupBy("__host").agg(F.collect_list("__line").alias("__common"))


def drop_common_lines(
    pages: DataFrame, site: Column, lines: Column, kept: list[str], ratio: float = RATIO, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """``kept`` columns, host, n_lines, n_dropped, text (the lines left, joined by newlines)."""
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], site.alias("__host"), lines.alias("__lines"))
    rows = materialize(rows, "lines")
    common = materialize(boilerplate(rows, ratio, least_pages), "common-lines")
    joined = join_spread(rows, common, "__host", "__lines", "left")
    left = F.filter("__lines", lambda line: ~F.array_contains(F.coalesce("__common", F.lit([]).cast("array<string>")), line))
    out = joined.withColumn("__left", left)
    return out.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col("__host").alias("host"),
        F.size("__lines").cast("bigint").alias("n_lines"),
        (F.size("__lines") - F.size("__left")).cast("bigint").alias("n_dropped"),
        F.array_join("__left", "\n").alias("text"),
    )


def dedup_page_lines(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, host, n_lines, n_dropped, text of pages (page_id, url, html)."""
    return drop_common_lines(pages, host("url"), markup_lines("html"), ["page_id"], ratio, least_pages)
