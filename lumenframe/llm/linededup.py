"""Line deduplication by site-relative frequency.

Documents are grouped by host. For each host and line, the host's pages that contain the line are divided by all its
pages; lines beyond the ratio are boilerplate of that host and dropped wherever they occur in it. Pages with equal texts
count as one page, so that copies of a page don't make its content boilerplate. Lines are compared without white space at
their ends; lines of white space alone are neither counted nor dropped.

Null hosts count as the empty string. Null texts stay null. A host has at most (mean lines a page) / ratio boilerplate
lines, whatever its size and however many copies its pages have, so they are joined as one array a host; no host's pages
meet in a task. Lines may be as long as a text. Repeated rows stay; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm._shared import checkpoint, join_groups, packed, quoted, unpacked

RATIO = 0.08
MIN_PAGES = 5


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line, pages, of_pages): lines on at least min_pages pages and more than ratio of their host's pages."""
    pages = docs.select(F.coalesce(quoted(host), F.lit("")).alias("_host"), F.coalesce(quoted(text), F.lit("")).alias("_t")).withColumn("_d", F.xxhash64("_t", F.sha2("_t", 256)))
    # copies: group by the text's digest, not by the text
    totals = checkpoint(pages.groupBy("_host", "_d").agg(F.count(F.lit(1)).alias("_copies")).groupBy("_host").agg(F.count(F.lit(1)).alias("of_pages")))
    lines = pages.select("_host", "_d", F.explode(F.array_distinct(F.transform(F.split("_t", "\n"), _trimmed))).alias("line")).where("line <> ''")
    # different pages with the line's hash bound those with the line from above, and the hashes kept for a host are no more
    # than its mean lines a page / ratio
    lines = lines.withColumn("_line", F.xxhash64("line"))
    seen = lines.groupBy("_host", "_line", "_d").agg(F.count(F.lit(1)).alias("_rows")).groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_pages"))
    often = join_groups(seen.where(F.col("_pages") >= min_pages), totals, ["_host"]).where(F.col("_pages") > F.col("of_pages") * ratio)
    maybe = checkpoint(often.groupBy("_host").agg(F.collect_set("_line").alias("_lines")))
    exact = join_groups(lines, maybe, ["_host"]).where(F.array_contains("_lines", F.col("_line")))
    pages_with = exact.groupBy("_host", "line", "_d").agg(F.count(F.lit(1)).alias("_n")).groupBy("_host", "line").agg(F.count(F.lit(1)).alias("pages"))
    found = join_groups(pages_with, totals, ["_host"]).where((F.col("pages") >= min_pages) & (F.col("pages") > F.col("of_pages") * ratio))
    return found.select(F.col("_host").alias("host"), "line", "pages", "of_pages")


def _arrays(found: DataFrame) -> DataFrame:
    return checkpoint(found.groupBy("_host").agg(F.collect_set(F.xxhash64("line")).alias("_lines")))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Documents with boilerplate lines removed from the text, plus n_lines and n_dropped (longs); all rows stay.

    Input columns stay, whatever their names; those named as the two counts are replaced.
    """
    found = boilerplate(docs, host, text, ratio, min_pages)
    drop = _arrays(found.withColumnRenamed("host", "_host"))
    others = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    rows = join_groups(docs.select(packed([c for c in others if c != text]), quoted(text).alias("_text"), F.coalesce(quoted(host), F.lit("")).alias("_host")), drop, ["_host"], "left")
    all_lines = F.split("_text", "\n")
    stay = F.filter(all_lines, lambda x: (_trimmed(x) == "") | ~F.array_contains("_lines", F.xxhash64(_trimmed(x))))
    rows = rows.withColumn("_stay", F.when(F.col("_lines").isNull(), F.lit(None)).otherwise(stay))
    n = F.when(F.col("_text").isNull(), F.lit(0)).otherwise(F.size(all_lines)).cast("long")
    dropped = F.when(F.col("_stay").isNull(), F.lit(0)).otherwise(F.size(all_lines) - F.size("_stay")).cast("long")
    new = F.when(F.col("_stay").isNull() | (F.size("_stay") == F.size(all_lines)), F.col("_text")).otherwise(F.array_join("_stay", "\n"))
    back = dict(zip([c for c in others if c != text], unpacked([c for c in others if c != text]), strict=True))
    return rows.select(*[new.alias(c) if c == text else back[c] for c in others], n.alias("n_lines"), dropped.alias("n_dropped"))
