"""Recognised text regions, boxes on the image, and small projections of results."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lumenframe.sources.files import small_batches

#: Letters that only Vietnamese has.
VIETNAMESE = "ăâđêôơưĂÂĐÊÔƠƯ"


@F.pandas_udf(StringType())  # a type's name can't be parsed before there is a session
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())  # a type's name can't be parsed before there is a session
def nfd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFD", t), na_action="ignore")


# a filter on what it gives would else evaluate it a second time
nfc = nfc.asNondeterministic()

#: ASCII is its own normal form.
BEYOND_ASCII = r"[^\x00-\x7F]"


def composed(text: Column) -> Column:
    return F.coalesce(nfc(F.when(text.rlike(BEYOND_ASCII), text)), text)


def clean(text: Column) -> Column:
    """Composed, without control characters, white space as single blanks, trimmed. Spark has no normalisation of its own,
    so texts beyond ASCII pass Arrow once; the rest is done in the JVM."""
    shown = F.regexp_replace(composed(text), r"[\p{C}&&[^\t\n\r]]", "")
    return F.regexp_replace(F.regexp_replace(shown, r"(?U)\s+", " "), "^ | $", "")


def decomposed(text: Column) -> Column:
    return F.coalesce(nfd(F.when(text.rlike(BEYOND_ASCII), text)), text)


def unaccented(text: Column) -> Column:
    return _bare(decomposed(text))


def _bare(apart: Column) -> Column:
    return F.regexp_replace(F.translate(apart, "đĐ", "dD"), r"\p{Mn}", "")


def language(text: Column) -> Column:
    """vi for its letters or any accent, en for other ASCII letters, else null."""
    return _language(text, decomposed(text))


def _language(text: Column, apart: Column) -> Column:
    return F.when(text.rlike(f"[{VIETNAMESE}]") | apart.rlike(r"\p{Mn}"), "vi").when(text.rlike("[A-Za-z]"), "en")


def text_regions(regions: DataFrame, threshold: float) -> DataFrame:
    """Regions (text, confidence, language, others kept) of at least ``threshold`` with some text left: raw_text, text,
    unaccented_text, and the language, guessed where it is null or empty. A null confidence counts as 0."""
    small_batches(regions.sparkSession)
    sure = regions.where(F.coalesce("confidence", F.lit(0.0)) >= threshold)
    rows = sure.withColumnRenamed("text", "raw_text").withColumn("text", clean(F.col("raw_text"))).where("text <> ''")
    # taken apart once for both
    apart = rows.withColumn("_apart", decomposed(F.col("text")))
    return apart.withColumns({"unaccented_text": _bare(F.col("_apart")), "language": F.coalesce(F.nullif("language", F.lit("")), _language(F.col("text"), F.col("_apart")))}).drop("_apart")


def within(value: Column, most: Column) -> Column:
    return F.least(most, F.greatest(F.lit(0.0), value))


def polygon_geometry(points: Column, width: Column, height: Column) -> Column:
    """Struct of the area's share of the image and the centre (x, y as shares) of an array of (x, y), kept on the image;
    null without a polygon or an image. Under three points is an error."""
    xs, ys = F.transform(points, lambda p: within(p[0], width)), F.transform(points, lambda p: within(p[1], height))
    span = lambda a: F.array_max(a) - F.array_min(a)
    middle = lambda a: (F.array_max(a) + F.array_min(a)) / 2
    found = F.struct(F.least(F.lit(1.0), span(xs) * span(ys) / (width * height)).alias("area"), (middle(xs) / width).alias("x"), (middle(ys) / height).alias("y"))
    return F.when(F.size(points) < 3, F.raise_error(F.lit("a polygon needs three points"))).when(points.isNotNull() & width.isNotNull() & height.isNotNull(), found)


def box_area(box: Column, width: Column, height: Column) -> Column:
    """Share of the image that a box (left, top, right, bottom) covers; null without an image."""
    side = lambda low, high, most: F.greatest(F.lit(0.0), within(box[high], most) - within(box[low], most))
    return F.when(width.isNotNull() & height.isNotNull(), F.least(F.lit(1.0), side(0, 2, width) * side(1, 3, height) / (width * height)))


def by_largest(rows: DataFrame, score: str, digits: int = 8) -> DataFrame:
    """Divide a score by its largest over all rows (by 1 where that is 0). The largest is one broadcast row, not a window."""
    top = rows.agg(F.max(score).alias("_top"))
    return rows.join(F.broadcast(top)).withColumn(score, F.round(F.col(score) / F.coalesce(F.nullif("_top", F.lit(0.0)), F.lit(1.0)), digits)).drop("_top")


def source_modalities(scores: Column) -> Column:
    """Names of a modality map's entries that aren't zero, sorted; the fused rank score doesn't count as one."""
    return F.array_sort(F.map_keys(F.map_filter(scores, lambda k, v: (v != 0) & (k != "rrf"))))


def outer_object(text: Column) -> Column:
    """From the first brace to the last of a text that holds a JSON object; null where there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
