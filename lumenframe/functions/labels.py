"""Text and labels of nested modality records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(c: Column) -> Column:
    """Null where a text is empty or blank."""
    return F.when(F.trim(c) != "", c)


def labels_of(objects: Column) -> Column:
    """Distinct labels in order of an array of structs (label, class_name): the label, else the class; empty ones left out."""
    names = F.transform(objects, lambda o: F.coalesce(filled(o["label"]), filled(o["class_name"])))
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull()))


def labels_in(text: Column) -> Column:
    """Distinct labels in order of a comma-separated text."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != ""))


def modality_text(caption: Column, regions: Column, labels: Column) -> Column:
    """The caption, else the texts of the recognised regions (structs with text), else the labels; empty if there is none."""
    joined = F.array_join(F.filter(F.transform(regions, lambda r: r["text"]), lambda t: F.trim(t) != ""), " ")
    return F.coalesce(filled(caption), filled(joined), filled(F.array_join(labels, " ")), F.lit(""))
