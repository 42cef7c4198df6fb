"""Annotation text: disease pattern from the file id, term translation, class roll-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtable.schema import AXIAL_TERMS, MANIFESTATION_TERMS


def disease_pattern(file_id: Column) -> Column:
    """File id without digits and white space; ``Unknown`` when nothing is left."""
    # (?U): also full-width digits and spaces.
    rest = F.regexp_replace(file_id, r"(?U)[\d\s]+", "")
    return F.when(rest == "", F.lit("Unknown")).otherwise(rest)


def _translated(term: Column, names: dict[str, str]) -> Column:
    pairs = [F.lit(text) for item in names.items() for text in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), term), term)


def axial_name(term: Column) -> Column:
    """English axial term; unknown terms pass through."""
    return _translated(term, AXIAL_TERMS)


def manifestation_name(term: Column) -> Column:
    """English manifestation term; unknown terms pass through."""
    return _translated(term, MANIFESTATION_TERMS)


def zero_based_layer(layer: Column) -> Column:
    """Slice number counted from 0; fractions are cut off, unreadable text and numbers out of range give null."""
    return layer.try_cast("double").try_cast("int") - 1


def or_unknown(term: Column) -> Column:
    return F.coalesce(term, F.lit("unknown"))


def five_class(pattern: Column) -> Column:
    """UIP, NSIP and OP stay; every other disease pattern is ``Other``."""
    return F.when(pattern.isin("UIP", "NSIP", "OP", "Normal"), pattern).otherwise(F.lit("Other"))
