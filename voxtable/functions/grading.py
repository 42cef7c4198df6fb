"""Word scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def involvement(share: Column) -> Column:
    """Lesion density of a region in words."""
    return (
        F.when(share < 0.05, "none")
        .when(share < 0.15, "mild")
        .when(share < 0.30, "moderate")
        .otherwise("severe")
    )


def likelihood(score: Column) -> Column:
    return (
        F.when(score >= 0.8, "Very likely")
        .when(score >= 0.6, "Likely")
        .when(score >= 0.4, "Possible")
        .when(score >= 0.2, "Unlikely")
        .otherwise("Very unlikely")
    )


def percent_text(share: Column) -> Column:
    """A share as text with one decimal."""
    return F.format_string("%.1f%%", share * 100.0)


def title(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))
