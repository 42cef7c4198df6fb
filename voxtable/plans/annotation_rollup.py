"""Annotation file to case records and statistics."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from voxtable.operators import annotations
from voxtable.session import written


class Rollup(NamedTuple):
    records: DataFrame
    lesion_marks: DataFrame
    roi_statistics: DataFrame
    categories: DataFrame


def roll_up(rows: DataFrame) -> Rollup:
    """Records are written once; the statistics read them from there."""
    records = written(annotations.case_records(rows), "records")
    return Rollup(
        records, annotations.lesion_mark_counts(rows),
        annotations.roi_statistics(records), annotations.category_counts(records),
    )
