"""Evaluation of stored predictions against the truth."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from voxtable.operators import overlap
from voxtable.session import written


class Evaluation(NamedTuple):
    class_dice: DataFrame
    macro_dice: DataFrame
    binary_dice: DataFrame
    detection: DataFrame
    background: DataFrame


def evaluate(prediction: DataFrame, truth: DataFrame, slices: DataFrame) -> Evaluation:
    """``slices`` lists every evaluated slice with ``ny`` and ``nx``.

    The voxel comparison is reduced to per-slice counts once; every score reads those.
    """
    compared = written(overlap.compare(prediction, truth), "compared")
    counts = written(overlap.class_overlap(compared, slices), "overlap")
    confusion = written(overlap.slice_overlap(compared, slices), "confusion")
    means = overlap.mean_class_dice(overlap.class_dice(counts))
    return Evaluation(
        means, overlap.macro_dice(means), overlap.mean_smoothed_dice(confusion),
        overlap.detection_metrics(confusion), overlap.background_check(confusion),
    )
