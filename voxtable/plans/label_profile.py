"""Label profile of a set of volumes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from voxtable.operators import profile
from voxtable.session import written


class LabelProfile(NamedTuple):
    totals: DataFrame
    incidence: DataFrame
    cases: DataFrame
    lesion_map: DataFrame


def profile_labels(voxels: DataFrame, cases: DataFrame) -> LabelProfile:
    """The voxels are read once; everything follows from the (case, slice, label) pairs."""
    pairs = written(profile.slice_label_pairs(voxels), "pairs")
    return LabelProfile(
        profile.dataset_totals(pairs, cases), profile.label_incidence(pairs),
        profile.case_summary(pairs, cases), profile.lesion_map(pairs, cases),
    )
