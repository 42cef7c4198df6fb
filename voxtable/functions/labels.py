"""Label arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtable.schema import RELABELLING


def relabelled(label: Column, mapping: dict[int, int] | None = None) -> Column:
    """All replacements at once, so 5→4 and 4→3 do not chain."""
    mapping = RELABELLING if mapping is None else mapping
    out = None
    for old, new in mapping.items():
        out = F.when(label == old, F.lit(new)) if out is None else out.when(label == old, F.lit(new))
    return label if out is None else out.otherwise(label)


def training_label(lesion: Column, lung: Column) -> Column:
    """Lesion labels move up by one and free lung becomes 1 (normal)."""
    return F.when(lesion > 0, lesion + 1).when(lung > 0, F.lit(1)).otherwise(F.lit(0))


def is_class(label: Column, label_id: int) -> Column:
    return label == label_id


def logit_positive(logit: Column, threshold: float = 0.5) -> Column:
    """``sigmoid(logit) > threshold``."""
    return (1 / (1 + F.exp(-logit))) > threshold


def synonym(synonyms: Column, position: Column) -> Column:
    """Caption number ``position`` (from 0) of a label, null beyond the list."""
    return F.try_element_at(synonyms, position.cast("int") + 1)
