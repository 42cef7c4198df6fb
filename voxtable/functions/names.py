"""File, slice and export names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ct_file(case: Column, folder: str | None = None) -> Column:
    return F.format_string(f"{_prefix(folder)}CT_%s_0000.nii.gz", case)


def lesion_file(case: Column, folder: str | None = None) -> Column:
    return F.format_string(f"{_prefix(folder)}CT_%s.nii.gz", case)


def mask_file(case: Column, mask_type: Column, folder: str | None = None) -> Column:
    return F.format_string(f"{_prefix(folder)}CT_%s_%s.nii.gz", case, mask_type)


def _prefix(folder: str | None) -> str:
    return "" if folder is None else folder.rstrip("/") + "/"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def case_of_ct_file(name: Column) -> Column:
    """Everything between the first and the last underscore of a CT file name."""
    parts = F.split(F.replace(name, F.lit(".nii.gz"), F.lit("")), "_")
    return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), "_")


def case_of_lesion_file(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("CT_"), F.lit("")), F.lit(".nii.gz"), F.lit(""))


def slice_name(z: Column) -> Column:
    return F.format_string("slice_%03d", z)


def export_name(case: Column, position: Column) -> Column:
    return F.format_string("%s-%03d", case.cast("string"), position)
