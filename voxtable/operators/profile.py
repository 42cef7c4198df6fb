"""Label profiles of sparse or dense voxel tables, and relabelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.functions.labels import relabelled
from voxtable.functions.names import slice_name
from voxtable.schema import RELABELLING


def slice_label_pairs(voxels: DataFrame, label: str = "lesion") -> DataFrame:
    """Distinct (case, slice, label) above the background: all other profiles read this."""
    return voxels.where(F.col(label) != 0).select("case_id", "z", F.col(label).alias("label")).distinct()


def slice_label_sets(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("case_id", "z").agg(F.sort_array(F.collect_set("label")).alias("labels"))


def lesion_slices(pairs: DataFrame) -> DataFrame:
    """Slices with lesions of every case that has some, ascending."""
    return pairs.groupBy("case_id").agg(F.sort_array(F.collect_set("z")).alias("layers"))


def label_incidence(pairs: DataFrame) -> DataFrame:
    """Cases and slices each label occurs in."""
    per_case = pairs.groupBy("label", "case_id").agg(F.count("*").alias("slices"))
    return per_case.groupBy("label").agg(F.count("*").alias("patients"), F.sum("slices").alias("slices"))


def case_summary(pairs: DataFrame, cases: DataFrame) -> DataFrame:
    """Lesion slices and label set of every case, also without lesions."""
    found = pairs.groupBy("case_id").agg(
        F.size(F.collect_set("z")).alias("lesion_slices"), F.sort_array(F.collect_set("label")).alias("labels")
    )
    return cases.select("case_id").join(found, "case_id", "left").select(
        "case_id",
        F.coalesce("lesion_slices", F.lit(0)).alias("lesion_slices"),
        F.coalesce("labels", F.array().cast("array<int>")).alias("labels"),
    )


def dataset_totals(pairs: DataFrame, cases: DataFrame) -> DataFrame:
    summary = case_summary(pairs, cases)
    labels = F.sort_array(F.array_distinct(F.flatten(F.collect_set("labels"))))
    return summary.agg(
        F.count("*").alias("patients"), F.sum("lesion_slices").alias("lesion_slices"), labels.alias("labels")
    )


def lesion_map(pairs: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case the lesion slices and a map from slice name to labels."""
    named = slice_label_sets(pairs).groupBy("case_id").agg(
        F.sort_array(F.collect_list(F.struct("z", "labels"))).alias("slices")
    )
    rows = cases.select("case_id").join(named, "case_id", "left")
    empty = F.array().cast("array<struct<z:int,labels:array<int>>>")
    slices = F.coalesce("slices", empty)
    entries = F.transform(slices, lambda s: F.struct(slice_name(s["z"]), s["labels"]))
    return rows.select(
        "case_id",
        F.transform(slices, lambda s: s["z"]).alias("roi_layers_with_lesions"),
        F.map_from_entries(entries).alias("slice_lesion_labels"),
    )


def relabel(voxels: DataFrame, mapping: dict[int, int] | None = None, label: str = "lesion") -> DataFrame:
    return voxels.withColumn(label, relabelled(F.col(label), mapping))


def relabel_counts(voxels: DataFrame, mapping: dict[int, int] | None = None, label: str = "lesion") -> DataFrame:
    """Per case and mapped label: voxels before, and voxels with the new label after.

    The count after includes voxels that carried the new label all along.
    """
    mapping = RELABELLING if mapping is None else mapping
    counts = voxels.groupBy("case_id", label).agg(F.count("*").alias("n"))
    new = relabelled(F.col(label), mapping)
    before = [F.sum(F.when(F.col(label) == old, F.col("n")).otherwise(0)).alias(f"before_{old}") for old in mapping]
    after = [F.sum(F.when(new == value, F.col("n")).otherwise(0)).alias(f"after_{value}") for value in dict.fromkeys(mapping.values())]
    moved = F.sum(F.when(F.col(label).isin(*mapping), F.col("n")).otherwise(0)).alias("total_converted")
    return counts.groupBy("case_id").agg(*before, *after, moved)
