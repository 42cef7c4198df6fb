"""Training slices from volumes: cleaning, windowing, regridding, labels, strata and split."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxtable.functions.intensity import unit_scaled
from voxtable.functions.joins import looked_up, shuffled
from voxtable.functions.names import export_name
from voxtable.operators import profile, sampling, slices
from voxtable.operators.components import clean_labels
from voxtable.session import written


def _merged(size: int, schema: T.StructType):
    """Image and label rows of one slice, met as arrays and copied onto ``size × size`` by the nearest neighbour."""
    arrow = to_arrow_schema(schema)

    def run(key: tuple, image: pa.Table, labels: pa.Table) -> pa.Table:
        if not image.num_rows:
            return arrow.empty_table()
        first = image.slice(0, 1).to_pylist()[0]
        ny, nx = first["ny"], first["nx"]
        planes = np.zeros((4, ny, nx), np.int32)
        at = image["y"].to_numpy(), image["x"].to_numpy()
        for plane, values in zip(planes, (image["byte"].to_numpy(), image["lung"].to_numpy(), np.ones(image.num_rows, np.int32))):
            plane[at] = values
        if labels.num_rows:
            planes[3][labels["y"].to_numpy(), labels["x"].to_numpy()] = labels["lesion"].to_numpy()
        low, high = planes[0][at].min(), planes[0][at].max()
        # Destination i reads source floor((i + 1/2) · n / size).
        rows, columns = ((2 * np.arange(size) + 1) * n // (2 * size) for n in (ny, nx))
        copied = planes[:, rows[:, None], columns]
        y, x = np.nonzero(copied[2])
        n = len(y)
        fixed = {c: pa.array([first[c]] * n, arrow.field(c).type) for c in ("case_id", "z", "i", "name")}
        found = {"y": y, "x": x, "byte": copied[0][y, x], "lung": copied[1][y, x], "lesion": copied[3][y, x], "low": np.full(n, low), "high": np.full(n, high)}
        return pa.table([fixed[f.name] if f.name in fixed else pa.array(found[f.name], f.type) for f in arrow], schema=arrow)

    return run


def training_pixels(
    voxels: DataFrame, cases: DataFrame, size: int, min_voxels: int = 1000, min_pixels: int = 100
) -> DataFrame:
    """Regridded pixels (``unit``, ``lesion``, ``lung``, ``label``) of slices with cleaned lesions.

    ``i`` numbers the kept slices of a case from 0. Image and labels meet slice by slice as arrays, so pixels cross the network once, by slice.
    """
    cleaned = written(clean_labels(voxels, min_voxels, min_pixels), "cleaned")
    kept = slices.kept_slices(cleaned)
    # Only kept slices go on; the window's limits come from one aggregate per case.
    images = voxels.drop("lesion")
    image = looked_up(slices.windowed(images.join(shuffled(kept), ["case_id", "z"]), volumes=images), cases.select("case_id", "ny", "nx"), ["case_id"])
    whole = lambda *names: [F.col(c).cast("int").alias(c) for c in names]
    image = image.select("case_id", *whole("z", "i"), "name", *whole("ny", "nx", "y", "x", "byte", "lung"))
    schema = T.StructType([image.schema[c] for c in ("case_id", "z", "i", "name")] + [T.StructField(c, T.IntegerType()) for c in ("y", "x", "byte", "lung", "lesion", "low", "high")])
    labels = cleaned.select("case_id", *whole("z", "y", "x", "lesion"))
    met = image.groupBy("case_id", "z").cogroup(labels.groupBy("case_id", "z")).applyInArrow(_merged(size, schema), schema)
    unit = unit_scaled(F.col("byte"), F.col("low"), F.col("high"))
    return slices.with_training_labels(met.select("case_id", "z", "i", "name", "y", "x", unit.alias("unit"), "lesion", "lung"))


def split_slices(pixels: DataFrame, valid: float = 0.1, test: float = 0.1) -> DataFrame:
    """(case_id, z, i, stratum, split) of every exported slice, stratified by rarest lesion."""
    exported = pixels.select("case_id", "z", "i").distinct()
    pairs = written(profile.slice_label_pairs(pixels, "label"), "pairs")
    strata = sampling.rarest_lesion(exported, pairs).join(shuffled(exported), ["case_id", "z"])
    return sampling.stratified_split(strata, ["stratum"], export_name(F.col("case_id"), F.col("i")), valid, test)


def slice_dataset(voxels: DataFrame, cases: DataFrame, size: int, **cleaning) -> tuple[DataFrame, DataFrame]:
    """Pixels and split table; write the pixels joined to the split with ``sinks.write_split``."""
    pixels = written(training_pixels(voxels, cases, size, **cleaning), "pixels")
    return pixels, split_slices(pixels)
