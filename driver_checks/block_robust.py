"""Checks on bad input: broken case rows, files that are no volumes, unreadable text, missing losses, and writers read back."""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from driver_checks import fixtures as fx
from driver_checks.block_sampling import key, strata
from driver_checks.block_sources import encoded, fresh, volume_files
from driver_checks.registry import check
from voxtable.operators import sampling, slices
from voxtable.operators import training_log as tl
from voxtable.plans import case_study
from voxtable.schema import AXIAL, FILE_ID, LAYER, LESION, MANIFESTATION
from voxtable.sources import annotations as reader
from voxtable.sources import catalog, sinks, volumes


def broken(spark, folder):
    """Case rows without spacing, with too small a size, and a label out of range, in three of five cases."""
    cases = fx.cases(spark, folder).withColumns({"sx": F.expr("if(case_id % 5 = 1, null, sx)"), "nx": F.expr("if(case_id % 5 = 2, 3, nx)")})
    voxels = fx.voxels(spark, folder).withColumn("lesion", F.expr("if(case_id % 5 = 3 and z = 6 and y = 8 and x = 10, 300, lesion)"))
    return case_study.analyse(voxels, cases)


@check("i2_broken_cases", """select case_id, case_id % 5 in (0, 4) as success, case case_id % 5 when 1 then 'Invalid voxel spacing'
       when 2 then 'Voxels outside the volume' when 3 then 'Lesion label out of range' end as error from cases""", "cases")
def _(spark, folder):
    return case_study.case_statuses(broken(spark, folder))


@check("i2_rest_of_broken_batch", """select case_id, sum(lesion_voxels)::bigint as lung_lesion_voxels from prof where case_id % 5 in (0, 4) group by all""", "prof")
def _(spark, folder):
    return broken(spark, folder).features.select("case_id", "lung_lesion_voxels")


@check("b12_without_positive_values", "select case_id, count(*) as voxels, count(*) filter (case_id % 4 <> 1) as windowed from vox group by all", "vox")
def _(spark, folder):
    hidden = fx.voxels(spark, folder).withColumn("hu", F.expr("if(case_id % 4 = 1, -abs(hu) - 1, hu)"))
    return slices.percentile_windowed(hidden).groupBy("case_id").agg(F.count("*").alias("voxels"), F.count("byte").alias("windowed"))


def odd_files(spark, folder):
    """Volume files: every third holds two volumes, every third fractional values, and the rest come in two gzip members."""
    shape = (fx.NZ, fx.NY, fx.NX)

    def encode(group: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros(shape, dtype=np.int16)
        cells[group.z, group.y, group.x] = group.hu
        raw, case = bytearray(gzip.decompress(encoded(cells, (1.0, 1.0, 1.0)))), int(group.case_id.iloc[0])
        if case % 3 == 0:
            struct.pack_into("<2h", raw, 40, 4, shape[2])
            struct.pack_into("<h", raw, 48, 2)
            raw += raw[352:]
        elif case % 3 == 1:
            struct.pack_into("<h", raw, 70, 16)
            raw = raw[:352] + (cells.astype("<f4") + 0.5).tobytes()
        content = gzip.compress(bytes(raw[:1000])) + gzip.compress(bytes(raw[1000:]))
        return pd.DataFrame({"path": [f"/in/CT_{case}_0000.nii.gz"], "content": [content]})

    return fx.voxels(spark, folder).select("case_id", "z", "y", "x", "hu").groupBy("case_id").applyInPandas(encode, "path string, content binary")


@check("a4_odd_files", """select 'CT_' || case_id || '_0000.nii.gz' as name, case when case_id % 3 = 2 then sum(hu) end::bigint as total,
       case case_id % 3 when 0 then 'ValueError(''the file holds 2 volumes'')' when 1 then 'ValueError(''the volume holds values that are not whole 32-bit numbers'')' end as error
       from vox group by case_id""", "vox")
def _(spark, folder):
    decoded = volumes.decode_files(odd_files(spark, folder))
    total = F.sum(F.aggregate("cells", F.lit(0).cast("bigint"), lambda a, c: a + c))
    return decoded.groupBy("name").agg(total.alias("total"), F.max("error").alias("error"))


@check("h1_missing_losses", """select run, arg_min(epoch, (val_loss, epoch)) filter (epoch % 3 <> 0) as best_epoch, round(min(val_loss) filter (epoch % 3 <> 0), 6) as best_loss
       from vals group by all""", "vals")
def _(spark, folder):
    return tl.best_epochs(fx.run_validation(spark, folder).withColumn("val_loss", F.expr("case epoch % 6 when 0 then null when 3 then double('NaN') else val_loss end")))


def named_columns(spark, folder):
    rows = fx.annotations(spark, folder)
    layer = F.expr("if(row_no % 31 = 0, '12a', cast(cast(layer as double) as string))")
    return rows.select(
        F.col("file_id").alias(FILE_ID), layer.alias(LAYER), F.col("axial").alias(AXIAL), F.col("manifestation").alias(MANIFESTATION), F.col("lesion").alias(LESION),
    )


@check("a1_read_csv", """select form, file_id, layer, axial, manifestation, lesion, count(*) as rows from (
       select form, file_id, case when row_no % 31 <> 0 then layer::double end as layer, axial, manifestation, case when form = 1 then lesion end as lesion
       from filed, (values (1::bigint), (2::bigint)) f(form)) group by all""", "filed")
def _(spark, folder):
    out = None
    for form, dropped in ((1, []), (2, [LESION])):
        path = fresh(spark, "annotations")
        named_columns(spark, folder).drop(*dropped).write.option("header", True).csv(path)
        rows = reader.read_annotations(spark, path).drop("row_no").withColumn("form", F.lit(form))
        out = rows if out is None else out.unionByName(rows)
    columns = ["form", "file_id", "layer", "axial", "manifestation", "lesion"]
    return out.withColumn("layer", F.col("layer").cast("double")).groupBy(*columns).agg(F.count("*").alias("rows"))


@check("a1_unreadable_values", "select count(*) as values from notes where row_no % 31 = 0", "notes")
def _(spark, folder):
    path = fresh(spark, "annotations")
    named_columns(spark, folder).write.option("header", True).csv(path)
    return reader.unreadable(spark, path).where(F.col("column") == LAYER).select("values")


@check("a14_written_split", "select * from split", "split")
def _(spark, folder):
    path = fresh(spark, "split")
    split = sampling.stratified_split(strata(spark, folder), ["stratum"], key())
    sinks.write_split(split, path)
    return spark.read.parquet(path).select(*split.columns)


@check("c3_validate_files", """select case_id, true as ct_exists, case_id % 4 <> 0 as lesion_exists, case when case_id % 4 <> 0 then '12x16x20' end as ct_shape,
       case when case_id % 4 in (1, 2) then '12x16x20' end as lesion_shape, case_id % 4 in (1, 2) as shape_match, case_id % 4 in (1, 2) as valid,
       case case_id % 4 when 0 then 'Missing files' when 3 then 'ValueError(''the file has no volume header'')' end as error,
       sz || ',' || sy || ',' || sx as ct_spacing from cases""", "cases")
def _(spark, folder):
    cts = catalog.ct_files(volumes.decode_headers(volume_files(spark, folder, "hu", "/in/CT_%s_0000.nii.gz")))
    files = volume_files(spark, folder, "lesion", "/in/CT_%s.nii.gz", "case_id % 4 <> 0")
    case = F.regexp_extract("path", r"CT_(\d+)", 1).cast("bigint")
    torn = files.withColumn("content", F.when(case % 4 == 3, F.to_binary(F.repeat(F.lit("00"), 400), F.lit("hex"))).otherwise(F.col("content")))
    lesions = catalog.lesion_files(volumes.decode_headers(torn))
    return catalog.validated_cases(cts, lesions).drop("lesion_spacing").withColumn("case_id", F.col("case_id").cast("bigint"))
