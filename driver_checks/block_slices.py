"""Checks of windowing, regridding and slice export."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_checks import fixtures as fx
from driver_checks.registry import check, extend
from voxtable.functions import intensity
from voxtable.operators import slices

extend({
    "clipv": "select case_id, z, y, x, hu, greatest(least(hu, 240), -160)::double as v from vox",
    "bytes": """select case_id, z, y, x, case when max(v) over w > min(v) over w then floor((v - min(v) over w) / (max(v) over w - min(v) over w) * 255)::bigint else 0 end as byte
        from clipv window w as (partition by case_id)""",
    "kept": "select case_id, z, row_number() over (partition by case_id order by z) - 1 as i from (select distinct case_id, z from vox where lesion > 0)",
}, {"clipv": ["vox"], "bytes": ["clipv"], "kept": ["vox"]})


@check("b10_ct_window", "select case_id, z, y, x, v from clipv", "clipv")
def _(spark, folder):
    return fx.voxels(spark, folder).select("case_id", "z", "y", "x", intensity.ct_window(F.col("hu")).alias("v"))


@check("b11_byte_scale", "select * from bytes", "bytes")
def _(spark, folder):
    return slices.windowed(fx.voxels(spark, folder)).select("case_id", "z", "y", "x", "byte")


@check("b12_percentile_window", """select case_id, z, y, x, case when hu = 0 or mx <= mn then 0 else floor((greatest(least(hu, hi), lo) - mn) / (mx - mn) * 255)::bigint end as byte
       from vox join (select v.case_id, lo, hi, greatest(least(min(hu), hi), lo) as mn, greatest(least(max(hu), hi), lo) as mx from vox v join (
         select case_id, quantile_cont(hu, 0.005) as lo, quantile_cont(hu, 0.995) as hi from vox where hu > 0 group by all) using (case_id) group by v.case_id, lo, hi) using (case_id)""", "vox")
def _(spark, folder):
    return slices.percentile_windowed(fx.voxels(spark, folder)).select("case_id", "z", "y", "x", "byte")


@check("b13_threshold", "select case_id, count(*) as voxels from vox where hu < -300 group by all", "vox")
def _(spark, folder):
    return fx.voxels(spark, folder).where(intensity.below_threshold(F.col("hu"))).groupBy("case_id").agg(F.count("*").alias("voxels"))


@check("b32_unit_slices", """select case_id, z, y, x, round((byte - min(byte) over w) / greatest(max(byte) over w - min(byte) over w, 1e-8), 6) as unit from bytes window w as (partition by case_id, z)""", "bytes")
def _(spark, folder):
    return slices.unit_slices(slices.windowed(fx.voxels(spark, folder))).select("case_id", "z", "y", "x", "unit")


@check("b28_regrid", """select v.case_id, v.z, i.i as y, j.j as x, lesion from vox v join range(24) i(i) on v.y = ((2*i.i + 1)*16) // 48 join range(24) j(j) on v.x = ((2*j.j + 1)*20) // 48
       where lesion > 0""", "vox")
def _(spark, folder):
    rows = fx.voxels(spark, folder).where("lesion > 0").join(fx.cases(spark, folder).select("case_id", "ny", "nx"), "case_id")
    return slices.regridded(rows, 24).select("case_id", "z", "y", "x", "lesion")


@check("b28_regrid_smaller", """select v.case_id, v.z, i.i as y, j.j as x, lesion from vox v join range(7) i(i) on v.y = ((2*i.i + 1)*16) // 14 join range(7) j(j) on v.x = ((2*j.j + 1)*20) // 14
       where lesion > 0""", "vox")
def _(spark, folder):
    rows = fx.voxels(spark, folder).where("lesion > 0").join(fx.cases(spark, folder).select("case_id", "ny", "nx"), "case_id")
    return slices.regridded(rows, 7).select("case_id", "z", "y", "x", "lesion")


@check("c8_roi_slices", "select case_id, z, y, x, lung from vox semi join kept using (case_id, z) where lung = 1", "vox", "kept")
def _(spark, folder):
    v = fx.voxels(spark, folder)
    return slices.roi_slices(v.where("lung > 0"), v.where("lesion > 0")).select("case_id", "z", "y", "x", "lung")


@check("a13_export_order", "select case_id, z, i, printf('%s-%03d', case_id::varchar, i) as name from kept", "kept")
def _(spark, folder):
    return slices.kept_slices(fx.voxels(spark, folder))
