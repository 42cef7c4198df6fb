"""Checks of components, morphology and lung masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_checks import fixtures as fx
from driver_checks.common import fresh
from driver_checks.registry import check, extend
from voxtable.operators import components, lung_mask, planar
from voxtable.plans import lung_masks as jobs
from voxtable.plans.slice_dataset import slice_dataset
from voxtable.session import written


def component_ctes(name: str, cells: str, keys: str, near: str) -> tuple[dict[str, str], dict[str, list[str]]]:
    """SQL for the smallest cell number reachable from every cell of ``cells`` (which has ``p``)."""
    pair = ", ".join(f"a.{k}" for k in keys.split(", "))
    same = " and ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    link = " and ".join(f"e.{k} = c.{k}" for k in keys.split(", "))
    back = " and ".join(f"r.{k} = e.{k}" for k in keys.split(", "))
    outs = ", ".join(f"e.{k}" for k in keys.split(", "))
    ctes = {
        f"{name}_links": f"select {pair}, a.p, b.p as q from {cells} a join {cells} b on {same} and {near} and a.p <> b.p",
        name: f"""@{name}({keys}, p, root) using key ({keys}, p)@select {keys}, p, p from {cells} union
            select {outs}, e.q, min(c.root) from {name} c join {name}_links e on {link} and e.p = c.p
            join recurring.{name} r on {back} and r.p = e.q where c.root < r.root group by all""",
    }
    return ctes, {f"{name}_links": [cells], name: [cells, f"{name}_links"]}


NEAR8 = "b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1"
NEAR26 = "b.z between a.z - 1 and a.z + 1 and " + NEAR8

extend({"les": "select case_id, lesion, z, y, x, (z*16 + y)*20 + x as p from vox where lesion > 0"}, {"les": ["vox"]})
extend(*component_ctes("les_cc", "les", "case_id, lesion", NEAR26))
extend({
    "solid": """select l.* from les l join les_cc c using (case_id, lesion, p) join (select case_id, lesion, root from les_cc group by all having count(*) >= 12) k using (case_id, lesion, root)""",
}, {"solid": ["les", "les_cc"]})
extend(*component_ctes("solid_cc", "solid", "case_id, lesion, z", NEAR8))
extend({
    "cleaned": """select s.case_id, s.z, s.y, s.x, s.lesion from solid s join solid_cc c using (case_id, lesion, z, p)
        join (select case_id, lesion, z, root from solid_cc group by all having count(*) >= 4) k using (case_id, lesion, z, root)""",
    "spots": "select case_id, z, y, x, y*20 + x as p from vox where lesion > 0",
}, {"cleaned": ["solid", "solid_cc"], "spots": ["vox"]})
extend(*component_ctes("spots_cc", "spots", "case_id, z", NEAR8))
# Lungs with air at the slice border, larger than a lung, and a third part beside them.
extend({
    "scan": """select case_id, z, y, x, lung, case when lung = 0 and z in (2, 3, 9, 10) and y < 2 then -950
        when lung = 0 and z in (2, 3, 9, 10) and case_id % 2 = 0 and y in (13, 14) and x in (9, 10) then -700 else hu end as hu from vox""",
    "lung_px": "select case_id, z, y, x, y*20 + x as p from scan where hu < -300",
}, {"scan": ["vox"], "lung_px": ["scan"]})
extend(*component_ctes("lung_cc", "lung_px", "case_id, z", NEAR8))
extend({
    "lung_parts": """select l.case_id, l.z, l.y, l.x from lung_px l join lung_cc c using (case_id, z, p) join (
        select case_id, z, root from (select case_id, z, root, rank() over (partition by case_id, z order by n desc) as place from (
          select case_id, z, root, count(*) as n from lung_cc group by case_id, z, root
          having min(p // 20) > 0 and max(p // 20) < 15 and min(p % 20) > 0 and max(p % 20) < 19)) where place <= 2) k using (case_id, z, root)""",
}, {"lung_parts": ["lung_px", "lung_cc"]})


def shrunk(name: str, source: str, radius: int) -> None:
    extend({name: f"""select case_id, z, y, x from {source} a where not exists (select 1 from (select v.case_id, v.z, v.y, v.x from vox v semi join {source} using (case_id, z)
        anti join {source} using (case_id, z, y, x)) b where b.case_id = a.case_id and b.z = a.z and (a.y - b.y)*(a.y - b.y) + (a.x - b.x)*(a.x - b.x) <= {radius**2})"""}, {name: ["vox", source]})


def grown(name: str, source: str, radius: int) -> None:
    extend({name: f"""select distinct b.case_id, b.z, b.y, b.x from {source} a join vox b on a.case_id = b.case_id and a.z = b.z
        and (a.y - b.y)*(a.y - b.y) + (a.x - b.x)*(a.x - b.x) <= {radius**2}"""}, {name: ["vox", source]})


def outlined(name: str, source: str) -> None:
    extend({name: f"""select case_id, z, y, x from (select *, lead(m, 1, m) over (partition by case_id, z, y order by x) as m01, lead(m10, 1, m10) over (partition by case_id, z, y order by x) as m11
        from (select *, lead(m, 1, m) over (partition by case_id, z, x order by y) as m10 from (select v.case_id, v.z, v.y, v.x, s.y is not null as m from vox v left join {source} s using (case_id, z, y, x))))
        where m <> m11 or m01 <> m10"""}, {name: ["vox", source]})


def filled(name: str, source: str) -> None:
    """Reachable background from the slice edge; everything else is mask or hole."""
    extend({
        f"{name}_free": f"select v.case_id, v.z, v.y, v.x from vox v semi join {source} using (case_id, z) anti join {source} using (case_id, z, y, x)",
        f"{name}_out": f"""@{name}_out(case_id, z, y, x)@select * from {name}_free where y in (0, 15) or x in (0, 19) union
            select f.* from {name}_out o join {name}_free f on f.case_id = o.case_id and f.z = o.z and abs(f.y - o.y) + abs(f.x - o.x) = 1""",
        name: f"select v.case_id, v.z, v.y, v.x from vox v semi join {source} using (case_id, z) anti join {name}_out using (case_id, z, y, x)",
    }, {f"{name}_free": ["vox", source], f"{name}_out": [f"{name}_free"], name: ["vox", source, f"{name}_out"]})


shrunk("lung_eroded", "lung_parts", 2)
# The default closing radius would cover the whole 16 × 20 slice.
CLOSING = 3
grown("lung_dilated", "lung_eroded", CLOSING)
shrunk("lung_closed", "lung_dilated", CLOSING)
outlined("lung_edges", "lung_closed")
filled("lung_mask", "lung_edges")
grown("spots_dilated", "spots", 3)
shrunk("spots_closed", "spots_dilated", 3)
outlined("spots_edges", "spots")
filled("spots_filled", "spots")
extend({
    "mask_cut": "select case_id, floor(quantile_cont(z, 0.6))::bigint as z_cut from lung_mask group by all",
    "mask_rows": """select case_id, 'lung_mask' as mask_type, z, y, x from lung_mask union all
        select case_id, case when z >= z_cut then 'upper_lung' else 'lower_lung' end, z, y, x from lung_mask join mask_cut using (case_id)""",
}, {"mask_cut": ["lung_mask"], "mask_rows": ["lung_mask", "mask_cut"]})


def spots(spark, folder):
    return fx.voxels(spark, folder).where("lesion > 0").select("case_id", "z", "y", "x")


def lung(spark, folder):
    return lung_mask.segment_lungs(fx.scans(spark, folder), fx.cases(spark, folder), closing=CLOSING)


@check("e2_components", "select case_id, lesion, z, y, x, ((root // 320)*2097152 + (root // 20) % 16)*2097152 + root % 20 as component from les join les_cc using (case_id, lesion, p)", "les", "les_cc")
def _(spark, folder):
    rows = fx.voxels(spark, folder).where("lesion > 0")
    return components.label_components(rows, ["case_id", "lesion"], ["z", "y", "x"])


@check("e2_volume_small_tiles", "select case_id, lesion, z, y, x, ((root // 320)*2097152 + (root // 20) % 16)*2097152 + root % 20 as component from les join les_cc using (case_id, lesion, p)", "les", "les_cc")
def _(spark, folder):
    # Tiles of 5 cells are crossed along all three axes of the phantom.
    rows = fx.voxels(spark, folder).where("lesion > 0")
    return components.label_components(rows, ["case_id", "lesion"], ["z", "y", "x"], tile=5)


@check("e2_components_small_tiles", "select case_id, z, count(distinct root) as components, count(*) as pixels from spots_cc group by all", "spots_cc")
def _(spark, folder):
    rows = components.label_components(spots(spark, folder), ["case_id", "z"], ["y", "x"], tile=8)
    return rows.groupBy("case_id", "z").agg(F.countDistinct("component").alias("components"), F.count("*").alias("pixels"))


@check("e3_clean_labels", "select * from cleaned", "cleaned")
def _(spark, folder):
    return components.clean_labels(fx.voxels(spark, folder), 12, 4)


@check("e4_clear_border", """select s.case_id, s.z, s.y, s.x from spots s join spots_cc c using (case_id, z, p) join (select case_id, z, root from spots_cc group by all
       having min(p // 20) > 0 and max(p // 20) < 15 and min(p % 20) > 0 and max(p % 20) < 19) k using (case_id, z, root)""", "spots", "spots_cc")
def _(spark, folder):
    return planar.clear_border(spots(spark, folder), fx.cases(spark, folder))


@check("e5_two_largest", """select s.case_id, s.z, s.y, s.x from spots s join spots_cc c using (case_id, z, p) join (select case_id, z, root from (
       select case_id, z, root, rank() over (partition by case_id, z order by count(*) desc) as place from spots_cc group by case_id, z, root) where place <= 2) k using (case_id, z, root)""", "spots", "spots_cc")
def _(spark, folder):
    return planar.two_largest(spots(spark, folder))


@check("e6_erosion", "select * from lung_eroded", "lung_eroded")
def _(spark, folder):
    return planar.erode(fx.voxels(spark, folder).where("lung > 0"), fx.cases(spark, folder), 2)


@check("e6_closing", "select * from spots_closed", "spots_closed")
def _(spark, folder):
    return planar.close(spots(spark, folder), fx.cases(spark, folder), 3)


@check("e7_fill_holes", "select * from spots_filled", "spots_filled")
def _(spark, folder):
    return planar.fill_holes(spots(spark, folder))


@check("e8_edges", "select * from spots_edges", "spots_edges")
def _(spark, folder):
    return planar.edge_pixels(spots(spark, folder), fx.cases(spark, folder))


@check("e9_segment_lungs", "select * from lung_mask", "lung_mask")
def _(spark, folder):
    return lung(spark, folder)


@check("e10_region_masks", "select * from mask_rows", "mask_rows")
def _(spark, folder):
    return lung_mask.region_masks(written(lung(spark, folder), "lung"))


def mask_run(spark, folder):
    """Every fourth case already has its masks."""
    c = fx.cases(spark, folder)
    existing = c.where("case_id % 4 = 0").select("case_id", F.explode(F.array(*[F.lit(k) for k in ("lung_mask", "upper_lung", "lower_lung")])).alias("mask_type"))
    # Every seventh case has no air at all, so nothing can be segmented.
    airless = fx.scans(spark, folder).withColumn("hu", F.expr("if(case_id % 7 = 3, 40, hu)"))
    return jobs.generate_masks(airless, c, existing, closing=CLOSING)


@check("i3_mask_outcomes", """select case_id, case_id % 4 = 0 or case_id % 7 <> 3 as success, case_id % 4 = 0 as skipped,
       case when case_id % 4 <> 0 and case_id % 7 = 3 then 'Failed to segment lungs' end as error, case when case_id % 4 <> 0 then case when case_id % 7 = 3 then 0.0 else round(n*sz*sy*sx, 6) end end as total_volume_mm3
       from cases left join (select case_id, count(*) as n from lung_mask group by all) using (case_id)""", "cases", "lung_mask")
def _(spark, folder):
    return mask_run(spark, folder).outcomes


@check("d30_mask_summary", """select count(*) as processed_cases, round(avg(v), 6) as avg_volume_mm3, round(min(v), 6) as min_volume_mm3, round(max(v), 6) as max_volume_mm3, round(stddev_pop(v), 6) as std_volume_mm3,
       true as timed, true as times_agree
       from (select n*sz*sy*sx as v from cases join (select case_id, count(*) as n from lung_mask group by all) using (case_id) where case_id % 4 <> 0)""", "cases", "lung_mask")
def _(spark, folder):
    """Two stored batches; the times come from their record."""
    tables = jobs.StoredRun(*(fresh(spark, n) for n in ("masks", "outcomes", "times")))
    c = fx.cases(spark, folder)
    for part in (0, 1):
        mine = c.where(F.col("case_id") % 2 == part)
        existing = mine.where("case_id % 4 = 0").select("case_id", F.explode(F.array(*[F.lit(k) for k in ("lung_mask", "upper_lung", "lower_lung")])).alias("mask_type"))
        stored = jobs.store_masks(fx.scans(spark, folder), mine, existing, tables, str(part), closing=CLOSING)
    times = spark.read.parquet(tables.times).agg(F.sum("seconds").alias("all"), F.sum("cases").alias("cases"))
    rows = jobs.mask_summary(stored).crossJoin(times)  # one row each
    agree = (F.abs(F.col("total_seconds") - F.col("all")) < 1e-6) & (F.abs(F.col("avg_seconds") * F.col("processed_cases") - F.col("all")) < 1e-6) & (F.col("cases") == F.col("processed_cases"))
    return rows.select(*(c for c in rows.columns if c.endswith("mm3") or c == "processed_cases"), (F.col("avg_seconds") > 0).alias("timed"), agree.alias("times_agree"))


@check("d31_mask_outcomes", """select count(*) as total_cases, count(*) filter (case_id % 4 = 0 or case_id % 7 <> 3) as successful, count(*) filter (case_id % 4 <> 0 and case_id % 7 = 3) as failed,
       count(*) filter (case_id % 4 = 0) as skipped from cases""", "cases")
def _(spark, folder):
    return jobs.mask_outcome_counts(mask_run(spark, folder).outcomes)


@check("a12_stored_masks", "select case_id, mask_type, count(*) as voxels from mask_rows group by all", "mask_rows")
def _(spark, folder):
    from voxtable.session import scratch_folder
    from voxtable.sources.sinks import write_masks
    import uuid

    path = f"{scratch_folder(spark)}/masks-{uuid.uuid4().hex}"
    write_masks(lung_mask.region_masks(written(lung(spark, folder), "lung")), path)
    return spark.read.parquet(path).groupBy("case_id", "mask_type").agg(F.count("*").alias("voxels"))


extend({
    "exported": "select case_id, z, row_number() over (partition by case_id order by z) - 1 as i from (select distinct case_id, z from cleaned)",
    "units": "select case_id, z, y, x, (byte - min(byte) over w) / greatest(max(byte) over w - min(byte) over w, 1e-8) as unit from bytes window w as (partition by case_id, z)",
    "pixels": """select v.case_id, v.z, e.i, r.i as y, c.j as x, coalesce(k.lesion, 0)::bigint as lesion, v.lung, u.unit
        from vox v join exported e using (case_id, z) join units u using (case_id, z, y, x) left join cleaned k using (case_id, z, y, x)
        join range(32) r(i) on v.y = ((2*r.i + 1)*16) // 64 join range(32) c(j) on v.x = ((2*c.j + 1)*20) // 64""",
}, {"exported": ["cleaned"], "units": ["bytes"], "pixels": ["vox", "exported", "cleaned", "units"]})


@check("i6_slice_dataset", """select case_id, z, i, count(*) as pixels, count(*) filter (lesion > 0) as lesion_pixels, sum(case when lesion > 0 then lesion + 1 when lung > 0 then 1 else 0 end)::bigint as label_sum,
       round(sum(unit), 6) as unit_sum, round(sum(unit*(y*32 + x)), 4) as unit_moment from pixels group by all""", "pixels")
def _(spark, folder):
    pixels, _ = slice_dataset(fx.voxels(spark, folder), fx.cases(spark, folder), 32, min_voxels=12, min_pixels=4)
    return pixels.groupBy("case_id", "z", "i").agg(
        F.count("*").alias("pixels"), F.count_if(F.col("lesion") > 0).alias("lesion_pixels"), F.sum("label").alias("label_sum"), F.sum("unit").alias("unit_sum"),
        F.round(F.sum(F.col("unit") * (F.col("y") * 32 + F.col("x"))), 4).alias("unit_moment"),
    )


extend({
    "px_pairs": "select distinct case_id, z, i, case when lesion > 0 then lesion + 1 else 1 end as label from pixels where lesion > 0 or lung > 0",
    "px_strata": """select e.case_id, e.z, e.i, coalesce(arg_min(label, slices*10 + label), 1)::bigint as stratum from exported e left join (
        select * from px_pairs join (select label, count(*) as slices from px_pairs group by all) using (label) where label > 1) t using (case_id, z) group by e.case_id, e.z, e.i""",
}, {"px_pairs": ["pixels"], "px_strata": ["exported", "px_pairs"]})


@check("i6_slice_split", """select case_id, z, i, stratum, case when r <= floor(n*0.1 + 0.5) then 'test' when r <= 2*floor(n*0.1 + 0.5) then 'valid' else 'train' end as split
       from (select *, row_number() over (partition by stratum order by md5(printf('%s-%03d', case_id::varchar, i) || '|42')) as r, count(*) over (partition by stratum) as n from px_strata)""", "px_strata")
def _(spark, folder):
    return slice_dataset(fx.voxels(spark, folder), fx.cases(spark, folder), 32, min_voxels=12, min_pixels=4)[1]
