"""Inputs derived from the driver tables, in Spark and as SQL common table expressions.

Both sides state the same rule, so every check starts from equal data. All volumes
are a phantom of two ellipsoids per supplier with lesions by rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NZ, NY, NX = 12, 16, 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows of a task that will multiply: 256 phantoms are about a million voxels.
SPREAD = 256


def spread(df: DataFrame, *columns: str, rows: int = SPREAD) -> DataFrame:
    """A small file arrives as one partition; rows that will multiply are spread first.

    What follows by the same columns stays in these partitions, so their number grows with the rows and a task's share does not.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks, *columns)


def cases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").selectExpr(
        "s_suppkey as case_id",
        "element_at(array(1.0D, 2.5D, 5.0D), cast(s_suppkey % 3 + 1 as int)) as sz",
        "element_at(array(0.5D, 2.0D, 4.0D, 1.0D, 8.0D), cast(s_suppkey % 5 + 1 as int)) as sy",
        "element_at(array(0.5D, 2.0D, 4.0D, 1.0D, 8.0D), cast(s_suppkey % 5 + 1 as int)) as sx",
        f"{NZ} as nz", f"{NY} as ny", f"{NX} as nx",
    )


_LESION = """cast(case
    when regime = 0 then 0
    when regime = 1 and v > 1500 and v <= 3600 and z < 6 then case when h < 8 then 1 else 2 end
    when regime = 2 and v <= 1500 then case when h < 7 then 3 else 2 end
    when regime = 3 and v <= 3600 and h < 6 then case when h < 4 then 4 else 3 end
    when regime = 4 and v <= 3600 and z >= 6 and h < 5 then 2
    when regime = 5 and h < 3 then 1 + (z + 2*y + x + case_id) % 4
    when regime = 6 and v <= 100 and h < 4 then 3
    else 0 end as int)"""
_V = "225*least((x-5)*(x-5),(x-14)*(x-14)) + 100*(y-8)*(y-8) + 144*(z-6)*(z-6)"
_H = "(z*7 + y*3 + x*5 + case_id) % 11"


def voxels(spark: SparkSession, folder: str) -> DataFrame:
    """Dense voxels: lung, lesion, hu."""
    grid = spread(table(spark, folder, "supplier").select(F.col("s_suppkey").alias("case_id")), "case_id")
    for axis, length in (("z", NZ), ("y", NY), ("x", NX)):
        grid = grid.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    rows = grid.selectExpr("*", "case_id % 7 as regime", f"{_V} as v", f"{_H} as h")
    # Out of an array, a label is computed once: a filter on it or on what follows from it cannot move below and repeat its whole rule.
    rows = rows.selectExpr(
        "case_id", "z", "y", "x", "h",
        "cast(case when v <= 3600 - 300*(case_id % 3) then 1 else 0 end as int) as lung", f"explode(array({_LESION})) as lesion",
    )
    return rows.selectExpr(
        "case_id", "z", "y", "x", "lung", "lesion",
        "cast(case when lung = 1 then -850 + 40*lesion + h*7 else -20 + (z*13 + y*5 + x*3) % 160 end as int) as hu",
    )


def scans(spark: SparkSession, folder: str) -> DataFrame:
    """Voxels with air at the slice border, larger than a lung, and a third part beside the lungs."""
    hu = """case when lung = 0 and z in (2, 3, 9, 10) and y < 2 then -950
        when lung = 0 and z in (2, 3, 9, 10) and case_id % 2 = 0 and y in (13, 14) and x in (9, 10) then -700 else hu end"""
    return voxels(spark, folder).withColumn("hu", F.expr(hu))


def masked_voxels(spark: SparkSession, folder: str) -> DataFrame:
    """Voxels with given upper and lower masks, cut at slice 7."""
    return voxels(spark, folder).selectExpr(
        "*", "if(z >= 7, lung, 0) as upper", "if(z < 7, lung, 0) as lower"
    )


def prediction(spark: SparkSession, folder: str) -> DataFrame:
    """Truth moved by one voxel (even cases) or partly relabelled (odd cases)."""
    lesions = voxels(spark, folder).where("lesion > 0")
    moved = lesions.where("case_id % 2 = 0 and x > 0").selectExpr("case_id", "z", "y", "x - 1 as x", "lesion as label")
    changed = lesions.where("case_id % 2 = 1").selectExpr(
        "case_id", "z", "y", "x", "if((x + y + z) % 5 = 0, lesion % 4 + 1, lesion) as label"
    )
    return moved.unionByName(changed)


def truth(spark: SparkSession, folder: str) -> DataFrame:
    return voxels(spark, folder).where("lesion > 0").selectExpr("case_id", "z", "y", "x", "lesion as label")


def slices(spark: SparkSession, folder: str) -> DataFrame:
    # As many slices in a task as a task of volumes has voxels.
    rows = spread(table(spark, folder, "supplier").selectExpr("s_suppkey as case_id"), "case_id", rows=SPREAD * NY * NX)
    return rows.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(NZ - 1)))).selectExpr("*", f"{NY} as ny", f"{NX} as nx")


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id as row_no",
        "if(event_id % 97 = 0, null, concat(element_at(array('UIP','NSIP','OP','AHP'), cast(user_id % 4 + 1 as int)), ' ', user_id)) as file_id",
        "if(event_id % 29 = 0, null, floor(value) + 1) as layer",
        """case event_type when 'click' then '外周' when 'view' then '中心' when 'purchase' then '弥漫/散在'
             when 'error' then '外周分布-其他' end as axial""",
        """case event_id % 5 when 0 then '胸膜下' when 1 then '胸膜下省略' when 2 then 'GGO实变不区分'
             when 3 then '其他' end as manifestation""",
        """case event_id % 6 when 0 then '蜂窝' when 1 then '网格' when 2 then '实变' when 3 then 'GGO'
             when 4 then '未知' end as lesion""",
    )


def ct_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").selectExpr(
        "concat('CT_CASE_', s_suppkey, '_0000.nii.gz') as name", "concat('CASE_', s_suppkey) as case_id", "'12x16x20' as shape"
    )


def lesion_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").where("s_suppkey % 3 <> 0").selectExpr(
        "concat('CT_CASE_', s_suppkey, '.nii.gz') as name", "concat('CASE_', s_suppkey) as case_id",
        "if(s_suppkey % 11 = 5, '12x16x21', '12x16x20') as shape",
    )


def mask_catalog(spark: SparkSession, folder: str) -> DataFrame:
    kinds = "filter(array(if(s_suppkey % 2 = 0, 'lung_mask', null), if(s_suppkey % 4 = 0, 'upper_lung', null), " \
            "if(s_suppkey % 4 = 0, 'lower_lung', null), if(s_suppkey % 12 = 1, 'lobe_mask', null)), k -> k is not null)"
    rows = table(spark, folder, "supplier").selectExpr("s_suppkey", f"explode({kinds}) as mask_type")
    return rows.selectExpr("concat('CT_CASE_', s_suppkey, '_', mask_type, '.nii.gz') as name")


def detections(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").selectExpr(
        "p_partkey as box_id", "p_partkey % 20 as image_id",
        "(p_partkey*37) % 200 as x0", "(p_partkey*53) % 200 as y0",
        "(p_partkey*37) % 200 + p_size + 5 as x1", "(p_partkey*53) % 200 + (p_size*3) % 40 + 5 as y1",
        "p_retailprice / 10000 as score", "260 as w", "250 as h",
    )


def run_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as training steps: the run is the status, the epoch the month."""
    from voxtable.operators.ranking import bucketed_rank

    rows = table(spark, folder, "orders").selectExpr(
        "o_orderstatus as run", "cast(year(o_orderdate)*12 + month(o_orderdate) as bigint) as epoch", "o_orderdate as ts",
        "o_totalprice / 70000 as loss", "o_orderkey", "o_orderkey % 997 = 5 as failed",
    )
    ranked = bucketed_rank(rows, ["run"], F.date_trunc("day", "ts"), ["ts", "o_orderkey"])
    return ranked.withColumnRenamed("place", "step").drop("group_size")


def run_validation(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders")
    return rows.groupBy(
        F.col("o_orderstatus").alias("run"), F.expr("cast(year(o_orderdate)*12 + month(o_orderdate) as bigint)").alias("epoch")
    ).agg(F.expr("avg(o_totalprice / 65536 + (o_orderkey % 5) / 8)").alias("val_loss"))


def marked_voxels(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as sparse label voxels, one per voxel."""
    rows = table(spark, folder, "lineitem").selectExpr(
        "l_suppkey as case_id", "l_linenumber as z", "cast(l_orderkey % 512 as int) as y", "cast(l_partkey % 512 as int) as x",
        "cast(1 + cast(l_quantity as int) % 4 as int) as lesion",
    )
    return rows.groupBy("case_id", "z", "y", "x").agg(F.max("lesion").alias("lesion"))


# The same rules as SQL, in order of dependence.
CTES: dict[str, str] = {
    "cases": f"""select s_suppkey as case_id,
        case s_suppkey % 3 when 0 then 1.0::double when 1 then 2.5::double else 5.0::double end as sz,
        case s_suppkey % 5 when 0 then 0.5::double when 1 then 2.0::double when 2 then 4.0::double when 3 then 1.0::double else 8.0::double end as sy,
        case s_suppkey % 5 when 0 then 0.5::double when 1 then 2.0::double when 2 then 4.0::double when 3 then 1.0::double else 8.0::double end as sx,
        {NZ}::bigint as nz, {NY}::bigint as ny, {NX}::bigint as nx from supplier""",
    "grid": f"""select *, case_id % 7 as regime, {_V} as v, {_H} as h
        from (select s_suppkey as case_id, z, y, x from supplier, range({NZ}) tz(z), range({NY}) ty(y), range({NX}) tx(x))""",
    "marked": f"""select case_id, z, y, x, h, (case when v <= 3600 - 300*(case_id % 3) then 1 else 0 end)::bigint as lung,
        {_LESION}::bigint as lesion from grid""",
    "vox": """select case_id, z, y, x, lung, lesion,
        (case when lung = 1 then -850 + 40*lesion + h*7 else -20 + (z*13 + y*5 + x*3) % 160 end)::bigint as hu from marked""",
    "slices": f"select s_suppkey as case_id, z, {NY}::bigint as ny, {NX}::bigint as nx from supplier, range({NZ}) tz(z)",
    "labels_a": """select * from (values (1, 'honeycomb'), (2, 'reticulation'), (3, 'ground_glass_opacity'), (4, 'consolidation')) t(lesion, name)""",
    "prof": """select case_id, z, count(*) filter (lung = 1) as lung_voxels, count(*) filter (lung = 1 and lesion > 0) as lesion_voxels
        from vox group by all""",
    "cut": "select case_id, floor(quantile_cont(z, 0.6))::bigint as z_cut from vox where lung = 1 group by all",
    "pass_x": """select a.case_id, a.z, a.y, a.x, min((a.x-b.x)*(a.x-b.x)*c.sx*c.sx) as d
        from vox a join vox b using (case_id, z, y) join cases c using (case_id) where a.lung = 1 and b.lung = 0 group by all""",
    "line_x": "select v.case_id, v.z, v.y, v.x, case when lung = 0 then 0.0 else d end as d from vox v left join pass_x using (case_id, z, y, x)",
    "pass_y": """select a.case_id, a.z, a.y, a.x, min(b.d + (a.y-b.y)*(a.y-b.y)*c.sy*c.sy) as d
        from line_x a join line_x b using (case_id, z, x) join cases c using (case_id) group by all""",
    "pass_z": """select a.case_id, a.z, a.y, a.x, min(b.d + (a.z-b.z)*(a.z-b.z)*c.sz*c.sz) as d
        from pass_y a join pass_y b using (case_id, y, x) join cases c using (case_id) group by all""",
    "feat": """select v.case_id, v.z, v.y, v.x, v.lesion, sqrt(d) as dist_mm
        from vox v join pass_z using (case_id, z, y, x) where v.lung = 1""",
    "pred": """select case_id, z, y, x - 1 as x, lesion as label from vox where lesion > 0 and case_id % 2 = 0 and x > 0
        union all select case_id, z, y, x, case when (x + y + z) % 5 = 0 then lesion % 4 + 1 else lesion end
        from vox where lesion > 0 and case_id % 2 = 1""",
    "truth": "select case_id, z, y, x, lesion as label from vox where lesion > 0",
    "notes": """select event_id as row_no,
        case when event_id % 97 = 0 then null else ['UIP','NSIP','OP','AHP'][user_id % 4 + 1] || ' ' || user_id end as file_id,
        case when event_id % 29 = 0 then null else floor(value) + 1 end as layer,
        case event_type when 'click' then '外周' when 'view' then '中心' when 'purchase' then '弥漫/散在' when 'error' then '外周分布-其他' end as axial,
        case event_id % 5 when 0 then '胸膜下' when 1 then '胸膜下省略' when 2 then 'GGO实变不区分' when 3 then '其他' end as manifestation,
        case event_id % 6 when 0 then '蜂窝' when 1 then '网格' when 2 then '实变' when 3 then 'GGO' when 4 then '未知' end as lesion
        from events""",
    "filed": "select * from notes where file_id is not null",
    "axial_names": "select * from (values ('外周','peripheral'), ('中心','central'), ('弥漫/散在','diffuse_scattered'), ('外周分布-其他','peripheral_other')) t(term, name)",
    "manifest_names": "select * from (values ('胸膜下','subpleural'), ('胸膜下省略','subpleural_omitted'), ('GGO实变不区分','ggo_consolidation_mixed'), ('其他','other')) t(term, name)",
    "cts": "select 'CT_CASE_' || s_suppkey || '_0000.nii.gz' as name, 'CASE_' || s_suppkey as case_id, '12x16x20' as shape from supplier",
    "lesion_files": """select 'CT_CASE_' || s_suppkey || '.nii.gz' as name, 'CASE_' || s_suppkey as case_id,
        case when s_suppkey % 11 = 5 then '12x16x21' else '12x16x20' end as shape from supplier where s_suppkey % 3 <> 0""",
    "mask_files": """select 'CASE_' || s_suppkey as case_id, mask_type from supplier, (values ('lung_mask'), ('upper_lung'), ('lower_lung'), ('lobe_mask')) t(mask_type)
        where (mask_type = 'lung_mask' and s_suppkey % 2 = 0) or (mask_type in ('upper_lung', 'lower_lung') and s_suppkey % 4 = 0)
           or (mask_type = 'lobe_mask' and s_suppkey % 12 = 1)""",
    "boxes": """select p_partkey as box_id, p_partkey % 20 as image_id, (p_partkey*37) % 200 as x0, (p_partkey*53) % 200 as y0,
        (p_partkey*37) % 200 + p_size + 5 as x1, (p_partkey*53) % 200 + (p_size*3) % 40 + 5 as y1, p_retailprice / 10000 as score,
        260::bigint as w, 250::bigint as h from part""",
    "steps": """select o_orderstatus as run, year(o_orderdate)*12 + month(o_orderdate) as epoch, o_orderdate as ts, o_totalprice / 70000 as loss,
        o_orderkey, o_orderkey % 997 = 5 as failed, row_number() over (partition by o_orderstatus order by o_orderdate, o_orderkey) as step from orders""",
    "vals": """select o_orderstatus as run, year(o_orderdate)*12 + month(o_orderdate) as epoch, avg(o_totalprice / 65536 + (o_orderkey % 5) / 8) as val_loss
        from orders group by all""",
    "marks": """select case_id, z, y, x, max(lesion) as lesion from (select l_suppkey as case_id, l_linenumber::bigint as z, l_orderkey % 512 as y,
        l_partkey % 512 as x, (1 + trunc(l_quantity)::bigint % 4) as lesion from lineitem) group by all""",
}
NEEDS: dict[str, list[str]] = {
    "marked": ["grid"], "vox": ["marked"], "prof": ["vox"], "cut": ["vox"], "pass_x": ["vox", "cases"], "line_x": ["vox", "pass_x"],
    "pass_y": ["line_x", "cases"], "pass_z": ["pass_y", "cases"], "feat": ["vox", "pass_z"], "pred": ["vox"], "truth": ["vox"],
    "filed": ["notes"],
}
