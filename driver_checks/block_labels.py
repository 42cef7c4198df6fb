"""Checks of label profiles, relabelling and training labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_checks import fixtures as fx
from driver_checks.registry import check, extend
from voxtable.functions import labels as lb
from voxtable.functions import names
from voxtable.operators import lesions, profile, sampling, slices
from voxtable.plans.label_profile import profile_labels
from voxtable.schema import label_dim
from voxtable.session import written

extend({
    "pairs": "select distinct case_id, z, lesion as label from vox where lesion <> 0",
    "trained": "select case_id, z, y, x, (case when lesion > 0 then lesion + 1 when lung > 0 then 1 else 0 end)::bigint as label from vox",
    "tpairs": "select distinct case_id, z, label from trained where label > 0",
    "tcounts": "select label, count(*) as slices from tpairs group by all",
    "strata": """select s.case_id, s.z, coalesce(arg_min(label, slices*10 + label), 1)::bigint as stratum from slices s
        left join (select * from tpairs join tcounts using (label) where label > 1) t using (case_id, z) group by s.case_id, s.z""",
}, {"pairs": ["vox"], "trained": ["vox"], "tpairs": ["trained"], "tcounts": ["tpairs"], "strata": ["slices", "tpairs", "tcounts"]})


def pairs(spark, folder):
    return profile.slice_label_pairs(fx.voxels(spark, folder))


def training_pairs(spark, folder):
    return written(profile.slice_label_pairs(slices.with_training_labels(fx.voxels(spark, folder)), "label"), "pairs")


@check("b6_unknown_labels", "select case_id, lesion, voxels from (select case_id, lesion + 2 as lesion, count(*) as voxels from vox where lesion > 0 group by all) where lesion > 4", "vox")
def _(spark, folder):
    moved = fx.voxels(spark, folder).withColumn("lesion", F.expr("if(lesion > 0, lesion + 2, 0)"))
    return lesions.unknown_labels(lesions.lesion_counts(moved), label_dim(spark)).select("case_id", "lesion", "voxels")


@check("b7_relabel", "select lesion + 1 as old, case lesion + 1 when 3 then 2 when 4 then 3 when 5 then 4 else lesion + 1 end as new, count(*) as voxels from vox group by all", "vox")
def _(spark, folder):
    v = fx.voxels(spark, folder).withColumn("old", F.col("lesion") + 1)
    return v.withColumn("new", lb.relabelled(F.col("old"))).groupBy("old", "new").agg(F.count("*").alias("voxels"))


@check("b8_training_label", "select label, count(*) as voxels from trained group by all", "trained")
def _(spark, folder):
    return slices.with_training_labels(fx.voxels(spark, folder)).groupBy("label").agg(F.count("*").alias("voxels"))


@check("b25_slice_names", "select distinct case_id, z, printf('slice_%03d', z) as name, printf('%s-%03d', case_id::varchar, z) as export from pairs", "pairs")
def _(spark, folder):
    rows = pairs(spark, folder).select("case_id", "z").distinct()
    return rows.withColumns({"name": names.slice_name(F.col("z")), "export": names.export_name(F.col("case_id"), F.col("z"))})


@check("b27_synonyms", """select case_id, z, label, (case label when 1 then ['normal', 'healthy lung'] when 2 then ['ground glass opacity', 'GGO'] when 3 then ['reticulation', 'reticular pattern']
       when 4 then ['consolidation', 'airspace consolidation'] else ['honeycombing', 'honeycomb pattern'] end)[z % 2 + 1] as caption from tpairs""", "tpairs")
def _(spark, folder):
    words = label_dim(spark).where("scheme = 'training'").select(F.col("label_id").alias("label"), "synonyms")
    rows = training_pairs(spark, folder).join(F.broadcast(words), "label")
    return rows.select("case_id", "z", "label", lb.synonym(F.col("synonyms"), F.col("z") % 2).alias("caption"))


@check("d7_slice_label_sets", "select case_id, z, string_agg(label::varchar, ',' order by label) as labels from pairs group by all", "pairs")
def _(spark, folder):
    return profile.slice_label_sets(pairs(spark, folder))


@check("d8_lesion_slices", "select case_id, string_agg(distinct z::varchar, ',' order by z::varchar) as layers from pairs group by all", "pairs")
def _(spark, folder):
    # Both sides list the slices in text order.
    rows = profile.lesion_slices(pairs(spark, folder))
    return rows.withColumn("layers", F.sort_array(F.col("layers").cast("array<string>")))


@check("d9_label_incidence", "select label, count(distinct case_id) as patients, count(*) as slices from pairs group by all", "pairs")
def _(spark, folder):
    return profile.label_incidence(pairs(spark, folder))


@check("d10_case_summary", """select c.case_id, count(distinct z) as lesion_slices, coalesce(string_agg(distinct label::varchar, ',' order by label::varchar), '') as labels
       from cases c left join pairs using (case_id) group by c.case_id""", "cases", "pairs")
def _(spark, folder):
    return profile.case_summary(pairs(spark, folder), fx.cases(spark, folder))


@check("d11_dataset_totals", """select (select count(*) from cases) as patients, (select count(*) from (select distinct case_id, z from pairs)) as lesion_slices,
       (select string_agg(distinct label::varchar, ',' order by label::varchar) from pairs) as labels""", "cases", "pairs")
def _(spark, folder):
    return profile.dataset_totals(pairs(spark, folder), fx.cases(spark, folder))


@check("d12_relabel_counts", """select case_id, count(*) filter (l = 3) as before_3, count(*) filter (l = 4) as before_4, count(*) filter (l = 5) as before_5,
       count(*) filter (n = 2) as after_2, count(*) filter (n = 3) as after_3, count(*) filter (n = 4) as after_4, count(*) filter (l in (3, 4, 5)) as total_converted
       from (select case_id, lesion + 1 as l, case lesion + 1 when 3 then 2 when 4 then 3 when 5 then 4 else lesion + 1 end as n from vox) group by all""", "vox")
def _(spark, folder):
    return profile.relabel_counts(fx.voxels(spark, folder).withColumn("lesion", F.col("lesion") + 1))


@check("a15_relabelled_volumes", "select case_id, z, y, x, case lesion + 1 when 3 then 2 when 4 then 3 when 5 then 4 else lesion + 1 end as lesion from vox", "vox")
def _(spark, folder):
    v = fx.voxels(spark, folder).withColumn("lesion", F.col("lesion") + 1)
    return profile.relabel(v).select("case_id", "z", "y", "x", "lesion")


@check("a16_lesion_map", """select case_id, coalesce(string_agg(printf('slice_%03d', z) || '=' || labels, ';' order by z), '') as entries from cases
       left join (select case_id, z, string_agg(label::varchar, '/' order by label) as labels from pairs group by all) using (case_id) group by case_id""", "cases", "pairs")
def _(spark, folder):
    rows = profile.lesion_map(pairs(spark, folder), fx.cases(spark, folder))
    entries = F.transform(F.map_entries("slice_lesion_labels"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"].cast("array<string>"), "/")))
    return rows.select("case_id", F.array_join(F.array_sort(entries), ";").alias("entries"))


@check("d32_label_slices", "select * from tcounts", "tcounts")
def _(spark, folder):
    return sampling.label_slice_counts(training_pairs(spark, folder))


@check("d33_rarest_lesion", "select * from strata", "strata")
def _(spark, folder):
    return sampling.rarest_lesion(fx.slices(spark, folder), training_pairs(spark, folder))


@check("d9_sparse_incidence", "select lesion as label, count(distinct case_id) as patients, count(distinct (case_id, z)) as slices from marks group by all", "marks")
def _(spark, folder):
    return profile.label_incidence(profile.slice_label_pairs(fx.marked_voxels(spark, folder)))


@check("i5_label_profile", """select c.case_id, count(distinct z) as lesion_slices, count(distinct label) as n_labels from cases c left join pairs using (case_id) group by c.case_id""", "cases", "pairs")
def _(spark, folder):
    rows = profile_labels(fx.voxels(spark, folder), fx.cases(spark, folder)).cases
    return rows.select("case_id", "lesion_slices", F.size("labels").alias("n_labels"))
