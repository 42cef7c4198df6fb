"""Checks of the annotation roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_checks import fixtures as fx
from driver_checks.registry import check, extend
from voxtable.functions import terms
from voxtable.operators import annotations as an
from voxtable.plans.annotation_rollup import roll_up

extend({
    "axial_mode": """select file_id, axial as term from (select file_id, axial, row_number() over (partition by file_id order by count(*) desc, min(row_no)) as r
        from filed where axial is not null group by file_id, axial) where r = 1""",
    "manifest_mode": """select file_id, manifestation as term from (select file_id, manifestation, row_number() over (partition by file_id order by count(*) desc, min(row_no)) as r
        from filed where manifestation is not null group by file_id, manifestation) where r = 1""",
    "overall": """select f.file_id, coalesce(an.name, a.term, 'unknown') as overall_axial_distribution, coalesce(mn.name, m.term, 'unknown') as overall_manifestation
        from (select distinct file_id from filed) f left join axial_mode a using (file_id) left join axial_names an on an.term = a.term
        left join manifest_mode m on m.file_id = f.file_id left join manifest_names mn on mn.term = m.term""",
    "rois": """select file_id, row_no, layer::bigint - 1 as layer, coalesce(an.name, axial, 'unknown') as axial, coalesce(mn.name, manifestation, 'unknown') as manifestation
        from filed left join axial_names an on an.term = axial left join manifest_names mn on mn.term = manifestation where layer is not null""",
    "patterns": "select distinct file_id, case when regexp_replace(file_id, '[0-9\\s]+', '', 'g') = '' then 'Unknown' else regexp_replace(file_id, '[0-9\\s]+', '', 'g') end as disease_pattern from filed",
}, {
    "axial_mode": ["filed"], "manifest_mode": ["filed"], "overall": ["filed", "axial_mode", "manifest_mode", "axial_names", "manifest_names"],
    "rois": ["filed", "axial_names", "manifest_names"], "patterns": ["filed"],
})


@check("a1_named_rows", "select row_no, file_id, layer::double as layer, axial, manifestation, lesion from filed", "filed")
def _(spark, folder):
    return an.with_file(fx.annotations(spark, folder)).withColumn("layer", F.col("layer").cast("double"))


@check("b1_disease_pattern", "select file_id, disease_pattern from patterns", "patterns")
def _(spark, folder):
    rows = an.with_file(fx.annotations(spark, folder)).select("file_id").distinct()
    return rows.withColumn("disease_pattern", terms.disease_pattern(F.col("file_id")))


@check("b2_axial_terms", "select row_no, coalesce(n.name, axial) as term from notes left join axial_names n on n.term = axial", "notes", "axial_names")
def _(spark, folder):
    return fx.annotations(spark, folder).select("row_no", terms.axial_name(F.col("axial")).alias("term"))


@check("b3_manifestation_terms", "select row_no, coalesce(n.name, manifestation) as term from notes left join manifest_names n on n.term = manifestation", "notes", "manifest_names")
def _(spark, folder):
    return fx.annotations(spark, folder).select("row_no", terms.manifestation_name(F.col("manifestation")).alias("term"))


@check("b4_zero_based_layer", "select row_no, trunc(layer)::bigint - 1 as layer from notes", "notes")
def _(spark, folder):
    return fx.annotations(spark, folder).select("row_no", terms.zero_based_layer(F.col("layer")).alias("layer"))


@check("b5_unknown_terms", "select row_no, coalesce(axial, 'unknown') as axial, coalesce(manifestation, 'unknown') as manifestation from notes", "notes")
def _(spark, folder):
    return fx.annotations(spark, folder).select(
        "row_no", terms.or_unknown(F.col("axial")).alias("axial"), terms.or_unknown(F.col("manifestation")).alias("manifestation")
    )


@check("b24_five_class", "select file_id, case when disease_pattern in ('UIP', 'NSIP', 'OP', 'Normal') then disease_pattern else 'Other' end as five_class from patterns", "patterns")
def _(spark, folder):
    rows = an.with_file(fx.annotations(spark, folder)).select("file_id").distinct()
    return rows.withColumn("five_class", terms.five_class(terms.disease_pattern(F.col("file_id"))))


@check("d1_overall_terms", "select * from overall", "overall")
def _(spark, folder):
    return an.overall_terms(fx.annotations(spark, folder))


@check("d2_lesion_presence", """select file_id, max((coalesce(lesion, '') = '蜂窝')::int) || ',' || max((coalesce(lesion, '') = '网格')::int) || ',' ||
       max((coalesce(lesion, '') = '实变')::int) || ',' || max((coalesce(lesion, '') = 'GGO')::int) as abnormal_manifestation_presence from filed group by all""", "filed")
def _(spark, folder):
    return an.lesion_presence(fx.annotations(spark, folder))


@check("d3_roi_arrays", """select f.file_id, coalesce(string_agg(layer::varchar, ',' order by layer, row_no), '') as roi_layers, coalesce(string_agg(axial, ',' order by layer, row_no), '') as roi_axial_distributions,
       coalesce(string_agg(manifestation, ',' order by layer, row_no), '') as roi_manifestations from (select distinct file_id from filed) f left join rois using (file_id) group by all""", "filed", "rois")
def _(spark, folder):
    return an.roi_arrays(fx.annotations(spark, folder))


@check("d4_lesion_marks", """select count(*) filter (lesion = '蜂窝') as honeycombing, count(*) filter (lesion = '网格') as reticulation,
       count(*) filter (lesion = '实变') as consolidation, count(*) filter (lesion = 'GGO') as ggo from filed""", "filed")
def _(spark, folder):
    return an.lesion_mark_counts(fx.annotations(spark, folder))


@check("d5_roi_statistics", """select count(*) as total_files, sum(n)::bigint as total_rois, round(avg(n), 6) as avg_rois_per_file, min(n) as min_rois_per_file, max(n) as max_rois_per_file
       from (select file_id, count(layer) as n from filed group by all)""", "filed")
def _(spark, folder):
    return an.roi_statistics(an.case_records(fx.annotations(spark, folder)))


@check("d6_category_counts", """select 'disease_pattern' as attribute, disease_pattern as value, count(*) as count from patterns group by all union all
       select 'overall_axial_distribution', overall_axial_distribution, count(*) from overall group by all union all
       select 'overall_manifestation', overall_manifestation, count(*) from overall group by all""", "patterns", "overall")
def _(spark, folder):
    return an.category_counts(an.case_records(fx.annotations(spark, folder)))


@check("i4_annotation_rollup", """select p.file_id as filename, disease_pattern, overall_axial_distribution, overall_manifestation,
       coalesce(string_agg(layer::varchar, ',' order by layer, row_no), '') as roi_layers, coalesce(string_agg(r.axial, ',' order by layer, row_no), '') as roi_axial_distributions,
       coalesce(string_agg(r.manifestation, ',' order by layer, row_no), '') as roi_manifestations
       from patterns p join overall using (file_id) left join rois r on r.file_id = p.file_id group by all""", "patterns", "overall", "rois")
def _(spark, folder):
    records = roll_up(fx.annotations(spark, folder)).records
    return records.select(
        "filename", "disease_pattern", "overall_axial_distribution", "overall_manifestation", "roi_layers", "roi_axial_distributions", "roi_manifestations")
