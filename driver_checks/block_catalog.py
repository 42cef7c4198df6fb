"""Checks of the file catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_checks import fixtures as fx
from driver_checks.registry import check, extend
from voxtable.functions import names
from voxtable.sources import catalog

extend({
    "valid": """select coalesce(c.case_id, l.case_id) as case_id, c.case_id is not null as ct_exists, l.case_id is not null as lesion_exists,
        case when l.case_id is not null then c.shape end as ct_shape, case when c.case_id is not null then l.shape end as lesion_shape,
        coalesce(c.shape = l.shape, false) as shape_match, coalesce(c.shape = l.shape, false) as valid,
        case when c.case_id is null or l.case_id is null then 'Missing files' when c.shape <> l.shape then 'Shape mismatch' end as error
        from cts c full join lesion_files l on l.case_id = c.case_id""",
    "masks_of": """select c.case_id, coalesce(bool_or(mask_type = 'lung_mask'), false) as lung_mask, coalesce(bool_or(mask_type = 'upper_lung'), false) as upper_lung,
        coalesce(bool_or(mask_type = 'lower_lung'), false) as lower_lung, coalesce(bool_or(mask_type = 'lobe_mask'), false) as lobe_mask
        from cts c left join mask_files m using (case_id) group by c.case_id""",
    "unfinished": "select case_id from cts where case_id not in (select case_id from mask_files where mask_type <> 'lobe_mask' group by all having count(distinct mask_type) = 3)",
}, {"valid": ["cts", "lesion_files"], "masks_of": ["cts", "mask_files"], "unfinished": ["cts", "mask_files"]})


def cts(spark, folder):
    return catalog.ct_files(fx.ct_catalog(spark, folder))


def lesion_rows(spark, folder):
    return catalog.lesion_files(fx.lesion_catalog(spark, folder))


def masks(spark, folder):
    return catalog.mask_files(fx.mask_catalog(spark, folder))


@check("a7_available_cases", "select case_id from lesion_files semi join cts using (case_id)", "lesion_files", "cts")
def _(spark, folder):
    return catalog.available_cases(lesion_rows(spark, folder), cts(spark, folder))


@check("a8_ct_files", "select name, case_id from cts", "cts")
def _(spark, folder):
    return cts(spark, folder).select("name", "case_id")


@check("a9_cases_with_masks", "select case_id from mask_files where mask_type = 'lung_mask'", "mask_files")
def _(spark, folder):
    return catalog.cases_with_lung_masks(fx.mask_catalog(spark, folder))


@check("b23_file_paths", "select case_id, 'images/CT_' || case_id || '_0000.nii.gz' as ct, 'segs/CT_' || case_id || '.nii.gz' as lesion from cts", "cts")
def _(spark, folder):
    c = F.col("case_id")
    return cts(spark, folder).select("case_id", names.ct_file(c, "images").alias("ct"), names.lesion_file(c, "segs/").alias("lesion"))


@check("b26_case_list", "select case_id from cts semi join lesion_files using (case_id)", "cts", "lesion_files")
def _(spark, folder):
    return catalog.listed_cases(cts(spark, folder).select("case_id"), lesion_rows(spark, folder).select("case_id"))


@check("c2_missing_ct", "select case_id from cts anti join lesion_files using (case_id)", "cts", "lesion_files")
def _(spark, folder):
    return catalog.cases_without_ct(cts(spark, folder), lesion_rows(spark, folder))


@check("c3_validate_cases", "select * from valid", "valid")
def _(spark, folder):
    return catalog.validated_cases(cts(spark, folder), lesion_rows(spark, folder))


@check("c4_mask_availability", "select * from masks_of", "masks_of")
def _(spark, folder):
    return catalog.mask_availability(cts(spark, folder), masks(spark, folder))


@check("c5_validate_with_masks", """select v.*, lung_mask, upper_lung, lower_lung, lobe_mask, lung_mask or upper_lung or lower_lung or lobe_mask as has_precomputed_masks
       from valid v join masks_of using (case_id)""", "valid", "masks_of")
def _(spark, folder):
    validated = catalog.validated_cases(cts(spark, folder), lesion_rows(spark, folder))
    return catalog.validated_with_masks(validated, masks(spark, folder))


@check("c6_unfinished_cases", "select * from unfinished", "unfinished")
def _(spark, folder):
    return catalog.unfinished_cases(cts(spark, folder).select("case_id"), masks(spark, folder))


@check("c7_complete_slices", "select case_id from lesion_files semi join cts using (case_id) semi join (select case_id from mask_files where mask_type = 'lung_mask') using (case_id)", "lesion_files", "cts", "mask_files")
def _(spark, folder):
    lungs = masks(spark, folder).where("mask_type = 'lung_mask'")
    return catalog.complete_slices(lesion_rows(spark, folder).select("case_id"), cts(spark, folder), lungs)


@check("c12_setup", """select (select count(*) from cts) as ct_files, (select count(*) from lesion_files) as lesion_files, (select count(*) from lesion_files semi join cts using (case_id)) as available_cases,
       '' as issues, true as setup_valid""", "cts", "lesion_files")
def _(spark, folder):
    return catalog.analysis_setup(cts(spark, folder), lesion_rows(spark, folder))


@check("c12_mask_setup", "select (select count(*) from cts) as ct_files, '' as issues, true as setup_valid", "cts")
def _(spark, folder):
    return catalog.mask_setup(cts(spark, folder))
