"""Checks of splits, draws and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_checks import fixtures as fx
from driver_checks.block_labels import training_pairs
from driver_checks.registry import check, extend
from voxtable.functions.joins import shuffled
from voxtable.functions.names import export_name
from voxtable.operators import profile, regions, sampling, slices
from voxtable.schema import label_dim


def number(key: str, seed: str) -> str:
    """SQL for a seeded draw in [0, 2³²)."""
    return f"(('0x' || substr(md5({key} || '|{seed}'), 1, 8))::bigint)"


KEY = "printf('%s-%03d', case_id::varchar, z)"
extend({
    "keyed": f"select *, {KEY} as key from strata",
    "split": """select case_id, z, stratum, case when r <= floor(n*0.1 + 0.5) then 'test' when r <= floor(n*0.1 + 0.5) + floor(n*0.1 + 0.5) then 'valid' else 'train' end as split
        from (select *, row_number() over (partition by stratum order by md5(key || '|42'), key) as r, count(*) over (partition by stratum) as n from keyed)""",
    "case_split": """select case_id, case when r <= floor(n*0.1 + 0.5) then 'test' when r <= floor(n*0.1 + 0.5) + floor(n*0.1 + 0.5) then 'valid' else 'train' end as split
        from (select case_id, row_number() over (partition by s order by md5(case_id::varchar || '|42'), case_id::varchar) as r, count(*) over (partition by s) as n
          from (select case_id, max(stratum) as s from strata group by all))""",
    "lacking": """select s.case_id, s.z, list_sort(coalesce(list(label) filter (label > 1), [])) as present,
        list_filter([2, 3, 4, 5]::bigint[], lambda l: not list_contains(coalesce(list(label), []), l)) as absent
        from slices s left join tpairs t using (case_id, z) group by s.case_id, s.z""",
    "drawn": f"""select case_id, z, negative as empty_target, case when negative then absent[na % len(absent) + 1] when len(present) > 0 then present[np % len(present) + 1] else 1 end as label
        from (select *, {number(KEY, '42n')} / 4294967296 < 0.25 and len(absent) > 0 as negative, {number(KEY, '42a')} as na, {number(KEY, '42p')} as np from lacking)""",
    "classed": "select case_id, z, coalesce(bool_and(label <= 1), true) as background from slices left join tpairs using (case_id, z) group by all",
}, {"keyed": ["strata"], "split": ["keyed"], "case_split": ["strata"], "lacking": ["slices", "tpairs"], "drawn": ["lacking"], "classed": ["slices", "tpairs"]})


def strata(spark, folder, pairs=None):
    return sampling.rarest_lesion(fx.slices(spark, folder), training_pairs(spark, folder) if pairs is None else pairs)


def key():
    return export_name(F.col("case_id"), F.col("z"))


def label_sets(spark, folder, pairs=None):
    sets = profile.slice_label_sets(training_pairs(spark, folder) if pairs is None else pairs)
    rows = fx.slices(spark, folder).join(shuffled(sets), ["case_id", "z"], "left")
    return rows.withColumn("labels", F.coalesce("labels", F.array().cast("array<int>")))


def classes(spark, folder):
    rows = sampling.absent_labels(label_sets(spark, folder))
    return rows.select("case_id", "z", (F.size("present") == 0).alias("background"))


@check("g1_slice_split", "select * from split", "split")
def _(spark, folder):
    return sampling.stratified_split(strata(spark, folder), ["stratum"], key())


@check("a14_split_rows", "select split, count(*) as slices from split group by all", "split")
def _(spark, folder):
    return sampling.stratified_split(strata(spark, folder), ["stratum"], key()).groupBy("split").agg(F.count("*").alias("slices"))


@check("g2_case_split", "select s.case_id, z, stratum, split from strata s join case_split using (case_id)", "strata", "case_split")
def _(spark, folder):
    return sampling.case_split(strata(spark, folder))


@check("d43_split_profile", """select split, count(*) as slices, count(distinct case_id) as patients, round(avg((len(present) = 0)::int), 6) as background_share,
       count(*) filter (list_contains(present, 2)) as slices_label_2, count(*) filter (list_contains(present, 3)) as slices_label_3,
       count(*) filter (list_contains(present, 4)) as slices_label_4, count(*) filter (list_contains(present, 5)) as slices_label_5
       from split join lacking using (case_id, z) group by all""", "split", "lacking")
def _(spark, folder):
    pairs = training_pairs(spark, folder)  # voxels are read once for both
    split = sampling.stratified_split(strata(spark, folder, pairs), ["stratum"], key())
    return sampling.split_profile(split.join(shuffled(sampling.absent_labels(label_sets(spark, folder, pairs))), ["case_id", "z"]))


@check("c10_absent_labels", "select case_id, z, array_to_string(present, ',') as present, array_to_string(absent, ',') as absent from lacking", "lacking")
def _(spark, folder):
    return sampling.absent_labels(label_sets(spark, folder))


@check("g3_label_draw", "select case_id, z, label, empty_target from drawn", "drawn")
def _(spark, folder):
    rows = sampling.label_draw(sampling.absent_labels(label_sets(spark, folder)), key())
    return rows.drop("present", "absent")


@check("g4_caption_draw", f"""select case_id, z, label, empty_target, (case label when 1 then ['normal', 'healthy lung'] when 2 then ['ground glass opacity', 'GGO'] when 3 then ['reticulation', 'reticular pattern']
       when 4 then ['consolidation', 'airspace consolidation'] else ['honeycombing', 'honeycomb pattern'] end)[{number(KEY, '42c')} % 2 + 1] as caption from drawn""", "drawn")
def _(spark, folder):
    drawn = sampling.label_draw(sampling.absent_labels(label_sets(spark, folder)), key()).drop("present", "absent")
    return sampling.caption_draw(drawn, label_dim(spark), key())


@check("e21_flips", f"""select case_id, z, case when {number(KEY, '42y')} % 2 = 1 then 15 - y else y end as y, case when {number(KEY, '42x')} % 2 = 1 then 19 - x else x end as x, lesion from vox where lesion > 0""", "vox")
def _(spark, folder):
    rows = fx.voxels(spark, folder).where("lesion > 0").join(fx.cases(spark, folder).select("case_id", "ny", "nx"), "case_id")
    return sampling.flipped(rows, key()).select("case_id", "z", "y", "x", "lesion")


@check("g5_background_slices", """select case_id, z, field, place, lung_voxels from (
         select case_id, z, lung_voxels, (z*3 // 12)::bigint as field, row_number() over (partition by case_id, z*3 // 12 order by lung_voxels desc, z) as place
         from prof where lesion_voxels = 0 and z >= 1 and z < 11) join (select case_id, ceil(count(*) filter (lesion_voxels > 0)*0.3::double/(1 - 0.3::double)/3) as quota from prof group by all) using (case_id)
       where place <= quota""", "prof")
def _(spark, folder):
    return sampling.background_slices(regions.slice_profile(fx.voxels(spark, folder)), fx.cases(spark, folder))


@check("g6_sampling_weights", """select case_id, z, background, round(case when background then 0.3 / count(*) filter (background) over () else 0.7 / count(*) filter (not background) over () end * 1000, 6)::double as weight
       from classed""", "classed")
def _(spark, folder):
    return sampling.sampling_weights(classes(spark, folder)).withColumn("weight", F.col("weight") * 1000)


@check("g6_weighted_draws", f"""select draw, c.background, case_id, z from (
         select z as draw0, case_id*12 + z as draw, {number("(case_id*12 + z)::varchar", '42b')} / 4294967296 < 0.3 as background, {number("(case_id*12 + z)::varchar", '42r')} as r from slices) d
       join (select case_id, z, background, row_number() over (partition by background order by md5({KEY} || '|42'), {KEY}) as place, count(*) over (partition by background) as n from classed) c
         on c.background = d.background and c.place = d.r % c.n + 1""", "slices", "classed")
def _(spark, folder):
    draws = fx.slices(spark, folder).select((F.col("case_id") * 12 + F.col("z")).alias("draw"))
    return sampling.weighted_draws(classes(spark, folder), key(), draws)
