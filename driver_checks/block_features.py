"""Checks of lesion types, regions and depth measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_checks import fixtures as fx
from driver_checks.registry import check, extend
from voxtable.functions import geometry
from voxtable.operators import depth, distance, lesions, regions
from voxtable.schema import label_dim
from voxtable.session import written

# Bin edges as the operator forms them: (bin + 1) * max / 10.
_BIN = "case " + " ".join(f"when sqrt(d) < {n + 1}*max_radius_mm/10 then {n}" for n in range(10)) + " end"

extend({
    "counts": "select case_id, lesion, count(*) as voxels from vox where lesion > 0 group by all",
    "lsum": """select c.case_id,
        coalesce(sum(voxels) filter (lesion = 1), 0)::bigint as n_honeycomb, coalesce(sum(voxels) filter (lesion = 2), 0)::bigint as n_reticulation,
        coalesce(sum(voxels) filter (lesion = 3), 0)::bigint as n_ground_glass_opacity, coalesce(sum(voxels) filter (lesion = 4), 0)::bigint as n_consolidation,
        coalesce(sum(voxels), 0)::bigint as total_lesion_voxels, coalesce(sum(voxels), 0) * any_value(sz*sy*sx) as total_lesion_volume,
        coalesce(string_agg(name, ',' order by lesion), '') as lesion_types, arg_max(name, voxels*10 - lesion) as dominant_lesion
        from cases c left join counts using (case_id) left join labels_a using (lesion) group by c.case_id""",
    "rcounts": """select case_id, z_cut,
        coalesce(sum(lung_voxels) filter (z >= z_cut), 0)::bigint as upper_lung_voxels, coalesce(sum(lung_voxels) filter (z < z_cut), 0)::bigint as lower_lung_voxels,
        coalesce(sum(lesion_voxels) filter (z >= z_cut), 0)::bigint as upper_lesion_voxels, coalesce(sum(lesion_voxels) filter (z < z_cut), 0)::bigint as lower_lesion_voxels,
        sum(lung_voxels)::bigint as total_lung_voxels, sum(lesion_voxels)::bigint as total_lesion_voxels
        from prof join cut using (case_id) group by all""",
    "shares": """select r.*, c.sz*c.sy*c.sx as vol,
        case when upper_lung_voxels > 0 then upper_lesion_voxels / upper_lung_voxels else 0 end as upper_lesion_ratio,
        case when lower_lung_voxels > 0 then lower_lesion_voxels / lower_lung_voxels else 0 end as lower_lesion_ratio,
        case when total_lesion_voxels > 0 then upper_lesion_voxels / total_lesion_voxels else 0 end as upper_lesion_proportion,
        case when total_lesion_voxels > 0 then lower_lesion_voxels / total_lesion_voxels else 0 end as lower_lesion_proportion
        from rcounts r join cases c using (case_id)""",
    "distribution": """select *, case
        when upper_lesion_proportion >= 0.65 then 'upper_predominant' when lower_lesion_proportion >= 0.65 then 'lower_predominant'
        when upper_lesion_proportion >= 0.20 and lower_lesion_proportion >= 0.20 then
          case when upper_lesion_ratio > lower_lesion_ratio*1.5 then 'upper_predominant'
               when lower_lesion_ratio > upper_lesion_ratio*1.5 then 'lower_predominant' else 'diffuse' end
        when upper_lesion_proportion < 0.20 and lower_lesion_proportion < 0.20 then 'minimal'
        when upper_lesion_proportion > lower_lesion_proportion then 'upper_predominant' else 'lower_predominant' end as distribution_pattern from shares""",
    "radius": "select case_id, max(dist_mm) as max_radius_mm from feat group by all",
    "axial": """select c.case_id, coalesce(max(case when n > 0 then max_radius_mm end), 0) as max_radius_mm, coalesce(max(mean_d), 0) as mean_distance_mm,
        coalesce(max(min_d), 0) as min_distance_mm, coalesce(max(max_d), 0) as max_distance_mm, coalesce(max(n), 0)::bigint as total_lesion_voxels,
        coalesce(max(near), 0)::bigint as peripheral_voxels, coalesce(max(n - near), 0)::bigint as central_voxels,
        coalesce(max(near / n), 0) as peripheral_ratio, coalesce(max((n - near) / n), 0) as central_ratio
        from cases c left join (select case_id, max_radius_mm, avg(dist_mm) as mean_d, min(dist_mm) as min_d, max(dist_mm) as max_d, count(*) as n,
            count(*) filter (dist_mm <= 10 or dist_mm <= 0.2*max_radius_mm) as near
            from feat join radius using (case_id) where lesion > 0 group by all) using (case_id) group by all""",
    "axial_named": """select *, case when total_lesion_voxels = 0 then 'unknown' when peripheral_ratio >= 0.7 then 'peripheral'
        when central_ratio >= 0.7 then 'central' else 'diffuse_scattered' end as axial_distribution from axial""",
    "bandspine": """select case_id, band, name as band_name from cases, (values (0, 'distance_0_1mm'), (1, 'distance_1_2mm'), (2, 'distance_2_3mm'),
        (3, 'distance_3_5mm'), (4, 'distance_5mm_plus')) t(band, name)""",
    "banded": """select s.case_id, s.band::bigint as band, band_name, count(f.case_id) as voxels,
        case when sum(count(f.case_id)) over (partition by s.case_id) > 0 then count(f.case_id) / sum(count(f.case_id)) over (partition by s.case_id) * 100 else 0 end as percent
        from bandspine s left join feat f on f.case_id = s.case_id and f.lesion > 0 and
          s.band = case when dist_mm < 1 then 0 when dist_mm < 2 then 1 when dist_mm < 3 then 2 when dist_mm < 5 then 3 else 4 end
        group by s.case_id, s.band, band_name""",
    "pleural": """select c.case_id, count(f.case_id)::bigint as total_lesion_voxels, coalesce(min(dist_mm), 0) as min_distance_mm,
        count(*) filter (dist_mm <= 3)::bigint as subpleural_voxels,
        case when count(f.case_id) > 0 then count(*) filter (dist_mm <= 3) / count(f.case_id) else 0 end as subpleural_ratio,
        coalesce(avg(dist_mm) filter (dist_mm <= 3), 0) as mean_subpleural_distance_mm,
        coalesce(min(dist_mm) <= 3, false) as subpleural_involvement,
        case when min(dist_mm) <= 3 then 'subpleural' else 'subpleural_omitted' end as subpleural_features,
        case when count(f.case_id) > 0 then count(*) filter (dist_mm < 2) / count(f.case_id) * 100 else 0 end as within_2mm_percent,
        count(*) filter (dist_mm <= 0.5)::bigint as contact_voxels,
        case when count(f.case_id) > 0 then count(*) filter (dist_mm <= 0.5) / count(f.case_id) * 100 else 0 end as contact_percent,
        count(*) filter (dist_mm <= 0.5) > 0 as direct_contact
        from cases c left join feat f on f.case_id = c.case_id and f.lesion > 0 group by c.case_id""",
    "contact": "select case_id, (z*16 + y)*20 + x as p, z, y, x from feat where lesion > 0 and dist_mm <= 0.5",
    "contact_links": """select a.case_id, a.p, b.p as q from contact a join contact b on a.case_id = b.case_id
        and abs(a.z-b.z) <= 1 and abs(a.y-b.y) <= 1 and abs(a.x-b.x) <= 1 and a.p <> b.p""",
    "contact_cc": """@contact_cc(case_id, p, root) using key (case_id, p)@select case_id, p, p from contact union
        select e.case_id, e.q, min(c.root) from contact_cc c join contact_links e on e.case_id = c.case_id and e.p = c.p
        join recurring.contact_cc r on r.case_id = e.case_id and r.p = e.q where c.root < r.root group by 1, 2""",
    "alldist": f"""select v.case_id, case when v.lung = 1 and v.lesion > 0 then 1 else 0 end as hit, v.lung, {_BIN} as bin, max_radius_mm
        from vox v join pass_z using (case_id, z, y, x) join radius using (case_id)""",
    "binned": "select case_id, bin, count(*) as voxels, sum(hit) as lesion_voxels from alldist where bin is not null group by all",
    "gradient": """select r.case_id, i.bin::bigint as bin, (i.bin*max_radius_mm/10 + (i.bin+1)*max_radius_mm/10)/2 as bin_center, coalesce(voxels, 0)::bigint as voxels,
        coalesce(lesion_voxels, 0)::bigint as lesion_voxels, coalesce(lesion_voxels / voxels, 0) as lesion_density
        from radius r cross join range(10) i(bin) left join binned b on b.case_id = r.case_id and b.bin = i.bin""",
}, {
    "counts": ["vox"], "lsum": ["cases", "counts", "labels_a"], "rcounts": ["prof", "cut"], "shares": ["rcounts", "cases"],
    "distribution": ["shares"], "radius": ["feat"], "axial": ["cases", "feat", "radius"], "axial_named": ["axial"],
    "bandspine": ["cases"], "banded": ["bandspine", "feat"], "pleural": ["cases", "feat"], "contact": ["feat"],
    "contact_links": ["contact"], "contact_cc": ["contact", "contact_links"], "alldist": ["vox", "pass_z", "radius"],
    "binned": ["alldist"], "gradient": ["binned", "radius"],
})


def depths(spark, folder):
    return distance.voxel_features(fx.voxels(spark, folder), fx.cases(spark, folder))


def profile(spark, folder):
    return regions.slice_profile(fx.voxels(spark, folder))


def histogram(spark, folder):
    return written(depth.depth_histogram(depths(spark, folder)), "depth")


@check("b9_voxel_volume", "select case_id, round(sz*sy*sx, 6) as volume from cases", "cases")
def _(spark, folder):
    c = fx.cases(spark, folder)
    return c.select("case_id", geometry.voxel_volume(F.col("sz"), F.col("sy"), F.col("sx")).alias("volume"))


@check("b6_label_names", "select case_id, lesion, name, voxels from counts join labels_a using (lesion)", "counts", "labels_a")
def _(spark, folder):
    return lesions.named(lesions.lesion_counts(fx.voxels(spark, folder)), label_dim(spark))


@check("c9_dimensions", """select case_id, name, count(*) as voxels, round(count(*) * sz*sy*sx, 6) as volume_mm3 from vox join labels_a using (lesion)
       join cases using (case_id) group by case_id, name, sz, sy, sx""", "vox", "labels_a", "cases")
def _(spark, folder):
    rows = lesions.lesion_types(fx.voxels(spark, folder), fx.cases(spark, folder), label_dim(spark))
    return rows.select("case_id", "name", "voxels", "volume_mm3")


@check("d13_lesion_types", """select case_id, lesion, name, voxels, round(voxels*sz*sy*sx, 6) as volume_mm3,
       round(voxels / sum(voxels) over (partition by case_id) * 100, 6) as percent
       from counts join labels_a using (lesion) join cases using (case_id)""", "counts", "labels_a", "cases")
def _(spark, folder):
    return lesions.lesion_types(fx.voxels(spark, folder), fx.cases(spark, folder), label_dim(spark))


@check("d14_dominant_lesion", "select case_id, lesion_types, total_lesion_voxels, dominant_lesion from lsum", "lsum")
def _(spark, folder):
    return lesions.lesion_summary(profile(spark, folder), fx.cases(spark, folder)).select(
        "case_id", "lesion_types", "total_lesion_voxels", "dominant_lesion"
    )


@check("d13_lesion_summary", """select case_id, n_honeycomb, n_reticulation, n_ground_glass_opacity, n_consolidation, lesion_types,
       total_lesion_voxels, round(total_lesion_volume, 6) as total_lesion_volume, dominant_lesion from lsum""", "lsum")
def _(spark, folder):
    return lesions.lesion_summary(profile(spark, folder), fx.cases(spark, folder))


@check("d15_lung_coverage", """select case_id, sum(lung_voxels)::bigint as lung_voxels, sum(lesion_voxels)::bigint as lesion_voxels,
       round(coalesce(sum(lesion_voxels) / nullif(sum(lung_voxels), 0), 0), 6) as lesion_lung_ratio,
       round(coalesce(sum(lesion_voxels) / nullif(sum(lung_voxels), 0), 0) * 100, 6) as coverage_percent from prof group by all""", "prof")
def _(spark, folder):
    return lesions.lung_coverage(profile(spark, folder))


@check("c1_lesion_in_lung", "select case_id, z, y, x, lesion from vox where lesion > 0 and lung = 1", "vox")
def _(spark, folder):
    v = fx.voxels(spark, folder)
    sparse = v.where("lesion > 0").select("case_id", "z", "y", "x", "lesion")
    return lesions.lesions_in_mask(sparse, v.where("lung > 0"))


@check("d16_region_cut", "select case_id, z_cut from cut", "cut")
def _(spark, folder):
    return regions.region_cut(profile(spark, folder))


@check("d17_lung_distribution", """select case_id, z_cut, upper_lung_voxels, lower_lung_voxels, upper_lesion_voxels, lower_lesion_voxels, total_lung_voxels,
       total_lesion_voxels, round(upper_lung_voxels*vol, 6) as upper_lung_volume, round(lower_lung_voxels*vol, 6) as lower_lung_volume,
       round(upper_lesion_voxels*vol, 6) as upper_lesion_volume, round(lower_lesion_voxels*vol, 6) as lower_lesion_volume,
       round(total_lung_voxels*vol, 6) as total_lung_volume, round(total_lesion_voxels*vol, 6) as total_lesion_volume,
       round(upper_lesion_ratio, 6) as upper_lesion_ratio, round(lower_lesion_ratio, 6) as lower_lesion_ratio,
       round(upper_lesion_proportion, 6) as upper_lesion_proportion, round(lower_lesion_proportion, 6) as lower_lesion_proportion,
       distribution_pattern from distribution""", "distribution")
def _(spark, folder):
    return regions.lung_distribution(regions.region_counts(profile(spark, folder)), fx.cases(spark, folder))


@check("d18_mask_distribution", """select case_id, ((min(z) filter (z >= 7 and lung = 1) + max(z) filter (z < 7 and lung = 1)) // 2)::bigint as z_cut,
       count(*) filter (z >= 7 and lung = 1) as upper_lung_voxels, count(*) filter (z < 7 and lung = 1) as lower_lung_voxels,
       count(*) filter (z >= 7 and lung = 1 and lesion > 0) as upper_lesion_voxels,
       count(*) filter (z < 7 and lung = 1 and lesion > 0) as lower_lesion_voxels,
       count(*) filter (lung = 1) as total_lung_voxels, count(*) filter (lung = 1 and lesion > 0) as total_lesion_voxels from vox group by all""", "vox")
def _(spark, folder):
    return regions.mask_region_counts(fx.masked_voxels(spark, folder))


@check("d19_lung_statistics", """select case_id, total_lung_voxels as total_voxels, round(total_lung_voxels*vol, 6) as total_volume_mm3, z_cut,
       upper_lung_voxels as upper_voxels, lower_lung_voxels as lower_voxels, round(upper_lung_voxels*vol, 6) as upper_volume_mm3,
       round(lower_lung_voxels*vol, 6) as lower_volume_mm3 from shares""", "shares")
def _(spark, folder):
    return regions.lung_statistics(profile(spark, folder), fx.cases(spark, folder))


@check("e1_distance", "select case_id, z, y, x, lesion, round(dist_mm, 6) as dist_mm from feat", "feat")
def _(spark, folder):
    return depths(spark, folder)


@check("e1_distance_small_tiles", "select case_id, z, y, x, lesion, round(dist_mm, 6) as dist_mm from feat", "feat")
def _(spark, folder):
    # Tiles of 5 cells are crossed along all three axes of the phantom.
    return distance.voxel_features(fx.voxels(spark, folder), fx.cases(spark, folder), tile=5)


@check("b14_peripheral", """select case_id, count(*) as lung_voxels, count(*) filter (dist_mm <= 10 or dist_mm <= 0.2*max_radius_mm) as peripheral
       from feat join radius using (case_id) group by all""", "feat", "radius")
def _(spark, folder):
    h = histogram(spark, folder)
    deepest = h.groupBy("case_id").agg(F.max("dist_mm").alias("r"))
    near = geometry.is_peripheral(F.col("dist_mm"), F.col("r"))
    return h.join(deepest, "case_id").groupBy("case_id").agg(
        F.sum("lung_voxels").alias("lung_voxels"), F.sum(F.when(near, F.col("lung_voxels")).otherwise(0)).alias("peripheral")
    )


@check("b15_distance_band", """select case when dist_mm < 1 then 0 when dist_mm < 2 then 1 when dist_mm < 3 then 2 when dist_mm < 5 then 3 else 4 end::bigint as band,
       count(*) as voxels from feat group by all""", "feat")
def _(spark, folder):
    return depths(spark, folder).groupBy(geometry.distance_band(F.col("dist_mm")).alias("band")).agg(F.count("*").alias("voxels"))


@check("b16_concentric_zone", """select case when dist_mm <= 5 then 0 when dist_mm <= 15 then 1 else 2 end::bigint as zone, count(*) as voxels from feat group by all""", "feat")
def _(spark, folder):
    return depths(spark, folder).groupBy(geometry.concentric_zone(F.col("dist_mm")).alias("zone")).agg(F.count("*").alias("voxels"))


@check("b17_gradient_bin", """select case_id, bin::bigint as bin, count(*) as voxels from alldist
       where lung = 1 and bin is not null group by case_id, bin""", "alldist")
def _(spark, folder):
    h = histogram(spark, folder)
    deepest = h.groupBy("case_id").agg(F.max("dist_mm").alias("r"))
    binned = h.join(deepest, "case_id").withColumn("bin", geometry.gradient_bin(F.col("dist_mm"), F.col("r")))
    return binned.where("bin is not null").groupBy("case_id", "bin").agg(F.sum("lung_voxels").alias("voxels"))


@check("d20_axial_distribution", """select case_id, round(max_radius_mm, 6) as max_radius_mm, round(mean_distance_mm, 6) as mean_distance_mm,
       round(min_distance_mm, 6) as min_distance_mm, round(max_distance_mm, 6) as max_distance_mm, total_lesion_voxels, peripheral_voxels,
       central_voxels, round(peripheral_ratio, 6) as peripheral_ratio, round(central_ratio, 6) as central_ratio, axial_distribution
       from axial_named""", "axial_named")
def _(spark, folder):
    return depth.axial_distribution(histogram(spark, folder), fx.cases(spark, folder))


@check("d21_slice_distribution", """select case_id, z, count(*) as total_lesion_voxels,
       round(avg(case when dist_mm <= 10 or dist_mm <= 0.2*r then 1.0::double else 0.0::double end), 6) as peripheral_ratio, round(avg(dist_mm), 6) as mean_distance_mm
       from feat join (select case_id, z, max(dist_mm) as r from feat group by all) using (case_id, z) where lesion > 0 group by all""", "feat")
def _(spark, folder):
    return depth.slice_distribution(depths(spark, folder))


@check("d22_concentric_zones", """select s.case_id, s.zone::bigint as zone, s.name as zone_name, count(*) filter (f.lesion > 0) as lesion_count, count(f.case_id) as lung_voxels,
       round(coalesce(count(*) filter (f.lesion > 0) / nullif(count(f.case_id), 0), 0), 6) as lesion_density
       from (select case_id, zone, name from cases, (values (0, 'zone_1_peripheral'), (1, 'zone_2_intermediate'), (2, 'zone_3_central')) t(zone, name)) s
       left join feat f on f.case_id = s.case_id and s.zone = case when dist_mm <= 5 then 0 when dist_mm <= 15 then 1 else 2 end
       group by s.case_id, s.zone, s.name""", "cases", "feat")
def _(spark, folder):
    return depth.concentric_zones(histogram(spark, folder), fx.cases(spark, folder))


@check("d23_distance_gradient", """select case_id, bin, round(bin_center, 6) as bin_center, voxels, lesion_voxels, round(lesion_density, 6) as lesion_density
       from gradient""", "gradient")
def _(spark, folder):
    return depth.distance_gradient(histogram(spark, folder), fx.cases(spark, folder))


@check("d23_gradient_trend", """select case_id, round(r, 4) as correlation, case when r > 0.3 then 'increasing_centrally' when r < -0.3 then 'decreasing_centrally'
       else 'uniform' end as trend from (select case_id, case when min(lesion_density) < max(lesion_density) then corr(bin_center, lesion_density) end as r
       from gradient group by all)""", "gradient")
def _(spark, folder):
    gradient = depth.distance_gradient(histogram(spark, folder), fx.cases(spark, folder))
    return depth.gradient_trend(gradient).withColumn("correlation", F.round("correlation", 4))


@check("d24_subpleural", """select case_id, total_lesion_voxels, round(min_distance_mm, 6) as min_distance_mm, subpleural_voxels, round(subpleural_ratio, 6) as subpleural_ratio,
       round(mean_subpleural_distance_mm, 6) as mean_subpleural_distance_mm, subpleural_involvement, subpleural_features from pleural""", "pleural")
def _(spark, folder):
    rows = depth.subpleural_features(histogram(spark, folder), fx.cases(spark, folder))
    return rows.drop("within_2mm_percent", "contact_voxels", "contact_percent", "direct_contact")


@check("d25_subpleural_bands", "select case_id, band, band_name, voxels, round(percent, 6) as percent from banded", "banded")
def _(spark, folder):
    return depth.subpleural_bands(histogram(spark, folder), fx.cases(spark, folder))


@check("d26_pleural_contact", """select case_id, direct_contact, contact_voxels, round(contact_percent, 6) as contact_percent, coalesce(n, 0)::bigint as contact_regions
       from pleural left join (select case_id, count(distinct root) as n from contact_cc group by all) using (case_id)""", "pleural", "contact_cc")
def _(spark, folder):
    features = written(depths(spark, folder), "features")
    rows = depth.subpleural_features(depth.depth_histogram(features), fx.cases(spark, folder))
    found = depth.contact_regions(features)
    return rows.join(found, "case_id", "left").fillna(0, ["contact_regions"]).select(
        "case_id", "direct_contact", "contact_voxels", "contact_percent", "contact_regions"
    )
