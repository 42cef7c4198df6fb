"""Checks of mask tables, boxes and suppression."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_checks import fixtures as fx
from driver_checks.block_spatial import NEAR8, component_ctes
from driver_checks.registry import check, extend
from voxtable.functions import geometry
from voxtable.operators import masks, suppression

KEYS = ["case_id", "z"]


def iou(a: str, b: str) -> str:
    """SQL for the overlap of two boxes."""
    shared = f"(greatest(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0), 0) * greatest(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0), 0))"
    whole = f"(({a}.x1 - {a}.x0)*({a}.y1 - {a}.y0) + ({b}.x1 - {b}.x0)*({b}.y1 - {b}.y0) - {shared})"
    return f"coalesce({shared} / nullif({whole}, 0), 0)"


def greedy(name: str, boxes: str, threshold: float) -> None:
    """SQL that walks the boxes of an image by score and keeps those that overlap none kept so far."""
    extend({
        f"{name}_order": f"select *, row_number() over (partition by image_id order by score desc, box_id) as n from {boxes}",
        f"{name}_walk": f"""select image_id, n, [struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1)] as kept, true as keep, box_id from {name}_order where n = 1 union all
            select b.image_id, b.n, case when len(list_filter(w.kept, lambda k: {iou("b", "k")} > {threshold})) = 0 then list_append(w.kept, struct_pack(x0 := b.x0, y0 := b.y0, x1 := b.x1, y1 := b.y1)) else w.kept end,
              len(list_filter(w.kept, lambda k: {iou("b", "k")} > {threshold})) = 0, b.box_id
            from {name}_walk w join {name}_order b on b.image_id = w.image_id and b.n = w.n + 1""",
        name: f"select image_id, box_id from {name}_walk where keep",
    }, {f"{name}_order": [boxes], f"{name}_walk": [f"{name}_order"], name: [f"{name}_walk"]})


extend({
    "blobs": "select case_id, z, y, x, y*20 + x as p from vox where lesion > 0",
    "frames": "select distinct case_id, z from vox where lesion > 0 or z % 4 = 0",
    "columns": "select case_id, z, x*16 + y as cell from vox where lesion > 0",
    "cell_runs": """select case_id, z, min(cell) as first, max(cell) as last from (select *, cell - row_number() over (partition by case_id, z order by cell) as g from columns) group by case_id, z, g""",
    "run_list": """select case_id, z, first, first - coalesce(lag(last) over w + 1, 0) as gap, last - first + 1 as length, max(last) over (partition by case_id, z) as stop
        from cell_runs window w as (partition by case_id, z order by first)""",
    "rle": """select f.case_id, f.z, coalesce(string_agg(gap || ',' || length, ',' order by first) || case when any_value(stop) < 319 then ',' || (319 - any_value(stop)) else '' end, '320') as counts,
        coalesce(sum(length), 0)::bigint as area from frames f left join run_list r using (case_id, z) group by f.case_id, f.z""",
    "bg": "select v.case_id, v.z, v.y, v.x, v.y*20 + v.x as p from vox v semi join (select distinct case_id, z from blobs) using (case_id, z) where lesion = 0",
}, {"blobs": ["vox"], "frames": ["vox"], "columns": ["vox"], "cell_runs": ["columns"], "run_list": ["cell_runs"], "rle": ["frames", "run_list"], "bg": ["vox", "blobs"]})
extend(*component_ctes("bg_cc", "bg", "case_id, z", NEAR8))
extend({
    "tiny_holes": "select case_id, z, root from bg_cc group by all having count(*) < 6",
    "plugged": "select case_id, z, y, x, p from blobs union all select case_id, z, y, x, p from bg join bg_cc using (case_id, z, p) semi join tiny_holes using (case_id, z, root)",
}, {"tiny_holes": ["bg_cc"], "plugged": ["blobs", "bg", "bg_cc", "tiny_holes"]})
extend(*component_ctes("plugged_cc", "plugged", "case_id, z", NEAR8))
extend({
    "islands": "select case_id, z, root, count(*) as n, row_number() over (partition by case_id, z order by count(*) desc, root) as place from plugged_cc group by case_id, z, root",
    "tidy": """select q.case_id, q.z, q.y, q.x from plugged q join plugged_cc using (case_id, z, p) join islands i using (case_id, z, root)
        where i.n >= 4 or (i.place = 1 and i.n < 4)""",
    "touched": "select case_id, z from tiny_holes union select case_id, z from islands where n < 4",
    "tidy_boxes": """select d.case_id as image_id, d.z as box_id, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1, case when bool_or(t.hit) then 0.0 else 1.0 end as score
        from tidy d left join (select case_id, z, true as hit from touched) t on t.case_id = d.case_id and t.z = d.z group by d.case_id, d.z""",
}, {"islands": ["plugged_cc"], "tidy": ["plugged", "plugged_cc", "islands"], "touched": ["tiny_holes", "islands"], "tidy_boxes": ["tidy", "touched"]})
greedy("kept_boxes", "boxes", 0.3)
# Three crops of an image: the whole, and two halves that overlap; every fourth image has one.
extend({
    "crop_found": """select *, case when image_id % 4 = 3 then 0 else box_id // 20 % 3 end as crop, case when crop = 2 then 120 else 0 end as crop_x0, 0 as crop_y0,
        case crop when 1 then 140 else 260 end as crop_x1, 250 as crop_y1 from boxes""",
    "crop_keyed": "select image_id*3 + crop as image_id, box_id, x0, y0, x1, y1, score from crop_found",
}, {"crop_found": ["boxes"], "crop_keyed": ["crop_found"]})
greedy("kept_found", "crop_keyed", 0.5)
extend({
    "crop_placed": """select image_id, box_id, x0 + crop_x0 as x0, y0 + crop_y0 as y0, x1 + crop_x0 as x1, y1 + crop_y0 as y1,
        -row_number() over (partition by image_id order by (crop_x1 - crop_x0)*(crop_y1 - crop_y0), crop_x0, crop_y0, score desc, box_id) as score
        from crop_found where image_id % 4 <> 3 and box_id in (select box_id from kept_found)""",
}, {"crop_placed": ["crop_found", "kept_found"]})
greedy("kept_placed", "crop_placed", 0.3)
greedy("kept_tidy", "tidy_boxes", 0.5)
extend({
    "images": "select s_suppkey as image_id, 640 + s_suppkey % 7 * 10 as w, 480 + s_suppkey % 5 * 12 as h from supplier",
    "crops": """select image_id, w, h, l.layer::bigint as layer, x0 as crop_x0, y0 as crop_y0, least(x0 + cw, w)::bigint as crop_x1, least(y0 + ch, h)::bigint as crop_y1 from (
        select *, ((cw - o) * i.i)::bigint as x0, ((ch - o) * j.j)::bigint as y0 from (
          select *, ceil((o*(n - 1) + w) / n) as cw, ceil((o*(n - 1) + h) / n) as ch from (
            select image_id, w, h, layer, (2**layer)::bigint as n, case when layer = 0 then 0 else floor(512.0::double/1500 * least(w, h) * (2.0 / (2**layer))) end as o from images, range(3) t(layer)))
        join range(4) i(i) on i.i < n join range(4) j(j) on j.j < n) l""",
    "candidates": """select *, (box_id % 100) / 100 as predicted_iou, 0.9::double + (box_id*7 % 11) / 100 as stability_score, (box_id % 2)*120 as crop_x0, 0::bigint as crop_y0, (box_id % 2)*120 + 140 as crop_x1, 250::bigint as crop_y1 from boxes""",
}, {"crops": ["images"], "candidates": ["boxes"]})


def blobs(spark, folder):
    return fx.voxels(spark, folder).where("lesion > 0").select("case_id", "z", "y", "x")


def frames(spark, folder):
    """Slices with lesions, and every fourth slice even when empty."""
    v = fx.voxels(spark, folder).where("lesion > 0 or z % 4 = 0").select("case_id", "z").distinct()
    return v.withColumns({"h": F.lit(fx.NY), "w": F.lit(fx.NX)})


def lesion_frames(spark, folder):
    return blobs(spark, folder).select("case_id", "z").distinct().withColumns({"h": F.lit(fx.NY), "w": F.lit(fx.NX)})


def images(spark, folder):
    return fx.table(spark, folder, "supplier").selectExpr("s_suppkey as image_id", "640 + s_suppkey % 7 * 10 as w", "480 + s_suppkey % 5 * 12 as h")


def candidates(spark, folder):
    return fx.detections(spark, folder).selectExpr(
        "*", "(box_id % 100) / 100 as predicted_iou", "0.9D + (box_id*7 % 11) / 100 as stability_score",
        "(box_id % 2)*120 as crop_x0", "0 as crop_y0", "(box_id % 2)*120 + 140 as crop_x1", "250 as crop_y1",
    )


def crop_detections(spark, folder):
    found = fx.detections(spark, folder).withColumn("crop", F.expr("if(image_id % 4 = 3, 0, box_id div 20 % 3)"))
    return found.selectExpr("*", "if(crop = 2, 120, 0) as crop_x0", "0 as crop_y0", "if(crop = 1, 140, 260) as crop_x1", "250 as crop_y1")


@check("b20_box_size", "select box_id, x0 as x, y0 as y, x1 - x0 as w, y1 - y0 as h from boxes", "boxes")
def _(spark, folder):
    return fx.detections(spark, folder).select("box_id", *geometry.box_size(*[F.col(c) for c in masks.BOX]))


@check("b21_uncrop", "select box_id, x0 + crop_x0 as x0, y0 + crop_y0 as y0, x1 + crop_x0 as x1, y1 + crop_y0 as y1 from candidates", "candidates")
def _(spark, folder):
    return masks.uncropped(candidates(spark, folder)).select("box_id", *masks.BOX)


@check("b22_near_crop_edge", """select box_id, (abs(x0 - crop_x0) <= 20 and abs(x0) > 20) or (abs(y0 - crop_y0) <= 20 and abs(y0) > 20) or (abs(x1 - crop_x1) <= 20 and abs(x1 - w) > 20)
       or (abs(y1 - crop_y1) <= 20 and abs(y1 - h) > 20) as near from candidates""", "candidates")
def _(spark, folder):
    box, crop = [F.col(c) for c in masks.BOX], [F.col(f"crop_{c}") for c in masks.BOX]
    near = geometry.near_crop_edge(box, crop, [F.lit(0), F.lit(0), F.col("w"), F.col("h")])
    return candidates(spark, folder).select("box_id", near.alias("near"))


@check("d39_mask_boxes", """select f.case_id, f.z, coalesce(min(x), 0) as x0, coalesce(min(y), 0) as y0, coalesce(max(x), 0) as x1, coalesce(max(y), 0) as y1
       from frames f left join blobs using (case_id, z) group by f.case_id, f.z""", "frames", "blobs")
def _(spark, folder):
    return masks.mask_boxes(blobs(spark, folder), frames(spark, folder), KEYS)


@check("e11_run_lengths", "select case_id, z, counts from rle", "rle")
def _(spark, folder):
    return masks.run_lengths(blobs(spark, folder), frames(spark, folder), KEYS).drop("h", "w")


@check("e12_run_pixels", "select case_id, z, y, x from blobs", "blobs")
def _(spark, folder):
    return masks.run_pixels(masks.run_lengths(blobs(spark, folder), frames(spark, folder), KEYS), KEYS)


@check("d40_run_area", "select case_id, z, area from rle", "rle")
def _(spark, folder):
    return masks.run_area(masks.run_lengths(blobs(spark, folder), frames(spark, folder), KEYS), KEYS)


@check("d41_stability", """select case_id, z, round(count(*) filter ((hu + 700)/50.0 > 1) / nullif(count(*) filter ((hu + 700)/50.0 > -1), 0), 6) as stability_score from vox where lung = 1 group by all""", "vox")
def _(spark, folder):
    logits = fx.voxels(spark, folder).where("lung > 0").withColumn("logit", (F.col("hu") + 700) / 50.0)
    return masks.stability(logits, KEYS)


@check("d42_lung_boxes", f"""select a.case_id, a.z, a.x0, a.y0, a.x1, a.y1, round(case when b.x0 is not null then {iou('a', 'b')} end, 6) as lesion_box_iou from (
       select case_id, z, greatest(min(x) - 5, 0) as x0, greatest(min(y) - 5, 0) as y0, least(max(x) + 5, 19) as x1, least(max(y) + 5, 15) as y1 from vox where lung = 1 group by all) a
       left join (select case_id, z, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from vox where lesion > 0 group by all) b on a.case_id = b.case_id and a.z = b.z""", "vox")
def _(spark, folder):
    return masks.lung_boxes(fx.voxels(spark, folder), fx.cases(spark, folder))


@check("e13_suppression", "select * from kept_boxes", "kept_boxes")
def _(spark, folder):
    return suppression.suppress(fx.detections(spark, folder), 0.3).select("image_id", "box_id")


@check("e13_between_crops", """select image_id, box_id, x0, y0, x1, y1 from crop_placed semi join kept_placed using (image_id, box_id)
       union all select image_id, box_id, x0 + crop_x0, y0 + crop_y0, x1 + crop_x0, y1 + crop_y0 from crop_found where image_id % 4 = 3 and box_id in (select box_id from kept_found)""", "crop_placed", "kept_placed", "crop_found", "kept_found")
def _(spark, folder):
    boxes = crop_detections(spark, folder)
    corners = ["image_id", "crop_x0", "crop_y0", "crop_x1", "crop_y1"]
    return suppression.suppress_crops(boxes, boxes.select(*corners).distinct(), 0.5, 0.3).select("image_id", "box_id", *masks.BOX)


@check("e14_small_holes", "select case_id, z, y, x from plugged", "plugged")
def _(spark, folder):
    return masks.fill_small_holes(blobs(spark, folder), lesion_frames(spark, folder), KEYS, 6)[0]


@check("e14_small_regions", "select * from tidy", "tidy")
def _(spark, folder):
    plugged = masks.fill_small_holes(blobs(spark, folder), lesion_frames(spark, folder), KEYS, 6)[0]
    return masks.drop_small_islands(plugged, KEYS, 4)[0]


@check("e15_cleaned_masks", """select image_id as case_id, box_id as z, x0, y0, x1, y1, score = 0 as changed from tidy_boxes semi join kept_tidy using (image_id, box_id)""", "tidy_boxes", "kept_tidy")
def _(spark, folder):
    return masks.cleaned_masks(blobs(spark, folder), lesion_frames(spark, folder), 6, 0.5, "case_id", "z", min_island=4)[1]


@check("e16_crop_boxes", "select * from crops", "crops")
def _(spark, folder):
    return masks.crop_boxes(images(spark, folder), layers=2)


@check("e17_point_grid", """select image_id, layer, crop_x0, crop_y0, i.i, j.j, round(crop_x0 + (2*i.i + 1) / (2*n) * (crop_x1 - crop_x0), 6) as point_x, round(crop_y0 + (2*j.j + 1) / (2*n) * (crop_y1 - crop_y0), 6) as point_y
       from (select *, (8 / 2**layer)::bigint as n from crops) join range(8) i(i) on i.i < n join range(8) j(j) on j.j < n""", "crops")
def _(spark, folder):
    rows = masks.point_grid(masks.crop_boxes(images(spark, folder), layers=2), 8, 2)
    return rows.select("image_id", "layer", "crop_x0", "crop_y0", "i", "j", "point_x", "point_y")


@check("e18_candidate_filter", """select box_id from candidates where predicted_iou > 0.88 and stability_score >= 0.95 and not ((abs(x0 - crop_x0) <= 20 and abs(x0) > 20)
       or (abs(y0 - crop_y0) <= 20 and abs(y0) > 20) or (abs(x1 - crop_x1) <= 20 and abs(x1 - w) > 20) or (abs(y1 - crop_y1) <= 20 and abs(y1 - h) > 20))""", "candidates")
def _(spark, folder):
    return masks.candidate_filter(candidates(spark, folder)).select("box_id")


@check("e19_mask_records", """select box_id as mask_id, (x1 - x0)*(y1 - y0) as area, (x0::double) || '|' || (y0::double) || '|' || ((x1 - x0)::double) || '|' || ((y1 - y0)::double) as bbox,
       round(predicted_iou, 6) as predicted_iou, round((x0 + x1)/2, 6) as point_x from candidates""", "candidates")
def _(spark, folder):
    rows = candidates(spark, folder).selectExpr("*", "box_id as mask_id", "(x1 - x0)*(y1 - y0) as area", "(x0 + x1)/2 as point_x", "(y0 + y1)/2 as point_y")
    r = masks.mask_records(rows)
    return r.select(
        "mask_id", "record.area", F.array_join(F.col("record.bbox").cast("array<string>"), "|").alias("bbox"), "record.predicted_iou",
        F.col("record.point_coords")[0][0].alias("point_x"),
    )


@check("e20_filter_and_append", "select box_id, image_id from boxes where score > 0.1 union all select box_id, image_id from boxes where x0 < 20", "boxes")
def _(spark, folder):
    b = fx.detections(spark, folder).select("box_id", "image_id", "score", "x0")
    return masks.appended(b.where("score > 0.1"), b.where("x0 < 20")).select("box_id", "image_id")
