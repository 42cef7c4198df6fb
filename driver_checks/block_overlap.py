"""Checks of the overlap metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_checks import fixtures as fx
from driver_checks.registry import check, extend
from voxtable.functions import labels as lb
from voxtable.operators import overlap
from voxtable.plans.evaluation import evaluate

extend({
    "paired": "select case_id, z, y, x, coalesce(p.label, 0) as predicted, coalesce(t.label, 0) as true_label from pred p full join truth t using (case_id, z, y, x)",
    "class_counts": """select s.case_id, s.z, c.label::bigint as label, count(*) filter (predicted = c.label and true_label = c.label) as shared, count(*) filter (predicted = c.label) as predicted,
        count(*) filter (true_label = c.label) as true_n from slices s cross join (values (1), (2), (3), (4), (5)) c(label) left join paired b using (case_id, z) group by s.case_id, s.z, c.label""",
    "dices": "select case_id, z, label, case when predicted + true_n > 0 then 2*shared / (predicted + true_n) end as dice from class_counts",
    "means": "select label, coalesce(avg(dice), 0) as mean_dice, count(dice) as samples from dices group by all",
    "confusion": """select s.case_id, s.z, count(*) filter (predicted > 0 and true_label > 0) as tp, count(*) filter (predicted > 0 and true_label = 0) as fp,
        count(*) filter (predicted = 0 and true_label > 0) as fn, any_value(ny*nx) - count(b.case_id) as tn from slices s left join paired b using (case_id, z) group by s.case_id, s.z""",
}, {"paired": ["pred", "truth"], "class_counts": ["slices", "paired"], "dices": ["class_counts"], "means": ["dices"], "confusion": ["slices", "paired"]})


def compared(spark, folder):
    return overlap.compare(fx.prediction(spark, folder), fx.truth(spark, folder))


def counts(spark, folder):
    return overlap.class_overlap(compared(spark, folder), fx.slices(spark, folder))


def confusion(spark, folder):
    return overlap.slice_overlap(compared(spark, folder), fx.slices(spark, folder))


@check("c11_compare", "select case_id, z, y, x, predicted, true_label from paired", "paired")
def _(spark, folder):
    return compared(spark, folder).withColumnRenamed("true", "true_label")


@check("d34_class_dice", "select case_id, z, label, round(dice, 6) as dice from dices", "dices")
def _(spark, folder):
    return overlap.class_dice(counts(spark, folder))


@check("d35_mean_class_dice", "select label, round(mean_dice, 6) as mean_dice, samples from means", "means")
def _(spark, folder):
    return overlap.mean_class_dice(overlap.class_dice(counts(spark, folder)))


@check("d36_macro_dice", "select round(avg(mean_dice), 6) as macro_dice from means", "means")
def _(spark, folder):
    return overlap.macro_dice(overlap.mean_class_dice(overlap.class_dice(counts(spark, folder))))


@check("d37_smoothed_dice", "select round(avg(2*tp / (2*tp + fp + fn + 1e-8)), 6) as mean_dice, count(*) as samples from confusion", "confusion")
def _(spark, folder):
    return overlap.mean_smoothed_dice(confusion(spark, folder))


@check("d38_detection_metrics", """select slices, tp, fp, tn, fn, round(p, 6) as precision, round(r, 6) as recall, round(tn / (tn + fp + 1e-8), 6) as specificity, round(2*p*r / (p + r + 1e-8), 6) as f1,
       round(2*tp / (2*tp + fp + fn + 1e-8), 6) as dice from (select *, tp / (tp + fp + 1e-8) as p, tp / (tp + fn + 1e-8) as r from (
         select slices, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(tn)::bigint as tn, sum(fn)::bigint as fn from (
           select 'all' as slices, tp, fp, tn, fn from confusion union all select case when tp + fn > 0 then 'lesion' else 'background' end, tp, fp, tn, fn from confusion) group by slices))""", "confusion")
def _(spark, folder):
    return overlap.detection_metrics(confusion(spark, folder))


@check("d45_detection_summary", """select count(*) as total_cases, count(*) filter (n > 0) as lesion_detected, count(*) filter (n = 0) as no_lesion
       from (select c.case_id, count(p.case_id) as n from cases c left join pred p using (case_id) group by c.case_id)""", "cases", "pred")
def _(spark, folder):
    return overlap.detection_summary(overlap.case_detections(fx.cases(spark, folder), fx.prediction(spark, folder)))


@check("d46_background_check", """select count(*) as background_slices, count(*) filter (fp > 0) as false_positive_slices, round(count(*) filter (fp > 0) / count(*), 6) as false_positive_rate,
       round(count(*) filter (fp = 0) / count(*), 6) as background_accuracy from confusion where tp + fn = 0""", "confusion")
def _(spark, folder):
    return overlap.background_check(confusion(spark, folder))


@check("b31_binarise", """select case_id, count(*) filter (1 / (1 + exp(-((hu + 400) / 100.0))) > 0.5) as positive, count(*) filter (lesion = 2) as class_2 from vox group by all""", "vox")
def _(spark, folder):
    return fx.voxels(spark, folder).groupBy("case_id").agg(
        F.count_if(lb.logit_positive((F.col("hu") + 400) / 100.0)).alias("positive"), F.count_if(lb.is_class(F.col("lesion"), 2)).alias("class_2")
    )


@check("a17_score_table", "select label, round(mean_dice, 6) as mean_dice, samples from means", "means")
def _(spark, folder):
    from voxtable.sources.sinks import nan_to_null

    return nan_to_null(overlap.mean_class_dice(overlap.class_dice(counts(spark, folder))), "mean_dice")


@check("i7_evaluation", """select label::varchar as score, round(mean_dice, 6) as dice from means union all select 'macro', round(avg(mean_dice), 6) from means
       union all select 'binary', round(avg(2*tp / (2*tp + fp + fn + 1e-8)), 6) from confusion""", "means", "confusion")
def _(spark, folder):
    result = evaluate(fx.prediction(spark, folder), fx.truth(spark, folder), fx.slices(spark, folder))
    classes = result.class_dice.select(F.col("label").cast("string").alias("score"), F.col("mean_dice").alias("dice"))
    macro = result.macro_dice.select(F.lit("macro").alias("score"), F.col("macro_dice").alias("dice"))
    return classes.unionByName(macro).unionByName(result.binary_dice.select(F.lit("binary").alias("score"), F.col("mean_dice").alias("dice")))
