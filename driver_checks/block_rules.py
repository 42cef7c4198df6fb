"""Checks of the pattern rules, the case analysis and its batch summary."""

from __future__ import annotations

import contextlib
import itertools
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from driver_checks import fixtures as fx
from driver_checks.block_features import histogram, profile
from driver_checks.common import fresh
from driver_checks.registry import check, extend
from voxtable.functions import grading
from voxtable.operators import depth, lesions, regions, rules
from voxtable.plans import case_study, ledger
from voxtable.sources import sinks

extend({
    "vars": """select l.case_id, lesion_types, n_honeycomb > 0 as hc, n_reticulation > 0 as ret, n_ground_glass_opacity > 0 as ggo, n_consolidation > 0 as con,
        coalesce(dominant_lesion, 'none') as dom, distribution_pattern as dist, axial_distribution as ax, subpleural_involvement as inv, subpleural_ratio as sr,
        d.total_lesion_voxels * vol as lesion_volume, d.total_lung_voxels * vol as lung_volume, n_honeycomb + n_reticulation + n_ground_glass_opacity + n_consolidation = 0 as nothing
        from lsum l join distribution d using (case_id) join axial_named a using (case_id) join pleural p using (case_id)""",
    "points": """select *, nothing or lesion_volume / greatest(lung_volume, 1) < 0.02 as normal,
        case when hc then 0.4 else 0 end + case when hc and dom = 'honeycomb' then 0.2 else 0 end
          + case dist when 'lower_predominant' then 0.2 when 'upper_predominant' then -0.1 else 0 end
          + case ax when 'peripheral' then 0.15 when 'central' then -0.1 else 0 end
          + case when inv then 0.15 + case when sr > 0.3 then 0.1 else 0 end else -0.05 end
          + case when ret then 0.05 else 0 end - case when dom = 'ground_glass_opacity' then 0.1 else 0 end as uip,
        case when ggo then 0.2 else 0 end + case when dom = 'ground_glass_opacity' then 0.2 else 0 end + case when ret then 0.15 else 0 end
          + case when hc then -0.2 else 0.15 end + case when dist in ('diffuse', 'upper_predominant') then 0.1 when dist = 'lower_predominant' then 0.05 else 0 end
          + case when ax in ('peripheral', 'diffuse_scattered') then 0.1 else 0 end
          + case when not inv then 0.2 when sr < 0.1 then 0.05 else -0.1 end as nsip,
        case when con then 0.3 else 0 end + case when dom = 'consolidation' then 0.2 else 0 end
          + case when ggo and con then 0.2 when dom = 'ground_glass_opacity' then 0.1 else 0 end + case when not hc and not ret then 0.1 else 0 end
          + case when dist in ('diffuse', 'lower_predominant') then 0.05 else 0 end + case when ax = 'peripheral' then 0.1 else 0 end
          + case when inv then 0.05 else 0 end as op from vars""",
    "clamped": """select case_id, normal, case when normal then 0 else greatest(0, least(1, round(uip::double, 10))) end as uip,
        case when normal then 0 else greatest(0, least(1, round(nsip::double, 10))) end as nsip, case when normal then 0 else greatest(0, least(1, round(op::double, 10))) end as op from points""",
    "scores": """select case_id, normal, uip::double as score_uip, nsip::double as score_nsip, op::double as score_op,
        (case when normal then 0 else greatest(0, round(1 - greatest(uip, nsip, op), 10)) end)::double as score_other, (case when normal then 0.9 else 0 end)::double as score_normal from clamped""",
    "ranking": """select case_id, normal, pattern, score, row_number() over (partition by case_id order by score desc, place) as rank from (
        select case_id, normal, 'UIP' as pattern, 0 as place, score_uip as score from scores union all select case_id, normal, 'NSIP', 1, score_nsip from scores union all
        select case_id, normal, 'OP', 2, score_op from scores union all select case_id, normal, 'Other', 3, score_other from scores union all
        select case_id, normal, 'Normal', 4, score_normal from scores)""",
    "decided": """select case_id, normal, max(pattern) filter (rank = 1) as predicted_pattern, max(score) filter (rank = 1) as confidence,
        case when max(score) filter (rank = 1) >= 0.8 then 'high' when max(score) filter (rank = 1) >= 0.6
          and round(max(score) filter (rank = 1) - max(score) filter (rank = 2), 10) >= 0.2 then 'moderate' else 'low' end as certainty_level,
        coalesce(string_agg(pattern || ':' || case when score >= 0.8 then 'Very likely' when score >= 0.6 then 'Likely' when score >= 0.4 then 'Possible'
          when score >= 0.2 then 'Unlikely' else 'Very unlikely' end, ',' order by rank) filter (rank <= 3 and score > 0.1 and not normal), '') as differential
        from ranking group by all""",
}, {
    "vars": ["lsum", "distribution", "axial_named", "pleural"], "points": ["vars"], "clamped": ["points"], "scores": ["clamped"],
    "ranking": ["scores"], "decided": ["ranking"],
})


def features(spark, folder):
    return case_study.case_features(fx.voxels(spark, folder), fx.cases(spark, folder))


def distribution(spark, folder, rule="density"):
    counts = regions.region_counts(profile(spark, folder)) if rule == "density" else regions.mask_region_counts(fx.masked_voxels(spark, folder))
    return regions.lung_distribution(counts, fx.cases(spark, folder), rule)


def decided(rows):
    """Classification columns with the differential as text."""
    text = F.transform("differential", lambda e: F.concat(e["pattern"], F.lit(":"), e["likelihood"]))
    return rows.withColumn("differential", text)


@check("b18_involvement", """select case_id, case when upper_lesion_ratio < 0.05 then 'none' when upper_lesion_ratio < 0.15 then 'mild' when upper_lesion_ratio < 0.3 then 'moderate' else 'severe' end as grade
       from distribution""", "distribution")
def _(spark, folder):
    return distribution(spark, folder).select("case_id", grading.involvement(F.col("upper_lesion_ratio")).alias("grade"))


@check("f1_lesion_pattern", """select case_id, case when nothing then 'normal' when hc then 'uip_like' when dom = 'ground_glass_opacity' then case when con then 'op_like' else 'nsip_like' end
       when dom = 'reticulation' then case when ggo then 'nsip_like' else 'fibrotic' end when dom = 'consolidation' then 'op_like' else 'other' end as lesion_pattern,
       (case when nothing then 0 when hc then case when dom = 'honeycomb' then 0.9 else 0.8 end
       when dom = 'ground_glass_opacity' then case when con then 0.7 when ret then 0.7 else 0.6 end
       when dom = 'reticulation' then case when ggo then 0.7 else 0.6 end when dom = 'consolidation' then 0.6 else 0.3 end)::double as lesion_pattern_confidence,
       case when nothing then 'No lesions detected' when hc then 'Honeycomb pattern present' || case when dom = 'honeycomb' then ',Honeycomb is dominant lesion' else '' end
       when dom = 'ground_glass_opacity' then case when con then 'GGO with consolidation present' when ret then 'Ground glass opacity dominant,GGO with reticulation' else 'Ground glass opacity dominant' end
       when dom = 'reticulation' then case when ggo then 'Reticulation with GGO' else 'Reticulation dominant' end when dom = 'consolidation' then 'Consolidation dominant'
       else 'Mixed or unclear pattern' end as lesion_pattern_reasons from vars""", "vars")
def _(spark, folder):
    rows = rules.lesion_pattern(lesions.lesion_summary(profile(spark, folder), fx.cases(spark, folder)))
    return rows.select("case_id", "lesion_pattern", "lesion_pattern_confidence", "lesion_pattern_reasons")


@check("f2_distribution_rule", "select case_id, distribution_pattern from distribution", "distribution")
def _(spark, folder):
    return distribution(spark, folder).select("case_id", "distribution_pattern")


@check("f3_mask_distribution_rule", """select case_id, case when u > 0.7 then 'upper_predominant' when l > 0.7 then 'lower_predominant' when abs(u - l) <= 0.2 then 'diffuse' else 'mixed' end as distribution_pattern
       from (select case_id, coalesce(count(*) filter (z >= 7) / nullif(count(case when lesion > 0 then 1 end), 0), 0) as u0,
         coalesce(count(*) filter (z >= 7 and lesion > 0) / nullif(count(*) filter (lesion > 0), 0), 0) as u,
         coalesce(count(*) filter (z < 7 and lesion > 0) / nullif(count(*) filter (lesion > 0), 0), 0) as l from vox where lung = 1 group by all)""", "vox")
def _(spark, folder):
    return distribution(spark, folder, "gap").select("case_id", "distribution_pattern")


@check("f4_distribution_summary", """select case_id, distribution_pattern as pattern, case when u < 0.05 then 'none' when u < 0.15 then 'mild' when u < 0.3 then 'moderate' else 'severe' end as upper_involvement,
       case when l < 0.05 then 'none' when l < 0.15 then 'mild' when l < 0.3 then 'moderate' else 'severe' end as lower_involvement,
       case when greatest(u, l) < 0.05 then 'none' when greatest(u, l) < 0.15 then 'mild' when greatest(u, l) < 0.3 then 'moderate' else 'severe' end as overall_severity
       from (select case_id, distribution_pattern, upper_lesion_ratio as u, lower_lesion_ratio as l from distribution)""", "distribution")
def _(spark, folder):
    return rules.distribution_summary(distribution(spark, folder)).drop("upper_percentage", "lower_percentage")


@check("f5_axial_rule", "select case_id, axial_distribution from axial_named", "axial_named")
def _(spark, folder):
    return depth.axial_distribution(histogram(spark, folder), fx.cases(spark, folder)).select("case_id", "axial_distribution")


@check("f6_subpleural_pattern", """select case_id, case when not i then 'no_subpleural_involvement' when r >= 0.5 then 'extensive_subpleural' when r >= 0.2 then 'moderate_subpleural' else 'minimal_subpleural' end as pattern_type,
       case when not i then 'none' when r >= 0.5 then 'severe' when r >= 0.2 then 'moderate' else 'mild' end as severity,
       case when not i then '' else concat_ws(',', case when r >= 0.5 then 'extensive_subpleural_involvement' when r >= 0.2 then 'moderate_subpleural_involvement' else 'minimal_subpleural_involvement' end,
         case when direct_contact then 'direct_pleural_contact' end, case when min_distance_mm <= 1 then 'immediate_subpleural' end,
         case when within_2mm_percent >= 15 then 'predominantly_immediate_subpleural' end) end as characteristics,
       round(u, 6) as uip_likelihood, round(case when i then greatest(0, 1 - u) else 0.6 end, 6) as nsip_likelihood
       from (select *, subpleural_involvement as i, subpleural_ratio as r, (case when not subpleural_involvement then 0 else least(1.0, case when subpleural_ratio >= 0.5 then 0.8 when subpleural_ratio >= 0.2 then 0.6 else 0.3 end
         + case when direct_contact then 0.1 else 0 end + case when min_distance_mm <= 1 then 0.1 else 0 end + case when within_2mm_percent >= 15 then 0.1 else 0 end) end)::double as u from pleural)""", "pleural")
def _(spark, folder):
    return rules.subpleural_pattern(depth.subpleural_features(histogram(spark, folder), fx.cases(spark, folder)))


@check("f7_subpleural_summary", """select case_id, case when i then 'Yes' else 'No' end as involvement,
       case when not i then 'None' when r >= 0.5 then 'Extensive (≥50%)' when r >= 0.2 then 'Moderate (20-50%)' else 'Minimal (<20%)' end as severity,
       case when i then 'Predominantly ' || replace(replace(b, 'distance_', ''), '_', '-') || 'mm from pleura' else 'N/A' end as distribution
       from (select p.case_id, subpleural_involvement as i, subpleural_ratio as r, b from pleural p
         left join (select case_id, arg_max(band_name, voxels*10 - band) as b from banded group by all) using (case_id))""", "pleural", "banded")
def _(spark, folder):
    h, c = histogram(spark, folder), fx.cases(spark, folder)
    return rules.subpleural_summary(depth.subpleural_features(h, c), depth.subpleural_bands(h, c)).drop("min_distance")


@check("f8_normal_case", "select case_id, normal from points", "points")
def _(spark, folder):
    return features(spark, folder).select("case_id", rules.is_normal().alias("normal"))


def _score_check(name, column, rule_set):
    @check(name, f"select case_id, round(greatest(0, least(1, round({column}::double, 10))), 6)::double as score from points", "points")
    def _(spark, folder):
        return features(spark, folder).select("case_id", rules.score(rule_set()).alias("score"))


_score_check("f9_uip_score", "uip", rules.uip_rules)
_score_check("f10_nsip_score", "nsip", rules.nsip_rules)
_score_check("f11_op_score", "op", rules.op_rules)


@check("f9_uip_reasons", """select case_id, concat_ws(',', case when hc then 'Honeycomb pattern present (strong UIP indicator)' end, case when hc and dom = 'honeycomb' then 'Honeycomb is dominant lesion' end,
       case dist when 'lower_predominant' then 'Lower lobe predominance' when 'upper_predominant' then 'Upper lobe predominance (atypical for UIP)' end,
       case ax when 'peripheral' then 'Peripheral distribution' when 'central' then 'Central distribution (atypical for UIP)' end,
       case when inv then 'Subpleural involvement' end, case when inv and sr > 0.3 then 'Extensive subpleural involvement' end,
       case when not inv then 'No subpleural involvement (atypical for UIP)' end, case when ret then 'Reticulation pattern present' end,
       case when dom = 'ground_glass_opacity' then 'Extensive ground glass (atypical for UIP)' end) as reasons from vars""", "vars")
def _(spark, folder):
    return features(spark, folder).select("case_id", rules.reasons(rules.uip_rules()).alias("reasons"))


@check("f10_nsip_reasons", """select case_id, concat_ws(',', case when ggo then 'Ground glass opacity present' end, case when dom = 'ground_glass_opacity' then 'Ground glass is dominant' end,
       case when ret then 'Reticulation pattern present' end, case when hc then 'Honeycomb present (atypical for NSIP)' else 'No honeycomb pattern (typical for NSIP)' end,
       case when dist in ('diffuse', 'upper_predominant') then dist || ' distribution' when dist = 'lower_predominant' then 'Lower predominance (less typical for NSIP)' end,
       case when ax in ('peripheral', 'diffuse_scattered') then ax || ' axial distribution' end,
       case when not inv then 'Subpleural sparing (classic NSIP feature)' when sr < 0.1 then 'Minimal subpleural involvement'
         else 'Significant subpleural involvement (atypical for NSIP)' end) as reasons from vars""", "vars")
def _(spark, folder):
    return features(spark, folder).select("case_id", rules.reasons(rules.nsip_rules()).alias("reasons"))


@check("f11_op_reasons", """select case_id, concat_ws(',', case when con then 'Consolidation present' end, case when dom = 'consolidation' then 'Consolidation is dominant' end,
       case when ggo and con then 'Mixed ground glass and consolidation' when dom = 'ground_glass_opacity' then 'Ground glass dominant (possible early OP)' end,
       case when not hc and not ret then 'No fibrotic patterns (typical for OP)' end, case when dist in ('diffuse', 'lower_predominant') then dist || ' distribution' end,
       case when ax = 'peripheral' then 'Peripheral distribution' end, case when inv then 'Subpleural involvement' end) as reasons from vars""", "vars")
def _(spark, folder):
    return features(spark, folder).select("case_id", rules.reasons(rules.op_rules()).alias("reasons"))


@check("f12_classify", """select case_id, normal, round(score_uip, 6) as score_uip, round(score_nsip, 6) as score_nsip, round(score_op, 6) as score_op, round(score_other, 6) as score_other,
       round(score_normal, 6) as score_normal, predicted_pattern, round(confidence, 6) as confidence from scores join decided using (case_id, normal)""", "scores", "decided")
def _(spark, folder):
    return rules.classify(features(spark, folder)).drop("certainty_level", "reasoning", "differential")


@check("f13_certainty", "select case_id, certainty_level from decided", "decided")
def _(spark, folder):
    return rules.classify(features(spark, folder)).select("case_id", "certainty_level")


@check("f14_differential", "select case_id, differential from decided", "decided")
def _(spark, folder):
    return decided(rules.classify(features(spark, folder))).select("case_id", "differential")


@check("b19_likelihood", """select case_id, case when confidence >= 0.8 then 'Very likely' when confidence >= 0.6 then 'Likely' when confidence >= 0.4 then 'Possible'
       when confidence >= 0.2 then 'Unlikely' else 'Very unlikely' end as likelihood from decided""", "decided")
def _(spark, folder):
    return rules.classify(features(spark, folder)).select("case_id", grading.likelihood(F.col("confidence")).alias("likelihood"))


@check("f15_classification_summary", """select case_id, predicted_pattern as pattern, upper(certainty_level[1]) || certainty_level[2:] as certainty,
       case when contains(differential, ',') then split_part(split_part(differential, ',', 2), ':', 1) else 'None' end as second from decided""", "decided")
def _(spark, folder):
    rows = rules.classification_summary(rules.classify(features(spark, folder)))
    return rows.select("case_id", "pattern", "certainty", F.regexp_extract("top_differential", r"^(\w+)", 1).alias("second"))


@check("f16_four_variables", """select case_id, case when dom <> 'none' then 'Dominant: ' || dom else 'No significant lesions' end as variable_1_lesion_type,
       case dist when 'upper_predominant' then 'Upper Predominant' when 'lower_predominant' then 'Lower Predominant' when 'diffuse' then 'Diffuse' else 'Minimal' end as variable_2_lung_distribution,
       case ax when 'diffuse_scattered' then 'Diffuse Scattered' when 'peripheral' then 'Peripheral' when 'central' then 'Central' else 'Unknown' end as variable_3_axial_distribution,
       case when inv then 'Present' else 'Spared' end as variable_4 from vars""", "vars")
def _(spark, folder):
    rows = rules.four_variables(features(spark, folder))
    return rows.withColumn("variable_4", F.regexp_extract("variable_4_subpleural_features", r"^(\w+)", 1)).drop("variable_4_subpleural_features")


@check("i1_case_analysis", """select case_id, lesion_types, case when dom = 'none' then null else dom end as dominant_lesion, dist as distribution_pattern, ax as axial_distribution, inv as subpleural_involvement,
       round(sr, 6) as subpleural_ratio, predicted_pattern, round(confidence, 6) as confidence, certainty_level, differential
       from vars join decided using (case_id)""", "vars", "decided")
def _(spark, folder):
    study = case_study.analyse(fx.voxels(spark, folder), fx.cases(spark, folder))
    kept = ["case_id", "lesion_types", "dominant_lesion", "distribution_pattern", "axial_distribution", "subpleural_involvement", "subpleural_ratio"]
    found = decided(study.classified).select("case_id", "predicted_pattern", "confidence", "certainty_level", "differential")
    return study.features.select(*kept).join(found, "case_id")


@check("i1_result_envelope", """select case_id, true as success, lesion_types, case when dom = 'none' then null else dom end as dominant_lesion, dist as distribution_pattern, ax as axial_distribution,
       inv as subpleural_involvement, round(sr, 6) as subpleural_ratio, predicted_pattern, round(confidence, 6) as confidence, certainty_level, predicted_pattern as summary_pattern, lung as lung_voxels
       from vars join decided using (case_id) join (select case_id, sum(lung_voxels)::bigint as lung from prof group by all) using (case_id)
       union all select case_id + 1000000, false, null, null, null, null, null, null, null, null, null, null, null from cases where case_id % 9 = 2""", "vars", "decided", "prof", "cases")
def _(spark, folder):
    """The nested result of every case, written as JSON per case and read back; cases without voxels keep their error."""
    lost = fx.cases(spark, folder).where("case_id % 9 = 2").withColumn("case_id", F.col("case_id") + 1_000_000)
    study = case_study.analyse(fx.voxels(spark, folder), fx.cases(spark, folder).unionByName(lost))
    rows, path = case_study.result_envelopes(study), fresh(spark, "envelopes")
    sinks.write_case_results(rows, path)
    back = spark.read.schema(rows.schema).json(path)
    assert back.where("(error is null) <> success").isEmpty()
    return back.select(
        "case_id", "success", "features.lesion_type.lesion_types", "features.lesion_type.dominant_lesion", "features.lung_distribution.distribution_pattern",
        "features.axial_distribution.axial_distribution", "features.subpleural_features.subpleural_involvement", "features.subpleural_features.subpleural_ratio",
        "classification.predicted_pattern", "classification.confidence", "classification.certainty_level", F.col("summary.pattern").alias("summary_pattern"), F.col("lung_statistics.total_lung_voxels").alias("lung_voxels"))


@check("i2_resumed_batch", """select case_id, case when case_id % 5 = 3 then 'failed' else 'done' end as state, case when case_id % 5 = 3 then 'shape mismatch' end as error,
       case when case_id % 5 = 3 or n <= 2*ceil(c / 4.0) then 'first' else 'second' end as run_id
       from (select *, row_number() over (partition by case_id % 5 = 3 order by case_id) as n, count(*) filter (case_id % 5 <> 3) over () as c from cases)""", "cases")
def _(spark, folder):
    """Failures of validation first; then a run that stops in its third batch, and one that goes on with what is left."""
    path, c = fresh(spark, "ledger"), fx.cases(spark, folder)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    ledger.record_failures(c.where("case_id % 5 = 3").select("case_id", F.lit("shape mismatch").alias("error")), path, "first", start)
    size, calls = -(-c.where("case_id % 5 <> 3").count() // 4), []

    def work(batch):
        calls.append(len(calls))
        if len(calls) == 3:
            raise RuntimeError("stopped")
        return batch.select("case_id", F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))

    ticks = itertools.count(1)
    with contextlib.suppress(RuntimeError):
        ledger.run_batches(c, path, work, size, timedelta(hours=1), "first", lambda: start + timedelta(seconds=next(ticks)))
    # The claim of the stopped batch has lapsed two hours later.
    ledger.run_batches(c, path, work, size, timedelta(hours=1), "second", lambda: start + timedelta(hours=2, seconds=next(ticks)))
    return ledger.states(spark, path).select(F.col("case_id").cast("bigint").alias("case_id"), "state", "error", "run_id")


def batch(spark, folder):
    """The case analysis with broken cases: some without lung, some without voxels."""
    v = fx.voxels(spark, folder).where("case_id % 13 <> 4").withColumn("lung", F.expr("if(case_id % 17 = 3, 0, lung)"))
    return case_study.analyse(v, fx.cases(spark, folder))


@check("i2_batch_outcomes", """select case_id, case_id % 13 <> 4 and case_id % 17 <> 3 as success, case when case_id % 13 = 4 then 'Failed to load case data'
       when case_id % 17 = 3 then 'Failed to segment lungs' end as error from cases""", "cases")
def _(spark, folder):
    return case_study.case_statuses(batch(spark, folder))


@check("d31_outcome_counts", """select count(*) as total_cases, count(*) filter (case_id % 13 <> 4 and case_id % 17 <> 3) as successful,
       count(*) filter (case_id % 13 = 4 or case_id % 17 = 3) as failed from cases""", "cases")
def _(spark, folder):
    return case_study.outcome_counts(case_study.case_statuses(batch(spark, folder)))


@check("d27_pattern_distribution", "select predicted_pattern as pattern, count(*) as cases from decided group by all", "decided")
def _(spark, folder):
    return case_study.pattern_distribution(rules.classify(features(spark, folder)))


@check("d28_feature_statistics", """select 'dominant_lesion' as attribute, dom as value, count(*) as count from vars where dom <> 'none' group by all union all
       select 'distribution_pattern', dist, count(*) from vars group by all union all select 'axial_distribution', ax, count(*) from vars group by all""", "vars")
def _(spark, folder):
    return case_study.feature_statistics(features(spark, folder))


@check("d29_involvement_rate", "select round(avg(case when inv then 1.0::double else 0.0::double end), 6) as rate from vars", "vars")
def _(spark, folder):
    return case_study.involvement_rate(features(spark, folder)).select("rate")
