"""One row per branch of the rules, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from voxtable.functions.geometry import distance_band, gradient_bin
from voxtable.operators import rules


@pytest.mark.parametrize("upper,lower,ud,ld,want", [
    (0.65, 0.35, 0.1, 0.1, "upper_predominant"),
    (0.30, 0.70, 0.1, 0.1, "lower_predominant"),
    (0.50, 0.50, 0.31, 0.20, "upper_predominant"),
    (0.50, 0.50, 0.20, 0.31, "lower_predominant"),
    (0.50, 0.50, 0.30, 0.20, "diffuse"),
    (0.00, 0.00, 0.0, 0.0, "minimal"),
    (0.30, 0.10, 0.1, 0.1, "upper_predominant"),
    (0.10, 0.30, 0.1, 0.1, "lower_predominant"),
])
def test_density_distribution(spark, upper, lower, ud, ld, want):
    row = spark.range(1).select(rules.density_distribution(*[F.lit(v) for v in (upper, lower, ud, ld)]).alias("p")).first()
    assert row.p == want


@pytest.mark.parametrize("upper,lower,want", [
    (0.71, 0.29, "upper_predominant"), (0.70, 0.30, "mixed"), (0.2, 0.8, "lower_predominant"), (0.55, 0.45, "diffuse"), (0.0, 0.0, "diffuse"),
])
def test_gap_distribution(spark, upper, lower, want):
    assert spark.range(1).select(rules.gap_distribution(F.lit(upper), F.lit(lower)).alias("p")).first().p == want


@pytest.mark.parametrize("types,dominant,category,confidence", [
    ([], None, "normal", 0.0),
    (["honeycomb", "reticulation"], "reticulation", "uip_like", 0.8),
    (["honeycomb"], "honeycomb", "uip_like", 0.9),
    (["ground_glass_opacity", "consolidation"], "ground_glass_opacity", "op_like", 0.7),
    (["ground_glass_opacity"], "ground_glass_opacity", "nsip_like", 0.6),
    (["reticulation", "ground_glass_opacity"], "ground_glass_opacity", "nsip_like", 0.7),
    (["reticulation", "ground_glass_opacity"], "reticulation", "nsip_like", 0.7),
    (["reticulation"], "reticulation", "fibrotic", 0.6),
    (["consolidation"], "consolidation", "op_like", 0.6),
    (["something"], "something", "other", 0.3),
])
def test_lesion_pattern(spark, types, dominant, category, confidence):
    df = spark.createDataFrame([(types, dominant)], "lesion_types array<string>, dominant_lesion string")
    row = rules.lesion_pattern(df).first()
    assert (row.lesion_pattern, row.lesion_pattern_confidence) == (category, confidence)
    assert row.lesion_pattern_reasons


FEATURES = ("case_id int, lesion_types array<string>, dominant_lesion string, lung_lesion_volume double, total_lung_volume double, "
            "distribution_pattern string, axial_distribution string, subpleural_involvement boolean, subpleural_ratio double")


def classified(spark, *rows):
    df = spark.createDataFrame([(n, *row) for n, row in enumerate(rows)], FEATURES)
    return {r.case_id: r for r in rules.classify(df).collect()}


def test_classification(spark):
    got = classified(
        spark,
        (["honeycomb", "reticulation"], "honeycomb", 30.0, 100.0, "lower_predominant", "peripheral", True, 0.6),
        (["reticulation", "ground_glass_opacity"], "ground_glass_opacity", 30.0, 100.0, "diffuse", "diffuse_scattered", False, 0.0),
        (["ground_glass_opacity", "consolidation"], "consolidation", 30.0, 100.0, "diffuse", "peripheral", True, 0.05),
        (["reticulation"], "reticulation", 1.0, 100.0, "diffuse", "peripheral", True, 0.5),
        ([], None, 0.0, 0.0, "unknown", "unknown", False, 0.0),
        (["something"], None, 30.0, 100.0, "mixed", "central", True, 0.2),
    )
    # 0.4 + 0.2 + 0.2 + 0.15 + 0.15 + 0.1 + 0.05, kept at 1.
    assert (got[0].predicted_pattern, got[0].confidence, got[0].certainty_level) == ("UIP", 1.0, "high")
    # 0.2 + 0.2 + 0.15 + 0.15 + 0.1 + 0.1 + 0.2, kept at 1.
    assert (got[1].predicted_pattern, got[1].score_nsip, got[1].score_other) == ("NSIP", 1.0, 0.0)
    # 0.3 + 0.2 + 0.2 + 0.1 + 0.05 + 0.1 + 0.05
    assert (got[2].predicted_pattern, got[2].score_op, got[2].certainty_level) == ("OP", 1.0, "high")
    assert got[2].score_nsip == 0.6
    assert got[3].normal and got[3].confidence == 0.9 and got[3].differential == [] and got[3].reasoning == ["Minimal or no lesions detected"]
    assert got[4].normal
    # UIP 0.15 - 0.1, NSIP 0.15 - 0.1, OP 0.1 + 0.05: Other wins with 0.85.
    assert (got[5].score_uip, got[5].score_nsip, got[5].score_op) == (0.05, 0.05, 0.15)
    assert (got[5].predicted_pattern, got[5].confidence) == ("Other", 0.85)
    assert [d.pattern for d in got[5].differential] == ["Other", "OP"]


def test_equal_scores_follow_pattern_order(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5, 0.5, 0.0)], "score_uip double, score_nsip double, score_op double, score_other double, score_normal double")
    ranked = df.select(rules.ranked_patterns().alias("r")).first().r
    assert [e.pattern for e in ranked] == rules.PATTERNS


def test_scores_stay_within_bounds(spark):
    names = ["honeycomb", "reticulation", "ground_glass_opacity", "consolidation"]
    rows = []
    for mask in range(1, 16):
        types = [n for i, n in enumerate(names) if mask >> i & 1]
        for dominant in types:
            for dist in ("upper_predominant", "lower_predominant", "diffuse", "minimal", "mixed"):
                for axial in ("peripheral", "central", "diffuse_scattered"):
                    for involved, share in ((False, 0.0), (True, 0.05), (True, 0.9)):
                        rows.append((types, dominant, 30.0, 100.0, dist, axial, involved, share))
    for r in classified(spark, *rows).values():
        scores = [r.score_uip, r.score_nsip, r.score_op, r.score_other]
        assert all(0.0 <= s <= 1.0 for s in scores) and r.confidence == max(scores)


def test_subpleural_pattern(spark):
    rows = [(0, False, 0.0, 9.0, 0.0, False), (1, True, 0.6, 0.5, 20.0, True), (2, True, 0.3, 2.0, 10.0, False), (3, True, 0.1, 1.0, 15.0, False)]
    df = spark.createDataFrame(rows, "case_id int, subpleural_involvement boolean, subpleural_ratio double, min_distance_mm double, within_2mm_percent double, direct_contact boolean")
    got = {r.case_id: r for r in rules.subpleural_pattern(df).collect()}
    assert [(got[n].uip_likelihood, got[n].nsip_likelihood) for n in range(4)] == [(0.0, 0.6), (1.0, 0.0), (0.6, 0.4), (0.5, 0.5)]
    assert got[1].characteristics == ["extensive_subpleural_involvement", "direct_pleural_contact", "immediate_subpleural", "predominantly_immediate_subpleural"]


def test_bands_and_bins_are_half_open(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 3.0, 5.0)], "d double")
    assert [r.b for r in df.select(distance_band(F.col("d")).alias("b")).collect()] == [0, 1, 2, 3, 4]
    bins = df.select(gradient_bin(F.col("d"), F.lit(5.0)).alias("b")).collect()
    assert [r.b for r in bins] == [0, 2, 4, 6, None]
