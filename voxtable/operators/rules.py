"""Pattern rules as column expressions: every rule is a ``when``, every score a sum.

Scores are sums of small decimal weights, so they are rounded to ten digits before
any comparison; reasons are arrays in rule order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.functions.grading import involvement, likelihood, percent_text, title

HONEYCOMB, RETICULATION = "honeycomb", "reticulation"
GGO, CONSOLIDATION = "ground_glass_opacity", "consolidation"

# The patterns in the order that settles equal scores.
PATTERNS = ["UIP", "NSIP", "OP", "Other", "Normal"]

MINIMAL_LESION = 0.02
EXTENSIVE_SUBPLEURAL = 0.30


def _has(name: str) -> Column:
    return F.array_contains("lesion_types", name)


def _dominant(name: str) -> Column:
    return F.coalesce(F.col("dominant_lesion") == name, F.lit(False))


def _reasons(*pairs: tuple[Column, Column | str]) -> Column:
    texts = [F.when(condition, F.lit(text) if isinstance(text, str) else text) for condition, text in pairs]
    return F.array_compact(F.array(*texts))


def lesion_pattern(lesions: DataFrame) -> DataFrame:
    """Pattern suggested by the lesion types alone, with confidence and reasons."""
    nothing = F.size("lesion_types") == 0
    honeycomb = ~nothing & _has(HONEYCOMB)
    rest = ~nothing & ~_has(HONEYCOMB)
    ggo_mixed = rest & _dominant(GGO) & _has(CONSOLIDATION)
    ggo_pure = rest & _dominant(GGO) & ~_has(CONSOLIDATION)
    ggo_lines = ggo_pure & _has(RETICULATION)
    lines_ggo = rest & _dominant(RETICULATION) & _has(GGO)
    lines_pure = rest & _dominant(RETICULATION) & ~_has(GGO)
    solid = rest & _dominant(CONSOLIDATION)
    category = (
        F.when(nothing, "normal").when(honeycomb, "uip_like").when(ggo_mixed, "op_like")
        .when(ggo_pure, "nsip_like").when(lines_ggo, "nsip_like").when(lines_pure, "fibrotic")
        .when(solid, "op_like").otherwise("other")
    )
    confidence = (
        F.when(nothing, 0.0).when(honeycomb & _dominant(HONEYCOMB), 0.9).when(honeycomb, 0.8)
        .when(ggo_mixed, 0.7).when(ggo_lines, 0.7).when(ggo_pure, 0.6)
        .when(lines_ggo, 0.7).when(lines_pure, 0.6).when(solid, 0.6).otherwise(0.3)
    )
    # Reason texts.
    reasons = _reasons(
        (nothing, "No lesions detected"),
        (honeycomb, "Honeycomb pattern present"),
        (honeycomb & _dominant(HONEYCOMB), "Honeycomb is dominant lesion"),
        (ggo_mixed, "GGO with consolidation present"),
        (ggo_pure, "Ground glass opacity dominant"),
        (ggo_lines, "GGO with reticulation"),
        (lines_ggo, "Reticulation with GGO"),
        (lines_pure, "Reticulation dominant"),
        (solid, "Consolidation dominant"),
        (category == "other", "Mixed or unclear pattern"),
    )
    return lesions.withColumns({
        "lesion_pattern": category, "lesion_pattern_confidence": confidence, "lesion_pattern_reasons": reasons,
    })


def density_distribution(upper: Column, lower: Column, upper_density: Column, lower_density: Column) -> Column:
    """Predominance at 65 %; with 20 % on both sides, a density 1.5 times as high decides."""
    both = (upper >= 0.20) & (lower >= 0.20)
    return (
        F.when(upper >= 0.65, "upper_predominant")
        .when(lower >= 0.65, "lower_predominant")
        .when(both & (upper_density > lower_density * 1.5), "upper_predominant")
        .when(both & (lower_density > upper_density * 1.5), "lower_predominant")
        .when(both, "diffuse")
        .when((upper < 0.20) & (lower < 0.20), "minimal")
        .when(upper > lower, "upper_predominant")
        .otherwise("lower_predominant")
    )


def gap_distribution(upper: Column, lower: Column) -> Column:
    """Predominance above 70 %, diffuse up to a gap of 0.20, else mixed."""
    return (
        F.when(upper > 0.70, "upper_predominant")
        .when(lower > 0.70, "lower_predominant")
        .when(F.abs(upper - lower) <= 0.20, "diffuse")
        .otherwise("mixed")
    )


def distribution_summary(rows: DataFrame) -> DataFrame:
    """Involvement per side, overall severity, and the proportions as text."""
    upper, lower = F.col("upper_lesion_ratio"), F.col("lower_lesion_ratio")
    return rows.select(
        "case_id",
        F.col("distribution_pattern").alias("pattern"),
        involvement(upper).alias("upper_involvement"),
        involvement(lower).alias("lower_involvement"),
        involvement(F.greatest(upper, lower)).alias("overall_severity"),
        percent_text(F.col("upper_lesion_proportion")).alias("upper_percentage"),
        percent_text(F.col("lower_lesion_proportion")).alias("lower_percentage"),
    )


def axial_pattern(peripheral: Column, central: Column, share: float = 0.70) -> Column:
    return (
        F.when(peripheral >= share, "peripheral").when(central >= share, "central").otherwise("diffuse_scattered")
    )


def subpleural_pattern(rows: DataFrame) -> DataFrame:
    """Extent of subpleural involvement with its UIP and NSIP likelihoods."""
    involved, ratio = F.col("subpleural_involvement"), F.col("subpleural_ratio")
    close = involved & (F.col("min_distance_mm") <= 1.0)
    packed = involved & (F.col("within_2mm_percent") >= 15)
    contact = involved & F.col("direct_contact")
    pattern = (
        F.when(~involved, "no_subpleural_involvement").when(ratio >= 0.5, "extensive_subpleural")
        .when(ratio >= 0.2, "moderate_subpleural").otherwise("minimal_subpleural")
    )
    severity = F.when(~involved, "none").when(ratio >= 0.5, "severe").when(ratio >= 0.2, "moderate").otherwise("mild")
    base = F.when(~involved, 0.0).when(ratio >= 0.5, 0.8).when(ratio >= 0.2, 0.6).otherwise(0.3)
    extra = sum((F.when(flag, 0.1).otherwise(0.0) for flag in (contact, close, packed)), F.lit(0.0))
    uip = F.least(F.lit(1.0), F.round(base + extra, 10))
    nsip = F.when(involved, F.greatest(F.lit(0.0), F.round(1.0 - uip, 10))).otherwise(0.6)
    # Characteristic names.
    names = _reasons(
        (involved & (ratio >= 0.5), "extensive_subpleural_involvement"),
        (involved & (ratio >= 0.2) & (ratio < 0.5), "moderate_subpleural_involvement"),
        (involved & (ratio < 0.2), "minimal_subpleural_involvement"),
        (contact, "direct_pleural_contact"),
        (close, "immediate_subpleural"),
        (packed, "predominantly_immediate_subpleural"),
    )
    return rows.select(
        "case_id", pattern.alias("pattern_type"), severity.alias("severity"), names.alias("characteristics"),
        uip.alias("uip_likelihood"), nsip.alias("nsip_likelihood"),
    )


def subpleural_summary(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """Involvement in words and the fullest distance band (the first one wins a tie)."""
    first = bands.where(F.col("percent") > 0).groupBy("case_id").agg(
        F.max_by("band_name", F.struct("percent", -F.col("band"))).alias("fullest")
    )
    involved, ratio = F.col("subpleural_involvement"), F.col("subpleural_ratio")
    span = F.replace(F.replace(F.col("fullest"), F.lit("distance_"), F.lit("")), F.lit("_"), F.lit("-"))
    return rows.join(first, "case_id", "left").select(
        "case_id",
        F.when(involved, "Yes").otherwise("No").alias("involvement"),
        F.when(~involved, "None").when(ratio >= 0.5, "Extensive (≥50%)").when(ratio >= 0.2, "Moderate (20-50%)")
        .otherwise("Minimal (<20%)").alias("severity"),
        F.when(involved, F.format_string("%.1fmm", "min_distance_mm")).otherwise("N/A").alias("min_distance"),
        F.when(involved & F.col("fullest").isNotNull(), F.concat(F.lit("Predominantly "), span, F.lit("mm from pleura")))
        .otherwise("N/A").alias("distribution"),
    )


def is_normal(threshold: float = MINIMAL_LESION) -> Column:
    """No lesion type, or lesions in less than 2 % of the lung volume (floored at 1)."""
    share = F.col("lung_lesion_volume") / F.greatest(F.col("total_lung_volume"), F.lit(1.0))
    return (F.size("lesion_types") == 0) | (share < threshold)


# A rule: when it holds, what it adds, and the reason it gives.
Rule = tuple[Column, float, "Column | str"]


def uip_rules() -> list[Rule]:
    lower, upper = F.col("distribution_pattern") == "lower_predominant", F.col("distribution_pattern") == "upper_predominant"
    axial, involved = F.col("axial_distribution"), F.col("subpleural_involvement")
    # Weights and reason texts.
    return [
        (_has(HONEYCOMB), 0.4, "Honeycomb pattern present (strong UIP indicator)"),
        (_has(HONEYCOMB) & _dominant(HONEYCOMB), 0.2, "Honeycomb is dominant lesion"),
        (lower, 0.2, "Lower lobe predominance"),
        (upper, -0.1, "Upper lobe predominance (atypical for UIP)"),
        (axial == "peripheral", 0.15, "Peripheral distribution"),
        (axial == "central", -0.1, "Central distribution (atypical for UIP)"),
        (involved, 0.15, "Subpleural involvement"),
        (involved & (F.col("subpleural_ratio") > EXTENSIVE_SUBPLEURAL), 0.1, "Extensive subpleural involvement"),
        (~involved, -0.05, "No subpleural involvement (atypical for UIP)"),
        (_has(RETICULATION), 0.05, "Reticulation pattern present"),
        (_dominant(GGO), -0.1, "Extensive ground glass (atypical for UIP)"),
    ]


def nsip_rules() -> list[Rule]:
    pattern, axial = F.col("distribution_pattern"), F.col("axial_distribution")
    involved, little = F.col("subpleural_involvement"), F.col("subpleural_ratio") < 0.1
    # Weights and reason texts.
    return [
        (_has(GGO), 0.2, "Ground glass opacity present"),
        (_has(GGO) & _dominant(GGO), 0.2, "Ground glass is dominant"),
        (_has(RETICULATION), 0.15, "Reticulation pattern present"),
        (~_has(HONEYCOMB), 0.15, "No honeycomb pattern (typical for NSIP)"),
        (_has(HONEYCOMB), -0.2, "Honeycomb present (atypical for NSIP)"),
        (pattern.isin("diffuse", "upper_predominant"), 0.1, F.concat(pattern, F.lit(" distribution"))),
        (pattern == "lower_predominant", 0.05, "Lower predominance (less typical for NSIP)"),
        (axial.isin("peripheral", "diffuse_scattered"), 0.1, F.concat(axial, F.lit(" axial distribution"))),
        (~involved, 0.2, "Subpleural sparing (classic NSIP feature)"),
        (involved & little, 0.05, "Minimal subpleural involvement"),
        (involved & ~little, -0.1, "Significant subpleural involvement (atypical for NSIP)"),
    ]


def op_rules() -> list[Rule]:
    pattern = F.col("distribution_pattern")
    mixed = _has(GGO) & _has(CONSOLIDATION)
    # Weights and reason texts.
    return [
        (_has(CONSOLIDATION), 0.3, "Consolidation present"),
        (_has(CONSOLIDATION) & _dominant(CONSOLIDATION), 0.2, "Consolidation is dominant"),
        (mixed, 0.2, "Mixed ground glass and consolidation"),
        (~mixed & _dominant(GGO), 0.1, "Ground glass dominant (possible early OP)"),
        (~_has(HONEYCOMB) & ~_has(RETICULATION), 0.1, "No fibrotic patterns (typical for OP)"),
        (pattern.isin("diffuse", "lower_predominant"), 0.05, F.concat(pattern, F.lit(" distribution"))),
        (F.col("axial_distribution") == "peripheral", 0.1, "Peripheral distribution"),
        (F.col("subpleural_involvement"), 0.05, "Subpleural involvement"),
    ]


def score(rules: list[Rule]) -> Column:
    """Sum of the rules that hold, kept within [0, 1]."""
    total = sum((F.when(condition, weight).otherwise(0.0) for condition, weight, _ in rules), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(total, 10)))


def reasons(rules: list[Rule]) -> Column:
    return _reasons(*[(condition, text) for condition, _, text in rules])


def pattern_scores(features: DataFrame) -> DataFrame:
    """Add the five scores; a normal case scores 0.9 as Normal and 0 elsewhere."""
    normal = F.col("normal")
    best = F.greatest("score_uip", "score_nsip", "score_op")
    return (
        features.withColumn("normal", is_normal())
        .withColumns({
            f"score_{name}": F.when(normal, 0.0).otherwise(score(rule_set))
            for name, rule_set in (("uip", uip_rules()), ("nsip", nsip_rules()), ("op", op_rules()))
        })
        .withColumns({
            "score_other": F.when(normal, 0.0).otherwise(F.greatest(F.lit(0.0), F.round(1.0 - best, 10))),
            "score_normal": F.when(normal, 0.9).otherwise(0.0),
        })
    )


def ranked_patterns() -> Column:
    """(pattern, score) structs by score, equal scores in the order of ``PATTERNS``."""
    entries = F.array(*[
        F.struct((-F.col(f"score_{name.lower()}")).alias("key"), F.lit(place).alias("place"), F.lit(name).alias("pattern"))
        for place, name in enumerate(PATTERNS)
    ])
    return F.transform(
        F.array_sort(entries), lambda e: F.struct(e["pattern"].alias("pattern"), (-e["key"]).alias("probability"))
    )


def certainty(first: Column, second: Column) -> Column:
    return (
        F.when(first >= 0.8, "high")
        .when((first >= 0.6) & (F.round(first - second, 10) >= 0.2), "moderate")
        .otherwise("low")
    )


def differential(ranked: Column) -> Column:
    """Up to three best patterns above 0.1, with a word for the score."""
    return F.transform(
        F.filter(F.slice(ranked, 1, 3), lambda e: e["probability"] > 0.1),
        lambda e: F.struct(e["pattern"].alias("pattern"), e["probability"].alias("probability"),
                           likelihood(e["probability"]).alias("likelihood")),
    )


def classify(features: DataFrame) -> DataFrame:
    """Pattern, confidence, certainty, reasons and differential for every case."""
    normal, ranked = F.col("normal"), F.col("ranked")
    empty = F.filter(differential(ranked), lambda e: F.lit(False))
    return (
        pattern_scores(features)
        .withColumn("ranked", ranked_patterns())
        .select(
            "case_id", "normal", *[f"score_{name.lower()}" for name in PATTERNS],
            ranked[0]["pattern"].alias("predicted_pattern"),
            ranked[0]["probability"].alias("confidence"),
            certainty(ranked[0]["probability"], ranked[1]["probability"]).alias("certainty_level"),
            F.when(normal, F.array(F.lit("Minimal or no lesions detected")))
            .otherwise(F.concat(reasons(uip_rules()), reasons(nsip_rules()), reasons(op_rules()))).alias("reasoning"),
            F.when(normal, empty).otherwise(differential(ranked)).alias("differential"),
        )
    )


def classification_summary(classified: DataFrame) -> DataFrame:
    """Display text of a classification."""
    second = F.get(F.col("differential"), F.lit(1))
    return classified.select(
        "case_id",
        F.col("predicted_pattern").alias("pattern"),
        percent_text(F.col("confidence")).alias("confidence"),
        F.initcap("certainty_level").alias("certainty"),
        F.coalesce(
            F.when(
                F.size("differential") > 1,
                F.concat(second["pattern"], F.lit(" ("), percent_text(second["probability"]), F.lit(")")),
            ),
            F.lit("None"),
        ).alias("top_differential"),
    )


def four_variables(features: DataFrame) -> DataFrame:
    """The four variables as display text."""
    involved = F.col("subpleural_involvement")
    return features.select(
        "case_id",
        F.when(F.col("dominant_lesion").isNotNull(), F.concat(F.lit("Dominant: "), F.col("dominant_lesion")))
        .when(F.size("lesion_types") > 0, F.concat(F.lit("Mixed: "), F.array_join(F.slice("lesion_types", 1, 2), ", ")))
        .otherwise("No significant lesions").alias("variable_1_lesion_type"),
        title(F.col("distribution_pattern")).alias("variable_2_lung_distribution"),
        title(F.col("axial_distribution")).alias("variable_3_axial_distribution"),
        F.when(involved, F.concat(F.lit("Present ("), percent_text(F.col("subpleural_ratio")), F.lit(")")))
        .otherwise("Spared").alias("variable_4_subpleural_features"),
    )


