"""Splits, label draws, background sampling and weights: seeded and order-independent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtable.functions.draws import SEED, draw_element, draw_number, draw_unit
from voxtable.functions.joins import shuffled
from voxtable.operators.ranking import seeded_rank
from voxtable.schema import TRAINING_LESIONS
from voxtable.session import written


def label_slice_counts(pairs: DataFrame) -> DataFrame:
    """Slices containing each label."""
    return pairs.groupBy("label").agg(F.count("*").alias("slices"))


def rarest_lesion(slices: DataFrame, pairs: DataFrame) -> DataFrame:
    """Stratum of every slice: its lesion label with the fewest slices overall, else 1.

    The count table has one row per label, a handful.
    """
    counts = label_slice_counts(pairs)
    lesions = pairs.where(F.col("label") > 1).join(F.broadcast(counts), "label")
    rarest = lesions.groupBy("case_id", "z").agg(F.min_by("label", F.struct("slices", "label")).alias("stratum"))
    return slices.select("case_id", "z").join(shuffled(rarest), ["case_id", "z"], "left").fillna(1, ["stratum"])


def split_of(place: Column, size: Column, valid: float, test: float) -> Column:
    """Split by rank: rounded quotas for test and validation, the rest trains."""
    tests = F.floor(size * test + 0.5)
    valids = F.floor(size * valid + 0.5)
    return F.when(place <= tests, "test").when(place <= tests + valids, "valid").otherwise("train")


def stratified_split(
    rows: DataFrame, strata: Sequence[str], key: Column, valid: float = 0.1, test: float = 0.1, seed: int = SEED
) -> DataFrame:
    """Add ``split`` with exact quotas in every stratum."""
    ranked = seeded_rank(written(rows, "strata"), strata, key, seed)
    split = split_of(F.col("place"), F.col("group_size"), valid, test)
    return ranked.withColumn("split", split).drop("place", "group_size")


def case_split(strata: DataFrame, valid: float = 0.1, test: float = 0.1, seed: int = SEED) -> DataFrame:
    """Split whole cases, so none is in two splits; the stratum of a case is its highest one."""
    cases = strata.groupBy("case_id").agg(F.max("stratum").alias("case_stratum"))
    split = stratified_split(cases, ["case_stratum"], F.col("case_id"), valid, test, seed)
    return strata.join(shuffled(split.select("case_id", "split")), "case_id")


def absent_labels(slices: DataFrame, lesions: Sequence[int] = TRAINING_LESIONS) -> DataFrame:
    """Per slice the lesion labels it has and those it lacks, ascending arrays."""
    every = F.array(*[F.lit(label) for label in lesions])
    present = F.array_intersect(every, F.col("labels"))
    return slices.select("case_id", "z", present.alias("present"), F.array_except(every, F.col("labels")).alias("absent"))


def label_draw(slices: DataFrame, key: Column, negative_rate: float = 0.25, seed: int = SEED) -> DataFrame:
    """Draw one label per slice: an absent one (empty target) at the negative rate, else a present one."""
    negative = (draw_unit(key, f"{seed}n") < negative_rate) & (F.size("absent") > 0)
    positive = F.coalesce(draw_element(F.col("present"), key, f"{seed}p"), F.lit(1))
    drawn = F.when(negative, draw_element(F.col("absent"), key, f"{seed}a")).otherwise(positive)
    return slices.withColumns({"label": drawn, "empty_target": negative})


def caption_draw(drawn: DataFrame, labels: DataFrame, key: Column, seed: int = SEED) -> DataFrame:
    """Attach a random synonym of the drawn label; the dimension has five rows."""
    names = labels.where("scheme = 'training'").select(F.col("label_id").alias("label"), "synonyms")
    return drawn.join(F.broadcast(names), "label").withColumn(
        "caption", draw_element(F.col("synonyms"), key, f"{seed}c")
    ).drop("synonyms")


def flipped(voxels: DataFrame, key: Column, seed: int = SEED) -> DataFrame:
    """Mirror x and y, each with probability ½ per key; needs ``ny`` and ``nx``."""
    mirror_x = draw_number(key, f"{seed}x") % 2 == 1
    mirror_y = draw_number(key, f"{seed}y") % 2 == 1
    return voxels.withColumns({
        "x": F.when(mirror_x, F.col("nx") - 1 - F.col("x")).otherwise(F.col("x")),
        "y": F.when(mirror_y, F.col("ny") - 1 - F.col("y")).otherwise(F.col("y")),
    })


def background_slices(profile: DataFrame, cases: DataFrame, share: float = 0.3, edge: int = 1) -> DataFrame:
    """Lesion-free slices for training: edges out, three fields of z, most lung first.

    ``profile`` holds ``lung_voxels`` and ``lesion_voxels`` per slice. Each field of a case
    takes a third of the background slices that bring the case to ``share``, rounded up.
    """
    quota = profile.groupBy("case_id").agg(
        F.ceil(F.count_if(F.col("lesion_voxels") > 0) * share / (1 - share) / 3).alias("quota")
    )
    by_lung = Window.partitionBy("case_id", "field").orderBy(F.desc("lung_voxels"), "z")
    free = (
        profile.join(cases.select("case_id", "nz"), "case_id")
        .where((F.col("lesion_voxels") == 0) & (F.col("z") >= edge) & (F.col("z") < F.col("nz") - edge))
        .withColumn("field", F.floor(F.col("z") * 3 / F.col("nz")).cast("int"))
        .withColumn("place", F.row_number().over(by_lung))
    )
    return free.join(quota, "case_id").where(F.col("place") <= F.col("quota")).select(
        "case_id", "z", "field", "place", "lung_voxels"
    )


def sampling_weights(slices: DataFrame, share: float = 0.3) -> DataFrame:
    """Weight per slice so that background slices are drawn with probability ``share``.

    Needs a boolean ``background``. The count table has two rows.
    """
    target = F.when(F.col("background"), share).otherwise(1 - share)
    weights = slices.groupBy("background").agg(F.count("*").alias("n")).select(
        "background", (target / F.col("n")).alias("weight")
    )
    return slices.join(F.broadcast(weights), "background")


def weighted_draws(slices: DataFrame, key: Column, draws: DataFrame, share: float = 0.3, seed: int = SEED) -> DataFrame:
    """Draw with replacement: each row of ``draws`` (column ``draw``) picks a class, then a rank in it."""
    ranked = seeded_rank(slices, ["background"], key, seed).withColumn("place", F.col("place").cast("bigint"))
    sizes = slices.groupBy("background").agg(F.count("*").alias("size"))
    picks = (
        draws.withColumn("background", draw_unit(F.col("draw"), f"{seed}b") < share)
        .join(F.broadcast(sizes), "background")
        .withColumn("place", draw_number(F.col("draw"), f"{seed}r") % F.col("size") + 1)
    )
    return picks.join(shuffled(ranked), ["background", "place"]).drop("size", "group_size", "place")


def split_profile(slices: DataFrame) -> DataFrame:
    """Slices, cases, background share and slices per lesion label in every split."""
    return slices.groupBy("split").agg(
        F.count("*").alias("slices"),
        F.countDistinct("case_id").alias("patients"),
        F.avg(F.when(F.size("present") == 0, 1.0).otherwise(0.0)).alias("background_share"),
        *[F.count_if(F.array_contains("present", label)).alias(f"slices_label_{label}") for label in TRAINING_LESIONS],
    )
