"""Splits and ranks: exact, disjoint, and independent of partitioning."""

from pyspark.sql import functions as F

from voxtable.operators.ranking import seeded_rank
from voxtable.operators.sampling import case_split, stratified_split, weighted_draws
from voxtable.operators.training_log import early_stops, epoch_losses


def rows(spark, parts):
    # One stratum holds most of the rows.
    return spark.range(0, 3000, 1, parts).selectExpr("id", "id div 10 as case_id", "if(id % 10 < 7, 0, id % 3) as stratum")


def test_ranks_are_exact(spark):
    ranked = seeded_rank(rows(spark, 3), ["stratum"], F.col("id")).groupBy("stratum").agg(
        F.sort_array(F.collect_list("place")).alias("p"), F.first("group_size").alias("n")
    )
    for r in ranked.collect():
        assert r.p == list(range(1, r.n + 1))


def test_split_quotas(spark):
    split = stratified_split(rows(spark, 3), ["stratum"], F.col("id"))
    counts = {}
    for r in split.groupBy("stratum", "split").count().collect():
        counts.setdefault(r.stratum, {})[r.split] = r["count"]
    for by_split in counts.values():
        n = sum(by_split.values())
        assert abs(by_split["test"] - n * 0.1) <= 1 and abs(by_split["valid"] - n * 0.1) <= 1
    again = stratified_split(rows(spark, 11), ["stratum"], F.col("id"))
    assert split.select("id", "split").exceptAll(again.select("id", "split")).isEmpty()


def test_cases_stay_together(spark):
    split = case_split(rows(spark, 2))
    assert split.groupBy("case_id").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty()


def test_weighted_draws_reach_the_share(spark):
    slices = spark.range(1000).selectExpr("id", "id % 20 = 0 as background")
    draws = spark.range(4000).withColumnRenamed("id", "draw")
    got = weighted_draws(slices, F.col("id"), draws, share=0.3)
    assert got.count() == 4000
    assert abs(got.where("background").count() / 4000 - 0.3) < 0.03


def test_early_stop_rules(spark):
    nan, inf = float("nan"), float("inf")
    runs = {"a": [5.0, 4.0, 4.0, 4.0, 1.0], "b": [nan, 3.0, inf, 2.0, 1.0], "c": [1.0, 0.995, 0.99, 0.98, 0.97]}
    data = [(run, n, loss) for run, losses in runs.items() for n, loss in enumerate(losses)]
    got = {r.run: r for r in early_stops(spark.createDataFrame(data, "run string, epoch int, val_loss double"), 2, 0.01).collect()}
    assert (got["a"].stop_epoch, got["a"].best_loss) == (3, 4.0)
    assert (got["b"].stop_epoch, got["b"].best_loss, got["b"].misses) == (None, 1.0, 0)
    # Steps of at most 0.01 are misses until they add up to more than that against the best.
    assert (got["c"].stop_epoch, got["c"].best_loss) == (2, 1.0)


def test_failed_and_missing_steps(spark):
    data = [("r", 0, 1.0, False), ("r", 0, 2.0, False), ("r", 1, 1.0, True), ("r", 1, 1.0, False)]
    steps = spark.createDataFrame(data, "run string, epoch int, loss double, failed boolean")
    got = {r.epoch: r.train_loss for r in epoch_losses(steps, 4).collect()}
    assert got == {0: (3.0 + 2e10) / 4, 1: float("inf")}
