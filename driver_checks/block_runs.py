"""Checks of the training-log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_checks import fixtures as fx
from driver_checks.registry import check, extend
from voxtable.functions.schedules import learning_rate, warmup_progress
from voxtable.operators import training_log as tl
from voxtable.streaming.live_metrics import epoch_progress

extend({
    "rate": """select run, step, (case when step < 500 then 1e-4*(0.01 + 0.99*step/500) else 1e-6 + (1e-4 - 1e-6)*(1 + cos(pi()*(step - 500)/4500))/2 end)*1e4 as rate,
        least(1.0, step/500)::double as warmup_progress from steps""",
    "best": "select *, min(val_loss) over (partition by run order by epoch) as best_so_far, min(val_loss) over (partition by run order by epoch rows between unbounded preceding and 1 preceding) as before from vals",
    "ordered": "select run, epoch, val_loss, row_number() over (partition by run order by epoch) as n from vals",
    "stops": """select run, n, val_loss as best, 0 as misses, null::bigint as stopped from ordered where n = 1 union all
        select o.run, o.n, case when s.stopped is null and o.val_loss < s.best - 0.01 then o.val_loss else s.best end,
          case when s.stopped is not null then s.misses when o.val_loss < s.best - 0.01 then 0 else s.misses + 1 end,
          case when s.stopped is not null then s.stopped when o.val_loss >= s.best - 0.01 and s.misses + 1 >= 5 then o.epoch end
        from stops s join ordered o on o.run = s.run and o.n = s.n + 1""",
}, {"rate": ["steps"], "best": ["vals"], "ordered": ["vals"], "stops": ["ordered"]})


@check("d44_epoch_losses", """select run, epoch, count(*) as steps, round(avg(case when failed then 100.0::double else loss end), 6) as train_loss from steps group by all""", "steps")
def _(spark, folder):
    # Failed steps count as infinite; a finite stand-in keeps the comparison meaningful.
    steps = fx.run_steps(spark, folder).withColumns({"loss": F.expr("if(failed, 100.0D, loss)"), "failed": F.lit(False)})
    return tl.epoch_losses(steps)


@check("d44_failed_epochs", "select run, epoch, bool_or(failed) as failed from steps group by all", "steps")
def _(spark, folder):
    return tl.epoch_losses(fx.run_steps(spark, folder)).select("run", "epoch", (F.col("train_loss") == float("inf")).alias("failed"))


@check("d44_planned_steps", """select run, epoch, round((sum(loss) + (greatest(count(*), 1000) - count(*))*1e10) / greatest(count(*), 1000) / 1e6, 3) as mega_loss from steps group by all""", "steps")
def _(spark, folder):
    steps = fx.run_steps(spark, folder).withColumn("failed", F.lit(False))
    return tl.epoch_losses(steps, 1000).select("run", "epoch", F.round(F.col("train_loss") / 1e6, 3).alias("mega_loss"))


@check("h1_best_epoch", "select run, arg_min(epoch, (val_loss, epoch)) as best_epoch, round(min(val_loss), 6) as best_loss from vals group by all", "vals")
def _(spark, folder):
    return tl.best_epochs(fx.run_validation(spark, folder))


@check("h1_running_best", "select run, epoch, round(val_loss, 6) as val_loss, round(best_so_far, 6) as best_so_far, before is null or val_loss < before as is_new_best from best", "best")
def _(spark, folder):
    return tl.running_best(fx.run_validation(spark, folder))


@check("h2_early_stop", """select run, max(stopped) as stop_epoch, round(arg_max(best, n), 6) as best_loss, arg_max(misses, n)::bigint as misses from stops group by all""", "stops")
def _(spark, folder):
    return tl.early_stops(fx.run_validation(spark, folder), patience=5, min_delta=0.01)


@check("h3_epoch_record", """select run, epoch, n as steps, seconds as epoch_seconds, round(val_loss, 6) as val_loss, round(best_so_far, 6) as best_so_far, before is null or val_loss < before as is_new_best
       from (select run, epoch, count(*) as n, (epoch_ms(max(ts)) - epoch_ms(min(ts))) / 1000 as seconds from steps group by all) join best using (run, epoch)""", "steps", "best")
def _(spark, folder):
    return tl.epoch_records(fx.run_steps(spark, folder), fx.run_validation(spark, folder)).drop("train_loss")


@check("h4_step_record", """select run, epoch, step, round(loss, 6) as loss, round(rate, 6) as rate, round(warmup_progress, 6) as warmup_progress from steps join rate using (run, step)""", "steps", "rate")
def _(spark, folder):
    rows = tl.step_records(fx.run_steps(spark, folder), 500, 5000)
    return rows.withColumn("rate", F.col("learning_rate") * 1e4).drop("learning_rate")


@check("b29_learning_rate", "select run, step, round(rate, 6) as rate from rate", "rate")
def _(spark, folder):
    rate = learning_rate(F.col("step"), F.lit(500), F.lit(5000)) * 1e4
    return fx.run_steps(spark, folder).select("run", "step", rate.alias("rate"))


@check("b30_warmup_progress", "select run, step, round(warmup_progress, 6) as warmup_progress from rate", "rate")
def _(spark, folder):
    return fx.run_steps(spark, folder).select("run", "step", warmup_progress(F.col("step"), F.lit(500)).alias("warmup_progress"))


@check("j2_epoch_progress", "select run, epoch, count(*) as steps, round(avg(loss), 6) as train_loss, max(step) as last_step from steps group by all", "steps")
def _(spark, folder):
    return epoch_progress(fx.run_steps(spark, folder)).drop("first_ts", "last_ts")
