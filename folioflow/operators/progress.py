"""Moving averages, remaining time and resource summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def moving_average(durations: DataFrame, key: str, order: str, value: str, size: int = 10) -> DataFrame:
    """Positive durations with the mean of the last so many of their stream."""
    last = Window.partitionBy(key).orderBy(order).rowsBetween(1 - size, 0)
    return durations.where(F.col(value) > 0).withColumn("average", F.avg(value).over(last))


def remaining(averages: DataFrame, left: str = "remaining") -> DataFrame:
    """Seconds left and how people read them."""
    seconds = F.when(F.col(left) <= 0, F.lit(0.0)).otherwise(F.col(left) * F.col("average"))
    return averages.withColumn("seconds_left", seconds).withColumn("eta", T.eta(F.col("seconds_left")))


def stage_summary(metrics: DataFrame, stage: str, seconds: str, memory: str, limit: float) -> DataFrame:
    """(stage, seconds, peak, share of all seconds, within limit): the last window is over one row per stage."""
    out = metrics.groupBy(stage).agg(F.sum(seconds).alias("seconds"), F.max(memory).alias("peak"))
    whole = F.sum("seconds").over(Window.partitionBy(F.lit(1)))
    return out.withColumn("share", F.col("seconds") / whole).withColumn("within", F.col("peak") <= limit)


def run_in_group(spark: SparkSession, group: str, action: Callable[[], object]) -> object:
    """What action returns; its jobs make up a group that other threads can watch and cancel."""
    spark.sparkContext.setJobGroup(group, group, interruptOnCancel=True)
    try:
        return action()
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            spark.sparkContext.setLocalProperty(name, None)


def group_progress(spark: SparkSession, group: str) -> tuple[int, int]:
    """(tasks done, tasks) of the group's jobs that run now."""
    tracker, done, total = spark.sparkContext.statusTracker(), 0, 0
    for job in tracker.getJobIdsForGroup(group):
        if (info := tracker.getJobInfo(job)) and info.status == "RUNNING":
            for stage in filter(None, map(tracker.getStageInfo, info.stageIds)):
                done, total = done + stage.numCompletedTasks, total + stage.numTasks
    return done, total


def cancel_group(spark: SparkSession, group: str) -> None:
    """End the group's jobs; the action that waits for them raises."""
    spark.sparkContext.cancelJobGroup(group)
