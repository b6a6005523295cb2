"""Ratings: category values, weighted scores, running logs, streaks, limits, reviews. Writes return new frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.numbers import half_up


def aggregate_scores(breakdowns: DataFrame) -> DataFrame:
    """person_id, score: weighted mean of the categories present; 100 where none has weight."""
    weight = F.round(scores.category_weight(F.col("category")) * 100)  # whole numbers: the sums don't hang on their order
    grouped = breakdowns.groupBy("person_id").agg(F.sum(F.col("value") * weight).alias("v"), F.sum(weight).alias("w"))
    return grouped.select("person_id", F.coalesce(half_up(F.try_divide("v", "w"), 2), F.lit(scores.BASELINE)).alias("score"))


def categories(spark) -> DataFrame:
    return spark.createDataFrame(list(scores.CATEGORY_WEIGHTS.items()), "category string, weight double")


def full_breakdown(persons: DataFrame, breakdowns: DataFrame) -> DataFrame:
    """Every category of every person; unknown values are 100. The six categories are exploded, so nothing is joined to get them."""
    each = persons.select(F.col("id").alias("person_id"), F.explode(F.array(*[F.lit(c) for c in scores.CATEGORY_WEIGHTS])).alias("category"))
    return each.join(breakdowns.select("person_id", "category", "value"), ["person_id", "category"], "left").withColumn("value", F.coalesce("value", F.lit(scores.BASELINE)))


def rating_log(changes: DataFrame) -> DataFrame:
    """old_value and new_value of every change (person_id, category, seq, delta): clamped, running from 100; zero changes leave no row."""
    clamped = changes.withColumn("delta", scores.clamp_delta(F.col("delta"))).where("delta <> 0")
    running = Window.partitionBy("person_id", "category").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    after = clamped.withColumn("new_value", scores.BASELINE + F.sum("delta").over(running))
    return after.withColumn("old_value", F.col("new_value") - F.col("delta"))


def apply_changes(breakdowns: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New breakdowns and the log of one change per person and category; categories without a value start at 100."""
    clamped = changes.withColumn("delta", scores.clamp_delta(F.col("delta")))
    joined = breakdowns.join(clamped.select("person_id", "category", "delta"), ["person_id", "category"], "full_outer")
    old = F.coalesce("value", F.lit(scores.BASELINE))
    moved = F.coalesce("delta", F.lit(0.0))
    log = joined.where(moved != 0).select("person_id", "category", old.alias("old_value"), (old + moved).alias("new_value"), moved.alias("delta"))
    kept = joined.where(F.col("value").isNotNull() | (moved != 0)).select("person_id", "category", (old + moved).alias("value"))
    return kept, log


def review(reports: DataFrame, decisions: DataFrame) -> DataFrame:
    """reports with the decision's status; whatever isn't APPROVE rejects, also a request for more information. Only open reports change."""
    joined = reports.join(decisions.select(F.col("report_id").alias("id"), "decision"), "id", "left")
    open_ = F.col("status").isin("PENDING", "UNDER_REVIEW") & F.col("decision").isNotNull()
    return joined.withColumn("status", F.when(open_, F.when(F.col("decision") == "APPROVE", "APPROVED").otherwise("REJECTED")).otherwise(F.col("status"))).drop("decision")


def reviewed(reports: DataFrame, decisions: DataFrame, breakdowns: DataFrame, deltas: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reports, breakdowns, log) after decisions (report_id, decision); deltas: report_id, category, delta.

    Approved reports, and only those open before, move their person's categories, in order of the reports' ids. The log
    has a row for each move: report_id, person_id, category, old_value, new_value, delta.
    """
    after = review(reports, decisions)
    approved = reports.where(F.col("status").isin("PENDING", "UNDER_REVIEW")).select(F.col("id").alias("report_id"), "person_id").join(decisions.where("decision = 'APPROVE'").select("report_id"), "report_id")
    moves = approved.join(deltas.withColumn("delta", scores.clamp_delta(F.col("delta"))).where("delta <> 0"), "report_id")
    running = Window.partitionBy("person_id", "category").orderBy("report_id").rowsBetween(Window.unboundedPreceding, 0)
    log = moves.join(breakdowns.select("person_id", "category", "value"), ["person_id", "category"], "left").withColumn("new_value", F.coalesce("value", F.lit(scores.BASELINE)) + F.sum("delta").over(running))
    log = log.select("report_id", "person_id", "category", (F.col("new_value") - F.col("delta")).alias("old_value"), "new_value", "delta")
    moved = moves.groupBy("person_id", "category").agg(F.sum("delta").alias("moved"))
    values = breakdowns.select("person_id", "category", "value").join(moved, ["person_id", "category"], "full_outer")
    return after, values.select("person_id", "category", (F.coalesce("value", F.lit(scores.BASELINE)) + F.coalesce("moved", F.lit(0.0))).alias("value")), log


def streaks(activity: DataFrame) -> DataFrame:
    """person_id, first_day, last_day, days: runs of consecutive days with activity (person_id, at)."""
    days = activity.select("person_id", F.to_date("at").alias("day")).distinct()
    order = Window.partitionBy("person_id").orderBy("day")
    island = F.date_sub("day", F.row_number().over(order))
    return days.withColumn("island", island).groupBy("person_id", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days")).drop("island")


def current_streaks(activity: DataFrame, as_of: Column) -> DataFrame:
    """person_id, longest, current: 0 once more than a day has passed."""
    runs = streaks(activity)
    last = F.max_by("days", "last_day")
    return runs.groupBy("person_id").agg(F.max("days").alias("longest"), F.when(F.date_diff(F.to_date(as_of), F.max("last_day")) > 1, 0).otherwise(last).alias("current"))


def over_limits(reports: DataFrame, per_day: int = 5, per_person: int = 2, days: int = 7) -> DataFrame:
    """reports with allowed: fewer than per_day earlier ones of the reporter that day, and fewer than per_person on the person within `days` days.

    Earlier means created earlier, then a smaller id, so a report never counts itself or a later one.
    """
    day = Window.partitionBy("reporter_id", F.to_date("created_at")).orderBy("created_at", "id")
    seconds = F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col("created_at"))
    week = Window.partitionBy("reporter_id", "person_id").orderBy("seconds").rangeBetween(-days * 86400, 0)
    ranked = reports.withColumn("seconds", seconds).withColumn("today", F.row_number().over(day) - 1)
    same = Window.partitionBy("reporter_id", "person_id", "seconds").orderBy("id")
    ranked = ranked.withColumn("lately", F.count(F.lit(1)).over(week) - (F.count(F.lit(1)).over(Window.partitionBy("reporter_id", "person_id", "seconds")) - F.row_number().over(same)) - 1)
    return ranked.withColumn("allowed", (F.col("today") < per_day) & (F.col("lately") < per_person)).drop("seconds")


def reporter_accuracy(reports: DataFrame) -> DataFrame:
    """reporter_id, approved, rejected, accuracy."""
    grouped = reports.groupBy("reporter_id").agg(F.count_if(F.col("status") == "APPROVED").alias("approved"), F.count_if(F.col("status") == "REJECTED").alias("rejected"))
    return grouped.withColumn("accuracy", scores.accuracy(F.col("approved"), F.col("rejected")))
