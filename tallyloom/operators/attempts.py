"""Pilot attempts: a state from its events, progress of participants, invariants over a participant's attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.columns import float_log, float_ratio
from tallyloom.operators.rules import attempt_rules, violations

# Usable tasks and task classes that a participant needs, and most attempts.
TARGET_TASKS, LEAST_CLASSES, MOST_ATTEMPTS = 6, 3, 60


def fold_attempts(events: DataFrame) -> DataFrame:
    """The last valid state of each attempt from events(participant, attempt, at, event).

    draft -> frozen -> paired -> invalidated, and frozen -> invalidated; what
    comes out of turn changes nothing and is counted.  States only rise, so the
    fold is a running maximum: an event counts if it goes on from the state before it.
    """
    rank = F.when(F.col("event") == "draft", 1).when(F.col("event") == "frozen", 2).when(F.col("event") == "paired", 3).when(F.col("event") == "invalidated", 4)
    order = F.struct("at", rank.alias("rank"), "event")
    steps = events.where(rank.isNotNull()).groupBy("participant", "attempt").agg(F.array_sort(F.collect_list(order)).alias("steps"))  # a few events an attempt
    allowed = lambda s, e: ((s["state"] == 0) & (e == 1)) | ((s["state"] == 1) & (e == 2)) | ((s["state"] == 2) & e.isin(3, 4)) | ((s["state"] == 3) & (e == 4))
    start = F.struct(F.lit(0).alias("state"), F.lit(0).alias("refused"))
    go = lambda s, x: F.when(allowed(s, x["rank"]), F.struct(x["rank"].alias("state"), s["refused"].alias("refused"))).otherwise(F.struct(s["state"].alias("state"), (s["refused"] + 1).alias("refused")))
    out = steps.withColumn("s", F.aggregate("steps", start, go))
    name = F.element_at(F.array(*map(F.lit, ("none", "draft", "frozen", "paired", "invalidated"))), F.col("s.state") + 1)
    return out.select("participant", "attempt", name.alias("state"), F.col("s.refused").alias("refused"))


def progress(attempts: DataFrame) -> DataFrame:
    """Counts of each participant's attempts(participant, attempt_sequence, state, task_class, actual_usd, ...)."""
    state = F.col("state")
    is_ = lambda *names: F.count_if(state.isin(*names))
    missing = F.count_if((state == "frozen") | (state == "invalidated") & F.col("actual_usd").isNull())
    classes = F.count_distinct(F.when(state == "paired", F.col("task_class")))
    out = attempts.groupBy("participant").agg(is_("paired").alias("paired_usable_tasks"), classes.alias("distinct_task_classes"), is_("frozen", "paired", "invalidated").alias("forecasts_frozen"), is_("invalidated").alias("invalidated_attempts"), missing.alias("missing_actual_attempts"), is_("draft", "frozen").alias("open_attempts"))
    met = (F.col("paired_usable_tasks") == TARGET_TASKS) & (F.col("distinct_task_classes") >= LEAST_CLASSES)
    return out.withColumn("target_met", met)


def participant_rules() -> dict[str, Column]:
    """Rules of a participant, over one row with the numbers of their attempts."""
    return {
        "sequence_is_position": F.col("out_of_place") == 0,
        "attempt_limit": F.col("attempts") <= MOST_ATTEMPTS,
        "one_open_attempt": F.col("open") <= 1,
        "open_is_latest": (F.col("open") == 0) | (F.col("last_open") == F.col("attempts")),
        "usable_tasks_within_target": F.col("paired") <= TARGET_TASKS,
        "nothing_open_after_target": (F.col("paired") < TARGET_TASKS) | (F.col("open") == 0),
        "class_mix_possible": F.col("classes") + (TARGET_TASKS - F.col("paired")) >= LEAST_CLASSES,
    }


def attempt_violations(attempts: DataFrame) -> DataFrame:
    """participant, attempt_sequence (null for rules of the participant) and code of every broken rule."""
    single = violations(attempts, ["participant", "attempt_sequence"], attempt_rules())
    place = F.row_number().over(W.partitionBy("participant").orderBy("attempt_sequence"))
    is_open = F.col("state").isin("draft", "frozen")
    rows = attempts.withColumn("_place", place)
    whole = rows.groupBy("participant").agg(
        F.count_if(F.col("_place") != F.col("attempt_sequence")).alias("out_of_place"), F.count(F.lit(1)).alias("attempts"), F.count_if(is_open).alias("open"), F.max(F.when(is_open, F.col("_place"))).alias("last_open"),
        F.count_if(F.col("state") == "paired").alias("paired"), F.count_distinct(F.when(F.col("state") == "paired", F.col("task_class"))).alias("classes"),
    )
    many = violations(whole, ["participant"], participant_rules()).select("participant", F.lit(None).cast("long").alias("attempt_sequence"), "code")
    return single.select("participant", F.col("attempt_sequence").cast("long"), "code").unionByName(many)


def conformal_scale(rows: DataFrame) -> Column:
    """How far a band must be widened, in log steps of its upper half, for a row's cost to lie in it."""
    return float_ratio(F.abs(float_log(float_ratio(F.col("cost_usd"), F.col("p50")))), float_log(float_ratio(F.col("p90"), F.col("p50"))))


def scaled_band(scale: Column) -> list[Column]:
    """p10, p50 and p90 with both halves multiplied by a scale in log steps."""
    p50 = F.col("p50")
    moved = lambda c: (p50 * F.pow(float_ratio(F.col(c), p50), scale)).alias(c)
    return [moved("p10"), p50, moved("p90")]
