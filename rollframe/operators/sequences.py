"""Ordered event logs: first terminal, trailing, repeated and out-of-order events, a horizon, and a fold over episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def marked(events: DataFrame, episode: str, order: list[str], action: str, terminal: list[str], horizon: int | None = None) -> DataFrame:
    """Adds no (from 1), repeated (the action came before), done_before (after the first terminal event) and, with a
    horizon, beyond. Episodes are of bounded length by nature; each is ordered within one task."""
    w = Window.partitionBy(episode).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = F.col(action).isin(terminal).cast("int")
    rows = events.withColumns(
        {
            "no": F.row_number().over(w),
            "repeated": F.row_number().over(Window.partitionBy(episode, action).orderBy(*order)) > 1,
            "done_before": F.coalesce(F.max(last).over(before), F.lit(0)) > 0,
        }
    )
    return rows.withColumn("beyond", F.col("no") > horizon) if horizon else rows


def order_violations(events: DataFrame, episode: str, order: list[str], action: str, required: list[str]) -> DataFrame:
    """Events of `required` that come before each earlier one of the list has come."""
    before = Window.partitionBy(episode).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = [F.coalesce(F.max((F.col(action) == a).cast("int")).over(before), F.lit(0)) for a in required]
    rows = events.withColumn("_seen", F.array(*seen))
    bad = F.lit(False)
    for i, a in enumerate(required[1:], 1):
        bad = bad | ((F.col(action) == a) & F.exists(F.slice("_seen", 1, i), lambda s: s == 0))
    return rows.where(bad).drop("_seen")


def fold(events: DataFrame, episode: str, order: list[str], action: str, terminal: list[str], horizon: int) -> DataFrame:
    """One row per episode by a fold over its ordered actions: attempts, trailing, repeated, final.

    After the first terminal action or once `horizon` attempts are used, further actions are only counted as trailing;
    an episode cut by the horizon ends as 'cut', one that never ends as null. The same rule as the streaming operator."""
    acts = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(action).alias("_a")))), lambda x: x["_a"])
    per = events.groupBy(episode).agg(acts.alias("acts"))
    zero = F.struct(F.lit(0).alias("attempts"), F.lit(0).alias("trailing"), F.lit(0).alias("repeated"), F.lit(None).cast("string").alias("final"), F.array().cast("array<string>").alias("seen"))

    def step(s: Column, a: Column) -> Column:
        done = s["final"].isNotNull()
        cut = ~done & (s["attempts"] >= horizon)
        live = ~done & ~cut
        return F.struct(
            (s["attempts"] + live.cast("int")).alias("attempts"),
            (s["trailing"] + done.cast("int")).alias("trailing"),
            (s["repeated"] + (live & F.coalesce(F.array_contains(s["seen"], a), F.lit(False))).cast("int")).alias("repeated"),
            F.when(done, s["final"]).when(cut, F.lit("cut")).when(a.isin(terminal), a).alias("final"),
            F.when(live & a.isNotNull(), F.array_union(s["seen"], F.array(a))).otherwise(s["seen"]).alias("seen"),
        )

    out = per.select(episode, F.aggregate("acts", zero, step).alias("s"))
    return out.select(episode, "s.attempts", "s.trailing", "s.repeated", "s.final")


def latest(rows: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """The value of each key with the largest `at` (ties: the largest value), combined on the map side."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(F.col(at), F.col(value))).alias(value), F.max(at).alias(at))


def alias_series(series: DataFrame, names: DataFrame) -> DataFrame:
    """names: (metric, tag, priority). The first tag of each metric that has points: (metric, tag, points)."""
    points = series.where(F.col("value").isNotNull()).groupBy("tag").agg(F.count(F.lit(1)).alias("points"))
    have = names.join(points, "tag")
    return have.groupBy("metric").agg(F.min_by("tag", "priority").alias("tag"), F.min_by("points", "priority").alias("points"))
