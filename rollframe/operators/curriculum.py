"""Stratified oversampling: multipliers from scores, allocation by largest remainder, repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: The metrics that a scenario's score is taken from, first come first.
PRIORITY = ("process_pass_at_1", "process_pass_at_k", "process_success_at_k", "safe_pass_at_1", "safe_pass_at_k", "safe_success_at_k", "pass_at_k", "pass_at_1")


def first_metric(rows: DataFrame, priority: tuple[str, ...] = PRIORITY) -> DataFrame:
    """Adds score, the first metric of priority that has a value, clamped to [0, 1], and source, its name; both null where
    none has. Metrics that rows lacks as columns count as missing."""
    have = [m for m in priority if m in rows.columns]
    score = F.coalesce(*[F.col(m) for m in have], F.lit(None).cast("double"))
    source = F.coalesce(*[F.when(F.col(m).isNotNull(), m) for m in have], F.lit(None).cast("string"))
    return rows.withColumns({"score": F.when(score.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))), "source": source})


def with_scores(strata: DataFrame, scores: DataFrame, stratum: str) -> DataFrame:
    """Strata with their score. One that has none ends the query with its name: it would silently count as the worst."""
    rows = strata.join(scores.select(stratum, "score", "source"), stratum, "left")
    told = F.when(F.col("score").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no score for "), F.coalesce(F.col(stratum).cast("string"), F.lit("null")))).cast("boolean"))
    return rows.where(told)


def only_split(rows: DataFrame, split: str, wanted: str = "train") -> DataFrame:
    """rows, of which any of another split ends the query."""
    ok = F.coalesce(F.col(split) == wanted, F.lit(False))
    return rows.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"only {wanted} rows are allowed, found "), F.coalesce(F.col(split), F.lit("null")))).cast("boolean")))


def multipliers(strata: DataFrame, score: Column, target: float = 0.8, alpha: float = 2.0, most: float = 3.0) -> DataFrame:
    """Adds score (clamped to [0, 1]; null counts as 0) and multiplier = min(most, 1 + alpha * max(0, target - score))."""
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(score, F.lit(0.0))))
    return strata.withColumn("score", s).withColumn("multiplier", F.least(F.lit(most), 1 + alpha * F.greatest(F.lit(0.0), target - F.col("score"))))


def allocate(strata: DataFrame, stratum: str, size: str, expansion: float) -> DataFrame:
    """Adds extra: floor(rows * (expansion - 1)) more rows, shared by size * (multiplier - 1), rounded by largest
    remainder (ties: larger share, then larger name). One row per stratum, so the windows are small."""
    whole = Window.partitionBy()
    need = F.col(size) * (F.col("multiplier") - 1)
    rows = strata.withColumns({"_need": need, "_budget": F.floor(F.sum(size).over(whole) * (expansion - 1))})
    rows = rows.withColumn("_all", F.sum("_need").over(whole))
    rows = rows.withColumn("_share", F.when(F.col("_all") > 0, F.round(F.col("_budget") * F.col("_need") / F.col("_all"), 9)).otherwise(0.0))
    rows = rows.withColumns({"_floor": F.floor("_share"), "_rest": F.round(F.col("_share") - F.floor("_share"), 9)})
    rows = rows.withColumn("_left", F.when(F.col("_all") > 0, F.col("_budget") - F.sum("_floor").over(whole)).otherwise(0))
    rank = F.row_number().over(Window.orderBy(F.col("_rest").desc(), F.col("_share").desc(), F.col(stratum).desc()))
    rows = rows.withColumn("extra", (F.col("_floor") + F.when(rank <= F.col("_left"), 1).otherwise(0)).cast("long"))
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def expand(rows: DataFrame, allocated: DataFrame, stratum: str, order: str, parts: int = 64) -> DataFrame:
    """All rows once (repeat_index 0) and `extra` more per stratum, in the order given, again and again.

    The rank within a stratum comes from counts per part of the order key's hash and a rank within the part, so that a
    stratum with a third of all rows is spread over `parts` tasks; the order is that of (part, hash, key)."""
    base = rows.withColumns({"_part": F.pmod(F.xxhash64(F.col(order), F.lit(5)), F.lit(parts)).cast("int"), "_mix": F.xxhash64(order)})
    n = base.groupBy(stratum, "_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(stratum)
    n = n.withColumns({"_before": F.sum("_n").over(w.orderBy("_part")) - F.col("_n"), "_pool": F.sum("_n").over(w)}).drop("_n")
    ranked = base.join(n, [stratum, "_part"]).withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy(stratum, "_part").orderBy("_mix", order)) - 1)
    extra = ranked.join(F.broadcast(allocated.select(stratum, "extra")), stratum)  # one row per stratum
    times = F.floor((F.col("extra") - F.col("_i") + F.col("_pool") - 1) / F.col("_pool"))
    more = extra.withColumn("_t", times.cast("int")).where(F.col("_t") > 0).withColumn("repeat_index", F.explode(F.sequence(F.lit(1), F.col("_t"))))
    cols = rows.columns
    return rows.withColumn("repeat_index", F.lit(0)).unionByName(more.select(*cols, "repeat_index"))
