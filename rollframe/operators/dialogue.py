"""Dialogues as turns and tokens: turn numbers, target masks, turn-balanced weights, audits, padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def turns(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line 'speaker: words' of a dialogue: key, turn (from 1), speaker, words. Other lines are left out."""
    line = F.posexplode(F.split(text, "\n"))
    rows = docs.select(key, line.alias("line_no", "line"))
    rows = rows.select(key, "line_no", F.regexp_extract("line", r"^\s*([^:：\s]{1,20})\s*[:：]", 1).alias("speaker"), F.regexp_replace("line", r"^\s*[^:：\s]{1,20}\s*[:：]\s*", "").alias("words")).where("speaker <> ''")
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy("line_no")))


def tokens(c) -> Column:
    """Words, and single characters of Chinese text."""
    return F.regexp_extract_all(c, F.lit(r"(\p{IsHan}|[^\s\p{IsHan}]+)"), 1)


def target_turns(turned: DataFrame, key: str, targets: list[str]) -> DataFrame:
    """Adds is_target and target_no, the number of the target turn up to here."""
    t = F.col("speaker").isin(targets)
    return turned.withColumn("is_target", t).withColumn("target_no", F.sum(t.cast("int")).over(Window.partitionBy(key).orderBy("turn")))


def turn_weights(turned: DataFrame) -> DataFrame:
    """Adds tokens and weight: each token of a target turn weighs 1 / tokens of the turn, others 0; so turns weigh alike."""
    n = F.size(tokens("words"))
    return turned.withColumn("tokens", n).withColumn("weight", F.when(F.col("is_target") & (n > 0), 1 / n).otherwise(0.0))


def floor_percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Order statistics sorted[floor((n - 1) * share)], from counts per value: as many rows as there are distinct values,
    never a group's rows in one task. Nulls are left out."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    counts = counts.withColumns({"_upto": F.sum("_n").over(w.orderBy(value)), "_all": F.sum("_n").over(w)})
    at = lambda p: F.min(F.when(F.col("_upto") > F.floor((F.col("_all") - 1) * p), F.col(value)))
    return counts.groupBy(*keys).agg(F.sum("_n").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("mean"), *[at(p).alias(k) for k, p in shares.items()])


def longest(rows: DataFrame, size: str, key: str, n: int = 20) -> DataFrame:
    return rows.orderBy(F.col(size).desc(), key).limit(n)


def serialized(turned: DataFrame, key: str) -> DataFrame:
    """A dialogue as parallel arrays: token, mask (1 for tokens of target turns) and turn (number of the target turn from 0, -1
    for others), turns in order. A dialogue is one training sample, so its tokens meet in one row."""
    each = F.struct("turn", tokens("words").alias("t"), F.col("is_target").cast("int").alias("m"), F.when(F.col("is_target"), F.col("target_no") - 1).otherwise(-1).cast("int").alias("n"))
    rows = turned.groupBy(key).agg(F.array_sort(F.collect_list(each)).alias("_t"))
    spread = lambda field: F.flatten(F.transform("_t", lambda x: F.array_repeat(x[field], F.size(x["t"]))))
    return rows.select(key, F.flatten(F.transform("_t", lambda x: x["t"])).alias("token"), spread("m").alias("mask"), spread("n").alias("turn"))


def overlong(samples: DataFrame, array: str, most: int) -> DataFrame:
    """Samples of more than `most` tokens. They are not cut: what is cut off would be the targets at the end."""
    return samples.where(F.size(array) > most)


def turn_balanced(mask, turn) -> Column:
    """Weights of a sample's tokens: 1 / tokens of the turn for tokens of target turns, else 0."""
    mask, turn = F.col(mask), F.col(turn)
    own = F.zip_with(mask, turn, lambda m, t: F.when(m == 1, t))
    return F.transform(own, lambda t: F.when(t.isNotNull(), 1.0 / F.size(F.filter(own, lambda o: o == t))).otherwise(0.0))


#: Fixed value: the label of tokens that are no target.
NO_LABEL = -100


def collated(samples: DataFrame, batch: str, ids: str, mask: str, weights: str, pad: int) -> DataFrame:
    """Samples with labels (the id of a target token, else NO_LABEL) and attention, all arrays filled up to the longest sample
    of their batch. A sample without any target ends the query. The batch's length is joined back."""
    some = F.exists(F.col(mask), lambda m: m == 1)
    rows = samples.where(F.when(some, F.lit(True)).otherwise(F.raise_error(F.lit("a sample has no target token")).cast("boolean")))
    most = samples.groupBy(batch).agg(F.max(F.size(ids)).alias("_m"))
    fill = F.col("_m") - F.size(ids)
    longer = lambda c, value: F.concat(c, F.array_repeat(F.lit(value), fill))
    labels = F.zip_with(F.col(ids), F.col(mask), lambda i, m: F.when(m == 1, i).otherwise(F.lit(NO_LABEL).cast("long")))
    rows = rows.join(most, batch).withColumns({"labels": longer(labels, NO_LABEL), "attention": longer(F.transform(F.col(ids), lambda _: F.lit(1)), 0), ids: longer(F.col(ids), pad), weights: longer(F.col(weights), 0.0)})
    return rows.drop("_m")


def padded(rows: DataFrame, batch: str, array: str, pad: Column) -> DataFrame:
    """Arrays filled up with pad to the longest of their batch; the length is joined back, batches are not gathered."""
    most = rows.groupBy(batch).agg(F.max(F.size(array)).alias("_m"))
    return rows.join(most, batch).withColumn(array, F.concat(array, F.array_repeat(pad, F.col("_m") - F.size(array)))).drop("_m")


def shifted_loss(labels, weights, losses, eps: float = 1.1920929e-07) -> Column:
    """Weighted mean loss of a sample's arrays: the loss at a position is that of predicting the label at the next one, so
    labels and weights move one to the left; positions without label do not count. eps keeps the divisor from 0."""
    n = F.size(labels)
    at = F.arrays_zip(F.slice(labels, 2, F.greatest(n - 1, F.lit(0))).alias("y"), F.slice(weights, 2, F.greatest(n - 1, F.lit(0))).alias("w"), F.slice(losses, 1, F.greatest(n - 1, F.lit(0))).alias("l"))
    live = F.filter(at, lambda x: x["y"] != NO_LABEL)
    total = lambda f: F.aggregate(live, F.lit(0.0), lambda acc, x: acc + f(x))
    return total(lambda x: x["w"] * x["l"]) / F.greatest(total(lambda x: x["w"]), F.lit(eps))


def audit(samples: DataFrame, groups: list[str]) -> DataFrame:
    """Tokens of samples (token, mask and turn arrays) per groups and over all (is_total): count, mean, p50, p95, most; targets:
    mean and least; turns: mean; imbalance: mean over samples of the longest target turn / the shortest. Samples without a
    target turn have no imbalance. Percentiles come from counts per length, see floor_percentiles."""
    own = F.filter(F.zip_with("mask", "turn", lambda m, t: F.when(m == 1, t)), lambda t: t.isNotNull())
    sizes = F.transform(F.array_distinct(own), lambda t: F.size(F.filter(own, lambda o: o == t)))
    rows = samples.select(*groups, F.size("token").alias("n"), F.size(own).alias("targets"), F.size(sizes).alias("turns"), F.try_divide(F.array_max(sizes), F.array_min(sizes)).alias("imbalance"))

    def of(keys: list[str]) -> DataFrame:
        spread = floor_percentiles(rows, keys, "n", {"p50": 0.5, "p95": 0.95}).select(*keys, F.col("n").alias("count"), F.col("mean").alias("tokens_mean"), F.col("p50").alias("tokens_p50"), F.col("p95").alias("tokens_p95"), F.col("most").alias("tokens_most"))
        means = rows.groupBy(*keys).agg(F.avg("targets").alias("targets_mean"), F.min("targets").alias("targets_least"), F.avg("turns").alias("turns_mean"), F.avg("imbalance").alias("imbalance_mean"))
        if not keys:
            return spread.crossJoin(F.broadcast(means))  # one row each
        m = means.withColumnsRenamed({k: f"_{k}" for k in keys})
        on = None
        for k in keys:
            same = F.col(k).eqNullSafe(F.col(f"_{k}"))
            on = same if on is None else on & same
        return spread.join(m, on).drop(*[f"_{k}" for k in keys])

    return of(groups).withColumn("is_total", F.lit(False)).unionByName(of([]).withColumn("is_total", F.lit(True)), allowMissingColumns=True)
