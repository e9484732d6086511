"""Checks of data sets: coverage, duplicates, leakage between splits, diversity, paths, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollframe import runtime


def canonical_json(c) -> Column:
    """JSON with sorted keys and no white space, letters as they are; null where it is broken. Numbers are written in
    their shortest form, so that texts with decimals are equal by value, not by spelling."""
    return F.to_json(F.try_parse_json(c))


def fingerprint(c) -> Column:
    return F.sha2(canonical_json(c), 256)


def coverage(expected: DataFrame, actual: DataFrame, key: str, per_key: int) -> DataFrame:
    """(key, status, n): missing, unknown, wrong_count or empty_id, of every key that is not as expected."""
    e = expected.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_e", F.lit(True))
    a = actual.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = e.join(a, key, "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col(key).isNull(), "empty_id").when(F.col("_e").isNull(), "unknown").when(F.col("n") == 0, "missing").when(F.col("n") != per_key, "wrong_count")
    return both.select(key, status.alias("status"), "n").where(F.col("status").isNotNull())


def first_of_each(rows: DataFrame, status: str, key: str, n: int) -> DataFrame:
    """The first n keys of each status and how many there are: reports stay short, rows are ranked where they lie."""
    w = Window.partitionBy(status).orderBy(F.col(key).asc_nulls_first())
    top = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    total = rows.groupBy(status).agg(F.count(F.lit(1)).alias("total"))
    return total.join(top.groupBy(status).agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("first")), status)


def snapshot(rows: DataFrame, key: str, step: str) -> DataFrame:
    """One row: records, distinct ids, empty ids, steps."""
    return rows.agg(F.count(F.lit(1)).alias("records"), F.count_distinct(key).alias("ids"), F.count_if(F.col(key).isNull()).alias("empty_ids"), F.count_distinct(step).alias("steps"), F.min(step).alias("first_step"), F.max(step).alias("last_step"))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def crossing(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in more than one split."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(split).alias("splits"), F.min(split).alias("first_split"), F.max(split).alias("last_split")).where("splits > 1")


def diversity(rows: DataFrame, keys: list[str], parts: dict[str, Column]) -> DataFrame:
    """Rows, distinct values of each part and their rate, per keys and over all (grouping sets: distinct counts do not add up)."""
    rows = rows.select(*keys, *[F.coalesce(e, F.lit("")).alias(n) for n, e in parts.items()])
    g = rows.groupingSets([keys, []], *keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(n).alias(n) for n in parts], F.grouping(keys[0]).cast("boolean").alias("is_total"))
    return g.withColumns({f"{n}_rate": F.col(n) / F.col("n") for n in parts})


def label_conflicts(rows: DataFrame, derived: Column, expected: Column, groups: list[str]) -> DataFrame:
    """Rows and conflicts (what was derived is not what is expected, nulls compared as values) per value of each of groups
    and over all: (grouped_by, value, n, conflicts); grouped_by is null over all."""
    marked = rows.select(*groups, (~derived.eqNullSafe(expected)).alias("_bad"))
    g = marked.groupingSets([*[[x] for x in groups], []], *groups).agg(F.count(F.lit(1)).alias("n"), F.count_if("_bad").alias("conflicts"), *[F.grouping(x).alias(f"_{i}") for i, x in enumerate(groups)])
    by = F.coalesce(*[F.when(F.col(f"_{i}") == 0, F.lit(x)) for i, x in enumerate(groups)])
    value = F.coalesce(*[F.when(F.col(f"_{i}") == 0, F.col(x)) for i, x in enumerate(groups)])
    return g.select(by.alias("grouped_by"), value.alias("value"), "n", "conflicts")


def contradictions(rows: DataFrame, seen: list[str], label: Column) -> DataFrame:
    """What is the same in all of seen but has several labels: (seen as a 16-byte key in hex, n, labels)."""
    key = F.md5(F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in seen]))
    g = rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce(label, F.lit(""))).alias("labels"))
    return g.where("labels > 1")


def broken_paths(rows: DataFrame, path: str, last: Column) -> DataFrame:
    """Rows whose path is missing, empty, or does not end with `last`."""
    return rows.where(F.coalesce(F.size(path), F.lit(0)) < 1).unionByName(rows.where((F.size(path) > 0) & ~F.element_at(path, -1).eqNullSafe(last)))


def digest(rows: DataFrame, order: list[str], line: Column, part_rows: int = 100_000) -> DataFrame:
    """One row: rows, digest. SHA-256 over the SHA-256 of each part of lines, parts and lines in order.

    A part holds the lines of part_rows ranks in a row, so that parts depend on the data only and no task holds more than
    a part. A line's rank is its place in its range of a range sort and the number of lines in the ranges before; lines
    of one key are in the order of their own hashes. The sort is written, because the bounds of its ranges are sampled."""
    keys = [*order, "_h"]
    numbered = rows.select(*order, F.sha2(line, 256).alias("_h")).where(F.col("_h").isNotNull())
    parts = max(1, -(-numbered.count() // part_rows))
    at = F.monotonically_increasing_id()  # range in the upper bits, place in the range in the lower 33
    ranged = runtime.written(numbered.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", at), "ranged")
    ranged = ranged.select(*keys, F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = ranged.join(F.broadcast(starts), "_range").withColumn("_p", F.floor((F.col("_start") + F.col("_place")) / part_rows))
    each = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys))), lambda x: x["_h"]), "\n"), 256).alias("_d"))
    return each.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_d"))), lambda x: x["_d"]), "\n"), 256).alias("digest"))


def compare_by(left: Column, operator: Column, right: Column) -> Column:
    """A comparison whose operator is data. Both sides are JSON text. >= <= > < compare numbers and are false without
    both; == and != compare the JSON values, null with null; another operator is null."""
    a, b = F.try_variant_get(F.try_parse_json(left), "$", "double"), F.try_variant_get(F.try_parse_json(right), "$", "double")
    same = canonical_json(left).eqNullSafe(canonical_json(right))
    num = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(operator == ">=", num(a >= b)).when(operator == "<=", num(a <= b)).when(operator == ">", num(a > b)).when(operator == "<", num(a < b)).when(operator == "==", same).when(operator == "!=", ~same)
    )


def cache_split(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of requests against a keyed cache; the latest cache entry of a key counts."""
    latest = cache.groupBy(key).agg(F.max_by("payload", "stored_at").alias("payload"))
    return requests.join(latest, key), requests.join(latest.select(key), key, "left_anti")


def rubric(scores: dict[str, tuple[Column, float]], top: float = 4.0) -> Column:
    """Weighted mean of scores from 0 to top, as a share of top; null if any is missing or out of range."""
    ok = None
    total = F.lit(0.0)
    for c, weight in scores.values():
        fits = c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c <= top)
        ok = fits if ok is None else ok & fits
        total = total + c * weight
    return F.when(ok, F.round(total / top, 6))
