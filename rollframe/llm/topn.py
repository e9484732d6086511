"""Top N rows within every group, by a histogram threshold and an exact rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollframe import runtime

#: Bins of a doubling of the score. More bins: fewer rows above the threshold bin, a larger histogram.
FINE = 16
#: Slots of the threshold table, which is what is broadcast: its size does not depend on the number of groups.
SLOTS = 1 << 17


def _bin(score: Column) -> Column:
    """Order-preserving bin of a score of any size: a larger score never gets a smaller bin.

    FINE bins for each doubling, so that neither a far value nor the range of the scores matters."""
    size = F.abs(score)
    power = F.floor(F.log2(size))
    at = (power + 1100) * FINE + F.floor((size / F.pow(F.lit(2.0), power) - 1) * FINE)
    at = F.when(size == 0, 0).when(size == F.lit(float("inf")), 1 << 20).otherwise(F.coalesce(at, F.lit(0)))
    return (F.when(score < 0, -at).otherwise(at)).cast("int")


def top_n_per_group(df: DataFrame, group: str, score: str, n: int, ties: list[tuple[str, bool]], id_col: str | None = None) -> DataFrame:
    """The n rows of each group with the largest score, as (group, rank_no, score, tie columns).

    ties: (column, ascending) in order; the last one should be unique, else rows equal in all keys get an
    arbitrary order among themselves, though always n of them.
    id_col: rows that repeat an id and the other used columns count once; it must be the last tie key.

    1. A histogram of scores per group gives the lowest bin with at least n rows at or above it. It is taken from the rows
       as they are; repeated rows are seen through by a map of n bits or more in each bin, which never counts too many.
    2. Rows below that bin are dropped where they are read, before anything else is shuffled. Groups share SLOTS slots by
       hash, and a slot has the lowest threshold of its groups: safe for all of them, and of a fixed size to broadcast.
    3. The rest is ranked exactly with the tie keys. Spark limits each group to n ranks on the map side before the
       shuffle, so a group that holds a third of all rows, or any number of equal scores, never meets in one task.

    Null groups, null and NaN scores are left out; infinite scores rank at the ends. An empty input gives an empty
    result. Null tie keys come last. Other columns of df are not read.
    """
    cols = list(dict.fromkeys([group, score, *[c for c, _ in ties], *([id_col] if id_col else [])]))
    if id_col and (not ties or ties[-1][0] != id_col):
        raise ValueError("id_col must be the last tie key")
    rows = df.select(*cols).where(F.col(group).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score)))
    rows = rows.withColumns({"_bin": _bin(F.col(score)), "_slot": F.pmod(F.xxhash64(group), F.lit(SLOTS)).cast("int")})

    if id_col:
        words = -(-n // 32)
        place = F.pmod(F.xxhash64(id_col), F.lit(64 * words))
        bit = lambda w: F.when(F.floor(place / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long"))
        histogram = rows.groupBy(group, "_slot", "_bin").agg(*[F.bit_or(bit(w)).alias(f"_w{w}") for w in range(words)])
        counted = sum((F.bit_count(f"_w{w}") for w in range(words)), F.lit(0))
    else:
        histogram = rows.groupBy(group, "_slot", "_bin").agg(F.count(F.lit(1)).alias("_n"))
        counted = F.col("_n")
    above = Window.partitionBy(group, "_slot").orderBy(F.col("_bin").desc())
    # as many rows of a group meet here as it has bins, however many rows it has
    reached = histogram.withColumn("_above", F.sum(counted).over(above))
    least = reached.groupBy(group, "_slot").agg(F.coalesce(F.max(F.when(F.col("_above") >= n, F.col("_bin"))), F.min("_bin")).alias("_least"))
    slots = runtime.cut(least.groupBy("_slot").agg(F.min("_least").alias("_least")))
    kept = rows.join(F.broadcast(slots), "_slot").where(F.col("_bin") >= F.col("_least"))  # at most SLOTS narrow rows

    order = [F.col(score).desc(), *[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in ties]]
    # repeats of a row are equal in all keys and share a dense rank
    rank = (F.dense_rank if id_col else F.row_number)().over(Window.partitionBy(group).orderBy(*order))
    ranked = kept.select(*cols).withColumn("rank_no", rank).where(F.col("rank_no") <= n)
    return ranked.distinct() if id_col else ranked
