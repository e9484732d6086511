"""Percentiles per group by deterministic buffer collapsing; the sketches of partitions, runs or days can be merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollframe import runtime

#: Values in a buffer. A group of n values has at most h = log2(n / K) + 1 levels and a rank error of about n h / (2 K).
K = 1024
#: Different values of all groups for which there is one part more.
PART_VALUES = 1_000_000
#: Sketches of a group that are merged at once, about.
FAN = 32

FIELDS = "n long, error long, weights array<long>, sizes array<int>, items array<double>"


class Sketch:
    """Sorted buffers of at most K values; each value of a level-i buffer stands for 2**i values.

    Two full buffers of one level collapse into one of the next: their merged order is thinned to every second
    position, first the odd then the even ones in turn. A collapse of weight-w buffers moves no rank by more than w;
    `error` adds these up and so bounds the error of any rank the sketch gives."""

    __slots__ = ("n", "error", "fill", "filled", "full", "turn")

    def __init__(self) -> None:
        self.n = self.error = self.filled = self.turn = 0
        self.fill: list[np.ndarray] = []
        self.full: list[np.ndarray | None] = []

    def add(self, values: np.ndarray, times: np.ndarray | None = None) -> None:
        """Values, each once or as many times as said: full buffers of one value are laid down at their weight at once."""
        if times is None or (times == 1).all():
            self.n += len(values)
            self._fill(values)
            return
        self.n += int(times.sum())
        for v, t in zip(values[times >= K].tolist(), times[times >= K].tolist()):
            whole = t // K
            for level in range(whole.bit_length()):
                if whole >> level & 1:
                    self._push(np.full(K, v), level)
        self._fill(np.repeat(values, times % K))

    def _fill(self, values: np.ndarray) -> None:
        self.fill.append(values)
        self.filled += len(values)
        if self.filled >= K:
            pool = np.concatenate(self.fill)
            whole = len(pool) // K * K
            for at in range(0, whole, K):
                self._push(np.sort(pool[at : at + K]), 0)
            self.fill, self.filled = [pool[whole:]], len(pool) - whole

    def _push(self, buffer: np.ndarray, level: int) -> None:
        while True:
            while level >= len(self.full):
                self.full.append(None)
            other = self.full[level]
            if other is None:
                self.full[level] = buffer
                return
            self.full[level] = None
            merged = np.sort(np.concatenate([other, buffer]), kind="stable")
            buffer = merged[self.turn :: 2]
            self.turn ^= 1
            self.error += 1 << level
            level += 1

    def merge(self, n: int, error: int, weights, sizes, items) -> None:
        self.n += int(n)
        self.error += int(error)
        at = 0
        for weight, size in zip(weights, sizes):
            part = np.asarray(items[at : at + size], dtype=np.float64)
            at += size
            if weight == 1 and size < K:
                self._fill(part)
            else:
                self._push(part, int(weight).bit_length() - 1)

    def state(self) -> tuple:
        parts = [(1, np.concatenate(self.fill))] if self.filled else []
        parts += [(1 << i, b) for i, b in enumerate(self.full) if b is not None]
        items = np.concatenate([p for _, p in parts]) if parts else np.empty(0)
        return self.n, self.error, [w for w, _ in parts], [len(p) for _, p in parts], items


def values_at(weights, sizes, items, n: int, shares: list[float]) -> list[float]:
    """The smallest stored value whose weight at or below reaches share * n, for each share."""
    items = np.asarray(items, dtype=np.float64)
    order = np.argsort(items, kind="stable")
    reach = np.cumsum(np.repeat(np.asarray(weights, dtype=np.int64), np.asarray(sizes, dtype=np.int64))[order])
    ranks = [max(1, int(np.ceil(p * n - 1e-9))) for p in shares]
    return [float(items[order[min(int(np.searchsorted(reach, r)), len(items) - 1)]]) for r in ranks]


def sketch(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """One sketch row per group: the group columns, n, error and the buffers.

    Nulls and NaN are no values; a null in a group column makes a group of its own; groups without a value are
    missing; an empty input gives no row. Infinite values are ordered as usual. Other columns of df are not read.

    Values are counted first, on the map side, so that a value that a third of all rows have is one row a task. Then each
    group's values are parted by their hashes, into as many parts as the data ask for, and every part is read in order:
    how the rows lay in files and tasks makes no difference to the result, and no group meets in one task."""
    v = F.col(value).cast("double")
    rows = df.select(*groups, (v + 0.0).alias("_value")).where(F.col("_value").isNotNull() & ~F.isnan("_value"))
    names = list(groups)
    counted = runtime.written(rows.groupBy(*groups, "_value").agg(F.count(F.lit(1)).alias("_times")), "values")
    parts = max(1, -(-counted.count() // PART_VALUES))
    keyed = counted.withColumn("_part", F.pmod(F.xxhash64("_value"), F.lit(parts)).cast("int"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*groups).schema) + ", _part int, " + FIELDS
    columns = [*names, "_part", "n", "error", "weights", "sizes", "items"]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, Sketch()
        for batch in batches:
            out = []
            at = np.flatnonzero((batch[[*names, "_part"]].ne(batch[[*names, "_part"]].shift()) & ~(batch[[*names, "_part"]].isna() & batch[[*names, "_part"]].shift().isna())).any(axis=1).to_numpy() | (np.arange(len(batch)) == 0))
            values, times = batch["_value"].to_numpy(), batch["_times"].to_numpy()
            for a, b in zip(at, [*at[1:], len(batch)]):
                key = tuple(None if x is None or x != x else x for x in batch[[*names, "_part"]].iloc[a])
                if key != now:
                    if now is not None:
                        out.append((*now, *held.state()))
                    now, held = key, Sketch()
                held.add(values[a:b], times[a:b])
            yield pd.DataFrame(out, columns=columns)
        if now is not None:
            yield pd.DataFrame([(*now, *held.state())], columns=columns)

    key = [*groups, "_part"]
    mix = F.xxhash64("_value", F.lit(3))  # not by size: a buffer should hold values from all over
    sketches = keyed.repartition(*key).withColumn("_mix", mix).sortWithinPartitions(*key, "_mix", "_value").select(*key, "_value", "_times").mapInPandas(partial, schema)
    return _tree(sketches, groups, parts) if parts > 1 else sketches.drop("_part")


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches with the same group columns become one. Works on sketches of other runs, days or partitions alike,
    and on coarser groups than those the sketches were made for. Merged level by level, about FAN at once, so that no task
    reads more than that of a hot group; which go together depends on what they hold, not on where they lie."""
    fields = ["n", "error", "weights", "sizes", "items"]
    own = sketches.select(*groups, *fields)
    most = own.groupBy(*groups).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("c")).first().c or 1
    return _tree(own.withColumn("_part", F.pmod(F.xxhash64(*fields), F.lit(1 << 30)).cast("int")), groups, most)


def _tree(sketches: DataFrame, groups: list[str], most: int) -> DataFrame:
    """most: the largest number of sketches of a group."""
    while most > FAN:
        most = -(-2 * most // FAN)
        sketches = _merge(sketches.withColumn("_part", F.pmod(F.xxhash64("_part", F.lit(most)), F.lit(most)).cast("int")), [*groups, "_part"])
    return _merge(sketches.drop("_part"), groups)


def _merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sketches.select(*groups).schema) + ", " + FIELDS

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        total = Sketch()
        part = part.assign(_i=[i.tobytes() for i in part["items"].map(np.asarray)]).sort_values(["n", "error", "_i"], ascending=[False, True, True], kind="stable")
        for row in part.itertuples():
            total.merge(row.n, row.error, row.weights, row.sizes, row.items)
        return pd.DataFrame([(*key, *total.state())], columns=[*groups, "n", "error", "weights", "sizes", "items"])

    return sketches.groupBy(*groups).applyInPandas(one, schema)


def percentiles(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Adds a column for each share (name -> share in (0, 1]); keeps n and error, the bound on the rank error in rows."""
    at = list(shares.values())
    keep = [c for c in sketches.columns if c not in ("weights", "sizes", "items")]

    @F.pandas_udf("array<double>")
    def look_up(n: pd.Series, weights: pd.Series, sizes: pd.Series, items: pd.Series) -> pd.Series:
        return pd.Series([values_at(w, s, i, m, at) for m, w, s, i in zip(n, weights, sizes, items)])

    found = sketches.withColumn("_at", look_up("n", "weights", "sizes", "items"))
    return found.select(*keep, *[F.col("_at")[i].alias(name) for i, name in enumerate(shares)])
