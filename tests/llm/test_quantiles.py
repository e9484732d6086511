import bisect
import random

import numpy as np
from pyspark.sql import functions as F

from rollframe.llm import quantiles as q


def rank_error(values, got, share):
    s = sorted(values)
    low, high = bisect.bisect_left(s, got) + 1, bisect.bisect_right(s, got)
    want = max(1, int(np.ceil(share * len(s) - 1e-9)))
    return max(0, low - want, want - high)


def test_small_groups_are_exact(spark):
    rows = [("a", float(i)) for i in range(1, 11)] + [("b", 3.0)] * 5 + [(None, 1.0), ("a", None), ("c", float("nan"))]
    got = {r.g: (r.n, r.p25, r.p50, r.p75) for r in q.percentiles(q.sketch(spark.createDataFrame(rows, "g string, v double"), ["g"], "v"), {"p25": 0.25, "p50": 0.5, "p75": 0.75}).collect()}
    assert got == {"a": (10, 3.0, 5.0, 8.0), "b": (5, 3.0, 3.0, 3.0), None: (1, 1.0, 1.0, 1.0)}


def test_error_stays_below_its_bound():
    rnd = random.Random(1)
    values = [rnd.choice([rnd.random(), 0.5, rnd.gauss(0, 1)]) for _ in range(60_000)]
    parts = []
    for at in range(0, len(values), 7_001):
        s = q.Sketch()
        s.add(np.array(values[at : at + 7_001]))
        parts.append(s.state())
    whole = q.Sketch()
    for p in parts:
        whole.merge(*p)
    n, error, weights, sizes, items = whole.state()
    assert n == len(values) == sum(w * k for w, k in zip(weights, sizes))
    assert error <= 0.01 * n
    for share in (0.01, 0.25, 0.5, 0.75, 0.99):
        assert rank_error(values, q.values_at(weights, sizes, items, n, [share])[0], share) <= error + max(weights)


def test_merged_days_equal_the_whole_within_the_bound(spark):
    df = spark.range(30_000).select((F.col("id") % 3).alias("day"), F.lit("hot").alias("g"), (F.hash("id") % 1000).cast("double").alias("v"))
    days = [q.sketch(df.where(F.col("day") == d), ["g"], "v") for d in range(3)]
    both = days[0].unionByName(days[1]).unionByName(days[2])
    r = q.percentiles(q.merge(both, ["g"]), {"p50": 0.5}).first()
    values = [x.v for x in df.select("v").collect()]
    assert r.n == 30_000
    assert rank_error(values, r.p50, 0.5) <= r.error + 64


def test_layout_makes_no_difference_and_the_bound_holds(spark, monkeypatch):
    """Several parts and levels, a value that a third of the rows have, other numbers of tasks: the same sketch, and ranks
    within the bound that it states."""
    monkeypatch.setattr(q, "PART_VALUES", 4000)
    monkeypatch.setattr(q, "FAN", 4)
    df = spark.range(240_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 5).cast("string"))).alias("g"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.xxhash64("id") / 2.0**63).alias("v"))
    shares = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}
    got = [{r.g: r for r in q.percentiles(q.sketch(x, ["g"], "v"), shares).collect()} for x in (df.repartition(1), df.repartition(7, "v"), df.orderBy("v").coalesce(3))]
    assert got[0] == got[1] == got[2]
    values = {}
    for r in df.collect():
        values.setdefault(r.g, []).append(r.v)
    for g, r in got[0].items():
        assert r.n == len(values[g]) and r.error < 0.05 * r.n
        for name, share in shares.items():
            assert rank_error(values[g], r[name], share) <= r.error + 2 * r.n // q.K + 1


def test_many_sketches_of_one_group(spark, monkeypatch):
    monkeypatch.setattr(q, "FAN", 4)
    df = spark.range(5000).select((F.col("id") % 100).alias("run"), F.lit("s").alias("s"), (F.col("id") * 7919 % 5000).cast("double").alias("v"))
    runs = q.sketch(df, ["run"], "v").withColumn("s", F.lit("s"))
    one = q.percentiles(q.merge(runs, ["s"]), {"p50": 0.5}).collect()
    two = q.percentiles(q.merge(runs.repartition(5, "n"), ["s"]), {"p50": 0.5}).collect()
    assert one == two and one[0].n == 5000 and abs(one[0].p50 - 2499) <= one[0].error + 8


def test_values_many_times(spark):
    s, t = q.Sketch(), q.Sketch()
    s.add(np.array([1.0, 2.0, 3.0]), np.array([5000, 1, 70_000]))
    t.add(np.repeat([1.0, 2.0, 3.0], [5000, 1, 70_000]))
    for x in (s, t):
        n, _, weights, sizes, items = x.state()
        assert n == 75_001 == sum(w * k for w, k in zip(weights, sizes))
        assert q.values_at(weights, sizes, items, n, [0.01, 0.5]) == [1.0, 3.0]


def test_merge_may_open_levels(spark):
    s = q.Sketch()
    s.merge(2048, 0, [2], [1024], np.arange(1024.0))
    assert s.state()[0] == 2048


def test_empty(spark):
    assert q.sketch(spark.createDataFrame([], "g string, v double"), ["g"], "v").collect() == []
