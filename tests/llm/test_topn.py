import random

from pyspark.sql import functions as F

from rollframe.llm import topn

SCHEMA = "case_id string, score double, step long, id long, rank_no string"


def brute(rows, n):
    best = {}
    for case, score, step, i, _ in set(rows):
        if case is not None and score is not None and score == score:
            best.setdefault(case, []).append((-score, step is None, step or 0, i))
    return {(c, k + 1, r[3]) for c, v in best.items() for k, r in enumerate(sorted(v)[:n])}


def run(spark, rows, n=4):
    df = spark.createDataFrame(rows, SCHEMA)
    out = topn.top_n_per_group(df, "case_id", "score", n, [("step", True), ("id", True)], id_col="id")
    return {(r.case_id, r.rank_no, r.id) for r in out.collect()}


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 5 + ["a", "b", "c", None]), rnd.choice([None, float("nan"), float("inf"), -float("inf"), 1.0, 1.0, 0.25, rnd.random()]), rnd.choice([None, 1, 2]), i, "x") for i in range(600)]
    rows += rows[:50]
    assert run(spark, rows) == brute(rows, 4)


def test_all_scores_equal_in_one_hot_group(spark):
    rows = [("hot", 1.0, 5, i, None) for i in range(500)]
    assert run(spark, rows) == {("hot", k + 1, k) for k in range(4)}


def test_few_slots_give_the_same(spark, monkeypatch):
    rows = [(f"c{i % 7}", float(i % 13) * 10 ** (i % 5), i % 3, i, None) for i in range(900)]
    want = run(spark, rows)
    monkeypatch.setattr(topn, "SLOTS", 2)
    assert run(spark, rows) == want == brute(rows, 4)


def test_far_values_and_repeats(spark):
    rows = [("a", 1e300, 1, 0, None), ("a", -1e300, 1, 1, None)] + [("a", i / 1000, 1, i + 2, None) for i in range(900)]
    rows += [("a", 0.9999, 1, 5000, None)] * 300 + [("a", 0.0, 1, 6000, None), ("b", -0.0, 1, 1, None), ("b", -1e-310, 2, 2, None)]
    assert run(spark, rows, 3) == brute(rows, 3)
    assert run(spark, rows, 100) == brute(rows, 100)


def test_bins_keep_the_order(spark):
    values = sorted([0.0, -0.0, 5e-324, 1e-310, 0.1, 0.5, 0.9999999999999999, 1.0, 1.0000000000000002, 3.0, 4.0, 1e300, float("inf")] + [2.0**k for k in range(-1074, 1024, 7)] + [2.0**k * (1 - 2**-53) for k in range(-1000, 1024, 9)])
    values = [-v for v in reversed(values)] + values
    got = [r.b for r in spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", topn._bin(F.col("v")).alias("b")).orderBy("i").collect()]
    assert got == sorted(got)


def test_empty(spark):
    assert run(spark, []) == set()
    assert run(spark, [(None, 1.0, 1, 1, None), ("a", None, 1, 2, None)]) == set()
