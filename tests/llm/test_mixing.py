import random

import pytest
from pyspark.sql import functions as F

from rollframe.llm import mixing as x

SIZES = "doc_id long, source string, tokens long"


def test_sizes_and_spelling(spark):
    docs = spark.createDataFrame([(1, "hello world", "Policy Portal", 9), (2, "", "policy-portal ", 9), (3, None, None, 9), (4, "<|endoftext|>", "x", 9)], "doc_id long, text string, source string, tokens long")
    got = {r.doc_id: (r.source, r.tokens) for r in x.sized(docs).collect()}
    assert got[1] == ("policy_portal", 2) and got[2] == ("policy_portal", 0) and got[3] == (None, 0) and got[4][1] > 1
    assert x.sized(docs.unionByName(docs)).count() == 4


def planned(spark, sizes, targets, budget=None):
    return x.plan(spark.createDataFrame(sizes, SIZES), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), budget)


def test_plan(spark):
    sizes = [(1, "a", 60), (2, "b", 10), (3, None, 30)]
    p = planned(spark, sizes, [("A", 0.5, 1), ("b", 0.3, 2), ("none", 0.1, 9), ("zero", 0.0, 1), ("nulls", None, None)])
    assert {r.name: (r.wanted, r.supply) for r in p.collect()} == {"A": (50.0, 60), "b": (30.0, 20), "none": (10.0, 0), "zero": (0.0, 0), "nulls": (0.0, 0)}
    got = {r.source: (r.tokens, r.reachable) for r in x.shares(x.mixture(spark.createDataFrame(sizes, SIZES), p), p).collect()}
    assert got == {"A": (60, True), "b": (20, False), "none": (0, False), "zero": (0, True), "nulls": (0, True)}


def test_refill(spark):
    sizes = [(1, "a", 300), (2, "b", 10), (3, "c", 100)]
    p = x.plan(spark.createDataFrame(sizes, SIZES), spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 1)], "source string, target_share double, max_repeats int"), 200, True)
    got = {r.name: round(r.wanted, 6) for r in p.collect()}
    assert got["b"] == 20 and got["a"] == pytest.approx(100 + 40 * 5 / 7) and sum(got.values()) == pytest.approx(200)


def brute(sizes, targets, budget):
    """Pass after pass over a source's documents until enough is given or the repeats are over."""
    out = {}
    for name, share, most in targets:
        own = [t for _, s, t in sizes if s == name]
        given = 0
        for _ in range(most):
            for t in own:
                if given < share * budget:
                    given += t
        out[name] = given >= share * budget
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reachable_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    sizes = [(i, rnd.choice("aaaabcde"), rnd.randint(0, 40)) for i in range(300)]
    targets = [(s, rnd.choice([0.05, 0.1, 0.2, 0.4]), rnd.randint(0, 4)) for s in "abcdef"]
    p = planned(spark, sizes, targets)
    want = brute(sizes, targets, sum(t for *_, t in sizes))
    for schedule in (None, {"a": [0.0, 1.0, 3.0]}):
        rows = x.shares(x.mixture(spark.createDataFrame(sizes, SIZES), p, schedule), p).collect()
        assert {r.source: r.reachable for r in rows} == want
        assert all((0 < r.until < 1) == (not r.reachable and r.tokens > 0) for r in rows)


def test_supply_that_ends_early(spark):
    sizes = [(i, "s", 10) for i in range(50)]
    df, p = spark.createDataFrame(sizes, SIZES), planned(spark, sizes, [("s", 1.0, 1)], 1000)
    rows = x.mixture(df, p, {"s": [2.0, 0.0]}, stretch=False).collect()
    assert max(r.position for r in rows) < max(r.until for r in rows) == pytest.approx(1 - 0.5**0.5)  # half of a weight falling from 2 to 0
    assert max(r.position for r in x.mixture(df, p).collect()) > 0.98


def test_default_schedule_puts_short_documents_first(spark):
    sizes = [(i, "short", 5) for i in range(100)] + [(1000 + i, "long", 50) for i in range(100)]
    p = planned(spark, sizes, [("short", 0.05, 1), ("long", 0.9, 1)])
    rows = x.mixture(spark.createDataFrame(sizes, SIZES), p).collect()
    early = lambda s: sum(r.tokens for r in rows if r.source == s and r.position <= 0.5) / sum(r.tokens for r in rows if r.source == s)
    assert early("short") == pytest.approx(0.625, abs=0.02) and early("long") == pytest.approx(0.375, abs=0.02)


def test_mixture_reaches_shares_within_repeats(spark, monkeypatch):
    monkeypatch.setattr(x, "PART", 50)
    sizes = [(i, "hot", 10 + i % 7) for i in range(600)] + [(1000 + i, "small", 12) for i in range(10)]
    df = spark.createDataFrame(sizes, SIZES)
    p = planned(spark, sizes, [("hot", 0.5, 1), ("small", 0.3, 3)]).cache()
    rows = x.mixture(df, p, {"hot": [2.0, 0.0], "small": [0.0, 2.0]}).collect()
    want = {r.source: min(r.wanted, r.supply) for r in p.collect()}
    got = {}
    for r in rows:
        got.setdefault(r.source, []).append(r)
    for s, v in got.items():
        assert want[s] <= sum(r.tokens for r in v) < want[s] + 20
        assert len({(r.doc_id, r.copy_no) for r in v}) == len(v)
    assert max(r.copy_no for r in got["small"]) == 3 and max(r.copy_no for r in got["hot"]) == 1
    at = [r.position for r in rows]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    early = sum(r.tokens for r in got["hot"] if r.position <= 0.5) / sum(r.tokens for r in got["hot"])
    assert early == pytest.approx(0.75, abs=0.03)  # the integral of a weight that falls from 2 to 0
    late = sum(r.tokens for r in got["small"] if r.position > 0.5) / sum(r.tokens for r in got["small"])
    assert late == pytest.approx(0.75, abs=0.06)
    shares = {r.source: r.actual_share for r in x.shares(x.mixture(df, p), p).collect()}
    assert sum(shares.values()) == pytest.approx(1.0)


def test_empty(spark):
    p = planned(spark, [], [("a", 0.5, 2)])
    assert [(r.wanted, r.supply) for r in p.collect()] == [(0.0, 0)]
    df = spark.createDataFrame([], SIZES)
    assert x.mixture(df, p).collect() == []
    assert [r.actual_share for r in x.shares(x.mixture(df, p), p).collect()] == [0.0]
    assert planned(spark, [(1, "a", 5)], []).collect() == []
    assert df.agg(F.count("*")).first()[0] == 0
