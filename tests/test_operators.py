import hashlib
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rollframe import runtime
from rollframe.functions import text
from rollframe.operators import compare as c
from rollframe.operators import curriculum as cu
from rollframe.operators import dialogue as dl
from rollframe.operators import metrics as m
from rollframe.operators import quality as q
from rollframe.operators import sequences as sq
from rollframe.sources import files
from rollframe.streaming import episodes as ep

ROLLOUT = "rollout_id long, case_id string, scenario_type string, environment_reward double, final_action_correct double, hard_gate double, process_compliant double, required_tool_rate double, output string"


def rollouts(spark, rows):
    return m.once(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ROLLOUT), {"output_hash": m.output_hash()})


def test_two_level_success(spark):
    rows = [("a", "S", 0.5, 1.0, 0.0, 1.0, None, "x  y"), ("A ", "s ", 0.5, 0.0, 0.0, None, None, " x y"), ("b", "s", 0.0, 1.0, 1.0, 1.0, None, "p"), ("b", "s", 1.0, 1.0, 0.0, None, 0.5, "q"), (None, "s", 1.0, 1.0, 0.0, 1.0, 1.0, "q")]
    r = m.evaluation(rollouts(spark, rows), ["scenario"]).first()
    assert (r.case_count, r.row_count, r.pass_at_1, r.pass_at_k, r.safe_pass_at_1, r.process_pass_at_1, r.process_pass_at_k) == (2, 4, 0.75, 1.0, 0.5, 0.25, 0.5)
    assert (r.group_reward_std, r.informative_group_rate, r.informative_trajectories) == (0.25, 0.5, 2)
    d = m.output_diversity(rollouts(spark, rows), []).first()
    assert (d.unique_output_rate, d.identical_group_rate) == (0.75, 0.5)


def test_length_bias(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (2, 2, 0.0), (3, 3, 1.0), (4, 4, 1.0), (5, None, 1.0), (6, 3, None)], "id int, n int, v double")
    r = m.length_bias(df, [], F.col("n"), "v", "id").first()
    assert (r.mean_length, r.shortest_quarter, r.longest_quarter) == (2.5, 0.0, 1.0) and r.length_correlation > 0.8
    flat = m.length_bias(df.withColumn("v", F.lit(1.0)), [], F.col("n"), "v", "id").first()
    assert flat.length_correlation == 0.0


def test_length_bias_ties_follow_the_tie_column(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.randint(1, 3), float(rnd.randint(0, 9))) for i in range(41)]
    r = m.length_bias(spark.createDataFrame(rows, "id int, n int, v double"), [], F.col("n"), "v", "id").first()
    s = sorted(rows, key=lambda x: (x[1], x[0]))
    assert r.shortest_quarter == pytest.approx(sum(x[2] for x in s[:10]) / 10) and r.longest_quarter == pytest.approx(sum(x[2] for x in s[-10:]) / 10)


def test_calls(spark):
    call = lambda o: f"<tool_call>{o if isinstance(o, str) else json.dumps(o)}</tool_call>"
    text_ = call({"name": "government_service", "arguments": {"action": "submit"}}) + call({"name": "other", "arguments": json.dumps({"action": "X"})}) + call({"function": {"name": "government_service", "arguments": {}}}) + call("{") + "<tool_call>"
    rows = spark.createDataFrame([(1, "a", "s", 1.0, 1.0, 0.0, 1.0, None, text_), (2, "a", "s", 1.0, 1.0, 0.0, 1.0, None, None)], ROLLOUT)
    got = [(r.action, r.malformed, r.wrong_name) for r in m.calls(rows.unionByName(rows), ["rollout_id"], "government_service").orderBy("call_no").collect()]
    # what is no JSON names no tool: it is malformed, not of a wrong name
    assert got == [("SUBMIT", False, False), ("X", False, True), (None, True, False), (None, True, False)]


def test_bare_calls_count_only_without_blocks(spark):
    bare = 'I will {call} now: {"name": "t", "arguments": {"action": "submit", "note": "a } b { c"}} and {"function": {"name": "u", "arguments": "{\\"action\\": \\"x\\"}"}} then {"no": 1} {"name": "t", "arguments": "{"} {"name": "t"'
    block = '<tool_call>{"name": "t", "arguments": {"action": "refuse"}}</tool_call>'
    df = spark.createDataFrame([(1, bare), (2, bare + block), (3, None), (4, ""), (5, "{" * 20_000 + "}" * 20_000)], "id int, output string")
    got = {r.id: [(x.action, x.malformed, x.wrong_name) for x in r.acts] for r in df.select("id", m.actions(F.col("output"), "t").alias("acts")).collect()}
    # an inner object that looks like a call counts as well: that of function
    assert got == {1: [("SUBMIT", False, False), ("X", False, True), ("X", False, True), (None, True, False)], 2: [("REFUSE", False, False)], 3: [], 4: [], 5: []}


def test_wilson_and_t(spark):
    df = spark.createDataFrame([(2, 8), (0, 0), (8, 8)], "s int, n int").select(c.wilson_low(F.col("s"), F.col("n")).alias("w"))
    w = [r.w for r in df.collect()]
    assert w[0] == pytest.approx(0.0715, abs=1e-3) and w[1] == 0.0 and w[2] == pytest.approx(0.6756, abs=1e-3)
    t = [r.t for r in spark.createDataFrame([(k,) for k in (1, 20, 22, 25, 27, 30, 31)], "k int").select(c.t_quantile(F.col("k")).alias("t")).collect()]
    assert t == pytest.approx([12.706, 2.086, 2.0756, 2.06, 2.06, 2.042, 1.96])


def test_over_seeds(spark):
    shape = "metric string, seed int, baseline double, candidate double, delta double, higher_is_better boolean"
    rows = [("m", s, 0.5, 0.6, 0.1, True) for s in (42, 43, 44)] + [("n", 42, 0.0, 0.1, 0.1, True)] + [("down", s, 1.0, 1 - d, -d, False) for s, d in ((42, 0.1), (43, 0.2), (44, -0.3))]
    got = {r.metric: r for r in c.over_seeds(spark.createDataFrame(rows, shape), ["metric"], 3).collect()}
    assert set(got) == {"m", "down"}
    assert got["m"].delta_mean == pytest.approx(0.1) and got["m"].delta_std == pytest.approx(0) and (got["m"].desired_sign_rate, got["m"].verdict) == (1.0, "improved")
    assert got["down"].desired_sign_rate == pytest.approx(2 / 3) and got["down"].verdict == "inconclusive" and got["down"].seed_deltas == "42=-0.100000 43=-0.200000 44=0.300000"
    one = c.over_seeds(spark.createDataFrame(rows[:1], shape), ["metric"], 1).first()
    assert one.delta_std == 0 and one.ci_low == -float("inf") and one.verdict == "inconclusive"
    with pytest.raises(Exception, match="disagree"):
        c.over_seeds(spark.createDataFrame([*rows[:2], ("m", 44, 0.5, 0.6, 0.1, False)], shape), ["metric"], 3).collect()


def test_bootstrap(spark):
    rnd = random.Random(6)
    rows = [(f"c{i}", 0.3, rnd.gauss(1, 2), None if i else 1.0, None) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, same double, wide double, one double, none double")
    names = ["same", "wide", "one", "none"]
    got = {r.metric: r for r in c.bootstrap(df, [], "k", names).collect()}
    assert (got["same"].ci_low, got["same"].ci_high, got["same"].pairs) == (pytest.approx(0.3), pytest.approx(0.3), 400)
    assert (got["one"].ci_low, got["one"].ci_high, got["one"].pairs) == (None, None, 1) and "none" not in got
    w = [r[2] for r in rows]
    mean = sum(w) / 400
    margin = 1.96 * (sum((x - mean) ** 2 for x in w) / 400) ** 0.5 / 20
    assert got["wide"].ci_low == pytest.approx(mean - margin, abs=margin / 8) and got["wide"].ci_high == pytest.approx(mean + margin, abs=margin / 8)
    other = {r.metric: r for r in c.bootstrap(df.repartition(5, "wide"), [], "k", names).collect()}  # weights are the rows' own
    assert all(other[n].ci_low == pytest.approx(got[n].ci_low) for n in ("same", "wide"))
    by = c.bootstrap(df.withColumn("g", F.when(F.col("wide") > 1, "x")), ["g"], "k", ["same"], 200).collect()
    assert {(r.g, r.pairs) for r in by} == {("x", sum(x > 1 for x in w)), (None, sum(x <= 1 for x in w))}
    assert c.bootstrap(df.limit(0), [], "k", names).collect() == []


@pytest.mark.parametrize(("rows", "want"), [([("g", "improved")], "invalid"), ([("g", "regressed"), ("h", "improved")], "reject"), ([("g", "improved"), ("h", "inconclusive")], "promote"), ([("g", "inconclusive"), ("h", "improved")], "needs_more_evidence")])
def test_decision(spark, rows, want):
    got = c.decide(spark.createDataFrame(rows, "metric string, verdict string"), gates=("g", "h"), goals=("g",)).first()
    assert got.decision == want and got.missing == ("h" if want == "invalid" else "")


def test_decision_over_scenarios_and_seeds(spark):
    overall = lambda rate: spark.createDataFrame([("g", "improved", rate), ("h", "inconclusive", 0.0)], "metric string, verdict string, desired_sign_rate double")
    scenario = lambda v: spark.createDataFrame([("risk", "h", v), ("risk", "other", "regressed")], "scenario string, metric string, verdict string")
    run = lambda rate, v: c.decide(overall(rate), scenario(v), ("g", "h"), ("g",), c.SIGN_RATE).first()
    assert run(0.67, "improved").decision == "promote" and run(0.6, "improved").decision == "needs_more_evidence"
    assert tuple(run(1.0, "regressed"))[0:4] == ("reject", "", "", "risk:h")


def test_verdict(spark):
    df = spark.createDataFrame([(0.1, 0.2, True), (0.1, 0.2, False), (-0.1, 0.2, True), (None, 0.2, True)], "a double, b double, up boolean")
    assert [r.v for r in df.select(c.verdict(F.col("a"), F.col("b"), F.col("up")).alias("v")).collect()] == ["improved", "regressed", "inconclusive", "unquantified"]


def test_budget(spark):
    some = spark.createDataFrame([(f"c{i}", 0.25) for i in range(40)], "case_id string, p double")
    none = some.withColumn("p", F.lit(0.0))
    sizes = [1, 2, 4, 8, 16]
    assert c.recommend(c.success_at(some, "p", sizes), 4).first().recommended_n == 8
    assert tuple(c.recommend(c.success_at(none, "p", sizes), 4).first()) == ("keep_current_n", 4, 1.0, None, None)
    # gains below the current size do not count, the gain at the next one is over the current one
    steps = spark.createDataFrame([(1, 0.1, 0.1), (2, 0.5, 0.5), (4, 0.5, 0.5), (8, 0.51, 0.6), (16, 0.6, 0.7)], "target_n int, success double, mixed double")
    got = c.recommend(steps, 4).first()
    assert (got.recommended_n, got.cost_multiplier) == (16, 4.0) and got.success_gain == pytest.approx(0.09)
    assert [r.success for r in c.success_at(none, "p", [16]).collect()] == [0.0]
    ends = {(r.target_n, r.measure): (r.ci_low, r.ci_high) for r in c.budget_bootstrap(some, "case_id", "p", [4], 200).collect()}
    assert ends[4, "success"] == pytest.approx((1 - 0.75**4,) * 2) and ends[4, "mixed"] == pytest.approx((1 - 0.25**4 - 0.75**4,) * 2)


def test_steps_that_cannot_be_judged_have_a_reason(spark):
    rows = [(1, x) for x in "aabb"] + [(2, x) for x in "aab"] + [(3, "a"), (4, "a"), (4, "b"), (4, "x"), (5, None), (5, "a"), (5, "b")]
    got = {r.step: (r.missing, r.unknown, r.reason) for r in c.coverage_by(spark.createDataFrame(rows, "step int, case_id string"), ["step"], "case_id", spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "case_id string")).collect()}
    assert got == {1: (0, 0, None), 2: (0, 0, "1 to 2 rollouts a case"), 3: (1, 0, "incomplete: 1 missing, 0 unknown"), 4: (0, 1, "incomplete: 0 missing, 1 unknown"), 5: (0, 1, "incomplete: 0 missing, 1 unknown")}


def test_best_takes_the_earliest_of_equals(spark):
    df = spark.createDataFrame([(10, 0.5), (20, 0.7), (30, 0.7), (40, None)], "step int, v double")
    assert c.best(df, [("v", True), ("step", False)]).first().step == 20


def test_coverage(spark):
    cases = spark.createDataFrame([("a",), ("b",), ("c",), ("a",), (None,)], "case_id string")
    got = {(r.case_id, r.status, r.n) for r in q.coverage(cases, spark.createDataFrame([("a",), ("a",), ("b",), ("x",), (None,)], "case_id string"), "case_id", 2).collect()}
    assert got == {("b", "wrong_count", 1), ("c", "missing", 0), ("x", "unknown", 1), (None, "empty_id", 1)}


def test_comparison_with_operator_in_data(spark):
    rows = [("3", ">=", "2", True), ("3", "<=", "2", False), (None, ">=", "2", False), ("true", "==", "true", True), ("true", "==", '"true"', False), (None, "==", None, True), (None, "!=", "1", True), ("1", "~", "1", None)]
    df = spark.createDataFrame(rows, "a string, op string, b string, want boolean")
    assert [r.got for r in df.select(q.compare_by(F.col("a"), F.col("op"), F.col("b")).alias("got")).collect()] == [r[3] for r in rows]


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"b":[1, 2],"a":"中 é"}',), ('{ "a": "中 é", "b": [1,2] }',), ("{",)], "j string")
    got = [r.c for r in df.select(q.canonical_json("j").alias("c")).collect()]
    assert got == ['{"a":"中 é","b":[1,2]}'] * 2 + [None]


def test_digest_follows_order_and_content(spark):
    d = lambda rows: q.digest(spark.createDataFrame(rows, "i int, t string"), ["i"], F.col("t")).first()
    one = d([(1, "a"), (2, "b")])
    assert one == d([(2, "b"), (1, "a")]) and one.digest != d([(1, "b"), (2, "a")]).digest and d([]).rows == 0


def test_digest_parts_are_ranks(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [(i // 3 if i % 50 else None, f"t{i * 7 % 1000}") for i in range(1000)]
    ordered = [h for _, _, h in sorted((i is not None, i or 0, sha(t)) for i, t in rows)]
    for part_rows in (64, 333, 1000, 5000):
        expected = sha("\n".join(sha("\n".join(ordered[at : at + part_rows])) for at in range(0, 1000, part_rows)))
        for slices in (1, 5):
            df = spark.createDataFrame(spark.sparkContext.parallelize(rows[::slices] + [r for k in range(1, slices) for r in rows[k::slices]], slices), "i int, t string")
            assert tuple(q.digest(df, ["i"], F.col("t"), part_rows).first()) == (1000, expected)


def test_curriculum(spark):
    rows = spark.createDataFrame([("low" if i < 4 else "high", f"k{i}", "x") for i in range(8)], "s string, id string, n string")
    strata = cu.multipliers(spark.createDataFrame([("low", 4, 0.0), ("high", 4, 1.0)], "s string, n int, v double"), F.col("v"))
    allocated = cu.allocate(strata, "s", "n", 1.5)
    assert {r.s: r.extra for r in allocated.collect()} == {"low": 4, "high": 0}
    out = cu.expand(rows, allocated, "s", "id").collect()
    assert len(out) == 12 and max(r.repeat_index for r in out) == 1 and all(r.s == "low" for r in out if r.repeat_index)
    full = cu.allocate(strata.withColumn("multiplier", F.lit(1.0)), "s", "n", 1.5)
    assert {r.extra for r in full.collect()} == {0}


def test_fold(spark):
    rows = [(1, 1, "a"), (1, 2, "a"), (1, 3, "end"), (1, 4, "b"), (1, 5, None), (2, 1, "x"), (2, 2, None), (2, 3, "y"), (2, 4, "z"), (3, 1, None)]
    got = {r.e: (r.attempts, r.trailing, r.repeated, r.final) for r in sq.fold(spark.createDataFrame(rows, "e int, ts int, act string"), "e", ["ts"], "act", ["end"], 3).collect()}
    assert got == {1: (3, 2, 1, "end"), 2: (3, 0, 0, "cut"), 3: (1, 0, 0, None)}


def test_latest_and_aliases(spark):
    s = spark.createDataFrame([("t", 1, 1.0, 5.0), ("t", 1, 2.0, 6.0), ("t", 1, 2.0, 7.0), ("u", 1, 1.0, None)], "tag string, step int, wall double, value double")
    assert [r.value for r in sq.latest(s.where("value IS NOT NULL"), ["tag", "step"], "value", "wall").collect()] == [7.0]
    names = spark.createDataFrame([("m", "u", 1), ("m", "t", 2), ("gone", "v", 1)], "metric string, tag string, priority int")
    assert [(r.metric, r.tag, r.points) for r in sq.alias_series(s, names).collect()] == [("m", "t", 3)]


def test_dialogue(spark):
    t = dl.target_turns(dl.turns(spark.createDataFrame([(1, "User: a b\nno speaker\nAgent: 你好 x\nAgent:"), (2, None)], "id int, t string"), "id", "t"), "id", ["Agent"])
    got = [(r.turn, r.speaker, r.target_no, r.tokens, round(r.weight, 3)) for r in dl.turn_weights(t).orderBy("turn").collect()]
    assert got == [(1, "User", 0, 2, 0.0), (2, "Agent", 1, 3, 0.333), (3, "Agent", 2, 0, 0.0)]


def test_floor_percentiles(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 11)] + [(None,)], "n int")
    r = dl.floor_percentiles(df, [], "n", {"p50": 0.5, "p95": 0.95}).first()
    assert (r.p50, r.p95, r.n, r["mean"]) == (5, 9, 10, 5.5)


def test_text(spark):
    df = spark.createDataFrame([(" a　  b\x1c",), ("",), (None,), (" 　",)], "t string")
    assert [(r.s, r.b) for r in df.select(text.squeeze_space("t").alias("s"), text.is_blank("t").alias("b")).collect()] == [("a b", False), ("", True), (None, True), ("", True)]
    ids = spark.createDataFrame([("Tree-Felling.permit NEW_001.\n",), ("…",), (None,)], "t string")
    assert [r.i for r in ids.select(text.canonical_id("t").alias("i")).collect()] == ["tree_felling_permit_new_001", None, None]


def test_files(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "7.jsonl").write_text('{"a": 1}\n\n{"a": 2, "step": 3}\n[1]\n{"a"\n')
    good, bad = files.read_jsonl_checked(spark, str(tmp_path / "j"), "a int, step long")
    assert [r.a for r in good.collect()] == [1, 2] and sorted((r.line_no, r.error) for r in bad.collect()) == [(4, "no object"), (5, "no valid JSON")]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "12.jsonl").write_text('{"a": 1}\n{"a": 2, "step": 3}\n')
    assert [(r.a, r.step) for r in files.read_steps(spark, str(tmp_path / "s"), "a int, step long").collect()] == [(1, 12), (2, 3)]
    assert files.latest_step_file(spark, str(tmp_path / "s")).endswith("/s/12.jsonl")
    with pytest.raises(FileNotFoundError):
        files.latest_step_file(spark, str(tmp_path))
    with pytest.raises(Exception, match="Malformed|MALFORMED"):
        files.read_jsonl(spark, str(tmp_path / "j"), "a int").collect()


def test_seeds_hashes_and_manifest(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps({"v": k}))
    named = [(k, str(tmp_path / f"{k}.json")) for k in range(3)]
    assert sorted((r.seed, r.v) for r in files.read_seeds(spark, named, "v int").collect()) == [(0, 0), (1, 1), (2, 2)]
    for wrong in (named[:2], [*named, named[0]]):
        with pytest.raises(ValueError, match="seed"):
            files.read_seeds(spark, wrong, "v int")
    before = files.folder_digest(spark, str(tmp_path))
    inner = lambda k: f"{k}.json\0" + hashlib.sha256(json.dumps({"v": k}).encode()).hexdigest() + "\0"
    assert before == hashlib.sha256("".join(map(inner, range(3))).encode()).hexdigest()
    (tmp_path / "2.json").write_text("{}")
    assert files.folder_digest(spark, str(tmp_path)) != before and files.file_hashes(spark, str(tmp_path)).count() == 3
    with pytest.raises(ValueError, match="empty"):
        (tmp_path / "none").mkdir()
        files.folder_digest(spark, str(tmp_path / "none"))
    path = str(tmp_path / "m" / "manifest.json")
    assert files.write_or_verify_manifest(spark, path, {"b": 1, "a": 2}) == "created" and files.write_or_verify_manifest(spark, path, {"a": 2, "b": 1}) == "verified"
    with pytest.raises(ValueError, match="agree"):
        files.write_or_verify_manifest(spark, path, {"a": 3})
    assert (tmp_path / "m" / "manifest.candidate.json").exists()


def test_upsert_and_require(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, at int, v string")
    new = spark.createDataFrame([("a", 1, "z"), ("b", 1, "w"), ("c", 1, "n")], "k string, at int, v string")
    assert {r.k: r.v for r in files.upsert(old, new, ["k"], "at").collect()} == {"a": "z", "b": "y", "c": "n"}
    assert files.require(old, F.col("at") > 0, "no").count() == 2
    with pytest.raises(Exception, match="too old"):
        files.require(old, F.col("at") > 1, "too old").collect()


def test_salted_join(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else "b") for i in range(60)], "id int, k string")
    small = spark.createDataFrame([("hot", 1)], "k string, v int")
    got = runtime.join_salted(big, small, ["k"], "left", F.xxhash64("id"), 4)
    assert sorted(map(tuple, got.select("id", "k", "v").collect())) == sorted(map(tuple, big.join(small, "k", "left").select("id", "k", "v").collect()))


def test_verdicts_come_from_the_bootstrap(spark):
    side = lambda v: None if v is None else {"b": 0.0, "c": v}
    rows = [(f"c{i}", side(p), side(f), side(o)) for i, (p, f, o) in enumerate(zip([0.1, 0.1, 1.0], [-0.5, 0.5, 0.25], [1.0, None, None]))]
    pairs = spark.createDataFrame(rows, "case_id string, process struct<b: double, c: double>, final struct<b: double, c: double>, one struct<b: double, c: double>")
    names = ["process", "final", "one"]
    got = {r.metric: (round(r.delta, 9), r.verdict) for r in c.compared(pairs, [], "case_id", names).collect()}
    # mean +- 1.96 standard errors of process holds 0, the resamples are all above it
    assert got == {"process": (0.4, "improved"), "final": (0.083333333, "inconclusive"), "one": (1.0, "unquantified")}
    assert {r.metric: r.verdict for r in c.compared(pairs, [], "case_id", names, normal=True).collect()}["process"] == "inconclusive"


def test_repeated_event_counts_once_however_late(spark, tmp_path):
    event = "event_id long, ts timestamp, user_id long, event_type string"
    at = datetime(2026, 1, 1)
    first = [(i, at + timedelta(minutes=i), 1, f"a{i}") for i in range(100)]
    late = [(0, at, 1, "a0"), (99, at + timedelta(minutes=99), 1, "a99"), (100, at + timedelta(hours=3), 1, "a5"), (100, at + timedelta(hours=3), 1, "a5")]
    for n, rows in enumerate((first, late)):
        spark.createDataFrame(rows, event).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{n}")
    key, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, rocks)
    try:
        for n in (0, 1):  # one batch each, over one checkpoint
            (tmp_path / "in").mkdir(exist_ok=True)
            for f in (tmp_path / str(n)).glob("*.parquet"):
                f.rename(tmp_path / "in" / f"{n}-{f.name}")
            updates = ep.episodes(ep.file_stream(spark, str(tmp_path / "in"), event), ["end"], 1000)
            q_ = updates.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/out")).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            q_.awaitTermination()
    finally:
        spark.conf.set(key, before)
    got = ep.latest_update(spark.read.parquet(f"{tmp_path}/out")).first()
    assert (got.attempts, got.trailing, got.repeated) == (101, 0, 1)


def test_release_ends_a_finished_episode_only(spark, tmp_path):
    event = "event_id long, ts timestamp, user_id long, event_type string"
    at = datetime(2026, 1, 1)
    batches = [[(1, at, 1, "end"), (2, at, 2, "a"), (10, at + timedelta(minutes=1), 1, "release"), (11, at + timedelta(minutes=1), 2, "release")], [(20, at + timedelta(hours=1), 1, "a"), (21, at + timedelta(hours=1), 2, "a")]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, event).coalesce(1).write.parquet(f"{tmp_path}/{n}")
    key, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, rocks)
    try:
        for n in (0, 1):
            (tmp_path / "in").mkdir(exist_ok=True)
            for f in (tmp_path / str(n)).glob("*.parquet"):
                f.rename(tmp_path / "in" / f"{n}-{f.name}")
            out = ep.run_to_end(ep.episodes(ep.file_stream(spark, str(tmp_path / "in"), event), ["end"], 10), f"{tmp_path}/out{n}", f"{tmp_path}/state")
    finally:
        spark.conf.set(key, before)
    # the state of 1 is gone and begins anew, that of 2 goes on: the action is a repeat
    assert {r.user_id: (r.attempts, r.trailing, r.repeated, r.final) for r in out.collect()} == {1: (1, 0, 0, None), 2: (2, 0, 1, None)}
