"""Comparisons of runs: paired differences, bootstrap, Wilson and t intervals, verdicts, selection, budget projection."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Resamples and seed of the bootstrap.
RESAMPLES, SEED = 2000, 41
#: The metrics of a comparison and whether more is better.
METRICS = {
    "environment_reward": True, "final_action_correct": True, "tool_results_support_final": True, "tool_result_conflict": False, "required_tool_rate": True, "process_compliant": True, "repeated_tool_call": False,
    "tool_order_violation": False, "eligibility_before_slots_complete": False, "material_check_called": True, "risk_check_called": True, "safe_success_at_1": True, "process_success_at_1": True, "safe_success_at_k": True,
    "process_success_at_k": True, "unique_output_rate": True, "identical_output_group_rate": False, "hard_gate": False, "unsafe_submit": False, "missing_tool_final_rate": False, "illegal_action_attempt_rate": False,
    "trailing_action_rate": False, "invalid_tool_name_rate": False, "tool_call_format_error_rate": False, "judge_used": True,
}
#: The metrics compared within a scenario, those that must not get worse, and those that decide.
SCENARIO_METRICS = ("process_success_at_1", "safe_success_at_1", "process_success_at_k", "safe_success_at_k", "final_action_correct", "tool_result_conflict", "hard_gate", "unsafe_submit")
GATES = (
    "process_success_at_1", "safe_success_at_1", "process_success_at_k", "safe_success_at_k", "unsafe_submit", "hard_gate", "final_action_correct", "tool_result_conflict", "repeated_tool_call", "tool_order_violation",
    "eligibility_before_slots_complete", "illegal_action_attempt_rate", "trailing_action_rate", "invalid_tool_name_rate", "tool_call_format_error_rate",
)
GOALS = ("process_success_at_1", "safe_success_at_1")
#: Share of seeds that must point the way a metric should go, for a promotion over several seeds.
SIGN_RATE = 2 / 3
#: Two-sided 95 % quantiles of Student's t for 1 to 20, 25 and 30 degrees of freedom.
T_95 = {
    1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 11: 2.201, 12: 2.179, 13: 2.16, 14: 2.145, 15: 2.131, 16: 2.12, 17: 2.11,
    18: 2.101, 19: 2.093, 20: 2.086, 25: 2.06, 30: 2.042,
}
Z_95 = 1.96


def case_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per keys (the case among them) with all of METRICS but missing_tool_final_rate, which no case has.

    rows: metrics.flat. Means over the values that are there; a case without any call has rates of 0."""
    derived = {
        "safe_success_at_1": F.avg(F.col("safe").cast("double")), "process_success_at_1": F.avg(F.col("process").cast("double")),
        "safe_success_at_k": F.max(F.col("safe").cast("double")), "process_success_at_k": F.max(F.col("process").cast("double")),
        "unique_output_rate": F.count_distinct("output_hash") / F.count(F.lit(1)),
        "identical_output_group_rate": ((F.count(F.lit(1)) > 1) & (F.count_distinct("output_hash") == 1)).cast("double"),
        "invalid_tool_name_rate": F.coalesce(F.try_divide(F.sum("wrong_names"), F.sum("calls")), F.lit(0.0)),
        "tool_call_format_error_rate": F.coalesce(F.try_divide(F.sum("malformed"), F.sum("calls")), F.lit(0.0)),
    }
    raw = [m for m in METRICS if m not in derived and m != "missing_tool_final_rate"]
    return rows.groupBy(*keys).agg(*[F.avg("reward_value" if m == "environment_reward" else m).alias(m) for m in raw], *[e.alias(m) for m, e in derived.items()])


def paired_cases(baseline: DataFrame, candidate: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per key of both sides; of each metric a struct (b, c), null where either side lacks it."""
    b = baseline.select(*keys, *[F.col(m).alias(f"b_{m}") for m in metrics])
    both = b.join(candidate.select(*keys, *[F.col(m).alias(f"c_{m}") for m in metrics]), keys)
    pair = lambda m: F.when(F.col(f"b_{m}").isNotNull() & F.col(f"c_{m}").isNotNull(), F.struct(F.col(f"b_{m}").cast("double").alias("b"), F.col(f"c_{m}").cast("double").alias("c")))
    return both.select(*keys, *[pair(m).alias(m) for m in metrics])


def paired_means(pairs: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric, higher_is_better, baseline, candidate, delta, paired_cases) of the metrics with any pair. All metrics are
    averaged in one pass over the cases and laid out as rows after that."""
    stats = pairs.groupBy(*by).agg(*[F.struct(F.avg(f"{m}.b").alias("baseline"), F.avg(f"{m}.c").alias("candidate"), F.count(m).alias("paired_cases")).alias(m) for m in metrics])
    long = stats.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(METRICS.get(m, True)).alias("higher_is_better"), F.col(m).alias("s")) for m in metrics])).alias("r"))
    out = long.select(*by, "r.metric", "r.higher_is_better", "r.s.baseline", "r.s.candidate", (F.col("r.s.candidate") - F.col("r.s.baseline")).alias("delta"), "r.s.paired_cases")
    return out.where(F.col("paired_cases") > 0)


def _poisson(keys: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """Weights of rows in resamples: Poisson(1) by a hash of the row's key, so that they depend on neither layout nor order."""
    x = keys.astype(np.uint64)[:, None] + (np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) * np.uint64(0xD1342543DE82EF95))[None, :]
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(times)
    x ^= x >> np.uint64(31)
    share = np.exp(-1.0) / np.cumprod([1.0, *range(1, 18)])
    return np.searchsorted(np.cumsum(share), (x >> np.uint64(11)) / 2.0**53).astype(np.float64)


def bootstrap(values: DataFrame, by: list[str], key: str, columns: list[str], resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(by, metric, ci_low, ci_high, pairs): 95 % interval of the mean of each column over the rows; fewer than 2 values: none.

    Every row weighs Poisson(1) in each resample, which for many rows is resampling with replacement; a resample's mean is
    then a ratio of two sums, so that every task adds up its own rows and only resamples, not rows, come together. key names
    the row (a case): its weight is the same in all columns. Null values are left out; by should have few values."""
    names = list(columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.select(*by).schema)
    schema = (schema + ", " if schema else "") + "b int, " + ", ".join(f"s{i} double, c{i} double" for i in range(len(names)))
    rows = values.select(*by, F.xxhash64(key).alias("_key"), *[F.col(c).cast("double").alias(c) for c in names])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            parts = batch.groupby(by, dropna=False, sort=False) if by else [((), batch)]
            for group, part in parts:
                group = tuple(None if x is None or x != x else x for x in (group if isinstance(group, tuple) else (group,)))
                for at in range(0, len(part), 1000):
                    some = part.iloc[at : at + 1000]
                    d = some[names].to_numpy(dtype=np.float64)
                    there = ~np.isnan(d)
                    w = _poisson(some["_key"].to_numpy(), resamples, seed).T
                    both = np.stack([w @ np.where(there, d, 0.0), w @ there.astype(np.float64)], axis=2).reshape(resamples, -1)
                    sums[group] = sums[group] + both if group in sums else both
        for group, both in sums.items():
            out = pd.DataFrame(both, columns=[f"{k}{i}" for i in range(len(names)) for k in "sc"])
            for i, column in enumerate(by):
                out.insert(i, column, [group[i]] * resamples)
            out.insert(len(by), "b", np.arange(resamples, dtype=np.int32))
            yield out

    whole = rows.mapInPandas(partial, schema).groupBy(*by, "b").agg(*[F.sum(f"{k}{i}").alias(f"{k}{i}") for i in range(len(names)) for k in "sc"])
    means = whole.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.try_divide(f"s{i}", f"c{i}").alias("m")) for i, m in enumerate(names)])).alias("r")).select(*by, "r.*")
    # RESAMPLES numbers a group
    ends = means.where("m IS NOT NULL").groupBy(*by, "metric").agg(F.array_sort(F.collect_list("m")).alias("all"))
    at = lambda p: F.element_at("all", F.greatest(F.lit(1), F.ceil(F.size("all") * p)).cast("int"))
    n = rows.groupBy(*by).agg(*[F.count(m).alias(m) for m in names]).select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("pairs")) for m in names])).alias("r")).select(*by, "r.*")
    cond = [F.col(f"n.{c}").eqNullSafe(F.col(f"e.{c}")) for c in [*by, "metric"]]
    both = n.where("pairs > 0").alias("n").join(ends.select(*by, "metric", at(0.025).alias("low"), at(0.975).alias("high")).alias("e"), reduce(Column.__and__, cond), "left")
    enough = F.col("pairs") >= 2
    return both.select(*[F.col(f"n.{c}").alias(c) for c in [*by, "metric"]], F.when(enough, F.col("low")).alias("ci_low"), F.when(enough, F.col("high")).alias("ci_high"), "pairs")


def compared(pairs: DataFrame, by: list[str], key: str, metrics: list[str], normal: bool = False) -> DataFrame:
    """paired_means with interval and verdict: from the bootstrap, or from mean +- 1.96 standard errors with normal."""
    means = paired_means(pairs, by, metrics)
    deltas = pairs.select(*by, key, *[(F.col(f"{m}.c") - F.col(f"{m}.b")).alias(m) for m in metrics])
    if normal:
        long = deltas.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("delta")) for m in metrics])).alias("r")).select(*by, "r.*").where("delta IS NOT NULL")
        ends = normal_interval(long, [*by, "metric"]).select(*by, "metric", "ci_low", "ci_high")
    else:
        ends = bootstrap(deltas, by, key, metrics).select(*by, "metric", "ci_low", "ci_high")
    out = means.join(ends, [*by, "metric"])
    return out.withColumn("verdict", verdict(F.col("ci_low"), F.col("ci_high"), F.col("higher_is_better")))


def verdict(low: Column, high: Column, higher_is_better: Column) -> Column:
    """improved, regressed, inconclusive (the interval holds 0) or unquantified (there is none)."""
    up, down = low > 0, high < 0
    return (
        F.when(low.isNull() | high.isNull(), "unquantified").when((up & higher_is_better) | (down & ~higher_is_better), "improved").when((up & ~higher_is_better) | (down & higher_is_better), "regressed").otherwise("inconclusive")
    )


def normal_interval(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The interval mean +- 1.96 standard errors, for data of any size in one aggregation."""
    se = F.stddev_samp("delta") / F.sqrt(F.count("delta"))
    return pairs.groupBy(*by).agg(F.avg("delta").alias("delta"), (F.avg("delta") - Z_95 * se).alias("ci_low"), (F.avg("delta") + Z_95 * se).alias("ci_high"), F.count("delta").alias("pairs"))


def with_fallback(measured: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """Measured rows first; a metric that only the summary has comes from there and is unquantified."""
    m, s = measured.alias("m"), summary.alias("s")
    both = m.join(s, F.col(f"m.{key}") == F.col(f"s.{key}"), "full_outer")
    rest = [c for c in summary.columns if c != key]
    return both.select(F.coalesce(f"m.{key}", f"s.{key}").alias(key), *[F.coalesce(f"m.{c}", f"s.{c}").alias(c) for c in rest], F.when(F.col(f"m.{key}").isNull(), "unquantified").otherwise(F.col("m.verdict")).alias("verdict"))


def wilson_low(successes: Column, n: Column, z: float = Z_95) -> Column:
    """Lower end of the Wilson interval; 0 for n = 0."""
    p = F.try_divide(successes.cast("double"), n)
    spread = z * F.sqrt(F.greatest(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n), F.lit(0.0)))
    return F.coalesce((p + F.try_divide(F.lit(z * z), 2 * n) - spread) / (1 + F.try_divide(F.lit(z * z), n)), F.lit(0.0))


def t_quantile(df: Column) -> Column:
    """Two-sided 95 %: the table, straight between 20 and 25, the value of 25 up to 29, 1.96 beyond 30."""
    out = F.when(df < 1, F.lit(float("inf")))
    for k in range(1, 21):
        out = out.when(df == k, T_95[k])
    out = out.when(df < 25, T_95[20] + (df - 20) * (T_95[25] - T_95[20]) / 5).when(df < 30, T_95[25]).when(df == 30, T_95[30])
    return out.otherwise(F.lit(Z_95))


def over_seeds(rows: DataFrame, keys: list[str], seeds: int) -> DataFrame:
    """rows: keys, seed, baseline, candidate, delta, higher_is_better. Of the metrics that every seed has: means, sample
    deviation of the delta (0 for one seed), t interval (infinite for one), share of the seeds that go the desired way,
    verdict, and the deltas by seed. A metric whose seeds do not agree on the orientation ends the query."""
    up = F.col("higher_is_better")
    same = F.when(F.min(up) == F.max(up), F.min(up)).otherwise(F.raise_error(F.lit("seeds disagree on the orientation of a metric")).cast("boolean"))
    g = rows.groupBy(*keys).agg(
        F.count_distinct("seed").alias("seeds"), F.avg("baseline").alias("baseline_mean"), F.avg("candidate").alias("candidate_mean"), F.avg("delta").alias("delta_mean"), F.coalesce(F.stddev_samp("delta"), F.lit(0.0)).alias("delta_std"),
        F.avg(F.when(up, F.col("delta") > 0).otherwise(F.col("delta") < 0).cast("double")).alias("desired_sign_rate"), same.alias("higher_is_better"),
        F.array_join(F.array_sort(F.collect_list(F.format_string("%s=%.6f", "seed", "delta"))), " ").alias("seed_deltas"),
    ).where(F.col("seeds") == seeds)
    margin = F.when(F.col("seeds") < 2, F.lit(float("inf"))).otherwise(t_quantile(F.col("seeds") - 1) * F.col("delta_std") / F.sqrt(F.col("seeds")))
    g = g.withColumns({"ci_low": F.col("delta_mean") - margin, "ci_high": F.col("delta_mean") + margin})
    return g.withColumn("verdict", verdict(F.col("ci_low"), F.col("ci_high"), F.col("higher_is_better")))


def decide(overall: DataFrame, scenarios: DataFrame | None = None, gates: tuple[str, ...] = GATES, goals: tuple[str, ...] = GOALS, sign_rate: float | None = None) -> DataFrame:
    """One row: decision and what it rests on, names parted by commas.

    invalid where a gate has no overall verdict (missing), else reject where one regressed, overall or in a scenario, else
    promote where a goal improved (with sign_rate: and that share of the seeds agrees), else needs_more_evidence.
    overall: metric, verdict(, desired_sign_rate); scenarios: scenario, metric, verdict. Both are a row per metric."""
    names = lambda condition, what: F.array_join(F.array_sort(F.collect_set(F.when(condition, what))), ",")
    metric, bad = F.col("metric"), F.col("verdict") == "regressed"
    good = metric.isin(list(goals)) & (F.col("verdict") == "improved")
    if sign_rate is not None:
        good = good & (F.col("desired_sign_rate") >= sign_rate)
    gate = metric.isin(list(gates))
    have = F.collect_set(F.when(gate, metric))
    missing = F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, gates)), have)), ",")
    one = overall.agg(missing.alias("missing"), names(gate & bad, metric).alias("regressions"), names(good, metric).alias("improvements"))
    if scenarios is not None:
        by_scenario = scenarios.agg(names(gate & bad, F.concat_ws(":", "scenario", "metric")).alias("scenario_regressions"))
        one = one.crossJoin(F.broadcast(by_scenario))  # one row each
    else:
        one = one.withColumn("scenario_regressions", F.lit(""))
    decision = F.when(F.col("missing") != "", "invalid").when((F.col("regressions") != "") | (F.col("scenario_regressions") != ""), "reject").when(F.col("improvements") != "", "promote").otherwise("needs_more_evidence")
    return one.select(decision.alias("decision"), "missing", "regressions", "scenario_regressions", "improvements")


def coverage_by(rows: DataFrame, keys: list[str], case: str, expected: DataFrame) -> DataFrame:
    """Per keys (a step): cases missing from the expected ones, unknown cases, the numbers of rollouts that cases have, and
    reason: why the step cannot be judged, or null. Rows without a case count as unknown."""
    want = expected.select(F.col(case)).where(F.col(case).isNotNull()).distinct().withColumn("_known", F.lit(True))
    total = want.agg(F.count(F.lit(1)).alias("_all"))
    per_case = rows.groupBy(*keys, case).agg(F.count(F.lit(1)).alias("_n")).join(want, case, "left")
    g = per_case.groupBy(*keys).agg(
        F.count_if("_known").alias("cases"), F.count_if(F.col("_known").isNull()).alias("unknown"), F.min("_n").alias("least_rollouts"), F.max("_n").alias("most_rollouts"),
    ).crossJoin(F.broadcast(total))  # fmt: skip (one row)
    g = g.withColumn("missing", F.col("_all") - F.col("cases"))
    reason = F.when((F.col("missing") > 0) | (F.col("unknown") > 0), F.format_string("incomplete: %d missing, %d unknown", "missing", "unknown")).when(F.col("least_rollouts") != F.col("most_rollouts"), F.format_string("%d to %d rollouts a case", "least_rollouts", "most_rollouts"))
    return g.select(*keys, "cases", "missing", "unknown", "least_rollouts", "most_rollouts", reason.alias("reason"))


#: The order in which checkpoints are chosen; True where more is better.
SELECTION = [
    ("worst_scenario_process_pass_at_1_lcb95", True), ("process_pass_at_1_lcb95", True), ("safe_pass_at_1_lcb95", True), ("unsafe_submit", False), ("illegal_action_attempt_rate", False), ("process_pass_at_k_lcb95", True),
    ("safe_pass_at_k_lcb95", True), ("final_action_correct", True), ("environment_reward", True),
]
_MEANS = ("unsafe_submit", "illegal_action_attempt_rate", "final_action_correct", "required_tool_rate", "repeated_tool_call", "tool_order_violation")


def checkpoints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys (a run and step) the summary that checkpoints are chosen by, in three aggregations: case, scenario, step.

    rows: metrics.flat with a case and a scenario. Missing flags count as 0; the compliance of a row falls back to
    required_tool_rate >= 1. Lower ends are Wilson's at 95 %."""
    zero = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0)))
    per_case = rows.groupBy(*keys, "scenario", "case_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("safe").alias("safe"), F.count_if("process").alias("process"), *[zero(m).alias(m) for m in _MEANS],
        F.sum(F.coalesce("process_compliant", (F.col("required_tool_rate") >= 1).cast("double"), F.lit(0.0))).alias("process_compliant"), F.sum("reward_value").alias("reward"), F.count("reward_value").alias("rewarded"),
    )
    sums = [*_MEANS, "process_compliant", "reward", "rewarded", "n", "safe", "process"]
    per_scenario = per_case.groupBy(*keys, "scenario").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("safe") > 0).alias("safe_k"), F.count_if(F.col("process") > 0).alias("process_k"), F.min("n").alias("least"), F.max("n").alias("most"), *[F.sum(c).alias(c) for c in sums]
    )
    at_1 = F.col("process") / F.col("n")
    worst = {
        "worst_scenario_process_pass_at_1": at_1, "worst_scenario_process_pass_at_1_lcb95": wilson_low(F.col("process"), F.col("n")),
        "worst_scenario_process_pass_at_k": F.col("process_k") / F.col("cases"), "worst_scenario_process_pass_at_k_lcb95": wilson_low(F.col("process_k"), F.col("cases")),
    }
    s = lambda c: F.sum(c)
    rates = {}
    for name in ("process", "safe"):
        rates |= {
            f"{name}_pass_at_1": s(name) / s("n"), f"{name}_pass_at_1_lcb95": wilson_low(s(name), s("n")),
            f"{name}_pass_at_k": s(f"{name}_k") / s("cases"), f"{name}_pass_at_k_lcb95": wilson_low(s(f"{name}_k"), s("cases")),
        }
    return per_scenario.groupBy(*keys).agg(
        s("cases").alias("cases"), s("n").alias("rollouts"), F.min("least").alias("least_rollouts"), F.max("most").alias("most_rollouts"), F.count(F.lit(1)).alias("scenario_count"), *[e.alias(k) for k, e in rates.items()], *[F.min(e).alias(k) for k, e in worst.items()],
        F.stddev_pop(at_1).alias("scenario_process_pass_at_1_std"), *[(s(m) / s("n")).alias(m) for m in (*_MEANS, "process_compliant")], F.try_divide(s("reward"), s("rewarded")).alias("environment_reward"),
    )


def best(rows: DataFrame, keys: list[tuple[str, bool]], by: list[str] | None = None) -> DataFrame:
    """The first row in the lexicographic order of keys (column, larger first); the last key should be unique."""
    order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in keys]
    if by:
        return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")
    return rows.orderBy(*order).limit(1)


def success_at(cases: DataFrame, rate: str, sizes: list[int]) -> DataFrame:
    """(target_n, success, mixed): expected share of cases with any success, and with both outcomes, at n rollouts."""
    p = F.col(rate)
    each = cases.select(p.alias("p"), F.explode(F.array(*map(F.lit, sizes))).alias("target_n"))
    p, n = F.col("p"), F.col("target_n")
    return each.groupBy("target_n").agg(F.avg(1 - F.pow(1 - p, n)).alias("success"), F.avg(1 - F.pow(p, n) - F.pow(1 - p, n)).alias("mixed"))


def recommend(projected: DataFrame, current: int, success_gain: float = 0.03, mixed_gain: float = 0.05) -> DataFrame:
    """One row: the first size above the current one whose gains over the size before (from the current one on) reach both
    bounds, with these gains; keep_current_n where none does. projected must hold the current size."""
    w = Window.orderBy("target_n")  # one row per size
    steps = projected.where(F.col("target_n") >= current).withColumns({"success_gain": F.col("success") - F.lag("success").over(w), "mixed_gain": F.col("mixed") - F.lag("mixed").over(w)})
    ok = (F.col("success_gain") >= success_gain) & (F.col("mixed_gain") >= mixed_gain)
    one = steps.agg(F.min_by(F.struct("target_n", "success_gain", "mixed_gain"), F.when(ok, F.col("target_n"))).alias("r"))
    found = F.col("r").isNotNull()
    n = F.coalesce("r.target_n", F.lit(current))
    return one.select(F.when(found, "run_rollout_ablation").otherwise("keep_current_n").alias("action"), n.alias("recommended_n"), (n / current).alias("cost_multiplier"), "r.success_gain", "r.mixed_gain")


def budget_bootstrap(cases: DataFrame, case: str, rate: str, sizes: list[int], resamples: int = RESAMPLES) -> DataFrame:
    """(target_n, measure, ci_low, ci_high): bootstrap intervals over cases of the projected success and mixed share."""
    p = F.col(rate)
    columns = {f"{m}@{n}": e for n in sizes for m, e in (("success", 1 - F.pow(1 - p, n)), ("mixed", 1 - F.pow(p, n) - F.pow(1 - p, n)))}
    found = bootstrap(cases.select(F.col(case).alias("case"), *[e.alias(k) for k, e in columns.items()]), [], "case", list(columns), resamples)
    name = F.split("metric", "@")
    return found.select(name[1].cast("int").alias("target_n"), name[0].alias("measure"), "ci_low", "ci_high")
