"""Comparison, selection and projection queries. Baseline and candidate are two groups of runs of the rollouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollframe import runtime
from rollframe.operators import compare as c
from rollframe.operators import metrics as m
from rollframe.plans.base import registering
from rollframe.plans.evaluation import CALLS, ONCE, flat, rollouts
from rollframe.plans.evaluation import QUERIES as QUERIES_OF_RUNS

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registering(QUERIES, SQL)

_SIZES = [1, 2, 4, 8, 16]
_PAIRED = [x for x in c.METRICS if x != "missing_tool_final_rate"]


def _case_sql(keys: str) -> str:
    """All metrics per keys (the case among them), of the rows x."""
    derived = {
        "environment_reward": "avg(reward_value)", "safe_success_at_1": "avg(safe::INT::DOUBLE)", "process_success_at_1": "avg(process::INT::DOUBLE)", "safe_success_at_k": "max(safe::INT::DOUBLE)", "process_success_at_k": "max(process::INT::DOUBLE)",
        "unique_output_rate": "count(DISTINCT o) / count(*)::DOUBLE", "identical_output_group_rate": "(count(*) > 1 AND count(DISTINCT o) = 1)::INT::DOUBLE",
        "invalid_tool_name_rate": "coalesce(sum(wrong) / nullif(sum(calls), 0)::DOUBLE, 0)", "tool_call_format_error_rate": "coalesce(sum(bad) / nullif(sum(calls), 0)::DOUBLE, 0)",
    }
    return f"SELECT {keys}, {', '.join(f'{derived.get(x, f'avg({x})')} AS {x}' for x in _PAIRED)} FROM x GROUP BY ALL"


_FLAT = rf"""{ONCE}, {CALLS}, n AS (SELECT rollout_id, count(*) AS calls, count(CASE WHEN wrong_name THEN 1 END) AS wrong, count(CASE WHEN malformed THEN 1 END) AS bad FROM k GROUP BY ALL),
    y AS (SELECT r.*, coalesce(calls, 0) AS calls, coalesce(wrong, 0) AS wrong, coalesce(bad, 0) AS bad, trim(regexp_replace(coalesce(output, ''), '[\s\x1c-\x1f\x85\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')) AS o
        FROM r LEFT JOIN n USING (rollout_id) WHERE case_id IS NOT NULL)"""


def _long_sql(table: str, keys: str, name: str) -> str:
    """The metrics of a table as rows, nulls left out."""
    return f"{name} AS (UNPIVOT {table} ON {', '.join(_PAIRED)} INTO NAME metric VALUE value)"


_UP = "CASE WHEN metric IN (" + ", ".join(f"'{x}'" for x, up in c.METRICS.items() if not up) + ") THEN false ELSE true END"
_SIDE = "x AS (SELECT *, CASE WHEN run_id LIKE '%-base-%' THEN 'baseline' WHEN run_id LIKE '%-curr-%' THEN 'candidate' END AS side FROM y WHERE run_id LIKE '%-base-%' OR run_id LIKE '%-curr-%')"


def _paired_sql(keys: str, only: str = "") -> str:
    on = " AND ".join(f"b.{k.strip()} = q.{k.strip()}" for k in keys.split(","))
    return f"""{_FLAT}, {_SIDE}, w AS ({_case_sql(f'side, {keys}')}), {_long_sql('w', keys, 'l')},
        p AS (SELECT {', '.join(f'b.{k.strip()}' for k in keys.split(','))}, b.metric, b.value AS baseline, q.value AS candidate, q.value - b.value AS delta FROM l b JOIN l q ON {on} AND b.metric = q.metric WHERE b.side = 'baseline' AND q.side = 'candidate' {only})"""


_BASE = _paired_sql("case_id")
_SCENARIO = _paired_sql("case_id, scenario", "AND b.metric IN (" + ", ".join(f"'{x}'" for x in c.SCENARIO_METRICS) + ")")


def _pairs(spark, d, keys, metrics):
    """base runs against curriculum runs, paired by keys."""
    rows = flat(spark, d).where("case_id IS NOT NULL")
    side = lambda kind: c.case_metrics(rows.where(F.col("run_id").contains(kind)), keys)
    return c.paired_cases(side("-base-"), side("-curr-"), keys, metrics)


@query(f"WITH {ONCE} SELECT case_id, avg(reward_value) AS reward_value, avg(rounds) AS rounds FROM r WHERE case_id IS NOT NULL GROUP BY case_id", "reward_value rounds")
def case_metric_means(spark, d):
    return m.means_of_present(rollouts(spark, d).where("case_id IS NOT NULL"), ["case_id"], ["reward_value", "rounds"])


@query(f"WITH {_FLAT}, x AS (SELECT * FROM y) {_case_sql('case_id')}", " ".join(_PAIRED))
def case_metrics_wide(spark, d):
    """All metrics of a comparison, a row per case."""
    return c.case_metrics(flat(spark, d).where("case_id IS NOT NULL"), ["case_id"])


@query(f"WITH {_BASE} SELECT metric, {_UP} AS higher_is_better, avg(baseline) AS baseline, avg(candidate) AS candidate, avg(candidate) - avg(baseline) AS delta, count(*) AS paired_cases FROM p GROUP BY metric", "baseline candidate delta")
def paired_metric_delta(spark, d):
    return c.paired_means(_pairs(spark, d, ["case_id"], _PAIRED), [], _PAIRED)


@query(f"WITH {_SCENARIO} SELECT scenario, metric, {_UP} AS higher_is_better, avg(baseline) AS baseline, avg(candidate) AS candidate, avg(candidate) - avg(baseline) AS delta, count(*) AS paired_cases FROM p GROUP BY scenario, metric", "baseline candidate delta")
def paired_scenario_delta(spark, d):
    metrics = list(c.SCENARIO_METRICS)
    return c.paired_means(_pairs(spark, d, ["case_id", "scenario"], metrics), ["scenario"], metrics)


@query()
def paired_bootstrap_ci(spark, d):
    pairs = _pairs(spark, d, ["case_id"], _PAIRED)
    return c.bootstrap(pairs.select("case_id", *[(F.col(f"{x}.c") - F.col(f"{x}.b")).alias(x) for x in _PAIRED]), [], "case_id", _PAIRED)


def _verdict_sql(pairs: str, keys: str) -> str:
    return f"""WITH {pairs}, i AS (SELECT {keys}, {_UP} AS up, avg(baseline) AS baseline, avg(candidate) AS candidate, avg(candidate) - avg(baseline) AS delta, avg(delta) - 1.96 * stddev_samp(delta) / sqrt(count(*)) AS lo, avg(delta) + 1.96 * stddev_samp(delta) / sqrt(count(*)) AS hi FROM p GROUP BY {keys}),
    vd AS (SELECT {keys}, up AS higher_is_better, baseline, candidate, delta, lo AS ci_low, hi AS ci_high, CASE WHEN lo IS NULL OR hi IS NULL THEN 'unquantified' WHEN (lo > 0 AND up) OR (hi < 0 AND NOT up) THEN 'improved' WHEN (lo > 0 AND NOT up) OR (hi < 0 AND up) THEN 'regressed' ELSE 'inconclusive' END AS verdict FROM i)"""


_ENDS = "baseline candidate delta ci_low ci_high"


@query(f"{_verdict_sql(_BASE, 'metric')} SELECT * FROM vd", _ENDS)
def comparison_normal(spark, d):
    """All metrics with intervals of 1.96 standard errors: what the bootstrap comes near to, in plain aggregation."""
    return c.compared(_pairs(spark, d, ["case_id"], _PAIRED), [], "case_id", _PAIRED, normal=True).drop("paired_cases")


@query(f"{_verdict_sql(_SCENARIO, 'scenario, metric')} SELECT * FROM vd", _ENDS)
def comparison_scenarios_normal(spark, d):
    metrics = list(c.SCENARIO_METRICS)
    return c.compared(_pairs(spark, d, ["case_id", "scenario"], metrics), ["scenario"], "case_id", metrics, normal=True).drop("paired_cases")


def _overall(spark, d):
    """Measured verdicts by bootstrap; a metric that only the runs' summaries have is unquantified."""
    measured = c.compared(_pairs(spark, d, ["case_id"], _PAIRED), [], "case_id", _PAIRED).select("metric", "baseline", "candidate", "delta", "verdict")
    rate = QUERIES_OF_RUNS["missing_tool_final_rate"](spark, d)
    of = lambda kind: F.avg(F.when(F.col("run_id").contains(kind), F.col("missing_tool_final_rate")))
    summary = rate.agg(of("-base-").alias("baseline"), of("-curr-").alias("candidate")).select(F.lit("missing_tool_final_rate").alias("metric"), "baseline", "candidate", (F.col("candidate") - F.col("baseline")).alias("delta"))
    return c.with_fallback(measured, summary, "metric")


@query()
def verdict_table(spark, d):
    """All 25 metrics with the verdict of the bootstrap, measured ones first."""
    return _overall(spark, d)


@query()
def scenario_verdicts(spark, d):
    metrics = list(c.SCENARIO_METRICS)
    return c.compared(_pairs(spark, d, ["case_id", "scenario"], metrics), ["scenario"], "case_id", metrics)


@query()
def promotion_decision(spark, d):
    return c.decide(_overall(spark, d), scenario_verdicts_of(spark, d))


def scenario_verdicts_of(spark, d):
    return QUERIES["scenario_verdicts"](spark, d)


def _names_sql(condition: str, what: str = "metric") -> str:
    return f"coalesce(string_agg(DISTINCT CASE WHEN {condition} THEN {what} END, ',' ORDER BY CASE WHEN {condition} THEN {what} END), '')"


_IN_GATES = "metric IN (" + ", ".join(f"'{x}'" for x in c.GATES) + ")"
_GATE_LIST = "(VALUES " + ", ".join(f"('{x}')" for x in c.GATES) + ") t(g)"


def _decide_sql(overall: str, scenarios: str, more: str = "") -> str:
    good = "metric IN ('process_success_at_1', 'safe_success_at_1') AND verdict = 'improved'" + more
    return f"""o AS (SELECT (SELECT coalesce(string_agg(g, ',' ORDER BY g), '') FROM {_GATE_LIST} WHERE g NOT IN (SELECT metric FROM {overall})) AS missing, {_names_sql(_IN_GATES + " AND verdict = 'regressed'")} AS regressions, {_names_sql(good)} AS improvements FROM {overall}),
        e AS (SELECT {_names_sql(_IN_GATES + " AND verdict = 'regressed'", "scenario || ':' || metric")} AS scenario_regressions FROM {scenarios})
        SELECT CASE WHEN missing <> '' THEN 'invalid' WHEN regressions <> '' OR scenario_regressions <> '' THEN 'reject' WHEN improvements <> '' THEN 'promote' ELSE 'needs_more_evidence' END AS decision, missing, regressions, scenario_regressions, improvements FROM o, e"""


def _wilson_sql(s: str, n: str) -> str:
    return f"coalesce(({s} / CAST({n} AS DOUBLE) + 3.8416 / (2 * {n}) - 1.96 * sqrt({s} / CAST({n} AS DOUBLE) * (1 - {s} / CAST({n} AS DOUBLE)) / {n} + 3.8416 / (4.0 * {n} * {n}))) / (1 + 3.8416 / {n}), 0)"


@query(f"WITH {ONCE}, g AS (SELECT scenario, count(CASE WHEN process THEN 1 END) AS s, count(*) AS n FROM r GROUP BY scenario) SELECT scenario, n, {_wilson_sql('s', 'n')} AS lower FROM g", "lower")
def wilson_lower_bound(spark, d):
    g = rollouts(spark, d).groupBy("scenario").agg(F.count_if("process").alias("s"), F.count(F.lit(1)).alias("n"))
    return g.select("scenario", "n", c.wilson_low(F.col("s"), F.col("n")).alias("lower"))


def _checkpoint_sql() -> str:
    w = lambda a, b: _wilson_sql(a, b)
    means = ("unsafe_submit", "illegal_action_attempt_rate", "final_action_correct", "required_tool_rate", "repeated_tool_call", "tool_order_violation")
    rates = "".join(
        f"sum({n}) / CAST(sum(n) AS DOUBLE) AS {n}_pass_at_1, {w(f'sum({n})', 'sum(n)')} AS {n}_pass_at_1_lcb95, sum({n}_k) / CAST(sum(cases) AS DOUBLE) AS {n}_pass_at_k, {w(f'sum({n}_k)', 'sum(cases)')} AS {n}_pass_at_k_lcb95, " for n in ("process", "safe")
    )
    return f"""{ONCE}, g AS (SELECT run_id, step, scenario, case_id, count(*) AS n, count(CASE WHEN safe THEN 1 END) AS safe, count(CASE WHEN process THEN 1 END) AS process, {', '.join(f'sum(coalesce({x}, 0)) AS {x}' for x in means)},
            sum(coalesce(process_compliant, CAST(required_tool_rate >= 1 AS DOUBLE), 0)) AS process_compliant, sum(reward_value) AS reward, count(reward_value) AS rewarded FROM r WHERE case_id IS NOT NULL AND scenario IS NOT NULL GROUP BY ALL),
        sc AS (SELECT run_id, step, scenario, count(*) AS cases, count(CASE WHEN safe > 0 THEN 1 END) AS safe_k, count(CASE WHEN process > 0 THEN 1 END) AS process_k, min(n) AS least, max(n) AS most, {', '.join(f'sum({x}) AS {x}' for x in (*means, 'process_compliant', 'reward', 'rewarded', 'n', 'safe', 'process'))} FROM g GROUP BY ALL),
        t AS (SELECT run_id, step, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(n) AS BIGINT) AS rollouts, min(least) AS least_rollouts, max(most) AS most_rollouts, count(*) AS scenario_count, {rates}
            min(process / CAST(n AS DOUBLE)) AS worst_scenario_process_pass_at_1, min({w('process', 'n')}) AS worst_scenario_process_pass_at_1_lcb95, min(process_k / CAST(cases AS DOUBLE)) AS worst_scenario_process_pass_at_k,
            min({w('process_k', 'cases')}) AS worst_scenario_process_pass_at_k_lcb95, stddev_pop(process / CAST(n AS DOUBLE)) AS scenario_process_pass_at_1_std, {', '.join(f'sum({x}) / CAST(sum(n) AS DOUBLE) AS {x}' for x in (*means, 'process_compliant'))}, sum(reward) / nullif(sum(rewarded), 0) AS environment_reward FROM sc GROUP BY ALL)"""


_CHECK = _checkpoint_sql()
_CHECKED = " ".join(f"{n}_pass_at_{k}{e}" for n in ("process", "safe", "worst_scenario_process") for k in "1k" for e in ("", "_lcb95")) + " scenario_process_pass_at_1_std unsafe_submit illegal_action_attempt_rate final_action_correct required_tool_rate repeated_tool_call tool_order_violation process_compliant environment_reward"


def _checkpoints(spark, d):
    return c.checkpoints(rollouts(spark, d).where("case_id IS NOT NULL AND scenario IS NOT NULL"), ["run_id", "step"])


@query(f"WITH {_CHECK} SELECT * FROM t", _CHECKED)
def checkpoint_summary(spark, d):
    return _checkpoints(spark, d)


@query(f"WITH {_CHECK}, u AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {', '.join(f'round({k}, 9) {'DESC' if up else 'ASC'} NULLS LAST' for k, up in c.SELECTION)}, step) AS rn FROM t WHERE step > 0) SELECT run_id, step, worst_scenario_process_pass_at_1_lcb95 AS worst, process_pass_at_1_lcb95 AS lower FROM u WHERE rn = 1", "worst lower")
def best_checkpoint(spark, d):
    """By the nine keys; ties go to the earliest step."""
    t = _checkpoints(spark, d).where("step > 0").withColumns({k: F.round(k, 9) for k, _ in c.SELECTION})
    return c.best(t, [*c.SELECTION, ("step", False)], ["run_id"]).select("run_id", "step", F.col("worst_scenario_process_pass_at_1_lcb95").alias("worst"), F.col("process_pass_at_1_lcb95").alias("lower"))


@query(f"""WITH {ONCE}, e AS (SELECT DISTINCT case_id FROM cases WHERE case_id IS NOT NULL), g AS (SELECT run_id, step, r.case_id, count(*) AS n, any_value(e.case_id IS NOT NULL) AS known FROM r LEFT JOIN e ON e.case_id = r.case_id GROUP BY ALL),
    t AS (SELECT run_id, step, count(CASE WHEN known THEN 1 END) AS cases, (SELECT count(*) FROM e) - count(CASE WHEN known THEN 1 END) AS missing, count(CASE WHEN NOT known THEN 1 END) AS unknown, min(n) AS least_rollouts, max(n) AS most_rollouts FROM g GROUP BY run_id, step)
    SELECT *, CASE WHEN missing > 0 OR unknown > 0 THEN 'incomplete: ' || missing || ' missing, ' || unknown || ' unknown' WHEN least_rollouts <> most_rollouts THEN least_rollouts || ' to ' || most_rollouts || ' rollouts a case' END AS reason FROM t""")
def checkpoint_coverage(spark, d):
    """Why a step cannot be judged: cases missing or unknown, or cases with other numbers of rollouts; null where it can."""
    return c.coverage_by(rollouts(spark, d), ["run_id", "step"], "case_id", runtime.table(spark, d, "cases"))


@query(f"WITH {ONCE} SELECT case_id, count(DISTINCT coalesce(scenario, '')) AS labels FROM r WHERE case_id IS NOT NULL GROUP BY case_id HAVING count(DISTINCT coalesce(scenario, '')) <> 1")
def inconsistent_scenarios(spark, d):
    """Cases whose rollouts do not agree on the scenario; a missing one counts as another."""
    return rollouts(spark, d).where("case_id IS NOT NULL").groupBy("case_id").agg(F.count_distinct(F.coalesce("scenario", F.lit(""))).alias("labels")).where("labels <> 1")


_SEEDED = "x AS (SELECT *, CAST(regexp_extract(run_id, '-s([0-9]+)-', 1) AS INTEGER) AS seed, step >= 130 AS late FROM y WHERE step IS NOT NULL AND regexp_matches(run_id, '-s([0-9]+)-') {more})"


def _seeds_sql(keys: str, only: str = "", more: str = "") -> str:
    """Early against late steps of each seed, paired by case, and the aggregation over seeds v."""
    names = [k.strip() for k in keys.split(",")]
    by = ", ".join([*[k for k in names if k != "case_id"], "metric"])
    on = " AND ".join(f"b.{k} = q.{k}" for k in names)
    return f"""{_FLAT}, {_SEEDED.format(more=more)}, w AS ({_case_sql(f'seed, late, {keys}')}), {_long_sql('w', keys, 'l')},
        p AS (SELECT b.seed, {', '.join(f'b.{k}' for k in names)}, b.metric, b.value AS baseline, q.value AS candidate FROM l b JOIN l q ON {on} AND b.seed = q.seed AND b.metric = q.metric WHERE NOT b.late AND q.late {only}),
        d AS (SELECT seed, {by}, avg(baseline) AS baseline, avg(candidate) AS candidate, avg(candidate) - avg(baseline) AS delta FROM p GROUP BY ALL), ns AS (SELECT count(DISTINCT seed) AS seeds FROM d),
        q(df, t) AS (VALUES {', '.join(f'({k}, {v})' for k, v in c.T_95.items())}),
        gs AS (SELECT {by}, count(DISTINCT seed) AS seeds, avg(baseline) AS baseline_mean, avg(candidate) AS candidate_mean, avg(delta) AS delta_mean, coalesce(stddev_samp(delta), 0) AS delta_std, {_UP} AS higher_is_better,
            avg(CASE WHEN {_UP} THEN delta > 0 ELSE delta < 0 END::INT::DOUBLE) AS desired_sign_rate FROM d GROUP BY ALL),
        ci AS (SELECT gs.*, delta_mean - t * delta_std / sqrt(gs.seeds) AS ci_low, delta_mean + t * delta_std / sqrt(gs.seeds) AS ci_high FROM gs JOIN ns USING (seeds) JOIN q ON df = gs.seeds - 1),
        sv AS (SELECT *, CASE WHEN (ci_low > 0 AND higher_is_better) OR (ci_high < 0 AND NOT higher_is_better) THEN 'improved' WHEN (ci_low > 0 AND NOT higher_is_better) OR (ci_high < 0 AND higher_is_better) THEN 'regressed' ELSE 'inconclusive' END AS verdict FROM ci)"""


_SEED_SCENARIO = "AND b.metric IN (" + ", ".join(f"'{x}'" for x in c.SCENARIO_METRICS) + ")"


def _by_seed(spark, d, keys, metrics):
    rows = flat(spark, d).where("case_id IS NOT NULL AND step IS NOT NULL").withColumn("seed", F.nullif(F.regexp_extract("run_id", "-s([0-9]+)-", 1), F.lit("")).cast("int")).where("seed IS NOT NULL")
    if "scenario" in keys:
        rows = rows.where("scenario IS NOT NULL")
    # both halves of a seed in one pass over its rows
    halves = runtime.cut(c.case_metrics(rows.withColumn("late", F.col("step") >= 130), ["seed", "late", *keys]))
    pairs = c.paired_cases(halves.where("NOT late"), halves.where("late"), ["seed", *keys], metrics)
    by = ["seed", *[k for k in keys if k != "case_id"]]
    deltas = runtime.cut(c.paired_means(pairs, by, metrics))
    return c.over_seeds(deltas, [*by[1:], "metric"], deltas.select("seed").distinct().count())  # a handful of seeds


_SEED_ROUND = "baseline_mean candidate_mean delta_mean delta_std desired_sign_rate ci_low ci_high"


@query(f"WITH {_seeds_sql('case_id')} SELECT * FROM sv", _SEED_ROUND)
def multiseed_t_interval(spark, d):
    """Late against early steps of each seed, all metrics, over the seeds."""
    return _by_seed(spark, d, ["case_id"], _PAIRED).drop("seed_deltas")


@query(f"WITH {_seeds_sql('case_id, scenario', _SEED_SCENARIO, 'AND scenario IS NOT NULL')} SELECT * FROM sv", _SEED_ROUND)
def multiseed_scenarios(spark, d):
    return _by_seed(spark, d, ["case_id", "scenario"], list(c.SCENARIO_METRICS)).drop("seed_deltas")


@query()
def multiseed_decision(spark, d):
    """Promotion over seeds: gates as for one comparison, and two thirds of the seeds must go the desired way."""
    return c.decide(_by_seed(spark, d, ["case_id"], _PAIRED), _by_seed(spark, d, ["case_id", "scenario"], list(c.SCENARIO_METRICS)), sign_rate=c.SIGN_RATE)


@query(f"{_verdict_sql(_BASE, 'metric')}, {_decide_sql('vd', '(SELECT NULL::VARCHAR AS scenario, NULL::VARCHAR AS metric, NULL::VARCHAR AS verdict)')}")
def promotion_normal(spark, d):
    """The decision on intervals of 1.96 standard errors, without scenarios."""
    return c.decide(c.compared(_pairs(spark, d, ["case_id"], _PAIRED), [], "case_id", _PAIRED, normal=True))


_RATES = f"{ONCE}, k AS (SELECT case_id, avg(CASE WHEN process THEN 1.0::DOUBLE ELSE 0 END) AS p FROM r WHERE case_id IS NOT NULL GROUP BY case_id HAVING count(*) >= 4), n(target_n) AS (VALUES (1), (2), (4), (8), (16)), j AS (SELECT target_n, avg(1 - pow(1 - p, target_n)) AS success, avg(1 - pow(p, target_n) - pow(1 - p, target_n)) AS mixed FROM k CROSS JOIN n GROUP BY target_n)"


def _rates(spark, d):
    g = rollouts(spark, d).where("case_id IS NOT NULL").groupBy("case_id").agg(F.avg(F.col("process").cast("double")).alias("p"), F.count(F.lit(1)).alias("n"))
    return g.where("n >= 4")


@query(f"WITH {_RATES} SELECT * FROM j", "success mixed")
def success_at_n_projection(spark, d):
    return c.success_at(_rates(spark, d), "p", _SIZES)


_NOW = 4


@query(f"""WITH {_RATES}, w AS (SELECT target_n, success - lag(success) OVER (ORDER BY target_n) AS a, mixed - lag(mixed) OVER (ORDER BY target_n) AS b FROM j WHERE target_n >= {_NOW}), f AS (SELECT * FROM w WHERE a >= 0.03 AND b >= 0.05 ORDER BY target_n LIMIT 1)
    SELECT CASE WHEN count(*) > 0 THEN 'run_rollout_ablation' ELSE 'keep_current_n' END AS action, CAST(coalesce(min(target_n), {_NOW}) AS INTEGER) AS recommended_n, coalesce(min(target_n), {_NOW}) / {_NOW}::DOUBLE AS cost_multiplier, min(a) AS success_gain, min(b) AS mixed_gain FROM f""", "success_gain mixed_gain")
def budget_recommendation(spark, d):
    """From groups of four on."""
    return c.recommend(c.success_at(_rates(spark, d), "p", _SIZES), _NOW)


@query()
def budget_bootstrap(spark, d):
    return c.budget_bootstrap(_rates(spark, d), "case_id", "p", _SIZES)
