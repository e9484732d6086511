"""Evaluation queries over the rollouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollframe import runtime
from rollframe.functions import text
from rollframe.operators import metrics as m
from rollframe.plans.base import registering

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registering(QUERIES, SQL)


#: The rollouts as the SQL sees them: once each, spelled alike, with the success flags.
ONCE = r"""
    v AS (SELECT DISTINCT ON (rollout_id) rollout_id, run_id, step, output, environment_reward, final_action_correct, tool_results_support_final, tool_result_conflict, repeated_tool_call, tool_order_violation, eligibility_before_slots_complete,
            material_check_called, risk_check_called, unsafe_submit, illegal_action_attempt_rate, trailing_action_rate, premature_submit, missing_required_tool, score, reward, hard_gate, required_tool_rate, process_compliant, judge_used, judge_score, judge_clarity,
            judge_professionalism, rounds, illegal_action_count, trailing_action_count, parsed_action_count, split, matter_id,
            nullif(trim(regexp_replace(lower(case_id), '[^\p{L}\p{N}]+', '_', 'g'), '_'), '') AS case_id, nullif(lower(trim(scenario_type)), '') AS scenario,
            CASE WHEN NOT isnan(environment_reward) THEN environment_reward END AS reward_value, coalesce(final_action_correct, 0) > 0 AS final
          FROM rollouts),
    s AS (SELECT *, final AND coalesce(hard_gate, 0) = 0 AS safe FROM v),
    r AS (SELECT *, safe AND coalesce(process_compliant, CAST(required_tool_rate >= 1 AS DOUBLE), 0) >= 1 AS process FROM s)"""

_LEVEL = """
    c AS (SELECT {keys} case_id, count(*) AS n, count(CASE WHEN final THEN 1 END) AS c_final, count(CASE WHEN safe THEN 1 END) AS c_safe, count(CASE WHEN process THEN 1 END) AS c_process,
                 stddev_pop(reward_value) AS sd, sum(reward_value) AS rs, count(reward_value) AS rn FROM r WHERE case_id IS NOT NULL GROUP BY {keys} case_id)"""
_METRICS = """
    count(*) AS case_count, CAST(sum(n) AS BIGINT) AS row_count, sum(c_final) / CAST(sum(n) AS DOUBLE) AS pass_at_1, sum(c_safe) / CAST(sum(n) AS DOUBLE) AS safe_pass_at_1,
    sum(c_process) / CAST(sum(n) AS DOUBLE) AS process_pass_at_1, avg(CASE WHEN c_final > 0 THEN 1.0::DOUBLE ELSE 0 END) AS pass_at_k, avg(CASE WHEN c_safe > 0 THEN 1.0::DOUBLE ELSE 0 END) AS safe_pass_at_k,
    avg(CASE WHEN c_process > 0 THEN 1.0::DOUBLE ELSE 0 END) AS process_pass_at_k, sum(rs) / nullif(sum(rn), 0) AS mean_reward, avg(sd) AS group_reward_std,
    avg(CASE WHEN sd > 1e-12 THEN 1.0::DOUBLE ELSE 0 END) AS informative_group_rate, CAST(sum(CASE WHEN sd > 1e-12 THEN n ELSE 0 END) AS BIGINT) AS informative_trajectories"""


_DOUBLES = "pass_at_1 safe_pass_at_1 process_pass_at_1 pass_at_k safe_pass_at_k process_pass_at_k mean_reward group_reward_std informative_group_rate"


#: The tool of the rollouts.
TOOL = "government_service"


def rollouts(spark: SparkSession, sf_dir: str, derive: dict | None = None) -> DataFrame:
    return m.once(runtime.table(spark, sf_dir, "rollouts"), derive)


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.flat(runtime.table(spark, sf_dir, "rollouts"), TOOL)


@query(f"WITH {ONCE}, {_LEVEL.format(keys='scenario,')} SELECT scenario, {_METRICS} FROM c GROUP BY scenario", _DOUBLES)
def pass_at_k_by_scenario(spark, d):
    return m.evaluation(rollouts(spark, d), ["scenario"])


@query(f"WITH {ONCE}, {_LEVEL.format(keys='')} SELECT {_METRICS} FROM c", _DOUBLES)
def pass_at_k_overall(spark, d):
    return m.evaluation(rollouts(spark, d), [])


@query(f"WITH {ONCE}, {_LEVEL.format(keys='scenario,')} SELECT scenario, grouping(scenario) = 1 AS is_total, {_METRICS} FROM c GROUP BY GROUPING SETS ((scenario), ())", _DOUBLES)
def scenario_grouping_sets(spark, d):
    return m.evaluation_sets(rollouts(spark, d), "scenario")


@query(f"WITH {ONCE}, {_LEVEL.format(keys='run_id, step,')} SELECT run_id, step, {_METRICS} FROM c GROUP BY run_id, step", _DOUBLES)
def step_metrics(spark, d):
    return m.evaluation(rollouts(spark, d), ["run_id", "step"])


@query(f"WITH {ONCE}, {_LEVEL.format(keys='run_id, step, scenario,')} SELECT run_id, step, scenario, {_METRICS} FROM c GROUP BY run_id, step, scenario", _DOUBLES)
def scenario_step_metrics(spark, d):
    return m.evaluation(rollouts(spark, d), ["run_id", "step", "scenario"])


@query(f"""WITH {ONCE}, c AS (SELECT scenario, case_id, count(*) AS n FROM r WHERE case_id IS NOT NULL GROUP BY ALL)
    SELECT scenario, count(*) AS cases, CAST(sum(n) AS BIGINT) AS rollouts, array_to_string(list_sort(list(DISTINCT n)), ',') AS group_sizes FROM c GROUP BY scenario""")
def group_sizes(spark, d):
    c = rollouts(spark, d).where("case_id IS NOT NULL").groupBy("scenario", "case_id").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("scenario").agg(F.count(F.lit(1)).alias("cases"), F.sum("n").alias("rollouts"), F.array_join(F.array_sort(F.collect_set("n")), ",").alias("group_sizes"))


_MEANS = ["hard_gate", "required_tool_rate", "process_compliant", "illegal_action_count", "trailing_action_count", "rounds"]


@query(f"WITH {ONCE} SELECT scenario, {', '.join(f'avg(coalesce({c}, 0)) AS {c}' for c in _MEANS)} FROM r GROUP BY scenario", " ".join(_MEANS))
def column_means_with_default(spark, d):
    return m.means_with_default(rollouts(spark, d), ["scenario"], _MEANS)


@query(f"""WITH {ONCE} SELECT run_id, step, avg(rounds) AS rounds, avg(score) AS score, avg(CASE WHEN judge_score >= 0 THEN judge_score END) AS judge_score,
    avg(CASE WHEN judge_clarity >= 0 THEN judge_clarity END) AS judge_clarity, avg(CASE WHEN judge_professionalism >= 0 THEN judge_professionalism END) AS judge_professionalism FROM r GROUP BY run_id, step""", "rounds score judge_score judge_clarity judge_professionalism")
def mean_over_present(spark, d):
    judged = ("judge_score", "judge_clarity", "judge_professionalism")
    return m.means_of_present(rollouts(spark, d), ["run_id", "step"], ["rounds", "score", *judged], judged)


@query(f"WITH {ONCE} SELECT run_id, avg(CASE WHEN judge_used > 0 AND judge_score >= 0 THEN judge_score END) AS judged_score, count(CASE WHEN judge_used > 0 AND judge_score >= 0 THEN 1 END) AS judged FROM r GROUP BY run_id", "judged_score")
def judged_score(spark, d):
    ok = (F.col("judge_used") > 0) & (F.col("judge_score") >= 0)
    return rollouts(spark, d).groupBy("run_id").agg(F.avg(F.when(ok, F.col("judge_score"))).alias("judged_score"), F.count_if(ok).alias("judged"))


@query(f"WITH {ONCE} SELECT run_id, avg(coalesce(reward_value, reward, score, 0)) AS evaluation_reward, avg(coalesce(reward_value, score, 0)) AS export_reward FROM r GROUP BY run_id", "evaluation_reward export_reward")
def fallback_reward(spark, d):
    v = m.value
    return rollouts(spark, d).groupBy("run_id").agg(
        F.avg(F.coalesce(F.col("reward_value"), v("reward"), v("score"), F.lit(0.0))).alias("evaluation_reward"), F.avg(F.coalesce(F.col("reward_value"), v("score"), F.lit(0.0))).alias("export_reward")
    )


@query(f"WITH {ONCE} SELECT split, count(CASE WHEN final THEN 1 END) AS final, count(CASE WHEN safe THEN 1 END) AS safe, count(CASE WHEN process THEN 1 END) AS process, count(*) AS n FROM r GROUP BY split")
def success_predicates(spark, d):
    return rollouts(spark, d).groupBy("split").agg(*[F.count_if(c).alias(c) for c in ("final", "safe", "process")], F.count(F.lit(1)).alias("n"))


@query(rf"""WITH {ONCE}, x AS (SELECT scenario, case_id, trim(regexp_replace(coalesce(output, ''), '[\s\x1c-\x1f\x85\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')) AS o FROM r WHERE case_id IS NOT NULL),
    c AS (SELECT scenario, case_id, count(*) AS n, count(DISTINCT o) AS kinds FROM x GROUP BY ALL)
    SELECT scenario, avg(kinds / CAST(n AS DOUBLE)) AS unique_output_rate, avg(CASE WHEN n > 1 AND kinds = 1 THEN 1.0::DOUBLE ELSE 0 END) AS identical_group_rate FROM c GROUP BY scenario""", "unique_output_rate identical_group_rate")
def output_diversity(spark, d):
    return m.output_diversity(rollouts(spark, d, {"output_hash": m.output_hash()}), ["scenario"])


@query(f"""WITH {ONCE}, x AS (SELECT run_id, length(output) AS l, reward_value AS o, rollout_id FROM r WHERE output IS NOT NULL AND reward_value IS NOT NULL),
    y AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY l, rollout_id) AS rn, count(*) OVER (PARTITION BY run_id) AS n FROM x)
    SELECT run_id, avg(l) AS mean_length, CASE WHEN stddev_pop(l) > 0 AND stddev_pop(o) > 0 THEN covar_pop(l, o) / (stddev_pop(l) * stddev_pop(o)) ELSE 0 END AS length_correlation,
        avg(CASE WHEN rn <= greatest(1, n // 4) THEN o END) AS shortest_quarter, avg(CASE WHEN rn > n - greatest(1, n // 4) THEN o END) AS longest_quarter FROM y GROUP BY run_id""", "mean_length length_correlation shortest_quarter longest_quarter")
def length_reward_bias(spark, d):
    return m.length_bias(rollouts(spark, d, {"chars": F.length("output")}), ["run_id"], F.col("chars"), "reward_value", "rollout_id")


CALLS = r"""b AS (SELECT rollout_id, run_id, unnest(regexp_extract_all(output, '(?is)<tool_call>\s*(.*?)\s*</tool_call>', 1)) AS block FROM r),
    j AS (SELECT *, CASE WHEN json_valid(block) THEN CASE WHEN json_type(block) = 'OBJECT' THEN block END END AS o FROM b),
    h AS (SELECT rollout_id, run_id, CASE WHEN list_contains(json_keys(o), 'name') THEN o WHEN json_type(o, '$.function') = 'OBJECT' THEN json_extract(o, '$.function') END AS f FROM j),
    a AS (SELECT *, CASE json_type(f, '$.arguments') WHEN 'OBJECT' THEN json_extract(f, '$.arguments') WHEN 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(f, '$.arguments')) THEN CASE WHEN json_type(json_extract_string(f, '$.arguments')) = 'OBJECT' THEN json_extract_string(f, '$.arguments')::JSON END END END AS args FROM h),
    k AS (SELECT rollout_id, run_id, f IS NOT NULL AND json_extract_string(f, '$.name') IS DISTINCT FROM 'government_service' AS wrong_name, f IS NULL OR args IS NULL OR NOT list_contains(json_keys(args), 'action') AS malformed, upper(trim(json_extract_string(args, '$.action'))) AS action FROM a)"""


@query(f"WITH {ONCE}, {CALLS} SELECT run_id, coalesce(action, '(none)') AS action, count(*) AS calls, count(*) / CAST(sum(count(*)) OVER (PARTITION BY run_id) AS DOUBLE) AS share FROM k GROUP BY run_id, coalesce(action, '(none)')")
def action_distribution(spark, d):
    """Histogram of the actions and their shares in a run; the totals are of the few rows per run that are left."""
    from pyspark.sql import Window

    e = m.calls(runtime.table(spark, d, "rollouts"), ["run_id"], TOOL)
    h = e.groupBy("run_id", F.coalesce("action", F.lit("(none)")).alias("action")).agg(F.count(F.lit(1)).alias("calls"))
    return h.withColumn("share", F.col("calls") / F.sum("calls").over(Window.partitionBy("run_id")))


@query(f"""WITH {ONCE}, {CALLS} SELECT run_id, count(*) AS calls, count(CASE WHEN wrong_name THEN 1 END) / CAST(greatest(1, count(*)) AS DOUBLE) AS invalid_name_rate,
    count(CASE WHEN malformed THEN 1 END) / CAST(greatest(1, count(*)) AS DOUBLE) AS malformed_rate FROM k GROUP BY run_id""")
def tool_call_stats(spark, d):
    n = F.count(F.lit(1))
    return m.calls(runtime.table(spark, d, "rollouts"), ["run_id"], TOOL).groupBy("run_id").agg(n.alias("calls"), m.ratio(F.count_if("wrong_name"), n).alias("invalid_name_rate"), m.ratio(F.count_if("malformed"), n).alias("malformed_rate"))


@query(f"""WITH {ONCE} SELECT run_id, sum(trailing_action_count) / greatest(1, sum(parsed_action_count)) AS trailing_rate, sum(illegal_action_count) / greatest(1, sum(parsed_action_count)) AS illegal_rate FROM r GROUP BY run_id""")
def ratio_of_sums(spark, d):
    return rollouts(spark, d).groupBy("run_id").agg(
        m.ratio(F.sum("trailing_action_count"), F.sum("parsed_action_count")).alias("trailing_rate"), m.ratio(F.sum("illegal_action_count"), F.sum("parsed_action_count")).alias("illegal_rate")
    )


@query(f"""WITH {ONCE}, g AS (SELECT run_id, step, case_id, avg(reward_value) AS mu, stddev_pop(reward_value) AS sd FROM r WHERE case_id IS NOT NULL GROUP BY ALL)
    SELECT r.rollout_id, CASE WHEN sd > 1e-12 THEN round((reward_value - mu) / sd, 9) WHEN reward_value IS NOT NULL THEN 0 END AS advantage FROM r JOIN g USING (run_id, step, case_id)""")
def group_advantages(spark, d):
    rows = rollouts(spark, d).where("case_id IS NOT NULL").select("rollout_id", "run_id", "step", "case_id", "reward_value")
    return m.advantages(rows, ["run_id", "step", "case_id"], "reward_value").select("rollout_id", F.round("advantage", 9).alias("advantage"))


@query(f"WITH {ONCE} SELECT scenario, matter_id, count(*) AS n FROM r GROUP BY scenario, matter_id")
def nested_value_counts(spark, d):
    return rollouts(spark, d).groupBy("scenario", "matter_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ONCE}, t AS (SELECT count(DISTINCT run_id) AS runs, max(step) AS last_step FROM r)
    SELECT run_id, step, count(*) AS rollouts, any_value(runs) AS runs, any_value(last_step) AS last_step FROM r CROSS JOIN t GROUP BY run_id, step""")
def scalars_on_every_step(spark, d):
    rows = rollouts(spark, d)
    t = rows.agg(F.count_distinct("run_id").alias("runs"), F.max("step").alias("last_step"))
    return rows.groupBy("run_id", "step").agg(F.count(F.lit(1)).alias("rollouts")).crossJoin(F.broadcast(t))  # one row


@query(f"""WITH {ONCE}, x AS (SELECT rollout_id, regexp_matches(coalesce(output, ''), '(?is)<tool_call>\\s*(.*?)\\s*</tool_call>') AS has_block, contains(coalesce(output, ''), '{{') AS has_brace FROM r)
    SELECT has_block, count(*) AS rollouts FROM x GROUP BY has_block""")
def outputs_with_blocks(spark, d):
    """How many outputs have closed blocks; only the others are searched for bare JSON calls."""
    rows = rollouts(spark, d, {"has_block": F.size(F.coalesce(m.text.tool_blocks(F.col("output")), F.array())) > 0})
    return rows.groupBy("has_block").agg(F.count(F.lit(1)).alias("rollouts"))


@query(f"WITH {ONCE}, {CALLS} SELECT run_id, rollout_id, count(*) AS calls, count(CASE WHEN malformed THEN 1 END) AS malformed FROM k GROUP BY ALL")
def tool_call_extract(spark, d):
    """The calls of each rollout: closed blocks, else bare JSON objects that look like calls (none of the test outputs has any)."""
    rows = rollouts(spark, d, {"acts": m.actions(F.col("output"), TOOL)}).where(F.size("acts") > 0)
    return rows.select("run_id", "rollout_id", F.size("acts").cast("long").alias("calls"), F.size(F.filter("acts", lambda c: c["malformed"])).cast("long").alias("malformed"))


_SPREAD = f"WITH {ONCE}, g AS (SELECT run_id, step, case_id, coalesce(stddev_pop(reward_value), 0) AS sd, count(*) AS n FROM r WHERE case_id IS NOT NULL GROUP BY ALL)"


@query(f"{_SPREAD} SELECT run_id, step, case_id, n, sd AS reward_std FROM g", "reward_std")
def group_reward_std(spark, d):
    return m.group_spread(rollouts(spark, d), ["run_id", "step"])


@query(f"""{_SPREAD} SELECT run_id, step, count(*) AS groups, count(CASE WHEN sd > 1e-12 THEN 1 END) AS informative, count(CASE WHEN sd > 1e-12 THEN 1 END) / CAST(count(*) AS DOUBLE) AS informative_rate, count(CASE WHEN sd <= 1e-12 THEN 1 END) / CAST(count(*) AS DOUBLE) AS zero_variance_rate,
    CAST(sum(CASE WHEN sd > 1e-12 THEN n ELSE 0 END) AS BIGINT) AS informative_trajectories FROM g GROUP BY run_id, step""", "informative_rate zero_variance_rate")
def informative_groups(spark, d):
    return m.informative(m.group_spread(rollouts(spark, d), ["run_id", "step"]), ["run_id", "step"])


@query(f"""WITH {ONCE} SELECT run_id, sum(CASE WHEN coalesce(missing_required_tool, 0) > 0 AND regexp_matches(lower(coalesce(output, '')), '"(submit|refuse)"') THEN 1 ELSE 0 END)
    / CAST(greatest(1, sum(CASE WHEN regexp_matches(lower(coalesce(output, '')), '"(submit|refuse)"') THEN 1 ELSE 0 END)) AS DOUBLE) AS missing_tool_final_rate FROM r GROUP BY run_id""", "missing_tool_final_rate")
def missing_tool_final_rate(spark, d):
    """Of the outputs with a final action the share in which a required tool was never called."""
    rows = rollouts(spark, d, {"has_final": F.rlike(F.lower(F.coalesce("output", F.lit(""))), F.lit('"(submit|refuse)"'))})
    final = F.col("has_final")
    return rows.groupBy("run_id").agg(m.ratio(F.count_if(final & (F.coalesce(m.value("missing_required_tool"), F.lit(0.0)) > 0)), F.count_if(final)).alias("missing_tool_final_rate"))
