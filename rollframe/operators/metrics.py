"""Success, reward and diversity metrics of rollouts: one row per rollout in, one row per group out.

All group metrics are two aggregations, case within group and then group; both combine on the map side, so a case that
holds a third of all rows is one row per task before the shuffle."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollframe.functions import text


def value(c) -> Column:
    """A number, or null where it is null or NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def once(rollouts: DataFrame, derive: dict[str, Column] | None = None) -> DataFrame:
    """Each rollout_id once, with case_id and scenario in one spelling and the success flags.

    final: the final action is right; safe: final and no hard gate; process: safe and compliant, which falls back to
    required_tool_rate >= 1 where the flag is missing. Nulls count as not successful.
    derive: columns worked out of the rows before that; with them the output is left out, so that no text is shuffled to
    find the repeats, only what is needed of it."""
    rows = rollouts.withColumns(derive).drop("output") if derive else rollouts
    rows = rows.dropDuplicates(["rollout_id"])
    final = F.coalesce(value("final_action_correct"), F.lit(0.0)) > 0
    safe = final & (F.coalesce(value("hard_gate"), F.lit(0.0)) == 0)
    compliant = F.coalesce(value("process_compliant"), (value("required_tool_rate") >= 1).cast("double"), F.lit(0.0)) >= 1
    return rows.withColumns(
        {
            "case_id": text.canonical_id("case_id"),
            "scenario": text.label("scenario_type"),
            "reward_value": value("environment_reward"),
            "final": final,
            "safe": safe,
            "process": safe & compliant,
        }
    )


def output_hash() -> Column:
    """8 bytes for an output; white space does not make a difference, null is like ''."""
    return F.xxhash64(F.coalesce(text.squeeze_space("output"), F.lit("")))


def flat(rollouts: DataFrame, tool: str) -> DataFrame:
    """once, with what comparisons need of the output in place of it: output_hash, calls, wrong_names, malformed."""
    listed = call_list(F.col("output"), tool)
    n = lambda flag: F.size(F.filter("_calls", lambda c: c[flag]))
    rows = rollouts.withColumns({"output_hash": output_hash(), "_calls": F.coalesce(listed, F.array())})
    rows = rows.withColumns({"calls": F.size("_calls"), "wrong_names": n("wrong_name"), "malformed": n("malformed")}).drop("_calls", "output")
    return once(rows)


def per_case(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First level: per keys and case the number of rollouts, of each success, and the spread of the reward."""
    n = lambda c: F.count_if(c)
    return (
        rows.where(F.col("case_id").isNotNull())
        .groupBy(*keys, "case_id")
        .agg(
            F.count(F.lit(1)).alias("n"), n("final").alias("c_final"), n("safe").alias("c_safe"), n("process").alias("c_process"),
            F.stddev_pop("reward_value").alias("reward_std"), F.sum("reward_value").alias("reward_sum"), F.count("reward_value").alias("reward_n"),
        )
    )


def two_level(cases: DataFrame) -> list[Column]:
    """Second level over per_case: pass@1, pass@k and dispersion."""
    k = lambda c: F.avg((F.col(c) > 0).cast("double"))
    one = lambda c: F.sum(c) / F.sum("n")
    informative = F.coalesce(F.col("reward_std") > 1e-12, F.lit(False))
    return [
        F.count(F.lit(1)).alias("case_count"), F.sum("n").alias("row_count"),
        one("c_final").alias("pass_at_1"), one("c_safe").alias("safe_pass_at_1"), one("c_process").alias("process_pass_at_1"),
        k("c_final").alias("pass_at_k"), k("c_safe").alias("safe_pass_at_k"), k("c_process").alias("process_pass_at_k"),
        F.try_divide(F.sum("reward_sum"), F.sum("reward_n")).alias("mean_reward"), F.avg("reward_std").alias("group_reward_std"),
        F.avg(informative.cast("double")).alias("informative_group_rate"), F.sum(F.when(informative, F.col("n")).otherwise(0)).alias("informative_trajectories"),
    ]


def evaluation(rows: DataFrame, keys: list[str]) -> DataFrame:
    cases = per_case(rows, keys)
    return cases.groupBy(*keys).agg(*two_level(cases))


def evaluation_sets(rows: DataFrame, key: str) -> DataFrame:
    """The metrics per key and over all, in one pass with grouping sets; over all: the key is null and is_total true."""
    cases = per_case(rows, [key])
    return cases.groupingSets([[key], []], key).agg(*two_level(cases), F.grouping(key).cast("boolean").alias("is_total"))


def output_diversity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over cases of distinct outputs / outputs, and share of cases with several outputs that are all the same.

    rows: once, with output_hash derived, so that texts are shuffled as 8 bytes."""
    each = rows.where(F.col("case_id").isNotNull()).groupBy(*keys, "case_id", "output_hash").agg(F.count(F.lit(1)).alias("_n"))
    cases = each.groupBy(*keys, "case_id").agg(F.count(F.lit(1)).alias("kinds"), F.sum("_n").alias("n"))
    same = (F.col("n") > 1) & (F.col("kinds") == 1)
    return cases.groupBy(*keys).agg(F.avg(F.col("kinds") / F.col("n")).alias("unique_output_rate"), F.avg(same.cast("double")).alias("identical_group_rate"))


def means_with_default(rows: DataFrame, keys: list[str], columns: list[str], default: float = 0.0) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.avg(F.coalesce(value(c), F.lit(default))).alias(c) for c in columns])


def means_of_present(rows: DataFrame, keys: list[str], columns: list[str], absent_below_zero: tuple[str, ...] = ()) -> DataFrame:
    """Means over the values that are there; of columns in absent_below_zero, negative values mark absence."""
    pick = lambda c: F.when(value(c) >= 0, value(c)) if c in absent_below_zero else value(c)
    return rows.groupBy(*keys).agg(*[F.avg(pick(c)).alias(c) for c in columns])


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows with both values; 0 where either does not vary."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.coalesce(F.when((sx > 0) & (sy > 0), F.covar_pop(x, y) / (sx * sy)), F.lit(0.0))


def length_bias(rows: DataFrame, keys: list[str], length: Column, outcome: str, tie: str) -> DataFrame:
    """Correlation of length and outcome, and the mean outcome of the shortest and the longest quarter (at least one row).

    The quarter's bounds come from a count per length, so that no group is sorted in one task; only rows of the two
    boundary lengths are ranked by the tie column."""
    rows = rows.select(*keys, length.alias("_len"), F.col(outcome).alias("_out"), F.col(tie).alias("_tie")).where(F.col("_len").isNotNull() & F.col("_out").isNotNull())
    per_len = rows.groupBy(*keys, "_len").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    per_len = per_len.withColumns({"_upto": F.sum("_n").over(w.orderBy("_len")), "_all": F.sum("_n").over(w)})
    per_len = per_len.withColumns({"_below": F.col("_upto") - F.col("_n"), "_q": F.greatest(F.lit(1), F.floor(F.col("_all") / 4))})
    at = rows.join(per_len, [*keys, "_len"])
    rank = F.row_number().over(Window.partitionBy(*keys, "_len").orderBy("_tie"))
    cut_low = (F.col("_below") < F.col("_q")) & (F.col("_upto") > F.col("_q"))
    cut_high = (F.col("_below") < F.col("_all") - F.col("_q")) & (F.col("_upto") > F.col("_all") - F.col("_q"))
    edge = at.where(cut_low | cut_high).withColumn("_rank", F.col("_below") + rank)
    inner = at.where(~(cut_low | cut_high)).withColumn("_rank", F.when(F.col("_upto") <= F.col("_q"), F.col("_upto")).otherwise(F.col("_below") + 1))
    both = inner.unionByName(edge)
    low, high = F.col("_rank") <= F.col("_q"), F.col("_rank") > F.col("_all") - F.col("_q")
    return both.groupBy(*keys).agg(
        F.avg("_len").alias("mean_length"),
        correlation(F.col("_len").cast("double"), F.col("_out")).alias("length_correlation"),
        F.avg(F.when(low, F.col("_out"))).alias("shortest_quarter"),
        F.avg(F.when(high, F.col("_out"))).alias("longest_quarter"),
    )


#: The actions of the tool protocol.
ACTIONS = ("ASK_USER", "POLICY_SEARCH", "ELIGIBILITY_CHECK", "MATERIAL_CHECK", "RISK_CHECK", "SUBMIT", "REFUSE")


def call_list(output: Column, tool: str) -> Column:
    """The closed tool-call blocks of an output as an array of (name, action in upper case, malformed, wrong_name).

    Malformed: no JSON object, neither name nor function in it, or arguments (an object, or a text holding one) without
    action. wrong_name: it names another tool; a wrong name and bad arguments both count."""

    # step by step: what one step works out is a value for the next, where a single expression would parse it again each time
    at = F.try_variant_get
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    parsed = F.transform(text.tool_blocks(output), lambda b: F.struct(F.try_parse_json(b).alias("v")))
    parts = F.transform(parsed, lambda x: F.struct(x["v"].alias("v"), at(x["v"], "$.name", "variant").isNotNull().alias("direct"), at(x["v"], "$.function", "variant").alias("inner")))
    told = F.transform(parts, lambda x: F.when(x["direct"], x["v"]).when(x["inner"].isNotNull() & is_object(x["inner"]), x["inner"]))
    named = F.transform(told, lambda f: F.struct(f.isNotNull().alias("named"), at(f, "$.name", "string").alias("name"), at(f, "$.arguments", "variant").alias("args"), at(f, "$.arguments.action", "variant").alias("inside")))
    # arguments given as a text that holds an object
    ready = F.transform(named, lambda x: F.struct(x["named"].alias("named"), x["name"].alias("name"), F.when(x["inside"].isNotNull(), x["inside"]).otherwise(at(F.try_parse_json(at(x["args"], "$", "string")), "$.action", "variant")).alias("action")))
    return F.transform(
        ready,
        lambda x: F.struct(
            x["name"].alias("name"), F.when(x["named"], F.upper(F.trim(at(x["action"], "$", "string")))).alias("action"), (~x["named"] | x["action"].isNull()).alias("malformed"), (x["named"] & ~x["name"].eqNullSafe(F.lit(tool))).alias("wrong_name")
        ),
    )


def calls(rollouts: DataFrame, keep: list[str], tool: str) -> DataFrame:
    """One row per closed tool-call block of each rollout: keep columns, call_no, name, action, malformed, wrong_name."""
    rows = once(rollouts, {"_calls": call_list(F.col("output"), tool)})
    return rows.select(*keep, F.posexplode("_calls").alias("call_no", "c")).select(*keep, "call_no", "c.*")


def actions(output: Column, tool: str) -> Column:
    """The calls of an output: those of its closed blocks, or where there is no block the JSON objects that stand in the
    text and look like a call (unparsable braces are passed over). Only outputs of the second kind go through Python."""

    @F.pandas_udf("array<struct<name: string, action: string, malformed: boolean, wrong_name: boolean>>")
    def bare(outputs: pd.Series, tools: pd.Series) -> pd.Series:
        return pd.Series([None if o is None else text.bare_calls(o, t) for o, t in zip(outputs, tools)])

    blocks = text.tool_blocks(output)
    loose = F.when((F.size(blocks) == 0) & F.contains(output, F.lit("{")), output)
    return F.when(F.size(blocks) > 0, call_list(output, tool)).otherwise(F.coalesce(bare(loose, F.lit(tool)), F.array()))


def ratio(a: Column, b: Column) -> Column:
    """Ratio of sums; the denominator is at least 1."""
    return a / F.greatest(F.lit(1), b)


def advantages(rows: DataFrame, group: list[str], outcome: str) -> DataFrame:
    """Outcome centred and scaled within its group; 0 where the group does not vary. The group's statistics are joined
    back, so that no group is gathered in one task."""
    stats = rows.groupBy(*group).agg(F.avg(outcome).alias("_m"), F.stddev_pop(outcome).alias("_s"))
    on = rows.join(stats, group)
    return on.withColumn("advantage", F.when(F.col("_s") > 1e-12, (F.col(outcome) - F.col("_m")) / F.col("_s")).when(F.col(outcome).isNotNull(), 0.0)).drop("_m", "_s")


def group_spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, case_id, n, reward_std): the spread of the reward in each case's group; 0 without a reward."""
    g = rows.where(F.col("case_id").isNotNull()).groupBy(*keys, "case_id")
    return g.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.stddev_pop("reward_value"), F.lit(0.0)).alias("reward_std"))


def informative(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Of group_spread, per keys: groups, those whose rewards differ, both rates and the rollouts in informative groups.

    Over no groups at all (keys is empty and there are no rows) the informative rate is 0 and that of zero variance 1."""
    differs = F.col("reward_std") > 1e-12
    n = F.count(F.lit(1))
    return groups.groupBy(*keys).agg(
        n.alias("groups"), F.count_if(differs).alias("informative"), ratio(F.count_if(differs), n).alias("informative_rate"), F.when(n > 0, F.count_if(~differs) / n).otherwise(1.0).alias("zero_variance_rate"),
        F.coalesce(F.sum(F.when(differs, F.col("n")).otherwise(0)), F.lit(0)).alias("informative_trajectories"),
    )
