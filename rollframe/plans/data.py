"""Queries on cases, documents, scalars and event logs: checks, curriculum, dialogues, sequences, functions, round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollframe import runtime
from rollframe.functions import text
from rollframe.operators import curriculum as cu
from rollframe.operators import dialogue as dl
from rollframe.operators import metrics
from rollframe.operators import quality as q
from rollframe.operators import sequences as sq
from rollframe.plans.base import registering
from rollframe.plans.evaluation import ONCE, rollouts
from rollframe.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registering(QUERIES, SQL)

_CASES = "c AS (SELECT DISTINCT ON (case_id) * FROM cases)"


def cases(spark, d):
    return runtime.table(spark, d, "cases").dropDuplicates(["case_id"])


# --- coverage, duplicates, leakage, audits

_COVER = f"""{ONCE}, a AS (SELECT case_id, count(*) AS n FROM r GROUP BY case_id), e AS (SELECT DISTINCT case_id FROM cases WHERE case_id IS NOT NULL),
    f AS (SELECT coalesce(e.case_id, a.case_id) AS case_id, coalesce(n, 0) AS n, CASE WHEN e.case_id IS NULL AND a.case_id IS NULL THEN 'empty_id' WHEN e.case_id IS NULL THEN 'unknown'
          WHEN a.n IS NULL THEN 'missing' WHEN n <> 4 THEN 'wrong_count' END AS status FROM e FULL JOIN a ON e.case_id = a.case_id)"""


@query(f"WITH {_COVER} SELECT case_id, status, n FROM f WHERE status IS NOT NULL")
def coverage_full_outer(spark, d):
    return q.coverage(runtime.table(spark, d, "cases"), rollouts(spark, d), "case_id", 4)


@query(f"WITH {_COVER}, g AS (SELECT status, case_id, row_number() OVER (PARTITION BY status ORDER BY case_id NULLS FIRST) AS rn, count(*) OVER (PARTITION BY status) AS total FROM f WHERE status IS NOT NULL) SELECT status, any_value(total) AS total, coalesce(string_agg(case_id, ',' ORDER BY case_id), '') AS first FROM g WHERE rn <= 10 GROUP BY status")
def coverage_report(spark, d):
    return q.first_of_each(q.coverage(runtime.table(spark, d, "cases"), rollouts(spark, d), "case_id", 4), "status", "case_id", 10)


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def missing_cases(spark, d):
    return runtime.table(spark, d, "orders").select("o_orderkey").join(runtime.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query(f"WITH {ONCE} SELECT count(*) AS records, count(DISTINCT rollout_id) AS ids, count(CASE WHEN rollout_id IS NULL THEN 1 END) AS empty_ids, count(DISTINCT step) AS steps, min(step) AS first_step, max(step) AS last_step FROM r")
def snapshot_check(spark, d):
    return q.snapshot(rollouts(spark, d), "rollout_id", "step")


@query("SELECT rollout_id, count(*) AS n FROM rollouts GROUP BY rollout_id HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return q.repeated(runtime.table(spark, d, "rollouts"), "rollout_id")


@query("SELECT text, count(DISTINCT doc_kind) AS splits, min(doc_kind) AS first_split, max(doc_kind) AS last_split FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT doc_kind) > 1")
def split_leakage(spark, d):
    return q.crossing(runtime.table(spark, d, "documents"), "text", "doc_kind")


@query(f"""WITH {_CASES}, x AS (SELECT matter_id, scenario_type, coalesce(user_request, '') AS visible, coalesce(user_request, '') || '|' || coalesce(visible_slots, '') AS whole FROM c)
    SELECT matter_id, scenario_type, grouping(matter_id) = 1 AS is_total, count(*) AS n, count(DISTINCT visible) AS visible, count(DISTINCT whole) AS whole, count(DISTINCT visible) / CAST(count(*) AS DOUBLE) AS visible_rate,
        count(DISTINCT whole) / CAST(count(*) AS DOUBLE) AS whole_rate FROM x GROUP BY GROUPING SETS ((matter_id, scenario_type), ())""", "visible_rate whole_rate")
def diversity_audit(spark, d):
    whole = F.concat(F.coalesce("user_request", F.lit("")), F.lit("|"), F.coalesce("visible_slots", F.lit("")))
    return q.diversity(cases(spark, d), ["matter_id", "scenario_type"], {"visible": F.col("user_request"), "whole": whole})


@query(f"WITH {_CASES} SELECT case_id FROM c WHERE len(coalesce(reference_actions, [])) < 1 OR list_last(reference_actions) IS DISTINCT FROM expected_result.final_action")
def reference_path_violations(spark, d):
    return q.broken_paths(cases(spark, d), "reference_actions", F.col("expected_result.final_action")).select("case_id")


@query(f"""WITH {_CASES}, s AS (SELECT case_id, visible_slots, unnest(rules.eligibility_rules) AS rule FROM c),
    k AS (SELECT case_id, rule.operator AS op, TRY_CAST(json_extract_string(visible_slots, '$.' || rule.slot) AS DOUBLE) AS a, TRY_CAST(rule.value AS DOUBLE) AS b FROM s)
    SELECT op, count(*) AS rules, count(CASE WHEN CASE op WHEN '>=' THEN a >= b WHEN '<=' THEN a <= b WHEN '>' THEN a > b WHEN '<' THEN a < b END THEN 1 END) AS holding FROM k WHERE op IN ('>=', '<=', '>', '<') GROUP BY op""")
def operator_in_data(spark, d):
    """Comparisons whose operator is a column: rules against the slots that a case shows."""
    e = cases(spark, d).select("visible_slots", F.explode("rules.eligibility_rules").alias("rule")).where(F.col("rule.operator").isin(">=", "<=", ">", "<"))
    slot = F.try_element_at(F.from_json("visible_slots", "map<string,string>"), F.col("rule.slot"))
    return e.groupBy(F.col("rule.operator").alias("op")).agg(F.count(F.lit(1)).alias("rules"), F.count_if(q.compare_by(slot, F.col("rule.operator"), F.col("rule.value"))).alias("holding"))


@query("SELECT doc_id, sha256(text) AS fingerprint FROM documents WHERE text IS NOT NULL")
def fingerprint_sha256(spark, d):
    return runtime.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("fingerprint"))


@query(r"""WITH x AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL) SELECT count(*) AS rows, sha256(sha256(string_agg(h, chr(10) ORDER BY doc_id))) AS digest FROM x""")
def dataset_digest(spark, d):
    """Up to 100,000 rows, which the SQL is for, there is one part, whose digest is digested again."""
    return q.digest(runtime.table(spark, d, "documents").where("text IS NOT NULL"), ["doc_id"], F.col("text"))


@query(f"""WITH {_CASES}, k AS (SELECT case_id, k, json_extract(hidden_truth, '/' || k) AS x FROM (SELECT case_id, hidden_truth, unnest(json_keys(hidden_truth)) AS k FROM c WHERE json_valid(hidden_truth))),
    i AS (SELECT case_id, k, '{{' || string_agg('"' || y || '":' || json_extract(x, '/' || y)::VARCHAR, ',' ORDER BY y) || '}}' AS t FROM (SELECT *, unnest(json_keys(x)) AS y FROM k WHERE json_type(x) = 'OBJECT') GROUP BY ALL),
    j AS (SELECT case_id, '{{' || string_agg('"' || k || '":' || coalesce(i.t, k.x::VARCHAR), ',' ORDER BY k) || '}}' AS t FROM k LEFT JOIN i USING (case_id, k) GROUP BY case_id)
    SELECT sha256(t) AS fingerprint, count(*) AS n, min(c.case_id) AS first_case FROM c LEFT JOIN j USING (case_id) GROUP BY 1""")
def canonical_fingerprints(spark, d):
    c = cases(spark, d).select("case_id", q.fingerprint("hidden_truth").alias("fingerprint"))
    return c.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("case_id").alias("first_case"))


@query("SELECT n_name, r_name, i FROM nation CROSS JOIN region CROSS JOIN range(0, 3) t(i)")
def case_cross_product(spark, d):
    n, r = runtime.table(spark, d, "nation"), runtime.table(spark, d, "region")
    return n.select("n_name").crossJoin(F.broadcast(r.select("r_name"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))  # 25 x 5 rows


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_join_existing(spark, d):
    return runtime.table(spark, d, "customer").select("c_custkey").join(runtime.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query(f"WITH {ONCE}, b AS (SELECT DISTINCT sha256(coalesce(output, '')) AS key FROM r WHERE run_id LIKE '%-base-%'), x AS (SELECT sha256(coalesce(output, '')) AS key FROM r WHERE run_id LIKE '%-curr-%') SELECT count(*) FILTER (key IN (SELECT key FROM b)) AS hits, count(*) FILTER (key NOT IN (SELECT key FROM b)) AS misses FROM x")
def judge_cache_miss(spark, d):
    rows = rollouts(spark, d).select("run_id", "step", F.sha2(F.coalesce("output", F.lit("")), 256).alias("key"))
    cache = rows.where(F.col("run_id").contains("-base-")).select("key", F.col("run_id").alias("payload"), F.col("step").alias("stored_at"))
    hits, misses = q.cache_split(rows.where(F.col("run_id").contains("-curr-")), cache, "key")
    return hits.agg(F.count(F.lit(1)).alias("hits")).crossJoin(misses.agg(F.count(F.lit(1)).alias("misses")))  # one row each


_W = {"judge_clarity": 0.2, "judge_reason_completeness": 0.25, "judge_actionability": 0.25, "judge_decision_alignment": 0.2, "judge_professionalism": 0.1}


@query("WITH x AS (SELECT DISTINCT ON (rollout_id) * FROM rollouts) SELECT rollout_id, CASE WHEN " + " AND ".join(f"{k} BETWEEN 0 AND 4 AND NOT isnan({k})" for k in _W) + " THEN round((" + " + ".join(f"{k} * {w}" for k, w in _W.items()) + ") / 4, 6) END AS rubric FROM x")
def rubric_score(spark, d):
    return runtime.table(spark, d, "rollouts").dropDuplicates(["rollout_id"]).select("rollout_id", q.rubric({k: (F.col(k), w) for k, w in _W.items()}).alias("rubric"))


@query("""SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 0::DOUBLE ELSE least(1, 0.25 + CASE WHEN length(text) >= 20 THEN 0.25 ELSE 0.1 END + CASE WHEN contains(text, '办理') OR contains(text, 'apply') THEN 0.25 ELSE 0 END
    + CASE WHEN contains(text, '材料') OR contains(text, 'papers') THEN 0.25 ELSE 0 END)::DOUBLE END AS score FROM documents""", "score")
def heuristic_score(spark, d):
    has = lambda *w: F.when(F.coalesce(F.greatest(*[F.contains("text", F.lit(x)) for x in w]), F.lit(False)), 0.25).otherwise(0.0)
    s = F.least(F.lit(1.0), 0.25 + F.when(F.length("text") >= 20, 0.25).otherwise(0.1) + has("办理", "apply") + has("材料", "papers"))
    return runtime.table(spark, d, "documents").select("doc_id", F.when(text.is_blank("text"), 0.0).otherwise(s).alias("score"))


# --- curriculum

_STRATA = f"""{ONCE}, p AS (SELECT scenario, avg(CASE WHEN process THEN 1.0::DOUBLE ELSE 0 END) AS score FROM r WHERE scenario IS NOT NULL GROUP BY scenario), z AS (SELECT scenario_type AS scenario, count(*) AS n FROM (SELECT DISTINCT ON (case_id) * FROM cases) WHERE split = 'train' GROUP BY scenario_type),
    w AS (SELECT scenario, n, coalesce(score, 0) AS score, least(3, 1 + 2 * greatest(0, 0.8 - coalesce(score, 0))) AS multiplier FROM z LEFT JOIN p USING (scenario)),
    x AS (SELECT *, n * (multiplier - 1) AS need, floor(sum(n) OVER () * (1.5 - 1)) AS budget FROM w), y AS (SELECT *, round(budget * need / sum(need) OVER (), 9) AS share FROM x),
    k AS (SELECT *, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, share DESC, scenario DESC) AS rk, budget - sum(floor(share)) OVER () AS rest FROM y),
    m AS (SELECT scenario, n, score, multiplier, CAST(floor(share) + CASE WHEN rk <= rest THEN 1 ELSE 0 END AS BIGINT) AS extra FROM k)"""


def _strata(spark, d):
    train = cases(spark, d).where("split = 'train'")
    score = rollouts(spark, d).where("scenario IS NOT NULL").groupBy("scenario").agg(F.avg(F.col("process").cast("double")).alias("found"))
    n = train.groupBy(F.col("scenario_type").alias("scenario")).agg(F.count(F.lit(1)).alias("n"))
    s = cu.multipliers(n.join(score, "scenario", "left"), F.col("found")).select("scenario", "n", "score", "multiplier")
    return train, cu.allocate(s, "scenario", "n", 1.5)


@query(f"WITH {_STRATA} SELECT scenario, n, score, multiplier FROM m", "score multiplier")
def curriculum_multipliers(spark, d):
    return _strata(spark, d)[1].drop("extra")


@query(f"WITH {_STRATA} SELECT scenario, extra FROM m")
def curriculum_allocation(spark, d):
    return _strata(spark, d)[1].select("scenario", "extra")


@query(f"WITH {_STRATA}, u AS (SELECT scenario, n, extra FROM m) SELECT scenario, CAST(n + extra AS BIGINT) AS rows, CASE WHEN extra > 0 THEN CAST(ceil(extra / CAST(n AS DOUBLE)) AS INTEGER) ELSE 0 END AS most_repeats FROM u")
def curriculum_rows(spark, d):
    train, allocated = _strata(spark, d)
    out = cu.expand(train.select("case_id", F.col("scenario_type").alias("scenario")), allocated, "scenario", "case_id")
    return out.groupBy("scenario").agg(F.count(F.lit(1)).alias("rows"), F.max("repeat_index").alias("most_repeats"))


# --- dialogues and tokens

_TURNS = r"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents WHERE doc_kind = 'dialogue'),
    t AS (SELECT doc_id, line_no, regexp_extract(line, '^\s*([^:：\s]{1,20})\s*[:：]', 1) AS speaker, regexp_replace(line, '^\s*[^:：\s]{1,20}\s*[:：]\s*', '') AS words FROM l),
    u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS turn, len(regexp_extract_all(words, '([\p{Han}]|[^\s\p{Han}]+)')) AS tokens, speaker IN ('Agent', 'Desk', '答复', '助手') AS is_target FROM t WHERE speaker <> '')"""
_TARGETS = ["Agent", "Desk", "答复", "助手"]


def _turns(spark, d):
    return dl.target_turns(dl.turns(runtime.table(spark, d, "documents").where("doc_kind = 'dialogue'"), "doc_id", "text"), "doc_id", _TARGETS)


@query(f"WITH {_TURNS} SELECT doc_id, CAST(turn AS INTEGER) AS turn, speaker, is_target, CAST(sum(CASE WHEN is_target THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY turn) AS BIGINT) AS target_no FROM u")
def turn_ids(spark, d):
    return _turns(spark, d).select("doc_id", "turn", "speaker", "is_target", "target_no")


@query(f"WITH {_TURNS} SELECT doc_id, CAST(turn AS INTEGER) AS turn, tokens, CASE WHEN is_target AND tokens > 0 THEN 1.0 / tokens ELSE 0 END AS weight FROM u", "weight")
def turn_balanced_weights(spark, d):
    return dl.turn_weights(_turns(spark, d)).select("doc_id", "turn", F.col("tokens").cast("long").alias("tokens"), "weight")


_TOKENS = rf"""{_TURNS}, k AS (SELECT doc_id, turn, is_target, unnest(regexp_extract_all(words, '([\p{{Han}}]|[^\s\p{{Han}}]+)')) AS token, unnest(range(0, len(regexp_extract_all(words, '([\p{{Han}}]|[^\s\p{{Han}}]+)')))) AS i FROM u),
    p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn, i) AS pos, 1.0::DOUBLE / count(*) OVER (PARTITION BY doc_id, turn) AS weight FROM k)"""


def _samples(spark, d):
    """Dialogues that have a target token, as arrays."""
    return dl.serialized(_turns(spark, d), "doc_id").where(F.exists("mask", lambda m: m == 1))


@query(f"WITH {_TOKENS} SELECT doc_id, count(*) AS tokens, count(CASE WHEN is_target THEN 1 END) AS targets, count(DISTINCT CASE WHEN is_target THEN turn END) AS turns, string_agg(CASE WHEN is_target THEN '1' ELSE '0' END, '' ORDER BY pos) AS mask FROM p GROUP BY doc_id HAVING count(CASE WHEN is_target THEN 1 END) > 0")
def assistant_mask(spark, d):
    """Each dialogue's tokens with the mask of the target turns."""
    n = lambda c: F.size(c).cast("long")
    targets = F.filter("turn", lambda t: t >= 0)
    return _samples(spark, d).select("doc_id", n("token").alias("tokens"), n(targets).alias("targets"), n(F.array_distinct(targets)).alias("turns"), F.array_join("mask", "").alias("mask"))


@query(f"""WITH {_TOKENS}, h AS (SELECT *, lag(length(token)) OVER (PARTITION BY doc_id ORDER BY pos) AS loss, max(is_target::INT) OVER (PARTITION BY doc_id) AS has FROM p)
    SELECT doc_id, coalesce(sum(CASE WHEN is_target THEN weight * loss END), 0) / greatest(coalesce(sum(CASE WHEN is_target AND loss IS NOT NULL THEN weight END), 0), 1.1920929e-07) AS loss FROM h WHERE has = 1 GROUP BY doc_id""", "loss")
def weighted_loss(spark, d):
    """The weighted loss after the shift: the loss at a token is that of predicting the next one; token lengths stand for losses."""
    s = _samples(spark, d).withColumns({"weights": dl.turn_balanced("mask", "turn"), "labels": F.transform("mask", lambda m: F.when(m == 1, F.lit(1).cast("long")).otherwise(F.lit(dl.NO_LABEL).cast("long")))})
    return s.select("doc_id", dl.shifted_loss(F.col("labels"), F.col("weights"), F.transform("token", lambda t: F.length(t).cast("double"))).alias("loss"))


@query(f"""WITH {_TOKENS}, g AS (SELECT doc_id, count(*) AS n, count(CASE WHEN is_target THEN 1 END) AS targets FROM p GROUP BY doc_id HAVING count(CASE WHEN is_target THEN 1 END) > 0)
    SELECT doc_id, CAST(max(n) OVER (PARTITION BY doc_id % 10) AS INTEGER) AS padded, CAST(n AS BIGINT) AS attended, targets FROM g""")
def collated_batches(spark, d):
    """Batches of dialogues with labels, attention and weights, filled up to the longest of the batch."""
    s = _samples(spark, d).withColumns({"batch": F.col("doc_id") % 10, "ids": F.transform("token", lambda t: F.xxhash64(t)), "weights": dl.turn_balanced("mask", "turn")})
    c = dl.collated(s, "batch", "ids", "mask", "weights", 0)
    total = lambda c_, keep: F.size(F.filter(c_, keep)).cast("long")
    return c.select("doc_id", F.size("ids").alias("padded"), total("attention", lambda x: x == 1).alias("attended"), total("labels", lambda x: x != dl.NO_LABEL).alias("targets"))


@query(f"""WITH {_TOKENS}, tt AS (SELECT doc_id, turn, is_target, count(*) AS c FROM p GROUP BY ALL), g AS (SELECT doc_id, sum(c) AS n, sum(CASE WHEN is_target THEN c ELSE 0 END) AS targets, count(CASE WHEN is_target THEN 1 END) AS turns, max(CASE WHEN is_target THEN c END) / min(CASE WHEN is_target THEN c END)::DOUBLE AS imbalance FROM tt GROUP BY doc_id HAVING count(CASE WHEN is_target THEN 1 END) > 0),
    x AS (SELECT g.*, d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY n) AS rl, count(*) OVER (PARTITION BY d.lang) AS nl, row_number() OVER (ORDER BY n) AS ra, count(*) OVER () AS na FROM g JOIN documents d USING (doc_id))
    SELECT lang, false AS is_total, count(*) AS count, avg(n) AS tokens_mean, max(CASE WHEN rl = floor((nl - 1) * 0.5) + 1 THEN n END)::INTEGER AS tokens_p50, max(CASE WHEN rl = floor((nl - 1) * 0.95) + 1 THEN n END)::INTEGER AS tokens_p95, max(n)::INTEGER AS tokens_most, avg(targets) AS targets_mean, min(targets)::INTEGER AS targets_least, avg(turns) AS turns_mean, avg(imbalance) AS imbalance_mean FROM x GROUP BY lang
    UNION ALL SELECT NULL, true, count(*), avg(n), max(CASE WHEN ra = floor((na - 1) * 0.5) + 1 THEN n END)::INTEGER, max(CASE WHEN ra = floor((na - 1) * 0.95) + 1 THEN n END)::INTEGER, max(n)::INTEGER, avg(targets), min(targets)::INTEGER, avg(turns), avg(imbalance) FROM x""", "tokens_mean targets_mean turns_mean imbalance_mean")
def token_audit(spark, d):
    """Tokens, targets, turns and their imbalance, by language and over all."""
    lang = runtime.table(spark, d, "documents").where("doc_kind = 'dialogue'").select("doc_id", "lang")
    return dl.audit(_samples(spark, d).join(lang, "doc_id"), ["lang"])


@query("""WITH x AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE n_chars IS NOT NULL)
    SELECT source, any_value(n) AS n, min(n_chars) AS least, max(n_chars) AS most, avg(n_chars) AS mean, max(CASE WHEN rn = floor((n - 1) * 0.5) + 1 THEN n_chars END) AS p50, max(CASE WHEN rn = floor((n - 1) * 0.95) + 1 THEN n_chars END) AS p95 FROM x GROUP BY source""", "mean")
def token_audit_percentiles(spark, d):
    return dl.floor_percentiles(runtime.table(spark, d, "documents"), ["source"], "n_chars", {"p50": 0.5, "p95": 0.95})


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 20")
def overlong_topk(spark, d):
    return dl.longest(runtime.table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 20)


@query("""WITH x AS (SELECT matter_id, case_id, reference_actions AS acts, max(len(reference_actions)) OVER (PARTITION BY matter_id) AS m FROM (SELECT DISTINCT ON (case_id) * FROM cases))
    SELECT case_id, array_to_string(list_concat(acts, list_transform(range(0, m - len(acts)), lambda i: 'PAD')), ' ') AS padded FROM x""")
def padded_batches(spark, d):
    p = dl.padded(cases(spark, d).select("matter_id", "case_id", "reference_actions"), "matter_id", "reference_actions", F.lit("PAD"))
    return p.select("case_id", F.array_join("reference_actions", " ").alias("padded"))


@query(f"""WITH {_CASES} SELECT case_id, matter_id, title, user_request, visible_slots FROM c""")
def policy_view(spark, d):
    """What an agent may see of a case."""
    return cases(spark, d).select("case_id", "matter_id", "title", "user_request", "visible_slots")


@query(f"""WITH {_CASES}, t AS (SELECT case_id, user_request, reference_actions FROM c) SELECT case_id, CAST(0 AS INTEGER) AS turn, 'user' AS role, user_request AS content FROM t
    UNION ALL SELECT case_id, CAST(unnest(range(1, len(reference_actions) + 1)) AS INTEGER), 'assistant', unnest(reference_actions) FROM t""")
def case_messages(spark, d):
    """A case as ordered messages: the request, then one message per reference action."""
    c = cases(spark, d)
    msgs = F.concat(F.array(F.struct(F.lit("user").alias("role"), F.col("user_request").alias("content"))), F.transform("reference_actions", lambda a: F.struct(F.lit("assistant").alias("role"), a.alias("content"))))
    return c.select("case_id", F.posexplode(msgs).alias("turn", "msg")).select("case_id", "turn", "msg.role", "msg.content")


# --- series and event logs

_SCALARS = "s AS (SELECT run_id, tag, step, arg_max(value, wall_time) AS value, max(wall_time) AS wall_time FROM scalars WHERE value IS NOT NULL GROUP BY ALL)"


@query(f"WITH {_SCALARS} SELECT * FROM s")
def latest_value_per_key(spark, d):
    return sq.latest(runtime.table(spark, d, "scalars").where("value IS NOT NULL"), ["run_id", "tag", "step"], "value", "wall_time")


@query(f"WITH {_SCALARS} SELECT run_id, step, max(CASE WHEN tag = 'actor/lr' THEN value END) AS lr, max(CASE WHEN tag = 'actor/entropy' THEN value END) AS entropy FROM s GROUP BY run_id, step")
def step_metrics_wide(spark, d):
    s = sq.latest(runtime.table(spark, d, "scalars").where("value IS NOT NULL"), ["run_id", "tag", "step"], "value", "wall_time")
    return s.groupBy("run_id", "step").pivot("tag", ["actor/lr", "actor/entropy"]).agg(F.max("value")).withColumnsRenamed({"actor/lr": "lr", "actor/entropy": "entropy"})


@query("""WITH n(metric, tag, priority) AS (VALUES ('reward', 'critic/score/mean', 1), ('reward', 'critic/rewards/mean', 2), ('entropy', 'actor/entropy_loss', 1), ('entropy', 'actor/entropy', 2), ('memory', 'perf/max_memory', 1)),
    p AS (SELECT tag, count(*) AS points FROM scalars WHERE value IS NOT NULL GROUP BY tag) SELECT metric, arg_min(tag, priority) AS tag, arg_min(points, priority) AS points FROM n JOIN p USING (tag) GROUP BY metric""")
def alias_resolution(spark, d):
    names = [("reward", "critic/score/mean", 1), ("reward", "critic/rewards/mean", 2), ("entropy", "actor/entropy_loss", 1), ("entropy", "actor/entropy", 2), ("memory", "perf/max_memory", 1)]
    return sq.alias_series(runtime.table(spark, d, "scalars"), spark.createDataFrame(names, "metric string, tag string, priority int"))


_EV = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM events)"


@query(f"WITH {_EV} SELECT user_id, min(no) FILTER (event_type = 'purchase') AS first_terminal, count(*) AS n FROM e GROUP BY user_id")
def first_terminal_action(spark, d):
    rows = sq.marked(runtime.table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", ["purchase"])
    return rows.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("no"))).alias("first_terminal"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_EV}, f AS (SELECT user_id, min(no) AS t FROM e WHERE event_type = 'purchase' GROUP BY user_id) SELECT user_id, count(*) AS trailing FROM e JOIN f USING (user_id) WHERE no > t GROUP BY user_id")
def trailing_actions(spark, d):
    rows = sq.marked(runtime.table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", ["purchase"])
    return rows.where("done_before").groupBy("user_id").agg(F.count(F.lit(1)).alias("trailing"))


@query(f"WITH {_EV}, k AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) SELECT user_id, count(*) AS repeated FROM k WHERE k > 1 GROUP BY user_id")
def repeated_actions(spark, d):
    rows = sq.marked(runtime.table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", ["purchase"])
    return rows.where("repeated").groupBy("user_id").agg(F.count(F.lit(1)).alias("repeated"))


@query(f"WITH {_EV} SELECT user_id, event_id, CAST(no AS INTEGER) AS no FROM e WHERE no <= 8")
def horizon_cut(spark, d):
    return sq.marked(runtime.table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", ["purchase"], 8).where("NOT beyond").select("user_id", "event_id", "no")


@query("""WITH b AS (SELECT *, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER w AS v, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS c FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_id FROM b WHERE (event_type = 'click' AND coalesce(v, 0) = 0) OR (event_type = 'purchase' AND (coalesce(v, 0) = 0 OR coalesce(c, 0) = 0))""")
def order_violations(spark, d):
    return sq.order_violations(runtime.table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", ["view", "click", "purchase"]).select("event_id")


@query(f"""WITH {_EV}, f AS (SELECT user_id, min(no) FILTER (event_type = 'purchase') AS t, count(*) AS n FROM e GROUP BY user_id),
    g AS (SELECT user_id, n, CASE WHEN t IS NOT NULL AND t <= 12 THEN t ELSE least(n, 12) END AS attempts, CASE WHEN t IS NOT NULL AND t <= 12 THEN 'purchase' WHEN n > 12 THEN 'cut' END AS final FROM f),
    k AS (SELECT e.user_id, count(*) - count(DISTINCT event_type) AS repeated FROM e JOIN g USING (user_id) WHERE no <= attempts GROUP BY ALL)
    SELECT user_id, CAST(attempts AS INTEGER) AS attempts, CAST(CASE WHEN final = 'purchase' THEN n - attempts WHEN final = 'cut' THEN n - 13 ELSE 0 END AS INTEGER) AS trailing, CAST(repeated AS INTEGER) AS repeated, final FROM g JOIN k USING (user_id)""")
def episode_fold(spark, d):
    return sq.fold(runtime.table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", ["purchase"], 12)


@query("SELECT event_type, count(*) AS n, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, max(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_max FROM events GROUP BY event_type")
def json_property_agg(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return runtime.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


# --- set operations, functions, round trips

@query("""SELECT 'only_orders' AS kind, count(*) AS n FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'both', count(*) FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'either', count(*) FROM (SELECT o_orderkey FROM orders UNION SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'all', count(*) FROM (SELECT o_orderkey FROM orders UNION ALL SELECT l_orderkey FROM lineitem)""")
def set_operations(spark, d):
    a = runtime.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    b = runtime.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    n = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(a.subtract(b), "only_orders").unionAll(n(a.intersect(b), "both")).unionAll(n(a.union(b).distinct(), "either")).unionAll(n(a.unionAll(b), "all"))


@query(f"""WITH {_CASES} SELECT case_id, array_to_string(list_sort(list_filter(rules.required_tools, lambda t: NOT list_contains(reference_actions, t))), ' ') AS uncalled, list_first(list_filter(reference_actions, lambda t: t <> 'ASK_USER')) AS first_tool,
    reference_actions[-1] AS last, len(rules.required_slots) // 2 AS half, format('{{:03d}}', len(reference_actions)) AS padded FROM c""")
def array_functions(spark, d):
    a = F.col("reference_actions")
    return cases(spark, d).select(
        "case_id", F.array_join(F.array_sort(F.array_except("rules.required_tools", a)), " ").alias("uncalled"), F.get(F.filter(a, lambda t: t != "ASK_USER"), F.lit(0)).alias("first_tool"),
        F.try_element_at(a, F.lit(-1)).alias("last"), F.expr("size(rules.required_slots) div 2").alias("half"), F.format_string("%03d", F.size(a)).alias("padded"),
    )


@query(r"""SELECT doc_id, trim(regexp_replace(text, '[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS squeezed, length(text) AS points, lower(text) AS lowered, starts_with(text, '来电') AS is_call,
    replace(text, '。', '.') AS replaced, coalesce(regexp_matches(source, '^[a-z0-9][a-z0-9_-]*$'), false) AS is_slug, CAST(strpos(text, chr(10)) AS INTEGER) AS first_break FROM documents""")
def text_functions(spark, d):
    return runtime.table(spark, d, "documents").select(
        "doc_id", text.squeeze_space("text").alias("squeezed"), F.length("text").alias("points"), F.lower("text").alias("lowered"), F.startswith("text", F.lit("来电")).alias("is_call"),
        F.replace("text", F.lit("。"), F.lit(".")).alias("replaced"), F.coalesce(F.rlike("source", F.lit("^[a-z0-9][a-z0-9_-]*$")), F.lit(False)).alias("is_slug"), F.instr("text", "\n").alias("first_break"),
    )


_ROUND = "SELECT event_id, user_id, event_type, value, props FROM events"


@query(_ROUND)
def jsonl_roundtrip(spark, d):
    df = runtime.table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props")
    return files.read_jsonl(spark, files.write_jsonl(df, runtime.Scratch(spark, "jsonl").path), df.schema)


@query(_ROUND)
def csv_roundtrip(spark, d):
    df = runtime.table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props")
    return files.read_csv(spark, files.write_csv(df, runtime.Scratch(spark, "csv").path), df.schema)


@query("SELECT matter_id, title, NULL::VARCHAR AS scenario_type, NULL::VARCHAR AS text FROM matters UNION ALL BY NAME SELECT matter_id, scenario_type, text FROM eval_items")
def ragged_union(spark, d):
    a = runtime.table(spark, d, "matters").select("matter_id", "title")
    return a.unionByName(runtime.table(spark, d, "eval_items").select("matter_id", "scenario_type", "text"), allowMissingColumns=True)


@query(f"""WITH {ONCE}, x AS (SELECT rollout_id, reward_value, judge_score, lower(coalesce(output, '')) AS o FROM r) SELECT rollout_id, reward_value AS source_environment_reward, judge_score AS source_judge_score,
    CASE WHEN contains(o, '"submit"') OR contains(o, '"refuse"') THEN coalesce(reward_value, 0) ELSE 0 END AS reward, CASE WHEN contains(o, '"submit"') OR contains(o, '"refuse"') THEN judge_score ELSE -1 END AS judge_score FROM x""")
def rescored_overlay(spark, d):
    """Source columns kept under another name, new values laid over them."""
    o = F.lower(F.coalesce("output", F.lit("")))
    done = F.contains(o, F.lit('"submit"')) | F.contains(o, F.lit('"refuse"'))
    rows = rollouts(spark, d).withColumns({"source_environment_reward": F.col("reward_value"), "source_judge_score": F.col("judge_score")})
    rows = rows.withColumns({"reward": F.when(done, F.coalesce("reward_value", F.lit(0.0))).otherwise(0.0), "judge_score": F.when(done, F.col("judge_score")).otherwise(-1.0)})
    return rows.select("rollout_id", "source_environment_reward", "source_judge_score", "reward", "judge_score")


# --- checks of labels, scores, matching

@query(f"""WITH {_CASES}, x AS (SELECT matter_id, scenario_type, reference_actions[-1] IS DISTINCT FROM 'SUBMIT' AS bad FROM c), g AS (SELECT matter_id, scenario_type, grouping(matter_id) AS a, grouping(scenario_type) AS b, count(*) AS n, count(CASE WHEN bad THEN 1 END) AS conflicts FROM x GROUP BY GROUPING SETS ((matter_id), (scenario_type), ()))
    SELECT CASE WHEN a = 0 THEN 'matter_id' WHEN b = 0 THEN 'scenario_type' END AS grouped_by, CASE WHEN a = 0 THEN matter_id WHEN b = 0 THEN scenario_type END AS value, n, conflicts FROM g""")
def consistency_audit(spark, d):
    """Cases whose derived label (here: the last action of the path) is not the expected one (here: SUBMIT), by matter, by
    scenario and over all. How the label is derived is an argument; the rules of eligibility are none of the engine's."""
    return q.label_conflicts(cases(spark, d), F.try_element_at("reference_actions", F.lit(-1)), F.lit("SUBMIT"), ["matter_id", "scenario_type"])


@query(f"WITH {_CASES} SELECT md5(coalesce(matter_id, chr(1)) || chr(0) || coalesce(split, chr(1))) AS key, count(*) AS n, count(DISTINCT coalesce(expected_result.final_action, '')) AS labels FROM c GROUP BY 1 HAVING count(DISTINCT coalesce(expected_result.final_action, '')) > 1")
def label_contradictions(spark, d):
    """What looks alike but has several labels; matter and split stand for what is seen."""
    return q.contradictions(cases(spark, d), ["matter_id", "split"], F.col("expected_result.final_action"))


@query(f"WITH {_CASES} SELECT case_id FROM c WHERE len(coalesce(reference_actions, [])) < 1 OR list_last(reference_actions) IS DISTINCT FROM 'SUBMIT'")
def paths_without_submit(spark, d):
    return q.broken_paths(cases(spark, d), "reference_actions", F.lit("SUBMIT")).select("case_id")


@query("SELECT matter_id, count(DISTINCT doc_kind) AS splits, min(doc_kind) AS first_split, max(doc_kind) AS last_split FROM documents WHERE matter_id IS NOT NULL GROUP BY matter_id HAVING count(DISTINCT doc_kind) > 1")
def matters_crossing_kinds(spark, d):
    return q.crossing(runtime.table(spark, d, "documents"), "matter_id", "doc_kind")


@query(f"WITH {_COVER} SELECT case_id, n FROM f WHERE status = 'unknown'")
def unknown_cases(spark, d):
    return q.coverage(runtime.table(spark, d, "cases"), rollouts(spark, d), "case_id", 4).where("status = 'unknown'").drop("status")


@query(f"WITH {_COVER} SELECT case_id, n FROM f WHERE status = 'wrong_count'")
def wrong_counts(spark, d):
    return q.coverage(runtime.table(spark, d, "cases"), rollouts(spark, d), "case_id", 4).where("status = 'wrong_count'").drop("status")


@query(f"WITH {ONCE}, {_CASES} SELECT c.case_id IS NOT NULL AS known, count(*) AS rollouts, count(CASE WHEN c.split = r.split THEN 1 END) AS same_split FROM r LEFT JOIN c ON r.case_id = c.case_id GROUP BY 1")
def rollouts_with_cases(spark, d):
    """Rollouts with their cases and how many have none; the cases are broadcast only if they are few."""
    c = cases(spark, d).select("case_id", F.col("split").alias("case_split"), F.lit(True).alias("known"))
    both = runtime.join_sized(rollouts(spark, d), c, ["case_id"], "left", c.count())
    return both.groupBy(F.coalesce("known", F.lit(False)).alias("known")).agg(F.count(F.lit(1)).alias("rollouts"), F.count_if(F.col("split") == F.col("case_split")).alias("same_split"))


@query(f"""WITH {ONCE}, sco AS (SELECT scenario, count(CASE WHEN process THEN 1 END) / count(*)::DOUBLE AS score FROM r WHERE case_id IS NOT NULL AND scenario IS NOT NULL GROUP BY scenario) SELECT scenario, score, 'process_pass_at_1' AS source FROM sco""", "score")
def scenario_scores(spark, d):
    """The score of each scenario and the metric it is from, by priority; a scenario of the cases without one ends the query."""
    found = cu.first_metric(metrics.evaluation(rollouts(spark, d).where("scenario IS NOT NULL"), ["scenario"]))
    need = cases(spark, d).where("split = 'train'").select(F.col("scenario_type").alias("scenario")).distinct()
    return cu.with_scores(need, found, "scenario")


@query("""WITH n(metric, tag, priority) AS (VALUES ('reward', 'critic/score/mean', 1), ('entropy', 'actor/entropy', 1), ('never', 'no/such/tag', 1)), p AS (SELECT DISTINCT tag FROM scalars WHERE value IS NOT NULL) SELECT metric FROM n WHERE metric NOT IN (SELECT metric FROM n JOIN p USING (tag))""")
def missing_series(spark, d):
    """Metrics none of whose names has a point."""
    names = spark.createDataFrame([("reward", "critic/score/mean", 1), ("entropy", "actor/entropy", 1), ("never", "no/such/tag", 1)], "metric string, tag string, priority int")
    return names.select("metric").distinct().join(sq.alias_series(runtime.table(spark, d, "scalars"), names), "metric", "left_anti")


@query(f"WITH {_SCALARS} SELECT run_id, step, value FROM s WHERE tag = 'actor/lr'")
def series_points(spark, d):
    """One series as points in order of its steps."""
    s = sq.latest(runtime.table(spark, d, "scalars").where("value IS NOT NULL AND tag = 'actor/lr'"), ["run_id", "tag", "step"], "value", "wall_time")
    return s.select("run_id", "step", "value").orderBy("run_id", "step")


@query(f"""WITH {_CASES} SELECT case_id, 'cases' AS data_source, user_request AS prompt, CASE WHEN split = 'train' THEN 0 ELSE 1 END AS held_out, len(rules.required_slots) AS slots FROM c""")
def trainer_rows(spark, d):
    """Cases in the nested shape that a trainer reads, and what comes back out of it."""
    r = cases(spark, d).select(
        "case_id", F.lit("cases").alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), F.col("user_request").alias("content"))).alias("prompt"),
        F.struct("split", "scenario_type", F.to_json("rules").alias("rules"), F.sha2(F.to_json("rules"), 256).alias("fingerprint")).alias("extra"),
    )
    slots = F.size(F.from_json("extra.rules", "required_slots array<string>")["required_slots"])
    return r.select("case_id", "data_source", F.col("prompt")[0]["content"].alias("prompt"), F.when(F.col("extra.split") == "train", 0).otherwise(1).alias("held_out"), slots.cast("long").alias("slots"))


@query(f"""WITH {ONCE}, x AS (SELECT rollout_id, coalesce(output, '') AS o, judge_clarity AS j FROM r) SELECT rollout_id, CASE WHEN contains(o, '{{') AND contains(o, '}}') AND strpos(reverse(o), '}}') < length(o) - strpos(o, '{{') + 1 THEN length(o) - strpos(o, '{{') + 1 - strpos(reverse(o), '}}') + 1 END AS sliced,
    coalesce(CASE WHEN j >= 0 THEN j / 4 END, -1) AS clarity, CAST(round_even(rollout_id / 8.0, 0) AS BIGINT) AS even FROM x""", "clarity")
def scalar_functions(spark, d):
    rows = runtime.table(spark, d, "rollouts").select("rollout_id", F.length(text.brace_slice(F.coalesce("output", F.lit("")))).cast("long").alias("sliced"), "judge_clarity").dropDuplicates(["rollout_id"])
    j = F.col("judge_clarity")
    return rows.select("rollout_id", "sliced", F.coalesce(F.when(j >= 0, j / 4), F.lit(-1.0)).alias("clarity"), F.bround(F.col("rollout_id") / 8.0, 0).cast("long").alias("even"))


@query(f"""WITH {_CASES} SELECT case_id, len(rules.required_slots) + len(rules.required_tools) AS together, len(json_keys(json_merge_patch(coalesce(hidden_truth, '{{}}'), coalesce(visible_slots, '{{}}')))) AS merged, (len(rules.required_slots) * (len(rules.required_slots) - 1) / 2)::BIGINT AS slot_pairs FROM c""")
def collection_functions(spark, d):
    """Arrays put together, maps laid over one another, all pairs of an array's few elements."""
    m_ = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    slots = F.col("rules.required_slots")
    pairs = F.flatten(F.transform(slots, lambda a, i: F.transform(F.slice(slots, i + 2, F.size(slots)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    keys = F.array_union(F.map_keys(m_("hidden_truth")), F.map_keys(m_("visible_slots")))
    return cases(spark, d).select("case_id", F.size(F.concat(slots, "rules.required_tools")).cast("long").alias("together"), F.size(keys).cast("long").alias("merged"), F.size(pairs).cast("long").alias("slot_pairs"))
