"""The pN_ queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollframe import runtime
from rollframe.functions import text
from rollframe.llm import leakage, ledger, mixing, pairs, quantiles, residue, topn

#: Days of arrival that make one batch of the ledger.
BATCH_DAYS = 8


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per case the four rollouts with the highest environment_reward; ties by step, then rollout_id."""
    rows = runtime.table(spark, sf_dir, "rollouts").select(text.canonical_id("case_id").alias("case_id"), "environment_reward", "step", "rollout_id")
    best = topn.top_n_per_group(rows, "case_id", "environment_reward", 4, [("step", True), ("rollout_id", True)], id_col="rollout_id")
    return best.select("case_id", "rank_no", "rollout_id")


def _rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runtime.table(spark, sf_dir, "rollouts")
    rows = rows.select("rollout_id", "run_id", text.label("scenario_type").alias("scenario_type"), "environment_reward")
    return rows.where(F.col("scenario_type").isNotNull() & F.col("environment_reward").isNotNull() & ~F.isnan("environment_reward")).distinct()


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches per run and scenario; small, and used for the slices and for the whole table alike."""
    return runtime.cut(quantiles.sketch(_rewards(spark, sf_dir), ["run_id", "scenario_type"], "environment_reward"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices (run, scenario) whose median lies outside the quartiles of the scenario over all runs."""
    slices = _slices(spark, sf_dir)
    whole = quantiles.percentiles(quantiles.merge(slices, ["scenario_type"]), {"p25": 0.25, "p75": 0.75}).select("scenario_type", "p25", "p75")
    medians = quantiles.percentiles(slices.where((F.col("n") >= 8) & F.col("run_id").isNotNull()), {"p50": 0.5})
    odd = medians.join(whole, "scenario_type").where((F.col("p50") < F.col("p25")) | (F.col("p50") > F.col("p75")))
    return odd.select("run_id", "scenario_type")


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per scenario over all runs (run_id null) and of each run, with the number of values and the bound on the
    rank error. Values without run_id count over all runs only."""
    slices = _slices(spark, sf_dir)
    points = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
    whole = quantiles.percentiles(quantiles.merge(slices, ["scenario_type"]), points).withColumn("run_id", F.lit(None).cast("string"))
    per_run = quantiles.percentiles(slices.where(F.col("run_id").isNotNull()), points)
    return whole.unionByName(per_run).withColumnRenamed("error", "rank_error_bound")


def _ledger(spark: SparkSession, sf_dir: str, root: str | None = None) -> tuple[DataFrame, ledger.Ledger, int]:
    rows = runtime.table(spark, sf_dir, "rollouts").select(
        F.col("rollout_id").alias("id"),
        ledger.key_of(text.canonical_id("case_id"), ledger.canonical_text(F.col("output"))).alias("key"),
        F.coalesce(F.floor(F.datediff("ingested_at", F.lit("1970-01-01")) / BATCH_DAYS), F.lit(0)).cast("int").alias("batch"),
    )
    # written before the nulls are dropped: a filter on the key would make Spark compute it twice
    keyed = runtime.written(rows, "keyed").where(F.col("key").isNotNull())
    book = ledger.Ledger(spark, root)
    per_batch = keyed.groupBy("batch").count().orderBy("batch").collect()  # one row per BATCH_DAYS days
    for b in per_batch:
        book.update(keyed.where(F.col("batch") == b.batch))
    return keyed, book, sum(b["count"] for b in per_batch)


def p3_found(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    """Further copies of rollouts whose case and output say the same thing, each with the first of its group.

    With a root the ledger there is brought up to date; without, one is built for this call."""
    keyed, book, total = _ledger(spark, sf_dir, root)
    return ledger.pairs(keyed, book.counts(), total)


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record that has copies: its first rollout and the number of its copies."""
    _, book, _ = _ledger(spark, sf_dir)
    return book.counts().where(F.col("copies") > 1).select("first_id", "copies")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts whose answer is defective, with the kind of defect."""
    return pairs.defects(runtime.table(spark, sf_dir, "rollouts"), runtime.table(spark, sf_dir, "cases"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of an evaluation item in long runs, with the item."""
    return leakage.leaks(runtime.table(spark, sf_dir, "documents"), runtime.table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def _sizes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = runtime.written(mixing.sized(runtime.table(spark, sf_dir, "documents")), "sizes")
    return sizes, runtime.cut(mixing.plan(sizes, runtime.table(spark, sf_dir, "mix_targets")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their share within the allowed repeats: their supply in the mixture ends before the training
    does, where the demand that their weights add up to has used up all copies."""
    return p7_shares(spark, sf_dir).where(~F.col("reachable")).select("source")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in training order, each copy with its position."""
    return mixing.mixture(*_sizes(spark, sf_dir))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source, and until when its supply lasts."""
    sizes, planned = _sizes(spark, sf_dir)
    return mixing.shares(mixing.mixture(sizes, planned), planned)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold template residue or a failed page."""
    return residue.residue(runtime.table(spark, sf_dir, "documents")).select("doc_id")


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that stay when those with residue are excluded."""
    docs = runtime.table(spark, sf_dir, "documents")
    return residue.without_residue(docs.select("doc_id"), residue.residue(docs))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p2_found, p2_percentiles, p3_found, p3_records, p5_found, p6_found, p7_found, p7_mixture, p7_shares, p8_found, p8_clean)
}

_CASE = "nullif(trim(regexp_replace(lower(case_id), '[^\\p{L}\\p{N}]+', '_', 'g'), '_'), '')"

#: The copies as SQL: blocks whose two levels of fields are put in order; g has each rollout with the first of its group.
_COPIES = r"""
    r AS (SELECT DISTINCT rollout_id AS id, nullif(trim(regexp_replace(lower(case_id), '[^\p{L}\p{N}]+', '_', 'g'), '_'), '') AS c, replace(lower(upper(output)), 'ß', 'ss') AS o FROM rollouts),
    b AS (SELECT id, unnest(regexp_extract_all(o, '(?s)<tool_call>(.*?)</tool_call>', 1)) AS block, unnest(range(0, len(regexp_extract_all(o, '(?s)<tool_call>(.*?)</tool_call>', 1)))) AS i FROM r),
    v AS (SELECT id, i, block, json_valid(block) AS ok FROM b),
    l1 AS (SELECT id, i, k, json_extract(block, '/' || k) AS x FROM (SELECT id, i, block, unnest(json_keys(block)) AS k FROM v WHERE ok) WHERE true),
    l2 AS (SELECT id, i, k, string_agg(k2 || coalesce(json_extract_string(x, '/' || k2), 'null'), ' ' ORDER BY k2) AS t FROM (SELECT id, i, k, x, unnest(json_keys(x)) AS k2 FROM l1 WHERE json_type(x) = 'OBJECT') GROUP BY ALL),
    l AS (SELECT l1.id, l1.i, string_agg(l1.k || coalesce(l2.t, CASE WHEN json_type(x) = 'OBJECT' THEN '' ELSE coalesce(json_extract_string(x, '$'), 'null') END), ' ' ORDER BY l1.k) AS t FROM l1 LEFT JOIN l2 USING (id, i, k) GROUP BY l1.id, l1.i),
    w AS (SELECT v.id, v.i, coalesce(l.t, CASE WHEN v.ok THEN '' ELSE v.block END) AS t FROM v LEFT JOIN l USING (id, i)),
    n AS (SELECT id, string_agg('toolcall ' || t, ' ' ORDER BY i) AS blocks FROM w GROUP BY id),
    k AS (SELECT r.id, r.c, string_split_regex(r.o, '(?s)<tool_call>.*?</tool_call>') AS parts, n.blocks, r.o FROM r LEFT JOIN n USING (id)),
    z AS (SELECT id, c, parts, (SELECT list(t ORDER BY i) FROM w WHERE w.id = k.id) AS ts FROM k WHERE c IS NOT NULL),
    y AS (SELECT id, c, regexp_replace(array_to_string(list_transform(range(1, len(parts) + 1), lambda j: parts[j] || CASE WHEN j <= len(coalesce(ts, [])) THEN 'toolcall ' || ts[j] ELSE '' END), ' '), '[^\p{L}\p{N}]+', '', 'g') AS key FROM z),
    g AS (SELECT id, min(id) OVER (PARTITION BY c, key) AS a FROM y WHERE key <> '')"""

SQL = {
    "p3_found": f"WITH {_COPIES} SELECT a AS rollout_id_a, id AS rollout_id_b FROM g WHERE id <> a",
    "p3_records": f"WITH {_COPIES} SELECT a AS first_id, count(*) AS copies FROM g GROUP BY a HAVING count(*) > 1",
    "p1_found": f"""
        WITH r AS (SELECT DISTINCT {_CASE} AS case_id, environment_reward AS v, step, rollout_id FROM rollouts
                   WHERE environment_reward IS NOT NULL AND NOT isnan(environment_reward))
        SELECT case_id, CAST(rank_no AS INTEGER) AS rank_no, rollout_id FROM (
            SELECT case_id, rollout_id, row_number() OVER (PARTITION BY case_id ORDER BY v DESC, step ASC NULLS LAST, rollout_id) AS rank_no
            FROM r WHERE case_id IS NOT NULL) WHERE rank_no <= 4""",
    "p2_found": """
        WITH r AS (SELECT DISTINCT rollout_id, run_id, lower(trim(scenario_type)) AS scenario_type, environment_reward AS v FROM rollouts
                   WHERE scenario_type IS NOT NULL AND trim(scenario_type) <> '' AND environment_reward IS NOT NULL AND NOT isnan(environment_reward)),
        s AS (SELECT run_id, scenario_type, quantile_disc(v, 0.5) AS p50 FROM r WHERE run_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 8),
        w AS (SELECT scenario_type, quantile_disc(v, 0.25) AS p25, quantile_disc(v, 0.75) AS p75 FROM r GROUP BY ALL)
        SELECT run_id, scenario_type FROM s JOIN w USING (scenario_type) WHERE p50 < p25 OR p50 > p75""",
    # sizes in characters: which sources fall short does not depend on the measure
    "p7_found": """
        WITH d AS (SELECT trim(regexp_replace(lower(source), '[^\\p{L}\\p{N}]+', '_', 'g'), '_') AS source, length(text) AS n FROM documents),
        own AS (SELECT source, sum(n) AS have FROM d GROUP BY source), whole AS (SELECT sum(n) AS total FROM d)
        SELECT t.source FROM mix_targets t CROSS JOIN whole LEFT JOIN own ON own.source = t.source
        WHERE t.target_share * total > t.max_repeats * coalesce(have, 0)""",
}
