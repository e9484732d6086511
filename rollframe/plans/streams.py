"""Streaming queries, run over a file source until all is read."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollframe import runtime
from rollframe.plans.base import registering
from rollframe.streaming import episodes as ep

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registering(QUERIES, SQL)


def _in_order(df, at: str, parts: int = 3) -> str:
    """df as files that arrive one part after the other in order of time: a file source reads older files first."""
    spark = df.sparkSession
    path = runtime.Scratch(spark, "stream").path
    spread = Window.orderBy("day")  # one row per day
    days = df.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    days = days.withColumn("part", F.least(F.lit(parts - 1), F.floor(parts * (F.sum("n").over(spread) - 1) / F.sum("n").over(Window.partitionBy()))))
    ends = [r.last for r in days.groupBy("part").agg(F.max("day").alias("last")).orderBy("part").collect()]  # `parts` rows
    low = None
    for last in ends:
        day = F.to_date(at)
        some = df.where((day <= F.lit(last)) & ((day > F.lit(low)) if low is not None else day.isNotNull()))
        some.write.mode("append").parquet(path)
        low = last
    return path


def _events(spark, d):
    df = runtime.table(spark, d, "events")
    return ep.file_stream(spark, _in_order(df, "ts"), df.schema, 1)


def _place(spark) -> str:
    return runtime.Scratch(spark, "state").path


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM events), f AS (SELECT user_id, min(no) FILTER (event_type = 'purchase') AS t, count(*) AS n FROM e GROUP BY user_id)
    SELECT user_id, CAST(CASE WHEN t <= 12 THEN t ELSE least(n, 12) END AS INTEGER) AS attempts, CAST(CASE WHEN t <= 12 THEN n - t WHEN n > 12 THEN n - 13 ELSE 0 END AS INTEGER) AS trailing, CASE WHEN t <= 12 THEN 'purchase' WHEN n > 12 THEN 'cut' END AS final FROM f""")
def stream_episodes(spark, d):
    """Episodes by keyed state, file after file; as the batch fold says."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = runtime.Scratch(spark, "episodes").path
        q = ep.episodes(_events(spark, d), ["purchase"], 12).writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", _place(spark)).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return ep.latest_update(spark.read.parquet(out)).select("user_id", "attempts", "trailing", "final")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL", "total")
def stream_windows(spark, d):
    """Daily counts with a watermark; the files arrive in order, so that nothing is late."""
    t = ep.run_to_end(ep.windowed(_events(spark, d)), runtime.Scratch(spark, "windows").path, _place(spark), "complete")
    return t.select("start", "event_type", "n", "total")


@query("SELECT step, count(*) AS n, count(CASE WHEN coalesce(final_action_correct, 0) > 0 THEN 1 END) AS successes FROM (SELECT DISTINCT ON (rollout_id) * FROM rollouts) GROUP BY step")
def stream_success(spark, d):
    """Running success counts by step, each rollout once."""
    df = runtime.table(spark, d, "rollouts").select("rollout_id", "step", "final_action_correct", "logged_at")
    path = _in_order(df.withColumn("logged_at", F.coalesce("logged_at", F.lit("1970-01-01").cast("timestamp_ntz"))), "logged_at")
    s = ep.file_stream(spark, path, df.schema).dropDuplicates(["rollout_id"])
    return ep.run_to_end(ep.running_success(s), runtime.Scratch(spark, "success").path, _place(spark), "complete")
