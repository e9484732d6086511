"""Streams: keyed episode state, running metrics over files that arrive, and windows with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "user_id long, attempts int, trailing int, repeated int, final string"
_STATE = "attempts int, trailing int, repeated int, final string, seen array<string>"


class Episode(StatefulProcessor):
    """State of one episode: counters, the actions seen, and the final action.

    The same rule as the batch fold. After the terminal action the state stays as a small tombstone that goes on counting
    trailing actions. A `release` action ends the state of an episode that is done, and is not counted; one that is not
    done keeps its state. The ids of all events are kept until then, in a map of the state store, so that a repeated delivery
    is counted once, however late."""

    def __init__(self, terminal: list[str], horizon: int, release: str):
        self.terminal, self.horizon, self.release = set(terminal), horizon, release

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("episode", _STATE)
        self.ids = handle.getMapState("ids", "event_id long", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        attempts, trailing, repeated, final, seen = self.state.get() if self.state.exists() else (0, 0, 0, None, [])
        seen = list(seen)
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        released = False
        for event_id, action in zip(events["event_id"].tolist(), events["event_type"].tolist()):
            known = not pd.isna(event_id)  # an event without id is none of the others
            if known and self.ids.containsKey((int(event_id),)):
                continue
            if action == self.release:
                released = True
                continue
            if known:
                self.ids.updateValue((int(event_id),), (True,))
            if final is not None:
                trailing += 1
            elif attempts >= self.horizon:
                final = "cut"
            else:
                attempts += 1
                repeated += action in seen
                if action is not None and action not in seen:
                    seen.append(action)
                if action in self.terminal:
                    final = action
        if released and final is not None:
            self.state.clear()
            self.ids.clear()
        else:
            self.state.update((attempts, trailing, repeated, final, seen))
        yield pd.DataFrame([(key[0], attempts, trailing, repeated, final)], columns=["user_id", "attempts", "trailing", "repeated", "final"]).astype({"attempts": "int32", "trailing": "int32", "repeated": "int32"})

    def close(self) -> None:
        pass


def episodes(stream: DataFrame, terminal: list[str], horizon: int, release: str = "release") -> DataFrame:
    """Updates (user_id, attempts, trailing, repeated, final) of a stream of (event_id, ts, user_id, event_type).

    Needs the RocksDB state store; each update replaces the one before of the same user."""
    return stream.select("event_id", "ts", "user_id", "event_type").groupBy("user_id").transformWithStateInPandas(Episode(terminal, horizon, release), OUT, "Update", "none")


def windowed(stream: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts and sums per window and type; events later than the watermark are dropped. Times without zone are UTC."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def running_success(stream: DataFrame) -> DataFrame:
    """Running counts of a stream of rollouts by step, for update or complete mode."""
    final = F.coalesce(F.col("final_action_correct"), F.lit(0.0)) > 0
    return stream.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.count_if(final).alias("successes"))


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """Runs a stream over all that is there; each batch is written below path by the executors.

    complete: the last batch holds everything, and it is returned; update: all batches are, with their number in `batch`."""
    spark = df.sparkSession
    done: list[int] = []

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")  # a batch that is run again replaces itself
        done.append(n)

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], df.schema)
    return spark.read.parquet(f"{path}/batch={max(done)}") if mode == "complete" else spark.read.parquet(path)


def latest_update(updates: DataFrame) -> DataFrame:
    """Of several updates of one episode the last one: that with most events counted."""
    at = F.col("attempts") + F.col("trailing") + F.when(F.col("final") == "cut", 1).otherwise(0)
    return updates.groupBy("user_id").agg(F.max_by(F.struct("attempts", "trailing", "repeated", "final"), at).alias("s")).select("user_id", "s.*")


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
