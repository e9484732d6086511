"""Calls of an outside function over a table: a cache, retries, and a rule for what fails."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollframe.operators import quality


def call(requests: DataFrame, key: str, payload: str, function: Callable[[str], str], retries: int = 2, wait: float = 0.0, closed: bool = False, rate_limit: int | None = None) -> DataFrame:
    """(key, answer, error): function(payload) for each different key, tried again up to `retries` times.

    What fails every time has a null answer and the last error's text; with closed it ends the query instead. Requests are
    called once a key, the smallest payload of each; null payloads are not called and have neither. The function must be
    picklable and is given texts only; nothing here opens a connection. rate_limit spreads the calls over so many tasks."""
    once = requests.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(payload).alias("_payload"))
    if rate_limit:
        once = once.repartition(rate_limit, key)
    kind = dict(once.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in zip(batch[key], batch["_payload"]):
                answer = error = None
                for attempt in range(retries + 1 if text is not None else 0):
                    try:
                        answer, error = function(text), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(wait * 2**attempt)
                if error and closed:
                    raise RuntimeError(error)
                out.append((k, answer, error))
            yield pd.DataFrame(out, columns=[key, "answer", "error"])

    return once.mapInPandas(run, f"`{key}` {kind}, answer string, error string")


def cached_call(requests: DataFrame, cache: DataFrame, key: str, payload: str, function: Callable[[str], str], default: str | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """(requests with answer and cached, new cache entries). Only keys that the cache (key, payload as answer, stored_at) lacks
    are called; what failed has `default` and goes into no cache. Give both frames their own written copy of the calls."""
    latest = cache.groupBy(key).agg(F.max_by("payload", "stored_at").alias("_hit"))
    misses = quality.cache_split(requests, cache, key)[1]
    called = call(misses, key, payload, function, **how)
    rows = requests.join(latest, key, "left").join(called.select(key, "answer"), key, "left")
    answered = rows.withColumns({"cached": F.col("_hit").isNotNull(), "answer": F.coalesce("_hit", "answer", F.lit(default))}).drop("_hit")
    return answered, called.where(F.col("answer").isNotNull()).select(key, F.col("answer").alias("payload"))
