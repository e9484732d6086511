"""Mixing sources to target weights along a curriculum: token demand, copies, training positions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollframe import runtime
from rollframe.functions import text

#: Default place of the public tokenizer that sizes are measured with; pass another path to use another one.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Documents in one part of a source's running sum.
PART = 20_000
#: The default schedule: sources with short documents come early, those with long ones late. TILT is how much the weight of
#: the first source rises above 1 at the start.
TILT = 0.5


def sized(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens): sources in lower_snake, null where there is none; null and empty texts have 0 tokens.

    Rows that repeat a doc_id count once (the largest of them); rows without doc_id are left out."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.canonical_id("source").alias("source"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("doc_id").isNotNull())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for batch in batches:
            texts = batch["text"].tolist()
            sizes: list[int] = []
            for at in range(0, len(texts), 256):
                sizes += [len(e.ids) for e in t.encode_batch(texts[at : at + 256], add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "tokens": sizes})

    counted = rows.mapInPandas(count, "doc_id long, source string, tokens long")
    return counted.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("r")).select("doc_id", "r.source", "r.tokens")


def plan(sizes: DataFrame, targets: DataFrame, budget: int | None = None, refill: bool = False) -> DataFrame:
    """One row per target: name, source, target_share, max_repeats, wanted, have, docs, supply.

    budget is the mixture's size in tokens, by default that of all documents, those of other sources included. A source
    without documents has 0 tokens; a null share or repeat limit counts as 0. supply is what the source has with all its
    repeats. Sources that fall short leave the mixture short; with refill their tokens are asked of the others, in
    proportion to their shares and as far as their supply goes. (A plan has a row per target: it is made on the driver.)"""
    own = sizes.groupBy("source").agg(F.sum("tokens").alias("have"), F.count(F.lit(1)).alias("docs"))
    total = F.lit(budget) if budget is not None else F.coalesce(F.col("total"), F.lit(0))
    want = targets.select(
        F.col("source").alias("name"), text.canonical_id("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")
    ).where(F.col("name").isNotNull())
    rows = want.join(own, "source", "left").crossJoin(F.broadcast(sizes.agg(F.sum("tokens").alias("total"))))  # one row
    have = F.coalesce("have", F.lit(0))
    rows = rows.select("name", "source", "target_share", "max_repeats", (F.col("target_share") * total).alias("wanted"), have.alias("have"), F.coalesce("docs", F.lit(0)).alias("docs"), (F.col("max_repeats") * have).alias("supply"))
    return _refilled(rows) if refill else rows


def _refilled(planned: DataFrame) -> DataFrame:
    rows = [r.asDict() for r in planned.collect()]  # one row a target
    while True:
        short = sum(max(0.0, r["wanted"] - r["supply"]) for r in rows)
        able = [r for r in rows if r["wanted"] < r["supply"] and r["target_share"] > 0]
        if short < 1 or not able:
            return planned.sparkSession.createDataFrame(rows, planned.schema)
        for r in rows:
            r["wanted"] = min(r["wanted"], float(r["supply"]))
        whole = sum(r["target_share"] for r in able)
        for r in able:
            r["wanted"] += short * r["target_share"] / whole


def curves(planned: DataFrame, schedule: dict[str, list[float]] | None = None) -> DataFrame:
    """Adds curve, the integral of each source's weight over the time from 0 to 1, as segments (share of the demand before,
    start, weight at the start, slope); the whole integral is 1.

    schedule: source -> weights at evenly spaced knots, straight between them; sources not named are flat. By default the
    weights follow the mean length of a source's documents, see TILT."""
    part = lambda b, t, w, k: F.struct(b.cast("double").alias("before"), F.lit(t).alias("start"), w.cast("double").alias("weight"), k.cast("double").alias("slope"))
    if schedule is None:
        rank = F.percent_rank().over(Window.orderBy(F.try_divide("have", "docs").asc_nulls_first(), "source"))  # a row a target
        first = 1 + TILT - 2 * TILT * rank
        return planned.withColumn("curve", F.array(part(F.lit(0), 0.0, first, (1 - first) * 2), part((first + 1) / 4, 0.5, F.lit(1), (1 - first) * 2)))
    out = F.when(F.lit(False), F.array(part(*[F.lit(0.0) if i != 1 else 0.0 for i in range(4)])))
    for name, weights in schedule.items():
        step = 1 / (len(weights) - 1)
        area = sum((a + b) / 2 * step for a, b in zip(weights, weights[1:]))
        segments, before = [], 0.0
        for i, (a, b) in enumerate(zip(weights, weights[1:])):
            segments.append(part(F.lit(before), i * step, F.lit(a / area), F.lit((b - a) / area / step)))
            before += (a + b) / 2 * step / area
        out = out.when(F.col("source") == name, F.array(*segments))
    return planned.withColumn("curve", out.otherwise(F.array(part(F.lit(0), 0.0, F.lit(1), F.lit(0)))))


def _time(share: Column, curve: Column) -> Column:
    """The time by which the source has given this share of its tokens: the integral of its weight, inverted."""
    at = F.element_at(F.filter(curve, lambda s: s["before"] <= share), -1)
    rest = share - at["before"]
    root = F.sqrt(F.greatest(at["weight"] * at["weight"] + 2 * at["slope"] * rest, F.lit(0.0)))
    return at["start"] + F.coalesce(F.try_divide(2 * rest, at["weight"] + root), F.lit(0.0))


def mixture(sizes: DataFrame, planned: DataFrame, schedule: dict[str, list[float]] | None = None, stretch: bool = True) -> DataFrame:
    """(position, until, doc_id, copy_no, source, tokens), sorted by position in [0, 1]; copy_no counts from 1.

    Every source is read pass by pass, its documents in a fixed random order, until it has given what is wanted (the last
    document may exceed it) or max_repeats passes are over. Each copy sits where the integral of its source's weight, the
    demand so far, reaches the middle of its tokens; until is where the demand reaches their end. A source that falls
    short is stretched over the whole time, or else its copies end where its supply does; until always tells the latter.
    The running sum of a source is made of parts of about PART documents, so that a source with a third of all documents
    is spread over many tasks; the sort is a range sort."""
    targets = runtime.cut(curves(planned, schedule).where(F.col("source").isNotNull() & (F.col("wanted") > 0) & (F.col("supply") > 0)).select("source", "have", "wanted", "supply", "max_repeats", "curve"))
    docs = sizes.where(F.col("doc_id").isNotNull() & (F.col("tokens") > 0))
    rows = docs.count()
    parts = max(1, -(-rows // PART))
    docs = runtime.join_sized(docs, targets, ["source"], "inner", targets.count())
    docs = docs.withColumns({"mix": F.xxhash64("doc_id", F.lit(11)), "part": F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")})
    sums = docs.groupBy("source", "part").agg(F.sum("tokens").alias("size"))
    before = sums.withColumn("base", F.sum("size").over(Window.partitionBy("source").orderBy("part")) - F.col("size")).drop("size")  # `parts` rows a source
    inside = Window.partitionBy("source", "part").orderBy("mix", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    docs = docs.join(before, ["source", "part"]).withColumn("ends", F.col("base") + F.sum("tokens").over(inside))
    starts = F.col("ends") - F.col("tokens")
    copies = F.least(F.col("max_repeats"), F.ceil((F.col("wanted") - starts) / F.col("have")))
    out = docs.withColumn("copies", copies.cast("int")).where(F.col("copies") > 0)
    out = out.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    end = (F.col("copy_no") - 1) * F.col("have") + F.col("ends")
    demand = F.least(F.col("wanted"), F.col("supply").cast("double")) if stretch else F.col("wanted")
    at = lambda tokens, of: F.least(F.lit(1.0), _time(F.least(F.lit(1.0), tokens / of), F.col("curve")))
    out = out.withColumns({"position": at(end - F.col("tokens") / 2, demand), "until": F.when(end >= F.col("wanted"), 1.0).otherwise(at(end, F.col("wanted")))})
    return out.select("position", "until", "doc_id", "copy_no", "source", "tokens").orderBy("position", "doc_id", "copy_no")


def shares(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """Per target: target_share, the share reached, tokens and copies in the mixture, the time until which it could meet its
    demand, and so whether the share could be met."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"), F.max("copy_no").alias("most_repeats"), F.max("until").alias("until"))
    got = runtime.cut(got)
    rows = planned.join(F.broadcast(got), "source", "left").crossJoin(F.broadcast(got.agg(F.sum("tokens").alias("whole"))))  # a row a target; one row
    tokens = F.coalesce("tokens", F.lit(0))
    until = F.when(F.col("wanted") <= 0, 1.0).otherwise(F.coalesce("until", F.lit(0.0)))
    return rows.select(
        F.col("name").alias("source"), "target_share", F.coalesce(F.try_divide(tokens, "whole"), F.lit(0.0)).alias("actual_share"), tokens.alias("tokens"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        until.alias("until"), (until >= 1.0).alias("reachable"),
    )
