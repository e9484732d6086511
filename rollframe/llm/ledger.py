"""Copies hidden by formatting: canonical keys and an incremental ledger of their counts."""

from __future__ import annotations

import copy
import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollframe import runtime
from rollframe.functions import text

#: Buckets of a new ledger, keys in a bucket up to which it stays, and deltas that a bucket may have.
BUCKETS, BUCKET_ROWS, DELTAS = 16, 2_000_000, 4
COUNTS = "key binary, copies long, first_id long"

_BLOCK = r"(?s)<tool_call>(.*?)</tool_call>"
_ESCAPE = r"\\(u[0-9a-f]{4}|.)"


def canonical_text(c: Column) -> Column:
    """The text without white space, punctuation and letter case, the fields of JSON objects in one order.

    Letters are folded, then the objects inside <tool_call> blocks are written with sorted keys (the order of blocks
    and of array items stays), then everything but letters and digits goes. A block that is no valid JSON keeps its
    own order. Text without letter or digit and null give null."""
    low = text.folded(c)
    between = F.split(low, _BLOCK)
    blocks = F.regexp_extract_all(low, F.lit(_BLOCK), 1)
    tidy = F.transform(blocks, lambda b: F.coalesce(F.regexp_replace(F.to_json(F.try_parse_json(b)), _ESCAPE, " "), b))
    # texts and blocks in turn: "toolcall" marks a block, as its tags would
    woven = F.concat_ws(" ", F.flatten(F.zip_with(between, tidy, lambda t, b: F.array(F.coalesce(t, F.lit("")), F.coalesce(F.concat(F.lit("toolcall "), b), F.lit(""))))))
    return F.nullif(F.regexp_replace(F.when(low.contains("<tool_call>"), woven).otherwise(low), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def key_of(*parts: Column) -> Column:
    """16-byte key of the parts; null if any of them is null."""
    whole = F.concat(*[x for p in parts for x in (p, F.lit("\x00"))])
    return F.unhex(F.md5(whole))


class Ledger:
    """Counts of canonical keys, kept in buckets in a shared folder and updated batch by batch.

    A batch is aggregated and laid beside the buckets it touches as a delta. A bucket with more than `deltas` of them is
    brought up to date by a full outer join of its counts with its deltas: counts add up and the earliest id stays. Ids
    already counted (repeated deliveries, within a batch or in an earlier one) are left out; they are kept in order, so that
    a look at a batch's range of ids skips the files outside it. Buckets double where they grow beyond `bucket_rows` keys.

    Everything a batch writes is new. A manifest with the next number, written aside and renamed, then makes it count; what
    is in memory changes after that only. So a batch that fails anywhere has not happened and can be given again, and of
    two writers of one ledger the second fails. Files of neither this manifest nor the one before are deleted. With a `root`
    the ledger outlives the session: rows given to it again change nothing."""

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS, deltas: int = DELTAS):
        self.spark, self.bucket_rows, self.deltas = spark, bucket_rows, deltas
        self.root = root or runtime.Scratch(spark, "ledger").path
        self.manifest = self._load() or {"version": 0, "buckets": buckets, "counts": {}, "seen": []}

    # the manifest is a few paths for each bucket
    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        _, p, fs = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _read_manifest(self, name: str) -> dict:
        jvm, p, fs = self._fs()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(p, name))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _load(self) -> dict | None:
        named = sorted(n for n in self._names() if n.startswith("manifest-") and n.endswith(".json"))
        return self._read_manifest(named[-1]) if named else None

    def _commit(self, manifest: dict) -> None:
        jvm, p, fs = self._fs()
        path = jvm.org.apache.hadoop.fs.Path
        new, final = path(p, f"new-{uuid.uuid4().hex}"), path(p, f"manifest-{manifest['version']:010d}.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        files.rename(new, final, none)  # fails where another writer has taken this number
        before, self.manifest = self.manifest, manifest
        keep = {f"manifest-{m['version']:010d}.json" for m in (before, manifest)}
        keep |= {x[len(self.root) :].strip("/").split("/")[0] for m in (before, manifest) for x in [*m["seen"], *[y for paths in m["counts"].values() for y in paths]]}
        for name in self._names():
            if name not in keep:
                fs.delete(path(p, name), True)

    def _bucket(self, c: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, counted: DataFrame, buckets: int) -> dict[str, str]:
        """Writes counts in folders by bucket; returns the folders."""
        path = f"{self.root}/counts-{uuid.uuid4().hex}"
        counted.withColumn("bucket", self._bucket(F.col("key"), buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)
        jvm, _, fs = self._fs()
        found = [s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path))]
        return {n.removeprefix("bucket="): f"{path}/{n}" for n in found if n.startswith("bucket=")}

    def _merged(self, manifest: dict, buckets: list[str]) -> DataFrame:
        """The counts of buckets: those laid down joined with their deltas, which are added up first."""
        base = self._read([manifest["counts"][b][0] for b in buckets], COUNTS)
        late = [p for b in buckets for p in manifest["counts"][b][1:]]
        if not late:
            return base
        deltas = self._read(late, COUNTS).groupBy("key").agg(F.sum("copies").alias("more"), F.min("first_id").alias("first_new"))
        both = base.join(deltas, "key", "full_outer")
        return both.select("key", (F.coalesce("copies", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("copies"), F.least("first_id", "first_new").alias("first_id"))

    def update(self, batch: DataFrame) -> None:
        """batch: (id long, key binary). Null ids and null keys are left out; an empty batch changes nothing."""
        rows = batch.select("id", "key").where(F.col("id").isNotNull() & F.col("key").isNotNull())
        new = copy.deepcopy(self.manifest)
        rows = rows.groupBy("id").agg(F.min("key").alias("key"))
        if new["seen"]:
            span = batch.where(F.col("key").isNotNull()).agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
            if span.low is None:
                return
            seen = self._read(new["seen"], "id long").where(F.col("id").between(span.low, span.high))
            rows = rows.join(seen, "id", "left_anti")
        rows = runtime.Scratch(self.spark, "batch").write(rows)
        if rows.isEmpty():
            return
        ids = f"{self.root}/seen-{uuid.uuid4().hex}"
        rows.select("id").sortWithinPartitions("id").write.parquet(ids)
        new["seen"].append(ids)
        counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"))
        for b, path in self._write(counted, new["buckets"]).items():
            new["counts"].setdefault(b, []).append(path)
        full = [b for b, paths in new["counts"].items() if len(paths) > self.deltas]
        if full:
            self._compact(new, full)
        if len(new["seen"]) > 8 * self.deltas:
            ids = f"{self.root}/seen-{uuid.uuid4().hex}"
            self._read(new["seen"], "id long").repartitionByRange("id").sortWithinPartitions("id").write.parquet(ids)
            new["seen"] = [ids]
        new["version"] += 1
        self._commit(new)

    def _compact(self, new: dict, full: list[str]) -> None:
        merged = runtime.Scratch(self.spark, "merged").write(self._merged(new, full))
        grown = merged.count() / len(full) / self.bucket_rows
        if grown > 1:  # more buckets: all are written again
            new["buckets"] *= 1 << math.ceil(math.log2(grown))
            rest = [b for b in new["counts"] if b not in set(full)]
            merged = merged.unionByName(self._merged(new, rest)) if rest else merged
            new["counts"] = {}
        for b, path in self._write(merged, new["buckets"]).items():
            new["counts"][b] = [path]

    def counts(self) -> DataFrame:
        """(key, copies, first_id): one row per record, with the number of its copies and the smallest id among them."""
        return self._merged(self.manifest, list(self.manifest["counts"]))


def pairs(rows: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(id, key) rows against the ledger: (rollout_id_a, rollout_id_b) for every further copy, a the smallest id.

    Keys with more than total / 1000 copies, of which there are fewer than 1000, are matched by broadcast; the others by
    a shuffle in which no key is large. So a record that makes up a third of all rows is never gathered in one task."""
    many = counts.where(F.col("copies") > 1).select("key", "copies", "first_id")
    hot = many.where(F.col("copies") > max(1000, total // 1000)).select("key", "first_id")
    cold = many.where(F.col("copies") <= max(1000, total // 1000)).select("key", "first_id")
    ids = rows.select("id", "key").where(F.col("id").isNotNull() & F.col("key").isNotNull())
    by_hot = ids.join(F.broadcast(hot), "key")
    by_cold = ids.join(F.broadcast(hot.select("key")), "key", "left_anti").join(cold, "key")
    both = by_hot.unionByName(by_cold).where(F.col("id") != F.col("first_id"))
    return both.select(F.col("first_id").alias("rollout_id_a"), F.col("id").alias("rollout_id_b")).distinct()
