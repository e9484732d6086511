"""File sources and sinks: JSON lines, CSV, steps in file names, keyed documents, hashes, manifests."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollframe import runtime


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """One object per line; blank lines are skipped, a broken line ends the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, line) of text files, lines counted from 1 in each file.

    Files are read in blocks by many tasks: a line's number is its place in its block and the number of lines in the blocks
    before it, which are counted first."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    blocks = rows.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # the blocks of a file
    blocks = runtime.cut(blocks.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    placed = runtime.join_sized(rows, blocks, ["file", "_block"], "inner", blocks.count())
    return placed.select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "line")


def read_jsonl_checked(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines): a bad line comes with its file, number and text and does not end the read.

    Lines are read as text, so that what is bad is known without a cache; blank lines are neither good nor bad."""
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    kind = F.schema_of_variant(F.try_parse_json("line"))
    ok = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    shape = schema.simpleString() if isinstance(schema, T.StructType) else schema
    good = lines.where(ok).select(F.from_json("line", shape).alias("r")).select("r.*")
    error = F.when(kind.isNull(), "no valid JSON").otherwise("no object")
    return good, lines.where(~ok).select("file", "line_no", "line", error.alias("error"))


def read_steps(spark: SparkSession, path: str, schema: T.StructType | str, step: str = "step") -> DataFrame:
    """JSON lines of a directory; a missing step is taken from a numeric file name."""
    name = F.regexp_extract("_metadata.file_name", r"(\d+)\.[a-z]+$", 1)
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.withColumn(step, F.coalesce(step, F.nullif(name, F.lit("")).cast("long")))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def numbered_files(spark: SparkSession, folder: str) -> list[tuple[int, str, int]]:
    """(number, path, modified in ms) of the files whose name before the ending is a number, by number. A listing by the
    folder's own file system, so that it may be on shared storage."""
    _, p, fs = _fs(spark, folder)
    found = [(s.getPath(), s.getModificationTime()) for s in fs.listStatus(p) if s.isFile()]
    return sorted((int(stem), f.toString(), at) for f, at in found if (stem := f.getName().rsplit(".", 1)[0]).isdigit())


def latest_step_file(spark: SparkSession, folder: str) -> str:
    """The file with the largest number as its name; raises where there is none."""
    found = numbered_files(spark, folder)
    if not found:
        raise FileNotFoundError(f"no numbered file in {folder}")
    return found[-1][1]


def files_with_checkpoint(spark: SparkSession, folder: str, checkpoints: str, name: str = "global_step_{}") -> list[tuple[int, str]]:
    """(step, path) of the numbered files above 0 that have a checkpoint folder, by step."""
    _, _, fs = _fs(spark, checkpoints)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [(n, f) for n, f, _ in numbered_files(spark, folder) if n > 0 and fs.exists(path(checkpoints, name.format(n)))]


def settled(spark: SparkSession, folder: str, seconds: float) -> bool:
    """True where the folder has files and none was changed in the last `seconds`: a snapshot that is no longer written."""
    import time

    _, p, fs = _fs(spark, folder)
    if not fs.exists(p):
        return False
    at, walk = [], fs.listFiles(p, True)
    while walk.hasNext():
        at.append(walk.next().getModificationTime())
    return bool(at) and max(at) / 1000 <= time.time() - seconds


def read_document(spark: SparkSession, path: str, needed: list[str]) -> dict:
    """One JSON document, which must be an object with the needed keys. It is read by the driver: a report, not data."""
    rows = spark.read.text(path, wholetext=True).collect()
    found = json.loads(rows[0].value) if len(rows) == 1 else None
    missing = needed if not isinstance(found, dict) else [k for k in needed if k not in found]
    if missing or found is None:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return found


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def read_csv_step(spark: SparkSession, path: str, step: int, order: str | None = None) -> DataFrame:
    """The row of a step in a CSV of metrics; of several the one with the largest `order` value. All columns as text, empty
    cells as null. A step that is not there raises, with the steps that are."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path).withColumn("_step", F.col("step").try_cast("double").cast("long"))
    found = rows.where(F.col("_step") == step).drop("_step")
    if found.isEmpty():
        there = rows.agg(F.array_join(F.slice(F.array_sort(F.collect_set("_step")), 1, 50), ", ").alias("s")).first().s
        raise ValueError(f"step {step} is not in {path}; there are: {there or 'none'}")
    return found.orderBy(F.col(order).try_cast("double").desc_nulls_last()).limit(1) if order else found


def read_seeds(spark: SparkSession, named: list[tuple[int, str]], schema: T.StructType | str, least: int = 3) -> DataFrame:
    """SEED=PATH documents in one table with a seed column; seeds must differ and be at least `least`."""
    seeds = [s for s, _ in named]
    if len(set(seeds)) != len(seeds):
        raise ValueError("a seed is given twice")
    if len(seeds) < least:
        raise ValueError(f"at least {least} seeds are needed")
    return reduce(DataFrame.unionByName, [spark.read.schema(schema).option("multiLine", True).json(p).withColumn("seed", F.lit(s)) for s, p in named])


def write_jsonl(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """Flat columns only: maps, arrays and structs are left out."""
    flat = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_splits(df: DataFrame, path: str, split: str = "split") -> str:
    """Parquet in one folder per split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)
    return path


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Keyed table after an upsert: of each key the row with the largest `at`; of equal ones the new row."""
    cols = stored.columns
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.select(*cols).withColumn("_new", F.lit(1)))
    rest = [c for c in cols if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(at), F.col("_new"))).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*cols)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of the files in a folder, read by the executors."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def folder_digest(spark: SparkSession, folder: str) -> str:
    """One SHA-256 for all files of a folder and their places in it; an empty folder is an error.

    Executors hash the files; names and hashes, as two texts a file each closed by a zero byte, are put in order of the
    names and hashed again. Files of hidden names, which Spark does not read, do not count."""
    _, root, fs = _fs(spark, folder)
    if not fs.listFiles(root, True).hasNext():
        raise ValueError(f"{folder} is empty")
    full = fs.makeQualified(root).toUri().getPath().rstrip("/") + "/"
    inner = F.substring_index("path", full, -1)
    listed = file_hashes(spark, folder).agg(F.array_sort(F.collect_list(F.struct(F.encode(inner, "utf-8").alias("k"), inner.alias("f"), "sha256"))).alias("all"))  # a row a file
    text = F.array_join(F.transform("all", lambda x: F.concat(x["f"], F.lit("\x00"), x["sha256"], F.lit("\x00"))), "")
    return listed.select(F.sha2(text, 256).alias("d")).first().d


def _write_text(spark: SparkSession, path: str, text: str, overwrite: bool) -> None:
    _, p, fs = _fs(spark, path)
    out = fs.create(p, overwrite)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def write_or_verify_manifest(spark: SparkSession, path: str, manifest: dict) -> str:
    """created or verified. A manifest that differs from the stored one is put beside it as *.candidate.json, and the
    call fails: manifests do not change. It may be on shared storage."""
    _, p, fs = _fs(spark, path)
    text = json.dumps(manifest, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    if not fs.exists(p):
        _write_text(spark, path, text, False)
        return "created"
    if json.dumps(read_document(spark, path, []), sort_keys=True, ensure_ascii=False, separators=(",", ":")) == text:
        return "verified"
    _write_text(spark, path.removesuffix(".json") + ".candidate.json", text, True)
    raise ValueError(f"{path} does not agree with this run")


def write_report(spark: SparkSession, path: str, sections: dict[str, DataFrame], facts: dict | None = None, most: int = 100_000) -> str:
    """One JSON file: facts, and each section's rows. A report is read by people: a section of more than `most` rows raises."""
    report = dict(facts or {})
    for name, rows in sections.items():
        found = [json.loads(r.j) for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).limit(most + 1).collect()]
        if len(found) > most:
            raise ValueError(f"{name} has more than {most} rows: write it as a table")
        report[name] = found
    _write_text(spark, path, json.dumps(report, ensure_ascii=False, indent=1), True)
    return path


def append_errors(errors: DataFrame, path: str) -> None:
    """Adds errors to a log of JSON lines, with the time in UTC; what is there stays."""
    errors.withColumn("logged_at", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.mode("append").json(path)


def write_with_meta(df: DataFrame, path: str, counts: dict[str, Column], facts: dict | None = None) -> dict:
    """JSON lines, and beside them `path`.meta.json with the rows written, the rows for which each condition holds, and facts.
    Counted while they are written: the data are read once."""
    from pyspark.sql import Observation

    seen = Observation("written")
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(e, F.lit(False))).alias(k) for k, e in counts.items()])
    write_jsonl(observed, path)
    meta = {**(facts or {}), **seen.get}
    _write_text(df.sparkSession, path.rstrip("/") + ".meta.json", json.dumps(meta, sort_keys=True, ensure_ascii=False), True)
    return meta


def write_dataset(df: DataFrame, path: str, split: str = "split", facts: dict | None = None) -> dict:
    """A data set: Parquet in a folder per split, and a manifest with the rows of each split. A manifest already there
    must agree."""
    spark = df.sparkSession
    data = f"{path.rstrip('/')}/data"
    write_splits(df, data, split)
    rows = {str(r[split]): r.n for r in spark.read.parquet(data).groupBy(split).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a split
    manifest = {**(facts or {}), "rows": rows}
    write_or_verify_manifest(spark, f"{path.rstrip('/')}/manifest.json", manifest)
    return manifest


def require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """df, whose rows are checked as they are read: the first row that is not ok ends the query."""
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
