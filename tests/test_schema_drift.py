import json

import pytest
from pyspark.sql import functions as F

from rollframe.operators import schema_drift as sd
from rollframe.plans import drift

SCHEMA = "run_id string, file_seq int, line_no int, payload string, path string"


def raw(spark, files, run="r"):
    rows = []
    for seq, lines in files:
        for n, line in enumerate(lines, 1):
            rows.append((run, seq, n, line if isinstance(line, (str, type(None))) else json.dumps(line), "clash"))
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return sorted((r.file_seq, r.change, r.field, r.new_field) for r in sd.drift(df).collect())


HEX = ["ab12" * 16, "0f" * 32, "9c" * 32]


def test_all_kinds(spark):
    files = [
        (1, [{"fp": h, "rate": r, "label": "ok", "temp": 14.6 + i} for i, (h, r) in enumerate(zip(HEX, (0.25, 1.0, 0.5)))]),
        (3, [{"hash": h, "rate": r, "temp": None, "label": "ok"} for h, r in zip(HEX, (0.5, 0.25, 1.0))]),  # 2 is missing; nulls have no type
        (4, [{"hash": h, "ratio": r, "flag": True} for h, r in zip(HEX, (0.5, 0.75, 1.0))]),
        (5, [{"hash": h, "ratio": str(r), "flag": True, "latency": [1, 2]} for h, r in zip(HEX, (0.5, 0.75, 1.0))]),
    ]
    want = [(3, "renamed", "fp", "hash"), (4, "added", "flag", ""), (4, "removed", "label", ""), (4, "removed", "temp", ""), (4, "renamed", "rate", "ratio"), (5, "added", "latency", ""), (5, "type_changed", "ratio", "")]
    assert found(raw(spark, files)) == want


def test_unlike_values_are_no_rename(spark):
    files = [(1, [{"temp": 20.0 + i} for i in range(6)]), (2, [{"share": i % 2 / 2} for i in range(6)]), (3, [{"label": "ok"}] * 6), (4, [{"digest": h} for h in HEX])]
    assert [c for c in found(raw(spark, files)) if c[1] == "renamed"] == []


@pytest.mark.parametrize("lines", [8, 40, 2000, 100_000])
def test_renames_at_every_size(spark, lines):
    """A file's length must not decide: fields of other values are no renames, fields of like values are."""
    i = F.col("id")
    hexed = lambda salt: F.sha2(F.concat(F.lit(salt), i.cast("string")), 256)
    colour = F.element_at(F.array(*map(F.lit, ["red", "green", "blue", "amber", "violet"])), (i % 5 + 1).cast("int"))
    rate = lambda salt: F.pmod(F.xxhash64(F.lit(salt), i), F.lit(4)) / 4.0
    reward = lambda salt: F.round(F.pmod(F.xxhash64(F.lit(salt), i), F.lit(9999)) / 10000.0, 4)
    first = F.struct(colour.alias("colour"), hexed("a").alias("fp"), rate("a").alias("rate"), reward("a").alias("reward"), (i % 7).alias("kept"), hexed("z").alias("note"))
    uuid = F.regexp_replace(hexed("u"), r"^(.{8})(.{4})(.{4})(.{4})(.{12}).*", "$1-$2-$3-$4-$5")
    second = F.struct(uuid.alias("uuid"), hexed("b").alias("digest"), rate("b").alias("share"), reward("b").alias("total"), (i % 7).alias("kept"), hexed("y").alias("note"))
    third = F.struct(uuid.alias("uuid"), hexed("c").alias("digest"), (i % 2).cast("double").alias("flag"), (200 + i % 90).alias("millis"), (i % 7).alias("kept"), hexed("x").alias("note"))
    of = lambda seq, what: spark.range(lines).select(F.lit("r").alias("run_id"), F.lit(seq).alias("file_seq"), i.cast("int").alias("line_no"), F.to_json(what).alias("payload"))
    got = found(of(1, first).unionByName(of(2, second)).unionByName(of(3, third)))
    assert [c for c in got if c[0] == 2] == [(2, "added", "uuid", ""), (2, "removed", "colour", ""), (2, "renamed", "fp", "digest"), (2, "renamed", "rate", "share"), (2, "renamed", "reward", "total")]
    assert [c for c in got if c[0] == 3] == [(3, "added", "flag", ""), (3, "added", "millis", ""), (3, "removed", "share", ""), (3, "removed", "total", "")]


def test_two_equal_matches_are_no_rename(spark):
    files = [(1, [{"a": f"{i:064x}", "k": 1} for i in range(40)]), (2, [{"xx": f"{i:064x}", "yy": f"{i + 7:064x}", "k": 1} for i in range(900, 940)])]
    assert [c for c in found(raw(spark, files)) if c[1] == "renamed"] == []


def test_broken_repeated_and_sparse_lines(spark):
    files = [(1, [{"a": 1, "b": 2}, {"a": 1}, {"a": 1}, '{"a"', "", None, "[1]", '"x"']), (2, [{"a": 1, "b": 2}, {"a": 1, "b": None}, {"a": "odd"}])]
    df = raw(spark, files)
    assert found(df.unionByName(df)) == [(2, "added", "b", "")]


def test_files_without_lines_and_empty_table(spark):
    assert found(raw(spark, [(1, [{"a": 1}]), (2, ["{"]), (3, [{"a": 1}])])) == [(2, "removed", "a", ""), (3, "added", "a", "")]
    assert found(raw(spark, [])) == []
    nulls = spark.createDataFrame([(None, 1, 1, "{}", ""), ("r", None, 1, "{}", ""), ("r", 1, None, '{"a": 1}', "")], SCHEMA)
    assert found(nulls) == []


def test_long_and_nested_values(spark):
    lines = sd.readable(raw(spark, [(1, [{"a": {"b": {"c": 1}, "d": "x" * 100_000}}])]))
    assert sorted((r.path, r.type) for r in sd.path_values(lines, 3).collect()) == [("a", "object"), ("a.b", "object"), ("a.b.c", "number"), ("a.d", "string")]


def test_typed_table_and_failed_casts(spark):
    types = {"step": "bigint", "case_fingerprint": "string", "required_tool_rate": "double", "process_compliant": "double"}
    files = [
        (1, [{"step": 5, "case_fingerprint": h, "required_tool_rate": 0.5, "process_compliant": 1.0} for h in HEX]),
        (2, [{"step": "10", "fp": h, "required_tool_rate": [1, 4], "process_compliant": "yes"} for h in HEX]),
        (3, [{"step": 15, "fp": {"alg": "sha256", "hex": h}, "requiredToolRate": "75%", "process_compliant": False} for h in HEX]),
        (4, [{"step": "soon", "fp": [h[:32], h[32:]], "requiredToolRate": "?", "process_compliant": None} for h in HEX]),
    ]
    df = raw(spark, files)
    lines = sd.readable(df)
    values = sd.typed_values(sd.path_values(lines), sd.aliases(sd.drift(df), list(types)), types)
    got = {(r.file_seq, r.line_no): (r.step, r.case_fingerprint, r.required_tool_rate, r.process_compliant) for r in sd.unified(lines, values, types).collect()}
    assert got[1, 1] == (5, HEX[0], 0.5, 1.0) and got[2, 2] == (10, HEX[1], 0.25, 1.0)
    assert got[3, 3] == (15, HEX[2], 0.75, 0.0) and got[4, 1] == (None, HEX[0], None, None)
    assert {(r.file_seq, r.how) for r in sd.loose_casts(values).collect()} == {(2, "part_of_whole"), (2, "yes_no"), (3, "longest_text"), (3, "percent"), (3, "yes_no"), (4, "joined_items")}
    plain = sd.typed_values(sd.path_values(lines), sd.aliases(sd.drift(df), list(types)), types, loose=())
    assert {r.path for r in sd.failed_casts(plain).where("file_seq = 2").collect()} == {"required_tool_rate", "process_compliant"}
    failed = {(r.file_seq, r.path, r.failed) for r in sd.failed_casts(values).collect()}
    assert failed == {(4, "step", 3), (4, "requiredToolRate", 3)}


def test_table_has_every_field_of_the_rollouts(spark, tmp_path):
    files = [(1, [{"step": 5, "rollout_id": 2**60 + 1, "reward": 0.25, "logged_at": "2026-01-02 03:04:05", "judge_clarity": "3"}] * 2), (2, [{"step": 6, "reward": "high", "logged_at": "soon"}] * 2)]
    raw(spark, files).write.parquet(f"{tmp_path}/raw_rollouts.parquet")
    rollouts = spark.createDataFrame([], "rollout_id long, run_id string, step long, reward double, judge_clarity double, logged_at timestamp_ntz")
    rollouts.write.parquet(f"{tmp_path}/rollouts.parquet")
    table = drift.p4_table(spark, str(tmp_path))
    assert set(rollouts.dtypes) <= set(table.dtypes) and len(table.columns) == len(set(table.columns))
    got = {(r.file_seq, r.step, r.rollout_id, r.reward, r.judge_clarity, str(r.logged_at)) for r in table.collect()}
    assert got == {(1, 5, 2**60 + 1, 0.25, 3.0, "2026-01-02 03:04:05"), (2, 6, None, None, None, "None")}
    assert {(r.field, r.failed) for r in drift.p4_failed_casts(spark, str(tmp_path)).collect()} == {("reward", 2), ("logged_at", 2)}
