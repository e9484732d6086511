import json

import pytest
from pyspark.sql import functions as F

from rollframe.functions import text
from rollframe.operators import curriculum as cu
from rollframe.operators import dialogue as dl
from rollframe.operators import external
from rollframe.operators import quality as q
from rollframe.sources import files


def test_line_numbers_over_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(1, 2001)))
    (tmp_path / "b.txt").write_text("one\n\ntwo\n")
    (tmp_path / "c.txt").write_text("")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "1000")  # some twenty blocks for the first file
    try:
        got = files.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(key, before)
    a = {r.line_no: r.line for r in got if r.file.endswith("a.txt")}
    assert a == {i: f"line {i}" for i in range(1, 2001)}
    assert sorted((r.line_no, r.line) for r in got if r.file.endswith("b.txt")) == [(1, "one"), (2, ""), (3, "two")]


def test_steps_with_a_checkpoint_and_settled_folders(spark, tmp_path):
    for n in ("0", "5", "10", "25", "note"):
        (tmp_path / f"{n}.jsonl").write_text("{}")
    for n in (0, 10, 25):
        (tmp_path / "ck" / f"global_step_{n}").mkdir(parents=True)
    assert [n for n, _ in files.files_with_checkpoint(spark, str(tmp_path), str(tmp_path / "ck"))] == [10, 25]
    assert files.settled(spark, str(tmp_path), 0) and not files.settled(spark, str(tmp_path), 3600) and not files.settled(spark, str(tmp_path / "none"), 0)
    assert not files.settled(spark, str(tmp_path / "ck"), 0)  # no file in it


def test_csv_of_a_step_and_documents(spark, tmp_path):
    (tmp_path / "m.csv").write_text("step,at,v\n1,1,a\n2.0,9,b\n2,10,\n")
    assert tuple(files.read_csv_step(spark, str(tmp_path / "m.csv"), 2, "at").first()) == ("2", "10", None)
    with pytest.raises(ValueError, match="there are: 1, 2"):
        files.read_csv_step(spark, str(tmp_path / "m.csv"), 7)
    (tmp_path / "r.json").write_text('{"a": {"x": 1}}')
    assert files.read_document(spark, str(tmp_path / "r.json"), ["a"]) == {"a": {"x": 1}}
    with pytest.raises(ValueError, match="lacks b"):
        files.read_document(spark, str(tmp_path / "r.json"), ["a", "b"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", 0.5), (2, "train", None), (3, "test", 1.0)], "id int, split string, v double")
    meta = files.write_with_meta(df, str(tmp_path / "out"), {"scored": F.col("v").isNotNull()}, {"by": "test"})
    assert meta == {"by": "test", "rows": 3, "scored": 2} == json.loads((tmp_path / "out.meta.json").read_text())
    files.write_report(spark, str(tmp_path / "report.json"), {"rows": df}, {"n": 3})
    report = json.loads((tmp_path / "report.json").read_text())
    assert report["n"] == 3 and {"id": 2, "split": "train", "v": None} in report["rows"]
    with pytest.raises(ValueError, match="more than 2"):
        files.write_report(spark, str(tmp_path / "report.json"), {"rows": df}, most=2)
    for _ in range(2):
        files.append_errors(df.select("id", F.lit("bad").alias("error")), str(tmp_path / "log"))
    log = spark.read.json(str(tmp_path / "log"))
    assert log.count() == 6 and log.where("logged_at IS NULL").count() == 0
    assert files.write_dataset(df, str(tmp_path / "set"))["rows"] == {"train": 2, "test": 1}
    assert files.write_dataset(df, str(tmp_path / "set"))["rows"] == {"train": 2, "test": 1}
    with pytest.raises(ValueError, match="agree"):
        files.write_dataset(df.limit(1), str(tmp_path / "set"))


def test_outside_calls(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def judge(t):
        n = len([p for p in log.iterdir() if p.name.startswith(t)])
        (log / f"{t}-{n}").touch()
        if t == "never" or (t == "twice" and n < 2):
            raise OSError("busy")
        return t.upper()

    rows = spark.createDataFrame([("k1", "ok"), ("k1", "ok"), ("k2", "twice"), ("k3", "never"), ("k4", None), (None, "x"), ("k5", "old")], "key string, text string")
    got = {r.key: (r.answer, r.error) for r in external.call(rows, "key", "text", judge, retries=2).collect()}
    assert got == {"k1": ("OK", None), "k2": ("TWICE", None), "k3": (None, "OSError: busy"), "k4": (None, None), "k5": ("OLD", None)}
    assert len(list(log.iterdir())) == 1 + 3 + 3 + 1  # one call a key, and the repeats of those that failed
    with pytest.raises(Exception, match="busy"):
        external.call(rows.where("key = 'k3'"), "key", "text", judge, closed=True).collect()
    cache = spark.createDataFrame([("k5", "older", 1), ("k5", "kept", 2)], "key string, payload string, stored_at int")
    answered, new = external.cached_call(rows, cache, "key", "text", lambda t: t if t != "never" else 1 / 0, default="none")
    assert {(r.key, r.answer, r.cached) for r in answered.collect()} == {("k1", "ok", False), ("k2", "twice", False), ("k3", "none", False), ("k4", "none", False), (None, "none", False), ("k5", "kept", True)}
    assert {r.key for r in new.collect()} == {"k1", "k2"}
    assert external.call(rows.limit(0), "key", "text", judge).collect() == []


def test_arrays_of_a_dialogue(spark):
    docs = spark.createDataFrame([(1, "User: a b\nAgent: c d e\nUser: f\nAgent: g"), (2, "User: x"), (3, None)], "id int, t string")
    turned = dl.target_turns(dl.turns(docs, "id", "t"), "id", ["Agent"])
    s = {r.id: r for r in dl.serialized(turned, "id").withColumn("w", dl.turn_balanced("mask", "turn")).collect()}
    assert (s[1].token, s[1].mask, s[1].turn) == (list("abcdefg"), [0, 0, 1, 1, 1, 0, 1], [-1, -1, 0, 0, 0, -1, 1])
    assert s[1].w == pytest.approx([0, 0, 1 / 3, 1 / 3, 1 / 3, 0, 1]) and s[2].mask == [0] and 3 not in s
    assert [r.id for r in dl.overlong(dl.serialized(turned, "id"), "token", 3).collect()] == [1]


def test_loss_is_shifted(spark):
    n = dl.NO_LABEL
    rows = [(1, [n, n, 7, 8], [0.0, 0.0, 0.5, 1.0], [9.0, 2.0, 4.0, 99.0]), (2, [5], [1.0], [3.0]), (3, [7, n, n], [1.0, 0.0, 0.0], [1.0, 1.0, 1.0]), (4, [], [], [])]
    df = spark.createDataFrame(rows, "id int, y array<long>, w array<double>, l array<double>")
    got = {r.id: r.loss for r in df.select("id", dl.shifted_loss(F.col("y"), F.col("w"), F.col("l")).alias("loss")).collect()}
    assert got == {1: pytest.approx((0.5 * 2 + 1.0 * 4) / 1.5), 2: 0.0, 3: 0.0, 4: 0.0}  # the first token predicts the second


def test_collation(spark):
    df = spark.createDataFrame([(1, 0, [4, 5, 6], [0, 1, 1], [0.0, 0.5, 0.5]), (2, 0, [7], [1], [1.0]), (3, 1, [8], [1], [1.0])], "id int, b int, ids array<long>, mask array<int>, w array<double>")
    got = {r.id: r for r in dl.collated(df, "b", "ids", "mask", "w", 0).collect()}
    assert (got[1].labels, got[2].labels, got[2].ids, got[2].attention, got[2].w) == ([-100, 5, 6], [7, -100, -100], [7, 0, 0], [1, 0, 0], [1.0, 0.0, 0.0]) and got[3].ids == [8]
    with pytest.raises(Exception, match="no target"):
        dl.collated(df.withColumn("mask", F.when(F.col("id") == 3, F.array(F.lit(0))).otherwise(F.col("mask"))), "b", "ids", "mask", "w", 0).collect()


def test_scores_by_priority(spark):
    rows = spark.createDataFrame([("a", None, 0.4), ("b", 1.5, 0.1), ("c", None, None)], "s string, process_pass_at_k double, pass_at_1 double")
    scores = cu.first_metric(rows)
    assert {r.s: (r.score, r.source) for r in scores.collect()} == {"a": (0.4, "pass_at_1"), "b": (1.0, "process_pass_at_k"), "c": (None, None)}
    strata = spark.createDataFrame([("a",), ("b",)], "s string")
    assert cu.with_scores(strata, scores, "s").count() == 2
    for missing in ("c", "d"):
        with pytest.raises(Exception, match=f"no score for {missing}"):
            cu.with_scores(spark.createDataFrame([(missing,)], "s string"), scores, "s").collect()
    with pytest.raises(Exception, match="only train rows"):
        cu.only_split(spark.createDataFrame([("train",), (None,)], "split string"), "split").collect()


def test_label_audits(spark):
    df = spark.createDataFrame([("m", "s", "A", "A"), ("m", "t", "A", "B"), ("n", "t", None, None), (None, "t", None, "B")], "m string, s string, got string, want string")
    got = {(r.grouped_by, r.value): (r.n, r.conflicts) for r in q.label_conflicts(df, F.col("got"), F.col("want"), ["m", "s"]).collect()}
    assert got == {("m", "m"): (2, 1), ("m", "n"): (1, 0), ("m", None): (1, 1), ("s", "s"): (1, 0), ("s", "t"): (3, 2), (None, None): (4, 2)}
    assert [(r.n, r.labels) for r in q.contradictions(df, ["m"], F.col("want")).collect()] == [(2, 2)]


def test_nested_cases_and_slices(spark):
    case = {"case_id": "x", "hidden_truth": {}, "rules": {"a": 1}}
    deep = json.dumps({"a": 1, "b": json.dumps({"c": {"d": json.dumps(case)}}), "e": case | {"case_id": "later"}})
    df = spark.createDataFrame([(1, deep), (2, "{"), (3, None), (4, json.dumps([case])), (5, "say ```x``` {a} b} c"), (6, "} {")], "id int, j string")
    got = {r.id: (json.loads(r.c)["case_id"] if r.c else None, r.s) for r in df.select("id", text.find_case("j").alias("c"), text.brace_slice(F.col("j")).alias("s")).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "x", 2: None, 3: None, 4: None, 5: None, 6: None}
    assert (got[5][1], got[6][1], got[2][1]) == ("{a} b}", None, None)
    fenced = spark.createDataFrame([("```json\n{}\n```",), ("{}",)], "t string").select(text.unfenced(F.col("t")).alias("u"))
    assert [r.u for r in fenced.collect()] == ["{}", "{}"]
