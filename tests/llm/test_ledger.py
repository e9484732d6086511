import json

import pytest
from pyspark.sql import functions as F

from rollframe.llm import ledger as g

A = '看看<tool_call>{"name": "t", "arguments": {"action": "SUBMIT", "message": "a.\\nB"}}</tool_call>'


def canon(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.c for r in df.select("i", g.canonical_text(F.col("t")).alias("c")).orderBy("i").collect()]


def test_formatting_makes_no_difference(spark):
    same = [A, A.upper(), '看看　<tool_call>\n{"arguments":{"message":"A B","action":"submit"},\t"name":"T"}\n</tool_call>！', A.replace(" ", ""), "«" + A + "»"]
    assert len(set(canon(spark, same))) == 1


def test_content_does(spark):
    other = [A, A.replace("SUBMIT", "REFUSE"), A + A, A.replace("B", "B2"), A.replace("</tool_call>", ""), '<tool_call>{"a": 1}</tool_call><tool_call>{"b": 2}</tool_call>', '<tool_call>{"b": 2}</tool_call><tool_call>{"a": 1}</tool_call>', "ＡＢ", "AB"]
    assert len(set(canon(spark, other))) == len(other)


def test_nothing_to_compare(spark):
    assert canon(spark, [None, "", " 　", "…？！"]) == [None] * 4
    assert canon(spark, ["STRASSE", "straße"])[0] == canon(spark, ["Straße"])[0]


def batch(spark, rows):
    return spark.createDataFrame(rows, "id long, k string").select("id", F.encode("k", "utf-8").alias("key"))


def test_batches_add_up_and_ids_count_once(spark):
    book = g.Ledger(spark, buckets=3)
    book.update(batch(spark, [(5, "x"), (6, "x"), (6, "x"), (7, "y"), (None, "x"), (9, None)]))
    book.update(batch(spark, []))
    book.update(batch(spark, [(2, "x"), (5, "x"), (8, "z")]))
    again = g.Ledger(spark, root=book.root, buckets=3)  # a later session goes on from the manifest
    again.update(batch(spark, [(1, "z"), (7, "y")]))
    got = {bytes(r.key).decode(): (r.copies, r.first_id) for r in again.counts().collect()}
    assert got == {"x": (3, 2), "y": (1, 7), "z": (2, 1)}


def test_pairs_with_a_hot_record(spark):
    rows = [(i, "hot") for i in range(1500)] + [(2000, "a"), (2001, "a"), (2002, "b")]
    df = batch(spark, rows + rows[:10])
    book = g.Ledger(spark)
    book.update(df)
    got = {(r.rollout_id_a, r.rollout_id_b) for r in g.pairs(df, book.counts(), 3000).collect()}
    assert got == {(0, i) for i in range(1, 1500)} | {(2000, 2001)}


def test_empty_ledger(spark):
    assert g.Ledger(spark).counts().collect() == []


def content(book):
    return {bytes(r.key).decode(): (r.copies, r.first_id) for r in book.counts().collect()}


@pytest.mark.parametrize("step", ["_write", "_compact", "_commit"])
def test_a_batch_that_fails_can_be_given_again(spark, tmp_path, monkeypatch, step):
    first, second = batch(spark, [(5, "x"), (6, "y")]), batch(spark, [(7, "x"), (8, "x"), (5, "x")])
    book = g.Ledger(spark, str(tmp_path), deltas=1)
    book.update(first)

    def fails(*_):
        raise OSError("disk full")

    with monkeypatch.context() as m:
        m.setattr(g.Ledger, step, fails)
        with pytest.raises(OSError):
            book.update(second)
    assert content(book) == content(g.Ledger(spark, str(tmp_path))) == {"x": (1, 5), "y": (1, 6)}
    book.update(second)
    assert content(book) == content(g.Ledger(spark, str(tmp_path))) == {"x": (3, 5), "y": (1, 6)}


def test_days_one_by_one_are_as_all_at_once(spark, tmp_path):
    days = [[(d * 100 + i, f"k{(d * 7 + i * i) % 40}") for i in range(60)] + [(d * 100 - 3, f"k{((d - 1) * 7 + 97 * 97) % 40}")] * (d > 0) for d in range(12)]
    for day in days:  # every day its own session; each day is also delivered twice
        g.Ledger(spark, str(tmp_path), buckets=2, bucket_rows=5, deltas=2).update(batch(spark, day))
        g.Ledger(spark, str(tmp_path), buckets=2, bucket_rows=5, deltas=2).update(batch(spark, day))
    book, whole = g.Ledger(spark, str(tmp_path)), g.Ledger(spark)
    whole.update(batch(spark, [r for day in days for r in day]))
    assert content(book) == content(whole)
    assert book.manifest["buckets"] > 2 and book.manifest["version"] == len(days)
    named = {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")}
    assert len([n for n in named if n.startswith("manifest-")]) == 2 and not [n for n in named if n.startswith("new-")]
    kept = {p for m in named if m.startswith("manifest-") for p in [*json.loads((tmp_path / m).read_text())["seen"], *sum(json.loads((tmp_path / m).read_text())["counts"].values(), [])]}
    assert {n for n in named if not n.startswith("manifest-")} == {p[len(str(tmp_path)) :].strip("/").split("/")[0] for p in kept}


def test_second_writer_fails(spark, tmp_path):
    one, two = g.Ledger(spark, str(tmp_path)), g.Ledger(spark, str(tmp_path))
    one.update(batch(spark, [(1, "a")]))
    with pytest.raises(Exception, match="exist"):
        two.update(batch(spark, [(2, "a")]))
    assert content(g.Ledger(spark, str(tmp_path))) == {"a": (1, 1)}
