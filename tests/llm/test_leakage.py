import random
import re
import time

from rollframe.llm import leakage as k

EN = "From Heron Lane the noodle vendor wrote in February that 505 railing forms were stamped within 47 days and nobody ever answered the letter"
ZH = "正月里矿车司机从渡口棚弄丢了427份护栏手续，拖了34天。中心窗口周四退回银行卡903页，因旧姓氏落在第24行。"


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, share double")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in k.leaks(d, i).collect()}


def test_whole_part_and_format(spark):
    words = EN.split()
    docs = [
        (1, "x " + EN + " y"),
        (2, EN.upper().replace(" ", "  \n")),
        (3, " ".join(words[:12])),
        (4, " ".join(words[:7]) + " zzz " + " ".join(words[7:14])),  # runs of 7 words only
        (5, " ".join(words[3:11])),  # 8 words of 24 are too few
        (6, "。".join(ZH)),
        (7, ZH[:30]),
        (8, ZH[:14] + "略" + ZH[15:28]),
        (9, None),
        (10, ""),
        (11, "甲" * 300_000 + ZH),
        (None, EN),
        (1, "x " + EN + " y"),
    ]
    assert found(spark, docs, [(7, EN), (8, ZH), (9, None), (None, EN), (10, "too short"), (7, EN)]) == {(1, 7), (2, 7), (3, 7), (6, 8), (7, 8), (11, 8)}


def test_nothing(spark):
    assert found(spark, [], [(7, EN)]) == set() == found(spark, [(1, EN)], []) == found(spark, [(1, EN)], [(3, "kurz")])


def test_passes_give_the_same(spark, monkeypatch):
    items = [(n, f"{n} " + " ".join(f"word{n}q{j}" for j in range(12))) for n in range(9)]
    docs = [(n, t) for n, t in items]
    want = found(spark, docs, items)
    monkeypatch.setattr(k, "PASS_CHARS", 300)
    assert found(spark, docs, items) == want == {(n, n) for n in range(9)}


def test_against_brute_force():
    rnd = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "bcdfg" for b in ("a", "e", "io", "u")]
    items = [(n, " ".join(rnd.choices(vocabulary, k=24))) for n in range(20)]
    texts = []
    for _ in range(300):
        words = rnd.choices(vocabulary, k=rnd.randint(0, 30))
        src = rnd.choice(items)[1].split()
        a = rnd.randint(0, 20)
        piece = src[a : a + rnd.randint(3, 24)]
        if rnd.random() < 0.3 and len(piece) > 4:
            piece[len(piece) // 2] = "zzz"
        at = rnd.randint(0, len(words))
        texts.append(" ".join(words[:at] + piece + words[at:]))
    want = set()
    for d, t in enumerate(texts):
        w = re.findall(r"\w+", t)
        for n, item in items:
            iw = item.split()
            hit = set()
            for a in range(len(iw) - 7):
                if any(w[b : b + 8] == iw[a : a + 8] for b in range(len(w) - 7)):
                    hit |= set(range(a, a + 8))
            if 2 * len(hit) >= len(iw):
                want.add((d, n))
    got = {(d, n) for d, n, _ in k.Matcher(items).search([k.folded(t)[0] for t in texts])}
    assert want and want <= got
    # beyond word boundaries of the document nothing else may be found
    assert all(any(" ".join(items[n][1].split()[a : a + 8]).replace(" ", "") in texts[d].replace(" ", "") for a in range(17)) for d, n in got - want)


def test_one_item_of_short_words_does_not_slow_the_others():
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(4, 9))) for _ in range(3000)]
    items = [(n, " ".join(rnd.choices(words, k=25))) for n in range(300)]
    short = (999, "it is a so we go on to be as is it so do go up at us or no if he is me")
    texts = [" ".join(rnd.choices(words, k=60)) for _ in range(400)] + [items[5][1], short[1]]
    clean = [k.letters(t) for t in texts]

    def timed(m):
        m.search(clean)
        began = time.perf_counter()
        got = m.search(clean)
        return time.perf_counter() - began, {(d, n) for d, n, _ in got}

    (before, _), (after, got) = timed(k.Matcher(items)), timed(k.Matcher([*items, short]))
    assert got == {(400, 5), (401, 999)}
    assert after < 4 * before + 0.2


def test_folding():
    for text in ["Straße ÉÑ 12_3 中文abc x\u0301", "", "\u200b!", "ﬁne ½ ²"]:
        s, words = k.folded(text)
        assert s == k.letters(text) and len(words) == len(s)
