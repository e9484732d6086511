import json
import random

from pyspark.sql import functions as F

from rollframe.llm import pairs as p

ZH = "我想在砾溪办理老宅修缮许可新办，店面大约15平，需要怎么做？"
EN = "My father needs the street stall permit in Gepu, this is my first time, can you handle it?"


def call(action, message=None, **more):
    args = {"action": action, **({"message": message} if message is not None else {}), **more}
    return f"<tool_call>{json.dumps({'name': 'government_service', 'arguments': args}, ensure_ascii=False)}</tool_call>"


GOOD_ZH = "老宅修缮许可新办的政策、资格、材料和风险都核过了，现已递交，编号NO.77。"
GOOD_EN = "All four checks passed, so I sent the street stall permit to the office. Keep receipt 88."
NO_ZH = "抱歉，我只是一个语言模型，没办法处理这类事务。"
OUTPUTS = {
    1: ("a", GOOD_ZH, None),
    2: ("a", call("ASK_USER", slot="x") + call("SUBMIT", GOOD_ZH), None),
    3: ("a", call("SUBMIT", GOOD_ZH) + call("POLICY_SEARCH", query="x"), "trailing"),
    4: ("a", None, "empty"),
    5: ("a", " ​…", "empty"),
    6: ("a", call("REFUSE"), "empty"),
    7: ("a", call("REFUSE", "？！"), "empty"),
    8: ("a", "您的问题是：" + ZH, "copied"),
    9: ("a", call("SUBMIT", ZH + ZH), "copied"),
    10: ("b", EN[:70], "copied"),
    11: ("a", NO_ZH, "refusal"),
    12: ("c", call("REFUSE", NO_ZH), "refusal"),
    13: ("a", call("REFUSE", "我不能跳过核验，况且查到重复申请，老宅修缮许可新办已拒绝，参考号622。"), None),
    14: ("a", GOOD_EN, "language"),
    15: ("b", GOOD_ZH, "language"),
    16: ("b", "Leider fehlt eine Unterlage, deshalb können wir den Vorgang nicht annehmen; Frist 9 Tage.", "language"),
    17: ("b", "All four checks passed, so I sent the 老宅修缮许可新办 to the office. Keep receipt 88.", None),
    18: ("b", GOOD_EN[:-1] + " before going to the offi", "truncated"),
    19: ("a", call("ASK_USER", slot="x") + call("SUBMIT", GOOD_ZH)[:-30], "truncated"),
    20: ("a", call("SUBMIT", GOOD_ZH).upper(), None),
    21: ("a", "经逐项检查未见异常，现将老宅修缮许可新办报送青碇行政审批处，回执为pk-0", None),
    22: (None, "", None),
    23: ("unknown", "…", "empty"),
    24: ("a", "字" * 200_000 + "。", None),
}


def frames(spark, outputs):
    rollouts = spark.createDataFrame([(i, c, o, "x") for i, (c, o, _) in outputs.items() for _ in range(2)], "rollout_id long, case_id string, output string, kind string")
    cases = spark.createDataFrame([("a", "m1", ZH, "q"), ("a", "m1", ZH, "q"), ("b", "m2", EN, "q"), ("c", "m3", ZH, "q"), ("d", None, None, "q"), (None, "m4", "x", "q")], "case_id string, matter_id string, user_request string, q string")
    return rollouts, cases


def test_each_kind(spark):
    got = {(r.rollout_id, r.defect) for r in p.defects(*frames(spark, OUTPUTS)).collect()}
    assert got == {(i, d) for i, (_, _, d) in OUTPUTS.items() if d}


def test_empty_tables(spark):
    rollouts, cases = frames(spark, OUTPUTS)
    assert p.defects(rollouts.limit(0), cases).collect() == []
    found = {r.rollout_id for r in p.defects(rollouts, cases.limit(0)).where("defect = 'empty'").collect()}
    assert found == {4, 5, 6, 7, 23}


def brute(texts):
    """Clusters by comparing all pairs."""
    sets = {t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))} for t in texts}
    links = [(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return links


def test_links_against_all_pairs(spark, monkeypatch):
    rnd = random.Random(4)
    texts = set()
    for k in range(12):  # templates of 30 words of which one or two are other words: similar, and not all to one of them
        words = [f"t{k}w{i}" for i in range(60)]
        for _ in range(25):
            own = list(words)
            for _ in range(rnd.randint(0, 2)):
                own[rnd.choice([0, 1, 58, 59])] = f"x{rnd.randint(0, 9)}"
            texts.add(" ".join(own))
    texts = sorted(texts)
    links = brute(texts)
    assert len(links) > 1000
    for limit in (256, 8):  # buckets compared at once, and buckets parted by further bands
        monkeypatch.setattr(p, "BUCKET", limit)
        got = {r.opening: r.cluster for r in p.clusters(spark.createDataFrame([(t,) for t in texts], "opening string")).collect()}
        assert sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links)
        assert len({got[t] for t in texts}) >= 12


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    # two and two are alike; with all others they share most words, so that large buckets are all that most bands give
    monkeypatch.setattr(p, "BUCKET", 4)
    for own, common in ((1, 14), (6, 33)):  # joined by subsets, and more than WIDE shingles
        twos = [[" ".join([f"k{k}w{i}" for i in range(own)] + [f"t{i}" for i in range(common)] + [f"{side}{k}"]) for side in "xy"] for k in range(40)]
        assert len(brute(sum(twos, []))) == 40
        got = {r.opening: r.cluster for r in p.clusters(spark.createDataFrame([(t,) for two in twos for t in two], "opening string")).collect()}
        assert [k for k, (a, b) in enumerate(twos) if got[a] != got[b]] == []
        assert len(set(got.values())) == 40


def test_subsets_join_what_all_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(p, "BUCKET", 2)
    rnd = random.Random(1)
    texts = set()
    for _ in range(400):  # 1 to 16 words of one text, some changed
        words = [f"w{i}" for i in range(rnd.choice([16, 16, 16, 13, 11, 9, 8, 4, 1]))]
        words = words[rnd.choice([0, 0, 0, 1]) : len(words) - rnd.choice([0, 0, 0, 1, 2])]
        for _ in range(rnd.randint(0, 2) if words else 0):
            words[rnd.choice([0, 0, -1, -1, len(words) // 2])] = f"x{rnd.randint(0, 5)}"
        texts.add(" ".join(words))
    texts = sorted(texts - {""})
    links, root = brute(texts), {t: t for t in texts}
    assert len(links) > 200
    for a, b in links:
        old, new = root[a], root[b]
        root = {t: new if r == old else r for t, r in root.items()}
    got = {r.opening: r.cluster for r in p.clusters(spark.createDataFrame([(t,) for t in texts], "opening string")).collect()}
    assert len(set(zip(root.values(), (got[t] for t in root)))) == len(set(root.values())) == len(set(got.values()))


def test_refusals_in_words_of_no_list(spark):
    things = ["老宅修缮许可", "流动摊点备案", "夜市经营执照", "用水过户登记", "校车使用核准", "宠物诊疗许可", "street stall permit", "night market licence", "water account transfer", "school bus filing", "pet clinic registration", "balcony solar grant"]
    cases = [(f"c{i}", f"m{i}", f"我想在砾溪办理{x}，手头只有身份证，请问怎么做？" if i < 6 else f"My father needs the {x} in Gepu, he only has the identity card, how does it work?") for i, x in enumerate(things)]
    no = {"zh": ["此事恕难从命，您还是另请高明吧。", "这一类事我这边接不了，也没法给您意见。", "不好意思，这不是我该做的事，先到这里。"], "en": ["That is not something I will be getting into today.", "My rules don't let me work on matters of this kind.", "No, I would rather leave this one alone, thank you."]}
    yes = {"zh": ["{}的四项检查都已通过，我已递交，不需要再来窗口。", "{}缺一份材料，我不能受理，请补交后再办。"], "en": ["I cannot accept the {} as one paper is not valid.", "All checks for the {} passed and I have sent it on, no further papers needed."]}
    bland = {"zh": ["资料已核对，没有发现问题，我已提交。"], "en": ["I have checked everything and found no problem."]}
    rows, wanted = [], set()
    for i, x in enumerate(things):
        lang = "zh" if i < 6 else "en"
        for n, text in enumerate(no[lang] + [t.format(x) for t in yes[lang]] + bland[lang]):
            rows.append((100 * i + n, f"c{i}", text if n % 2 else call("REFUSE", text)))
            if n < 3:
                wanted.add(100 * i + n)
    got = p.defects(spark.createDataFrame(rows, "rollout_id long, case_id string, output string"), spark.createDataFrame(cases, "case_id string, matter_id string, user_request string"))
    assert {(r.rollout_id, r.defect) for r in got.collect()} == {(i, "refusal") for i in wanted}


def test_large_requests_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(p, "PROMPT_BYTES", 10)
    got = {(r.rollout_id, r.defect) for r in p.defects(*frames(spark, OUTPUTS)).collect()}
    assert got == {(i, d) for i, (_, _, d) in OUTPUTS.items() if d}


def test_languages(spark):
    texts = ["您好，请到窗口办理。", "Please bring the form to the desk.", "Bitte bringen Sie das Formular mit.", "Veuillez apporter le dossier avec vous.", "Traiga el formulario con su firma.", "Por favor traga o formulário e não o envie pelo correio.", "Si prega di portare il modulo con la firma.", "Breng het formulier mee naar de balie en teken het.", "Принесите форму в окно.", "窓口に申請書をお持ちください。", "양식을 창구로 가져오세요.", "1234", None]
    df = p._scripts(spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("t", F.lower("t")), "t", "out")
    assert [r.out for r in df.orderBy("i").collect()] == ["zh", "en", "de", "fr", "es", "pt", "it", "nl", "ru", "ja", "ko", None, None]


def test_copy_changed_in_a_few_places_is_copied(spark):
    request = "".join(chr(0x4E00 + 37 * i) for i in range(100))
    changed = "".join("x" if i in (22, 52, 82) else c for i, c in enumerate(request))  # 77 of 95 pieces are left
    too_few = "".join("x" if i % 12 == 6 else c for i, c in enumerate(request))
    rollouts = spark.createDataFrame([(1, "a", changed + "。"), (2, "a", request + "。"), (3, "a", too_few + "。")], "rollout_id long, case_id string, output string")
    cases = spark.createDataFrame([("a", "m1", request)], "case_id string, matter_id string, user_request string")
    assert {r.rollout_id for r in p.defects(rollouts, cases).where("defect = 'copied'").collect()} == {1, 2}
