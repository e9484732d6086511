import pytest

from rollframe.llm import residue as r

PLAIN = ["同一地址406年内重复提出阳台光伏备案延续的，按变更处理。", "Time spent on missing papers is not counted, up to 68 days.", "Los vecinos deben traer el documento 55 con fecha y firma."]
BAD = [
    "尊敬的{{certNo}}：您申请的许可已于3月5日受理。", "请于[办理地点]前到{%申请人姓名%}领取结果。", "本通知适用于<<此处插入联系电话>>，收费5元。", "许可由__受理单位__办理。", "DEAR @@CASE.TITLE@@, CALL <AGENCY>.",
    "Hello %s, your permit number is %d.", "兹证明 ________ 于 ____年__月__日 办理。", "undefined 您好，您的许可编号为 undefined。", "[object Object] 已提交，[object Object] 待补。", "None年None月None日，nan 已完成 null 项核验。",
    "姓名：XXX 电话：XXXXXXXX 地址：XX市XX路XX号。", "Name: xxxxx  Phone: 000-0000-0000  Address: N/A N/A", "LOREM IPSUM PALORA VENIT, SEDRA MINTU QUALE DOREM, TAVI NUSCA FEROL.", "此处为示例文字，正式发布时请替换。",
    "502 Bad Gateway — upstream gateway-3 did not answer", "Traceback (most recent call last): KeyError: 'matter_3'", "404 您访问的页面不存在或已删除", "<noscript>开启 JS 才能看到完整内容</noscript>", "请启用浏览器的 JAVASCRIPT 功能后再访问本页。",
]
FINE = [
    "请在[附件一]中查看清单，编号[3]的材料可免交。", 'The record holds {"fee": 30} and is read by the desk program.', "培训讲义解释了什么是占位符，以及为何不能原样提交。", "昨日系统维护3小时，期间无法访问，现已恢复并补录8件。",
    "The service was unavailable for 4 hours yesterday and has since caught up on 9 files.", "费用栏以 $ 或 ¥ 标明币种，金额精确到 0.01。", "葛浦市为学习JavaScript的青年提供培训补贴，每人300元。", "404路公交站旁的500号房是临时受理点。", "样张中的下划线表示手写处，打印件须填完再交。",
    "Anything in curly braces on the sample form is filled in by the clerk, not by you.", "填写申请表时，姓名栏写全名，不要照抄示例中的“张三”。",
]


def found(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, label string")
    return {x.doc_id: x.label for x in r.residue(df.unionByName(df)).collect()}


def test_residue_alone_and_beside_content(spark):
    texts = BAD + [PLAIN[0] + b + PLAIN[1] for b in BAD] + FINE + PLAIN * 20 + [" ".join(PLAIN) + " " + f for f in FINE]
    assert set(found(spark, texts)) == set(range(2 * len(BAD)))


def test_long_null_and_empty(spark):
    got = found(spark, [None, "", PLAIN[0] * 20_000 + BAD[0], PLAIN[1]])
    assert got == {2: "placeholder"}
    assert found(spark, []) == {}


def test_exclusion_keeps_all_columns(spark):
    df = spark.createDataFrame([(1, BAD[0], "a"), (2, PLAIN[0], "b")], "doc_id long, text string, coverage string")
    assert [(x.doc_id, x.coverage) for x in r.without_residue(df, r.residue(df)).collect()] == [(2, "b")]


@pytest.mark.parametrize(("text", "marks"), [("a {{b}} c", r.SLOT), ("5% off and 10% more", ""), ("null and void", r.NOVALUE), ("[3]", ""), ("【申请人姓名】", r.SLOT), ("__init__", ""), ("<b>", "")])
def test_shapes(text, marks):
    assert "".join(c for c in r.shaped(text) if "\ue000" <= c <= "\ue006") == marks
