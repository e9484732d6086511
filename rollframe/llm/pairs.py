"""Defective prompt and response pairs of agent rollouts.

Openings of the responses are clustered by MinHash with verified similarity; clusters that recur across unrelated
prompts without a word about their cases are refusals. Copy, language and termination checks label the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollframe import runtime
from rollframe.functions import text

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 12, 4
#: Members up to which all pairs of a bucket are compared one by one; in larger buckets common subsets tell which are alike.
BUCKET = 256
#: Tokens (words, or single Chinese characters) of an opening.
OPENING = 16
#: Shingles up to which subsets are spelled out: at most 79 for each opening; no opening of this length has more shingles.
WIDE = OPENING - SHINGLE + 1
#: A template recurs if prompts of at least so many matters have it.
MATTERS = 2
#: Share of a cluster's replies that may be about their case where it is still a refusal.
ABOUT = 0.2
#: Bytes of requests up to which they are broadcast; beyond, rollouts and requests are shuffled by case, hot cases spread.
PROMPT_BYTES = 16 << 20
#: Letters in a row that count as taken from the request, and the shares that make a copy.
GRAM, TAKEN, WHOLE = 6, 0.72, 0.5

_FINAL = r'(?s)\\?"action\\?"\s*:\s*\\?"\s*(submit|refuse)\s*\\?"'
_TAG = r"^[\s\p{P}\p{Z}\p{Cf}]*\[[^\]]{0,40}\]"
_LEAD = r"^[\s\p{P}\p{Z}\p{Cf}\p{S}]*(您的问题是|您问的是|你的问题是|you asked|your question (is|was)|you wrote|su pregunta es)"
#: Letters of the request that a reply must share in a row to be about the case: Chinese, other scripts.
OWN_HAN, OWN_OTHER = 4, 10
#: Words that say no, that speak of work, of oneself and of a result, as they stand in an opening (letters parted by blanks);
#: each is a weak sign only.
_NO = r"\b(no|not|never|t|cannot|unable|decline|refuse|sorry|unfortunately|outside|beyond|nicht|pas|lo siento)\b|[不没无恕]|抱歉|遗憾|超出|拒绝"
_UNABLE = r"\b(cannot|can t|can not|unable|not able|won t|will not|wouldn t|would not|couldn t|decline|refuse|no puedo|no podemos|nicht|ne peux)\b|无法|不能|没办法|不便|不方便|恕|帮不|办不|超出|outside|beyond"
_WORK = r"\b(help|assist|answer|respond|discuss|take part|engage|provide|process|ask|do|allowed|able|model|abilit|scope|ayudar|responder|helfen|aider)|协助|帮|回答|答复|处理|提供|参与|讨论|操作|效劳|能力|模型|智能|话题|请求"
_SELF = r"\b(i|me|my|we|yo|ich|je)\b|我"
_DONE = r"\b(submitted|sent|passed|checked|approved|received|accepted|lodged|filed|complete|done|granted|forwarded|processed|meets?|found|enough|complies|enviado|presentado|aprobado)\b|已|核对|符合|通过|提交|送出|递交|受理|办结|发现"
#: Common words of each language; a parameter of `defects`, so that other languages can be added.
LANGUAGES = {
    "en": "the and is are was to of for you with not that on at be it this your have from please which will by",
    "de": "der die das und ist sind wir nicht bitte unter ihr ihre wurde sich den eine auf können ein dem mit für von wird",
    "fr": "le la les des et est sont nous vous une votre sous ne donc pas dossier rien du dans pour avec sur qui être",
    "es": "el los las es está porque un su con todo falta en quedó hemos por para una del al que se lo como más",
    "pt": "os as um uma não para com por foi são seu sua em no na dos das pelo pela está você mas ao mais",
    "it": "il gli un una non per con di che del della sono è nel alla ha anche questo sua si dal più lo i",
    "nl": "het een en van is niet zijn met voor op te aan ook maar bij worden naar dit deze uw wij heeft geen de",
}
#: Scripts that tell a language by themselves.
SCRIPTS = {"ru": "IsCyrillic", "ar": "IsArabic", "ja": "IsHiragana}\\p{IsKatakana", "ko": "IsHangul", "th": "IsThai", "el": "IsGreek", "he": "IsHebrew", "hi": "IsDevanagari"}


def _scripts(df: DataFrame, c: str, out: str) -> DataFrame:
    """Adds out: zh, a language of LANGUAGES or SCRIPTS, latin where no common word tells, or null without letters. A few
    words of the other script (a name, a code) do not count: a Chinese character weighs as two thirds of a word."""
    plain = F.regexp_replace(c, r"\p{IsHan}+", " ")
    df = df.withColumn("_words", F.filter(F.split(plain, r"[^\p{L}]+"), lambda w: F.length(w) > 1))
    df = df.withColumn("_han", F.length(F.regexp_replace(c, r"[^\p{IsHan}]+", "")))
    named = list(LANGUAGES)
    df = df.withColumn("_hits", F.when((F.size("_words") > 0) & (F.col("_han") < F.size("_words") * 1.5), F.array(*[F.size(F.array_intersect("_words", F.array(*map(F.lit, LANGUAGES[k].split())))) for k in named])))
    best = F.array_max("_hits")
    latin = F.when(best > 0, F.element_at(F.array(*map(F.lit, named)), F.array_position("_hits", best).cast("int"))).otherwise("latin")
    # another script counts where it has most of the letters (a quarter of them for Japanese): looked at only where any stands
    anything = F.rlike(c, F.lit("[" + "".join(rf"\p{{{x}}}" for x in SCRIPTS.values()) + "]"))
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]+", ""))
    parts = {name: F.length(F.regexp_replace(c, rf"[^\p{{{x}}}]+", "")) for name, x in SCRIPTS.items()}
    by_script = F.when(anything, F.coalesce(*[F.when((4 if name == "ja" else 2) * n > letters, name) for name, n in parts.items()]))
    return df.withColumn(out, F.coalesce(by_script, F.when(F.col("_hits").isNotNull(), latin).when(F.col("_han") > 0, "zh"))).drop("_words", "_han", "_hits")


def replies(rollouts: DataFrame) -> DataFrame:
    """(rollout_id, case_id, kind, broken, reply) of rollouts with a case; kind is trailing, empty or null.

    reply, in lower case, is the message of the last SUBMIT or REFUSE call, or the whole output without calls; null
    where a call is not closed (broken) or where there are calls but none of these. A null output is empty."""
    low = F.lower(F.coalesce("output", F.lit("")))
    rows = rollouts.select("rollout_id", text.canonical_id("case_id").alias("case_id"), low.alias("low")).where(F.col("case_id").isNotNull())
    opened, closed = F.regexp_count("low", F.lit("<tool_call>")), F.regexp_count("low", F.lit("</tool_call>"))
    finals = F.filter(text.tool_blocks(F.col("low")), lambda b: b.rlike(_FINAL))
    last = F.try_element_at(finals, F.lit(-1))
    message = F.coalesce(
        F.get_json_object(last, "$.arguments.message"),
        F.get_json_object(last, "$.function.arguments.message"),
        F.get_json_object(F.get_json_object(last, "$.arguments"), "$.message"),
        F.nullif(F.regexp_extract(last, r'"message"\s*:\s*"((?:[^"\\]|\\.)*)', 1), F.lit("")),
        F.lit(""),
    )
    rows = rows.withColumns({"opened": opened, "broken": (opened > closed) | F.col("low").rlike(r"<[/a-z_]{0,10}$"), "last": last})
    rows = rows.withColumn("reply", F.when(F.col("opened") == 0, F.col("low")).when(F.col("last").isNotNull(), message))
    word = r"[\p{L}\p{N}]"
    kind = (
        F.when((F.col("opened") > 1) & F.col("last").isNotNull() & F.col("low").rlike(_FINAL + r".*?</tool_call>.*<tool_call"), "trailing")
        .when(~F.col("low").rlike(word), "empty")
        .when(~F.col("broken") & F.col("reply").isNotNull() & ~F.col("reply").rlike(word), "empty")
    )
    return rows.select("rollout_id", "case_id", kind.alias("kind"), "broken", F.when(~F.col("broken"), F.col("reply")).alias("reply"))


def prompts_of(cases: DataFrame) -> DataFrame:
    """(case_id, matter_id, q, theirs): one row per case; q is the request's letters and digits, theirs its language."""
    rows = cases.select(text.canonical_id("case_id").alias("case_id"), "matter_id", "user_request").where(F.col("case_id").isNotNull())
    rows = rows.groupBy("case_id").agg(F.min("matter_id").alias("matter_id"), F.lower(F.min("user_request")).alias("request"))
    return _scripts(rows.withColumn("q", text.alnum("request")), "request", "theirs").drop("request")


def checked(rows: DataFrame) -> DataFrame:
    """Adds to (..., kind, broken, reply, matter_id, q, theirs) what one pair tells: (rollout_id, matter_id, kind, later, opening,
    about).

    kind also gets copied; later is language or truncated, which come after refusal; opening is null for defects already named.
    about: whether the reply shares a run of letters with its request, so that it is about the case; null where they are
    not in the same language."""
    rows = rows.withColumn("own", text.alnum(F.regexp_replace("reply", _LEAD, "")))
    size = F.length("own")
    long = (size >= GRAM + 2) & (size >= WHOLE * F.length("q"))
    # pieces are cut at each of GRAM offsets, which takes time in proportion to the reply; those at every second letter are
    # looked up first, and where so many are missing that the rest cannot make a copy, the rest is not
    cut = lambda at: F.regexp_extract_all(F.substring("own", F.lit(at + 1), F.length("own")), F.lit(f"(?s)(.{{{GRAM}}})"), 1)
    count = lambda offsets, known: reduce(lambda x, y: x + y, [F.size(F.filter(cut(at), lambda g: F.contains(F.col("q"), g) == F.lit(known))) for at in offsets])
    missing = count(range(0, GRAM, 2), False)
    rows = rows.withColumn("look", F.coalesce(F.when(long, (size - GRAM + 1) - missing >= TAKEN * (size - GRAM + 1)), F.lit(False)))
    taken = count(range(GRAM), True)
    rows = rows.withColumn("kind", F.coalesce("kind", F.when(F.when(F.col("look"), taken >= TAKEN * (size - GRAM + 1)), "copied")))
    rows = rows.withColumn("bare", F.when(F.col("kind").isNull(), F.regexp_replace("reply", _TAG, "")))
    rows = _scripts(rows, "bare", "ours")
    plain = [*SCRIPTS, "zh"]
    other = (F.col("ours") != F.col("theirs")) & (F.col("ours").isin(plain) | F.col("theirs").isin(plain) | ((F.col("ours") != "latin") & (F.col("theirs") != "latin")))
    han = F.col("theirs") == "zh"
    run, step = F.when(han, OWN_HAN).otherwise(OWN_OTHER), F.when(han, OWN_HAN // 2).otherwise(OWN_OTHER // 3)
    shares = F.exists(F.sequence(F.lit(1), F.greatest(F.length("q") - run + 1, F.lit(1)), step), lambda i: F.contains(F.col("own"), F.substring(F.col("q"), i, run)))
    comparable = F.col("kind").isNull() & (F.length("q") >= run) & (F.col("ours") == F.col("theirs"))
    # complete: a closing mark, or a number or code as last word
    whole = r"([.!?。！？…．｡\"'”’»」』)）\]】}~～]|[a-z0-9/._–—-]*[0-9][a-z0-9]*)[\s\p{Z}\p{Cf}]*$"
    later = F.when(F.col("broken"), "truncated").when(other, "language").when(~F.right("bare", F.lit(40)).rlike(whole), "truncated")
    tokens = F.regexp_extract_all(F.left(F.regexp_replace("bare", r"(?<![\p{L}&&[^\p{IsHan}]])[a-z]{0,3}[-./ ]{0,2}\p{N}+", " "), F.lit(40 * OPENING)), F.lit(r"(\p{IsHan}|[\p{L}\p{M}\p{N}&&[^\p{IsHan}]]+)"), 1)
    opening = F.nullif(F.concat_ws(" ", F.slice(tokens, 1, OPENING)), F.lit(""))
    return rows.select("rollout_id", "matter_id", "kind", F.when(F.col("kind").isNull(), later).alias("later"), opening.alias("opening"), F.when(comparable, shares).alias("about"))


def _signed(openings: DataFrame) -> DataFrame:
    tokens = F.split("opening", " ")
    shingles = F.when(
        F.size(tokens) > SHINGLE, F.transform(F.sequence(F.lit(1), F.size(tokens) - SHINGLE + 1), lambda i: F.xxhash64(F.array_join(F.slice(tokens, i, SHINGLE), " ")))
    ).otherwise(F.array(F.xxhash64("opening")))
    rows = openings.withColumns({"oid": F.xxhash64("opening"), "shingles": F.array_distinct(shingles)})
    hashed = lambda p: F.array_min(F.transform("shingles", lambda s: F.xxhash64(s, F.lit(p))))  # noqa: E731 (a second argument of the inner one would be the index)
    mins = [hashed(p) for p in range(BANDS * ROWS)]
    bands = F.array(*[F.xxhash64(F.lit(b), *mins[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)])
    return rows.withColumn("bands", bands)


def _alike(a: set, b: set) -> bool:
    common = len(a & b)
    return common >= SIMILAR * (len(a) + len(b) - common)


def _within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links inside buckets, whose members arrive one after another: all pairs of a bucket are compared, those that links
    already join left out; of the links just enough are handed on to hold each cluster together."""
    bucket, members, root = None, [], {}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        links = []
        for at, oid, shingles in zip(batch["bucket"], batch["oid"], batch["shingles"]):
            if at != bucket:
                bucket, members, root = at, [], {}
            mine = set(shingles)
            root[oid] = oid
            for other, theirs in members:
                if top(other) != top(oid) and _alike(mine, theirs):
                    root[top(other)] = top(oid)
                    links.append((oid, other))
            members.append((oid, mine))
        yield pd.DataFrame(links, columns=["oid", "head"], dtype="int64")


def _by_subsets(sets: DataFrame) -> DataFrame:
    """(oid, head): links that join all alike sets of (oid, shingles, least), whatever their number; sets have at most WIDE
    shingles, and of two that must be joined neither has fewer than `least` of either.

    Each set hands out its subsets c that can be all it shares with an alike set. Of the sets that hold the same c the smallest
    is the head, and a set x is linked to it where c alone makes them alike: |c| >= SIMILAR (|head| + |x| - |c|). If c is all
    that two alike sets share, this holds for both of them, as the head is no larger than either. So no pairs are compared."""
    n, c = F.size("hashes"), F.size("hashes") - F.col("left_out")
    xor = lambda x, y: [x[k].bitwiseXOR(y[k]).alias(k) for k in ("a", "b")]  # noqa: E731 (two hashes, so that no two subsets are taken for one)
    none = F.struct(F.lit(0).alias("last"), F.lit(0).alias("left_out"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    rows = sets.select("oid", "least", F.transform("shingles", lambda s: F.struct(F.xxhash64(s, F.lit(1)).alias("a"), F.xxhash64(s, F.lit(2)).alias("b"))).alias("hashes"))
    rows = rows.withColumns({"whole": F.aggregate("hashes", none, lambda x, y: F.struct(x["last"].alias("last"), x["left_out"].alias("left_out"), *xor(x, y))), "subsets0": F.array(none)})
    deepest = max(k for k in range(WIDE) if WIDE - k >= SIMILAR * WIDE)
    for k in range(deepest):
        further = lambda e: F.transform(F.slice("hashes", e["last"] + 1, n), lambda h, i: F.struct((e["last"] + i + 1).alias("last"), (e["left_out"] + 1).alias("left_out"), *xor(e, h)))
        rows = rows.withColumn(f"subsets{k + 1}", F.flatten(F.transform(f"subsets{k}", further)))
    rows = rows.select("oid", "least", "hashes", "whole", F.explode(F.concat(*[f"subsets{k}" for k in range(deepest + 1)])).alias("e")).select("oid", "least", "hashes", "whole", "e.left_out", F.struct(*xor(F.col("e"), F.col("whole"))).alias("c"))
    rows = rows.where((c > 0) & (c >= SIMILAR * (n + F.greatest("least", c) - c))).select("oid", n.alias("n"), c.alias("shared"), "c.a", "c.b")
    heads = rows.groupBy("a", "b").agg(F.min(F.struct("n", "oid")).alias("first"), F.count(F.lit(1)).alias("holders")).where(F.col("holders") > 1).select("a", "b", F.col("first.n").alias("head_n"), F.col("first.oid").alias("head"))
    return rows.join(heads, ["a", "b"]).where((F.col("oid") != F.col("head")) & (F.col("shared") >= SIMILAR * (F.col("n") + F.col("head_n") - F.col("shared")))).select("oid", "head")


def clusters(openings: DataFrame) -> DataFrame:
    """(oid, opening, cluster): openings joined by verified links (Jaccard of 5-token shingles >= SIMILAR).

    Bands of MinHash name the buckets in which openings are compared: any two alike openings of one bucket are in one
    cluster, however large the bucket. Up to BUCKET members all pairs are compared. Members of larger buckets are joined by
    their common subsets, in time in proportion to their number; those of more than WIDE shingles, which `checked` does not
    make, have too many subsets: pairs of parts of such a bucket are compared, in time that grows with its square."""
    signed = runtime.written(_signed(openings.select("opening").where(F.col("opening").isNotNull()).distinct()), "openings")
    n = F.size("shingles")
    left = signed.select("oid", "shingles", n.alias("n"), F.explode("bands").alias("bucket"))
    sizes = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least"), F.max("n").alias("most")).where(F.col("members") > 1)
    both = runtime.written(left.join(sizes, "bucket"), "buckets")
    compared = both.where(F.col("members") <= BUCKET).select("bucket", "oid", "shingles")
    edges: list[DataFrame] = []
    large = both.where(F.col("members") > BUCKET)
    if not large.isEmpty():
        short = large.where(F.col("n") <= WIDE).groupBy("oid").agg(F.min("least").alias("least"))
        edges.append(_by_subsets(signed.join(short, "oid").select("oid", "shingles", "least")))
        # parts of half a bucket each, by hash; each pair of parts is a bucket again
        parts = F.ceil(2 * F.col("members") / BUCKET)
        wide = large.where((F.col("most") > WIDE) & (F.col("n") >= SIMILAR * (WIDE + 1))).select("oid", "shingles", "bucket", parts.alias("parts"), F.pmod(F.xxhash64("bucket", "oid"), parts).alias("part"))
        wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where(F.col("part") != F.col("other"))
        compared = compared.unionByName(wide.select(F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("bucket"), "oid", "shingles"))
    edges.append(compared.repartition("bucket").sortWithinPartitions("bucket", "oid").mapInPandas(_within, "oid long, head long"))
    found = reduce(DataFrame.unionByName, edges).distinct()
    both_ways = runtime.written(found.unionByName(found.select(F.col("head").alias("oid"), F.col("oid").alias("head"))), "links")
    labels = signed.select("oid", F.col("oid").alias("cluster"))
    while True:
        # the smallest label among the neighbours, then that label's own label: chains are halved in each round
        near = both_ways.join(labels.withColumnRenamed("oid", "head"), "head").groupBy("oid").agg(F.min("cluster").alias("near"))
        new = runtime.written(labels.join(near, "oid", "left").select("oid", F.least("cluster", F.coalesce("near", "cluster")).alias("cluster"), (F.col("near") < F.col("cluster")).alias("moved")), "labels")
        jump = new.select(F.col("oid").alias("cluster"), F.col("cluster").alias("further"))
        labels = runtime.written(new.join(jump, "cluster").select("oid", F.least("cluster", "further").alias("cluster")), "labels")
        if new.where("moved").isEmpty():
            break
    return signed.select("oid", "opening").join(labels, "oid")


def refusal_openings(rows: DataFrame) -> DataFrame:
    """(opening) of the clusters that decline to work. rows: (opening, matter_id, about).

    A cluster must recur for prompts of MATTERS matters, and hardly any of its replies may be about its case (where replies
    and prompts have one language, so that this can be told). That is what sets a refusal apart from the usual answers, which
    recur as well but name the case; then the weak signs count: words that say no or that one is not able to work, and
    words of oneself speak for it, words of a result against it. So no wording has to be known beforehand."""
    # the sketch of matters is built before the shuffle, so that a frequent opening is one row per task
    per_opening = rows.where(F.col("opening").isNotNull()).groupBy("opening").agg(
        F.approx_count_distinct("matter_id").alias("matters"), F.min("matter_id").alias("lo"), F.max("matter_id").alias("hi"), F.count(F.lit(1)).alias("rows"),
        F.count("about").alias("told"), F.count_if("about").alias("about"),
    )
    per_opening = runtime.written(per_opening, "per-opening")
    grouped = clusters(per_opening).join(per_opening, "opening")
    joined = F.regexp_replace("opening", r"(?<=\p{IsHan}) (?=\p{IsHan})", "")
    says = lambda pattern: F.sum(F.when(joined.rlike(pattern), F.col("rows")).otherwise(0))
    found = grouped.groupBy("cluster").agg(
        F.greatest(F.max("matters"), (F.min("lo") != F.max("hi")).cast("int") + 1).alias("matters"),
        F.sum("rows").alias("rows"), F.sum("told").alias("told"), F.sum("about").alias("about"),
        says(_NO).alias("no"), says(_SELF).alias("oneself"), says(_DONE).alias("done"), says(_UNABLE).alias("cannot"), says(f"({_UNABLE}).{{0,30}}({_WORK})|({_WORK}).{{0,12}}({_UNABLE})").alias("unable"),
    )
    most = lambda c: (2 * F.col(c) > F.col("rows")).cast("int")
    # without prompts to compare with, inability to work must be there
    signs = most("no") + most("oneself") + most("cannot") + most("unable") - 3 * most("done")
    refuses = F.when(F.col("told") > 0, (F.col("about") <= ABOUT * F.col("told")) & (signs >= 2)).otherwise((most("unable") > 0) & (signs >= 3))
    return grouped.join(found.where((F.col("matters") >= MATTERS) & refuses).select("cluster"), "cluster", "left_semi").select("opening")


def defects(rollouts: DataFrame, cases: DataFrame) -> DataFrame:
    """(rollout_id, defect), one row per defective rollout.

    rollouts: rollout_id, case_id, output; cases: case_id, matter_id, user_request. Rollouts without case_id are left
    out, those of an unknown case have no request to be compared with. Repeated rows count once; an empty input gives
    an empty result; other columns are not read."""
    prompts = runtime.written(prompts_of(cases), "prompts")
    # written here and below: Spark would otherwise inline the parsing into each of the many expressions that use it
    rows = runtime.written(replies(rollouts), "replies")
    size = prompts.agg(F.sum(F.octet_length("q") + F.octet_length("case_id") + 40).alias("bytes")).first().bytes or 0
    if size <= PROMPT_BYTES:
        rows = rows.join(F.broadcast(prompts), "case_id", "left")
    else:
        rows = runtime.join_salted(rows, prompts, ["case_id"], "left", F.xxhash64("rollout_id"), 16)
    rows = runtime.written(checked(rows), "pairs")
    refusing = runtime.cut(refusal_openings(rows).withColumn("refuses", F.lit(True)))
    open_rows = rows.where(F.col("kind").isNull() & F.col("opening").isNotNull())
    count = refusing.count()
    if count <= runtime.BROADCAST_ROWS:
        open_rows = open_rows.join(F.broadcast(refusing), "opening", "left")
    else:
        open_rows = runtime.join_salted(open_rows, refusing, ["opening"], "left", F.xxhash64("rollout_id"), 16)
    told = open_rows.select("rollout_id", F.when(F.col("refuses"), "refusal").otherwise(F.col("later")).alias("defect"))
    rest = rows.where(F.col("kind").isNotNull() | F.col("opening").isNull()).select("rollout_id", F.coalesce("kind", "later").alias("defect"))
    return told.unionByName(rest).where(F.col("defect").isNotNull()).distinct()
