"""Files whose schema drifts: path-value maps with raw types, statistics per file, changes, one typed table, failed casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollframe import runtime

FILE = ["run_id", "file_seq"]
#: A field belongs to a file if at least this share of the file's readable lines has it.
PRESENT = 0.5
#: A removed and an added field of one type are one renamed field from this likeness of their values on, if no other field
#: comes as near as MARGIN.
ALIKE, MARGIN = 0.5, 0.02
#: Distinct values in a profile's sample, and lines from which on a field with few kinds of values is known to be such.
SAMPLE, FEW_FROM = 64, 16
_CLASSES = (r"[0-9]+", r"[a-f]+", r"[g-z]+", r"[A-Z]+", r"\p{IsHan}+", r"\s+")


def _type(v: Column) -> Column:
    raw = F.schema_of_variant(v)
    return (
        F.when(raw == "VOID", "null").when(raw == "STRING", "string").when(raw == "BOOLEAN", "boolean").when(raw.startswith("ARRAY"), "array").when(raw.startswith("OBJECT"), "object").otherwise("number")
    )


def readable(raw: DataFrame) -> DataFrame:
    """(run_id, file_seq, line_no, v): the lines that hold one JSON object, each line number of a file once.

    Of several readable deliveries of a line the smallest payload counts. Objects that name a key twice are not readable."""
    parsed = raw.select(*FILE, "line_no", "payload", F.try_parse_json("payload").alias("v"))
    parsed = parsed.where(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))
    return parsed.groupBy(*FILE, "line_no").agg(F.min("payload").alias("payload")).select(*FILE, "line_no", F.parse_json("payload").alias("v"))


def path_values(lines: DataFrame, depth: int = 1) -> DataFrame:
    """(run_id, file_seq, line_no, path, type, value): one row per field; nested objects give dotted paths down to depth."""
    spark = lines.sparkSession

    def level(df: DataFrame, prefix: Column | None) -> DataFrame:
        out = df.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        path = F.col("key") if prefix is None else F.concat(F.col("path"), F.lit("."), F.col("key"))
        return out.select(*FILE, "line_no", path.alias("path"), _type(F.col("value")).alias("type"), F.col("value").alias("v"))

    at = level(lines, None)
    out = at
    for _ in range(depth - 1):
        at = level(at.where(F.col("type") == "object"), F.col("path"))
        out = out.unionByName(at)
    return out.select(*FILE, "line_no", "path", "type", F.when(F.col("type") == "string", F.try_variant_get("v", "$", "string")).otherwise(F.to_json("v")).alias("value"), F.schema_of_variant("v").alias("raw_type"))


def file_lines(raw: DataFrame, lines: DataFrame) -> DataFrame:
    """(run_id, file_seq, lines): readable lines of every file that has any row, also of those with none."""
    have = lines.groupBy(*FILE).agg(F.count(F.lit(1)).alias("lines"))
    return raw.where(F.col("run_id").isNotNull() & F.col("file_seq").isNotNull()).select(*FILE).distinct().join(have, FILE, "left").fillna(0, ["lines"])


def field_stats(values: DataFrame) -> DataFrame:
    """Per file and path: lines with it, and its most frequent type (ties: first in the alphabet; nulls have none).

    A line has a path once, so lines are counted by counting rows, in one pass."""
    per_type = values.groupBy(*FILE, "path", "type").agg(F.count(F.lit(1)).alias("n"))
    named = F.when(F.col("type") != "null", F.struct(-F.col("n"), F.col("type")))
    return per_type.groupBy(*FILE, "path").agg(F.sum("n").alias("with_field"), F.min_by("type", named).alias("type"))


def profiles(values: DataFrame) -> DataFrame:
    """Per file, path and type a profile of the values, of fixed size however many lines there are.

    sample: of the distinct values the SAMPLE with the smallest hashes, with their counts. The hash is the same in every
    file, so that two samples hold the same part of all possible values and their overlap estimates that of the whole
    (exactly, up to SAMPLE distinct values). kinds: number of distinct values. deciles: of numbers, and of texts that are
    all numbers. classes: mean shares of digits, a-f, other small letters, capitals, Chinese characters and white space
    in the values' text; length and its deviation; form: the JSON types inside arrays and objects."""
    key = [*FILE, "path", "type"]
    v = F.col("value")
    number = F.when(F.col("type").isin("number", "string"), v.try_cast("double"))
    size = F.length("value")
    share = lambda pattern: F.avg(F.coalesce(F.try_divide(size - F.length(F.regexp_replace("value", pattern, "")), size), F.lit(0.0)))
    nested = F.when(F.col("type").isin("array", "object"), F.col("raw_type")).otherwise("")
    own = values.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(number).alias("numbers"),
        F.percentile_approx(number, [i / 20 for i in range(21)], 10_000).alias("deciles"),
        F.array(*[share(c) for c in _CLASSES]).alias("classes"),
        F.avg(size).alias("length"),
        F.stddev_pop(size).alias("spread"),
        F.mode(nested, True).alias("form"),
    )
    counted = values.groupBy(*key, F.xxhash64("value").alias("h")).agg(F.count(F.lit(1)).alias("c"))
    first = Window.partitionBy(*key).orderBy("h")  # Spark keeps SAMPLE rows a group of each task before the shuffle
    picked = counted.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= SAMPLE)
    sample = picked.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("h", "c")))).alias("sample"))
    kinds = counted.groupBy(*key).agg(F.count(F.lit(1)).alias("kinds"))
    return own.join(sample, key).join(kinds, key)


def _likeness(a: str, b: str) -> Column:
    """From 0 to 1: how alike the values of two fields of one type are, from their profiles a_... and b_..."""
    of = lambda side, name: F.col(f"{side}_{name}")
    n, m = of(a, "n"), of(b, "n")
    # values: overlap of the two distributions below the smaller of the samples' largest hashes, where both are complete
    x, y = of(a, "sample"), of(b, "sample")
    top = lambda side, s: F.when(of(side, "kinds") <= SAMPLE, F.lit(2**63 - 1)).otherwise(F.array_max(F.map_keys(s)))
    common = F.least(top(a, x), top(b, y))
    x, y = (F.map_filter(s, lambda h, _: h <= common) for s in (x, y))
    both = F.map_zip_with(x, y, lambda _, p, q: F.least(F.coalesce(p / n, F.lit(0.0)), F.coalesce(q / m, F.lit(0.0))))
    seen = F.map_zip_with(x, y, lambda _, p, q: F.greatest(F.coalesce(p / n, F.lit(0.0)), F.coalesce(q / m, F.lit(0.0))))
    total = lambda mapped: F.aggregate(F.map_values(mapped), F.lit(0.0), lambda s, e: s + e)
    shared = F.size(F.array_intersect(F.map_keys(x), F.map_keys(y)))
    jaccard = F.coalesce(F.try_divide(shared, F.size(F.map_keys(both))), F.lit(0.0))
    values = (jaccard + F.coalesce(F.try_divide(total(both), total(seen)), F.lit(0.0))) / 2
    # few kinds of values: what tells is whether they are the same ones
    few = lambda side: (of(side, "n") >= FEW_FROM) & (4 * of(side, "kinds") <= of(side, "n"))
    # numbers: largest distance of the distribution functions, read at each other's 5 % points
    numeric = (of(a, "numbers") == n) & (of(b, "numbers") == m)
    below = lambda points, at: F.size(F.filter(points, lambda p: p <= at)) / 21
    gaps = lambda p, q: F.array_max(F.transform(p, lambda at: F.abs(below(p, at) - below(q, at))))
    apart = F.greatest(gaps(of(a, "deciles"), of(b, "deciles")), gaps(of(b, "deciles"), of(a, "deciles")))
    noise = F.least(F.lit(0.4), F.sqrt((n + m) / (n * m)))
    longest = F.greatest(of(a, "length"), of(b, "length"))
    sizes = F.least(F.lit(1.0), F.abs(of(a, "length") - of(b, "length")) / (of(a, "spread") + of(b, "spread") + longest / 10))
    spread = F.when(numeric, (1 - F.greatest(F.lit(0.0), apart - noise)) * (1 - sizes))  # as many digits, too
    # codes: the same characters in the same length
    mixed = F.aggregate(F.zip_with(of(a, "classes"), of(b, "classes"), lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, e: s + e)
    code = (of(a, "spread") + of(b, "spread")) <= longest / 10
    shape = F.when(code & (of(a, "form") == of(b, "form")), (1 - F.least(F.lit(1.0), 2 * mixed)) * (1 - sizes))
    loose = F.when(few(a) | few(b), F.lit(0.0)).otherwise(F.coalesce(F.when(F.col("type").isin("number", "string"), spread), shape, F.lit(0.0)))
    # of yes and no only the shares can be compared
    yes = lambda side: F.coalesce(F.try_element_at(of(side, "sample"), F.xxhash64(F.lit("true"))) / of(side, "n"), F.lit(0.0))
    off = F.abs(yes(a) - yes(b))
    boolean = 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), off - noise / 2) * 4)
    return F.when(F.col("type") == "boolean", boolean).otherwise(F.greatest(values, loose))


def _name_likeness(a: str, b: str) -> Column:
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    return 1 - F.levenshtein(plain(a), plain(b)) / F.greatest(F.length(plain(a)), F.length(plain(b)), F.lit(1))


def changes(stats: DataFrame, files: DataFrame, values: DataFrame) -> DataFrame:
    """(run_id, file_seq, change, field, new_field): each file against the one with the next lower number of its run.

    added, removed, renamed, type_changed. Renamed: a removed and an added field of one type whose values are alike, each
    the other's best match by at least MARGIN; likeness of the names counts a little, so that it parts fields whose values
    are alike. Where two fields match equally well, none is a rename. Long free texts that share no values are taken for
    one field only if their names are alike. A field with nulls only has no type and so no change of type. Values are
    profiled for the fields that come or go only."""
    order = Window.partitionBy("run_id").orderBy("file_seq")  # files of a run, not lines
    chain = files.withColumns({"next_seq": F.lead("file_seq").over(order), "last_seq": F.lag("file_seq").over(order)})
    own = stats.join(files, FILE).where(F.col("with_field") >= PRESENT * F.col("lines"))
    new = own.join(chain.where(F.col("last_seq").isNotNull()).select(*FILE, "last_seq"), FILE).select(*FILE, "path", F.col("type").alias("new_type"), F.lit(True).alias("is_new"))
    old = own.join(chain.where(F.col("next_seq").isNotNull()), FILE).select("run_id", F.col("next_seq").alias("file_seq"), "path", F.col("type").alias("old_type"), F.lit(True).alias("was"))
    both = runtime.cut(new.join(old, [*FILE, "path"], "full_outer").where(F.col("is_new").isNull() | F.col("was").isNull() | (F.col("new_type") != F.col("old_type"))))

    gone = both.where(F.col("is_new").isNull()).select(*FILE, F.col("path").alias("field"), F.col("old_type").alias("type"))
    come = both.where(F.col("was").isNull()).select(*FILE, F.col("path").alias("new_field"), F.col("new_type").alias("type"))
    # only where a field of the same type goes and comes can there be a rename
    able = runtime.cut(gone.join(come, [*FILE, "type"]).join(chain.select(*FILE, "last_seq"), FILE))
    sides = able.select("run_id", F.col("last_seq").alias("file_seq"), F.col("field").alias("path"), "type").unionByName(able.select(*FILE, F.col("new_field").alias("path"), "type")).distinct()
    held = runtime.join_sized(values, sides, [*FILE, "path", "type"], "left_semi", sides.count())
    held = runtime.cut(profiles(runtime.written(held, "held")))  # few fields, which are then read without being parsed again
    names = [c for c in held.columns if c not in (*FILE, "path", "type")]
    side = lambda tag, seq, field: held.select("run_id", F.col("file_seq").alias(seq), F.col("path").alias(field), "type", *[F.col(c).alias(f"{tag}_{c}") for c in names])
    pairs = able.join(side("old", "last_seq", "field"), ["run_id", "last_seq", "field", "type"]).join(side("new", "file_seq", "new_field"), ["run_id", "file_seq", "new_field", "type"])
    named = _name_likeness("field", "new_field")
    text = (F.col("type") == "string") & (F.col("old_length") > 12) & (F.col("new_length") > 12) & (F.col("old_spread") + F.col("new_spread") > F.greatest("old_length", "new_length") / 10)
    like = F.greatest(_likeness("old", "new"), F.when(text & (named >= 0.5), named).otherwise(0.0))
    pairs = runtime.cut(pairs.select(*FILE, "field", "new_field", like.alias("like"), named.alias("named")).where(F.col("like") >= ALIKE))
    pairs = pairs.withColumn("score", F.col("like") + F.col("named") / 4)
    for mine in ("field", "new_field"):
        w = Window.partitionBy(*FILE, mine).orderBy(F.col("score").desc())  # the fields of one file
        pairs = pairs.withColumns({f"_top_{mine}": F.first("score").over(w), f"_next_{mine}": F.nth_value("score", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    clear = lambda mine: (F.col("score") == F.col(f"_top_{mine}")) & (F.coalesce(F.col("score") - F.col(f"_next_{mine}"), F.lit(1.0)) >= MARGIN)
    renamed = runtime.cut(pairs.where(clear("field") & clear("new_field")).select(*FILE, "field", "new_field"))

    removed = gone.select(*FILE, "field").join(renamed, [*FILE, "field"], "left_anti")
    added = come.select(*FILE, "new_field").join(renamed, [*FILE, "new_field"], "left_anti")
    retyped = both.where(F.col("new_type") != F.col("old_type"))
    row = lambda df, change, field, to=None: df.select(*FILE, F.lit(change).alias("change"), F.col(field).alias("field"), (F.col(to) if to else F.lit("")).alias("new_field"))
    return row(renamed, "renamed", "field", "new_field").unionByName(row(removed, "removed", "field")).unionByName(row(added, "added", "new_field")).unionByName(row(retyped, "type_changed", "path"))


def drift(raw: DataFrame) -> DataFrame:
    """All changes of the files in raw (run_id, file_seq, line_no, payload). Rows without run or file number are left
    out, null and broken payloads are no lines; an empty table gives no change; other columns are not read."""
    raw = raw.where(F.col("run_id").isNotNull() & F.col("file_seq").isNotNull()).select(*FILE, "line_no", "payload")
    lines = runtime.written(readable(raw), "lines")
    values = path_values(lines)
    return changes(runtime.cut(field_stats(values)), runtime.cut(file_lines(raw, lines)), values)


def fields(raw: DataFrame) -> DataFrame:
    """(run_id, file_seq, field, type, with_field, lines): what the files hold; type is null for a field with nulls only."""
    raw = raw.where(F.col("run_id").isNotNull() & F.col("file_seq").isNotNull()).select(*FILE, "line_no", "payload")
    lines = runtime.written(readable(raw), "lines")
    stats = field_stats(path_values(lines)).join(file_lines(raw, lines), FILE)
    return stats.select(*FILE, F.col("path").alias("field"), "type", "with_field", "lines")


def _snake(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])", "_"))


def aliases(found: DataFrame, fields: list[str]) -> DataFrame:
    """(path, field): the known field that each name stands for, followed through renames in any run and through
    camelCase spelling. Of several fields that a name was linked with, the one with most renames. As many rows as there are
    names, not lines."""
    links = found.where(F.col("change") == "renamed").select(F.col("field").alias("a"), F.col("new_field").alias("b"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = runtime.cut(both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")))
    spark = found.sparkSession
    known = spark.createDataFrame([(f, f) for f in fields], "path string, field string")
    camel = found.select(F.col("field").alias("path")).unionByName(found.select(F.col("new_field").alias("path"))).distinct()
    known = known.unionByName(camel.withColumn("field", _snake(F.col("path"))).where(F.col("field").isin(fields) & (F.col("path") != F.col("field"))))
    while True:
        more = both.join(known, F.col("a") == F.col("path")).select(F.col("b").alias("path"), "field", "times").join(known.select("path"), "path", "left_anti")
        more = more.groupBy("path", "field").agg(F.sum("times").alias("times")).groupBy("path").agg(F.min_by("field", F.struct(-F.col("times"), F.col("field"))).alias("field"))
        more = runtime.cut(more)
        if more.isEmpty():
            return known
        known = runtime.cut(known.unionByName(more))


#: What typed_values may do besides plain casts: "1,2" of part and whole, "75%", yes and no, texts cut into array items, a text
#: inside an object.
LOOSE = ("part_of_whole", "percent", "yes_no", "joined_items", "longest_text")


def typed_values(values: DataFrame, names: DataFrame, types: dict[str, str], loose: tuple[str, ...] = LOOSE) -> DataFrame:
    """(run_id, file_seq, line_no, field, path, type, value, cast, how): the values of known fields, cast to the field's type.

    Text fields: strings, numbers and booleans as they are; number fields: numbers and texts of numbers, whole numbers keep
    all their digits in bigint fields; time fields: texts that can be cast. how is 'plain' for these. The readings named in
    loose are guesses: how names the one that was used, `loose_casts` lists them, and without its name in loose it is not
    tried. Anything else gives null, which `failed_casts` reports."""
    of = lambda *kinds: F.col("field").isin([f for f, kind in types.items() if kind in kinds])
    may = lambda name: F.lit(name in loose)
    rows = runtime.join_sized(values, names, ["path"], "inner", names.count()).where(F.col("type") != "null")
    v, t = F.col("value"), F.col("type")
    word = F.lower(F.trim(v))
    number, text_field, time_field = ~of("string", "timestamp", "timestamp_ntz"), of("string"), of("timestamp", "timestamp_ntz")
    exact = F.when(of("bigint") & t.isin("number", "string") & v.try_cast("bigint").isNotNull(), v)
    plain = F.coalesce(
        exact,
        F.when(text_field & ~t.isin("array", "object"), v),
        F.when(number & t.isin("number", "string"), v.try_cast("double").cast("string")),
        F.when(time_field & (t == "string") & v.try_cast("timestamp").isNotNull(), v),
    )
    pair = F.from_json(v, "array<double>")
    strings = F.map_values(F.from_json(F.when(t == "object", v), "map<string,string>"))
    guesses = {
        "yes_no": F.when(number & t.isin("string", "boolean"), F.when(word.isin("true", "yes"), "1.0").when(word.isin("false", "no"), "0.0")),
        "percent": F.when(number & (t == "string") & F.trim(v).endswith("%"), (F.regexp_replace(F.trim(v), "%$", "").try_cast("double") / 100).cast("string")),
        "part_of_whole": F.when(number & (t == "array") & (F.size(pair) == 2), F.try_divide(F.try_element_at(pair, F.lit(1)), F.try_element_at(pair, F.lit(2))).cast("string")),
        "joined_items": F.when(text_field & (t == "array"), F.array_join(F.from_json(v, "array<string>"), "")),
        "longest_text": F.when(text_field & (F.size(strings) > 0), F.element_at(F.array_sort(strings, lambda a, b: F.length(b) - F.length(a)), 1)),
    }
    cast, how = plain, F.when(plain.isNotNull(), "plain")
    for name, guess in guesses.items():
        cast, how = F.coalesce(cast, F.when(may(name), guess)), F.coalesce(how, F.when(may(name) & guess.isNotNull(), name))
    return rows.select(*FILE, "line_no", "field", "path", "type", "value", cast.alias("cast"), how.alias("how"))


def loose_casts(values: DataFrame) -> DataFrame:
    """Per file and name: the values that were read by a guess, with the guess, the JSON type and one example."""
    return values.where(F.col("how") != "plain").groupBy(*FILE, "field", "path", "type", "how").agg(F.count(F.lit(1)).alias("values"), F.min("value").alias("example"), F.min_by("cast", "value").alias("read_as"))


def unified(lines: DataFrame, values: DataFrame, types: dict[str, str]) -> DataFrame:
    """One row per readable line with all fields of types; missing and uncastable values are null."""
    keys = [*FILE, "line_no"]
    wide = values.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(*[F.min(F.when(F.col("field") == f, F.col("cast"))).alias(f) for f in types])
    cols = [F.coalesce(F.col(f).try_cast("bigint"), F.col(f).try_cast("double").try_cast("bigint")).alias(f) if t == "bigint" else F.col(f).try_cast(t).alias(f) for f, t in types.items()]
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return lines.select(*keys).join(wide, same[0] & same[1] & same[2], "left").select(*keys, *cols)


def failed_casts(values: DataFrame) -> DataFrame:
    """Per file and name: the values that could not be cast, with their JSON type and one example."""
    return values.where(F.col("cast").isNull()).groupBy(*FILE, "field", "path", "type").agg(F.count(F.lit(1)).alias("failed"), F.min("value").alias("example"))
