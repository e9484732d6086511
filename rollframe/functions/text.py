"""Column functions on text: whitespace, canonical ids, tool-call blocks. All JVM-side."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space plus the separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]+"
CALL = r"(?is)<tool_call>\s*(.*?)\s*</tool_call>"


def squeeze_space(c) -> Column:
    """Runs of Unicode white space become one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def is_blank(c) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(squeeze_space(c) == "", F.lit(True))


def canonical_id(c) -> Column:
    """Ids spelled with other separators, letter case, blanks or a closing mark become lower_snake; null if nothing is left."""
    x = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_")
    return F.nullif(F.regexp_replace(x, r"^_+|_+$", ""), F.lit(""))


def label(c) -> Column:
    """A category label, trimmed and lower-case; null if nothing is left."""
    return F.nullif(F.lower(squeeze_space(c)), F.lit(""))


def folded(c) -> Column:
    """Lower case for comparisons: by way of upper case, and with ss for ß, so that texts written in capitals agree."""
    return F.replace(F.lower(F.upper(c)), F.lit("ß"), F.lit("ss"))


def alnum(c) -> Column:
    """Letters and digits only, case folded."""
    return F.regexp_replace(folded(c), r"[^\p{L}\p{N}]+", "")


def tool_blocks(c) -> Column:
    """Array with the inner text of each closed <tool_call> block."""
    return F.regexp_extract_all(c, F.lit(CALL), 1)


def objects_in(text: str) -> Iterator[dict]:
    """The JSON objects that stand anywhere in a text, inner ones as well, in the order in which they begin.

    Braces are paired by a stack; a pair whose inside is no JSON object is passed over."""
    opened: list[int] = []
    pairs: list[tuple[int, int]] = []
    for at, ch in enumerate(text):
        if ch == "{":
            if text[at + 1 : at + 40].lstrip()[:1] in ('"', "}", ""):  # else no object begins here
                opened.append(at)
        elif ch == "}":
            # braces inside strings may not pair up: every opening one that is left is tried
            for first in reversed(opened):
                try:
                    found = json.loads(text[first : at + 1])
                except ValueError:
                    continue
                if isinstance(found, dict):
                    pairs.append((first, at + 1))
                    opened.remove(first)
                    break
    for first, last in sorted(pairs):
        yield json.loads(text[first:last])


def bare_calls(text: str, tool: str) -> list[dict]:
    """The objects in a text that name a tool, as calls."""
    out = []
    for found in objects_in(text):
        inner = found if "name" in found else found.get("function")
        if not isinstance(inner, dict):
            continue
        name, args = inner.get("name"), inner.get("arguments")
        if isinstance(args, str):
            try:
                args = json.loads(args)
            except ValueError:
                args = None
        ok = isinstance(args, dict) and "action" in args
        action = args["action"] if ok else None
        out.append({"name": name if name is None else str(name), "action": action.strip().upper() if isinstance(action, str) else None, "malformed": not ok, "wrong_name": name != tool})
    return out


def brace_slice(c) -> Column:
    """From the first opening to the last closing brace, code fences and all else around it left out; null without braces."""
    first, size = F.instr(c, "{"), F.length(c)
    last = size - F.instr(F.reverse(c), "}") + 1
    return F.when((first > 0) & (F.instr(c, "}") > 0) & (last > first), F.substring(c, first, last - first + 1))


def unfenced(c) -> Column:
    """A text without the code fence around it."""
    return F.regexp_replace(F.trim(c), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")


def nested_case(value: object, needed: tuple[str, ...] = ("case_id", "hidden_truth", "rules")) -> dict | None:
    """The first object with all needed keys in a nested value, outer ones and earlier keys first; texts that hold JSON are
    opened on the way. Broken JSON is passed over."""
    waiting = [value]
    while waiting:
        at = waiting.pop()
        if isinstance(at, str) and at.lstrip()[:1] in ("{", '"'):
            try:
                waiting.append(json.loads(at))
            except ValueError:
                pass
        elif isinstance(at, dict):
            if all(k in at for k in needed):
                return at
            waiting += reversed(at.values())
    return None


def find_case(c, needed: tuple[str, ...] = ("case_id", "hidden_truth", "rules")) -> Column:
    """nested_case of a JSON text as a JSON text; null where there is none. For payloads of unknown depth; a known path is
    better read with variant_get."""

    @F.pandas_udf("string")
    def look(texts: pd.Series) -> pd.Series:
        found = [None if t is None else nested_case(t, needed) for t in texts]
        return pd.Series([None if f is None else json.dumps(f, ensure_ascii=False, sort_keys=True) for f in found])

    return look(c)
