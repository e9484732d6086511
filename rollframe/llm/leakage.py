"""Evaluation texts inside training text: Wu-Manber multi-pattern search with exact verification."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run counts from so many words on, or characters where words are not spaced.
RUN_WORDS, RUN_CHARS = 8, 15
#: Share of the item's words (characters) that must stand in runs.
SHARE = 0.5
#: Characters of a block of the shift table, and bits of its hash.
BLOCK, BITS = 3, 18
#: Texts are searched in segments of this many characters, which overlap by a pattern's length.
SEGMENT = 4096
#: Characters of items that one pass searches for; more items are searched in several passes over the documents.
PASS_CHARS = 4_000_000


_CJK = "\u3040-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_OTHER = re.compile(r"[\W_]+")
_UNIT = re.compile(rf"[{_CJK}]|[^\W_{_CJK}]+")


def letters(text: str) -> str:
    """Letters and digits only, case folded."""
    return _OTHER.sub("", unicodedata.normalize("NFC", text).casefold())


def folded(text: str) -> tuple[str, np.ndarray]:
    """The letters, and for each of them the number of the word it belongs to.

    Chinese characters (and other scripts without spaces) are words of their own."""
    units = _UNIT.findall(unicodedata.normalize("NFC", text).casefold())
    return "".join(units), np.repeat(np.arange(len(units)), [len(u) for u in units]) if units else np.empty(0, dtype=np.int64)


def unspaced(text: str) -> bool:
    """True where most letters are of a script without spaces: runs are then counted in characters, digits included."""
    own = sum("぀" <= ch <= "鿿" or ch >= "\U00020000" for ch in text)
    return 2 * own > sum(ch.isalpha() for ch in text)


class Item:
    __slots__ = ("code", "first", "id", "least", "size", "unit")

    def __init__(self, item_id: int, text: str):
        s, words = folded(text)
        self.id = item_id
        self.code = np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        chars = unspaced(s)
        self.unit = np.arange(len(s)) if chars else words  # what is counted: character or word
        self.least = RUN_CHARS if chars else RUN_WORDS
        self.size = int(self.unit[-1]) + 1 if len(s) else 0
        self.first = np.flatnonzero(np.diff(self.unit, prepend=-1)) if len(s) else np.empty(0, dtype=np.int64)


def _hash(a: np.ndarray) -> np.ndarray:
    """Hash of the block that ends at each position from BLOCK - 1 on."""
    h = np.zeros(len(a) - BLOCK + 1, dtype=np.uint64)
    for i in range(BLOCK):
        h = h * np.uint64(0x9E3779B97F4A7C15) + a[i : len(a) - BLOCK + 1 + i].astype(np.uint64)
        h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)


def _whole(a: np.ndarray, begin: np.ndarray, window: int) -> np.ndarray:
    """Hash of the whole window that begins at each of the positions."""
    h = np.zeros(len(begin), dtype=np.uint64)
    for i in range(window):
        h = (h ^ a[begin + i].astype(np.uint64)) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(31)
    return h


class Table:
    """Shift table and suffix-hash buckets of pieces of at least `window` characters, searched by their first `window`."""

    def __init__(self, whole: np.ndarray, begin: np.ndarray, window: int, pieces: list[tuple[int, int]]):
        self.window = window
        hashes = _hash(whole)  # of the block that begins there
        self.shift = np.full(1 << BITS, max(1, window - BLOCK + 1), dtype=np.int16)
        for at in range(window - BLOCK + 1):
            np.minimum.at(self.shift, hashes[begin + at], window - BLOCK - at)
        self.bucket: dict[int, list[tuple[int, int]]] = {}  # by the hash of the whole window
        for key, piece in zip(_whole(whole, begin, window).tolist(), pieces):
            self.bucket.setdefault(key, []).append(piece)
        self.keys = np.asarray(sorted(self.bucket), dtype=np.uint64)

    def hits(self, whole: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a piece's window begins, and its hash. Every segment is a cursor: all cursors look at their block at once
        and move on by its shift."""
        at, end = [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            for s in range(a, max(a + 1, b - self.window + 1), SEGMENT):
                if b - s >= self.window:
                    at.append(s + self.window - BLOCK)
                    end.append(min(b, s + SEGMENT + self.window - 1) - BLOCK)
        pos, last = np.asarray(at, dtype=np.int64), np.asarray(end, dtype=np.int64)
        found: list[np.ndarray] = []
        while len(pos):
            move = self.shift[hashes[pos]].astype(np.int64)
            found.append(pos[move == 0])
            pos = pos + np.maximum(move, 1)
            alive = pos <= last
            pos, last = pos[alive], last[alive]
        begin = np.unique(np.concatenate(found)) + BLOCK - self.window if found else np.empty(0, dtype=np.int64)
        keys = _whole(whole, begin, self.window)
        known = np.isin(keys, self.keys)
        return begin[known], keys[known]


class Matcher:
    """Tables over the pieces of all items.

    Any run of `least` units holds a whole aligned piece of (least + 1) // 2 units, so that searching for the aligned
    pieces finds every run; each hit is then compared with the item directly and extended to the whole run. Pieces are
    put in tables by their length, to the next power of two: a table's window is the length of its shortest piece, and an
    item of short words does not slow the search for the others."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [i for i in (Item(*x) for x in items) if i.size >= i.least]
        by_size: dict[int, list[tuple[int, int, int]]] = {}  # item, start in characters, length
        for n, item in enumerate(self.items):
            step = (item.least + 1) // 2
            for u in range(0, item.size - step + 1, step):
                start = int(item.first[u])
                end = int(item.first[u + step]) if u + step < item.size else len(item.code)
                by_size.setdefault((end - start).bit_length(), []).append((n, start, end - start))
        whole = np.concatenate([i.code for i in self.items]) if self.items else np.empty(0, dtype=np.int64)
        offset = np.cumsum([0, *[len(i.code) for i in self.items]])
        self.tables = [Table(whole, np.asarray([offset[n] + start for n, start, _ in pieces]), min(size for *_, size in pieces), [p[:2] for p in pieces]) for _, pieces in sorted(by_size.items())]

    def search(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(text number, item id, share of the item in runs) of every text with at least SHARE of an item."""
        codes = [np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32).astype(np.int64) for t in texts]
        whole = np.concatenate(codes) if codes else np.empty(0, dtype=np.int64)
        if len(whole) < BLOCK or not self.tables:
            return []
        starts = np.cumsum([0, *map(len, codes)])
        hashes = _hash(whole)
        hits: list[tuple[int, int, int, int]] = []  # where, item, start in the item, window
        for table in self.tables:
            hits += [(b, n, start, table.window) for b, key in zip(*(x.tolist() for x in table.hits(whole, hashes, starts))) for n, start in table.bucket[key]]
        hits.sort()
        found = np.asarray([h[0] for h in hits], dtype=np.int64)
        doc_of = np.searchsorted(starts, found, side="right") - 1
        # A run with k whole pieces has at most k (3 step - 2) units, so that fewer hits than this cannot reach the share.
        pieces: dict[tuple[int, int], set[int]] = {}
        for doc, (_, n, start, _) in zip(doc_of.tolist(), hits):
            pieces.setdefault((doc, n), set()).add(start)
        able = {(doc, n) for (doc, n), s in pieces.items() if len(s) * (3 * ((self.items[n].least + 1) // 2) - 2) >= SHARE * self.items[n].size}
        covered: dict[tuple[int, int], np.ndarray] = {}
        reach: dict[tuple[int, int, int], int] = {}
        for doc, (begin, n, start, window) in zip(doc_of.tolist(), hits):
            lane = (doc, n, begin - start)
            if (doc, n) not in able or reach.get(lane, -1) >= begin:
                continue  # too few hits, or inside a run that was already compared
            item = self.items[n]
            run = _run(item.code, start, codes[doc], begin - int(starts[doc]), window)
            if run is None:
                continue
            lo, hi = run
            reach[lane] = begin - start + hi
            a = int(np.searchsorted(item.first, lo))  # whole units only
            b = int(item.unit[hi]) if hi < len(item.code) else item.size
            if b - a >= item.least:
                covered.setdefault((doc, n), np.zeros(item.size, dtype=bool))[a:b] = True
        out = []
        for (doc, n), units in covered.items():
            share = units.sum() / self.items[n].size
            if share >= SHARE:
                out.append((doc, self.items[n].id, float(share)))
        return out


def _run(item: np.ndarray, i: int, doc: np.ndarray, j: int, window: int) -> tuple[int, int] | None:
    """The longest common run around item[i:i+window] = doc[j:j+window], as positions in the item; None if they differ."""
    if not np.array_equal(item[i : i + window], doc[j : j + window]):
        return None
    right = min(len(item) - i, len(doc) - j)
    unlike = np.flatnonzero(item[i : i + right] != doc[j : j + right])
    hi = i + (int(unlike[0]) if len(unlike) else right)
    left = min(i, j)
    unlike = np.flatnonzero(item[i - left : i] != doc[j - left : j])
    lo = i - left + (int(unlike[-1]) + 1 if len(unlike) else 0)
    return lo, hi


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share) of each document that holds at least SHARE of an item in long runs.

    documents: doc_id, text; items: item_id, text. Null ids and texts are left out, empty texts match nothing, items
    shorter than a run are never found, repeated rows count once. White space, letter case and punctuation do not
    matter. Whole texts are searched, however long. The items are a fixed test set: they are sent to the tasks in
    blocks of at most PASS_CHARS characters, with one pass over the documents for each block, so that what is sent
    stays bounded. Documents are read and searched where they lie; nothing is shuffled but the pairs found."""
    spark = documents.sparkSession
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    sized = wanted.withColumn("size", F.length("text"))
    total = sized.agg(F.sum("size").alias("chars")).first().chars or 0
    passes = max(1, -(-total // PASS_CHARS))
    found = None
    for k in range(passes):
        part = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k) if passes > 1 else wanted
        block = spark.sparkContext.broadcast(Matcher([(r.item_id, r.text) for r in part.collect()]))  # about PASS_CHARS characters, as arrays

        def search(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            matcher = block.value
            for batch in batches:
                texts = [letters(t) for t in batch["text"]]
                ids = batch["doc_id"].to_numpy()
                yield pd.DataFrame([(ids[d], i, s) for d, i, s in matcher.search(texts)], columns=["doc_id", "item_id", "share"])

        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        pairs = rows.mapInPandas(search, "doc_id long, item_id long, share double")
        found = pairs if found is None else found.unionByName(pairs)
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
