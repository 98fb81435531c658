"""Benchmark decontamination with Wu-Manber multi-pattern search.

Items give windows of ``WINDOW`` words (a shorter item is one window). Windows are
sought as bytes, a space on either side of every word, in the normalised texts of
many documents at once. Patterns are grouped by length; each group has a block
shift table over the first ``m`` bytes of its patterns, whose entry for the block
that ends the current position says how far no pattern can begin. Positions with
shift zero go to the bucket of their suffix and prefix hash, whose few patterns
are compared directly. The search advances thousands of lanes of the buffer in
step, so that each table access is one vector operation.

The benchmark is a stated query set; only it is sent to the executors. Up to
``MOST_BYTES`` it goes as one search, which each worker builds once for all its tasks;
windows are places in the benchmark's own text, so its tables take about 16 times its
bytes and at most 16 MB for each shift table. Documents are then read once and never
shuffled. A larger benchmark is dealt into parts of at most that size by the hash of its
items. Documents are searched for one part at a time, and of all parts but the first
only documents with hits are kept, and brought together.

Defined cases: very long texts are searched whole; other columns are ignored, whatever
their names, and an empty table gives an empty result; null or wordless texts have no words, no hits and no items, and are
not contaminated; a wordless item gives no window; items that repeat count once by
item_id, a null item_id under the empty string; an empty benchmark hits nothing; a
single item larger than a part is a part of its own.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import common

WINDOW = 13
SHARE = 20
MOST_BYTES = 8 << 20
LANE = 2048
END = 0xFF
#: A byte of a word stands for itself (A-Z lower-cased), any other becomes a space; 0xFF, never in UTF-8, ends a document.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    tokens = (text or "").encode().translate(_FOLD).split()
    if not tokens:
        return []
    return [b" " + b" ".join(tokens[i : i + size]) + b" " for i in range(max(1, len(tokens) - size + 1))]


def loads(buffer: bytes | np.ndarray, n: int) -> np.ndarray:
    """The eight bytes at each of the first n places as an integer; the buffer has seven more."""
    return np.ndarray((n,), "<u8", buffer, strides=(1,))


class Group:
    """Shift table and buckets of patterns of similar length. begin, end: their places in the benchmark's text."""

    def __init__(self, text: bytes, begin: np.ndarray, end: np.ndarray, ids: np.ndarray):
        self.begin, self.end, self.ids = begin, end, ids
        self.m = int((end - begin).min())
        self.block = 8 if self.m >= 16 else min(self.m, 4)
        self.mask = np.uint64((1 << (8 * self.block)) - 1)
        words = loads(text, len(text) - 8)
        last = self.m - self.block
        self.bits = min(24, max(16, int(len(begin) * (last + 1) * 8).bit_length()))
        # A shift that is too short only costs a step.
        self.shift = np.full(1 << self.bits, min(255, last + 1), np.uint8)
        for j in range(last + 1):
            self.shift[self.slot(words[begin + j] & self.mask)] = min(255, last - j)
        keys = self.key(words[begin] & self.mask, words[begin + last] & self.mask)
        self.order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[self.order], return_index=True)
        self.bounds = np.r_[first, len(keys)]

    def slot(self, block: np.ndarray) -> np.ndarray:
        return (block * _MIX) >> np.uint64(64 - self.bits)

    @staticmethod
    def key(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        return (prefix * _MIX) ^ (suffix * _MIX2)

    def search(self, own: bytes, text: bytes, words: np.ndarray, n: int) -> list[tuple[int, int]]:
        """(place, pattern id) of all occurrences in the first n bytes."""
        at = np.arange(0, n, LANE)
        stop = np.minimum(at + LANE, n - self.m + 1)
        at, stop = at[at < stop], stop[at < stop]
        last, found = self.m - self.block, []
        while len(at):
            ahead = self.shift[self.slot(words[at + last] & self.mask)].astype(np.int64)
            if len(hit := at[ahead == 0]):
                found.append(hit)
            at = at + np.maximum(ahead, 1)
            if not (live := at < stop).all():
                at, stop = at[live], stop[live]
        if not found or not len(self.keys):
            return []
        place = np.concatenate(found)
        keys = self.key(words[place] & self.mask, words[place + last] & self.mask)
        bucket = np.searchsorted(self.keys, keys)
        bucket[bucket == len(self.keys)] = 0
        right = self.keys[bucket] == keys
        out = []
        for s, b in zip(place[right].tolist(), bucket[right].tolist(), strict=True):
            for i in self.order[self.bounds[b] : self.bounds[b + 1]].tolist():
                if text.startswith(own[self.begin[i] : self.end[i]], s):
                    out.append((s, int(self.ids[i])))
        return out


def folded(texts: list[bytes]) -> tuple[bytes, int, np.ndarray, np.ndarray]:
    """The texts one after the other, a space around every word and 0xFF after every text; its length without what is added
    at the end; where each word begins, and the number of words before each text."""
    raw = np.frombuffer((b" " + b" \xff ".join(texts) + b" \xff ").translate(_FOLD), np.uint8)
    space = raw == 32
    space[1:] &= space[:-1]
    space[0] = False
    kept = raw[~space]
    begins = np.flatnonzero((kept[:-1] == 32) & (kept[1:] != 32) & (kept[1:] != END)) + 1
    bounds = np.r_[0, np.searchsorted(begins, np.flatnonzero(kept == END))]
    return kept.tobytes() + b"\xff" * 16, len(kept), begins, bounds


class Searcher:
    """All windows of a benchmark. items: (item_id as text, text)."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        self.names = [item for item, _ in items]
        self.text, n, begins, bounds = folded([(t or "").encode() for _, t in items])
        ends = np.flatnonzero((np.frombuffer(self.text, np.uint8, n - 1, 1) == 32) & ~np.isin(np.frombuffer(self.text, np.uint8, n - 1), (32, END))) + 1
        words = np.diff(bounds)[: len(items)]
        count = np.where(words > 0, np.maximum(1, words - size + 1), 0)
        self.item = np.repeat(np.arange(len(items)), count)
        first = np.repeat(bounds[: len(items)], count) + np.arange(len(self.item)) - np.repeat(np.cumsum(count) - count, count)
        self.n_words = np.minimum(size, words)[self.item]
        begin, end = begins[first] - 1, ends[first + self.n_words - 1] + 1
        kind = np.digitize(end - begin, (8, 16, 32))
        self.groups = [Group(self.text, begin[mine], end[mine], mine) for k in range(4) if len(mine := np.flatnonzero(kind == k))]

    def scan(self, texts: list[bytes]) -> list[tuple[int, int, set[str]]]:
        """(words, hit words, items) of each text."""
        return [(n, sum(b - a for a, b in runs), items) for n, runs, items in self.places(texts)]

    def places(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """(words, runs of hit words, items) of each text."""
        text, n, begins, bounds = folded(texts)
        words = loads(text, n + 8)
        hits = [x for g in self.groups for x in g.search(self.text, text, words, n)]
        items: list[set[str]] = [set() for _ in texts]
        covered = np.zeros(len(begins) + 1, np.int64)
        if hits:
            place, which = np.array(hits).T
            word = np.searchsorted(begins, place + 1)
            np.add.at(covered, word, 1)
            np.subtract.at(covered, word + self.n_words[which], 1)
            docs = np.searchsorted(bounds, word, "right") - 1
            for d, i in set(zip(docs.tolist(), which.tolist(), strict=True)):
                items[d].add(self.names[self.item[i]])
        hit = np.cumsum(covered[:-1]) > 0
        edge = np.zeros(len(hit) + 1, bool)
        edge[bounds] = True  # words of two documents are never one run
        before, after = np.r_[False, hit[:-1]], np.r_[hit[1:], False]
        first, last = np.flatnonzero(hit & (~before | edge[:-1])), np.flatnonzero(hit & (~after | edge[1:])) + 1
        runs: list[list[tuple[int, int]]] = [[] for _ in texts]
        doc = np.searchsorted(bounds, first, "right") - 1
        for d, x, y in zip(doc.tolist(), (first - bounds[doc]).tolist(), (last - bounds[doc]).tolist(), strict=True):
            runs[d].append((x, y))
        return list(zip(np.diff(bounds).tolist(), runs, items, strict=True))


def parts(benchmark: DataFrame, most_bytes: int = MOST_BYTES) -> list[DataFrame]:
    """The benchmark (item, text) in parts of at most ``most_bytes``, single items apart."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    total, largest = items.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    n = 1
    while total > most_bytes:
        n = max(2 * n, -(-total // most_bytes))
        place = F.pmod(F.xxhash64("text"), F.lit(n))  # equal texts lie together
        sizes = items.groupBy(place.alias("i")).agg(F.sum(size).alias("bytes"), F.max(size).alias("one")).orderBy("i").collect()
        if all(r["bytes"] <= max(most_bytes, r["one"]) for r in sizes):
            return [items.where(place == r["i"]) for r in sizes]
        if n > 64 * -(-total // most_bytes):  # one text under very many ids: its ids are sent, its windows are built once
            return [items.where(place == r["i"]) for r in sizes]
    return [items]


def scanner(part: DataFrame, size: int = WINDOW):
    """A function of a text column to struct<n_words, n_hit, runs, items>, for one part of a benchmark."""
    sent = part.sparkSession.sparkContext.broadcast(common.Recipe(Searcher, [tuple(r) for r in part.collect()], size))

    @arrow_udf("struct<n_words: long, n_hit: long, runs: array<struct<begin: long, end: long>>, items: array<string>>")
    def scan(text: pa.Array) -> pa.Array:
        rows = [r for part in common.chunks(text) for r in sent.value.made().places(part)]
        columns = [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([sum(b - a for a, b in r[1]) for r in rows], pa.int64()),
            pa.array([[{"begin": a, "end": b} for a, b in r[1]] for r in rows], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
            pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string())),
        ]
        return pa.StructArray.from_arrays(columns, ["n_words", "n_hit", "runs", "items"])

    return scan


#: Words in any of the sorted runs of all parts.
_UNION = """aggregate(array_sort(flatten(collect_list(x.runs))), named_struct('n', 0L, 'to', 0L),
  (a, r) -> named_struct('n', a.n + greatest(0L, r.end - greatest(r.begin, a.to)), 'to', greatest(a.to, r.end)), a -> a.n)"""


def _found_in_parts(texts: DataFrame, given: list[DataFrame]) -> DataFrame:
    """texts: rid, text (stored). rid, x: what all parts find together; a group has a row of the first part, and one of each other with hits."""
    every = [texts.select("rid", scanner(p)(F.col("text")).alias("x")) for p in given]
    found = reduce(DataFrame.unionByName, [common.stored(rows if i == 0 else rows.where("x.n_hit > 0"), "part") for i, rows in enumerate(every)])
    together = found.groupBy("rid").agg(F.max("x.n_words").alias("n_words"), F.expr(_UNION).alias("n_hit"), F.array_distinct(F.flatten(F.collect_list("x.items"))).alias("items"))
    return together.select("rid", F.struct("n_words", "n_hit", "items").alias("x"))


def contaminated(found: Column, share: int = SHARE) -> Column:
    """Any hit, and at least one word in ``share`` hit."""
    hit, words = found.getField("n_hit"), found.getField("n_words")
    return (hit > 0) & (hit * share >= words)


def report(docs: DataFrame, benchmark: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items."""
    given, x = parts(benchmark, most_bytes), F.col("x")
    if len(given) == 1:
        found = docs.select(F.col("doc_id").alias("doc_id"), scanner(given[0])(F.col("text")).alias("x"))
    else:
        texts = common.stored(common.row_numbered(docs.select(F.col("doc_id").alias("doc_id"), "text"), "rid"), "texts")
        found = texts.select("rid", "doc_id").join(_found_in_parts(texts, given), "rid")
    return found.select(
        "doc_id", "x.n_words", "x.n_hit", F.size("x.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("x.items")).cast("binary"), 256).alias("items_sha256"),
        contaminated(x).alias("contaminated"), "x.items",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The documents that are not contaminated, all columns."""
    given, names = parts(benchmark, most_bytes), docs.columns
    if len(given) == 1:
        return docs.where(~contaminated(scanner(given[0])(F.col("text"))))
    rows = common.stored(common.row_numbered(docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")), "rid"), "rows")
    gone = _found_in_parts(rows.select("rid", "row.text"), given).where(contaminated(F.col("x"))).select("rid")
    return rows.join(gone, "rid", "left_anti").select(*(F.col("row").getField(c).alias(c) for c in names))


def sha_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
