"""SimHash near-duplicates through deletion-variant signatures.

Two fingerprints that differ in at most ``bits`` places are cut into so few
segments (bits // 2 + 1) that one segment differs in at most one place. Each
distinct fingerprint is indexed under every segment with one place blanked, so
such a pair meets under the key whose blank covers the difference. An equality
shuffle brings the members of a key together, and each pair is verified on the
whole fingerprint, only under the first key that it shares.

A key gives at most a spanning forest of its links, never all pairs. Keys of more
than ``BLOCK`` members are cut into blocks, and each pair of blocks is its own
group, so no task holds more than two blocks. Components come from alternating
large-star and small-star rounds over stored tables.

The nodes are fingerprints, so an id that stands on several texts joins nothing; a
component is named after the smallest doc_id on its rows.

Defined cases: a null text counts as empty (fingerprint zero, linked like any
other); a row with a null doc_id links like any other, and a component without any
doc_id has a null name; repeated rows share their fingerprint and component; one id on
several rows is several documents; very long texts are read whole; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 4
WORDS = 4
SEED = 42
BLOCK = 4096
LAGS = 48


def fingerprint(raw: bytes, words: int = WORDS) -> int:
    """Majority bit of the XXH64 values of all shingles, unsigned."""
    tokens = raw.lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    joined = b" ".join(tokens)
    ends = [e - 1 for e in accumulate(len(t) + 1 for t in tokens)]
    begins = [0, *(e + 1 for e in ends[: len(tokens) - words])]
    h = xxhash.xxh64_intdigest
    values = np.fromiter((h(joined[a:b], SEED) for a, b in zip(begins, ends[words - 1 :], strict=True)), np.uint64, len(begins))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 32768):
        part = values[at : at + 32768].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view(np.uint64)[0])


@common.on_arrow("long")
def fingerprints(text: pa.Array) -> pa.Array:
    out = [fingerprint(raw) for part in common.chunks(text) for raw in part]
    return pa.array(np.array(out, np.uint64).view(np.int64))


def segments(bits: int) -> list[tuple[int, int]]:
    """(first place, width) of each segment."""
    n = bits // 2 + 1
    widths = [64 // n + (i < 64 % n) for i in range(n)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def first_shared(x: np.ndarray, bits: int) -> np.ndarray:
    """The first place under which two fingerprints with difference x share a key (64: none)."""
    out = np.full(len(x), 64, np.int64)
    for low, width in reversed(segments(bits)):
        part = (x >> np.uint64(low)) & np.uint64((1 << width) - 1)
        place = np.where(part == 0, 0, np.bitwise_count(part - (part > 0).astype(np.uint64)))
        hit = np.bitwise_count(part) <= 1
        out[hit] = low + place[hit]
    return out


def _linked(a: np.ndarray, b: np.ndarray, place: np.ndarray | int, bits: int) -> np.ndarray:
    x = a ^ b
    near = np.flatnonzero(np.bitwise_count(x) <= bits)
    at = place if np.isscalar(place) else place[near]
    return near[first_shared(x[near], bits) == at]


def forest(a: np.ndarray, b: np.ndarray | None, place: int, bits: int) -> list[tuple[int, int]]:
    """Index pairs (i, j) of a spanning forest of the links within a, or between a and b (indices then shifted)."""
    other = a if b is None else b
    shift = 0 if b is None else len(a)
    parent = list(range(len(a) + (0 if b is None else len(b))))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in range(len(a)):
        rest = other[i + 1 :] if b is None else other
        for j in _linked(np.broadcast_to(a[i], len(rest)), rest, place, bits):
            j = int(j) + (i + 1 if b is None else shift)
            p, q = root(i), root(j)
            if p != q:
                parent[q] = p
                out.append((i, j))
    return out


def _edges_of_runs(bits: int):
    """From rows sorted by key: links (hot false), and the members of keys too large for one group (hot true)."""

    def batch(u, v, hot, key=None, fp=None):
        n = len(u)
        nothing = np.zeros(n, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(u, np.int64)), pa.array(np.asarray(v, np.int64)), pa.array(np.full(n, hot)), pa.array(nothing if key is None else key), pa.array(nothing if fp is None else fp)], ["u", "v", "hot", "key", "fp"])

    def small(key, fp, rep):
        """All complete keys of the arrays."""
        n = len(key)
        if n < 2:
            return
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[start, n])
        room = np.repeat(length, length) - (np.arange(n) - np.repeat(start, length)) - 1
        big = np.repeat(length > LAGS, length)
        for lag in range(1, min(LAGS, int(length.max()))):
            i = np.flatnonzero((room >= lag) & ~big)
            if not len(i):
                break
            near = _linked(fp[i], fp[i + lag], key[i] >> 32, bits)
            if len(near):
                yield batch(rep[i[near]], rep[i[near] + lag], False)
        for s, size in zip(start[length > LAGS], length[length > LAGS], strict=True):
            if pairs := forest(fp[s : s + size], None, int(key[s] >> 32), bits):
                i, j = np.array(pairs).T + s
                yield batch(rep[i], rep[j], False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, rep, over, members = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), None, 0
        for b in batches:
            cols = {n: b.column(n).to_numpy() for n in ("key", "fp", "rep")}
            key, fp, rep = np.r_[key, cols["key"]], np.r_[fp, cols["fp"].view(np.uint64)], np.r_[rep, cols["rep"]]
            while len(key):
                if over is not None:
                    n = int(np.searchsorted(key, over, "right"))
                    yield batch(rep[:n], (members + np.arange(n)) // BLOCK, True, key[:n], fp[:n].view(np.int64))
                    members += n
                    if n == len(key):
                        key, fp, rep = key[:0], fp[:0], rep[:0]
                        break
                    key, fp, rep, over, members = key[n:], fp[n:], rep[n:], None, 0
                last = int(np.searchsorted(key, key[-1], "left"))
                starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                sizes = np.diff(np.r_[starts, len(key)])
                large = np.flatnonzero(sizes > BLOCK)
                stop = int(starts[large[0]]) if len(large) else last
                yield from small(key[:stop], fp[:stop], rep[:stop])
                key, fp, rep = key[stop:], fp[stop:], rep[stop:]
                if not len(large):
                    break
                over = int(key[0])
        yield from small(key, fp, rep)

    return run


def _edges_of_blocks(bits: int):
    def run(t: pa.Table) -> pa.Table:
        fp, rep, block = t["fp"].to_numpy().view(np.uint64), t["u"].to_numpy(), t["block"].to_numpy()
        place = int(t["key"][0].as_py() >> 32)
        low = block == block.min()
        same = t["bi"][0].as_py() == t["bj"][0].as_py()
        pairs = forest(fp, None, place, bits) if same else forest(fp[low], fp[~low], place, bits)
        ids = rep if same else np.r_[rep[low], rep[~low]]
        i, j = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.table({"u": ids[i], "v": ids[j]})

    return run


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(u, v) by representative: links that connect what all links connect. fps: distinct fp with rep."""
    case = lambda i: "CASE " + " ".join(f"WHEN p < {low + w} THEN {(low, (1 << w) - 1)[i]}L" for low, w in segments(bits)) + " END"
    keys = (
        fps.select("fp", "rep", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
        .withColumn("low", F.expr(case(0)).cast("int"))
        .withColumn("part", F.expr(f"shiftrightunsigned(fp, low) & ({case(1)})"))
        .select(F.expr("shiftleft(cast(p as bigint), 32) | (part & ~shiftleft(1L, p - low))").alias("key"), "fp", "rep")
    )
    found = common.stored(
        keys.repartition("key").sortWithinPartitions("key").mapInArrow(_edges_of_runs(bits), "u long, v long, hot boolean, key long, fp long"), "links"
    )
    pairs = found.where("not hot").select("u", "v")
    hot = found.where("hot").select("key", "fp", "u", F.col("v").alias("block"))
    if hot.take(1):
        blocks = hot.groupBy("key").agg((F.max("block") + 1).alias("n"))
        spread = hot.join(blocks, "key").select("key", "fp", "u", "block", F.explode(F.expr("sequence(0L, n - 1)")).alias("other"))
        spread = spread.select("key", "fp", "u", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
        pairs = pairs.unionByName(spread.groupBy("key", "bi", "bj").applyInArrow(_edges_of_blocks(bits), "u long, v long"))
    return pairs


def _anew(key: str) -> Column:
    """The key, in a form that Spark can't take for the one it was grouped by: a join then deals both sides anew and may split a hub."""
    return F.col(key).bitwiseXOR(F.lit(0).cast("long"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that can be reached. Only nodes with links."""
    edges = common.stored(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(_anew("u").alias("u"), F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(_anew("u").alias("u"), "m")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = common.stored(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _grouped(docs: DataFrame, bits: int) -> DataFrame:
    """One row for each document: doc_id, fp, node (the same for all of a component), component_id."""
    marked = common.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprints("text").alias("fp")), "fingerprints")
    fps = common.stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(fps.select("fp", F.col("fp").alias("rep")), bits))
    placed = common.stored(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("node")), "placed")
    names = placed.groupBy("node").agg(F.min("least").alias("component_id")).select(_anew("node").alias("node"), "component_id")
    return marked.join(placed.drop("least").join(names, "node"), "fp")


def groups(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, fp, component_id."""
    return _grouped(docs, bits).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """The documents with one row of each group, all columns: one with the smallest doc_id (null last).

    Rows whose doc_id is theirs alone are told apart by it: only ids are joined and grouped, and documents are
    dealt out once, to be rid of those that go. Rows that share a doc_id or have none are stored with a row id,
    and of those that could stay for a group the one with the smallest digest of its text does.
    """
    found = common.stored(_grouped(docs, bits), "groups")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    shared = common.stored(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_gone")), "shared")
    if not shared.take(1):
        return docs.join(gone.distinct().hint("shuffle_hash"), docs["doc_id"] == gone["_gone"], "left_anti")
    # A null doc_id equals nothing in a join, so its rows are taken out by themselves.
    names, known = docs.columns, docs.where(F.col("doc_id").isNotNull())
    leaves = gone.unionByName(shared.where("_gone is not null")).distinct().hint("shuffle_hash")
    alone = known.join(leaves, known["doc_id"] == leaves["_gone"], "left_anti")
    alike = known.join(shared, known["doc_id"] == shared["_gone"], "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
    row = F.struct(*(F.col(f"`{c}`") for c in names))
    rows = common.stored(common.row_numbered(alike.select(row.alias("row"), fingerprints("text").alias("fp")), "rid"), "alike")
    thin = rows.select("rid", F.col("row.doc_id").cast("long").alias("doc_id"), "fp", F.sha2(F.col("row.text").cast("binary"), 256).alias("sha"))
    first = thin.join(found.select("fp", "node", "component_id").distinct(), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays = first.groupBy("node").agg(F.min(F.struct("sha", "rid")).alias("best")).select(F.col("best.rid").alias("rid"))
    return alone.unionByName(rows.join(stays, "rid", "left_semi").select(*(F.col("row").getField(c).alias(c) for c in names)))
