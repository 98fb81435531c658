"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of packets: its documents in a fixed order, each cut every
``SEQUENCE`` tokens. A round is a window of ``WINDOW`` tokens. In each round every
queue earns its share of the window; a packet is served in the first round whose
earned total covers the packet's end, and what is left of the deficit counter is
carried to the next round. As a queue's counter after round w is its share times
(w + 1) less what it has served, the round of a packet follows from its end in the
queue alone, ``ceil(end / (share * window)) - 1``: the same schedule that a serial
round-robin makes, with deficits carried over all windows and partitions, from
prefix sums that no single task has to make. Shares are the sources' part of all
tokens, or given ``targets``; a queue that runs dry leaves its part to the others.

Served tokens are laid end to end and cut into sequences, so only the last one
could need padding; its rest is cut into powers of two, which need none.

Defined cases: a null text counts as empty (its one token is the end mark); a special
token's string in a text becomes that token, as the library does by default; a null
source is a queue of its own; a very long text is cut like any other; rows are told
apart by a row id, so ties in doc_id and repeated rows are packed as often as they
occur; other columns are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import common

SEQUENCE = 1024
WINDOW = 64 * SEQUENCE
END_ID = 0
BUCKET_ROWS = 512
NO_SOURCE = "\x00"


class Encoder:
    """Text to ids as a ``tokenizers`` file says, without the tokens that a post-processor adds.

    tiktoken merges byte-level BPE several times faster than the library. It takes the file's
    ranks where the file is of that plain form (checked), else the library itself is used.
    Special tokens are cut out of the text first, the leftmost, then the longest one.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        self.special = {t["content"]: t["id"] for t in given["added_tokens"]}
        self.n_vocab = 1 + max([*given["model"]["vocab"].values(), *self.special.values()])
        self._cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._plain = self._library = None
        if self._is_plain(given):
            import public_tokenizers
            import tiktoken

            byte_of = _byte_of()
            ranks = {bytes(byte_of[c] for c in token): i for token, i in given["model"]["vocab"].items() if token not in self.special}
            del given
            self._plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(path)

    @staticmethod
    def _is_plain(given: dict) -> bool:
        model, before = given["model"], given.get("pre_tokenizer") or {}
        odd = [model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
        odd += [t[x] for t in given["added_tokens"] for x in ("single_word", "lstrip", "rstrip", "normalized")]
        simple = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        return model["type"] == "BPE" and simple and not given.get("normalizer") and not any(odd)

    def encode(self, text: str) -> list[int]:
        if self._library:
            return self._library.encode(text, add_special_tokens=False).ids
        if not self._cut or not self._cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self._cut.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._plain(text[at:])


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level BPE files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_columns(path: str):
    """text -> struct<n: int, ids: binary>, ids as little-endian 16-bit numbers, or 32-bit for large vocabularies."""

    @arrow_udf("struct<n: int, ids: binary>")
    def tokens(text: pa.Array) -> pa.Array:
        e = encoder(path)
        kind = "<u2" if e.n_vocab <= 1 << 16 else "<u4"
        n, ids = [], []
        for part in common.chunks(text):
            for raw in part:
                got = e.encode(raw.decode())
                got.append(END_ID)
                n.append(len(got))
                ids.append(np.array(got, kind).tobytes())
        return pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(ids, pa.binary())], ["n", "ids"])

    return tokens


def round_of(end: int, total: int, queue: int, window: int) -> int:
    """The round whose earned total first covers ``end``, for a queue with ``queue`` of ``total`` tokens."""
    return -(-end * total // (window * queue)) - 1


class Shares:
    """Earned totals under given targets: pieces of (first earned, first window position, weight over active weight)."""

    def __init__(self, sizes: dict[str, int], targets: dict[str, float]):
        from fractions import Fraction

        self.of: dict[str, list[tuple[int, Fraction, Fraction]]] = {q: [] for q in sizes}
        weights = {q: Fraction(targets.get(q, 0)).limit_denominator(10**6) for q in sizes}
        left = {q: Fraction(n) for q, n in sizes.items() if n}
        clock = Fraction(0)
        while left:
            active = {q: weights[q] for q in left if weights[q] > 0} or {q: left[q] for q in left}
            total = sum(active.values())
            step = min(left[q] * total / active[q] for q in active)
            for q, w in active.items():
                self.of[q].append((sizes[q] - left[q], clock, w / total))
                left[q] -= step * w / total
            left = {q: n for q, n in left.items() if n > 0}
            clock += step

    def round_of(self, queue: str, end: int, window: int) -> int:
        first, clock, rate = next(x for x in reversed(self.of[queue]) if x[0] < end)
        return max(0, -(-(clock + (end - first) / rate) // window) - 1)


def served(rows: DataFrame, window: int, targets: dict[str, float] | None) -> DataFrame:
    """rows: rid, q, n. (rid, w, begin, length, q, a): runs of a document served in one round; a is the place in the queue."""
    total, count = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    queues = rows.groupBy("q").agg(F.sum("n").cast("long").alias("queue"))
    buckets = max(1, -(-count // BUCKET_ROWS))
    spread = rows.withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(buckets)))
    bases = common.exclusive_prefix(spread.groupBy("q", "bucket").agg(F.sum("n").cast("long").alias("size")), "bucket", "size", "base", ["q"])
    inside = W.partitionBy("q", "bucket").orderBy("rid").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        spread.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(bases.drop("size"), ["q", "bucket"])
        .join(queues, "q")
        .select("rid", "q", "n", "queue", (F.col("base") + F.col("before")).cast("long").alias("a"))
    )
    shares = Shares({r["q"]: r["queue"] for r in queues.where(F.col("q").isin(list(targets))).collect()} | {"": 0}, targets) if targets else None
    if targets:
        _covered(queues, targets)

    @arrow_udf("array<struct<w: long, begin: long, length: long>>")
    def rounds(q: pa.Array, n: pa.Array, queue: pa.Array, a: pa.Array) -> pa.Array:
        out = []
        for name, size, all_of, at in zip(q.to_pylist(), n.to_pylist(), queue.to_pylist(), a.to_pylist(), strict=True):
            runs: list[dict] = []
            for begin in range(0, size, SEQUENCE):
                end = min(size, begin + SEQUENCE)
                w = shares.round_of(name, at + end, window) if shares else round_of(at + end, total, all_of, window)
                if runs and runs[-1]["w"] == w:
                    runs[-1]["length"] += end - begin
                else:
                    runs.append({"w": w, "begin": begin, "length": end - begin})
            out.append(runs)
        kind = pa.list_(pa.struct([("w", pa.int64()), ("begin", pa.int64()), ("length", pa.int64())]))
        return pa.array(out, kind)

    return placed.select("rid", "q", "a", F.explode(rounds("q", "n", "queue", "a")).alias("x")).select("rid", "q", (F.col("a") + F.col("x.begin")).alias("a"), "x.w", "x.begin", "x.length")


def _covered(queues: DataFrame, targets: dict[str, float]) -> None:
    if missing := queues.where(~F.col("q").isin(list(targets))).limit(1).collect():
        raise ValueError(f"targets name no proportion for source {missing[0]['q']!r}")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, targets: dict[str, float] | None = None, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, window, ids.

    ``ids`` holds the piece's ids as little-endian 32-bit numbers; without ``with_ids`` there is no such column.
    """
    tokens = token_columns(tokenizer)
    read = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("q"), tokens("text").alias("x"))
    table = common.stored(common.row_numbered(read.select("doc_id", "q", "x.n", "x.ids"), "rid"), "tokens")
    runs = common.stored(served(table.select("rid", "q", "n"), window, targets), "served")
    bases = common.exclusive_prefix(runs.groupBy("w").agg(F.sum("length").cast("long").alias("size")), "w", "size", "base")
    inside = W.partitionBy("w").orderBy("q", "a").rowsBetween(W.unboundedPreceding, -1)
    laid = (
        runs.withColumn("before", F.coalesce(F.sum("length").over(inside), F.lit(0)))
        .join(bases.drop("size"), "w")
        .groupBy("rid")
        .agg(F.sort_array(F.collect_list(F.struct("begin", "length", (F.col("base") + F.col("before")).alias("at"), "w"))).alias("runs"))
    )
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cut = _cutter(total, with_ids)
    out = table.join(laid, "rid").select("doc_id", F.col("n").cast("long").alias("doc_tokens"), F.nullif("q", F.lit(NO_SOURCE)).alias("source"), F.explode(cut("ids", "n", "runs")).alias("p"))
    return out.select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset", "source", "p.window", *(["p.ids"] if with_ids else []))


def boundaries(total: int) -> tuple[int, list[int]]:
    """Whole sequences, and the ends of the powers of two that take the rest."""
    whole, ends = total // SEQUENCE, []
    at, rest = whole * SEQUENCE, total % SEQUENCE
    while rest:
        at += 1 << (rest.bit_length() - 1)
        rest -= 1 << (rest.bit_length() - 1)
        ends.append(at)
    return whole, ends


def _cutter(total: int, with_ids: bool):
    whole, ends = boundaries(total)
    tail = [whole * SEQUENCE, *ends]
    names = ["start", "length", "ids_crc32", "sequence_id", "offset", "window"]

    @arrow_udf("array<struct<start: long, length: long, ids_crc32: long, sequence_id: long, offset: long, window: long" + (", ids: binary>>" if with_ids else ">>"))
    def cut(ids: pa.Array, n: pa.Array, runs: pa.Array) -> pa.Array:
        pieces: list[tuple] = []
        data: list[bytes] = []
        counts = [0]
        # Row by row from Arrow's own buffers: Python holds the ids of one document at a time.
        for raw, size, mine in zip(ids, n.to_pylist(), runs.to_pylist(), strict=True):
            raw = raw.as_buffer()
            raw = np.frombuffer(raw, f"<u{len(raw) // size}").astype("<u4").view(np.uint8)
            for r in mine:
                start, left, at = r["begin"], r["length"], r["at"]
                while left:
                    if at < tail[0]:
                        sequence, first = divmod(at, SEQUENCE)
                        first, stop = at - first, at - first + SEQUENCE
                    else:
                        k = next(i for i in range(len(ends)) if at < ends[i])
                        sequence, first, stop = whole + k, tail[k], ends[k]
                    take = min(left, stop - at)
                    piece = raw[4 * start : 4 * (start + take)]
                    pieces.append((start, take, zlib.crc32(piece), sequence, at - first, r["w"]))
                    if with_ids:
                        data.append(piece.tobytes())
                    start, left, at = start + take, left - take, at + take
            counts.append(len(pieces))
        columns = list(zip(*pieces, strict=True)) if pieces else [()] * len(names)
        arrays = [pa.array(c, pa.int64()) for c in columns] + ([pa.array(data, pa.binary())] if with_ids else [])
        struct = pa.StructArray.from_arrays(arrays, names + ["ids"] * with_ids)
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), struct)

    return cut
