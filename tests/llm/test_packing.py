"""Packing: an exact round trip, ids as the tokenizers library gives them, windows near their targets."""

import json
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from seqlake.llm import packing, queries
from seqlake.llm.common import table

from . import messy


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    return [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(docs, targets=None):
    rows = docs.select("doc_id", "text", "source").collect()
    want = Counter((r["doc_id"], tuple(ids)) for r, ids in zip(rows, library_ids([r["text"] for r in rows])))
    pieces = packing.pack(docs, queries.tokenizer(), window=4096, targets=targets).collect()
    sequences = defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4")
        assert len(ids) == p["length"] > 0 and zlib.crc32(p["ids"]) == p["ids_crc32"]
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    total = sum(p["length"] for p in pieces)
    assert sorted(sequences) == list(range(len(sequences)))
    for spans in sequences.values():
        spans.sort()
        at = 0
        for offset, length in spans:
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0
    # Pieces of documents: each id once, by cutting the whole documents again.
    got = Counter()
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"], p["doc_tokens"]].append((p["start"], p["length"], tuple(np.frombuffer(p["ids"], "<u4").tolist())))
    for (doc, n), parts in by_doc.items():
        copies = sum(1 for s, *_ in parts if s == 0)
        assert sum(length for _, length, _ in parts) == n * copies
        if copies == 1:
            parts.sort()
            got[doc, tuple(i for *_, ids in parts for i in ids)] += 1
    assert all(want[k] == v for k, v in got.items())
    assert total == sum(len(ids) * c for (_, ids), c in want.items())
    return pieces


def test_messy(spark):
    check(messy.documents(spark))
    assert packing.pack(messy.nothing(spark), queries.tokenizer()).count() == 0


def test_windows_meet_their_targets(spark, small):
    docs = table(spark, small, "documents")
    pieces = check(docs)
    size, window = Counter(), defaultdict(Counter)
    for p in pieces:
        size[p["source"]] += p["length"]
        window[p["window"]][p["source"]] += p["length"]
    total = sum(size.values())
    served = Counter()
    for w in range(max(window)):
        for s in size:
            served[s] += window[w][s]
            earned = Fraction(size[s] * (w + 1) * 4096, total)
            assert earned - packing.SEQUENCE < served[s] <= earned


def serial(queue_sizes, packets, window):
    """Deficit round-robin as a loop."""
    total = sum(queue_sizes.values())
    deficit = {q: Fraction(0) for q in packets}
    at = dict.fromkeys(packets, 0)
    out, w = {q: [] for q in packets}, 0
    while any(at[q] < len(packets[q]) for q in packets):
        for q in packets:
            deficit[q] += Fraction(queue_sizes[q] * window, total)
            while at[q] < len(packets[q]) and packets[q][at[q]] <= deficit[q]:
                deficit[q] -= packets[q][at[q]]
                out[q].append(w)
                at[q] += 1
        w += 1
    return out


def test_rounds_are_those_of_the_serial_loop():
    rng = np.random.default_rng(3)
    packets = {q: rng.integers(1, 1024, n).tolist() for q, n in (("a", 50), ("b", 7), ("c", 200))}
    sizes = {q: sum(p) for q, p in packets.items()}
    for window in (700, 4096, 65536):
        want = serial(sizes, packets, window)
        for q, p in packets.items():
            assert [packing.round_of(int(e), sum(sizes.values()), sizes[q], window) for e in np.cumsum(p)] == want[q]


def test_given_targets(spark):
    docs = messy.documents(spark, [(i, "alpha beta gamma " * 40, None, "ab"[i % 2]) for i in range(400)])
    pieces = check(docs, {"a": 3.0, "b": 1.0})
    first = Counter()
    for p in pieces:
        if p["window"] == 0:
            first[p["source"]] += p["length"]
    assert abs(first["a"] / sum(first.values()) - 0.75) < 0.1
    with pytest.raises(ValueError):
        packing.pack(docs, queries.tokenizer(), targets={"a": 1.0})


def test_unequal_targets_over_all_windows(spark):
    """Three sources far from their targets: each window is as planned until a source ends, then the others share it."""
    sizes, targets = {"a": 300, "b": 120, None: 60}, {"a": 0.5, "b": 0.3, packing.NO_SOURCE: 0.2}
    rows = [(i, "river stone cloud " * 30 + str(i), None, q) for i, q in enumerate(q for q, n in sizes.items() for _ in range(n))]
    docs = messy.documents(spark, rows)
    docs = docs.unionByName(docs.limit(1).withColumns({"text": F.lit("one <|endoftext|> two"), "doc_id": F.lit(10_000).cast("long"), "source": F.lit("b")}))
    pieces = check(docs, targets)
    left, got = Counter(), defaultdict(Counter)
    for p in pieces:
        left[p["source"]] += p["length"]
        got[p["window"]][p["source"]] += p["length"]
    assert len({packing.NO_SOURCE if q is None else q for q in left}) == 3
    served = Counter()
    earned = dict.fromkeys(left, Fraction(0))
    weight = {q: Fraction(str(targets[packing.NO_SOURCE if q is None else q])) for q in left}
    for w in range(max(got) + 1):
        budget = Fraction(4096)
        while budget and (active := [q for q in left if earned[q] < left[q]]):
            total = sum(weight[q] for q in active)
            step = min([budget, *((left[q] - earned[q]) * total / weight[q] for q in active)])
            for q in active:
                earned[q] += step * weight[q] / total
            budget -= step
        for q in left:
            served[q] += got[w][q]
            assert earned[q] - packing.SEQUENCE < served[q] <= earned[q]


def test_pieces_without_ids(spark):
    docs = messy.documents(spark)
    key = lambda rows: Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["sequence_id"], r["offset"]) for r in rows)
    bare = packing.pack(docs, queries.tokenizer(), with_ids=False)
    assert "ids" not in bare.columns and sum(r["length"] for r in bare.collect()) == sum(r["length"] for r in packing.pack(docs, queries.tokenizer()).collect())
    one = messy.documents(spark, [(1, "a <|endoftext|> b " * 900, None, "s")])
    assert key(packing.pack(one, queries.tokenizer(), with_ids=False).collect()) == key(packing.pack(one, queries.tokenizer()).collect())


def test_ids_equal_the_library():
    texts = messy.texts() + ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>x<|endoftext", " <|endoftext|>\n ",  "it's  we'll\n\n x ", "  a", "日本語テキスト", "a" * 3000, " " * 500 + "b", "\r\n\t"]
    e = packing.encoder(queries.tokenizer())
    assert [[*e.encode(t or ""), 0] for t in texts] == library_ids(texts)


def test_files_of_another_form_go_to_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    e, t = packing.Encoder(path), Tokenizer.from_file(path)
    assert all(e.encode(x) == t.encode(x, add_special_tokens=False).ids for x in ("Two Words", "a <|endoftext|> b", ""))


def test_every_token_of_the_vocabulary_is_reached():
    """A whole piece is looked up first here; the library merges. Both must give each token for its own text."""
    e = packing.encoder(queries.tokenizer())
    texts = []
    byte_of = packing._byte_of()
    with open(queries.tokenizer(), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    for token in vocabulary.keys() - e.special.keys():
        try:
            texts.append(bytes(byte_of[c] for c in token).decode())
        except UnicodeDecodeError:
            continue
    assert len(texts) > 40_000
    assert [[*e.encode(t), 0] for t in texts] == library_ids(texts)
