"""Exact and near de-duplication against brute force."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from seqlake.llm import exact_dedup, queries, simhash
from seqlake.llm.common import table

from . import messy

#: Stands for no id, after all ids and fingerprints.
NO_ID = 1 << 80
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(FOLD)].append(i)
    return sorted((str(i), str(max((x for x in g if x is not None), default=None)), len(g), sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)


def check_exact(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    out = exact_dedup.classes(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in out) == brute_exact(rows)
    kept = defaultdict(int)
    for r in out:
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) <= {1}


def test_exact_messy(spark):
    check_exact(messy.documents(spark))
    assert exact_dedup.classes(messy.nothing(spark)).count() == 0


def test_exact_shared_heads(spark):
    """Texts that part only after the first split, at its edges, or end exactly there."""
    head = "h" * exact_dedup.HEAD
    cuts = [0, 1, exact_dedup.FIRST - 1, exact_dedup.FIRST, exact_dedup.FIRST + 1, exact_dedup.FIRST * 9, exact_dedup.FIRST * 9 + 1, 40_000]
    texts = [head + "é" * (c // 2) + "z" * (c % 2) + tail for c in cuts for tail in ("", "x", "X", "y")] + ["é" * 64, "É" * 64, "é" * 65]
    check_exact(messy.documents(spark, [(i, t, None, None) for i, t in enumerate(texts * 2)]))


def test_exact_keep_one(spark):
    docs = messy.documents(spark)
    out = exact_dedup.keep_one(docs)
    assert out.columns == docs.columns
    got = [(r["text"] or "").translate(FOLD) for r in out.collect()]
    assert len(got) == len(set(got)) == len({(r["text"] or "").translate(FOLD) for r in docs.collect()})
    assert exact_dedup.keep_one(messy.nothing(spark)).count() == 0


def test_exact_parts_do_not_add_up_over_levels(spark):
    head = "h" * exact_dedup.HEAD
    docs = messy.documents(spark, [(i, head + "z" * (700 * (i % 40)), None, None) for i in range(400)]).repartition(8)
    check_exact(docs)
    assert exact_dedup.classes(docs).rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def brute_fingerprint(text):
    words = (text or "").translate(FOLD).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, bits=4):
    """pairs: (doc_id, fingerprint); a null doc_id names no component."""
    of = {}
    for i, f in pairs:
        of[f] = min(NO_ID if i is None else i, of.get(f, NO_ID))
    fps = list(of)
    arr = np.array(fps, np.uint64)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= bits):
            a, b = find(f), find(fps[j])
            if a != b:
                root[b] = a
    least = defaultdict(lambda: NO_ID)
    for f in fps:
        least[find(f)] = min(least[find(f)], of[f])
    return {f: least[find(f)] for f in fps}


def check_near(docs):
    rows = [r for r in docs.select("doc_id", "text").collect()]
    out = simhash.groups(docs).collect()
    assert len(out) == len(rows)
    fps = {t: brute_fingerprint(t) for t in {r["text"] for r in rows}}
    assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64)) for r in out) == sorted((str(r["doc_id"]), fps[r["text"]]) for r in rows)
    want = brute_components([(r["doc_id"], fps[r["text"]]) for r in rows])
    for r in out:
        assert (NO_ID if r["component_id"] is None else r["component_id"]) == want[r["fp"] % (1 << 64)]


def test_near_messy(spark):
    check_near(messy.documents(spark))
    assert simhash.groups(messy.nothing(spark)).count() == 0


def test_near_on_test_data(spark, small):
    check_near(table(spark, small, "documents"))


@pytest.mark.parametrize("block", [8, 4096])
def test_links_of_dense_clusters(spark, monkeypatch, block):
    """Clusters far larger than a block: linked as by brute force, with at most a forest from each key."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "LAGS", 4)
    rng = random.Random(block)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                f ^= 1 << b
            fps.add(f)
    rows = [(np.uint64(f).astype(np.int64).item(), i) for i, f in enumerate(sorted(fps))]
    # In this process, as workers would import the module anew.
    run = simhash._edges_of_runs(4)
    import pyarrow as pa

    keyed = []
    for fp, rep in rows:
        u = fp % (1 << 64)
        for low, width in simhash.segments(4):
            part = u >> low & ((1 << width) - 1)
            keyed += [((low + p) << 32 | part & ~(1 << p), fp, rep) for p in range(width)]
    keyed.sort()
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*keyed[i : i + 37])], ["key", "fp", "rep"]) for i in range(0, len(keyed), 37)]
    edges, hot = [], defaultdict(list)
    for b in run(iter(batches)):
        for r in b.to_pylist():
            if r["hot"]:
                hot[r["key"]].append((r["fp"], r["u"], r["v"]))
            else:
                edges.append((r["u"], r["v"]))
    assert bool(hot) == (block == 8)
    for key, members in hot.items():
        n = max(b for *_, b in members) + 1
        for i in range(n):
            for j in range(i, n):
                rows_ij = [(key, f, u, b, i, j) for f, u, b in members if b in (i, j)]
                t = pa.table(dict(zip(["key", "fp", "u", "block", "bi", "bj"], map(list, zip(*rows_ij)))))
                edges += [(r["u"], r["v"]) for r in simhash._edges_of_blocks(4)(t).to_pylist()]
    assert all(np.bitwise_count(np.uint64(rows[u][0] % 2**64) ^ np.uint64(rows[v][0] % 2**64)) <= 4 for u, v in edges)
    pairs = spark.createDataFrame(edges, "u long, v long")
    found = {r["node"]: r["root"] for r in simhash.components(pairs).collect()}
    want = brute_components([(i, f % (1 << 64)) for f, i in rows])
    assert all(found.get(i, i) == want[f % (1 << 64)] for f, i in rows)


def test_links_through_spark(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:100]:
        fps |= {f ^ (1 << rng.randrange(64)), f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ 1 ^ 2}
    rows = [(np.uint64(f).astype(np.int64).item(), i) for i, f in enumerate(sorted(fps))]
    frame = spark.createDataFrame(rows, "fp long, rep long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame)).collect()}
    want = brute_components([(i, f % (1 << 64)) for f, i in rows])
    assert all(found.get(i, i) == want[f % (1 << 64)] for f, i in rows)


def test_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    assert {r["node"]: r["root"] for r in simhash.components(pairs).collect()} == {**{i: 0 for i in range(1, 41)}, 101: 100}


UNLIKE = ["the quiet river bends past the old stone mill at dusk", "seven lamps were lit along the harbour wall before dawn", "nobody had counted the swallows since the winter storms", "a ledger of grain and salt lay open on the table"]


def check_kept(docs):
    """One row of each component, with its smallest id; nothing else goes."""
    rows = docs.collect()
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    want = brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in rows])
    kept = [(NO_ID if r["doc_id"] is None else r["doc_id"], brute_fingerprint(r["text"])) for r in out.collect()]
    assert sorted(i for i, _ in kept) == sorted(want[f] for _, f in kept)
    roots = brute_roots(want.keys())
    assert Counter(roots[f] for _, f in kept) == Counter(set(roots.values()))
    assert Counter(map(tuple, out.collect())) <= Counter(map(tuple, rows))


def brute_roots(fps):
    """The smallest fingerprint of each one's component."""
    return brute_components([(f, f) for f in fps])


def test_near_keep_one(spark):
    check_kept(messy.documents(spark))
    assert simhash.keep_one(messy.nothing(spark)).count() == 0


def test_one_id_on_several_texts(spark):
    """(1, A), (3, A), (3, B): B is unlike A and stays; ids and rows that repeat in every way."""
    a, b, c, d = UNLIKE
    assert len(set(brute_roots([brute_fingerprint(t) for t in UNLIKE]).values())) == 4
    for rows in (
        [(1, a), (3, a), (3, b)], [(1, a), (1, b), (2, b), (2, c)], [(3, a), (3, a), (3, b), (3, b), (4, b)], [(None, a), (None, b), (5, a), (None, a), (None, d)],
        [(7, a), (7, a)], [(None, a)], [(1, a), (2, b), (2, a), (1, b)], [(9, None), (9, ""), (9, d), (8, " ")],
    ):
        check_kept(messy.documents(spark, [(i, t, None, None) for i, t in rows]))


def test_query_shape(spark, small):
    out = queries.op7_simhash(spark, small)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert all(len(r["fingerprint"]) == 16 for r in out.collect())
