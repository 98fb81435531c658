import random
import re

from seqlake.llm import decontaminate, queries
from seqlake.llm.common import table

from . import messy

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        i = words(t)
        for a in range(max(1, len(i) - 12) if i else 0):
            window = i[a : a + 13]
            for b in range(len(w) - len(window) + 1):
                if w[b : b + len(window)] == window:
                    hit.update(range(b, b + len(window)))
                    found.add(item)
    return len(w), len(hit), found


def test_scan_is_brute_force():
    rng = random.Random(2)
    vocabulary = "a b ab abc é the of river x1 QQ".split()
    for round_ in range(60):
        items = [(str(i), rng.choice(["", " - ", None]) if rng.random() < 0.1 else " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 12, 13, 14, 30])))) for i in range(rng.randint(0, 8))]
        texts = []
        for _ in range(rng.randint(1, 8)):
            parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))]
            if items and rng.random() < 0.6:
                parts.insert(rng.randint(0, 1), (rng.choice(items)[1] or "").upper().replace(" ", rng.choice([" ", ", ", "\n\n"])))
            texts.append(" ".join(parts))
        got = decontaminate.Searcher(items).scan([t.encode() for t in texts])
        assert got == [brute(t, items) for t in texts], round_


def test_over_lanes():
    """Occurrences at every place relative to the edges of lanes, in one long text and many short ones."""
    rng = random.Random(3)
    item = " ".join(f"w{i}" for i in range(20))
    filler = [f"f{rng.randint(0, 999)}" for _ in range(8000)]
    for at in range(0, 8000, 397):
        filler.insert(at, item)
    text = " ".join(filler)
    s = decontaminate.Searcher([("1", item)])
    assert s.scan([text.encode()]) == [(len(words(text)), 21 * 20, {"1"})]
    assert s.scan([item.encode(), b"", item.encode()]) == [(20, 20, {"1"}), (0, 0, set()), (20, 20, {"1"})]


def test_messy(spark):
    docs = messy.documents(spark)
    long = messy.texts()[-8]
    items = [(1, long[:900]), (2, "river stone"), (2, "élan"), (None, "x"), (3, None), (4, "!!!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {(r["doc_id"], r["n_words"], r["n_hit"], r["items_sha256"], r["contaminated"]) for r in decontaminate.report(docs, bench).collect()}
    want = set()
    named = [("" if i is None else str(i), t) for i, t in items]
    for r in docs.collect():
        n, hit, found = brute(r["text"], named) if len(r["text"] or "") < 60_000 else decontaminate.Searcher(named).scan([r["text"].encode()])[0]
        want.add((r["doc_id"], n, hit, decontaminate.sha_of(list(found)), hit > 0 and 20 * hit >= n))
    assert out == want
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not r["contaminated"] for r in decontaminate.report(docs, bench).collect())
    empty = bench.where("false")
    assert decontaminate.drop_contaminated(docs, empty).count() == docs.count()
    assert decontaminate.report(messy.nothing(spark), bench).count() == 0


def test_large_benchmarks_are_searched_in_parts(spark):
    """The same results as in one search, also where windows of several parts meet in a document."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(200)]
    items = [(i, " ".join(passage[6 * i : 6 * i + 20])) for i in range(30)] + [(40, "short one"), (41, None), (42, "short one"), (None, passage[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [" ".join(passage), " ".join(passage[50:90] + ["x"] * 60), "nothing of it", None, "a short one here", " ".join(rng.choice(vocabulary) for _ in range(300))]
    docs = messy.documents(spark, [(i % 5, t, None, None) for i, t in enumerate(texts)])
    assert len(decontaminate.parts(bench)) == 1
    given = decontaminate.parts(bench, 600)
    assert len(given) > 3 and sum(p.count() for p in given) == len(items)
    assert all(sum(len(r["text"] or "") for r in p.collect()) <= 600 for p in given)
    rows = lambda df: sorted(str((*r[:-1], sorted(r["items"]))) for r in df.collect())
    assert rows(decontaminate.report(docs, bench, 600)) == rows(decontaminate.report(docs, bench))
    kept = decontaminate.drop_contaminated(docs, bench, 600)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, decontaminate.drop_contaminated(docs, bench).collect()))


def test_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name in ("op8_decontamination", "op10_exact_dedup", "op1_chat_formatting"):
        got = queries.QUERIES[name](spark, small)
        want = con.execute(queries.SQL[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns)
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(key, want.fetchall())) == sorted(key(r) for r in got.select(*columns).collect()), name


def test_planted_passages_are_found(spark, small):
    bench = table(spark, small, "benchmark")
    rows = [(int(r["item_id"]), "Some words before. " + r["text"].translate(str.maketrans("abc", "ABC")) + " and after.", None, None) for r in bench.collect()]
    assert all(r["contaminated"] for r in decontaminate.report(messy.documents(spark, rows), bench).collect())
