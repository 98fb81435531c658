"""The pipeline against its stages done one by one in plain Python (the classifier's scores and the token ids taken as given)."""

from collections import Counter, defaultdict

import corpus_pipeline
from seqlake.llm import packing, quality, queries
from seqlake.llm.common import table

from .test_decontaminate import brute as brute_hits
from .test_dedup import FOLD, brute_components, brute_fingerprint


def test_brute_force(spark, small):
    docs = {r["doc_id"]: r for r in table(spark, small, "documents").collect()}
    scores = {r["doc_id"]: r["score"] for r in queries.op4_quality(spark, small).collect()}
    kept = {i for i in docs if scores[i] >= quality.CUT}
    last = {}
    for i in sorted(kept):
        last[docs[i]["text"].translate(FOLD)] = i
    kept = set(last.values())
    fp = {i: brute_fingerprint(docs[i]["text"]) for i in kept}
    roots = brute_components(list(fp.items()))
    kept = {i for i in kept if roots[fp[i]] == i}
    items = [(str(r["item_id"]), r["text"]) for r in table(spark, small, "benchmark").collect()]
    for i in list(kept):
        n, hit, _ = brute_hits(docs[i]["text"], items)
        if hit > 0 and 20 * hit >= n:
            kept.discard(i)
    e = packing.encoder(queries.tokenizer())
    sizes = {i: len(e.encode(docs[i]["text"])) + 1 for i in kept}
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, small).collect():
        got[r["doc_id"]] += r["length"]
        assert r["doc_tokens"] == sizes[r["doc_id"]]
    assert got == sizes


def test_stages_keep_the_columns(spark, small):
    docs = table(spark, small, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        assert Counter(map(tuple, out.collect())) <= Counter(map(tuple, docs.collect())), name
        assert stage(spark, docs.where("false"), small).count() == 0
    assert corpus_pipeline.packed(spark, docs.where("false"), small).count() == 0


def test_no_labels_keep_everything(spark, small):
    docs = table(spark, small, "documents")
    assert quality.keep_good(docs, table(spark, small, "labels").where("false")).count() == docs.count()
