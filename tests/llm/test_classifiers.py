"""Quality, toxicity, language: held-out accuracy, hostile rows, and that the models' parts are what they claim."""

import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from seqlake.llm import common, langid, quality, toxicity

from . import messy

GOOD = "the quiet river bends past old stone and every evening lamps are lit along it".split()


def prose(rng, n):
    return " ".join(rng.choice(GOOD) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(900):
        text, good, toxic = prose(rng, int(rng.integers(20, 200))), 1, 0
        if i % 4 == 0:
            text, good = " | ".join(text.upper().split()[:60]) + " !!! $$$", 0
        if i % 3 == 0:
            tokens = text.split()
            for _ in range(3):
                tokens.insert(int(rng.integers(0, len(tokens))), "grumblo" + rng.choice(["t", "rt", "xat"]))
            text, toxic = " ".join(tokens), 1
        docs.append((i, text, "en", "a"))
        labels.append((i, good, toxic, None))
    labels += [(None, 1, 1, None), (5, None, None, None), (6, 1, 0, "x"), (6, 1, 0, "x"), (10**9, 0, 1, None)]
    return messy.documents(spark, docs), messy.labels(spark, labels), {i: (g, t) for i, g, t, _ in labels[:900]}


@pytest.mark.parametrize("module,at,cut", [(quality, 0, 0.3), (toxicity, 1, 0.5)])
def test_held_out(corpus, module, at, cut):
    docs, labels, truth = corpus
    out = module.scores(docs, labels).collect()
    assert len(out) == 900
    assert all(r["held_out"] == (remainder(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for r in out)
    held = [r for r in out if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]][at] for r in held]) > 0.97


@pytest.mark.parametrize("module", [quality, toxicity])
def test_hostile_rows(spark, corpus, module):
    _, labels, _ = corpus
    docs = messy.documents(spark)
    out = module.scores(docs, labels).collect()
    assert len(out) == docs.count() and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in out)
    again = {}
    for r in docs.join(module.scores(docs, labels).withColumnRenamed("doc_id", "d"), docs["doc_id"].eqNullSafe(common.F.col("d"))).where("doc_id = 0").collect():
        again.setdefault(r["doc_id"], set()).add(round(r["score"], 12))
    assert all(len(s) == 1 for s in again.values())
    assert module.scores(messy.nothing(spark), labels).count() == 0
    blank = module.scores(docs, labels.where("false")).collect()
    assert {r["score"] for r in blank} == ({0.5} if module is quality else {0.0})


def test_keep_good(spark, corpus):
    docs, labels, truth = corpus
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert np.mean([(i in ids) == bool(g) for i, (g, _) in truth.items()]) > 0.97
    assert quality.keep_good(messy.documents(spark), labels).count() > 0
    assert quality.keep_good(messy.nothing(spark), labels).count() == 0


def test_discriminant_is_the_gaussian_posterior():
    rng = np.random.default_rng(0)
    x = [rng.normal(c, 1 + c, (4000, quality.SIZE)) for c in (0, 1)]
    sums = np.array([(lambda z: z.T @ z)(np.column_stack([np.ones(len(v)), v])) for v in x])
    model = quality.Discriminant(sums)
    point = rng.normal(0.5, 1, (50, quality.SIZE))
    logs = []
    for v in x:
        own, pooled = np.cov(v.T, bias=True), (np.cov(x[0].T, bias=True) + np.cov(x[1].T, bias=True)) / 2
        cov = 0.95 * (0.95 * own + 0.05 * pooled) + 0.05 * np.diag(np.diag(pooled) + 1e-6)
        d = point - v.mean(axis=0)
        logs.append(-0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)))
    assert np.allclose(model.score(point), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-6)


def brute_statistics(text):
    """One number after another, from the text's code points and lines."""
    raw = text.encode()
    kind = Counter()
    for c in text:
        b = c.encode()[0]
        kind["letter" if "a" <= c <= "z" or b >= 0xC0 else "upper" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9" else "space" if c in " \t" else "line" if c in "\n\r" else "mark" if c in ".,;:'\"()-" else "call" if c in "!?" else "bar" if c == "|" else "other"] += 1
    words, lines, n = raw.split(), raw.split(b"\n"), len(text)
    letters, rate = kind["letter"] + kind["upper"], lambda x, n: np.log((x + 0.5) / (n + 10))
    return [
        np.log1p(len(words)), rate(kind["upper"], letters), *(rate(kind[k], n) for k in ("digit", "line", "mark", "call", "bar", "other", "space")),
        np.log((letters + 5) / (len(words) + 1)), np.log((len(set(words)) + 1) / (len(words) + 1)) + 0.2 * np.log1p(len(words)),
        np.log((len(set(lines)) + 1) / (len(lines) + 1)), np.log((len(words) + 1) / (len(lines) + 1)), rate(sum(a == b for a, b in zip(words, words[1:])), len(words)),
    ]


def test_statistics_are_those_of_plain_loops():
    texts = [t or "" for t in messy.texts()] + ["a a b!? | x\ty\r\n\n42 -- «é»", "|||", "The the THE the the"]
    got = quality.statistics([t.encode() for t in texts])
    assert np.allclose(got, [brute_statistics(t) for t in texts])


@pytest.mark.parametrize("n", [2, 5, 30])
def test_few_labels_are_enough(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, prose(rng, 60) if i % 2 else " | ".join(prose(rng, 60).upper().split()) + " !!! $$$", "en", "a") for i in range(400)]
    learnt = [i for i in range(400) if remainder(i, 5)]
    labels = [(i, i % 2, 0, None) for y in (0, 1) for i in [i for i in learnt if i % 2 == y][:n]]
    out = quality.scores(messy.documents(spark, rows), messy.labels(spark, labels)).collect()
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in out]) > 0.95
    alone = quality.scores(messy.documents(spark, rows), messy.labels(spark, [x for x in labels if x[1]] + labels[:1])).collect()
    assert {r["score"] for r in alone} == {0.5}


def test_folds_are_those_of_crc32(spark):
    rows = spark.range(500).select("id", common.fold(common.F.col("id"), 5).alias("f")).collect()
    assert all(r["f"] == remainder(r["id"], 5) for r in rows)


def brute_words(text):
    """Runs of letters and marks, lower-cased."""
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def brute_discount(counts):
    once, twice = sum(n == 1 for n in counts), sum(n == 2 for n in counts)
    return once / (once + 2 * twice) if once else 0.5


class Brute:
    """The models by dictionaries of strings: learn (text, class), and all texts."""

    def __init__(self, learnt, every):
        self.n = [Counter(), Counter()]
        self.pairs = [Counter(), Counter()]
        for text, y in learnt:
            words = brute_words(text)
            self.n[y].update(set(words))
            self.pairs[y].update(set(zip(["", *words], words)))
        known, held = set(self.n[0]) | set(self.n[1]), set(self.pairs[0]) | set(self.pairs[1])
        words, pairs = Counter(), Counter()
        for text in every:
            own = brute_words(text)
            words.update(set(own))
            pairs.update(set(zip(["", *own], own)) & held)
        self.words, self.all_pairs = words, pairs
        # Signs after what precedes them, from a word's begin ^ to its end $.
        self.top = [self.signs({w: n for w, n in c.items()}, toxicity.ORDER) for c in self.n]
        self.every = self.signs(words, toxicity.ORDER)
        contexts = {h for w in known for h, _ in self.spelt(w, toxicity.ORDER)}
        self.cut = [brute_discount(n.values()) for n in self.top]
        self.cut_every = brute_discount([n for (h, x), n in self.every.items() if h in contexts])
        self.low = {k: self.signs(dict.fromkeys(words, 1), k) for k in range(1, toxicity.LOW + 1)}
        self.cut_low = {k: brute_discount(n.values()) for k, n in self.low.items()}
        self.followers = {}
        for name, table in [(("c", c), self.top[c]) for c in (0, 1)] + [("all", self.every)] + list(self.low.items()):
            of = self.followers[name] = {}
            for (h, _), n in table.items():
                total, kinds = of.get(h, (0, 0))
                of[h] = (total + n, kinds + 1)
        self.cut_pairs = [brute_discount(p.values()) for p in self.pairs]
        self.cut_all_pairs = brute_discount([pairs[p] for p in held])
        self.held = held

    @staticmethod
    def spelt(word, order):
        signs = "^" + word + "$"
        return [(signs[max(0, i - order + 1) : i], signs[i]) for i in range(1, len(signs))]

    def signs(self, words, order):
        out = Counter()
        for w, n in words.items():
            for e in self.spelt(w, order):
                out[e] += n
        return out

    def shared_low(self, before, x, order):
        if not order:
            return 1 / (1 + self.followers[1][""][1])
        h = before[len(before) - order + 1 :] if order > 1 and len(before) >= order - 1 else before if order > 1 else ""
        p = self.shared_low(before, x, order - 1)
        total, kinds = self.followers[order].get(h, (0, 0))
        return (max(self.low[order][h, x] - self.cut_low[order], 0) + self.cut_low[order] * kinds * p) / total if total else p

    def sign(self, c, h, x):
        p = self.shared_low(h, x, toxicity.LOW)
        for table, name, cut in ((self.every, "all", self.cut_every), (self.top[c], ("c", c), self.cut[c])):
            total, kinds = self.followers[name].get(h, (0, 0))
            p = (max(table[h, x] - cut, 0) + cut * kinds * p) / total if total else p
        return p

    def word(self, c, word):
        return np.prod([self.sign(c, h, x) for h, x in self.spelt(word, toxicity.ORDER)])

    def pair(self, c, u, w):
        followers = [p for p in self.held if p[0] == u]
        if not followers:
            return self.word(c, w)
        of_all = max(sum(self.all_pairs[p] for p in followers), self.words[u])
        share = {p: max(self.all_pairs[p] - self.cut_all_pairs, 0) / of_all for p in followers}
        p = share.get((u, w), 0) + (1 - sum(share.values())) * self.word(c, w)
        own = [self.pairs[c][f] for f in followers if self.pairs[c][f]]
        return (max(self.pairs[c][u, w] - self.cut_pairs[c], 0) + self.cut_pairs[c] * len(own) * p) / sum(own) if own else p

    def evidence(self, text):
        words = brute_words(text)
        ratio = [np.log(self.pair(1, u, w)) - np.log(self.pair(0, u, w)) for u, w in zip(["", *words], words)]
        best = {}
        for w, r in zip(words, ratio):
            best[w] = max(r, best.get(w, r))
        top = sorted(best.values(), reverse=True)
        return [sum(ratio) / (len(words) + toxicity.STEADY), *(sum(top[:k]) / k for k in toxicity.TELLING)]


def test_the_models_are_kneser_neys(spark):
    """Evidence of every text against dictionaries of strings: letters beyond Latin, long words, phrases, unseen words."""
    rng = np.random.default_rng(6)
    phrase = ["go", "back"]
    def text(toxic):
        words = [str(rng.choice(["river", "stone", "élan", "река", "камень", "石頭", "lamp", "go", "back", "x" * 30, "größe"])) for _ in range(int(rng.integers(3, 12)))]
        return " ".join(words + (phrase if toxic else phrase[::-1])) + ("!" if toxic else ". 42")
    rows = [(i, text(i % 3 == 0), "en", "a") for i in range(60)] + [(100, None, None, None), (101, "", None, None), (102, "neu und новое 石 x", None, None)]
    docs, labels = messy.documents(spark, rows), messy.labels(spark, [(i, 1, int(i % 3 == 0), None) for i in range(60)])
    sent, curve = toxicity.fit(docs, labels)
    assert curve.known
    learnt = [(t, int(i % 3 == 0)) for i, t, _, _ in rows[:60] if remainder(i, 5) > 1]
    brute = Brute(learnt, [t for _, t, _, _ in rows])
    got = toxicity.evidence([(t or "").encode() for _, t, _, _ in rows], sent.value)
    want = np.array([brute.evidence(t) for _, t, _, _ in rows])
    assert np.allclose(got, want, atol=1e-4)
    # A phrase of words that both classes use, in another order.
    assert brute.pair(1, "go", "back") > 2 * brute.pair(0, "go", "back")


def test_chances_of_words_are_no_objects_of_the_driver(spark, corpus, monkeypatch):
    """Tasks make the table of all words of the sample; it is no local relation."""
    docs, labels, _ = corpus
    docs, labels = (common.stored(x, "test") for x in (docs, labels))
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: pytest.fail("rows in the driver"))
    assert toxicity.fit(docs, labels)[1].known
    columns = {"word": np.arange(-5, 20_000), "c0": np.linspace(0, 1, 20_005)}
    rows = toxicity.dealt(spark, columns, "word long, c0 double").collect()
    assert sorted(map(tuple, rows)) == list(zip(columns["word"].tolist(), columns["c0"].tolist()))
    assert toxicity.dealt(spark, {"word": np.zeros(0, np.int64)}, "word long").count() == 0


def test_distributions_sum_to_one():
    rng = np.random.default_rng(4)
    texts = [(prose(rng, 30), i % 2) for i in range(12)]
    brute = Brute(texts, [t for t, _ in texts])
    signs = {x for _, x in brute.every} | {"?"}  # one sign stands for all that were never seen
    for c in (0, 1):
        for h, _ in list(brute.top[c])[:40]:
            assert abs(sum(brute.sign(c, h, x) for x in signs) - 1) < 1e-9


def test_label_sample_is_bounded(spark):
    rows = [(i, 1, int(i % 4 == 0), None) for i in range(4000)]
    for most, want in ((100, {0: 100, 1: 100}), (1000, {0: 1000, 1: sum(i % 4 == 0 and remainder(i, 5) != 0 for i in range(4000))})):
        out = toxicity.labelled_sample(messy.labels(spark, rows), most).collect()
        assert {y: sum(r["y"] == y for r in out) for y in (0, 1)} == want
        assert all(remainder(r["doc_id"], 5) != 0 and r["y"] == int(r["doc_id"] % 4 == 0) for r in out)


def test_a_bounded_sample_keeps_the_base_rate(spark):
    """A tenth is toxic and words say little of it: scores stay near a tenth when the bound makes the classes even."""
    rng = np.random.default_rng(8)
    rows = [(i, prose(rng, 40), "en", "a") for i in range(2400)]
    docs, labels = messy.documents(spark, rows), messy.labels(spark, [(i, 1, int(rng.random() < 0.1), None) for i in range(2400)])
    means = [np.mean([r["score"] for r in toxicity.scores(docs, labels, most).where("held_out").collect()]) for most in (10_000, 150)]
    assert abs(means[0] - 0.1) < 0.06 and abs(means[1] - means[0]) < 0.06


def test_a_weight_counts_as_so_many_rows():
    rng = np.random.default_rng(3)
    x, y = rng.normal(0, 1, (300, 3)), rng.integers(0, 2, 300)
    weight = np.where(y == 1, 1, 4)
    long, short = toxicity.Curve(np.repeat(x, weight, axis=0), np.repeat(y, weight)), toxicity.Curve(x, y, weight)
    assert np.allclose(long.score(x), short.score(x), atol=1e-6)


def test_phrases_are_greedy_longest_matches():
    rng = np.random.default_rng(9)
    for _ in range(40):
        learnt = rng.integers(1, 4, 60)
        table = langid.automaton(learnt)
        text = rng.integers(1, 5, int(rng.integers(1, 50)))
        known = bytes(learnt.tolist())
        want, at = 0, 0
        while at < len(text):
            n = 1
            while at + n < len(text) and bytes(text[at : at + n + 1].tolist()) in known and bytes(text[at : at + n].tolist()) in known:
                n += 1
            want, at = want + 1, at + n
        grid = text[:, None].astype(np.uint8)
        got = langid.phrases(table, grid, np.ones(len(text), int), np.array([-1]))[0]
        assert got == want
        # In lanes that go on from one another, the longest first.
        size = int(rng.integers(1, 9))
        parts = [text[i : i + size] for i in range(0, len(text), size)]
        lanes = np.zeros((size, len(parts)), np.uint8)
        for i, p in enumerate(parts):
            lanes[: len(p), i] = p
        live = np.array([sum(len(p) > step for p in parts) for step in range(size)])
        assert langid.phrases(table, lanes, live, np.arange(len(parts)) - 1).sum() == want


def test_long_texts_are_parsed_unbroken():
    rng = np.random.default_rng(2)
    text = lambda letters, n: "".join(rng.choice(list(letters), n))
    r = langid.Recogniser({"a": text("abcde ", 3000), "b": text("cdefg ", 3000)})
    texts = [text("abcdefg ", n).encode() for n in (5000, 10, 3, 2048, 1024, 1025, 9000)] + [b"", b"??"]
    def brute(language, raw):
        signs = r.alphabet.signs([raw])[0]
        state, n = 0, 0
        for c in signs.tolist():
            to = r.tables[language][state, c]
            n += state == 0 or to < 0
            state = to if to >= 0 else max(0, r.tables[language][0, c])
        return n / max(1, len(signs))
    langs, scores = r.predict(texts)
    for raw, lang, score in zip(texts, langs, scores):
        rate = [brute(i, raw) for i in (0, 1)]
        if r.alphabet.signs([raw])[1][0]:
            assert lang == "ab"[int(rate[1] < rate[0])]
            assert np.isclose(score, 1 / sum(np.exp(-langid.SHARPNESS * (x - min(rate))) for x in rate))
        else:
            assert (lang, score) == ("und", 0)


def test_languages(spark, small):
    docs = common.table(spark, small, "documents")
    out = {r["doc_id"]: r for r in langid.predictions(docs).collect()}
    rows = docs.collect()
    assert all(out[r["doc_id"]]["held_out"] == (remainder(r["doc_id"], 3) == 1) for r in rows)
    assert np.mean([out[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows if out[r["doc_id"]]["held_out"]]) > 0.95


def test_few_documents_are_learnt_whole(spark):
    """Five documents of 10,000 letters give all of them; of many long ones, begin, middle and end are read."""
    few = [i for i in range(100) if remainder(i, 3) != 1][:5]
    rows = [(i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(2500)), "xx", "a") for i in few]
    rows += [(1000 + i, "a" * 4000 + "b" * 4000 + "c" * 4000, "yy", "a") for i in range(600)]
    learnt = langid.samples(messy.documents(spark, rows))
    assert learnt["xx"].split() == [w for _, t, _, _ in rows[:5] for w in t.split()]
    n = Counter(learnt["yy"])
    assert 40_000 < len(learnt["yy"]) <= langid.LETTERS and min(n[c] for c in "abc") > 0.25 * len(learnt["yy"])


def test_repeated_ids_do_not_fill_the_driver(spark, monkeypatch):
    rows = [(None if i % 2 else 7_000_000, f"text {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", "en", "a") for i in range(3000)] + [(11, "again", "fr", "a")] * 2000
    assert remainder("", 3) != 1 and remainder(11, 3) != 1
    docs, sizes = messy.documents(spark, rows), []
    kind, plain = type(docs), type(docs).collect
    monkeypatch.setattr(kind, "collect", lambda self: (sizes.append(len(x := plain(self))), x)[1])
    learnt = langid.samples(docs)
    assert max(sizes) < 3 * langid.SAMPLE_DOCS
    assert len(set(learnt["en"].split())) == langid.SAMPLE_DOCS + 1 and learnt["fr"] == "again "


def test_keys_of_learning_rows_are_not_stored(spark, monkeypatch):
    rows = [(i, f"some words {chr(97 + i % 26)}", "en" if i % 3 else "fr", "a") for i in range(900)]
    rows += rows[:300]
    monkeypatch.setattr(langid.common, "stored", lambda *a: pytest.fail("a file of each shuffle partition"))
    learnt = langid.samples(messy.documents(spark, rows), 50)
    assert {x: len(t.split()) for x, t in learnt.items()} == {"en": 150, "fr": 150}


def test_languages_hostile(spark):
    docs = messy.documents(spark)
    out = langid.predictions(docs).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out:
        if r["doc_id"] not in (None, 3):
            letters = any(c.isalpha() for c in texts[r["doc_id"]] or "")
            assert (r["lang_pred"] == "und") == (not letters)
    assert langid.predictions(messy.nothing(spark)).count() == 0
    unlearnt = langid.predictions(docs.withColumn("lang", common.F.lit(None).cast("string"))).collect()
    assert Counter(r["lang_pred"] for r in unlearnt) == {"und": docs.count()}
