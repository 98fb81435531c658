"""Toxicity from class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary labelled documents, predict each word from
the one before it. The top order are pairs of words: discounted counts of the class,
backed by discounted counts of the same pairs in all documents, backed by the word
itself. A word is spelt letter by letter, its end included, each from up to ORDER - 1
signs before it back to the word's begin: discounted counts of the class, backed by
those of all documents, backed by one Kneser-Ney distribution of orders LOW to 1 whose
continuation counts are the words (of all documents) that a run of signs occurs in. What
one class has seldom seen is so judged by the same shared counts as in the other, and
the ratio stays near one; no expression is cut off for being rare.

A document is compared by its length-normalised log-likelihoods under both models: over
all of its words, and over the TELLING most telling of them; a logistic curve fitted on
a fold that the counts leave out turns these differences into a score.

Where neither class has seen a sign after its context, or a word after another, the
shared probabilities cancel, so a worker needs only the log ratios of what the labelled
sample holds. The sample, MOST_LABELS documents of a class at most (drawn by the hash of
their ids), bounds what is gathered and broadcast; the curve weighs its rows by how many
of their class they stand for. The words of all documents, whole texts, are counted in a
distributed table, which grows with them.

Counts are of documents: what one document repeats counts once, as does a word among
its most telling ones. Words are runs of letters and marks, lower-cased, by code point; words, pairs and runs
of signs are keyed by 64-bit hashes.

Defined cases: null and empty texts have no evidence and a score from the curve's
value for none; a doc_id with several labels takes their majority (ties: 0); a null
label is no label; without learning rows of both classes every score is 0; very long
texts are read whole; repeated rows are counted and scored as often as they occur; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import common, quality

FOLDS = 5
CALIBRATION = 1
#: A batch is read in parts of so many bytes: a part takes about a hundred times that in arrays of its letters and words.
PART_BYTES = 1 << 20
ORDER = 12
LOW = 4
MOST_LABELS = 2_000
CUT = 0.5
TELLING = (1, 2, 4)
#: So many words without a difference are added to a text's own: the mean over few words would vary more than that over many.
STEADY = 16
#: Words whose ratios a worker keeps.
KEPT = 1_000_000
SIZE = 1 + len(TELLING)
END, START, FIRST_SIGN = 1, 2, 3
#: Of tables of signs: the top order, and the shared orders LOW to 1.
TOP = 0
_POWER = np.cumprod(np.full(512, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@functools.cache
def _is_letter() -> np.ndarray:
    """By code point: whether it is a letter or a mark on one."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def read(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased; of each word its begin, its end and its text."""
    lowered = [t.decode().lower() + "\n" for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
    edge = np.diff(_is_letter()[codes].astype(np.int8), prepend=np.int8(0))
    first = np.flatnonzero(edge == 1)
    return codes, first, np.flatnonzero(edge == -1), np.searchsorted(np.cumsum([len(x) for x in lowered]), first, "right")


def _inside(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of places: all the places, each one's number in its run, and where each run begins among them."""
    begin = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(begin, size)
    return np.repeat(first, size) + at, at, begin


def hashes(codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    if not len(first):
        return np.zeros(0, np.uint64)
    place, at, begin = _inside(first, last - first)
    return _mix(np.add.reduceat(_mix(codes[place].astype(np.uint64)) * _POWER[at % len(_POWER)], begin) ^ (last - first).astype(np.uint64))


def _once(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of the first of each key in each document."""
    return np.unique(_mix(doc.astype(np.uint64) * _B + _mix(key)), return_index=True)[1]


def pairs(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word the hash of the word before it (0: none), and of both together."""
    before = np.r_[np.zeros(min(1, len(words)), np.uint64), words[:-1]]
    before[1:][doc[1:] != doc[:-1]] = 0
    return before, _pair(before, words)


def _pair(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return _mix(before * _A + after)


def spelt(codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The word of each sign that is predicted (letters and ends); by order (TOP, LOW to 1) keys of its context and of both."""
    size = last - first
    place, at, _ = _inside(first, size + 1)
    n = np.repeat(size, size + 1)
    sign = np.where(at < n, codes[np.minimum(place, len(codes) - 1)].astype(np.uint64) + np.uint64(FIRST_SIGN), np.uint64(END))
    context, out = np.zeros(len(sign), np.uint64), {}
    for back in range(1, ORDER):
        if back <= LOW:
            out[back] = (context, _mix(context * _B + sign))
        there = at >= back - 1
        before = np.where(at >= back, np.r_[np.zeros(min(back, len(sign)), np.uint64), sign[:-back]], np.uint64(START))
        context = np.where(there, _mix(context * _A + before), context)
    out[TOP] = (context, _mix(context * _B + sign))
    return np.repeat(np.arange(len(first)), size + 1), out


def looked_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each wanted key its place among the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _taken(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values by key, 0 for keys that are not there."""
    at, there = looked_up(keys, wanted)
    return np.where(there, values[at], 0) if len(keys) else np.zeros(len(wanted))


def discount(once: float, twice: float) -> float:
    return once / (once + 2 * twice) if once else 0.5


def _discount(counts: np.ndarray) -> float:
    return discount(np.count_nonzero(counts == 1), np.count_nonzero(counts == 2))


class Counts:
    """Counts of an event after its context, from rows of (context, event, count), as discounted shares and what is left for backing off."""

    def __init__(self, context: np.ndarray, key: np.ndarray, n: np.ndarray, total: np.ndarray | None = None, kinds: np.ndarray | None = None, cut: float | None = None):
        """context: the place of each key's context, from 0. total, kinds: of each context, where the rows are not all that it has."""
        self.cut = _discount(n) if cut is None else cut
        size = int(context.max()) + 1 if len(context) else 0
        total = np.bincount(context, n, size) if total is None else total
        seen = np.maximum(n - self.cut, 0)
        left = self.cut * (np.bincount(context, n > 0, size) if kinds is None else kinds)
        known = total > 0
        #: Of each row its share, and of each context what it leaves (1 if it was never seen).
        self.share = np.where(known[context], seen / np.maximum(total, 1e-300)[context], 0.0) if size else np.zeros(0)
        self.left = np.where(known, left / np.maximum(total, 1e-300), 1.0)


class Shared:
    """Orders LOW to 1 over the words of all documents. tables: by order the sorted keys, their counts, and their contexts' keys, totals and kinds."""

    def __init__(self, tables: dict[int, tuple], cuts: dict[int, float]):
        self.tables, self.cuts = tables, cuts

    def share(self, orders: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        _, _, _, total, kinds = self.tables[1]
        p = np.full(len(orders[1][1]), 1 / (1 + (kinds[0] if len(kinds) else 0)))
        for order in range(1, LOW + 1):
            keys, n, contexts, total, kinds = self.tables[order]
            context, key = orders[order]
            cut, whole = self.cuts[order], _taken(contexts, total, context)
            mixed = (np.maximum(_taken(keys, n, key) - cut, 0) + cut * _taken(contexts, kinds, context) * p) / np.maximum(whole, 1)
            p = np.where(whole > 0, mixed, p)
        return p


class Model:
    """Sorted keys and log ratios (toxic over ordinary): of signs, of contexts of signs, of pairs of words, of first words of pairs."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.sign, self.context, self.pair, self.lead = tables

    @staticmethod
    def _sorted(keys: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        return keys[order], ratio[order].astype(np.float32)

    def word_ratios(self, codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        if not len(first):
            return np.zeros(0)
        word, orders = spelt(codes, first, last)
        context, key = orders[TOP]
        at, there = looked_up(self.sign[0], key)
        out = np.where(there, self.sign[1][at] if len(self.sign[0]) else 0, _taken(*self.context, context))
        return np.bincount(word, out, len(first))

    def _known_ratios(self, keys: np.ndarray, codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of words with distinct, sorted hashes; what a worker has worked out is kept, up to KEPT words."""
        known, ratio = self.__dict__.setdefault("_kept", (np.zeros(0, np.uint64), np.zeros(0)))
        at, there = looked_up(known, keys)
        out = np.empty(len(keys))
        out[there] = ratio[at[there]]
        new = np.flatnonzero(~there)
        out[new] = self.word_ratios(codes, first[new], last[new])
        if len(new):
            both = np.r_[known, keys[new]] if len(known) < KEPT else keys[new]
            order = np.argsort(both, kind="stable")
            self._kept = both[order], (np.r_[ratio, out[new]] if len(known) < KEPT else out[new])[order]
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_kept"}

    def ratios(self, codes: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """log P(toxic) - log P(ordinary) of each word after the one before it."""
        words = hashes(codes, first, last)
        keys, one, which = np.unique(words, return_index=True, return_inverse=True)
        before, pair = pairs(words, doc)
        lead = _taken(*self.lead, np.r_[keys, np.uint64(0)])
        where = np.r_[len(keys), which[:-1]] if len(which) else which
        where[1:][doc[1:] != doc[:-1]] = len(keys)
        out = self._known_ratios(keys, codes, first[one], last[one])[which] + lead[where]
        at, there = looked_up(self.pair[0], pair)
        return np.where(there, self.pair[1][at], out) if len(self.pair[0]) else out


def evidence(texts: list[bytes], model: Model) -> np.ndarray:
    """For each text: the difference of its log-likelihoods a word, over all its words and over the most telling ones."""
    out = np.zeros((len(texts), SIZE))
    codes, first, last, doc = read(texts)
    if not len(first):
        return out
    ratio = model.ratios(codes, first, last, doc)
    size = np.bincount(doc, minlength=len(texts))
    out[:, 0] = np.bincount(doc, ratio, len(texts)) / (size + STEADY)
    order = np.lexsort((-ratio, doc))
    order = order[np.sort(_once(doc[order], hashes(codes, first, last)[order]))]  # of a word that is repeated, the place that tells most
    size = np.bincount(doc[order], minlength=len(texts))
    rank = np.arange(len(order)) - (np.cumsum(size) - size)[doc[order]]
    for i, most in enumerate(TELLING):
        top = order[rank < most]
        out[:, 1 + i] = np.bincount(doc[top], ratio[top], len(texts)) / most
    return out


class Curve:
    """Logistic regression by Newton steps, on standardised evidence; a row of weight w counts as w rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1.0):
        self.known = len(x) > 0 and 0 < y.sum() < len(y)
        if not self.known:
            return
        own = np.ones(len(x)) if weight is None else weight
        self.mean = np.average(x, axis=0, weights=own)
        self.scale = np.sqrt(np.average((x - self.mean) ** 2, axis=0, weights=own)) + 1e-9
        z = self._design(x)
        self.weight = np.zeros(z.shape[1])
        ridge = penalty * np.eye(z.shape[1])
        ridge[0, 0] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weight, -30, 30)))
            step = np.linalg.solve((z * (own * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (own * (p - y)) + ridge @ self.weight)
            self.weight -= step
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.weight, -700, 700)))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sums of the columns of n."""
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.stack([np.bincount(at, x, len(keys)) for x in np.atleast_2d(n)])


def _word_texts(codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[str]:
    text = codes.tobytes()
    return [text[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(first.tolist(), last.tolist(), strict=True)]


def _counted_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, before, pair, after, o, t: counts of words, and (word null) of pairs, by class."""
    for b in batches:
        kinds, at = b.column("y").to_numpy(zero_copy_only=False), 0
        for texts in common.chunks(b.column("text"), PART_BYTES):
            kind = kinds[at : at + len(texts)]
            at += len(texts)
            codes, first, last, doc = read(texts)
            words = hashes(codes, first, last)
            before, pair = pairs(words, doc)
            for key, is_pair in ((words, False), (pair, True)):
                own = _once(doc, key)
                one = own[np.unique(key[own], return_index=True)[1]]
                n = _summed(key[own], np.stack([kind[doc[own]] == 0, kind[doc[own]] == 1]))[1].astype(np.int64)
                none = pa.nulls(len(one), pa.string())
                text = none if is_pair else pa.array(_word_texts(codes, first[one], last[one]), pa.string())
                longs = [np.where(is_pair, x[one], 0).astype(np.uint64).view(np.int64) for x in (before, pair, words)]
                yield pa.RecordBatch.from_arrays([text, *map(pa.array, longs), pa.array(n[0]), pa.array(n[1])], ["word", "before", "pair", "after", "o", "t"])


class _Tally:
    """Counts of words that a task has met, by sorted hash, with the text of each."""

    MOST = 2_000_000

    def __init__(self):
        self.keys, self.n, self.met = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def add(self, keys: np.ndarray, n: np.ndarray, text) -> None:
        """keys: sorted, distinct; text: gives the texts of some of them."""
        at, there = looked_up(self.keys, keys)
        self.n[at[there]] += n[there]
        new = np.flatnonzero(~there)
        if len(new):
            self.met.append((keys[new], text(new)))
            both = np.r_[self.keys, keys[new]]
            order = np.argsort(both, kind="stable")
            self.keys, self.n = both[order], np.r_[self.n, n[new]][order]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for keys, text in self.met:
            n = self.n[looked_up(self.keys, keys)[0]]
            for i in range(0, len(keys), 50_000):
                part = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(text[part], pa.string()), pa.array(np.zeros(len(keys[part]), np.int64)), pa.array(n[part])], ["word", "pair", "n"])
        self.__init__()


def _counted(held):
    """held: sorted keys of pairs. (word, pair, n): counts of words, and (word null) of those pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, together = _Tally(), np.zeros(len(held.value), np.int64)
        for b in batches:
            for texts in common.chunks(b.column("text"), PART_BYTES):
                codes, first, last, doc = read(texts)
                words = hashes(codes, first, last)
                own = _once(doc, words)
                keys, one, n = np.unique(words[own], return_index=True, return_counts=True)
                one = own[one]
                tally.add(keys, n.astype(np.int64), lambda new: _word_texts(codes, first[one[new]], last[one[new]]))  # noqa: B023
                _, pair = pairs(words, doc)
                at, there = looked_up(held.value, pair)
                here = np.flatnonzero(there)
                together += np.bincount(at[here][_once(doc[here], pair[here])], minlength=len(together))
                if len(tally.keys) > tally.MOST:
                    yield from tally.rows()
        yield from tally.rows()
        met = np.flatnonzero(together)
        for i in range(0, len(met), 50_000):
            part = met[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.string()), pa.array(held.value[part].view(np.int64)), pa.array(together[part])], ["word", "pair", "n"])

    return run


def _joined(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as one array of code points, and their begins and ends."""
    size = np.array([len(w) for w in words], np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.cumsum(size) - size, np.cumsum(size)


def _blocks(n: int, size: int = 20_000) -> Iterator[slice]:
    return (slice(i, min(n, i + size)) for i in range(0, n, size))


def _signs(wanted):
    """wanted: by order the sorted keys of contexts. (part, context, key, n): of the words of all documents, how often a sign
    follows a wanted context, and (context null) how often a sign's count is one or two in the lower orders is told by the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            word, orders = spelt(*_joined(b.column("word").to_pylist()))
            tokens = b.column("n").to_numpy()[word]
            for order, (context, key) in orders.items():
                if order == TOP:  # the lower orders are told whole: an alphabet bounds them, and their discounts need all
                    mine = looked_up(wanted.value, context)[1]
                    context, key = context[mine], key[mine]
                _, one = np.unique(key, return_index=True)
                _, n = _summed(key, tokens[mine] if order == TOP else np.ones(len(key)))
                columns = [np.full(len(one), order, np.int32), context[one].view(np.int64), key[one].view(np.int64), n[0].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["part", "context", "key", "n"])

    return run


def build(words: list[str], n: np.ndarray, top: dict[str, np.ndarray], low: Shared) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, list[np.ndarray]]:
    """words with counts by class n (2, words); top: context, key and count of the signs of all documents' words after the
    contexts of these words. Keys and log ratios of signs and of their contexts; each word's hash, and its log chance by class."""
    parts = []
    for block in _blocks(len(words)):  # the driver holds the distinct runs of signs, and the signs of one block of words
        word, orders = spelt(*_joined(words[block]))
        context, key = orders[TOP]
        own, one, at = np.unique(key, return_index=True, return_inverse=True)
        below = low.share({o: (c[one], k[one]) for o, (c, k) in orders.items()})
        parts.append((own, context[one], below, *(np.bincount(at, n[c][block][word], len(own)) for c in (0, 1))))
    key, context, below, *by_class = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    keys, one, at = np.unique(key, return_index=True, return_inverse=True)
    by_class = [np.bincount(at, x, len(keys)) for x in by_class]
    context, below = context[one], below[one]
    del key, one, at
    contexts, place = np.unique(context, return_inverse=True)
    del context
    # All documents' signs after these contexts: totals and kinds need them all, shares only those of the sample.
    mine, here = looked_up(contexts, top["context"])
    mine, count = mine[here], top["n"][here]
    total, kinds = np.bincount(mine, count, len(contexts)), np.bincount(mine, minlength=len(contexts))
    order = np.argsort(top["key"])
    own = _taken(top["key"][order], top["n"][order], keys)
    shared = Counts(place, keys, own, total, kinds, _discount(count))
    base = shared.share + shared.left[place] * below
    del mine, here, count, order, own, shared, below
    chance, left = [], []
    for x in by_class:
        model = Counts(place, keys, x)
        chance.append(model.share + model.left[place] * base)
        left.append(model.left)
    logs = [np.log(x) for x in chance]
    sign, back = logs[1] - logs[0], np.log(left[1]) - np.log(left[0])
    whole, named = [np.zeros(len(words)) for _ in (0, 1)], np.zeros(len(words), np.uint64)
    for block in _blocks(len(words)):
        codes, first, last = _joined(words[block])
        named[block] = hashes(codes, first, last)
        word, orders = spelt(codes, first, last)
        at = np.searchsorted(keys, orders[TOP][1])
        for c in (0, 1):
            whole[c][block] = np.bincount(word, logs[c][at], len(first))
    return [(keys, sign), (contexts, back)], named, whole


def pair_ratios(both: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """both: before, after, pair, o, t, n (counts by class and in all documents); words: word (hash), n, c0, c1 (chances).

    (pair, ratio) and (before, ratio), logs of toxic over ordinary: a pair's discounted share of what its class has after its
    first word, backed by its share in all documents, backed by the second word's own chance."""
    seen = lambda c, k: F.count_if(F.col(c) == k)
    once = both.agg(*(seen(c, k).alias(f"{c}{k}") for c in "otn" for k in (1, 2))).first()
    cut = {c: discount(once[f"{c}1"], once[f"{c}2"]) for c in "otn"}
    together = F.greatest(F.col("n") - cut["n"], F.lit(0.0))
    sums = [F.sum(c).alias(f"total_{c}") for c in "otn"] + [F.count_if(F.col(c) > 0).alias(f"kinds_{c}") for c in "ot"]
    lead = both.groupBy("before").agg(*sums, F.sum(together).alias("held")).join(words.select(F.col("word").alias("before"), F.col("n").alias("alone")), "before", "left")
    whole = F.greatest("total_n", F.coalesce("alone", F.lit(0)))
    left = lambda c: F.when(F.col(f"total_{c}") > 0, cut[c] * F.col(f"kinds_{c}") / F.col(f"total_{c}")).otherwise(1.0)
    lead = common.stored(lead.select("before", "total_o", "total_t", whole.alias("whole"), (1 - F.col("held") / whole).alias("rest"), left("o").alias("left_o"), left("t").alias("left_t")), "leads")

    def chance(c: str, own: str) -> Column:
        share = F.when(F.col(f"total_{c}") > 0, F.greatest(F.col(c) - cut[c], F.lit(0.0)) / F.col(f"total_{c}")).otherwise(0.0)
        return share + F.col(f"left_{c}") * (together / F.col("whole") + F.col("rest") * F.col(own))

    joined = both.join(lead, "before").join(words.select(F.col("word").alias("after"), "c0", "c1"), "after")
    ratios = joined.select("pair", (F.log(chance("t", "c1")) - F.log(chance("o", "c0"))).cast("float").alias("ratio"))
    return ratios, lead.select("before", (F.log("left_t") - F.log("left_o")).cast("float").alias("ratio"))


def dealt(spark: SparkSession, columns: dict[str, np.ndarray], kinds: str) -> DataFrame:
    """A table of arrays of the driver. Tasks make its rows: those of a local relation are objects of the driver's JVM, made anew at each use."""
    sent = spark.sparkContext.broadcast(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in sent.value.values()], list(sent.value))

    out = common.stored(spark.range(len(next(iter(columns.values())))).mapInArrow(run, kinds), "dealt")
    sent.destroy()
    return out


def labelled_sample(labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """doc_id, y, weight of the learning folds: all of a class, or ``most`` at most, by the hash of their ids.
    A row's weight is the number of its class's rows that it stands for.

    A share of the hashes goes first, so that no task sends more than it must to be sorted."""
    own = common.stored(quality.labelled(labels, "toxic").where(common.fold(F.col("doc_id"), FOLDS) != 0), "own_labels")
    sizes = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)

    def part(y: int) -> DataFrame:
        mine = own.where(F.col("y") == y)
        if sizes.get(y, 0) <= most:
            return mine.withColumn("weight", F.lit(1.0))
        mine = mine.withColumn("weight", F.lit(sizes[y] / most))
        return mine.where(draw < 1.2 * most / sizes[y]).orderBy(draw, "doc_id").limit(most)

    return part(0).unionByName(part(1))


def _unsigned(column) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS):
    """A broadcast of the model (None without labels of both classes), and the curve."""
    spark = docs.sparkSession
    sample = common.stored(labelled_sample(labels, most), "labels")
    thin = docs.select(F.col("doc_id").alias("doc_id"), "text")
    calibrates = common.fold(F.col("doc_id"), FOLDS) == CALIBRATION
    # The sample has at most 2 * most rows of 20 bytes.
    learnt = thin.join(F.broadcast(sample.where(~calibrates).select("doc_id", "y")), "doc_id").select("y", "text")
    counts = learnt.mapInArrow(_counted_sample, "word string, before long, pair long, after long, o long, t long")
    counts = common.stored(counts.groupBy("word", "before", "pair", "after").agg(F.sum("o").alias("o"), F.sum("t").alias("t")), "sample_counts")
    seen = counts.where("word is not null").agg(F.sum("o"), F.sum("t")).first()
    if not (seen[0] and seen[1]):
        return None, Curve(np.zeros((0, SIZE)), np.zeros(0))
    held = spark.sparkContext.broadcast(np.sort(_unsigned(counts.where("word is null").select("pair").toArrow()["pair"])))
    rows = thin.select("text").mapInArrow(_counted(held), "word string, pair long, n long")
    every = common.stored(rows.groupBy("word", "pair").agg(F.sum("n").alias("n")), "all_counts")
    held.destroy()
    words = counts.where("word is not null").select("word", "o", "t").join(every.where("word is not null").select("word", "n"), "word").toArrow()
    texts = words["word"].to_pylist()
    contexts = [np.unique(spelt(*_joined(texts[block]))[1][TOP][0]) for block in _blocks(len(texts))]
    wanted = spark.sparkContext.broadcast(np.unique(np.concatenate(contexts)))
    signs = every.where("word is not null").select("word", "n").mapInArrow(_signs(wanted), "part int, context long, key long, n long")
    signs = signs.groupBy("part", "context", "key").agg(F.sum("n").alias("n")).toArrow()
    wanted.destroy()
    part, context, key, n = signs["part"].to_numpy(), _unsigned(signs["context"]), _unsigned(signs["key"]), signs["n"].to_numpy()
    del contexts, signs
    tables, cuts = {}, {}
    for order in range(1, LOW + 1):
        mine = np.flatnonzero(part == order)
        mine = mine[np.argsort(key[mine])]
        contexts, place = np.unique(context[mine], return_inverse=True)
        tables[order] = (key[mine], n[mine], contexts, np.bincount(place, n[mine]), np.bincount(place))
        cuts[order] = _discount(n[mine])
    top = {"context": context[part == TOP], "key": key[part == TOP], "n": n[part == TOP]}
    del part, context, key, n, mine, place
    tables, named, whole = build(texts, np.stack([words["o"].to_numpy(), words["t"].to_numpy()]), top, Shared(tables, cuts))
    own = {"word": named.view(np.int64), "n": words["n"].to_numpy(), "c0": np.exp(whole[0]), "c1": np.exp(whole[1])}
    del words, texts, top
    both = counts.where("word is null").drop("word").join(every.where("word is null").select("pair", "n"), "pair")
    for found in pair_ratios(both, dealt(spark, own, "word long, n long, c0 double, c1 double")):
        rows = found.toArrow()
        tables.append((_unsigned(rows[0]), rows[1].to_numpy()))
    model = Model([Model._sorted(*t) for t in tables])
    sent = spark.sparkContext.broadcast(model)
    found = evidence_udf(sent)
    marked = thin.join(F.broadcast(sample.where(calibrates)), "doc_id").select("y", "weight", found("text").alias("e")).toArrow()
    x = marked["e"].combine_chunks().flatten().to_numpy().reshape(-1, SIZE)
    return sent, Curve(x, marked["y"].to_numpy(), marked["weight"].to_numpy())


def evidence_udf(sent):
    @arrow_udf("array<double>")
    def found(text: pa.Array) -> pa.Array:
        rows = [evidence(part, sent.value) for part in common.chunks(text, PART_BYTES)]
        flat = np.concatenate(rows) if rows else np.zeros((0, SIZE))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, SIZE, dtype=np.int32)), pa.array(flat.ravel()))

    return found


def scores(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    sent, curve = fit(docs, labels, most)

    @arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        rows = [np.zeros(len(part)) if sent is None else curve.score(evidence(part, sent.value)) for part in common.chunks(text, PART_BYTES)]
        return pa.array(np.concatenate(rows) if rows else np.zeros(0))

    held = common.fold(F.col("doc_id"), FOLDS) == 0
    return docs.select(F.col("doc_id").alias("doc_id"), held.alias("held_out"), score(F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
