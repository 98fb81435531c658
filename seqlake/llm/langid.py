"""Language identification by cross-parsing with suffix automata.

A suffix automaton of a language's text recognises every substring of it. Parsing a
document with it takes, again and again, the longest phrase that the automaton
knows; the language whose text needs the fewest phrases for each letter wins. The
automata's transitions are integer tables, and a batch of documents is parsed in
lanes of ``LANE`` letters that step together, so whole texts are read at the cost of
a few vector operations a letter and language. Where a lane ends the phrase goes on: the
next lane is parsed again from the state that this one ends in, until both parses begin
a phrase at the same letter, from where on they are one. The phrases are those of an
unbroken parse.

Each language learns from a sample of ``SAMPLE_DOCS`` documents, drawn by the hash of
their ids and texts from the learning folds (rows alike in both are one), of which the automaton reads ``EACH``
letters each and ``LETTERS`` in all: the bound on what is gathered and broadcast.
Many short pieces stand for a language better than a few long ones, in which a
passage in another language would weigh much; they come from all over a text. A
language with fewer documents gives them all, and more letters of each, up to
``LETTERS`` in all. Letters are lower-cased and folded to an alphabet of the
``SIGNS`` - 2 most frequent of the sample and one for all others; whatever is no
letter is a space.

Defined cases: null texts and texts without letters are ``und`` with score 0; so is
every text if nothing was learnt; very long texts are read whole; ties go to the language
that sorts first; repeated rows are predicted alike; other columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import common

FOLDS, HELD = 3, 1
SAMPLE_DOCS = 200
EACH = 300
PIECE = 100
LETTERS = 60_000
SIGNS = 64
LANE = 1024
SHARPNESS = 60.0
SPACE, OTHER = 0, 1


def letters(text: str) -> str:
    """Lower-cased letters, everything else as single spaces."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def spread(text: str, most: int) -> str:
    """``most`` letters at most: all, or pieces of about ``PIECE`` at even distances from the text's begin to its end."""
    own = letters(text)
    if len(own) <= most:
        return own
    n = max(1, most // PIECE)
    size = most // n - 1
    return " ".join(own[(len(own) - size) * i // max(1, n - 1) :][:size] for i in range(n))


class Alphabet:
    def __init__(self, sample: str):
        codes, n = np.unique(np.frombuffer(sample.encode("utf-32-le"), np.uint32), return_counts=True)
        order = np.lexsort((codes, -n))
        kept = [c for c in codes[order].tolist() if c != 32][: SIGNS - 2]
        self.sign = np.full(0x110000, 255, np.uint8)
        for i, c in enumerate(kept):
            self.sign[c] = self.sign[ord(chr(c).upper()) if len(chr(c).upper()) == 1 else c] = 2 + i

    def signs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Signs of all letters, words apart by one space, and the number of signs of each text."""
        decoded = [t.decode() for t in texts]
        ends = np.cumsum([len(t) for t in decoded], dtype=np.int64)
        codes = np.frombuffer("".join(decoded).encode("utf-32-le"), np.uint32)
        out = self.sign[codes]
        if (out == 255).any():
            for c in np.unique(codes[out == 255]).tolist():
                self.sign[c] = OTHER if chr(c).isalpha() else SPACE
            out = self.sign[codes]
        after = np.r_[False, out[:-1] != SPACE]
        after[ends[:-1][ends[:-1] < len(out)]] = False
        total = np.r_[0, np.cumsum((out != SPACE) | after[: len(out)])]
        return out[(out != SPACE) | after[: len(out)]], np.diff(np.r_[0, total[ends]])


def automaton(signs: np.ndarray) -> np.ndarray:
    """Transitions (state, sign) -> state of the suffix automaton, -1 where there is none; the start is state 0."""
    go: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in signs.tolist():
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p != -1:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    table = np.full((len(go), SIGNS), -1, np.int32)
    for state, moves in enumerate(go):
        for c, to in moves.items():
            table[state, c] = to
    return table


def _step(table: np.ndarray, flat: np.ndarray, state: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next states, and where a phrase begins: after a state that is the start, or where the open phrase can't go on.

    A sign that the language has nowhere is a phrase of its own."""
    to = flat[state * SIGNS + sign]
    stuck = to < 0
    return np.where(stuck, np.maximum(table[0, sign], 0), to), stuck | (state == 0)


def phrases(table: np.ndarray, grid: np.ndarray, live: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Longest-match phrases that begin in each lane. grid: (step, lane) signs; live: lanes still running at each step, the
    longest first; follows: the lane that a lane goes on from, or -1."""
    flat = table.ravel()
    lanes = grid.shape[1]
    begins = np.zeros(grid.shape, bool)
    state = np.zeros(lanes, np.int64)
    for step, n in enumerate(live.tolist()):
        state[:n], begins[step, :n] = _step(table, flat, state[:n], grid[step, :n])
    alone, ended, length = begins.sum(axis=0), state.copy(), _lengths(live, lanes)
    count, leads = alone.copy(), np.full(lanes, -1)
    leads[follows[follows >= 0]] = np.flatnonzero(follows >= 0)
    anew = np.flatnonzero(follows >= 0)
    while len(anew):
        at, now, extra, step, changed = anew, state[follows[anew]], np.zeros(len(anew), np.int64), 0, []
        while len(at):
            now, begun = _step(table, flat, now, grid[step, at])
            known = begins[step, at]
            extra = extra + begun - known
            met, step = begun & known, step + 1
            done = met | (length[at] == step)
            if done.any():
                lane, end = at[done], np.where(met, ended[at], now)[done]
                count[lane] = alone[lane] + extra[done]
                changed.append(leads[lane[end != state[lane]]])  # what follows them goes on from elsewhere than was thought
                state[lane] = end
            at, now, extra = at[~done], now[~done], extra[~done]
        anew = np.concatenate(changed)
        anew = anew[anew >= 0]
    return count


def _lengths(live: np.ndarray, lanes: int) -> np.ndarray:
    """Of each lane how many steps it runs."""
    return len(live) - np.searchsorted(live[::-1], np.arange(lanes), "right")


class Recogniser:
    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.alphabet = Alphabet("".join(samples.values()))
        self.tables = [automaton(self.alphabet.signs([samples[x].encode()])[0]) for x in self.langs]

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The language and its score for each text."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        signs, sizes = self.alphabet.signs(texts)
        starts = np.cumsum(sizes) - sizes
        lanes = -(-sizes // LANE)
        doc = np.repeat(np.arange(len(texts)), lanes)
        begin = starts[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        length = np.minimum(LANE, (starts + sizes)[doc] - begin)
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        follows = np.where(np.r_[-1, doc[:-1]] == doc, np.r_[-1, place[:-1]], -1)[order] if len(doc) else doc
        doc, begin, length = doc[order], begin[order], length[order]
        steps = np.arange(int(length[0]) if len(length) else 0)
        live = len(length) - np.searchsorted(length[::-1], steps, "right")
        padded = np.r_[signs, np.zeros(LANE, np.uint8)]
        grid = padded[steps[:, None] + begin[None, :]] if len(length) else np.zeros((0, 0), np.uint8)
        cost = np.stack([np.bincount(doc, phrases(t, grid, live, follows), len(texts)) for t in self.tables], axis=1)
        rate = cost / np.maximum(1, sizes)[:, None]
        best = rate.argmin(axis=1)
        weight = np.exp(-SHARPNESS * (rate - rate.min(axis=1, keepdims=True)))
        score = 1 / weight.sum(axis=1)
        lettered = sizes > 0
        return [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], np.where(lettered, score, 0.0)


def samples(docs: DataFrame, most: int = SAMPLE_DOCS) -> dict[str, str]:
    """Letters of ``most`` learning documents of each language at most, in the order of their hashes, ``LETTERS`` at most.

    Texts are fetched only once the documents are chosen: that many, however often an id or a row is repeated."""
    learn = docs.where(F.col("lang").isNotNull() & (common.fold(F.col("doc_id"), FOLDS) != HELD)).select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    # Hashing once more costs less than storing the keys, which takes a file of each shuffle partition.
    keys = learn.select("lang", "h")
    counts = {r["lang"]: r["n"] for r in keys.distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    draw = F.pmod(F.col("h"), F.lit(1 << 30))

    def by_lang(values: dict) -> Column:
        return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.col("lang")]

    # Some more than wanted, so that hardly ever fewer are drawn; the driver takes the first.
    drawn: dict[str, list[tuple[int, int]]] = {}
    for r in keys.where(draw < by_lang({x: (1.5 * most + 50) / n * (1 << 30) for x, n in counts.items()})).distinct().select("lang", draw.alias("draw"), "h").collect():
        drawn.setdefault(r["lang"], []).append((r["draw"], r["h"]))
    chosen = {x: sorted(found)[:most] for x, found in drawn.items()}
    if not chosen:
        return {}

    @arrow_udf("string")
    def pieces(text: pa.Array, most: pa.Array) -> pa.Array:
        return pa.array([spread(t or "", n) for t, n in zip(text.to_pylist(), most.to_pylist(), strict=True)], pa.string())

    texts = learn.where(draw <= by_lang({x: found[-1][0] for x, found in chosen.items()})).groupBy("lang", "h").agg(F.first("text").alias("text"))
    each = by_lang({x: max(EACH, LETTERS // len(found)) for x, found in chosen.items()})
    rows = texts.select("lang", draw.alias("draw"), pieces("text", each).alias("text")).collect()
    out: dict[str, str] = dict.fromkeys(counts, "")
    for r in sorted(rows, key=lambda r: (r["draw"], r["text"])):
        if len(out[r["lang"]]) < LETTERS:
            out[r["lang"]] += r["text"] + " "
    return {k: v[:LETTERS] for k, v in out.items() if v.strip()}


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(common.Recipe(Recogniser, samples(docs)))

    @arrow_udf("struct<lang: string, score: double>")
    def predict(text: pa.Array) -> pa.Array:
        found = [sent.value.made().predict(part) for part in common.chunks(text, 1 << 20)]
        langs = [x for part, _ in found for x in part]
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate([s for _, s in found]) if found else np.zeros(0))], ["lang", "score"])

    held = common.fold(F.col("doc_id"), FOLDS) == HELD
    return docs.select(F.col("doc_id").alias("doc_id"), held.alias("held_out"), predict(F.col("text")).alias("x")).select("doc_id", "held_out", F.col("x.lang").alias("lang_pred"), "x.score")
