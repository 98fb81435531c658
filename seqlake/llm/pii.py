"""Personal data by weak supervision.

Four kinds of spans have fixed patterns: email, ip, card, phone. These base spans always
stand. Wider patterns propose more candidates of each (written-out addresses of either
sort, IPv6, cards inside longer runs of digits, telephone numbers without a plus sign)
and of a fifth kind, secret (values that are assigned to a name, tokens of known make).
On every candidate three labellers vote for, against or not at all: the pattern and its
checks, gazetteers (mail domains, calling codes, card prefixes, addresses that are no
one's, names of secrets), and the words and signs around it. Over the counts of vote
patterns of all documents, expectation-maximisation estimates how reliable each labeller
is for each kind, and a posterior for each pattern. A logistic classifier of the
candidate's features learns from these posteriors and decides on the candidates beyond
the base.

What reaches the driver are counts of vote and feature patterns, of which there are
a fixed number.

Defined cases: a null text counts as empty; documents without spans have zero counts
and the digest of the empty text; very long texts are read whole; places are code
points; of candidates of a kind that overlap the first stands, and none stands inside a
base span; repeated rows give the same spans; other columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import common

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
AROUND = 40
CUT = 0.5
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A leftmost match begins where its run of digits begins, or every start in the run fails alike.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_SPELT_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,63}){1,6}")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])")
_SPELT_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\(dot\)|\[dot\]|\[\.\]|\(\.\)) ?[0-9]{1,3}){3}(?![0-9])")
_LONG_IP = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])|(?<![0-9A-Za-z:.])(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}(?![0-9A-Za-z:])")
_CARD_SHAPE = re.compile(r"(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([ -]?)[0-9]{6}\2[0-9]{5})(?![0-9])")
_ASSIGNED = re.compile(r"[=:] ?[\"']?([A-Za-z0-9_+/.~-]{8,200})")
_KNOWN_TOKEN = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[opsru]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+)(?![A-Za-z0-9])")
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_.-]{0,40}[\"']?[ ]?$")
_MARKS = ("[.]", "(.)", "(at)", "[at]", "{at}", "(dot)", "[dot]", "{dot}", " dot ")
#: Gazetteers.
TOP_DOMAINS = frozenset("com org net edu gov info io de fr es uk eu us ca au ch at it nl be".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "354", "358", "420", "421")
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "22", "23", "24", "25", "26", "27")
NO_ONES = ("0.", "10.", "127.", "192.168.", "169.254.", "255.")
SECRET_NAMES = ("password", "passwd", "passwort", "pwd", "token", "secret", "apikey", "api_key", "api-key", "access_key", "private_key", "auth", "bearer", "credential", "contrase", "clave", "mot_de_passe")
CUES = {
    "secret": ("password", "token", "secret", "key", "login", "credential", "auth"),
    "email": ("mail", "contact", "write", "address", "courriel", "correo", "@"),
    "ip": ("ip", "host", "server", "login", "from", "address"),
    "card": ("card", "visa", "credit", "payment", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "anruf", "llam", "appel"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then place."""
    out: list[tuple[str, int, int]] = []
    at, last, free = text.find("@"), -1, 0
    while at >= 0:
        begin = max(free, last + 1)
        start = begin + len(text[begin:at].rstrip(_LOCAL))
        last = at
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 2 * 19:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def more_spans(text: str) -> list[tuple[str, int, int, int]]:
    """Candidates beyond the base patterns, and what their own checks say: for (1), against (-1) or nothing (0)."""
    out = []
    if any(m in text for m in _MARKS):
        out += [("email", m.start(), m.end(), 0) for m in _SPELT_EMAIL.finditer(text)]
        out += [("ip", m.start(), m.end(), 1 if all(int(x) <= 255 for x in re.findall("[0-9]+", m[0])) else -1) for m in _SPELT_IP.finditer(text)]
    if _DIGIT.search(text):
        out += [("card", m.start(), m.end(), 1 if luhn("".join(c for c in m[0] if c.isdigit())) else -1) for m in _CARD_SHAPE.finditer(text)]
        out += [("phone", m.start(), m.end(), 0) for m in _LOCAL_PHONE.finditer(text)]
        if ":" in text:
            out += [("ip", m.start(), m.end(), 1 if "::" not in m[0] or m[0].count(":") > 2 else 0) for m in _LONG_IP.finditer(text)]
        if "=" in text or ":" in text:
            for m in _ASSIGNED.finditer(text):
                kinds = {"d" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "." for c in m[1]}
                if "d" in kinds and _NAME.search(text, max(0, m.start() - 44), m.start()):
                    out.append(("secret", m.start(1), m.end(1), 1 if len(m[1]) >= 12 and kinds & {"a", "A"} else -1 if kinds <= {"d", "."} else 0))
        out += [("secret", m.start(), m.end(), 1) for m in _KNOWN_TOKEN.finditer(text)]
    return _first_of_overlapping(out)


def _first_of_overlapping(spans: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    out, ends = [], dict.fromkeys(ALL_KINDS, 0)
    for kind, start, end, check in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= ends[kind]:
            out.append((kind, start, end, check))
            ends[kind] = end
    return out


def _gazetteer(kind: str, text: str, start: int, end: int) -> int:
    span = text[start:end]
    if kind == "secret":
        if _KNOWN_TOKEN.fullmatch(span):
            return 1
        before = text[max(0, start - AROUND) : start].rstrip(" \"'=:").lower()
        name = before[len(before.rstrip("abcdefghijklmnopqrstuvwxyz0123456789_.-")) :]
        return 1 if any(x in name for x in SECRET_NAMES) else -1
    if kind == "email":
        return 1 if re.split(r"[^A-Za-z0-9]+", span)[-1].lower() in TOP_DOMAINS else -1
    if kind == "ip":
        return -1 if span.startswith(NO_ONES) else 1
    digits = "".join(c for c in span if c.isdigit())
    if kind == "card":
        return 1 if digits.startswith(CARD_PREFIXES) else -1
    if span.startswith("+"):
        return 1 if digits.startswith(CALLING_CODES) else -1
    return 1 if digits[0] not in "01" and digits[3] not in "01" else -1


def _context(kind: str, text: str, start: int, end: int) -> int:
    before = text[max(0, start - AROUND) : start].lower()
    if any(c in before for c in CUES[kind]):
        return 1
    tight = (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    return -1 if tight else 0


def votes(kind: str, text: str, start: int, end: int, check: int) -> tuple[int, int, int]:
    """Of the pattern with its checks, the gazetteer and the context."""
    return (check, _gazetteer(kind, text, start, end), _context(kind, text, start, end))


def features(kind: str, text: str, start: int, end: int, v: tuple[int, int, int]) -> tuple[int, ...]:
    """Yes and no only: pattern, gazetteer for and against, cue, tightly enclosed, brackets, within one line, ends a sentence."""
    span = text[start:end]
    return (int(v[0] > 0), int(v[1] > 0), int(v[1] < 0), int(v[2] > 0), int(v[2] < 0), int("(" in span or "[" in span), int("\n" not in span), int(text[end : end + 1] in (".", ",", ";", "\n", "")))


def candidates(text: str) -> list[tuple[int, int, int, int, int, int]]:
    """(kind, start, end, base, votes, features), votes and features as numbers."""
    out = []
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    starts = np.array([s for s, _ in taken])
    reach = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0)
    for strict, spans in ((True, [(*x, 1) for x in base]), (False, more_spans(text))):
        for kind, s, e, check in spans:
            if not strict:
                # Another kind's base span may lie in a secret; else what a base span meets is its.
                before = int(np.searchsorted(starts, s, "right") if kind == "secret" else np.searchsorted(starts, e)) if len(starts) else 0
                if before and reach[before - 1] >= (e if kind == "secret" else s + 1):
                    continue
            v = votes(kind, text, s, e, check)
            f = features(kind, text, s, e, v)
            out.append((ALL_KINDS.index(kind), s, e, int(strict), sum((x + 1) * 3**i for i, x in enumerate(v)), sum(x << i for i, x in enumerate(f))))
    return out


def posteriors(counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """counts: of the 27 vote patterns. The probability that a candidate with that pattern is real, by EM over
    labellers that vote independently given the truth."""
    vote = np.array([[p // 3**i % 3 for i in range(3)] for p in range(27)])
    # Votes for are right more often than not: where EM begins.
    table = np.array([[[0.5, 0.3, 0.2]] * 3, [[0.1, 0.3, 0.6]] * 3])
    prior = 0.7
    for _ in range(rounds):
        like = [w * np.prod([table[c, i, vote[:, i]] for i in range(3)], axis=0) for c, w in ((0, 1 - prior), (1, prior))]
        real = like[1] / (like[0] + like[1])
        if not counts.sum():
            break
        prior = float(np.clip((counts * real).sum() / counts.sum(), 0.01, 0.99))
        for c, weight in ((0, counts * (1 - real)), (1, counts * real)):
            for i, k in product(range(3), range(3)):
                table[c, i, k] = (weight[vote[:, i] == k].sum() + 1) / (weight.sum() + 3)
    return real


def classifier(feature: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic weights (the first is the constant) for soft targets."""
    x = np.column_stack([np.ones(len(feature)), *((feature >> i) & 1 for i in range(8))])
    w = np.zeros(9)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(9), x.T @ (weight * (p - target)) + w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(found: DataFrame) -> dict[int, np.ndarray]:
    """found: kind, votes, features of all candidates. Logistic weights by kind."""
    rows = found.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for k in range(len(ALL_KINDS)):
        own = [r for r in rows if r["kind"] == k]
        counts = np.zeros(27)
        for r in own:
            counts[r["votes"]] += r["n"]
        real = posteriors(counts)
        out[k] = classifier(np.array([r["features"] for r in own], int), np.array([real[r["votes"]] for r in own]), np.array([r["n"] for r in own], float))
    return out


def likely(weights: np.ndarray, feature: int) -> float:
    z = weights[0] + sum(weights[1 + i] for i in range(8) if feature >> i & 1)
    return 1 / (1 + np.exp(-z))


@common.on_arrow("array<struct<kind: int, start: int, end: int, base: int, votes: int, features: int>>")
def _candidates(text: pa.Array) -> pa.Array:
    names = ["kind", "start", "end", "base", "votes", "features"]
    rows = [candidates(raw.decode()) for part in common.chunks(text) for raw in part]
    flat = [c for r in rows for c in r]
    columns = list(zip(*flat, strict=True)) if flat else [()] * 6
    struct = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], names)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)), struct)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans, n_spans (all), n_secret."""
    found = common.stored(docs.select(F.col("doc_id").alias("doc_id"), _candidates("text").alias("found")), "candidates")
    weights = fit(found.select(F.explode("found").alias("x")).select("x.*"))
    sure = {k: {f for f in range(256) if likely(w, f) >= CUT} for k, w in weights.items()}

    @arrow_udf("struct<base: string, spans: string, n_spans: long, n_secret: long>")
    def written(found: pa.Array) -> pa.Array:
        base, spans, n, secret = [], [], [], []
        for row in found.to_pylist():
            own = [(c["kind"], c["start"], c["end"], c["base"]) for c in row if c["base"] or c["features"] in sure[c["kind"]]]
            text = lambda cs: ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for k, s, e, _ in sorted(cs))
            base.append(text([c for c in own if c[3]]))
            spans.append(text(own))
            n.append(len(own))
            secret.append(sum(c[0] == len(KINDS) for c in own))
        return pa.StructArray.from_arrays([pa.array(base, pa.string()), pa.array(spans, pa.string()), pa.array(n, pa.int64()), pa.array(secret, pa.int64())], ["base", "spans", "n_spans", "n_secret"])

    count = [F.expr(f"cast(size(filter(found, c -> c.kind = {k} AND c.base = 1)) AS bigint)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *count, written("found").alias("x")).select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("x.base").cast("binary"), 256).alias("base_sha256"), "x.spans", "x.n_spans", "x.n_secret")


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
