"""Quality by a regularised quadratic discriminant over document statistics.

Each whole text becomes a vector of transformed statistics. Labelled rows of the
learning folds give, for each class, a mean and a covariance, which is shrunk
towards the pooled covariance and its diagonal. A document's score is the
posterior of label 1 from the difference of the Mahalanobis log densities, whose
inverse Cholesky factors are computed once and sent to the executors.

Moments are summed over all labelled learning rows: each task adds up its own,
then Spark sums by cell, so the driver gets the same few numbers at every size.

The fewer rows a class has, the more its covariance is shrunk (by SIZE over its rows and
SIZE, at least by the given shares), so that two rows of each class are enough.

Defined cases: null and empty texts have the statistics of an empty text and a
score; very long texts are read whole; a doc_id with several labels takes their majority
(ties: 0); a null label is no label; without two labelled learning rows of each class
every score is 0.5; a score equal to CUT is kept; repeated rows are scored alike and a
labelled one counts as often as it occurs; other columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import common

FOLDS = 5
SHRINK_POOLED = 0.05
SHRINK_DIAGONAL = 0.05
CUT = 0.3
#: Byte classes: letters and first bytes of others 0, upper case 1, digits 2, space 3, new line 4, marks of sentences 5, calls 6, bars 7, other signs 8, continuation bytes 9.
_CLASS = np.full(256, 8, np.uint8)
_CLASS[[*range(0x61, 0x7B), *range(0xC0, 0x100)]] = 0
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0x20, 0x09]] = 3
_CLASS[[0x0A, 0x0D]] = 4
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 5
_CLASS[[ord(c) for c in "!?"]] = 6
_CLASS[ord("|")] = 7
_CLASS[0x80:0xC0] = 9
SIZE = 14


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of SIZE transformed statistics for each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    cell = np.repeat(np.arange(len(texts), dtype=np.int32) * 10, sizes) + _CLASS[data]
    count = np.bincount(cell, minlength=10 * len(texts)).reshape(-1, 10).astype(float)
    chars = sizes - count[:, 9]
    words, distinct, lines, distinct_lines, twice = (np.empty(len(texts)) for _ in range(5))
    for i, t in enumerate(texts):
        tokens = t.split()
        words[i], distinct[i] = len(tokens), len(set(tokens))
        rows = t.split(b"\n")
        lines[i], distinct_lines[i] = len(rows), len(set(rows))
        twice[i] = sum(map(_same, tokens, tokens[1:]))
    letters = count[:, 0] + count[:, 1]
    rate = lambda x, n: np.log((x + 0.5) / (n + 10.0))
    return np.column_stack([
        np.log1p(words),
        rate(count[:, 1], letters), rate(count[:, 2], chars), rate(count[:, 4], chars), rate(count[:, 5], chars),
        rate(count[:, 6], chars), rate(count[:, 7], chars), rate(count[:, 8], chars), rate(count[:, 3], chars),
        np.log((letters + 5.0) / (words + 1.0)),
        # A vocabulary grows about as the power 0.8 of the text: what is missing against that is repetition.
        np.log((distinct + 1.0) / (words + 1.0)) + 0.2 * np.log1p(words),
        np.log((distinct_lines + 1.0) / (lines + 1.0)),
        np.log((words + 1.0) / (lines + 1.0)),
        rate(twice, words),
    ])


def _same(a: bytes, b: bytes) -> bool:
    return a == b


@common.on_arrow("array<double>")
def _statistics(text: pa.Array) -> pa.Array:
    rows = [statistics(part) for part in common.chunks(text)]
    flat = np.concatenate(rows) if rows else np.zeros((0, SIZE))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, SIZE, dtype=np.int32)), pa.array(flat.ravel()))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((2, 1 + SIZE, 1 + SIZE))
    for b in batches:
        x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
        y = b.column("y").to_numpy(zero_copy_only=False)
        x = np.column_stack([np.ones(len(x)), x])
        for c in (0, 1):
            sums[c] += x[y == c].T @ x[y == c]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["cell", "value"])


class Discriminant:
    def __init__(self, sums: np.ndarray):
        n = sums[:, 0, 0]
        self.known = bool((n >= 2).all())
        if not self.known:
            return
        self.mean = sums[:, 0, 1:] / n[:, None]
        own = np.array([sums[c, 1:, 1:] / n[c] - np.outer(self.mean[c], self.mean[c]) for c in (0, 1)])
        pooled = np.tensordot(n / n.sum(), own, 1)
        diagonal = np.diag(np.diag(pooled) + 1e-6)
        self.prior = np.log(n / n.sum())
        self.factor, self.log_det = [], []
        for c in (0, 1):
            to_pooled, to_diagonal = max(SHRINK_POOLED, SIZE / (n[c] + SIZE)), max(SHRINK_DIAGONAL, SIZE / (n.sum() + SIZE))
            lower = np.linalg.cholesky((1 - to_diagonal) * ((1 - to_pooled) * own[c] + to_pooled * pooled) + to_diagonal * diagonal)
            self.factor.append(np.linalg.inv(lower))
            self.log_det.append(2 * np.log(np.diag(lower)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), 0.5)
        density = [self.prior[c] - 0.5 * (self.log_det[c] + (((x - self.mean[c]) @ self.factor[c].T) ** 2).sum(axis=1)) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def labelled(labels: DataFrame, what: str) -> DataFrame:
    """doc_id, y: the majority of a document's labels."""
    return labels.where(F.col(what).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(F.col(what).cast("double")) > 0.5).cast("int").alias("y"))


def fit(stats: DataFrame, labels: DataFrame, what: str = "quality") -> Discriminant:
    """stats: doc_id, x."""
    train = stats.where(common.fold(F.col("doc_id"), FOLDS) != 0).join(labelled(labels, what), "doc_id").select("x", "y")
    cells = train.mapInArrow(_moments, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros(2 * (1 + SIZE) ** 2)
    for r in cells:
        sums[r["cell"]] = r["value"]
    return Discriminant(sums.reshape(2, 1 + SIZE, 1 + SIZE))


def scorer(model: Discriminant, spark):
    sent = spark.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)))

    return score


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    stats = common.stored(docs.select(F.col("doc_id").alias("doc_id"), _statistics("text").alias("x")), "statistics")
    score = scorer(fit(stats, labels), docs.sparkSession)
    found = stats.select("doc_id", (common.fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), score("x").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score of at least CUT, all columns."""
    stats = common.stored(docs.select(F.col("doc_id").alias("doc_id"), _statistics("text").alias("x")), "statistics")
    score = scorer(fit(stats, labels), docs.sparkSession)
    return docs.where(score(_statistics("text")) >= CUT)
