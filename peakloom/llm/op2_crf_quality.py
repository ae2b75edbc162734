"""Operator 2, quality by a linear-chain conditional random field over lines.

Every line with a word gets a feature vector of its own form and that of its neighbours. The field
has two labels, good and bad; forward-backward gives each line's probability of being good, and the
length-weighted mean over lines, calibrated by a logistic curve, is the document's score.

Labels exist for documents only: in training all lines bear their document's label. The model is
fitted on the driver on at most TRAIN_DOCS labelled documents (those of the least hash of the id, so
the choice doesn't depend on the order of rows) whose checksum is not held out; scoring covers all
documents. Neither labels nor language, source or id are features.

Null and empty texts are one empty line and get the score that the model gives to it. Documents
without a label are scored as any other; a document with several labels counts with the least. With
no labels at all every score is 0.5. Repeated rows are scored each. Documents are worked on in blocks
bounded by lines, so many long ones together take no more memory than one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod5, documents

#: Lines (padded) of documents that are worked on together.
CELLS = 100_000
TRAIN_DOCS, STEPS, RATE, RIDGE, CUT = 3_000, 150, 0.1, 1e-3, 0.3
OWN, NEAR = 12, 6
FEATURES = OWN + 2 * (NEAR + 1)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line with a word, and the lines' lengths in characters. The first NEAR features after the constant are also taken from both neighbours."""
    rows, sizes, seen = [], [], set()
    for line in (text or "").split("\n"):
        words = line.split()
        if not words:
            continue
        n, chars = len(words), sum(map(len, words))
        upper = 0 if line.islower() else sum(map(str.isupper, line))
        symbols = sum(map(line.count, "#*$%&|<>"))
        marks = line.count("!") + line.count("?")
        digits = sum(map(line.count, "0123456789")) if any(map(line.count, "0123456789")) else 0
        pairs = len(set(zip(words, words[1:])))
        rows.append((
            1.0, min(symbols / n, 2.0), min(marks / n, 2.0), upper / chars, float(line in seen), math.log1p(n) / 5, min(abs(chars / n - 5) / 5, 3.0),
            digits / chars, len(set(words)) / n, 1 - pairs / max(1, n - 1) if n > 1 else 0.0, float(n < 3), float(line.rstrip()[-1] in ".!?:;\"'"),
        ))
        sizes.append(len(line))
        seen.add(line)
    if not rows:
        rows, sizes = [(1.0, *[0.0] * (OWN - 1))], [1]
    own = np.array(rows)
    near = np.concatenate([own[:, 1 : NEAR + 1], np.ones((len(own), 1))], 1)
    edge = np.zeros((1, NEAR + 1))
    return np.concatenate([own, np.concatenate([edge, near[:-1]]), np.concatenate([near[1:], edge])], 1), np.array(sizes, np.float64)


class Field:
    """weights: of the good label against the bad one; moves[a, b]: from a line of label a to one of label b (1 is good)."""

    def __init__(self):
        self.weights, self.moves, self.curve = np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(2)

    def blocks(self, texts: list[np.ndarray], most: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Documents of like length together, of CELLS lines at most unless one alone has more: their places, features padded to the longest, and the mask of lines."""
        order = np.argsort([len(x) for x in texts], kind="stable")
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and stop - at < min(most, CELLS // max(1, len(texts[order[stop]]))) and len(texts[order[stop]]) <= 1.25 * len(texts[order[at]]) + 2:
                stop += 1
            here = order[at:stop]
            x = np.zeros((len(here), len(texts[here[-1]]), FEATURES))
            mask = np.zeros(x.shape[:2], bool)
            for i, d in enumerate(here):
                x[i, : len(texts[d])], mask[i, : len(texts[d])] = texts[d], True
            yield here, x, mask
            at = stop

    def marginals(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward in logarithms: each line's probability of good, and the expected number of moves."""
        b, t = mask.shape
        unary = np.zeros((b, t, 2))
        unary[:, :, 1] = x @ self.weights
        forward, backward = np.empty((b, t, 2)), np.zeros((b, t, 2))
        forward[:, 0] = unary[:, 0]
        for i in range(1, t):
            step = unary[:, i] + np.logaddexp(forward[:, i - 1, :1] + self.moves[0], forward[:, i - 1, 1:] + self.moves[1])
            forward[:, i] = np.where(mask[:, i, None], step, forward[:, i - 1])
        for i in range(t - 2, -1, -1):
            ahead = unary[:, i + 1] + backward[:, i + 1]
            step = np.logaddexp(self.moves[:, 0] + ahead[:, :1], self.moves[:, 1] + ahead[:, 1:])
            backward[:, i] = np.where(mask[:, i + 1, None], step, 0.0)
        whole = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        good = np.where(mask, np.exp(np.clip(forward[:, :, 1] + backward[:, :, 1] - whole[:, None], -50, 0)), 0.0)
        moves = np.zeros((2, 2))
        if t > 1:
            pair = forward[:, :-1, :, None] + self.moves + (unary[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, None, None, None]
            moves = np.where(mask[:, 1:, None, None], np.exp(np.minimum(pair, 0)), 0).sum((0, 1))
        return good, moves

    def quality(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Length-weighted mean probability of good lines, and the number of lines rather bad than good."""
        mean, bad = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for here, x, mask in self.blocks([x for x, _ in texts]):
            good, _ = self.marginals(x, mask)
            for i, d in enumerate(here):
                size = texts[d][1]
                p = good[i, : len(size)]
                mean[d], bad[d] = float((p * size).sum() / size.sum()), int((p < 0.5).sum())
        return mean, bad

    def score(self, mean: np.ndarray) -> np.ndarray:
        z = self.curve[0] + self.curve[1] * odds(mean)
        return 1 / (1 + np.exp(-z))

    def fit(self, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> "Field":
        """Adam on the likelihood of the line labels, lines of a document weighing one together; then the curve by Newton's method."""
        if not len(texts):
            return self
        blocks = [(here, x, mask, mask / mask.sum(1, keepdims=True)) for here, x, mask in self.blocks([x for x, _ in texts])]
        first, second, n = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4), len(texts)
        for step in range(1, STEPS + 1):
            slope = np.zeros(FEATURES + 4)
            for here, x, mask, share in blocks:
                y = labels[here][:, None]
                good, moves = self.marginals(x, mask)
                slope[:FEATURES] += ((y - good) * share)[:, :, None].__mul__(x).sum((0, 1))
                stay = (mask[:, 1:].sum(1) * labels[here]).sum(), (mask[:, 1:].sum(1) * (1 - labels[here])).sum()
                slope[FEATURES:] += (np.array([[stay[1], 0], [0, stay[0]]]) - moves).ravel() / max(1, mask.sum()) * len(here)
            now = np.concatenate([self.weights, self.moves.ravel()])
            slope = slope / n - RIDGE * now
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            now = now + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            self.weights, self.moves = now[:FEATURES], now[FEATURES:].reshape(2, 2)
        mean, _ = self.quality(texts)
        z = np.stack([np.ones(n), odds(mean)], 1)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.curve, -30, 30)))
            self.curve = self.curve + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (labels - p) - 1e-2 * self.curve)
        return self


def odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def trained(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Field:
    chosen = labels.where(crc_mod5() != 0).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = chosen.select(F.col("doc_id").alias("_id"), "quality")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "quality").limit(2 * most).collect()  # at most `most` rows where ids are unique
    rows.sort(key=lambda r: r.doc_id)
    return Field().fit([features(r.text) for r in rows], np.array([float(r.quality) for r in rows]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_lines, n_bad_lines."""
    field = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))  # a few dozen weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                texts, lines, first = [], 0, at
                while at < whole.num_rows and at - first < 512 and lines < CELLS:
                    texts.append(features(whole.column(1)[at].as_py()))
                    lines, at = lines + len(texts[-1][1]), at + 1
                batch = whole.slice(first, at - first)
                mean, bad = field.value.quality(texts)
                score = field.value.score(mean)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= CUT).astype(np.int32)), pa.array([len(s) for _, s in texts], pa.int32()), pa.array(bad.astype(np.int32))], names=["doc_id", "held_out", "score", "predicted", "n_lines", "n_bad_lines"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(crc_mod5() == 0, F.lit(False)).alias("held_out"))
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_lines int, n_bad_lines int")


def op2_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
