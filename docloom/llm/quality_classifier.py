"""Quality classifier: naive Bayes support vectors.

A text is the set of its n-grams: one and two words, three and four bytes, and
three word shapes in a row (case, signs, repeats). An n-gram's indicator is
scaled by the log ratio of its smoothed share in the two classes, counted over
all labelled rows; a linear hinge-loss model is fitted to the scaled
indicators by dual coordinate descent. Ratios and weights make one table of
CELLS hashed n-grams, whatever the corpus size.

The fit, and only the fit, uses at most SAMPLE labelled rows, those with the
smallest hash of id and text; rows that agree in both count once there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import binary, byte_table, chunks, known_labels, labelled, mix, word_hashes

CELLS = 1 << 18
SAMPLE = 6000
SMOOTHING = 1.0
COST = 1.0  # of a violated margin
SHARE = 0.25  # of the fitted weights, against their mean size
EPOCHS = 12

_WORDS = byte_table([32, *range(9, 14)], fold_case=False)
_UPPER, _LOWER, _PLAIN = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91], _LOWER[97:123], _LOWER[128:] = True, True, True
_PLAIN[[ord(c) for c in ".,;:?'\"()-"]] = True


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) & (CELLS - 1)


def _shapes(data, starts, ends, words, row):
    """A small number per word: case, signs, and whether it repeats one of the eight before."""

    def count(mask):
        sums = np.concatenate([[0], np.cumsum(mask[data])])
        return sums[ends] - sums[starts]

    upper, lower, plain = count(_UPPER), count(_LOWER), count(_PLAIN)
    letters = upper + lower
    case = np.where((upper > 1) & (lower == 0), 2, np.where(_UPPER[data[starts]], 1, 0))
    other = ends - starts - letters - plain
    signs = np.where(other > 1, 3, np.where(other == 1, 2, np.minimum(plain, 1)))
    repeat = np.zeros(len(words), np.int64)
    for back in range(8, 0, -1):
        same = np.zeros(len(words), bool)
        same[back:] = (words[back:] == words[:-back]) & (row[back:] == row[:-back])
        repeat[same] = 1 if back > 1 else 2
    return ((case * 4 + signs) * 3 + repeat) * 2 + (letters > 0)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct cells of each row's n-grams."""
    starts, ends, words, first = word_hashes(data, offsets, _WORDS)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    shapes = _shapes(data, starts, ends, words, row).astype(np.uint64) if len(words) else words
    wide = data.astype(np.uint64)
    three = wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16) if len(data) > 2 else wide[:0]
    four = three[:-1] | wide[3:] << np.uint64(24) | np.uint64(1 << 40) if len(data) > 3 else wide[:0]
    streams = [
        (_cell(words), first, 1),
        (_cell(mix(words[:-1] * np.uint64(3) + words[1:] * np.uint64(5))), first, 2),
        (_cell(mix((shapes[:-2] * np.uint64(128) + shapes[1:-1]) * np.uint64(128) + shapes[2:] + np.uint64(1 << 50))), first, 3),
        (_cell(mix(three)), offsets, 3),
        (_cell(mix(four)), offsets, 4),
    ]
    seen = np.zeros(CELLS, bool)
    for r in range(len(offsets) - 1):
        for cells, at, size in streams:
            seen[cells[at[r] : max(at[r], at[r + 1] - size + 1)]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


def _class_counts(batches):
    """How many rows of each class have an n-gram, over the task's rows."""
    counts, rows = np.zeros((2, CELLS), np.int64), np.zeros(2, np.int64)
    for batch, data, offsets in chunks(batches, "text"):
        for label, found in zip(batch.column("label").to_pylist(), ngrams(data, offsets)):
            counts[label, found] += 1
            rows[label] += 1
    some = np.flatnonzero(counts.any(axis=0))
    cells = np.append(some, -1)  # -1: the rows themselves
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), *(pa.array(np.append(counts[k, some], rows[k])) for k in (0, 1))], ["cell", "poor", "good"])


def _sampled(batches):
    for batch, data, offsets in chunks(batches, "text"):
        sets = [found.astype(np.int32).tobytes() for found in ngrams(data, offsets)]
        yield pa.RecordBatch.from_arrays([batch.column("label"), binary(sets)], ["label", "cells"])


def fit(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, seed: int = 1) -> np.ndarray:
    """Weights per cell, ratios included, and the bias last: hinge loss by
    coordinate descent on the dual. Rows are scaled to one length per n-gram."""
    weights, bias = np.zeros(len(ratios)), 0.0
    sign = np.where(labels == 1, 1.0, -1.0)
    scale = np.array([1 / np.sqrt(max(len(r), 1)) for r in rows])
    norms = np.array([float((ratios[r] ** 2).sum()) for r in rows]) * scale**2 + 1.0
    alpha, order = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            values = ratios[rows[i]]
            gradient = sign[i] * (float(weights[rows[i]] @ values) * scale[i] + bias) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), COST)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weights[rows[i]] += step * scale[i] * values
                bias += step
                alpha[i] = new
    weights = np.append(weights, bias)
    used = weights[:-1][weights[:-1] != 0]
    mean = np.abs(used).mean() if len(used) else 0.0
    weights[:-1] = (1 - SHARE) * mean + SHARE * weights[:-1]
    weights[:-1] *= ratios
    return weights


def margins(rows: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    return np.array([float(weights[r].sum()) / np.sqrt(max(len(r), 1)) + weights[-1] for r in rows])


def calibrate(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margin to chance."""
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    if not n1 or not n0:
        return 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.abs(margin).max()), 1e-9)
    x = np.stack([margin / scale, np.ones(len(margin))])
    beta = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(60):
        chance = 1 / (1 + np.exp(-np.clip(beta @ x, -40, 40)))
        hessian = (x * (chance * (1 - chance))) @ x.T + 1e-4 * np.eye(2)
        step = np.linalg.solve(hessian, x @ (chance - target) + 1e-4 * beta)
        beta -= np.clip(step, -5, 5)
    return float(beta[0] / scale), float(beta[1])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, float]:
    """``(weights, slope, offset)`` from ``docs(id, text)`` and labels to learn from."""
    rows = labelled(docs, labels)
    sums = rows.select("label", "text").mapInArrow(_class_counts, "cell long, poor long, good long").groupBy("cell").agg(F.sum("poor").alias("poor"), F.sum("good").alias("good")).toArrow()
    cells = sums.column("cell").to_numpy()
    counts = np.zeros((2, CELLS + 1))
    for k, name in enumerate(("poor", "good")):
        counts[k, cells] = sums.column(name).to_numpy()  # -1 is the last place
    shares = (counts[:, :-1] + SMOOTHING) / (counts[:, -1:] + 2 * SMOOTHING)
    ratios = np.log(shares[1] / shares[0])
    # equal rows count once here, and a number joins one row: a repeated id cannot fill the sample or exceed it
    picked = rows.groupBy(F.xxhash64("id", "text").alias("h")).agg(F.min("nth").alias("nth")).orderBy("h").limit(SAMPLE).select("nth")
    table = rows.join(F.broadcast(picked), "nth", "left_semi").select("label", "text").mapInArrow(_sampled, "label int, cells binary").toArrow()
    sets = [np.frombuffer(x, np.int32) for x in table.column("cells").to_pylist()]
    order = sorted(range(len(sets)), key=lambda i: (sets[i].tobytes(), i))  # the same fit whatever order the rows come in
    sets, known = [sets[i] for i in order], table.column("label").to_numpy()[order] if sets else np.zeros(0, np.int64)
    fold = np.arange(len(sets)) % 2
    margin = np.zeros(len(sets))
    for k in (0, 1):
        out = np.flatnonzero(fold == k)
        rest = np.flatnonzero(fold != k)
        margin[out] = margins([sets[i] for i in out], fit([sets[i] for i in rest], known[rest], ratios))
    return fit(sets, known, ratios), *calibrate(margin, known)


def _scores(batches, weights, slope, offset):
    for batch, data, offsets in chunks(batches, "text"):
        margin = margins(list(ngrams(data, offsets)), weights)
        score = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -40, 40)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score)], ["id", "score"])


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``(id, score)`` per row: the chance that its label is 1.

    Null and empty texts have no n-grams and get the score of the bias; without
    labels every score is one half. Rows with one id are separate rows. Other
    columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    weights, slope, offset = train(docs, known_labels(labels, id_col, label_col))
    scored = docs.mapInArrow(partial(_scores, weights=weights.astype(np.float32), slope=slope, offset=offset), "id long, score double")
    return scored.withColumnRenamed("id", id_col)
