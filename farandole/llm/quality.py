"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts (lengths, shares of kinds of characters, repetition of words and
lines, word shapes) are computed in map tasks. Trees are grown on quantile-binned statistics
with gradient and hessian histograms; the finished ensemble is flattened into arrays (feature,
threshold, child, value) that numpy walks for a whole batch of rows and all trees at once.

Only labels and texts of rows that aren't held out are learned from; lang, source and doc_id are
never inputs. The fit takes a bounded sample of labelled rows (TRAIN_ROWS, by a fixed hash of
doc_id); scoring covers every document.

Nulls: a null text is scored as an empty one; rows with a null doc_id are scored and not held
out, and are never learned from; null labels are ignored. Repeated rows get equal scores; a
doc_id with several labels is learned once with each, one with several texts from the least. Without labels of both kinds every score
is the same: the share of label 1, smoothed. An empty table gives no rows. Columns other than
doc_id and text (quality in labels) are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, kept_by_text, sliced, text_bytes

#: Labelled rows that the fit takes at most.
TRAIN_ROWS = 20_000
#: Rows whose crc32(doc_id) has this remainder are held out.
FOLDS, HELD_OUT = 3, 1

#: Trees, their depth, histogram bins, step, and the penalties on a leaf.
TREES, DEPTH, BINS, STEP, LEAST_HESSIAN, L2 = 60, 4, 64, 0.15, 2.0, 1.0

STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "long_words", "letters", "upper", "digits",
    "blanks", "high_bytes", "marks", "odd_marks", "line_length", "distinct_lines", "distinct_words", "top_word",
    "repeated_neighbours", "distinct_pairs", "sentence_ends", "bars", "entropy", "title_words", "ends_with_mark", "longest_run",
)

_CLASS = np.zeros(256, np.int64)  # 1 lower, 2 upper, 3 digit, 4 white space, 5 usual mark, 6 other ASCII, 7 high
_CLASS[32:127] = 6
_CLASS[128:] = 7
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_RUN = re.compile(rb"([^\s])\1{3,}")


def statistics(text: bytes) -> list[float]:
    """The document statistics of a whole text, in the order of STATISTICS; zeros if empty."""
    n, words = len(text), text.split()
    if not words:
        return [float(np.log1p(n))] + [0.0] * (len(STATISTICS) - 1)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, counts, 8) / n
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = text.split(b"\n")
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    p = counts[counts > 0] / n
    m = len(words)
    runs = max((len(x.group()) for x in _RUN.finditer(text)), default=0)
    return [
        float(np.log1p(n)), float(np.log1p(m)), float(lengths.mean()), float(lengths.std()), float((lengths > 14).mean()), kinds[1] + kinds[2], kinds[2], kinds[3],
        kinds[4], kinds[7], kinds[5], kinds[6], float(np.log1p(n / len(lines))), len(set(lines)) / len(lines), len(seen) / m, max(seen.values()) / m,
        sum(map(bytes.__eq__, words, words[1:])) / m, pairs / m, float(counts[[33, 46, 63]].sum() / m), float(counts[124] / m), float(-(p * np.log2(p)).sum()),
        sum(map(bytes.istitle, words)) / m, sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / m, float(np.log1p(runs)),
    ]


@dataclass
class Trees:
    """A flattened ensemble: row t of each array is a tree, whose node i has children child and
    child + 1; leaves point at themselves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), self.base)
        t = np.arange(len(self.feature))
        at, rows = np.zeros((len(x), len(t)), np.int64), np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            child = self.child[t, at]
            at = np.where(child > 0, child + (x[rows, self.feature[t, at]] > self.threshold[t, at]), at)
        return self.base + self.value[t, at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for labels y (0 or 1) with log loss."""
    share = (y.sum() + 1) / (len(y) + 2)
    trees = Trees(float(np.log(share / (1 - share))), *(np.zeros((0, 0)) for _ in range(4)))
    if not 0 < y.sum() < len(y):
        return trees
    k = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(k)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(k)], axis=1)  # bin <= i: x <= cuts[i]
    offset = np.arange(k) * BINS
    raw, grown = np.full(len(y), trees.base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, threshold, child, value = [0], [0.0], [0], [0.0]
        split_bin = [0]
        open_nodes, at = [(0, np.arange(len(y)))], np.zeros(len(y), np.int64)
        for depth in range(DEPTH + 1):
            below = []
            for node, rows in open_nodes:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = -STEP * gs / (hs + L2)
                if depth == DEPTH or hs < 2 * LEAST_HESSIAN:
                    continue
                cells = (binned[rows] + offset).ravel()
                gl = np.bincount(cells, np.repeat(g[rows], k), k * BINS).reshape(k, BINS).cumsum(axis=1)
                hl = np.bincount(cells, np.repeat(h[rows], k), k * BINS).reshape(k, BINS).cumsum(axis=1)
                gain = gl**2 / (hl + L2) + (gs - gl) ** 2 / (hs - hl + L2) - gs**2 / (hs + L2)
                gain[(hl < LEAST_HESSIAN) | (hs - hl < LEAST_HESSIAN)] = -1
                j, b = divmod(int(gain.argmax()), BINS)
                if gain[j, b] <= 1e-6 or b >= len(cuts[j]):
                    continue
                feature[node], threshold[node], child[node], split_bin[node] = j, float(cuts[j][b]), len(feature), b
                for side in (0, 1):
                    feature.append(0), threshold.append(0.0), child.append(0), value.append(0.0), split_bin.append(0)
                    part = rows[(binned[rows, j] > b) == side]
                    at[part] = child[node] + side
                    below.append((child[node] + side, part))
            open_nodes = below
        raw = raw + np.array(value)[at]
        grown.append((feature, threshold, child, value))
    most = max(len(f) for f, *_ in grown)
    full = lambda i, kind: np.array([t[i] + [0] * (most - len(t[i])) for t in grown], kind)
    trees.feature, trees.threshold, trees.child, trees.value = full(0, np.int64), full(1, float), full(2, np.int64), full(3, float)
    return trees


def held_out() -> F.Column:
    return F.coalesce(crc32_of("doc_id") % FOLDS == HELD_OUT, F.lit(False))


def _measured(docs: DataFrame, keep: list[str], schema: str) -> DataFrame:
    """The kept columns and the statistics of text_bytes as packed doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            stats = [np.array(statistics(t)).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(stats, pa.binary())], names=[*keep, "stats"])

    return docs.select(text_bytes().alias("whole"), *keep).mapInArrow(run, f"{schema}, stats binary")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees from at most so many labelled rows that aren't held out."""
    told = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out()).select(F.col("doc_id").alias("of_doc"), F.col("quality").cast("int")).distinct()
    told = told.orderBy(F.xxhash64("of_doc"), "of_doc", "quality").limit(rows)
    # At most `rows` pairs of numbers: a broadcast of a documented bound. Repeated documents count once.
    seen = docs.join(F.broadcast(told), F.col("doc_id") == F.col("of_doc")).groupBy("of_doc", "quality").agg(F.min("text").alias("text"))
    got = _measured(seen, ["of_doc", "quality"], "of_doc long, quality int").toArrow().sort_by([("of_doc", "ascending"), ("quality", "ascending")])
    x = np.frombuffer(b"".join(got.column("stats").to_pylist())).reshape(-1, len(STATISTICS))
    return grow(x, got.column("quality").to_numpy().astype(float))


def _scores(trees: Trees, texts: list[bytes]) -> pa.Array:
    return pa.array(trees.score(np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS))))


def scored(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], _scores(model.value, batch.column(0).to_pylist())], names=["doc_id", "held_out", "score"])

    rows = docs.select(text_bytes().alias("whole"), F.col("doc_id").cast("long"), held_out().alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose score reaches `least`, with the columns of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return kept_by_text(docs, lambda texts: [_scores(model.value, texts)], "score double", f"score >= {least}")
