"""Language ID: multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, runs of anything but letters become one blank, and the 1- to 3-grams of
code points are hashed into BINS columns. Weights: 1 + log(count), times idf, scaled to length 1.
Document frequencies come from every document that may be learned from. The regression is trained
by follow-the-regularised-leader (per-coordinate steps, elastic net: L1 keeps it sparse) on a
bounded sample, PER_LANG documents of each language by a fixed hash of doc_id; then a temperature
that minimises the log loss of a part kept out of the training calibrates its probabilities.

Only text and lang of documents that aren't held out are learned from; lang, source and doc_id
are never inputs of a prediction.

Nulls: a null text, an empty one and one without letters is `und` with score 0, and so is any text
where nothing could be learned; null languages aren't learned from; rows with a null doc_id are
predicted and not held out. Repeated rows get equal predictions and are learned from once, a
doc_id with several texts of a language from the least of them; ties
go to the smaller language. Very long texts are read whole. An empty table gives no rows. Columns
other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_of, kept_by_text, sliced, text_bytes

UNDETERMINED = "und"
FOLDS, HELD_OUT = 5, 0
#: Columns of the hashed n-grams, a power of two; documents of each language that the fit takes.
BITS = 14
BINS = 1 << BITS
PER_LANG = 400
#: Languages that are learned: the most frequent ones, ties to the smaller.
LANGS = 256
#: Rounds over the sample, the step, its smoothing, and the penalties.
ROUNDS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.01
#: Every so many-th row of the sample sets the temperature instead of the weights.
CALIBRATION = 6

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; made once in each worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_counts(text: bytes) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text; None if it has no letter."""
    c = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = letters()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a blank only after a letter
    c = np.concatenate([[np.uint32(32)], c[keep], [np.uint32(32)]]).astype(np.uint32)
    one, two, three = c * np.uint32(0x9E3779B1), c * np.uint32(0x85EBCA6B), c * np.uint32(0xC2B2AE35)
    pair = one[:-1] ^ (two[1:] + np.uint32(0x27D4EB2F))
    triple = pair[:-1] * np.uint32(0x165667B1) ^ three[2:]
    grams = np.concatenate([one[1:-1], pair * np.uint32(0x9E3779B1), triple * np.uint32(0x9E3779B1)])
    return np.bincount(grams >> np.uint32(32 - BITS), minlength=BINS)


@dataclass
class Model:
    """langs in order, idf by column, weights (columns x langs), bias, temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def weighted(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """TF-IDF weights of the columns `at`, of length 1."""
        v = (1 + np.log(counts)) * self.idf[at]
        return v / np.sqrt((v**2).sum())

    def predict(self, text: bytes) -> tuple[str, float]:
        counts = gram_counts(text) if self.langs else None
        if counts is None:
            return UNDETERMINED, 0.0
        at = np.flatnonzero(counts)
        v = self.weighted(at, counts[at])
        p = _softmax((v @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(langs: list[str], counted: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, idf: np.ndarray) -> Model:
    """Follow-the-regularised-leader over the rows (columns and their counts), then the temperature."""
    k = len(langs)
    model = Model(langs, idf, np.zeros((BINS, k)), np.zeros(k))
    rows = [(at, model.weighted(at, c)) for at, c in counted]
    kept = np.arange(len(rows)) % CALIBRATION == CALIBRATION - 1
    z, n = np.zeros((BINS + 1, k)), np.zeros((BINS + 1, k))  # the last row is the bias

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    order = np.random.default_rng(7)
    for _ in range(ROUNDS):
        for i in order.permutation(np.flatnonzero(~kept)):
            at, v = np.append(rows[i][0], BINS), np.append(rows[i][1], 1.0)
            w = weights(z[at], n[at])
            error = _softmax(v @ w)
            error[target[i]] -= 1
            g = v[:, None] * error
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
            n[at] = more
    w = weights(z, n)
    model.weights, model.bias = w[:BINS], w[BINS]
    if kept.any():
        raw = np.array([rows[i][1] @ model.weights[rows[i][0]] + model.bias for i in np.flatnonzero(kept)])
        loss = lambda t: -np.log(np.maximum(_softmax(raw / t)[np.arange(len(raw)), target[kept]], 1e-12)).mean()
        model.temperature = float(min(np.exp(np.linspace(-3, 3, 61)), key=loss))
    return model


def held_out() -> Column:
    return F.coalesce(crc32_of("doc_id") % FOLDS == HELD_OUT, F.lit(False))


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents with letters, and how many of them have each column; over all rows of docs.
    Every task adds up its own rows; BINS numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(BINS, np.int64)
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                counts = gram_counts(text)
                if counts is not None:
                    n += 1
                    df += counts > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BINS)), pa.array(np.r_[n, df])], names=["bin", "df"])

    got = docs.select(text_bytes().alias("text")).mapInArrow(run, "bin long, df long").groupBy("bin").agg(F.sum("df").alias("df")).toArrow().to_pydict()
    out = np.zeros(BINS + 1, np.int64)
    out[np.array(got["bin"], np.int64) + 1] = got["df"]
    return int(out[0]), out[1:]


def fit(docs: DataFrame, per_lang: int = PER_LANG, most_langs: int = LANGS) -> Model:
    """The model of the most_langs most frequent languages, from at most per_lang documents of each."""
    seen = docs.select("doc_id", "text", "lang").where("lang is not null and doc_id is not null").where(~held_out())
    n, df = document_frequencies(seen)
    idf = np.log((1 + n) / (1 + df)) + 1
    # A row per language that is learned. Only rows with hashes below the language's cut reach the
    # window: about twice per_lang of them, however many rows a language has.
    known = seen.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "lang").limit(most_langs)
    known = known.select(F.col("lang").alias("of_lang"), (F.lit(2.0 * per_lang) / F.col("rows")).alias("cut"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / (1 << 32)
    below = seen.select("doc_id", "lang").join(F.broadcast(known), F.col("lang") == F.col("of_lang")).where(place < F.col("cut")).select("doc_id", "lang").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = below.withColumn("rank", rank).where(F.col("rank") <= per_lang).select(F.col("doc_id").alias("of_doc"), F.col("lang").alias("of_lang"))
    # At most per_lang short rows for each of most_langs languages: a broadcast of a documented bound.
    texts = seen.join(F.broadcast(chosen), (F.col("doc_id") == F.col("of_doc")) & (F.col("lang") == F.col("of_lang"))).groupBy("of_doc", "of_lang").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts = [gram_counts(t) for t in batch.column(2).to_pylist()]
            packed = [None if c is None else np.stack([at := np.flatnonzero(c), c[at]]).astype(np.int32).tobytes() for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["of_doc", "of_lang", "counts"])

    rows = texts.select("of_doc", "of_lang", text_bytes().alias("text")).mapInArrow(run, "of_doc long, of_lang string, counts binary").where("counts is not null")
    got = rows.toArrow().sort_by([("of_doc", "ascending"), ("of_lang", "ascending")]).to_pydict()
    langs = sorted(set(got["of_lang"]))
    counted = [tuple(np.frombuffer(packed, np.int32).reshape(2, -1)) for packed in got["counts"]]
    return train(langs, counted, np.array([langs.index(x) for x in got["of_lang"]], np.int64), idf)


def _predictions(model: Model, texts: list[bytes]) -> list[pa.Array]:
    out = [model.predict(t) for t in texts]
    return [pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())]



def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    told = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *_predictions(told.value, batch.column(0).to_pylist())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(text_bytes().alias("whole"), F.col("doc_id").cast("long"), held_out().alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, with its columns, whose language is determined with at least that score."""
    told = docs.sparkSession.sparkContext.broadcast(fit(docs))
    return kept_by_text(docs, lambda texts: _predictions(told.value, texts), "lang_pred string, score double", f"lang_pred <> '{UNDETERMINED}' and score >= {least}")
