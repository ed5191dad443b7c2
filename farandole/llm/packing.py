"""Packing by concatenate-and-cut: all documents' token ids, one after another, cut every 4096.

First pass: map tasks tokenize whole documents and store the ids with the task's number and the
running total inside the task. The tasks' totals (one row per task) are summed up into offsets,
so that every document knows its place in the endless token line. Second pass: each document is
cut where that line crosses a window's end; a piece is a boundary record. No document moves
between machines and no window of tokens is gathered: only the last sequence can be short.

Tokenizing: a word's ids don't depend on its neighbours (white space ends a word and is
dropped), so a slice of texts is split into words by Arrow, the distinct words are looked up in a
bounded cache of Arrow arrays, and the tokenizers library gets the others in one line. That holds
for Latin-1 texts under a file with the normalizer and the pattern below, which is checked when
the file is read; every other text, and any that could hold a special token's string, goes to the
library whole.

Nulls: a null text is empty; an empty document is its end id alone. A null doc_id is kept.
Repeated rows are packed once each. Very long texts give as many pieces as windows they touch.
An empty table gives no pieces. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, stored, text_bytes

#: Tokens of a sequence.
WINDOW = 4096
#: Id that ends each document.
END_ID = 2
#: Words that a worker keeps ids of, about 30 bytes each. Longer ones aren't kept.
CACHE_WORDS = 250_000
CACHE_BYTES = 64
#: Bytes of new words that the library gets at once.
LINE_BYTES = 1 << 18

#: What a tokenizer file has to say for its texts to be split at white space.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
BLANKS = r"\s+"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands between new words; one token of its own.
BETWEEN = "\x01"

#: Bytes of UTF-8 that send a text to the library whole: beyond Latin-1, BETWEEN, and separators
#: that the library doesn't take for white space.
_ODD = np.zeros(256, bool)
_ODD[0xC4:] = True
_ODD[[0x01, 0x1C, 0x1D, 0x1E, 0x1F]] = True

_workers: dict[str, WordTokenizer] = {}


def ends_words_at_blanks(file: dict) -> bool:
    """Whether the tokenizer file lower-cases, and splits at white space and drops it."""
    normal, parts = (file.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
    steps, cuts = normal.get("normalizers", []), parts.get("pretokenizers", [])
    return (
        [s["type"] for s in steps] == NORMALIZERS
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": BLANKS}, " ")
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and (cuts[0]["pattern"], cuts[0]["behavior"], cuts[0]["invert"]) == ({"Regex": PATTERN}, "Removed", True)
        and not cuts[1]["add_prefix_space"]
        and not cuts[1]["use_regex"]
        and file["model"]["type"] == "BPE"
        and not any(file.get(k) for k in ("post_processor", "truncation", "padding"))
    )


class WordTokenizer:
    """Token ids of whole texts as unsigned 16-bit numbers (32-bit for vocabularies beyond 65,536
    ids), as the library gives them without added special tokens."""

    def __init__(self, path: str, most: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        self.dtype = np.dtype(np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        between = self.encode(BETWEEN)
        self.between = int(between[0]) if len(between) == 1 else None
        self.by_word = self.between is not None and ends_words_at_blanks(json.loads(self.library.to_str()))
        self.slices = 0
        self._keep(pa.array([], pa.string()), np.zeros(1, np.int64), np.empty(0, self.dtype), np.empty(0, np.int32))

    def _keep(self, words: pa.Array, ends: np.ndarray, flat: np.ndarray, used: np.ndarray) -> None:
        """The cache: words, where the ids of each end in flat (from 0), and the slice that last had it."""
        self.words, self.ends, self.flat, self.used = words, ends, flat, used

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and how many each has."""
        flat, counts, at = [], [], 0
        while at < len(words):
            size, end = 0, at
            while end < len(words) and size < LINE_BYTES:
                size += len(words[end]) + 3
                end += 1
            ids = self.encode(f" {BETWEEN} ".join(words[at:end]))
            cuts = np.flatnonzero(ids == self.between)
            flat.append(np.delete(ids, cuts))
            counts.append(np.diff(np.r_[-1, cuts, len(ids)]) - 1)
            at = end
        return (np.concatenate(flat), np.concatenate(counts)) if flat else (np.empty(0, self.dtype), np.empty(0, np.int64))

    def looked_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words: where the ids of each start, how many they are, and all these ids."""
        at = pc.index_in(words, value_set=self.words)
        new = np.asarray(pc.is_null(at))
        at = np.asarray(pc.fill_null(at, 0)).astype(np.int64)
        unknown = words.filter(pa.array(new))
        flat, counts = self.encode_words(unknown.to_pylist())
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        starts[~new], sizes[~new] = self.ends[at[~new]], np.diff(self.ends)[at[~new]]
        starts[new], sizes[new] = len(self.flat) + np.cumsum(counts) - counts, counts
        all_ids = np.concatenate([self.flat, flat])
        self.slices += 1
        self.used[at[~new]] = self.slices
        short = np.asarray(pc.less_equal(pc.binary_length(unknown), CACHE_BYTES)) if len(unknown) else np.empty(0, bool)
        self._keep(
            pa.concat_arrays([self.words, unknown.filter(pa.array(short, pa.bool_()))]),
            np.r_[self.ends, self.ends[-1] + np.cumsum(counts[short])],
            np.concatenate([self.flat, flat[np.repeat(short, counts)]]),
            np.r_[self.used, np.full(short.sum(), self.slices, np.int32)],
        )
        if len(self.words) > self.most:
            self._forget(self.most // 2)
        return starts, sizes, all_ids

    def _forget(self, most: int) -> None:
        """Keeps the words that were used last."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[:most])
        counts, chosen = np.diff(self.ends), np.zeros(len(self.words), bool)
        chosen[keep] = True
        self._keep(self.words.take(pa.array(keep)), np.r_[0, np.cumsum(counts[chosen])], self.flat[np.repeat(chosen, counts)], self.used[chosen])

    def plain(self, texts: pa.Array) -> np.ndarray:
        """Which texts (binary) are those of their words."""
        good = np.full(len(texts), self.by_word)
        if len(texts):
            ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
            good[np.searchsorted(ends, np.flatnonzero(_ODD[data]) + ends[0], "right") - 1] = False
            for special in self.specials:
                good &= ~np.asarray(pc.match_substring(texts, special))
        return good

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (binary, without nulls), one after another, and how many each has."""
        good = self.plain(texts)
        try:
            some = texts.filter(pa.array(good)).cast(pa.string())
        except pa.ArrowInvalid:  # not UTF-8
            good[:] = False
            some = pa.array([], pa.string())
        split = pc.utf8_split_whitespace(pc.utf8_lower(some))
        found = split.flatten().dictionary_encode()
        starts, sizes, all_ids = self.looked_up(found.dictionary)
        codes = np.asarray(found.indices)
        counts = sizes[codes]
        words_to = np.asarray(split.offsets)[: len(split) + 1]
        ends = np.r_[0, np.cumsum(counts)]
        flat = all_ids[np.repeat(starts[codes] - ends[:-1], counts) + np.arange(ends[-1])]
        of_text = np.diff(ends[words_to - words_to[0]])
        if good.all():
            return flat, of_text
        out, pieces = np.zeros(len(texts), np.int64), iter(np.split(flat, np.cumsum(of_text)[:-1]))
        all_pieces = [next(pieces) if g else self.encode(t.as_py().decode("utf-8", "replace")) for g, t in zip(good, texts, strict=True)]
        out[:] = list(map(len, all_pieces))
        return np.concatenate(all_pieces), out


def tokenizer(path: str) -> WordTokenizer:
    if path not in _workers:
        _workers[path] = WordTokenizer(path)
    return _workers[path]


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, task, before (tokens of the task ahead of this document), n_tokens and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, before = tokenizer(path), TaskContext.get().partitionId(), 0
        for batch in sliced(batches):
            ids, sizes = words.ids(batch.column(1))
            sizes = sizes + 1
            ends = np.cumsum(sizes)
            line = np.full(ends[-1], END_ID, words.dtype)
            own = np.ones(len(line), bool)
            own[ends - 1] = False
            line[own] = ids
            whole = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends * line.itemsize].astype(np.int32)), pa.py_buffer(line)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(ends), task)), pa.array(before + ends - sizes), pa.array(sizes), whole], ["doc_id", "task", "before", "n_tokens", "ids"])
            before += int(ends[-1])

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, task long, before long, n_tokens long, ids binary")


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (unsigned 32-bit, little-endian),
    doc_tokens, sequence_id and offset."""
    told = tokenizer(path).dtype
    rows = stored(tokenized(docs, path), "pack-ids")
    # One row per map task of the first pass: bounded by the number of tasks, not by the rows.
    totals = rows.groupBy(F.col("task").alias("of_task")).agg(F.sum("n_tokens").alias("tokens"))
    totals = totals.select("of_task", F.coalesce(F.sum("tokens").over(Window.orderBy("of_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    placed = rows.join(F.broadcast(totals), F.col("task") == F.col("of_task")).select("doc_id", (F.col("before") + F.col("ahead")).alias("place"), "n_tokens", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: list[tuple] = []
            for doc, place, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(ids, told).astype("<u4").tobytes()
                start = 0
                while start < n:
                    length = min(n - start, window - (place + start) % window)
                    out.append((doc, start, length, ids[4 * start : 4 * (start + length)], n, (place + start) // window, (place + start) % window))
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), PIECE, strict=True)] if out else [pa.array([], t) for t in PIECE], names=NAMES)

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
PIECE = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def with_crc(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 (unsigned) in the place of ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
