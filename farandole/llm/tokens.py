"""Token counts by a two-tier map-side lookup; no pre-token is ever shuffled.

A text is cut into pre-tokens (blanks with the run that follows them; line ends alone) between
which the vocabulary has no piece, so the library's count of a text is the sum over them.
First tier: a compact table of the most frequent pre-tokens and their token counts, the same on
every worker. Second tier: misses are encoded by the library and kept in the worker's bounded
cache. The table only decides what is looked up where, never what is counted.

The table comes from a pass over all documents: every task counts its pre-tokens in a bounded
summary (rare ones are dropped when it is full) and hands its TASK_TOP most frequent on.

Nulls: a null text is empty and has 0 tokens; a null doc_id is kept. Repeated rows are counted
each. Very long texts and pre-tokens are counted whole (long pre-tokens aren't kept). An empty
table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_bytes

#: A document of more tokens is over the limit.
LIMIT = 4096
#: Pre-tokens of the broadcast table, and those that a task hands on for it.
TABLE_ROWS = 32_768
TASK_TOP = 4_096
#: Entries of a task's summary, and of a worker's cache; longer pre-tokens aren't kept.
SUMMARY_ROWS = 200_000
CACHE_ROWS = 400_000
CACHE_CHARS = 64

#: The blank and the piece model's own sign for it are one to the model.
PRE_TOKENS = re.compile("[ ▁]*[^ ▁\n]+|[ ▁]+|\n").findall

_workers: dict[str, PieceCounter] = {}


class PieceCounter(dict):
    """Tokens by pre-token: the frequent ones first, then a bounded cache of what was encoded."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.frequent: dict[str, int] = {}
        # A line end keeps the library's own leading blank apart from the pre-token.
        self.apart = len(self.library.encode("\n"))

    def tier(self, frequent: dict[str, int]) -> None:
        if self.frequent is not frequent:
            self.frequent = frequent
            self.clear()
            self.update(frequent)

    def __missing__(self, pre: str) -> int:
        n = len(self.library.encode("\n" + pre)) - self.apart
        if len(pre) <= CACHE_CHARS:
            if len(self) >= len(self.frequent) + CACHE_ROWS:
                self.clear()
                self.update(self.frequent)
            self[pre] = n
        return n

    def count(self, text: bytes) -> int:
        return sum(map(self.__getitem__, PRE_TOKENS(" " + text.decode("utf-8", "replace")))) if text else 0


def counter(path: str) -> PieceCounter:
    if path not in _workers:
        _workers[path] = PieceCounter(path)
    return _workers[path]


def frequent_pre_tokens(docs: DataFrame, rows: int = TABLE_ROWS) -> DataFrame:
    """The most frequent pre-tokens of all documents, at most so many: (pre, seen)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                seen.update(PRE_TOKENS(" " + text.decode("utf-8", "replace")))
                if len(seen) > SUMMARY_ROWS:
                    seen = Counter(dict(seen.most_common(SUMMARY_ROWS // 4)))
        top = [(p, n) for p, n in seen.most_common(TASK_TOP) if len(p) <= CACHE_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["pre", "n"])

    parts = docs.select(text_bytes().alias("text")).mapInArrow(run, "pre string, n long")
    return parts.groupBy("pre").agg(F.sum("n").alias("seen")).orderBy(F.desc("seen"), "pre").limit(rows)


def frequent_lengths(docs: DataFrame, path: str, rows: int = TABLE_ROWS) -> Broadcast:
    """The first tier, broadcast: at most `rows` short strings with their token counts."""
    pre = [r.pre for r in frequent_pre_tokens(docs, rows).select("pre").collect()]
    of = PieceCounter(path)
    return docs.sparkSession.sparkContext.broadcast({p: of[p] for p in pre})


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, rows: int = TABLE_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    told = frequent_lengths(docs, path, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        tokens.tier(told.value)
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(list(map(tokens.count, texts)), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
