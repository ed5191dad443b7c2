"""Exact top-k by inner product: columnar branch and bound over quantised vectors.

Vectors are packed into blocks in vertical layout (one row per dimension). Every block of queries
meets every block of candidates once: as many query blocks as CHUNK_BYTES hold are broadcast, and
tasks stream the stored candidate blocks past them, chunk after chunk; no vector is shuffled after
it was packed. For some queries at a
time, scores are accumulated STEP dimensions at a time, those with the queries' largest mass
first; by Cauchy-Schwarz what the remaining dimensions can add is at most the product of the
remaining masses, and candidates that reach no query's k-th best score so far are compacted away.
Each task hands k candidates per query on; their ranks are decided in a last small shuffle.

All sums are of integers below 2**53 in double precision, hence exact; blocks with larger
products are computed in Python's unlimited integers, and scores outside a long saturate.

Nulls and non-finite numbers: vectors that are null or hold one, and rows without an id, take no
part. A query meets vectors of its own length only. Repeated rows: every query row has its own
answer; rows with the query's id are the query itself and never its candidates. Ties go to the
smaller vec_id. An empty table gives no rows. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

K = 20
SCALE = 64
#: Rows of a query block and of a candidate block, and dimensions accumulated at a time.
QUERY_ROWS, CANDIDATE_ROWS, STEP = 2048, 8192, 16
#: Queries for which a candidate block is compacted together.
TOGETHER = 32
#: Bytes of query blocks that are broadcast at once; a block beyond it goes alone.
CHUNK_BYTES = 8 << 20
_EXACT, _LONG = 1 << 53, (1 << 63) - 1


def taking_part(rows: DataFrame) -> DataFrame:
    """vec_id and v (double components) of the rows that take part."""
    vector = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    return vector.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def _packed(rows: DataFrame, most: int, scale: int) -> DataFrame:
    """Blocks of at most `most` rows of one length: dims, task, nth, ids, kind (of number) and data,
    the components as floor(scale * component), one dimension after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth = TaskContext.get().partitionId(), 0
        open_: dict[int, tuple[list, list]] = {}

        def block(dims: int) -> pa.RecordBatch:
            nonlocal nth
            ids, data = open_.pop(dims)
            ids, data = np.concatenate(ids), np.floor(np.concatenate(data) * scale)
            largest = float(np.abs(data).max(initial=0))
            kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<f8"
            nth += 1
            return pa.RecordBatch.from_arrays([pa.array([dims]), pa.array([task]), pa.array([nth - 1]), pa.array([ids.tobytes()]), pa.array([kind]), pa.array([np.ascontiguousarray(data.T).astype(kind).tobytes()])], names=["dims", "task", "nth", "ids", "kind", "data"])

        for batch in batches:
            ids, lists = np.asarray(batch.column(0)), batch.column(1)
            flat, ends = np.asarray(lists.values), np.asarray(lists.offsets)
            size = np.diff(ends)
            for dims in np.unique(size).tolist():
                at = np.flatnonzero(size == dims)
                data = flat[ends[at][:, None] + np.arange(dims)]
                while len(at):
                    held = open_.setdefault(dims, ([], []))
                    room = most - sum(map(len, held[0]))
                    held[0].append(ids[at[:room]]), held[1].append(data[:room])
                    at, data = at[room:], data[room:]
                    if sum(map(len, held[0])) == most:
                        yield block(dims)
        for dims in list(open_):
            yield block(dims)

    return rows.mapInArrow(run, "dims long, task long, nth long, ids binary, kind string, data binary")


class Search:
    """The best k of the candidates streamed past one query block."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, k: int):
        self.ids, self.data, self.k = ids, data, k
        self.largest = float(np.abs(data).max(initial=0))
        #: For each query: scores and ids of its best so far, best first.
        self.best = [(np.empty(0), np.empty(0, np.int64)) for _ in ids]

    def feed(self, ids: np.ndarray, data: np.ndarray) -> None:
        if float(np.abs(data).max(initial=0)) * self.largest * len(data) >= _EXACT:
            return self._feed_large(ids, data)
        mass = (data**2).sum(axis=0)
        for q in range(0, len(self.ids), TOGETHER):
            self._feed(slice(q, q + TOGETHER), ids, data, mass)

    def _feed(self, some: slice, ids: np.ndarray, data: np.ndarray, left: np.ndarray) -> None:
        query, dims = self.data[:, some], len(data)
        power = query**2
        order = np.argsort(-power.sum(axis=1), kind="stable")
        least = np.array([s[-1] if len(s) == self.k else -np.inf for s, _ in self.best[some]])
        rest, part = power.sum(axis=0), np.zeros((query.shape[1], len(ids)))
        for k in range(0, dims, STEP):
            block = order[k : k + STEP]
            rows = data[block]
            part += query[block].T @ rows
            if k + STEP >= dims or not np.isfinite(least).all():
                continue
            rest = np.maximum(rest - power[block].sum(axis=0), 0)
            left = left - (rows**2).sum(axis=0)
            # Scores are whole numbers: a slack below 1 covers the rounding of the bound.
            reach = part + np.sqrt(rest)[:, None] * np.sqrt(np.maximum(left, 0)) + 1e-2 + 1e-9 * np.abs(part) >= least[:, None]
            alive = np.flatnonzero(reach.any(axis=0))
            if not len(alive):
                return
            if len(alive) < 0.8 * len(ids):
                ids, data, left, part = ids[alive], data[:, alive], left[alive], part[:, alive]
        good = part >= least[:, None]
        for q in np.flatnonzero(good.any(axis=1)):
            at = np.flatnonzero(good[q])
            at = at[ids[at] != self.ids[some.start + q]]
            self._keep(some.start + q, part[q, at], ids[at])

    def _keep(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 4 * self.k:  # all that reach the k-th best of them
            reach = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[reach], ids[reach]
        scores, ids = np.concatenate([self.best[q][0], scores]), np.concatenate([self.best[q][1], ids])
        first = np.lexsort((ids, -scores))[: self.k]
        self.best[q] = scores[first], ids[first]

    def _feed_large(self, ids: np.ndarray, data: np.ndarray) -> None:
        whole = [[int(x) for x in column] for column in data.T]
        for q, query in enumerate(self.data.T):
            ints = [int(x) for x in query]
            scored = [(max(-_LONG - 1, min(_LONG, sum(map(int.__mul__, ints, v)))), i) for v, i in zip(whole, ids.tolist(), strict=True) if i != self.ids[q]]
            scored += [(int(s), int(i)) for s, i in zip(*self.best[q], strict=True)]
            scored.sort(key=lambda x: (-x[0], x[1]))
            self.best[q] = np.array([s for s, _ in scored[: self.k]], object), np.array([i for _, i in scored[: self.k]], np.int64)

    def rows(self, block: int) -> pa.RecordBatch:
        n = [len(i) for _, i in self.best]
        row = np.repeat(np.arange(len(n)) + (block << 32), n)
        scores = [int(s) for s, _ in self.best for s in s] if any(s.dtype == object for s, _ in self.best) else np.concatenate([s for s, _ in self.best] or [np.empty(0)]).astype(np.int64)
        ids = np.concatenate([i for _, i in self.best] or [np.empty(0, np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n)), pa.array(row), pa.array(ids), pa.array(scores, pa.int64())], names=["query_id", "query_row", "vec_id", "score"])


def _chunks(blocks: list[tuple]) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of blocks (dims, task, nth, bytes) of one length that are broadcast together, each with the
    number of its first block."""
    at = 0
    while at < len(blocks):
        end, size = at + 1, blocks[at][3]
        while end < len(blocks) and blocks[end][0] == blocks[at][0] and size + blocks[end][3] <= CHUNK_BYTES:
            size += blocks[end][3]
            end += 1
        yield at, blocks[at:end]
        at = end


def _search(spark: SparkSession, asked: DataFrame, chunk: list[tuple], first: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What finds, in a task's candidate blocks, the best k for each query of the chunk's blocks."""
    dims = chunk[0][0]
    wanted = F.struct("task", "nth").isin([F.struct(F.lit(t).cast("long"), F.lit(n).cast("long")) for _, t, n, _ in chunk])
    rows = {(r.task, r.nth): (r.ids, r.kind, r.data) for r in asked.where(F.col("dims") == dims).where(wanted).collect()}
    told = spark.sparkContext.broadcast([rows[t, n] for _, t, n, _ in chunk])

    def unpacked(ids: bytes, kind: str, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        numbers = np.frombuffer(ids, np.int64)
        return numbers, np.frombuffer(data, kind).reshape(dims, len(numbers)).astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = None
        for batch in batches:
            for own, ids, kind, data in zip(*(batch.column(c).to_pylist() for c in ("dims", "ids", "kind", "data")), strict=True):
                if own != dims:
                    continue
                if searches is None:
                    searches = [Search(*unpacked(*block), k) for block in told.value]
                numbers, columns = unpacked(ids, kind, data)
                for search in searches:
                    search.feed(numbers, columns)
        for n, search in enumerate(searches or []):
            yield search.rows(first + n)

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query row's k best candidates."""
    q = stored(taking_part(queries), "top-queries")
    # Round robin: equal blocks whatever the ids are.
    asked = stored(_packed(q.repartition(max(1, math.ceil(q.count() * 1.1 / QUERY_ROWS))), QUERY_ROWS, scale), "top-query-blocks")
    given = stored(_packed(taking_part(candidates), CANDIDATE_ROWS, scale), "top-blocks")
    # A row for every QUERY_ROWS queries, which says what is broadcast when.
    named = asked.select("dims", "task", "nth", F.length("data").alias("bytes")).orderBy("dims", "task", "nth").collect()
    spark, found = q.sparkSession, None
    for first, chunk in _chunks([(r.dims, r.task, r.nth, r.bytes) for r in named]):
        met = stored(given.mapInArrow(_search(spark, asked, chunk, first, k), "query_id long, query_row long, vec_id long, score long"), "top-found")
        found = met if found is None else found.unionByName(met)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank: Column = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
