"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a queue of its documents in a shuffled, fixed order, repeated up to `repeats`
times. A copy's virtual finish time is the source's words up to its end divided by the source's
target, so all queues drain at rates in proportion to their targets, and the budget (the sum of
the targets, which is the sum of all sizes) is spent at virtual time 1. Documents longer than a
quantum (a fixed share of the budget) are served in quanta of that many words. All quanta that
begin before virtual time 1 are sorted globally by finish time, and the running total over that
order cuts them where the budget is spent. A source's words are served in the order of its queue,
so what the cut leaves of each source says what it takes of each document: a source misses its
target by less than a quantum for every source.

No group is gathered anywhere: a source's running word count is a two-pass prefix sum, first
within buckets of about BUCKET_ROWS documents (as many per source as it needs), then over the
bucket totals. A source that holds a third of all rows only has more buckets.

Nulls: a null text has size 0; a null source is a source of its own, last in order; a null
doc_id is kept. Size 0 documents take 0 words. Repeated rows are documents of their own; ties in
the shuffle order go to the smaller doc_id, then the smaller size. An empty table gives an empty
mix. Columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small, stored

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: A document appears at most so often in the mix.
REPEATS = 3
#: Documents of one bucket of the prefix sums, and quanta that the budget is divided into.
BUCKET_ROWS = 4096
QUANTA = 1 << 17


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key() -> Column:
    """First 32 bits of md5 of the doc_id's text: the same order in every run and every engine."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per source: source_size, docs and target, nth (its place by name), and the sums total
    of all sizes and all_docs.

    Targets share the sum of all sizes by weight; none exceeds repeats times its source's size,
    and the excess is shared again by weight. That fixed point is min(cap, level * weight), and
    the level is the first (total - caps below) / (weights above) in order of cap / weight that
    does not exceed the next cap / weight.
    """
    # A row per source: the windows below order the list of sources, never the documents.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "nth")
    everything = Window.partitionBy()
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    s = s.withColumn("nth", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - (F.sum("cap").over(by_ratio) - F.col("cap"))) / (F.sum("weight").over(everything) - (F.sum("weight").over(by_ratio) - F.col("weight"))))
    s = s.withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "nth"))).over(everything))
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_docs", F.sum("docs").over(everything))
    return s.select("source", "source_size", "docs", "nth", "total", "all_docs", F.least(F.col("cap").cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def queued(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, bucket_rows: int = BUCKET_ROWS, carry: bool = False) -> DataFrame:
    """Every document with its place in its source's queue: doc_id, source, size, source_size,
    target, nth, total, all_docs, bucket, pos and end (words of the queue up to and with this
    document); with carry also doc, a struct of all columns of docs."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select("doc_id", "source", word_count("text").alias("size"), shuffle_key().alias("key"), *[whole][: int(carry)])
    sized = stored(rows.drop("doc"), "mix-sizes")
    sources = small(targets(sized, weights, repeats).withColumnRenamed("source", "of_source"))
    of_source = F.col("source").eqNullSafe(F.col("of_source"))
    bucket = F.shiftright(F.col("key") * F.ceil(F.col("docs") / bucket_rows), 32)
    before = Window.partitionBy("at_source").orderBy("at_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = sized.join(sources, of_source).groupBy(F.col("source").alias("at_source"), bucket.alias("at_bucket")).agg(F.sum("size").alias("words"))
    totals = small(totals.select("at_source", "at_bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead")))
    within = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "size")
    rows = (rows if carry else sized).join(sources, of_source).withColumn("bucket", bucket)
    rows = rows.withColumn("pos", F.row_number().over(within)).withColumn("end", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(totals, F.col("source").eqNullSafe(F.col("at_source")) & (F.col("bucket") == F.col("at_bucket")))
    return rows.withColumn("end", F.col("end") + F.col("ahead")).drop("of_source", "docs", "at_source", "at_bucket", "ahead", "key")


def in_order(rows: DataFrame, repeats: int = REPEATS, quanta: int = QUANTA, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The quanta of queued() that begin before virtual time 1, globally sorted by finish: nth (of
    the source), finish, words, budget and spent (words of all quanta up to and with this one).

    The running total is a two-pass prefix sum over slices of virtual time, into which the range
    sort deals the quanta: in each, queues drain by the same share.
    """
    quantum = F.greatest(F.lit(1), F.ceil(F.col("total") / quanta))
    copy = rows.where("size > 0 and target > 0").withColumn("copy", F.explode(F.array(*[F.lit(k) for k in range(repeats)])))
    copy = copy.withColumn("first", F.col("copy") * F.col("source_size") + F.col("end") - F.col("size")).where("first < target").withColumn("quantum", quantum)
    parts = copy.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.col("quantum"))))
    parts = parts.withColumn("words", F.least("quantum", F.col("size") - F.col("at"))).where(F.col("first") + F.col("at") < F.col("target"))
    finish = (F.col("first") + F.col("at") + F.col("words")) / F.col("target")
    parts = parts.select("nth", finish.alias("finish"), "words", F.col("total").alias("budget"), F.floor(finish * (64 + F.floor(F.col("all_docs") / bucket_rows))).alias("slice"))
    parts = stored(parts.repartitionByRange("slice").sortWithinPartitions("slice", "finish", "nth"), "mix-order")
    # A row per slice, a list as long as the documents are buckets, itself in groups.
    sums = parts.groupBy("slice").agg(F.sum("words").alias("w")).withColumn("group", F.floor(F.col("slice") / 1024))
    before = lambda w: F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sums.groupBy("group").agg(F.sum("w").alias("w")).select(F.col("group").alias("of_group"), before(Window.orderBy("group")).alias("ahead"))
    sums = sums.join(small(groups), F.col("group") == F.col("of_group")).select(F.col("slice").alias("of_slice"), (F.col("ahead") + before(Window.partitionBy("group").orderBy("slice"))).alias("ahead"))
    parts = parts.repartitionByRange("slice").withColumn("spent", F.sum("words").over(Window.partitionBy("slice").orderBy("finish", "nth").rowsBetween(Window.unboundedPreceding, 0)))
    return parts.join(small(sums), F.col("slice") == F.col("of_slice")).select("nth", "finish", "words", "budget", (F.col("spent") + F.col("ahead")).alias("spent"))


def served(ordered: DataFrame) -> DataFrame:
    """(of_nth, served): words that each source gets before the running total reaches the budget."""
    words = F.greatest(F.lit(0), F.least("words", F.col("budget") - (F.col("spent") - F.col("words"))))
    return ordered.groupBy(F.col("nth").alias("of_nth")).agg(F.sum(words).cast("long").alias("served"))


def copies(rows: DataFrame, served: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """A row per copy that the queues hold: the columns of queued() and copy (from 0), finish
    (virtual finish time; null if the target is 0) and words (what the mix takes of the copy: its
    size, less for the copy in service at the cut, 0 beyond it)."""
    rows = rows.join(small(served), F.col("nth") == F.col("of_nth"), "left")
    rows = rows.withColumn("copy", F.explode(F.array(*[F.lit(k) for k in range(repeats)])))
    end = F.col("copy") * F.col("source_size") + F.col("end")
    left = F.coalesce("served", F.lit(0)) - (end - F.col("size"))
    rows = rows.withColumn("finish", F.when(F.col("target") > 0, end / F.col("target")))
    return rows.withColumn("words", F.greatest(F.lit(0), F.least("size", left)).cast("long")).drop("of_nth", "served")


def by_finish(rows: DataFrame) -> DataFrame:
    order = [F.col("finish").asc_nulls_last(), F.col("nth").asc(), F.col("bucket").asc(), F.col("pos").asc()]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, quanta: int = QUANTA, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All copies, each with the words that the mix takes of it."""
    rows = stored(queued(docs, weights, repeats, bucket_rows), "mix-queues")
    return copies(rows, stored(served(in_order(rows, repeats, quanta, bucket_rows)), "mix-served"), repeats)


def taken(docs: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) of
    every document."""
    rows = stored(queued(docs, repeats=repeats), "mix-queues")
    rows = rows.join(small(stored(served(in_order(rows, repeats)), "mix-served")), F.col("nth") == F.col("of_nth"), "left")
    left = lambda k: F.coalesce("served", F.lit(0)) - (F.col("source_size") * k + F.col("end") - F.col("size"))
    words = sum((F.greatest(F.lit(0), F.least("size", left(k))) for k in range(repeats)), F.lit(0))
    return rows.select("doc_id", "size", "source_size", "target", words.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """docs in the order of the mix, with its columns: every copy of which the mix takes at
    least half of the words, whole; a document without words is not in the mix."""
    got = stored(served(in_order(stored(queued(docs, weights, repeats), "mix-queues"), repeats)), "mix-served")
    kept = copies(queued(docs, weights, repeats, carry=True), got, repeats).where("size > 0 and words * 2 >= size")
    return by_finish(kept.select("doc", "finish", "nth", "bucket", "pos")).select("doc.*")
