"""WARC archives and their Merkle fixity audit.

Pages become WARC response records, laid out in archives at ordered offsets. For each replica of
an archive, records are hashed, the digests of the records that start in one offset range make a
leaf, and FANOUT neighbouring nodes make a node of the next level, up to a root. Two replicas are
compared from the roots down: only children of mismatching nodes are joined, so the records of
sound ranges are never compared, and the damage is located record by record.

Nulls: null html or url is empty in the record; a null page_id is kept. Rows that give the same
record are stored once, with their number (copies). An empty table gives no archives and no
findings. Very long pages are records like others (a range holds at least the record that starts
in it). Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bytes of an archive (about), and of a leaf's offset range; children of a node.
ARCHIVE_BYTES = 1 << 30
RANGE_BYTES = 1 << 20
FANOUT = 16


def record_text(page_id: str = "page_id", url: str = "url", html: str = "html") -> Column:
    """The whole WARC record of a page."""
    name = F.md5(F.concat_ws("|", F.col(page_id).cast("string"), F.col(url)).cast("binary"))
    uuid = F.concat_ws("-", F.substring(name, 1, 8), F.substring(name, 9, 4), F.substring(name, 13, 4), F.substring(name, 17, 4), F.substring(name, 21, 12))
    body = F.coalesce(F.col(html), F.lit(""))
    head = ["WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:", uuid, ">\r\nWARC-Target-URI: ", F.coalesce(F.col(url), F.lit("")), "\r\nContent-Type: text/html\r\nContent-Length: ", F.octet_length(body).cast("string"), "\r\n\r\n"]
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in head], body, F.lit("\r\n\r\n"))


def laid_out(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """records (page_id, digest, length, ...), each once, with archive, offset and copies.

    The archive is a prefix of the digest, long enough for archives of about archive_bytes, so
    they are equally large whatever the keys are; in it records follow each other by page_id.
    """
    once = records.groupBy(*records.columns).agg(F.count(F.lit(1)).alias("copies"))
    total = once.agg(F.sum("length")).first()[0] or 0
    digits = max(1, math.ceil(math.log(max(total, 1) / archive_bytes, 16)))
    order = Window.partitionBy("archive").orderBy(F.col("page_id").asc_nulls_first(), "digest")
    rows = once.withColumn("archive", F.substring("digest", 1, digits))
    return rows.withColumn("offset", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))


def _hash_of(*columns: str) -> Column:
    """sha256 over the group's rows in the order of the columns."""
    rows = F.sort_array(F.collect_list(F.struct(*columns)))
    text = F.array_join(F.transform(rows, lambda r: F.concat_ws(":", *[r[c].cast("string") for c in columns])), ";")
    return F.sha2(text.cast("binary"), 256)


def merkle_tree(replica: DataFrame, levels: int) -> DataFrame:
    """(level, archive, node, hash) of a replica's records (archive, offset, length, digest):
    offset ranges are level 0, and every level above joins FANOUT neighbours."""
    of_range = F.floor(F.col("offset") / RANGE_BYTES).cast("long")
    level = replica.groupBy("archive", of_range.alias("node")).agg(_hash_of("offset", "length", "digest").alias("hash"))
    tree = stored(level.withColumn("level", F.lit(0)), "merkle")
    level = tree
    for k in range(1, levels):
        above = F.floor(F.col("node") / FANOUT).cast("long")
        level = level.withColumn("above", above).groupBy("archive", "above").agg(_hash_of("node", "hash").alias("hash")).select("archive", F.col("above").alias("node"), "hash", F.lit(k).alias("level"))
        tree = tree.unionByName(level)
    return stored(tree, "merkle")


def _mismatching(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys whose values differ, or that one side lacks."""
    of = [F.col(f"b_{k}") for k in key]
    right = b.select(*[F.col(k).alias(f"b_{k}") for k in key], F.col(value).alias("b_value"))
    same = [F.col(k) == o for k, o in zip(key, of, strict=True)]
    both = a.select(*key, value).join(right, same, "full").where(~F.col(value).eqNullSafe(F.col("b_value")))
    return both.select(*[F.coalesce(k, o).alias(k) for k, o in zip(key, of, strict=True)], value, "b_value")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Where two replicas (archive, offset, length, digest) differ: archive, offset, length and
    digest of the primary's record, replica_digest, and status: corrupt, missing (in the
    replica) or foreign (not in the primary)."""
    end = primary.unionByName(replica).agg(F.max("offset")).first()[0]
    levels, top = 1, (end or 0) // RANGE_BYTES
    while top:
        levels, top = levels + 1, top // FANOUT
    trees = [merkle_tree(r, levels) for r in (primary, replica)]
    branches = None
    for k in reversed(range(levels)):
        sides = [t.where(F.col("level") == k) for t in trees]
        if branches is not None:  # only children of what mismatches
            parents = branches.select(F.col("archive").alias("p_archive"), F.col("node").alias("p_node"))
            sides = [s.join(parents, (F.col("archive") == F.col("p_archive")) & (F.floor(F.col("node") / FANOUT) == F.col("p_node")), "left_semi") for s in sides]
        branches = _mismatching(*sides, ["archive", "node"], "hash")
    ranges = stored(branches.select(F.col("archive").alias("p_archive"), F.col("node").alias("p_node")), "merkle-damage")
    of_range = (F.col("archive") == F.col("p_archive")) & (F.floor(F.col("offset") / RANGE_BYTES) == F.col("p_node"))
    sides = [r.withColumn("record", F.struct("length", "digest")).join(ranges, of_range, "left_semi") for r in (primary, replica)]
    found = _mismatching(*sides, ["archive", "offset"], "record")
    status = F.when(F.col("b_value").isNull(), "missing").when(F.col("record").isNull(), "foreign").otherwise("corrupt")
    return found.select("archive", "offset", F.col("record.length").alias("length"), F.col("record.digest").alias("digest"), F.col("b_value.digest").alias("replica_digest"), status.alias("status"))


def replicas(pages: DataFrame) -> DataFrame:
    """The pages' records at their places, as the primary holds them (digest) and as a damaged
    copy does (copy_digest). The damage goes by the first 24 bits of md5(page_id): where they are
    a multiple of 61 the record's last byte is altered, where they leave 7 by 211 it is lost
    (null)."""
    text = record_text()
    bits = F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("x")).cast("binary")), 1, 6), 16, 10).cast("long")
    altered = F.concat(text.substr(F.lit(1), F.length(text) - 1), F.lit("!"))
    copy = F.when(bits % 211 == 7, None).when(bits % 61 == 0, F.sha2(altered.cast("binary"), 256)).otherwise(F.sha2(text.cast("binary"), 256))
    rows = pages.select("page_id", F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).cast("long").alias("length"), copy.alias("copy_digest"))
    return stored(laid_out(rows), "warc-records")


def damage(pages: DataFrame) -> DataFrame:
    """page_id and the audit's finding for every damaged record of the copy."""
    rows = replicas(pages)
    primary = rows.select("archive", "offset", "length", "digest")
    copy = rows.where("copy_digest is not null").select("archive", "offset", "length", F.col("copy_digest").alias("digest"))
    found = audit(primary, copy)
    named = rows.select("page_id", "copies", F.col("archive").alias("of_archive"), F.col("offset").alias("of_offset"))
    return found.join(named, (F.col("archive") == F.col("of_archive")) & (F.col("offset") == F.col("of_offset"))).select("page_id", "archive", "offset", "length", "digest", "replica_digest", "status", "copies")
