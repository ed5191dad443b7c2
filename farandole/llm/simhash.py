"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints link at RADIUS = 3 or fewer differing bits. 64 bits are cut into three blocks. If
two fingerprints differ in three bits, some block holds one of them; without it, two remain, and
then one variant lies within one flip of both. So every distinct fingerprint emits, for each
block left out, itself and all its one-flip variants on the other bits: 131 keys. Equal keys
meet in a shuffle, and each meeting is verified on the 64 bits. No link can be missed, and none
between linked fingerprints is emitted twice over: a key's links are cut to a spanning forest.

A key that more than MEETING fingerprints share (a dense family of near copies) isn't compared
pairwise: its fingerprints go the exact way for dense families, balls on all 64 bits. There
fingerprints of even parity emit all variants within one flip and odd ones all within two, so
whatever meets at a variant together with an even one is linked to it, and a star of links is
enough; such a ball never holds more than 65 + 2081 fingerprints.

The pipeline's stage (without_near_duplicates) has a rule of its own: five-word shingles of a
Jaccard similarity of 0.8. Ball hashing of the texts' fingerprints gives its first candidates; as
fingerprints miss part of such pairs, prefix filtering adds the rest and makes them complete: texts
as similar as that share one of the first fifth of their shingles in a common order. Each
candidate pair that isn't connected yet and that its bitmaps allow is verified on whole sets.

Exact copies share a fingerprint, and everything above runs on distinct fingerprints. Groups are
the connected components of the links.

Nulls: a null text has no words, as an empty one has: fingerprint zero, linked like any other.
A null doc_id is kept and never is the smallest of its group, unless all are null. Repeated rows
are linked as exact copies. An empty table gives no rows. Columns other than doc_id and text are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, small, stored, text_bytes
from .components import components

RADIUS = 3
#: Words of a shingle: 3 by the query's contract; the pipeline takes 5.
SHINGLE = 3
SEED = 42
#: Fingerprints of a key that are compared with each other; beyond it the exact way for dense
#: families is taken.
MEETING = 64
#: Slots that tell common shingles, and how many shingles of each on average make COMMON the count from
#: which a slot is common; larger tables raise it in proportion.
SLOTS, LOAD, COMMON = 1 << 21, 2, 8
#: 64-bit numbers of a text's parity bitmap, and at most those of the wide one of a large set.
BITMAP, WIDEST = 8, 512
#: Pairs of one text that a task verifies.
VERIFIED = 1024
#: How many times as many texts of a meeting each further round compares with the others, and members
#: of a meeting that are ranked together.
HUBS, RANKED = 64, 4096
#: Tokens, numbers of 8 bytes, that are broadcast at most.
MET_ROWS = 500_000
#: Bytes of text that are hashed together.
HASHED_BYTES = 1 << 20
#: First bit and number of bits of the blocks of which one is left out.
BLOCKS = ((0, 21), (21, 21), (42, 22))


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a whole text."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()  # of bytes: A-Z, and white space 0x20 and 0x09-0x0D
    if not w:
        return 0
    shingles = [b" ".join(x) for x in zip(*(w[k:] for k in range(words)), strict=False)] or [b" ".join(w)]
    h = np.fromiter((xxh64_intdigest(x, SEED) for x in shingles), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id and fp of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fp = pa.array([fingerprint(x, words) for x in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def _emitted(fps: DataFrame) -> DataFrame:
    """Each fingerprint's 131 keys: (key, fp). Keys of a block are its fingerprint with the block's
    bits replaced by the block's number, as it is and with each other bit flipped."""
    first, keep, flip, tag = 0, F.lit(0), F.lit(0), F.lit(0)
    for n, (low, bits) in enumerate(BLOCKS):
        last = first + 64 - bits
        here = F.col("v").between(first, last)
        k = F.col("v") - (first + 1)
        bit = F.when(k < low, k).otherwise(k + bits)
        mask = ~(((1 << bits) - 1) << low) & (1 << 64) - 1
        keep = F.when(here, F.lit(_signed(mask)).cast("long")).otherwise(keep)
        flip = F.when(here, F.when(k < 0, F.lit(0).cast("long")).otherwise(_bit(bit))).otherwise(flip)
        tag = F.when(here, F.lit(n << low).cast("long")).otherwise(tag)
        first = last + 1
    keys = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(first - 1))).alias("v"))
    return keys.select(F.col("fp").bitwiseAND(keep).bitwiseXOR(flip).bitwiseXOR(tag).alias("key"), "fp")


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links that join what earlier ones leave apart."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            above[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _linked(radius: int, most: int):
    """For rows (key, fp) in order of key: links (a, b), and (fp, null) for members of a key
    with more than so many. At most one key's `most` rows are kept from one batch to the next."""

    def links(key: np.ndarray, fp: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[starts, len(key)])
        dense = np.repeat(size > most, size)
        a, b, of = [], [], []
        alive = np.flatnonzero(np.repeat(size > 1, size) & ~dense)
        run = np.repeat(np.arange(len(starts)), size)
        for d in range(1, most):
            alive = alive[alive + d < len(key)]
            alive = alive[run[alive + d] == run[alive]]
            if not len(alive):
                break
            near = alive[np.bitwise_count((fp[alive] ^ fp[alive + d]).view(np.uint64)) <= radius]
            a.append(fp[near]), b.append(fp[near + d]), of.append(run[near])
        if a:
            a, b, of = map(np.concatenate, (a, b, of))
            many = size[of] > 2
            pairs = [np.stack([a[~many], b[~many]], axis=1)]
            order = np.argsort(of[many], kind="stable")
            am, bm, om = a[many][order], b[many][order], of[many][order]
            cuts = np.flatnonzero(np.r_[True, om[1:] != om[:-1]]) if len(om) else []
            for i, j in zip(cuts, [*cuts[1:], len(om)], strict=True) if len(om) else ():
                pairs.append(np.array(_forest(am[i:j], bm[i:j]), np.int64).reshape(-1, 2))
            return pairs, fp[dense]
        return [], fp[dense]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, known = np.empty(0, np.int64), np.empty(0, np.int64), None

        def rows(pairs: list[np.ndarray], dense: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = np.concatenate([*pairs, np.stack([dense, dense], axis=1)]) if pairs or len(dense) else np.empty((0, 2), np.int64)
            if len(found):
                none = np.r_[np.zeros(len(found) - len(dense), bool), np.ones(len(dense), bool)]
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1], mask=none)], names=["a", "b"])

        for batch in batches:
            new_key, new_fp = (np.asarray(c) for c in batch.columns)
            if known is not None:  # more of a dense key whose first rows are out already
                more = int(np.searchsorted(new_key, known, "right"))
                yield from rows([], new_fp[:more])
                new_key, new_fp = new_key[more:], new_fp[more:]
                if not len(new_key):
                    continue
                known = None
            key, fp = np.r_[key, new_key], np.r_[fp, new_fp]
            last = int(np.searchsorted(key, key[-1], "left"))
            if len(key) - last > most:
                yield from rows(*links(key, fp))
                known, key, fp = key[-1], key[:0], fp[:0]
            elif last:
                yield from rows(*links(key[:last], fp[:last]))
                key, fp = key[last:], fp[last:]
        if len(key):
            yield from rows(*links(key, fp))

    return run


def _dense_links(fps: DataFrame) -> DataFrame:
    """All links between the given fingerprints, as stars around the variants where they meet."""
    odd = F.bit_count("fp") % 2 == 1
    # 0 is the fingerprint itself, 1 to 64 flip one bit, 65 to 2080 flip bits j < k.
    balls = fps.select("fp", odd.alias("odd"), F.explode(F.sequence(F.lit(0), F.when(odd, 2080).otherwise(64))).alias("v"))
    pair = F.col("v") - 65
    k = F.floor((F.sqrt(pair * 8 + 1) + 1) / 2).cast("int")
    flip = F.when(F.col("v") == 0, F.lit(0).cast("long")).when(F.col("v") <= 64, _bit(F.col("v") - 1)).otherwise(_bit(k).bitwiseOR(_bit((pair - k * (k - 1) / 2).cast("int"))))
    met = balls.select("fp", "odd", F.when(F.col("v") == 0, 0).when(F.col("v") <= 64, 1).otherwise(2).alias("r"), F.col("fp").bitwiseXOR(flip).alias("key"))
    hubs = met.groupBy(F.col("key").alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(~F.col("odd"), F.col("fp"))).alias("even"), F.min(F.when(F.col("r") < 2, F.col("fp"))).alias("near")).where("n > 1")
    joined = met.join(hubs, F.col("key") == F.col("at"))
    return joined.select(F.col("fp").alias("a"), F.when(F.col("even").isNotNull(), F.col("even")).when(F.col("r") < 2, F.col("near")).alias("b")).where("a <> b").distinct()


def links(fps: DataFrame, radius: int = RADIUS, most: int = MEETING) -> DataFrame:
    """(a, b): links between the distinct fingerprints of fps, enough to connect what is linked."""
    met = _emitted(fps.select("fp").distinct()).repartition("key").sortWithinPartitions("key", "fp")
    met = stored(met.mapInArrow(_linked(radius, most), "a long, b long"), "simhash-links")
    dense = met.where("b is null").select(F.col("a").alias("fp")).distinct()
    return met.where("b is not null").unionByName(stored(_dense_links(dense), "simhash-dense"))


def groups(rows: DataFrame, radius: int = RADIUS, most: int = MEETING) -> DataFrame:
    """(fp, component) for each fingerprint of rows that is linked to another one."""
    return components(links(rows, radius, most)).toDF("fp", "component")


def near_duplicates(rows: DataFrame, radius: int = RADIUS, most: int = MEETING) -> DataFrame:
    """(fp, component_id): for each distinct fingerprint of rows (doc_id, fp), the smallest doc_id
    of its group."""
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = first.join(groups(rows, radius, most).withColumnRenamed("fp", "of"), F.col("fp") == F.col("of"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    ids = linked.groupBy(F.col("component").alias("in")).agg(F.min("first").alias("component_id"))
    return linked.join(ids, F.col("component") == F.col("in")).select(F.col("fp").alias("of_fp"), "component_id")


def near_duplicate_ids(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every document."""
    rows = stored(fingerprints(docs), "simhash")
    found = rows.join(near_duplicates(rows), F.col("fp") == F.col("of_fp"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _mixer(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, np.uint64) | np.uint64(1)


_OF_BYTE, _OF_PLACE = _mixer(256, 1), _mixer(1024, 2)
_FACTOR = np.uint64(0x7FB5D329728EA185)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _FACTOR
    return h ^ (h >> np.uint64(29))


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and how many words each has."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    blank = _BLANK[data]
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    own = _OF_BYTE[data]
    own[blank] = 0
    place = np.arange(len(data))
    place[starts[0] :] -= np.repeat(starts, np.diff(np.r_[starts, len(data)]))
    own *= _OF_PLACE[place & 1023] + (place >> 10).astype(np.uint64) * _FACTOR
    return _mixed(np.add.reduceat(own, starts)), np.diff(np.searchsorted(starts, np.r_[0, ends]))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; one of a text with fewer words."""
    h, counts = _word_hashes(texts)
    whole = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        whole = _mixed(whole ^ h[k : k + len(whole)])
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(whole[at : at + n - words + 1].view(np.int64)))
        else:
            one = np.full(1, n, np.uint64)
            for k in range(at, at + n):
                one = _mixed(one ^ h[k : k + 1])
            out.append(one.view(np.int64))
        at += n
    return out


def _each(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """shingle_sets of the texts of a column, some texts at a time."""
    some, size = [], 0
    for t in column.to_pylist():
        some.append(t)
        size += len(t)
        if size >= HASHED_BYTES:
            yield from shingle_sets(some, words)
            some, size = [], 0
    yield from shingle_sets(some, words)


def _set_fingerprint(own: np.ndarray) -> int:
    """The signed 64-bit SimHash of a set of hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(own), 1 << 16):
        ones += np.unpackbits(own[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view(np.int64)[0])


def _bitmap(own: np.ndarray, longs: int = BITMAP) -> np.ndarray:
    """Parities of how many of the hashes fall on each of 64 * longs bits: two sets' bitmaps differ
    in no more bits than the sets differ in members."""
    bits = np.bincount((own.view(np.uint64) >> np.uint64(33)).astype(np.int64) % (64 * longs), minlength=64 * longs) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _wide(own: np.ndarray) -> np.ndarray | None:
    """The bitmap of a large set, about a bit for each member; null where BITMAP is enough."""
    longs = 1 << max(0, (len(own) - 1) // 64).bit_length()
    return _bitmap(own, min(longs, WIDEST)) if longs > BITMAP else None


def least_shared(size: int, similarity: float) -> int:
    """Shingles that a set of that size shares at least with any set as similar as the bound."""
    return int(np.ceil(similarity * size - 1e-9))


def _common(told: DataFrame, texts: DataFrame, words: int) -> bytes:
    """For each of SLOTS hash slots a level: the binary logarithm of how often shingles fall into it,
    if often, else 0. All texts are counted; what counts as often grows with them, as if LOAD fell into each
    slot on average. It only puts common shingles last, and any levels give the same results."""
    total = (texts.agg(F.sum("bytes")).first()[0] or 0) // 6
    load = max(1, int(total / (LOAD * SLOTS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in sliced(batches):
            for own in _each(batch.column(0), words):
                counts[np.unique(own & (SLOTS - 1))] += 1
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(counts[slots])], names=["slot", "n"])

    counted = told.select("text").mapInArrow(run, "slot int, n long")
    heavy = counted.groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON * load).select("slot", F.floor(F.log2(F.col("n") / load)).cast("int").alias("level")).toPandas()
    levels = np.zeros(SLOTS, np.uint8)
    levels[heavy["slot"].to_numpy(np.int64)] = heavy["level"].to_numpy(np.uint8)
    return levels.tobytes()


def _measured(told: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """For each row of told: id, size (of its set), fp, bits and wide (bitmaps), rare and common:
    together the first size - least_shared + 1 of its shingles, common ones last. Two sets as similar
    as the bound share one of them, in any common order."""
    levels = told.sparkSession.sparkContext.broadcast(_common(told, texts, words))
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, np.uint8)
        for batch in sliced(batches):
            sizes, fps, bits, wide, rare, common = [], [], [], [], [], []
            for own in _each(batch.column(1), words):
                of = level[own & (SLOTS - 1)]
                order = np.argsort(of, kind="stable")[: len(own) - least_shared(len(own), similarity) + 1]
                sizes.append(len(own)), fps.append(_set_fingerprint(own)), bits.append(_bitmap(own)), wide.append(_wide(own))
                first, cut = own[order], int(np.count_nonzero(of[order] == 0))
                rare.append(first[:cut]), common.append(first[cut:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), *[pa.array(x, longs) for x in (bits, wide, rare, common)]], names=["id", "size", "fp", "bits", "wide", "rare", "common"])

    rows = told.select("id", "text").mapInArrow(run, "id long, size int, fp long, bits array<long>, wide array<long>, rare array<long>, common array<long>")
    return stored(rows, "near-measured")


def _meetings(measured: DataFrame) -> DataFrame:
    """(token, id, size, bits, wide, nth) of texts that share a token; of the tokens at which the same texts
    meet, one is kept. Texts of a token are numbered in buckets of about RANKED, so no group is
    gathered."""
    tokens = lambda c: measured.select(F.explode(c).alias("token"), "id")
    # Rare tokens have few texts, which one shuffle brings together; common ones are combined first.
    of = Window.partitionBy("token")
    rare = tokens("rare").withColumns({"low": F.min("id").over(of), "high": F.max("id").over(of)}).where("low < high").select("token", "id")
    common = tokens("common")
    met = common.groupBy("token").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select(F.col("token").alias("of_token"))
    common = common.join(small(stored(met, "near-tokens"), MET_ROWS), F.col("token") == F.col("of_token"), "left_semi")
    rows = stored(rare.distinct().unionByName(common.distinct()), "near-members")
    mark, half = F.xxhash64("id"), F.lit((1 << 32) - 1)
    told = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.sum(mark.bitwiseAND(half)).alias("x"), F.sum(F.shiftrightunsigned(mark, 32)).alias("y"))
    kept = stored(told.groupBy("n", "low", "high", "x", "y").agg(F.min("token").alias("kept")).select("kept", F.ceil(F.col("n") / RANKED).alias("buckets")), "near-kept")
    rows = rows.join(small(kept, MET_ROWS), F.col("token") == F.col("kept")).withColumn("bucket", F.pmod(mark, F.col("buckets")))
    rows = stored(rows.withColumn("nth", F.row_number().over(Window.partitionBy("token", "bucket").orderBy("id"))).drop("kept"), "near-ranked")
    # A row per bucket: what orders them is the list of a token's buckets, never its members.
    ahead = Window.partitionBy("in_token").orderBy("in_bucket").rowsBetween(Window.unboundedPreceding, -1)
    many = rows.where("buckets > 1").groupBy(F.col("token").alias("in_token"), F.col("bucket").alias("in_bucket")).agg(F.count(F.lit(1)).alias("n"))
    many = many.select("in_token", "in_bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    rows = rows.join(small(many), (F.col("token") == F.col("in_token")) & (F.col("bucket") == F.col("in_bucket")), "left")
    about = measured.select(F.col("id").alias("of_id"), "size", "bits", "wide").dropDuplicates(["of_id"])
    return rows.join(about, F.col("id") == F.col("of_id")).select("token", "id", "size", "bits", "wide", (F.col("nth") + F.coalesce("ahead", F.lit(0))).alias("nth"))


def _fingerprint_pairs(measured: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts whose fingerprints are linked or the same, enough to connect those."""
    texts = measured.select("id", "fp").distinct()
    first = stored(texts.groupBy("fp").agg(F.min("id").alias("first")), "near-fingerprints")
    same = texts.join(first.withColumnRenamed("fp", "of"), F.col("fp") == F.col("of")).where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    near = links(first.select("fp")).toDF("x", "y")
    for end in ("x", "y"):
        near = near.join(first.select(F.col("fp").alias(f"{end}_fp"), F.col("first").alias(f"{end}_id")), F.col(end) == F.col(f"{end}_fp"))
    return same.unionByName(near.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))).distinct()


def _differing(a: Column, b: Column) -> Column:
    """In how many bits two bitmaps differ, of which one may be twice as long: it folds to the other."""
    half = lambda x: F.zip_with(F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    one, two = F.when(F.size(a) > F.size(b), half(a)).otherwise(a), F.when(F.size(b) > F.size(a), half(b)).otherwise(b)
    return F.aggregate(F.zip_with(one, two, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, x: n + x)


def _near(similarity: float) -> Column:
    """Whether the sizes and bitmaps of two texts (size, bits, wide, and the same with a_) allow the similarity.
    Sizes that are near enough have wide bitmaps of one length or of twice it; no wide one is the short one."""
    most = (F.col("size") + F.col("a_size")) * ((1 - similarity) / (1 + similarity)) + 1e-9
    sizes = F.least("a_size", "size") >= similarity * F.greatest("a_size", "size") - 1e-9
    short = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("a_bits")[k])) for k in range(BITMAP)), F.lit(0))
    large = F.col("wide").isNotNull() | F.col("a_wide").isNotNull()
    return F.when(~sizes | (short > most), False).when(large, _differing(F.coalesce("wide", "bits"), F.coalesce("a_wide", "a_bits")) <= most).otherwise(True)


def _possible(pairs: DataFrame, measured: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of ids whose sizes and bitmaps allow the similarity."""
    about = measured.select("id", "size", "bits", "wide").dropDuplicates(["id"])
    both = pairs.join(about.toDF("a_id", "a_size", "a_bits", "a_wide"), F.col("a") == F.col("a_id")).join(about, F.col("b") == F.col("id"))
    return both.where(_near(similarity)).select("a", "b")


def _similar(told: DataFrame, texts: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of ids whose shingles' Jaccard similarity reaches the bound. Each
    text b goes to its a, once, in shares of about VERIFIED pairs of one a."""
    many = pairs.groupBy(F.col("a").alias("of_a")).agg(F.ceil(F.count(F.lit(1)) / VERIFIED).alias("shares")).where("shares > 1")
    dealt = pairs.join(small(many), F.col("a") == F.col("of_a"), "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("shares", F.lit(1))).alias("share"))
    asked = dealt.select(F.col("a").alias("hub"), "share", F.col("b").alias("asked")).unionByName(dealt.select(F.col("a").alias("hub"), "share", F.col("a").alias("asked")).distinct())
    asked = asked.join(texts.select(F.col("id").alias("of_id"), F.col("best.doc_id").alias("of_doc")), F.col("asked") == F.col("of_id")).drop("of_id")
    rows = told.join(small(stored(asked, "near-asked")), (F.col("id") == F.col("asked")) & F.col("doc_id").eqNullSafe(F.col("of_doc")))
    rows = rows.select("hub", "share", (F.col("id") != F.col("hub")).alias("other"), "id", "text").repartition("hub", "share").sortWithinPartitions("hub", "share", "other", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, last = None, None, None
        for batch in sliced(batches):
            a, b = [], []
            keys = zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3)), strict=True)
            for (hub, share, other, one), own in zip(keys, _each(batch.column(4), words), strict=True):
                if not other:
                    at, first, last = (hub, share), own, None
                elif one != last and at == (hub, share):
                    same, last = len(np.intersect1d(first, own, assume_unique=True)), one
                    if same >= similarity * (len(first) + len(own) - same):
                        a.append(hub), b.append(one)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def similar_groups(told: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, component): ids of texts that pairs as similar as the bound connect, complete.

    told has id, doc_id and text, texts id, best (with the doc_id that stands for it) and bytes. Pairs of near fingerprints are
    verified first, and of texts that meet, the first of each meeting with all later ones; then more
    of them, until every two that meet were compared or are connected: a dense family is connected by
    its first rounds, and no pair is left out for having failed against a representative.
    """
    measured = _measured(told, texts, words, similarity)
    met = stored(_meetings(measured), "near-meetings")
    found, asked, of = None, None, None
    done, most = 0, 1
    while True:
        # Only meetings of several components have pairs left.
        now = met.withColumn("component", F.col("id")) if of is None else met.join(of, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id")).select(*met.columns, "component")
        if done:
            open_ = now.groupBy(F.col("token").alias("open")).agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("nth").alias("last")).where(f"low < high and last > {done + 1}").select("open")
            now = stored(now.join(open_, F.col("token") == F.col("open"), "left_semi"), "near-open")
            if now.isEmpty():
                return of
            met = now.select(*met.columns)
        hubs = now.where((F.col("nth") > done) & (F.col("nth") <= most)).select(F.col("token").alias("a_token"), *[F.col(c).alias(f"a_{c}") for c in ("id", "size", "bits", "wide", "nth", "component")])
        apart = (F.col("nth") > F.col("a_nth")) & (F.col("a_component") != F.col("component"))
        pairs = now.join(hubs, (F.col("token") == F.col("a_token")) & apart & _near(similarity)).select(F.least("a_id", "id").alias("a"), F.greatest("a_id", "id").alias("b"))
        pairs = pairs.unionByName(_possible(_fingerprint_pairs(measured), measured, similarity)).distinct() if asked is None else pairs.distinct().join(asked, ["a", "b"], "left_anti")
        pairs = stored(pairs, "near-pairs")
        alike = stored(_similar(told, texts, pairs, words, similarity), "near-alike")
        asked = pairs if asked is None else asked.unionByName(pairs)
        found = alike if found is None else found.unionByName(alike)
        of = components(found) if of is None or not alike.isEmpty() else of
        done, most = most, most * HUBS


def without_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs, of each group of near-duplicates only the document with the smallest doc_id.

    Near-duplicates are connected by pairs of texts whose shingles' similarity reaches the bound;
    every such pair counts. Equal texts are one (null is the empty one); a null doc_id is the last
    choice. Texts are known by 64-bit hashes; different ones with one hash are left as they are.
    """
    told = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_bytes()).alias("id"), text_bytes().alias("text"))
    rows = told.groupBy("id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.md5("text")).alias("low"), F.max(F.md5("text")).alias("high"), F.max(F.length("text")).alias("bytes"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id", "n")).alias("best")
    texts = rows.groupBy("id").agg(best, F.sum("n").alias("rows"), F.max("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
    texts = stored(texts.where("low = high").drop("low", "high"), "near-texts")
    of = similar_groups(told, texts, words, similarity)
    linked = texts.join(of, F.col("id") == F.col("node"), "left").withColumn("group", F.coalesce("component", "id"))
    first = linked.where("component is not null").groupBy(F.col("group").alias("of_group")).agg(F.min("best").alias("first"))
    linked = linked.join(first, F.col("group") == F.col("of_group"), "left")
    # Texts of one row that are the first of their group are kept as they are.
    changed = linked.select(F.col("id").alias("of_id"), (F.col("first").isNull() | (F.col("first.id") == F.col("id"))).alias("kept"), "rows", F.col("best.doc_id").alias("of_doc"), F.col("best.n").alias("n")).where("not kept or rows > 1")
    changed = stored(changed, "near-changed")
    whole = docs.select(F.xxhash64(text_bytes()).alias("id"), F.col("doc_id").cast("long").alias("own"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    chosen = F.col("kept") & F.col("own").eqNullSafe(F.col("of_doc"))
    once = whole.join(small(changed), F.col("id") == F.col("of_id"), "left").where(F.col("of_id").isNull() | (chosen & (F.col("n") == 1)))
    repeated = whole.join(small(changed.where("kept and n > 1")), F.col("id") == F.col("of_id")).where(chosen).dropDuplicates(["id"])
    return once.select("doc.*").unionByName(repeated.select("doc.*"))
