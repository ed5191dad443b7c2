"""Spatial joins and grids. Radius joins meet in grid cells, never in all pairs, and what stands at
one place meets once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farandole.functions.columns import EARTH_RADIUS, RADIAN, haversine
from farandole.scratch import stored

#: Metres of a degree of latitude, a little less than real, so that cells are large enough.
DEGREE = 111_000.0
#: Smaller rings that a nearest search tries first.
RINGS = 3
#: Ids of one place that travel together, about: points, and queries. All pairs of two lists are written
#: out at once, so their product bounds what a task holds of the result.
TOGETHER, ASKED_TOGETHER = 1024, 16
#: Pairs that one part of a cell may have to look at, about.
PART_PAIRS = 2**27


def _in_cells(asked: DataFrame, held: DataFrame, metres: float) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cells (x, y) that they meet in, for so many metres, anywhere on earth.

    Rows of cells are as high as the radius; each row is cut into as many columns as keep a column
    at least as wide as the radius there, around the whole circle of latitude. A query stands in the
    3 x 3 cells around it and meets the points of each.
    """
    height = metres / DEGREE
    half = math.sin(min(math.pi / 2, metres / (2 * EARTH_RADIUS)))

    def columns(row: Column) -> Column:
        """Columns of a row, for the largest latitude that it or the next row holds."""
        top = F.greatest(F.abs(row * height), F.abs((row + 1) * height)) + height
        reach = F.lit(half) / F.cos(F.least(top, F.lit(89.999)) * RADIAN)
        return F.when((top >= 89.999) | (reach >= 1), 1).otherwise(F.greatest(F.lit(1), F.floor(360 / (2 * F.asin(F.least(reach, F.lit(1.0))) / RADIAN) / 1.0001))).cast("long")

    at = lambda lon, n: F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * n), n - 1).cast("long")
    row = lambda lat: F.floor(F.col(lat) / height).cast("long")
    around = F.array(*[F.pmod(at(F.col("q_lon"), F.col("n")) + k, F.col("n")) for k in (-1, 0, 1)])
    stands = asked.withColumn("y", F.explode(F.sequence(row("q_lat") - 1, row("q_lat") + 1))).withColumn("n", columns(F.col("y"))).withColumn("x", F.explode(F.array_distinct(around))).drop("n")
    cells = held.withColumn("y", row("lat")).withColumn("x", at(F.col("lon"), columns(F.col("y"))))
    return stands, cells


def _meet(stands: DataFrame, cells: DataFrame, keys: list[str], metres: float) -> DataFrame:
    """Rows of one cell within so many metres, and their distance. Sizes of exploded rows are estimated
    far too low, so the sides are merged and neither is broadcast."""
    met = stands.join(cells.hint("merge"), keys).withColumn("distance", haversine(F.col("q_lon"), F.col("q_lat"), F.col("lon"), F.col("lat")))
    return met.where(F.col("distance") <= metres).drop(*keys)


def near_places(asked: DataFrame, held: DataFrame, metres: float) -> DataFrame:
    """Rows of asked (q_lon, q_lat, ...) with those of held (lon, lat, ...) within so many metres, and their
    distance, anywhere on earth."""
    return _meet(*_in_cells(asked, held, metres), ["x", "y"], metres)


def _by_place(rows: DataFrame, key: str, together: int) -> DataFrame:
    """(lon, lat, ids): the keys of each place, in lists of about so many; rows without a place have none."""
    rows = rows.where("lon is not null and lat is not null")
    many = rows.groupBy("lon", "lat").agg(F.ceil(F.count(F.lit(1)) / together).alias("lists")).where("lists > 1").toDF("of_lon", "of_lat", "lists")
    dealt = rows.join(many, (F.col("lon") == F.col("of_lon")) & (F.col("lat") == F.col("of_lat")), "left")
    return dealt.groupBy("lon", "lat", F.pmod(F.xxhash64(key), F.coalesce("lists", F.lit(1))).alias("list")).agg(F.collect_list(key).alias("ids")).drop("list")


def _in_parts(stands: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the part of their cell. Of a cell with more than PART_PAIRS pairs the larger
    side is dealt to parts and the smaller one stands in each, so that no cell is one task's."""
    asked, held = (rows.groupBy("x", "y").agg(F.sum(F.size(ids)).alias(n)) for rows, ids, n in ((stands, "query_ids", "n_asked"), (cells, "ids", "n_held")))
    pairs = F.col("n_asked").cast("double") * F.col("n_held")
    large = asked.join(held.hint("merge"), ["x", "y"]).where(pairs > PART_PAIRS).select("x", "y", F.ceil(pairs / PART_PAIRS).alias("parts"), (F.col("n_asked") > F.col("n_held")).alias("deals_asked"))

    def parted(rows: DataFrame, ids: str, dealt: Column) -> DataFrame:
        own = F.array(F.pmod(F.xxhash64(F.array_min(ids)), F.col("parts")))  # lists come in any order, also when a task is run again
        part = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).when(dealt, own).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        return rows.join(large.hint("merge"), ["x", "y"], "left").withColumn("part", F.explode(part)).drop("parts", "deals_asked")

    return parted(stands, "query_ids", F.col("deals_asked")), parted(cells, "ids", ~F.col("deals_asked"))


def place_pairs(queries: DataFrame, points: DataFrame, metres: float) -> DataFrame:
    """(query_ids, ids, distance): lists of the points (id, lon, lat) that stand at one place within so
    many metres of queries (query_id, lon, lat) of another or the same, anywhere on earth. Every query of a
    row has every point of it.

    What is met says little about how many pairs come of it, so tasks are as many as the session has,
    however few bytes they read.
    """
    asked = _by_place(queries.select("query_id", "lon", "lat"), "query_id", ASKED_TOGETHER).toDF("q_lon", "q_lat", "query_ids")
    held = _by_place(points.select("id", "lon", "lat"), "id", TOGETHER)
    spark, keys = queries.sparkSession, ["x", "y", "part"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    stands, cells = (rows.repartition(tasks, *keys) for rows in _in_parts(*_in_cells(asked, held, metres)))
    return _meet(stands, cells, keys, metres).select("query_ids", "ids", "distance")


def written_out(met: DataFrame) -> DataFrame:
    """(query_id, id, distance) of all pairs of place_pairs, where they are found: they aren't shuffled."""
    return met.select(F.explode("query_ids").alias("query_id"), "ids", "distance").select("query_id", F.explode("ids").alias("id"), "distance")


def radius_join(queries: DataFrame, points: DataFrame, metres: float) -> DataFrame:
    """(query_id, id, distance) of points (id, lon, lat) within so many metres of queries
    (query_id, lon, lat), anywhere on earth. What the distance is used for is cheaper on place_pairs."""
    return written_out(place_pairs(queries, points, metres))


def nearest(queries: DataFrame, points: DataFrame, metres: float, k: int) -> DataFrame:
    """The k nearest points of each query within the radius; ties go to the smaller id.

    Queries of one place have one answer, and of the points of one place the k smallest ids suffice.
    Rings grow: places that find k points within a small radius are done, the others go on with
    four times the radius, so that dense places never meet all points of a large one.
    """
    first = F.row_number().over(Window.partitionBy("lon", "lat").orderBy("id"))
    heads = stored(points.select("id", "lon", "lat").withColumn("nth", first).where(F.col("nth") <= k).drop("nth"), "ring-points")
    left = stored(queries.select(F.col("lon").alias("q_lon"), F.col("lat").alias("q_lat")).distinct(), "ring-left")
    place, of = ["q_lon", "q_lat"], ["of_lon", "of_lat"]
    order = Window.partitionBy(*place).orderBy("distance", "id")
    done = None
    for step in range(RINGS, -1, -1):
        best = near_places(left, heads, metres / 4**step).select(*place, "id", "distance").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
        if step:
            best = stored(best, "ring")
            full = best.where(F.col("nth") == k).select(*place).hint("merge")
            left = stored(left.join(full, place, "left_anti"), "ring-left")
            best = best.join(full, place, "left_semi")
        done = best if done is None else done.unionByName(best)
    told = queries.select("query_id", "lon", "lat").join(done.drop("nth").hint("merge"), (F.col("lon") == F.col("q_lon")) & (F.col("lat") == F.col("q_lat")))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return told.select("query_id", "id", "distance").withColumn("nth", nth).where(F.col("nth") <= k)


def heat_grid(points: DataFrame, box: tuple[float, float, float, float], n: int) -> DataFrame:
    """Points counted by cell of an n x n grid over the box (lon, lat, lon, lat), clamped to it."""
    rank = lambda c, low, high: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(c) - low) / ((high - low) / n)).cast("int")))
    return points.groupBy(rank("lon", box[0], box[2]).alias("x"), rank("lat", box[1], box[3]).alias("y")).agg(F.count(F.lit(1)).alias("n"))


def uncovered_circles(circles: DataFrame) -> DataFrame:
    """Circles (id, lon, lat, radius) that no larger circle contains. Circles meet those of each
    power of two of the radius in cells of that size; of a place only the largest circle of a power can
    contain others, and equal circles of one place are one."""
    power = F.ceil(F.log2(F.greatest(F.col("radius"), F.lit(1.0)))).cast("int")
    sized = stored(circles.select("lon", "lat", "radius", power.alias("power")).groupBy("lon", "lat", "power").agg(F.max("radius").alias("outer")), "circles")
    own = stored(circles.select(F.col("lon").alias("q_lon"), F.col("lat").alias("q_lat"), "radius").distinct(), "circles-own")
    inner = None
    for p in sorted(r.power for r in sized.where("power is not null").select("power").distinct().collect()):  # at most 25 on earth
        held = sized.where(F.col("power") == p).select("lon", "lat", "outer")
        met = near_places(own.where(F.col("radius") <= 2.0**p), held, 2.0**p)
        hit = met.where(F.col("distance") + F.col("radius") < F.col("outer")).select("q_lon", "q_lat", F.col("radius").alias("q_radius"))
        inner = hit if inner is None else inner.unionByName(hit)
    same = (F.col("lon") == F.col("q_lon")) & (F.col("lat") == F.col("q_lat")) & (F.col("radius") == F.col("q_radius"))
    return circles if inner is None else circles.join(inner.distinct().hint("merge"), same, "left_anti")
