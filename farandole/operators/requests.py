"""Remaining answers: places by id, status counts, reports' overlays, emissions, coverage choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farandole.functions.columns import haversine
from farandole.operators.geo import near_places


def first_found(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first source that has a key: earlier sources come before later ones."""
    out = None
    for priority, rows in enumerate(sources):
        told = rows.withColumn("priority", F.lit(priority))
        out = told if out is None else out.unionByName(told)
    return out.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("priority"))).where("nth = 1").drop("nth")


def access_stops(sources: list[DataFrame]) -> DataFrame:
    """(stop_id, duration) of an entry point: its own stops before on-demand ones, then free
    radius, then those reached on foot. Within a source the shortest counts."""
    best = [s.groupBy("stop_id").agg(F.min("duration").alias("duration")) for s in sources]
    return first_found(best, "stop_id").select("stop_id", "duration", "priority")


def geo_status(**tables: DataFrame) -> DataFrame:
    """(kind, n): rows of each table."""
    out = None
    for kind, rows in tables.items():
        n = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def car_emission(lon1: Column, lat1: Column, lon2: Column, lat2: Column, distance: Column, per_km: float, crow: float = 1.35) -> Column:
    """Grams for the given metres, or for the crow-fly distance with a detour coefficient."""
    return F.coalesce(distance, haversine(lon1, lat1, lon2, lat2) * crow) / 1000 * per_km


def with_missing_emission(sections: DataFrame, per_km: float) -> DataFrame:
    return sections.withColumn("emission", F.coalesce("emission", F.when(F.col("mode") == "car", F.col("length") / 1000 * per_km)))


def overlaid_status(objects: DataFrame, status: DataFrame, key: str) -> DataFrame:
    """objects with the newest external status (key, status, updated) of their code, or unknown."""
    newest = status.groupBy(key).agg(F.max_by("status", "updated").alias("status"))
    return objects.join(newest, key, "left").withColumn("status", F.coalesce("status", F.lit("unknown")))


def realtime_window(passages: DataFrame, by: str, begin: Column, duration: int, k: int) -> DataFrame:
    """The first k passages of each group from begin on, within the duration."""
    held = passages.where((F.col("ts") >= begin) & (F.col("ts") <= begin + F.make_dt_interval(secs=F.lit(duration))))
    return held.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy("ts", "id"))).where(F.col("nth") <= k)


def outside_zones(objects: DataFrame, zones: DataFrame, radius_column: str = "radius") -> DataFrame:
    """Objects (id, lon, lat) in no active zone (zone_lon, zone_lat, radius). Distinct places meet zones
    in cells of the largest zone's size."""
    told = zones.select(F.col("zone_lon").alias("lon"), F.col("zone_lat").alias("lat"), F.col(radius_column).alias("zone_radius")).where("zone_radius >= 0")
    largest = told.agg(F.max("zone_radius")).first()[0]
    if largest is None:
        return objects
    places = objects.select(F.col("lon").alias("q_lon"), F.col("lat").alias("q_lat")).distinct()
    hit = near_places(places, told, float(max(largest, 1.0))).where("distance <= zone_radius").select("q_lon", "q_lat").distinct()
    return objects.join(hit.hint("merge"), (F.col("lon") == F.col("q_lon")) & (F.col("lat") == F.col("q_lat")), "left_anti")


def coverage(instances: DataFrame, lon: Column, lat: Column) -> DataFrame:
    """Instances whose box holds the point: larger priority first, then not free, then by name."""
    held = lon.between(F.col("west"), F.col("east")) & lat.between(F.col("south"), F.col("north"))
    return instances.where(held).orderBy(F.desc("priority"), "free", "name")


def line_label(network: Column, mode: Column, code: Column, name: Column) -> Column:
    return F.concat_ws(" ", F.when(network != mode, network), mode, F.coalesce(code, name))


def natural_order(code: Column) -> Column:
    """Sort key of a code in which numbers count by value, of any length: leading zeros go and the
    number of digits stands ahead."""
    digits = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    number = lambda p: F.concat(F.lpad(F.length(digits(p)).cast("string"), 6, "0"), digits(p))
    return F.array_join(F.transform(F.regexp_extract_all(code, F.lit(r"([0-9]+|[^0-9]+)")), lambda p: F.when(p.rlike("^[0-9]"), number(p)).otherwise(p)), "")


def stale(backups: DataFrame, by: str, keep: int) -> DataFrame:
    """Backups beyond the newest ones of their dataset, which a purge removes; running ones stay."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("created"), F.desc("id")))
    return backups.withColumn("nth", nth).where((F.col("nth") > keep) & ~F.col("running")).drop("nth")


def access_by_entrance(ways: DataFrame, entrances: DataFrame, most: int) -> DataFrame:
    """(stop_id, duration): the quickest way through an entrance, if less than `most` seconds."""
    via = ways.join(entrances, "entrance_id").groupBy("stop_id").agg(F.min(F.col("duration") + F.col("traversal_time")).alias("duration"))
    return via.where(F.col("duration") < most)


def odt_level(on_demand: DataFrame, by: str) -> DataFrame:
    """Whether any and all of a line's routes run on demand: scheduled, mixed or zonal."""
    bits = on_demand.groupBy(by).agg(F.bit_or("bits").alias("bits"))
    return bits.select(by, F.when(F.col("bits") == 0, "scheduled").when(F.col("bits").bitwiseAND(2) == 0, "with_stops").otherwise("zonal").alias("odt_level"))


def large_components(labels: DataFrame, least: float = 0.01) -> DataFrame:
    """Components (component, node) whose size is at least that share of the largest one."""
    size = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    most = size.agg(F.max("n").alias("most"))
    return size.join(F.broadcast(most)).where(F.col("n") >= F.col("most") * least).select("component", "n")


def by_code(objects: DataFrame, codes: DataFrame, system: str, code: str) -> DataFrame:
    """Objects (id) that have the code in the system (object_id, system, code)."""
    found = codes.where((F.col("system") == system) & (F.col("code") == code)).select(F.col("object_id").alias("id")).distinct()
    return objects.join(found, "id", "left_semi")


def on_demand_stops(stops: DataFrame, odt_stops: DataFrame, lon: Column, lat: Column, metres: float) -> DataFrame:
    """Stops of zonal trips on demand (stop_id) within reach of a point, nearest first."""
    away = haversine(F.col("lon"), F.col("lat"), lon, lat)
    told = stops.join(odt_stops.select(F.col("stop_id").alias("id")).distinct(), "id", "left_semi")
    return told.withColumn("distance", away).where(F.col("distance") <= metres).orderBy("distance", "id")


def task_spans(logs: DataFrame) -> DataFrame:
    """(request_id, task, starts, lasts): microseconds from a request's first log line (request_id, task, ts) to
    each of its tasks' first one, and from there to the task's last one."""
    spans = logs.groupBy("request_id", "task").agg(F.min("ts").alias("begin"), F.max("ts").alias("end"))
    first = F.min("begin").over(Window.partitionBy("request_id"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return spans.select("request_id", "task", (micros(F.col("begin")) - micros(first)).alias("starts"), (micros(F.col("end")) - micros(F.col("begin"))).alias("lasts"))


def on_demand_by_admin(stops: DataFrame, served: DataFrame, routes: DataFrame) -> DataFrame:
    """(admin, stop_id), each once, of the stops of zonal on-demand routes. stops: stop_id, admin; served:
    route_id, stop_id; routes: route_id, zonal."""
    zonal = served.join(routes.where("zonal").select("route_id").distinct(), "route_id", "left_semi").select("stop_id").distinct()
    return stops.where("admin is not null").join(zonal, "stop_id", "left_semi").select("admin", "stop_id").distinct()
