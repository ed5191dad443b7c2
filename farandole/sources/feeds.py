"""Timetable feeds as CSV folders: a schema registry, typed readers and snapshots.

Every file is read by one CSV scan with all columns as strings; rules are column expressions, so
bad values become nulls or defaults instead of errors. Optional columns that a feed lacks are null.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farandole.functions.columns import time_to_int
from farandole.operators.periods import calendar_days

#: Columns of the standard dialect's files.
GTFS = {
    "agency": "agency_id,agency_name,agency_url,agency_timezone",
    "stops": "stop_id,stop_name,stop_desc,stop_lat,stop_lon,zone_id,stop_url,platform_code,location_type,parent_station,stop_timezone,wheelchair_boarding",
    "routes": "route_id,agency_id,route_short_name,route_long_name,route_desc,route_type,route_url,route_color,route_text_color",
    "trips": "route_id,service_id,trip_id,trip_headsign,direction_id,block_id,shape_id",
    "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence,stop_headsign,pickup_type,drop_off_type,shape_dist_traveled",
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date",
    "calendar_dates": "service_id,date,exception_type",
    "frequencies": "trip_id,start_time,end_time,headway_secs",
    "transfers": "from_stop_id,to_stop_id,transfer_type,min_transfer_time",
    "pathways": "pathway_id,from_stop_id,to_stop_id,pathway_mode,is_bidirectional,length,traversal_time",
    "shapes": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence,shape_dist_traveled",
    "feed_info": "feed_publisher_name,feed_publisher_url,feed_lang,feed_start_date,feed_end_date",
}
#: Further files and columns of the extended dialect.
NTFS = GTFS | {
    "networks": "network_id,network_name,network_url,network_timezone,network_lang,network_phone,network_sort",
    "lines": "line_id,line_code,line_name,line_color,line_sort,network_id,commercial_mode_id,contributor_id,geometry_id,line_opening_time,line_closing_time",
    "routes": "route_id,route_name,direction_type,line_id,contributor_id,geometry_id",
    "companies": "company_id,company_name",
    "physical_modes": "physical_mode_id,physical_mode_name,co2_emission",
    "commercial_modes": "commercial_mode_id,commercial_mode_name",
    "comments": "comment_id,comment_name",
    "comment_links": "object_id,object_type,comment_id",
    "object_codes": "object_type,object_id,object_system,object_code",
    "addresses": "address_id,street_name,house_number",
    "line_groups": "line_group_id,line_group_name,main_line_id",
    "line_group_links": "line_group_id,line_id",
    "equipments": "equipment_id,wheelchair_boarding,sheltered,elevator,escalator,bike_accepted,bike_depot,visual_announcement,audible_announcement,appropriate_escort,appropriate_signage",
    "geometries": "geometry_id,geometry_wkt",
    "contributors": "contributor_id,contributor_name",
    "frames": "frame_id,contributor_id,frame_start_date,frame_end_date,frame_type,frame_desc,frame_system",
    "grid_calendars": "grid_calendar_id,name,monday,tuesday,wednesday,thursday,friday,saturday,sunday",
    "grid_periods": "grid_calendar_id,start_date,end_date",
    "grid_exception_dates": "grid_calendar_id,date,type",
    "stops": "stop_id,visible,stop_name,stop_lat,stop_lon,stop_code,zone_id,location_type,parent_station,stop_timezone,equipment_id,contributor_id,geometry_id,address_id",
    "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence,stop_headsign,pickup_type,drop_off_type,local_zone_id,date_time_estimated,boarding_duration,alighting_duration",
    "transfers": "from_stop_id,to_stop_id,min_transfer_time,real_min_transfer_time,equipment_id",
    "trips": "route_id,service_id,trip_id,trip_headsign,block_id,company_id,physical_mode_id,trip_property_id,dataset_id,geometry_id",
    "trip_properties": "trip_property_id,wheelchair_accessible,bike_accepted,air_conditioned,visual_announcement,audible_announcement,appropriate_escort,appropriate_signage,school_vehicle",
    "feed_infos": "feed_info_param,feed_info_value",
    "object_properties": "object_type,object_id,object_property_name,object_property_value",
    "grid_rel_calendar_line": "grid_calendar_id,line_id",
    "grid_rel_calendar_trip": "grid_calendar_id,trip_id",
    "admin_stations": "admin_id,station_id",
}
MANDATORY = ("stops", "routes", "trips", "stop_times")
#: Seconds of walking and of waiting where a transfer names none; most of a transfer.
DEFAULT_WALK, DEFAULT_WAIT, LONGEST_TRANSFER = 120, 120, 86_400
WEEK = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


class MissingFile(ValueError):
    """A feed lacks a mandatory file, or one of its columns that identify rows."""


def read_file(spark: SparkSession, folder: str, name: str, dialect: dict[str, str] = GTFS) -> DataFrame:
    """One file of a feed with the registry's columns, and line_: a number that grows along the file.
    Nothing but mandatory files must exist."""
    wanted = dialect[name].split(",")
    try:
        rows = spark.read.csv(f"{folder}/{name}.txt", header=True, mode="PERMISSIVE")
        have = {c.strip().lstrip("﻿"): c for c in rows.columns}
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        if name in MANDATORY:
            raise MissingFile(name) from e
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in wanted) + ", line_ long")
    if name in MANDATORY and not {c for c in wanted if c.endswith("_id")} & set(have):
        raise MissingFile(f"{name}: no id column")
    return rows.select(*[F.col(f"`{have[c]}`").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in wanted], F.monotonically_increasing_id().alias("line_"))


def read_feed(spark: SparkSession, folder: str, dialect: dict[str, str] = GTFS) -> dict[str, DataFrame]:
    return {name: read_file(spark, folder, name, dialect) for name in dialect}


def number(c: str, kind: str = "int") -> Column:
    return F.expr(f"try_cast(`{c}` as {kind})")


def day(c: str) -> Column:
    return F.try_to_date(F.col(c), "yyyyMMdd")


def first_lines(rows: DataFrame, *key: str) -> DataFrame:
    """Of rows with one key the first line of the file, without its number."""
    rest = [c for c in rows.columns if c not in (*key, "line_")]
    first = rows.groupBy(*key).agg(F.min(F.struct("line_", *rest)).alias("f"))
    return first.select(*key, *[f"f.{c}" for c in rest])


def stop_points(stops: DataFrame, keep_orphans: bool = True) -> DataFrame:
    """Stops (location type 0) with valid coordinates and their area; of repeated ids the first line
    counts.

    Standard dialect: an orphan's area is made of the stop itself. Extended dialect
    (keep_orphans off): orphans are left out.
    """
    placed = stops.where(F.coalesce(number("location_type"), F.lit(0)) == 0).withColumns({"lon": number("stop_lon", "double"), "lat": number("stop_lat", "double")})
    placed = placed.where(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90))
    once = first_lines(placed, "stop_id")
    areas = stops.where(number("location_type") == 1).select(F.col("stop_id").alias("area_id")).distinct()
    joined = once.join(areas, F.col("parent_station") == F.col("area_id"), "left")
    if not keep_orphans:
        return joined.where("area_id is not null")
    return joined.withColumn("area_id", F.coalesce("area_id", F.concat(F.lit("area:"), F.col("stop_id"))))


def service_days(calendar: DataFrame, calendar_dates: DataFrame) -> DataFrame:
    """(service_id, day) by week masks and periods, plus and less the exceptions."""
    mask = sum((F.when(number(w) == 1, 1 << k).otherwise(0) for k, w in enumerate(WEEK)), F.lit(0))
    spans = calendar.select("service_id", day("start_date").alias("begin"), day("end_date").alias("end"), mask.alias("mask")).where("begin <= end")
    once = spans.groupBy("service_id").agg(F.min(F.struct("begin", "end", "mask")).alias("s")).select("service_id", "s.*")
    exceptions = calendar_dates.select("service_id", day("date").alias("day"), number("exception_type").alias("type")).where("day is not null")
    return calendar_days(once, exceptions, "service_id", F.col("mask"))


def production_period(days: DataFrame, trips: DataFrame) -> DataFrame:
    """(begin, end): first and last day of the services that trips use, at most 365 days on, end
    exclusive."""
    used = days.join(trips.select("service_id").distinct(), "service_id", "left_semi")
    span = used.agg(F.min("day").alias("begin"), F.max("day").alias("last"))
    return span.select("begin", F.date_add(F.least("last", F.date_add("begin", 365)), 1).alias("end"))


def stop_times(rows: DataFrame, utc_offset: int = 0) -> DataFrame:
    """Typed stop times in UTC seconds (below 0 and above 24 h are fine); rows where neither
    pick-up nor drop-off is possible are left out. Extended columns widen the stay."""
    sub = {c: F.coalesce(number(c), F.lit(0)) if c in rows.columns else F.lit(0) for c in ("boarding_duration", "alighting_duration")}
    pick, drop = (F.coalesce(number(c), F.lit(0)) for c in ("pickup_type", "drop_off_type"))
    arrival, departure = (time_to_int(F.col(c)) - utc_offset for c in ("arrival_time", "departure_time"))
    out = rows.select("trip_id", number("stop_sequence").alias("sequence"), "stop_id", arrival.alias("arrival"), departure.alias("departure"), (departure - sub["boarding_duration"]).alias("boarding"), (arrival + sub["alighting_duration"]).alias("alighting"), (pick != 1).alias("pick_up"), (drop != 1).alias("drop_off"), ((pick == 2) | (drop == 2)).alias("on_demand"), F.col("stop_headsign").alias("headsign"), (~((pick == 3) & (drop == 3))).alias("usable"))
    return out.where("usable").drop("usable")


def transfers(rows: DataFrame, stops: DataFrame) -> DataFrame:
    """Connections between stops: an area on either side stands for its stops. An empty time is
    dropped, as is one over 24 h; one that isn't a number means the default walk and wait. A real
    time, where there is one, replaces the duration but not the displayed one."""
    ends = stops.select(F.col("stop_id").alias("key"), "stop_id").unionByName(stops.select(F.col("area_id").alias("key"), "stop_id")).distinct()
    side = lambda c, name: ends.select(F.col("key").alias(c), F.col("stop_id").alias(name))
    told = rows.where("min_transfer_time is not null and min_transfer_time <> ''")
    given, real = number("min_transfer_time"), number("real_min_transfer_time") if "real_min_transfer_time" in rows.columns else F.lit(None)
    both = told.join(side("from_stop_id", "from_stop"), "from_stop_id").join(side("to_stop_id", "to_stop"), "to_stop_id")
    timed = both.select("from_stop", "to_stop", "line_", F.coalesce(given, F.lit(DEFAULT_WALK)).alias("display_duration"), F.coalesce(real, given, F.lit(DEFAULT_WALK + DEFAULT_WAIT)).alias("duration"))
    return first_lines(timed.where(F.col("duration") <= LONGEST_TRANSFER), "from_stop", "to_stop")


def shapes(rows: DataFrame) -> DataFrame:
    """(shape_id, points): each shape's points in order."""
    point = F.struct(number("shape_pt_sequence").alias("seq"), number("shape_pt_lon", "double").alias("lon"), number("shape_pt_lat", "double").alias("lat"))
    return rows.groupBy("shape_id").agg(F.transform(F.sort_array(F.collect_list(point)), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("points"))


def frequencies(rows: DataFrame, times: DataFrame) -> DataFrame:
    """Stop times of trips that run every headway, relative to their first departure, with the
    first and last start and the headway in seconds."""
    first = F.first("departure").over(Window.partitionBy("trip_id").orderBy("sequence"))
    told = rows.select("trip_id", time_to_int(F.col("start_time")).alias("start"), time_to_int(F.col("end_time")).alias("end"), number("headway_secs").alias("headway"))
    return times.withColumn("first", first).join(told, "trip_id").select("trip_id", "sequence", "stop_id", (F.col("arrival") - F.col("first") + F.col("start")).alias("arrival"), (F.col("departure") - F.col("first") + F.col("start")).alias("departure"), "start", "end", "headway")


def default_transfers(stops: DataFrame) -> DataFrame:
    """For a feed without any transfer: all pairs of an area's stops, as far as walking takes."""
    from farandole.functions.columns import haversine

    a = stops.select("area_id", F.col("stop_id").alias("from_stop"), F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"))
    b = stops.select("area_id", F.col("stop_id").alias("to_stop"), F.col("lon").alias("b_lon"), F.col("lat").alias("b_lat"))
    walk = F.when(F.col("from_stop") == F.col("to_stop"), 0).otherwise((haversine(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat")) * 1.414 / 1.1).cast("int"))
    return a.join(b, "area_id").select("from_stop", "to_stop", walk.alias("display_duration"), (walk + 120).alias("duration"))


def fare_prices(spark: SparkSession, path: str) -> DataFrame:
    """(ticket, begin, end, price, name): dated prices of a `;` file without header; other rows are dropped."""
    rows = spark.read.csv(path, sep=";", header=False, schema="ticket string, b string, e string, p string, name string, _1 string, comment string")
    return rows.select("ticket", day("b").alias("begin"), day("e").alias("end"), number("p").alias("price"), "name").where("begin is not null and end is not null and price is not null")


def write_snapshot(tables: dict[str, DataFrame], folder: str, version: int) -> None:
    """All tables as LZ4 Parquet, then the version: a snapshot without it is incomplete."""
    spark = next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        rows.write.mode("overwrite").option("compression", "lz4").parquet(f"{folder}/{name}")
    told = json.dumps({"version": version, "tables": sorted(tables)})
    spark.createDataFrame([(told,)], "value string").write.mode("overwrite").text(f"{folder}/_version")


def read_snapshot(spark: SparkSession, folder: str, version: int) -> dict[str, DataFrame]:
    told = json.loads(spark.read.text(f"{folder}/_version").first().value)
    if told["version"] != version:
        raise ValueError(f"snapshot version {told['version']}, not {version}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in told["tables"]}
