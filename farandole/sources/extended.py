"""Typed tables of the extended dialect's further files, from the string columns of read_feed().

A value that can't be read becomes null or its default; rows without their key are left out. Of
repeated keys the first line of the file counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farandole.functions.columns import DAY, time_to_int
from farandole.operators.periods import offset_periods
from farandole.sources.feeds import WEEK, day, first_lines, number

#: Names of what a feed leaves out.
DEFAULT_NETWORK, DEFAULT_MODE = "default_network", "default_commercial_mode"
#: Accessibility bits in order, of stops and of trips.
STOP_BITS = ("wheelchair_boarding", "sheltered", "elevator", "escalator", "bike_accepted", "bike_depot", "visual_announcement", "audible_announcement", "appropriate_escort", "appropriate_signage")
TRIP_BITS = ("wheelchair_accessible", "bike_accepted", "air_conditioned", "visual_announcement", "audible_announcement", "appropriate_escort", "appropriate_signage", "school_vehicle")
#: Route types of the standard dialect and their modes.
ROUTE_TYPES = {0: "Tramway", 1: "Metro", 2: "Train", 3: "Bus", 4: "Ferry", 5: "Funicular", 6: "SuspendedCableCar", 7: "Funicular"}


def _keyed(rows: DataFrame, *key: str) -> DataFrame:
    return first_lines(rows.where(" and ".join(f"{k} <> ''" for k in key)), *key)


def default_modes(routes: DataFrame) -> DataFrame:
    """(route_id, mode) by route type; unknown ones are buses, extended types count by hundreds."""
    kind = number("route_type")
    hundreds = F.when(kind.between(100, 199), 2).when(kind.between(400, 699), 1).when(kind.between(900, 999), 0).when(kind.between(1000, 1099), 4)
    told = F.create_map(*[F.lit(x) for pair in ROUTE_TYPES.items() for x in pair])
    return routes.select("route_id", F.coalesce(F.try_element_at(told, F.coalesce(hundreds, kind)), F.lit("Bus")).alias("mode"))


def parameters(rows: DataFrame) -> DataFrame:
    """(name, value) of a feed's own description (feed_info_param, feed_info_value); creation date
    and time become feed_creation_datetime."""
    told = first_lines(rows.where("feed_info_param <> ''"), "feed_info_param").toDF("name", "value")
    part = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    at = told.agg(F.try_to_timestamp(F.concat_ws(" ", part("feed_creation_date"), F.coalesce(part("feed_creation_time"), F.lit("00:00:00"))), F.lit("yyyyMMdd HH:mm:ss")).alias("at")).where("at is not null")
    plain = told.where("name not in ('feed_creation_date', 'feed_creation_time')")
    return plain.unionByName(at.select(F.lit("feed_creation_datetime").alias("name"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("value")))


def networks(rows: DataFrame) -> DataFrame:
    sort = F.when(number("network_sort") != -1, number("network_sort"))
    return _keyed(rows, "network_id").select("network_id", F.col("network_name").alias("name"), F.col("network_url").alias("url"), F.col("network_timezone").alias("timezone"), F.col("network_lang").alias("lang"), F.col("network_phone").alias("phone"), sort.alias("sort"))


def lines(rows: DataFrame, networks: DataFrame, modes: DataFrame) -> DataFrame:
    """Lines with their network and commercial mode. A network that is told but unknown is an error,
    none is the default one, as is an unknown mode; sort -1 is none; a closing time counts within a day."""
    told = _keyed(rows, "line_id")
    named = F.when(F.col("network_id") != "", F.col("network_id"))
    unknown = told.where(named.isNotNull()).join(networks, "network_id", "left_anti").select("network_id").first()
    if unknown is not None:
        raise ValueError(f"unknown network {unknown.network_id}")
    known = modes.select(F.col("commercial_mode_id").alias("known_mode")).distinct()
    seconds = lambda c: F.when(F.col(c).rlike("^[0-9]+:"), time_to_int(F.col(c)))
    return told.join(known, F.col("commercial_mode_id") == F.col("known_mode"), "left").select(
        "line_id", F.col("line_code").alias("code"), F.col("line_name").alias("name"), F.col("line_color").alias("color"), F.when(number("line_sort") != -1, number("line_sort")).alias("sort"),
        F.coalesce(named, F.lit(DEFAULT_NETWORK)).alias("network_id"), F.coalesce("known_mode", F.lit(DEFAULT_MODE)).alias("commercial_mode_id"), "contributor_id", "geometry_id",
        seconds("line_opening_time").alias("opening"), (seconds("line_closing_time") % DAY).alias("closing"),
    )


def routes(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Routes of known lines."""
    told = _keyed(rows, "route_id").join(lines.select("line_id"), "line_id", "left_semi")
    return told.select("route_id", F.col("route_name").alias("name"), "direction_type", "line_id", "geometry_id")


def geometries(rows: DataFrame) -> DataFrame:
    """(geometry_id, kind, wkt) of lines, sets of lines and sets of areas; others are left out."""
    kind = F.upper(F.regexp_extract("geometry_wkt", r"^\s*([A-Za-z]+)\s*\(", 1))
    return _keyed(rows, "geometry_id").select("geometry_id", kind.alias("kind"), F.trim("geometry_wkt").alias("wkt")).where("kind in ('MULTILINESTRING', 'LINESTRING', 'MULTIPOLYGON')")


def companies(rows: DataFrame) -> DataFrame:
    return _keyed(rows, "company_id").select("company_id", F.col("company_name").alias("name"))


def physical_modes(rows: DataFrame) -> DataFrame:
    return _keyed(rows, "physical_mode_id").select("physical_mode_id", F.col("physical_mode_name").alias("name"), number("co2_emission", "double").alias("co2_emission"))


def commercial_modes(rows: DataFrame) -> DataFrame:
    return _keyed(rows, "commercial_mode_id").select("commercial_mode_id", F.col("commercial_mode_name").alias("name"))


def contributors(rows: DataFrame) -> DataFrame:
    return _keyed(rows, "contributor_id").select("contributor_id", F.col("contributor_name").alias("name"))


def frames(rows: DataFrame, contributors: DataFrame) -> DataFrame:
    """Frames of known contributors with their days."""
    told = _keyed(rows, "frame_id").join(contributors.select("contributor_id"), "contributor_id", "left_semi")
    return told.select("frame_id", "contributor_id", day("frame_start_date").alias("begin"), day("frame_end_date").alias("end"), F.col("frame_type").alias("type"), F.col("frame_desc").alias("description"), F.col("frame_system").alias("system"))


def line_groups(groups: DataFrame, links: DataFrame, lines: DataFrame) -> DataFrame:
    """(line_group_id, name, line_id, main): the groups' known lines, the main one with or without a link."""
    told = _keyed(groups, "line_group_id")
    pairs = links.select("line_group_id", "line_id").unionByName(told.select("line_group_id", F.col("main_line_id").alias("line_id"))).distinct()
    out = told.drop("line_id").join(pairs, "line_group_id").join(lines.select("line_id"), "line_id", "left_semi")
    return out.select("line_group_id", F.col("line_group_name").alias("name"), "line_id", F.col("main_line_id").eqNullSafe(F.col("line_id")).alias("main"))


def comments(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(object_type, object_id, comment_id, comment) of every link to a known comment."""
    told = _keyed(rows, "comment_id").select("comment_id", F.col("comment_name").alias("comment"))
    return links.select(F.lower("object_type").alias("object_type"), "object_id", "comment_id").distinct().join(told, "comment_id").select("object_type", "object_id", "comment_id", "comment")


def object_codes(rows: DataFrame, legacy_system: str | None = None) -> DataFrame:
    """(object_type, object_id, system, code), types in lower case, each code once; codes of the
    legacy system are named external_code."""
    told = F.col("object_system")
    system = F.when(F.lower(told) == (legacy_system or "").lower(), "external_code").otherwise(told) if legacy_system else told
    return rows.where("object_id <> '' and object_code <> ''").select(F.lower("object_type").alias("object_type"), "object_id", system.alias("system"), F.col("object_code").alias("code")).distinct()


def object_properties(rows: DataFrame) -> DataFrame:
    return rows.where("object_id <> '' and object_property_name <> ''").select(F.lower("object_type").alias("object_type"), "object_id", F.col("object_property_name").alias("name"), F.col("object_property_value").alias("value"))


def _bits(names: tuple[str, ...], have: list[str]) -> Column:
    return sum((F.when(number(n) == 1, 1 << k).otherwise(0) for k, n in enumerate(names) if n in have), F.lit(0)).cast("int")


def equipments(rows: DataFrame) -> DataFrame:
    """(equipment_id, bits): what a stop offers."""
    return _keyed(rows, "equipment_id").select("equipment_id", _bits(STOP_BITS, rows.columns).alias("bits"))


def trip_properties(rows: DataFrame) -> DataFrame:
    """(trip_property_id, bits): what a trip's vehicle offers."""
    return _keyed(rows, "trip_property_id").select("trip_property_id", _bits(TRIP_BITS, rows.columns).alias("bits"))


def grid_calendars(rows: DataFrame) -> DataFrame:
    """(grid_calendar_id, name, mask): bit 0 is Monday."""
    mask = sum((F.when(number(w) == 1, 1 << k).otherwise(0) for k, w in enumerate(WEEK)), F.lit(0))
    return _keyed(rows, "grid_calendar_id").select("grid_calendar_id", "name", mask.cast("int").alias("mask"))


def grid_periods(rows: DataFrame) -> DataFrame:
    """(grid_calendar_id, begin, end), the end exclusive; periods without both days are left out."""
    return rows.select("grid_calendar_id", day("start_date").alias("begin"), F.date_add(day("end_date"), 1).alias("end")).where("begin is not null and end is not null")


def grid_exceptions(rows: DataFrame) -> DataFrame:
    """(grid_calendar_id, day, type) with type 1 added and 2 removed, as calendars take them; the
    file says 0 for removed, other types are left out."""
    kind = F.when(number("type") == 0, 2).when(number("type") == 1, 1)
    return rows.select("grid_calendar_id", day("date").alias("day"), kind.alias("type")).where("day is not null and type is not null")


def grid_links(rows: DataFrame, calendars: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(grid_calendar_id, key): links of known calendars to known lines or trips."""
    return rows.select("grid_calendar_id", key).distinct().join(calendars, "grid_calendar_id", "left_semi").join(known.select(key), key, "left_semi").select("grid_calendar_id", key)


def admin_stations(rows: DataFrame, areas: DataFrame) -> DataFrame:
    """(admin_id, area_id): the main known areas of each admin."""
    return rows.select("admin_id", F.col("station_id").alias("area_id")).distinct().join(areas.select("area_id"), "area_id", "left_semi").select("admin_id", "area_id")


def addresses(rows: DataFrame) -> DataFrame:
    return _keyed(rows, "address_id").select("address_id", F.col("street_name").alias("street"), F.col("house_number").alias("number"))


def zones_and_access(stops: DataFrame) -> DataFrame:
    """Stops by location type: stop, area, zone (with its geometry) and access; others are left out."""
    kind = F.element_at(F.array(*map(F.lit, ("stop", "area", "zone", "access"))), F.coalesce(number("location_type"), F.lit(0)) + 1)
    return _keyed(stops.where(F.coalesce(number("location_type"), F.lit(0)).between(0, 3)), "stop_id").select("stop_id", kind.alias("kind"), F.col("stop_name").alias("name"), number("stop_lon", "double").alias("lon"), number("stop_lat", "double").alias("lat"), "parent_station", "geometry_id")


def trips(rows: DataFrame, days: DataFrame, properties: DataFrame, zone: str) -> DataFrame:
    """One row per trip and period of one UTC offset: trip_id, part (from 0), route_id, company_id,
    mode, block_id, headsign, bits, begin and end (first and last day of the part) and offset (minutes).

    days is (service_id, day); a trip whose service runs across a change of the offset is split.
    """
    told = _keyed(rows, "trip_id")
    spans = offset_periods(days.select("day").distinct(), zone)
    dated = days.join(spans, (F.col("day") >= F.col("begin")) & (F.col("day") <= F.col("end"))).groupBy("service_id", "offset", F.col("begin").alias("of_span")).agg(F.min("day").alias("begin"), F.max("day").alias("end"))
    bits = properties.select("trip_property_id", "bits")
    out = told.join(dated, "service_id").join(bits, "trip_property_id", "left")
    earlier = F.sort_array(F.collect_list("begin").over(_by_trip()))
    return out.withColumn("part", (F.array_position(earlier, F.col("begin")) - 1).cast("int")).select("trip_id", "part", "route_id", "company_id", F.col("physical_mode_id").alias("mode"), "block_id", F.col("trip_headsign").alias("headsign"), F.coalesce("bits", F.lit(0)).alias("bits"), "begin", "end", "offset")


def _by_trip():
    from pyspark.sql import Window

    return Window.partitionBy("trip_id")  # a trip has a row for each change of the offset: two a year
