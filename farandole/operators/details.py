"""Smaller rules: realtime statuses, sections on patterns, shapes of circles, addresses, tags."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farandole.functions.columns import DAY, EARTH_RADIUS, RADIAN
from farandole.operators.folds import folded

#: Status of an amended stop event, in order of precedence, and the trip's effect.
STATUSES = ("UNCHANGED", "ADDED", "ADDED_FOR_DETOUR", "DELETED", "DELETED_FOR_DETOUR", "DELAYED")
EFFECTS = {"ADDED": "MODIFIED_SERVICE", "ADDED_FOR_DETOUR": "DETOUR", "DELETED": "REDUCED_SERVICE", "DELETED_FOR_DETOUR": "DETOUR", "DELAYED": "SIGNIFICANT_DELAYS"}


def event_status(told: Column, relationship: Column, delay: Column) -> Column:
    """The told status, else by relationship; a delay that is missing or not 0 means DELAYED."""
    return F.coalesce(told, F.when(relationship == "SKIPPED", "DELETED").when(relationship == "ADDED", "ADDED").when(delay.isNull() | (delay != 0), "DELAYED").otherwise("UNCHANGED"))


def trip_effects(events: DataFrame, by: str) -> DataFrame:
    """The status of highest precedence of each trip's stop events, and its effect."""
    ordinal = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    worst = events.groupBy(by).agg(F.max_by("status", ordinal).alias("status"))
    effect = F.create_map(*[F.lit(x) for pair in EFFECTS.items() for x in pair])
    return worst.withColumn("effect", F.coalesce(F.try_element_at(effect, F.col("status")), F.lit("UNKNOWN_EFFECT")))


def matches_from_first(areas: Column, pattern: list[str]) -> Column:
    """Whether the areas hold the pattern, without gaps, at the first place of its first area."""
    at = F.array_position(areas, pattern[0])
    return (at > 0) & (F.slice(areas, F.greatest(at, F.lit(1)).cast("int"), len(pattern)) == F.array(*map(F.lit, pattern)))


def circle(lon: Column, lat: Column, metres: Column, corners: int = 180) -> Column:
    """The ring of points so many metres around a centre."""
    d, la = metres / EARTH_RADIUS, lat * RADIAN

    def corner(k: Column) -> Column:
        bearing = k * (2 * math.pi / corners)
        to = F.asin(F.sin(la) * F.cos(d) + F.cos(la) * F.sin(d) * F.cos(bearing))
        east = F.atan2(F.sin(bearing) * F.sin(d) * F.cos(la), F.cos(d) - F.sin(la) * F.sin(to))
        return F.struct((lon + east / RADIAN).alias("lon"), (to / RADIAN).alias("lat"))

    return F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), corner)


def house_positions(queries: DataFrame, houses: DataFrame) -> DataFrame:
    """(query_id, lon, lat): where a number lies on its way's side (odd or even): at the house
    itself, linearly between its neighbours, or at the side's end beyond them."""
    side = houses.withColumn("side", F.col("number") % 2)
    asked = queries.withColumn("side", F.col("number") % 2).withColumnRenamed("number", "wanted")
    met = asked.join(side, ["way_id", "side"])
    here = F.struct("number", "lon", "lat")
    ends = met.groupBy("query_id", "wanted").agg(F.max(F.when(F.col("number") <= F.col("wanted"), here)).alias("low"), F.min(F.when(F.col("number") >= F.col("wanted"), here)).alias("high"))
    low, high = F.coalesce("low", "high"), F.coalesce("high", "low")
    share = F.when(high["number"] > low["number"], (F.col("wanted") - low["number"]) / (high["number"] - low["number"])).otherwise(0.0)
    return ends.select("query_id", *[(low[c] + (high[c] - low[c]) * share).alias(c) for c in ("lon", "lat")])


def rotated(times: DataFrame, by: str, reference: int) -> DataFrame:
    """Times of day in order from the reference time on."""
    order = F.pmod(F.col("at") - reference, F.lit(DAY))
    return times.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(order, "id")))


def week_groups(days: DataFrame, key: str) -> DataFrame:
    """Runs of consecutive ISO weeks with the same weekdays: (key, mask, begin, weeks)."""
    monday = F.date_trunc("week", "day").cast("date")
    weeks = days.groupBy(key, monday.alias("week")).agg(F.bit_or(F.expr("shiftleft(1, weekday(day))")).alias("mask"))
    island = F.floor(F.datediff("week", F.lit("2000-01-03").cast("date")) / 7) - F.row_number().over(Window.partitionBy(key, "mask").orderBy("week"))
    return weeks.withColumn("island", island).groupBy(key, "mask", "island").agg(F.min("week").alias("begin"), F.count(F.lit(1)).alias("weeks")).drop("island")


def distance_matrix(paths: DataFrame, origins: DataFrame, destinations: DataFrame, known: DataFrame) -> DataFrame:
    """(origin, destination, cost, status) for a request's few origins and destinations: reached
    within the radius, unreached, or unknown to the graph."""
    pairs = origins.select("origin").crossJoin(destinations.select("destination"))
    rows = pairs.join(paths.withColumnRenamed("node", "destination"), ["origin", "destination"], "left").join(known.select(F.col("node").alias("destination"), F.lit(True).alias("known")).distinct(), "destination", "left")
    return rows.select("origin", "destination", "cost", F.when(F.col("cost").isNotNull(), "reached").when(F.col("known"), "unreached").otherwise("unknown").alias("status"))


def waiting(transfer: Column, gap: Column) -> Column:
    """What is left of a gap between two rides after the transfer."""
    return F.greatest(F.lit(0), gap - transfer)


def reliable(sections: DataFrame, by: str, modes: list[str]) -> DataFrame:
    """Whether all sections of each journey are of a reliable mode and undisrupted."""
    return sections.groupBy(by).agg(F.bool_and(F.col("mode").isin(modes) & ~F.col("disrupted")).alias("reliable"))


def ecologic(emission: Column, car_emission: Column) -> Column:
    """Less than half of what a car emits; without a car's value nothing is, without an own one it is."""
    return F.when(car_emission.isNull(), False).when(emission.isNull(), True).otherwise(emission < car_emission * 0.5)


def boarding_positions(sections: DataFrame, positions: DataFrame, by: str) -> DataFrame:
    """Each section with the best place to board for the change to the next one (from_stop, to_stop)."""
    ahead = F.lead("stop_id").over(Window.partitionBy(by).orderBy("rank"))
    return sections.withColumn("to_stop", ahead).join(positions, (F.col("stop_id") == F.col("p_from")) & (F.col("to_stop") == F.col("p_to")), "left").drop("p_from", "p_to")


def split_overtaking(stop_times: DataFrame, patterns: DataFrame) -> DataFrame:
    """(trip_id, part): trips of one pattern (trip_id, pattern) split so that none overtakes
    another of its part. Trips are taken in order of their times and ids, each joins the first part
    whose every trip is strictly ahead of it at all stops."""

    def split(key: tuple, group: Iterator[tuple]) -> Iterator[tuple]:
        # In this order no trip is ahead of an earlier one at the first stop, so it has to be behind a
        # whole part at all stops: behind the part's last trip, which is behind the others.
        last, used = np.empty((16, 0), np.int64), 0
        for times, trip in group:
            now = np.array(times, np.int64)
            if not used:
                last = np.empty((16, len(now)), np.int64)
            behind = (last[:used] < now).all(axis=1)
            n = int(behind.argmax()) if behind.any() else used
            if n == used:
                used += 1
                if used > len(last):
                    last = np.concatenate([last, np.empty_like(last)])
            last[n] = now
            yield trip, n

    stops = F.sort_array(F.collect_list(F.struct("rank", F.array("arrival", "departure").alias("t"))))
    times = stop_times.groupBy("trip_id").agg(F.flatten(F.transform(stops, lambda s: s["t"])).alias("times"))
    rows = times.join(patterns, "trip_id").select("pattern", "times", "trip_id")
    return folded(rows, ["pattern"], ["times", "trip_id"], split, "trip_id long, part int")


def mode_combinations(first: DataFrame, last: DataFrame, allowed: DataFrame) -> DataFrame:
    """Pairs of a first and a last mode that are allowed; a handful of modes each."""
    return allowed.join(F.broadcast(first), "first").join(F.broadcast(last), "last").select("first", "last")
