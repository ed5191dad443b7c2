"""Journey search by days: rounds of rides with boarding rules, zones, stay-in and parents, in both
directions, for many searches at once; journeys are read back from the labels.

Times are absolute seconds from midnight of `day0`. A run is a trip on one of its days. Every table
of labels has a column `search`, so one job answers all requests, and all second passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farandole.functions.columns import DAY
from farandole.scratch import bucketed, stored

_LEG = ("arrival", "via_stop", "run", "board_stop", "board_at", "alight_at", "rides")


def runs(stop_times: DataFrame, days: DataFrame, day0: str, span: int) -> DataFrame:
    """Stop times (trip_id, rank, stop_id, arrival, departure, pick_up, drop_off, zone) of every trip on
    its days (trip_id, day), from the day before day0 on for `span` days: run, trip_id, rank, stop_id,
    arrival, departure, pick_up, drop_off and zone. Zone null or 0 is none."""
    nth = F.datediff("day", F.lit(day0).cast("date"))
    near = days.select("trip_id", nth.alias("nth")).where((F.col("nth") >= -1) & (F.col("nth") < span))
    told = stop_times.join(near, "trip_id")
    at = lambda c: (F.col(c) + F.col("nth") * DAY).cast("long").alias(c)
    run = F.concat_ws("/", "trip_id", "nth")
    return told.select(run.alias("run"), "trip_id", "rank", "stop_id", at("arrival"), at("departure"), "pick_up", "drop_off", F.when(F.col("zone") != 0, F.col("zone")).alias("zone"))


def mirrored(rides: DataFrame) -> DataFrame:
    """The runs backwards in time: a search over them from negated arrivals finds latest departures."""
    return rides.select("run", "trip_id", (-F.col("rank")).alias("rank"), "stop_id", (-F.col("departure")).alias("arrival"), (-F.col("arrival")).alias("departure"), F.col("drop_off").alias("pick_up"), F.col("pick_up").alias("drop_off"), "zone")


def labels(rides: DataFrame, seeds: DataFrame, walks: DataFrame, rounds: int = 10, stay_in: DataFrame | None = None) -> DataFrame:
    """Labels of a round-based search with their parents: search, stop_id, round, arrival, via_stop (where
    the ride ends; the label's stop unless a walk follows), run, board_stop, board_at, alight_at, rides.

    seeds: search, stop_id, arrival, bound. A ride is boarded where pick-up is allowed, at a stop that the
    last round improved and not before its arrival, and left at a later stop where drop-off is allowed and
    whose local zone isn't the one boarded in. stay_in (run, next_run) goes on, in the same round, on the
    next trip of a block. walks (from_stop, to_stop, duration) follow rides. Nothing is later than the bound.

    Boardings by stop and alightings by run are written once in buckets, the latter without what lies after
    all bounds; rounds only shuffle what the last one improved.
    """
    seeds = stored(seeds, "seeds")
    bounds = seeds.select("search", "bound").groupBy("search").agg(F.max("bound").alias("bound"))
    first = seeds.where("arrival <= bound").groupBy("search", "stop_id").agg(F.min("arrival").alias("arrival"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("via_stop", rides.schema["stop_id"].dataType), ("run", "string"), ("board_stop", rides.schema["stop_id"].dataType), ("board_at", "long"), ("alight_at", "long"))]
    frontier = stored(first.select("search", "stop_id", F.lit(0).alias("round"), "arrival", *none, F.lit(0).alias("rides")), "labels")
    out = frontier
    rides = stored(rides, "rides")
    latest = seeds.agg(F.max("bound")).first()[0]
    board = rides.where("pick_up").select("run", "stop_id", F.col("rank").alias("from_rank"), "departure", F.col("zone").alias("from_zone"))
    alight = rides.where("drop_off").where(F.col("arrival") <= F.lit(latest)).select("run", F.col("stop_id").alias("to_stop"), F.col("rank").alias("to_rank"), F.col("arrival").alias("to_at"), F.col("zone").alias("to_zone"))
    board, alight = bucketed(board, "stop_id", "board"), bucketed(alight, "run", "alight")
    for k in range(1, rounds + 1):
        best = out.groupBy("search", "stop_id").agg(F.min("arrival").alias("before"))
        caught = board.join(frontier.select("search", "stop_id", "arrival").hint("shuffle_hash"), "stop_id").where("departure >= arrival")
        # Of the stops of a zone where a run can be boarded the first one reaches all that the others do.
        rider = F.min(F.struct("from_rank", F.col("stop_id").alias("board_stop"), F.col("departure").alias("board_at"))).alias("b")
        on = caught.groupBy("search", "run", "from_zone").agg(rider).select("search", "run", "from_zone", "b.*", F.col("run").alias("boarded"), F.lit(1).alias("rides"))
        on = stored(on, "on-board")
        ahead, chain = on, on
        while stay_in is not None:
            chain = stored(chain.join(stay_in, "run").select("search", F.col("next_run").alias("run"), "from_zone", F.lit(-(1 << 30)).alias("from_rank"), "board_stop", "board_at", "boarded", (F.col("rides") + 1).alias("rides")), "stay-in")
            if chain.isEmpty():
                break
            ahead = ahead.unionByName(chain)
        got = alight.join(ahead.hint("shuffle_hash"), "run").where("to_rank > from_rank").where(F.col("from_zone").isNull() | F.col("to_zone").isNull() | (F.col("from_zone") != F.col("to_zone")))
        ride = got.select("search", F.col("to_stop").alias("stop_id"), F.col("to_at").alias("arrival"), F.col("to_stop").alias("via_stop"), F.col("boarded").alias("run"), "board_stop", "board_at", F.col("to_at").alias("alight_at"), "rides")
        ride = ride.groupBy("search", "stop_id").agg(F.min(F.struct(*_LEG)).alias("l")).select("search", "stop_id", "l.*")
        walked = ride.join(walks, F.col("stop_id") == F.col("from_stop")).select("search", F.col("to_stop").alias("stop_id"), (F.col("arrival") + F.col("duration")).alias("arrival"), *_LEG[1:])
        reached = ride.unionByName(walked).groupBy("search", "stop_id").agg(F.min(F.struct(*_LEG)).alias("l")).select("search", "stop_id", "l.*").join(bounds, "search").where("arrival <= bound").drop("bound")
        better = reached.join(best, ["search", "stop_id"], "left").where("before is null or arrival < before").drop("before")
        frontier = stored(better.withColumn("round", F.lit(k)).select(*out.columns), "labels")
        if frontier.isEmpty():
            break
        out = stored(out.unionByName(frontier), "labels")
    return out


def journeys(found: DataFrame, targets: DataFrame) -> DataFrame:
    """The legs of every label of the targets (search, stop_id) beyond round 0: search, stop_id, round,
    arrival, leg (from 0 at the end of the journey), run, board_stop, board_at, via_stop, alight_at,
    to_stop (differs from via_stop if a walk follows) and rides (more than 1: stayed in)."""
    parent = found.select("search", F.col("stop_id").alias("p_stop"), F.col("round").alias("p_round"), *[F.col(c).alias(f"p_{c}") for c in ("arrival", "via_stop", "run", "board_stop", "board_at", "alight_at", "rides")])
    here = ["run", "board_stop", "board_at", "via_stop", "alight_at", "rides"]
    at = found.join(targets.select("search", "stop_id").distinct(), ["search", "stop_id"], "left_semi").where("round > 0")
    now = stored(at.select("search", "stop_id", "round", "arrival", F.lit(0).alias("leg"), F.col("round").alias("at_round"), F.col("stop_id").alias("to_stop"), *here), "legs")
    out = now
    while not now.isEmpty():
        back = now.select("search", "stop_id", "round", "arrival", (F.col("leg") + 1).alias("leg"), (F.col("at_round") - 1).alias("at_round"), F.col("board_stop").alias("to_stop"))
        hit = back.where("at_round > 0").join(parent.withColumnRenamed("search", "p_search"), (F.col("search") == F.col("p_search")) & (F.col("to_stop") == F.col("p_stop")) & (F.col("at_round") == F.col("p_round")))
        now = stored(hit.select("search", "stop_id", "round", "arrival", "leg", "at_round", "to_stop", *[F.col(f"p_{c}").alias(c) for c in here]), "legs")
        out = out.unionByName(now)
    return out.drop("at_round")


def latest_departures(rides: DataFrame, seeds: DataFrame, walks: DataFrame, rounds: int = 10, stay_in: DataFrame | None = None) -> DataFrame:
    """Labels (search, stop_id, round, departure) of a search backwards from seeds (search, stop_id,
    arrival, bound): the latest departure that still arrives in time, none before the bound."""
    back = walks.select(F.col("to_stop").alias("from_stop"), F.col("from_stop").alias("to_stop"), "duration")
    stay = stay_in.select(F.col("next_run").alias("run"), F.col("run").alias("next_run")) if stay_in is not None else None
    found = labels(mirrored(rides), seeds.select("search", "stop_id", (-F.col("arrival")).alias("arrival"), (-F.col("bound")).alias("bound")), back, rounds, stay)
    return found.withColumn("departure", -F.col("arrival")).drop("arrival")


def two_passes(rides: DataFrame, seeds: DataFrame, targets: DataFrame, walks: DataFrame, rounds: int = 10, stay_in: DataFrame | None = None) -> DataFrame:
    """(search, stop_id, round, arrival, departure): for each Pareto label of a target the latest start that
    still arrives then with no more rides. The first pass finds arrivals, one second pass goes backwards
    from all of them at once, each a search of its own."""
    found = labels(rides, seeds, walks, rounds, stay_in)
    starts = seeds.select("search", "stop_id", "arrival").toDF("of_search", "origin", "earliest")
    ends = stored(found.join(targets, ["search", "stop_id"], "left_semi").where("round > 0").select(F.col("search").alias("of_search"), F.col("stop_id").alias("target"), "round", "arrival"), "ends")
    key = F.concat_ws("/", "of_search", "target", "round")
    least = starts.groupBy("of_search").agg(F.min("earliest").alias("least"))
    again = ends.join(least, "of_search").select(key.alias("search"), F.col("target").alias("stop_id"), "arrival", F.col("least").alias("bound"))
    back = latest_departures(rides, again, walks, rounds, stay_in).select("search", F.col("stop_id").alias("origin"), F.col("round").alias("back_round"), "departure")
    met = ends.withColumn("search", key).join(back, "search").join(starts, ["of_search", "origin"]).where("back_round <= round and departure >= earliest")
    best = met.groupBy("of_search", "target", "round", "arrival").agg(F.max("departure").alias("departure"))
    return best.select(F.col("of_search").alias("search"), F.col("target").alias("stop_id"), "round", "arrival", "departure")


def better_on_time(penalty: int = 120):
    """Order of journeys by time (arrival, departure, transfers): a transfer counts as a penalty; ties go
    to the later departure, then to fewer transfers."""
    return [F.col("arrival") + F.col("transfers") * penalty, F.desc("departure"), F.col("transfers")]


def better_on_walking(penalty: int = 120):
    """Order of journeys by walking (walking seconds, transfers)."""
    return [F.col("walking") + F.col("transfers") * penalty, F.col("transfers")]


def valid_solutions(legs: DataFrame, start: int, end: int) -> DataFrame:
    """Legs of journeys that lie inside the request and don't change between two estimated stop times
    (journey_id, leg, board_at, alight_at, board_estimated, alight_estimated)."""
    from pyspark.sql import Window

    ahead = F.lead("board_estimated").over(Window.partitionBy("journey_id").orderBy("leg"))
    bad = legs.withColumn("next_estimated", ahead).groupBy("journey_id").agg(F.bool_or((F.col("board_at") < start) | (F.col("alight_at") > end) | (F.col("alight_estimated") & F.coalesce("next_estimated", F.lit(False)))).alias("bad"))
    return legs.join(bad.where("not bad").select("journey_id"), "journey_id", "left_semi")


def keep_going(found: int, total: int, least: int | None, most: int | None, in_frame: bool | None) -> bool:
    """Whether a repeated search goes on: as long as fewer than the least are found; with a time frame,
    while it isn't left and the most isn't reached; without both, one search is enough."""
    if total == 0 or found == 0:
        return False
    if most is not None and total >= most:
        return False
    if least is not None and total < least:
        return True
    return bool(in_frame) if in_frame is not None else False
