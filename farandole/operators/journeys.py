"""Journey post-processing: one row per journey, compared within its request."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farandole.operators.folds import folded


def best_of_similar(journeys: DataFrame, by: str, signature: list[str], order: list[str]) -> DataFrame:
    """Of journeys of one request with the same signature the first one in the order."""
    nth = F.row_number().over(Window.partitionBy(by, *signature).orderBy(*order))
    return journeys.withColumn("nth", nth).where("nth = 1").drop("nth")


def on_demand_kept(journeys: DataFrame, by: str) -> DataFrame:
    """On-demand journeys only stay if they arrive before the earliest fixed one."""
    best = F.min(F.when(~F.col("on_demand"), F.col("arrival"))).over(Window.partitionBy(by))
    return journeys.withColumn("best", best).where(~F.col("on_demand") | F.col("best").isNull() | (F.col("arrival") < F.col("best"))).drop("best")


def few_connections(journeys: DataFrame, by: str, additional: int) -> DataFrame:
    """At most so many connections more than the request's best journey."""
    best = F.min("connections").over(Window.partitionBy(by))
    return journeys.withColumn("best", best).where(F.col("connections") <= F.col("best") + additional).drop("best")


def not_late(journeys: DataFrame, by: str, factor: float, base: int) -> DataFrame:
    """Pseudo duration at most best * factor + base."""
    best = F.min("pseudo_duration").over(Window.partitionBy(by))
    return journeys.withColumn("best", best).where(F.col("pseudo_duration") <= F.col("best") * factor + base).drop("best")


def typed(journeys: DataFrame, by: str, classes: dict[str, tuple[Column, list[str]]]) -> DataFrame:
    """The best journey of each request and class: (by, type, id). A class is a constraint and
    the columns in whose order its smallest journey is best."""
    out = None
    for name, (allowed, order) in classes.items():
        first = journeys.where(allowed).groupBy(by).agg(F.min(F.struct(*order, "id")).alias("b")).select(by, F.lit(name).alias("type"), F.col("b.id").alias("id"))
        out = first if out is None else out.unionByName(first)
    return out


def totals(sections: DataFrame, by: str, modes: list[str]) -> DataFrame:
    """Sums of duration by mode, total length, and emissions (null if no section has any)."""
    per = [F.sum(F.when(F.col("mode") == m, F.col("duration")).otherwise(0)).alias(f"duration_{m.lower()}") for m in modes]
    return sections.groupBy(by).agg(*per, F.sum("length").alias("length"), F.sum("emission").alias("emission"))


def heaviest_mode(sections: DataFrame, by: str) -> DataFrame:
    """The mode of largest weight in each journey; ties go to the smaller name."""
    return sections.groupBy(by).agg(F.min(F.struct((-F.col("weight")).alias("w"), "mode")).alias("b")).select(by, F.col("b.mode").alias("mode"))


def waiting_within(sections: DataFrame, by: str, most: int) -> DataFrame:
    """Journeys without a waiting section of `most` seconds or longer."""
    return sections.groupBy(by).agg(F.max(F.when(F.col("kind") == "waiting", F.col("duration"))).alias("w")).where(F.coalesce("w", F.lit(0)) < most).select(by)


def aggregated(sections: DataFrame, by: str) -> DataFrame:
    """Journeys with the same sequence of section ids: the smallest stands for all."""
    ids = sections.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "section"))), lambda s: s["section"].cast("string")), ">").alias("path"))
    return ids.groupBy("path").agg(F.min(by).alias(by), F.count(F.lit(1)).alias("journeys"))


def _any_section(sections: DataFrame, condition: Column) -> DataFrame:
    return sections.where(condition).select("journey_id").distinct()


def long_enough(journeys: DataFrame, sections: DataFrame, least: dict[str, int]) -> DataFrame:
    """Journeys (journey_id) whose total time on each heavy street mode (bike, car, ...) is at least that mode's
    least; sections (journey_id, mode, duration, shared) on a shared bike don't count."""
    told = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
    heavy = sections.where(F.col("mode").isin(sorted(least)) & ~F.col("shared")).groupBy("journey_id", "mode").agg(F.sum("duration").alias("total"))
    return journeys.join(heavy.where(F.col("total") < F.try_element_at(told, F.col("mode"))), "journey_id", "left_anti")


def by_direct_path(journeys: DataFrame, policy: str) -> DataFrame:
    """Direct paths (journey_id, request_id, direct) by policy: none, only, indifferent, or
    only_with_alternatives: a direct path stays only beside another journey of its request."""
    if policy == "none":
        return journeys.where("not direct")
    if policy == "only":
        return journeys.where("direct")
    if policy == "only_with_alternatives":
        others = journeys.where("not direct").select("request_id").distinct()
        return journeys.where("not direct").unionByName(journeys.where("direct").join(others, "request_id", "left_semi"))
    return journeys


def allowed_direct_modes(journeys: DataFrame, modes: list[str]) -> DataFrame:
    """Journeys without direct paths of other modes (direct, direct_mode)."""
    return journeys.where(~F.col("direct") | F.coalesce(F.col("direct_mode").isin(modes), F.lit(False)))


def short_direct_paths(journeys: DataFrame, longest: dict[str, int]) -> DataFrame:
    """Journeys without direct paths longer than their mode's longest (direct, direct_mode, duration)."""
    told = F.create_map(*[F.lit(x) for pair in longest.items() for x in pair])
    most = F.try_element_at(told, F.col("direct_mode"))
    return journeys.where(~F.col("direct") | most.isNull() | (F.col("duration") <= most))


def all_filters(journeys: DataFrame, rules: list[tuple[str, Column]], debug: bool = False) -> DataFrame:
    """Journeys that all the rules (name, condition) keep; with debug all of them, with the names of the rules
    that drop them in order (dropped_by)."""
    if not debug:
        for _, keep in rules:
            journeys = journeys.where(keep)
        return journeys
    names = F.array(*[F.when(~F.coalesce(keep, F.lit(False)), F.lit(name)) for name, keep in rules])
    return journeys.withColumn("dropped_by", F.filter(names, lambda n: n.isNotNull()))


def referenced(rows: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Tickets or terminus points that some journey still refers to."""
    return rows.join(links.select(key).distinct(), key, "left_semi")


def merged(responses: list[DataFrame]) -> DataFrame:
    """Journeys of several responses in one, with ids of their own: response and journey_id before it."""
    out = None
    for n, r in enumerate(responses):
        told = r.withColumn("journey_id", F.concat_ws("-", F.lit(n), F.col("journey_id").cast("string"))).withColumn("response", F.lit(n))
        out = told if out is None else out.unionByName(told, allowMissingColumns=True)
    return out


def in_request_order(journeys: DataFrame, clockwise: bool = True) -> DataFrame:
    """Journeys by arrival where the request is for a departure, else the latest departure first."""
    return journeys.orderBy("arrival", F.desc("departure"), "journey_id") if clockwise else journeys.orderBy(F.desc("departure"), "arrival", "journey_id")


def pseudo_duration(requested: Column, departure: Column, arrival: Column, clockwise: bool = True) -> Column:
    """Seconds between the requested time and the end of the journey that isn't asked for."""
    return F.abs((arrival if clockwise else departure) - requested)


def culled(journeys: DataFrame, sections: DataFrame, by: str, most: int) -> DataFrame:
    """At most so many journeys (journey_id, by, must_keep, pseudo_duration) of each request: those that must stay,
    then, one at a time, the one that adds most sections (journey_id, section) not covered yet; ties go to
    fewer sections, then to the smaller pseudo duration and id."""
    of = sections.select("journey_id", "section").distinct().groupBy("journey_id").agg(F.sort_array(F.collect_set(F.col("section").cast("string"))).alias("sections"))
    rows = journeys.join(of, "journey_id", "left").select(by, "journey_id", "must_keep", F.col("pseudo_duration").cast("long"), F.coalesce("sections", F.array().cast("array<string>")).alias("sections"))

    def choose(key: tuple, group: Iterator[tuple]) -> Iterator[tuple]:
        left = [(i, keep, d, frozenset(s)) for i, keep, d, s in group]  # a request's journeys: a page
        chosen = [x for x in left if x[1]]
        covered = frozenset().union(*(x[3] for x in chosen)) if chosen else frozenset()
        left = [x for x in left if not x[1]]
        while left and len(chosen) < most:
            best = min(left, key=lambda x: (-len(x[3] - covered), len(x[3]), x[2], x[0]))
            left.remove(best)
            chosen.append(best)
            covered |= best[3]
        for x in chosen:
            yield key[0], x[0]

    return folded(rows, [by], ["journey_id"], choose, f"{by} {_kind(journeys, by)}, journey_id {_kind(journeys, 'journey_id')}")


def _kind(rows: DataFrame, c: str) -> str:
    return {"bigint": "long"}.get(kind := rows.schema[c].dataType.simpleString(), kind)
