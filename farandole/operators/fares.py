"""Fares: tickets by origin and destination, dated prices, and the cheapest chain of tickets."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farandole.functions.columns import DAY
from farandole.operators.folds import folded


def od_tickets(journeys: DataFrame, fares: DataFrame) -> DataFrame:
    """The most specific fare of each journey (id and origin/destination levels `o_<level>`,
    `d_<level>`): on each end stop beats mode beats zone. fares: o_level, o_key, d_level, d_key,
    ticket. Levels are 0 stop, 1 mode, 2 zone."""
    ends = lambda side: F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"{side}_{name}").cast("string").alias("key")) for k, name in enumerate(("stop", "mode", "zone"))])).alias(side)
    rows = journeys.select("id", "o_stop", "o_mode", "o_zone", "d_stop", "d_mode", "d_zone").select("id", "d_stop", "d_mode", "d_zone", ends("o")).select("id", "o", ends("d"))
    met = rows.select("id", F.col("o.level").alias("o_level"), F.col("o.key").alias("o_key"), F.col("d.level").alias("d_level"), F.col("d.key").alias("d_key")).join(fares, ["o_level", "o_key", "d_level", "d_key"])
    return met.groupBy("id").agg(F.min(F.struct("o_level", "d_level", "ticket")).alias("f")).select("id", "f.ticket", "f.o_level", "f.d_level")


def dated_prices(rides: DataFrame, prices: DataFrame) -> DataFrame:
    """The first price period (ticket, begin, end, price) that holds each ride's day."""
    met = rides.join(prices, "ticket").where((F.col("day") >= F.col("begin")) & (F.col("day") < F.col("end")))
    return met.groupBy("id", "ticket", "day").agg(F.min(F.struct("begin", "price")).alias("p")).select("id", "ticket", "day", "p.price")


def transition_allowed(duration: Column, changes: Column, max_duration: Column, max_changes: Column) -> Column:
    return (duration <= max_duration) & (changes <= max_changes)


def best_fares(rides: DataFrame, price: int = 170, duration: int = 5400, max_changes: int = 2, exclusive: str = "signup", exclusive_price: int = 900) -> DataFrame:
    """(journey_id, cost, tickets, changes) of the cheapest tickets for each journey's rides
    (journey_id, nth, at in seconds, kind).

    Labels go from ride to ride: a ticket in hand is kept while its duration and changes allow
    it, or a new one is bought; a ride of the exclusive kind needs its own ticket and ends all
    others. The best label is the smallest (cost, tickets, changes).
    """

    def fold(key: tuple, group: Iterator[tuple]) -> Iterator[tuple]:
        labels: dict[tuple[int, int] | None, tuple[int, int, int]] = {None: (0, 0, 0)}
        for _, at, kind in group:
            new: dict = {}

            def reach(state, cost, new=new):
                if state not in new or cost < new[state]:
                    new[state] = cost

            for state, (cost, tickets, changes) in labels.items():
                if kind == exclusive:
                    reach(None, (cost + exclusive_price, tickets + 1, changes))
                    continue
                if state is not None and at - state[0] <= duration and state[1] < max_changes:
                    reach((state[0], state[1] + 1), (cost, tickets, changes + 1))
                reach((at, 0), (cost + price, tickets + 1, changes))
            labels = new
        yield (*key, *min(labels.values()))

    rows = rides.select("journey_id", F.col("nth").cast("int"), F.col("at").cast("long"), "kind")
    return folded(rows, ["journey_id"], ["nth"], fold, "journey_id string, cost long, tickets long, changes long")


def cheapest(options: DataFrame, by: str) -> DataFrame:
    """Of priced options (undefined, cost, tickets, changes) the best of each group: an undefined
    part counts more than any price."""
    order = Window.partitionBy(by).orderBy("undefined", "cost", "tickets", "changes", "id")
    return options.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


#: Most transitions of a fare graph: a table of rules, checked before it goes to the tasks.
MOST_TRANSITIONS = 10_000
_CONDITION = re.compile(r"\s*(\w+)\s*(<=|>=|!=|=|<|>)\s*([^&]*?)\s*$")
_COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


def parse_conditions(text: str | None) -> list[tuple[str, str, str]]:
    """`key op value` joined by &; empty or "true" always holds; any other text is an error."""
    if not (text or "").strip() or text.strip().lower() == "true":
        return []
    found = [_CONDITION.match(part) for part in text.split("&")]
    if not all(found):
        raise ValueError(f"not a condition: {text}")
    return [m.groups() for m in found]


def parse_state(text: str | None) -> dict[str, str]:
    """`*` for any section, or equalities, each key once."""
    if (text or "").strip() in ("", "*"):
        return {}
    told = parse_conditions(text)
    if any(op != "=" for _, op, _ in told) or len({k for k, _, _ in told}) < len(told):
        raise ValueError(f"not a state: {text}")
    return {k: v for k, _, v in told}


def holds(value: object, op: str, told: str) -> bool:
    """Numbers are compared as numbers, other values as text; no value holds nothing."""
    if value is None:
        return False
    try:
        return _COMPARE[op](float(value), float(told))
    except ValueError:
        return _COMPARE[op](str(value), told)


def elapsed(at: int, punched: int) -> int:
    """Seconds since a ticket was punched, a day on if the clock went past midnight."""
    return at - punched + (DAY if at < punched else 0)


def transitions(spark: SparkSession, path: str, tickets: set[str]) -> DataFrame:
    """A fare graph's `;` file with a header: start_state, start_conditions, end_state, end_conditions,
    global_condition and ticket. Rows of another width or with an unknown ticket are left out; a
    symetric one also stands with its conditions exchanged, under the same states."""
    names = ["start_state", "start_conditions", "end_state", "end_conditions", "global_condition", "ticket"]
    lines = spark.read.text(path).select(F.split("value", ";").alias("c"), F.monotonically_increasing_id().alias("n"))
    header = F.col("n") == lines.agg(F.min("n")).first()[0]
    rows = lines.where(~header & (F.size("c") == len(names))).select(*[F.trim(F.col("c")[k]).alias(n) for k, n in enumerate(names)])
    rows = rows.where((F.col("ticket") == "") | F.col("ticket").isin(sorted(tickets)))
    swapped = rows.where("global_condition = 'symetric'").withColumns({"start_conditions": F.col("end_conditions"), "end_conditions": F.col("start_conditions")})
    return rows.unionByName(swapped)


def origin_destination_fares(spark: SparkSession, path: str, tickets: set[str]) -> DataFrame:
    """(o_mode, o, d_mode, d, tickets) of a `;` file without header: a pair of ends and any number of
    tickets; unknown ones are left out, so is a row without any, and the last row of a pair counts."""
    lines = spark.read.text(path).select(F.transform(F.split("value", ";"), F.trim).alias("c"), F.monotonically_increasing_id().alias("n")).where(F.size("c") >= 7)
    known = F.filter(F.slice("c", 7, 1_000), lambda t: t.isin(sorted(tickets)))
    rows = lines.select(F.col("c")[1].alias("o_mode"), F.col("c")[0].alias("o"), F.col("c")[4].alias("d_mode"), F.col("c")[3].alias("d"), "n", known.alias("tickets")).where("size(tickets) > 0")
    return rows.groupBy("o_mode", "o", "d_mode", "d").agg(F.max_by("tickets", "n").alias("tickets"))


def graph_fares(sections: DataFrame, graph: DataFrame, prices: DataFrame) -> DataFrame:
    """(journey_id, cost, tickets, changes): the cheapest way through a fare graph for the sections of each
    journey (journey_id, nth, start, end, and any string columns that states name).

    graph has the columns of transitions(), prices (ticket, price). A label is a ticket in hand, when it was
    punched, its changes and the section before. A transition fits if its start state and conditions (of
    the ticket in hand: ticket, duration, nb_changes) hold, and its end state and conditions hold for the
    section; with a ticket it buys it, without one it goes on with the one in hand. Where an exclusive
    transition fits, only such count, and no ticket is in hand after them. A section that nothing fits
    makes the cost null.
    """
    told = graph.limit(MOST_TRANSITIONS + 1).collect()
    if len(told) > MOST_TRANSITIONS:
        raise ValueError(f"more than {MOST_TRANSITIONS} transitions")
    used = sorted({t.ticket for t in told if t.ticket})
    costs = {r.ticket: r.price for r in prices.where(F.col("ticket").isin(used)).collect()}
    rules = [(parse_state(t.start_state), parse_conditions(t.start_conditions), parse_state(t.end_state), parse_conditions(t.end_conditions), t.global_condition or "", t.ticket or "") for t in told]
    names = [c for c in sections.columns if c not in ("journey_id", "nth", "start", "end")]

    def fold(key: tuple, group: Iterator[tuple]) -> Iterator[tuple]:
        labels: dict[tuple, tuple] = {(None, None, 0): (0, 0, 0)}
        before: dict[str, str] = {}
        for _, start, end, *values in group:
            section = dict(zip(names, values, strict=True))
            found: dict[bool, dict[tuple, tuple]] = {False: {}, True: {}}
            for (ticket, punched, changes), (cost, tickets, total) in labels.items():
                hand = {"ticket": ticket, "duration": None if punched is None else elapsed(start, punched), "nb_changes": changes}
                for start_state, starts, end_state, ends, kind, buys in rules:
                    here = {"duration": None if punched is None else elapsed(end, punched), "ticket": ticket, "nb_changes": changes} | section
                    fits = all(before.get(k) == v for k, v in start_state.items()) and all(section.get(k) == v for k, v in end_state.items())
                    if not fits or not all(holds(hand.get(k), op, v) for k, op, v in starts) or not all(holds(here.get(k), op, v) for k, op, v in ends):
                        continue
                    if buys and buys in costs:
                        state, paid = (buys, start, 0), (cost + costs[buys], tickets + 1, total)
                    elif not buys and ticket is not None:
                        state, paid = (ticket, punched, changes + 1), (cost, tickets, total + 1)
                    else:
                        continue
                    only = kind == "exclusive"
                    state = (None, None, 0) if only else state
                    if state not in found[only] or paid < found[only][state]:
                        found[only][state] = paid
            labels, before = found[True] or found[False], section
        yield (*key, *(min(labels.values()) if labels else (None, None, None)))

    rows = sections.select("journey_id", F.col("nth").cast("int"), F.col("start").cast("long"), F.col("end").cast("long"), *[F.col(c).cast("string") for c in names])
    return folded(rows, ["journey_id"], ["nth"], fold, "journey_id string, cost long, tickets long, changes long")
