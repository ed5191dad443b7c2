"""Rounds of a search don't shuffle again what doesn't change between them."""

import pytest
from pyspark.sql import functions as F

from farandole.operators import routing, search


def shuffled(spark, job):
    """MB that the stages of a job write to shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = total()
    job()
    return (total() - before) / 1e6


@pytest.fixture
def chain(spark):
    """100,000 trips between two stops each, of which a search takes one after the other."""
    trips = spark.range(100_000).select(F.col("id").alias("trip_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("rank"))
    rows = trips.select("trip_id", "rank", (F.col("trip_id") + F.col("rank")).alias("stop_id"), (F.col("trip_id") * 10 + F.col("rank") * 5).alias("arrival"))
    return rows.withColumn("departure", F.col("arrival") + 1)


def test_rounds_of_rides(spark, chain):
    seeds = spark.createDataFrame([(0, 0)], "stop_id long, arrival long")
    few, many = (shuffled(spark, lambda n=n: routing.earliest_arrivals(chain, seeds, None, n, 10_000_000).count()) for n in (1, 7))
    assert many < 1.5 * few


def test_rounds_of_paths(spark, chain):
    edges = chain.where("rank = 0").select(F.col("stop_id").alias("a"), (F.col("stop_id") + 1).alias("b"), F.lit(1).cast("long").alias("cost"))
    origins = spark.createDataFrame([(0, 0)], "origin long, node long")
    few, many = (shuffled(spark, lambda n=n: routing.shortest_paths(edges, origins, n).count()) for n in (1, 7))
    assert many < 1.5 * few


def test_rounds_by_days(spark, chain):
    rides = chain.select(F.col("trip_id").cast("string").alias("run"), "trip_id", "rank", "stop_id", "arrival", "departure", F.lit(True).alias("pick_up"), F.lit(True).alias("drop_off"), F.lit(None).cast("long").alias("zone"))
    seeds = spark.createDataFrame([("x", 0, 0, 10_000_000)], "search string, stop_id long, arrival long, bound long")
    walks = spark.createDataFrame([], "from_stop long, to_stop long, duration long")
    few, many = (shuffled(spark, lambda n=n: search.labels(rides, seeds, walks, n).count()) for n in (1, 6))
    assert many < 1.5 * few
