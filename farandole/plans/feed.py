"""Transit tables over the star schema: which entity is which table, and how entities relate.

network <- region, line <- nation, route <- customer, trip <- orders, stop_time <- lineitem,
stop_point <- part, stop_area <- brand, company <- supplier, realtime feed <- events. Times of
day come from keys; a trip's stops are 600 s apart and stand for 60 s; times may exceed 24 h.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY = 86_400


class Feed:
    """The entities of one data folder, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def network(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))

    @property
    def line(self) -> DataFrame:
        key = F.col("n_nationkey").cast("long")
        return self.table("nation").select(key.alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("network_id"), (key * 3571 % DAY).alias("opening"), ((key * 3571 + 57_600) % DAY).alias("closing"))

    @property
    def route(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(key.alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("line_id"), F.col("c_mktsegment").alias("direction_type"), (key * 7 % 1000 / 1000 + 2).alias("lon"), (key * 13 % 1000 / 1000 + 48).alias("lat"))

    @property
    def trip(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").select(key.alias("id"), F.col("o_custkey").alias("route_id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("headsign"), (key * 37 % DAY).alias("start"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))

    @property
    def stop_time(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
        rows = self.table("lineitem").withColumn("rank", F.row_number().over(order) - 1)
        start = F.col("l_orderkey") * 37 % DAY + F.col("rank") * 600
        return rows.select(F.col("l_orderkey").alias("trip_id"), "rank", F.col("l_partkey").alias("stop_id"), F.col("l_suppkey").alias("company_id"), start.alias("arrival"), (start + 60).alias("departure"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("headsign"), F.col("l_quantity").alias("length"), F.col("l_linestatus").alias("mode"))

    @property
    def stop_point(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(key.alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("area"), F.col("p_type").alias("code"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), (key * 11 % 1000 / 1000 + 2).alias("lon"), (key * 17 % 1000 / 1000 + 48).alias("lat"))

    @property
    def company(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(key.alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("line_id"), (key * 23 % 1000 / 1000 + 2).alias("lon"), (key * 29 % 1000 / 1000 + 48).alias("lat"))

    @property
    def event(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("entity_id"), F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))

    def relation(self, source: str, target: str) -> DataFrame:
        """(source_id, target_id) of directly related entities."""
        direct = {
            ("network", "line"): lambda: self.line.select(F.col("network_id").alias("source_id"), F.col("id").alias("target_id")),
            ("line", "route"): lambda: self.route.select(F.col("line_id").alias("source_id"), F.col("id").alias("target_id")),
            ("route", "trip"): lambda: self.trip.select(F.col("route_id").alias("source_id"), F.col("id").alias("target_id")),
            ("trip", "stop_point"): lambda: self.table("lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id")),
            ("trip", "company"): lambda: self.table("lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_suppkey").alias("target_id")),
        }
        if (source, target) in direct:
            return direct[source, target]()
        back = direct[target, source]()
        return back.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))


#: The entities' DuckDB forms, for the oracle.
SQL = """
    network AS (SELECT r_regionkey::BIGINT AS id, r_name AS name FROM region),
    line AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS network_id, n_nationkey::BIGINT * 3571 % 86400 AS opening, (n_nationkey::BIGINT * 3571 + 57600) % 86400 AS closing FROM nation),
    route AS (SELECT c_custkey AS id, c_name AS name, c_nationkey::BIGINT AS line_id, c_mktsegment AS direction_type, c_custkey * 7 % 1000 / 1000 + 2 AS lon, c_custkey * 13 % 1000 / 1000 + 48 AS lat FROM customer),
    trip AS (SELECT o_orderkey AS id, o_custkey AS route_id, o_orderdate::DATE AS day, o_orderpriority AS headsign, o_orderkey * 37 % 86400 AS start, o_orderstatus AS status, o_totalprice AS price FROM orders),
    stop_time0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)::INT - 1 AS rank FROM lineitem),
    stop_time AS (SELECT l_orderkey AS trip_id, rank, l_partkey AS stop_id, l_suppkey AS company_id, l_orderkey * 37 % 86400 + rank * 600 AS arrival, l_orderkey * 37 % 86400 + rank * 600 + 60 AS departure, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS headsign, l_quantity AS length, l_linestatus AS mode FROM stop_time0),
    stop_point AS (SELECT p_partkey AS id, p_name AS name, p_brand AS area, p_type AS code, p_size AS size, p_retailprice AS price, p_partkey * 11 % 1000 / 1000 + 2 AS lon, p_partkey * 17 % 1000 / 1000 + 48 AS lat FROM part),
    company AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey::BIGINT AS line_id, s_suppkey * 23 % 1000 / 1000 + 2 AS lon, s_suppkey * 29 % 1000 / 1000 + 48 AS lat FROM supplier),
    event AS (SELECT event_id AS id, ts, user_id AS entity_id, event_type AS kind, value, (props->>'$.k')::INT AS k FROM events)
"""
