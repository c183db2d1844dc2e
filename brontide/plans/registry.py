"""Registration of queries, each with the SQL that states the same result, and the roles that tables play in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Roles. Each function has its SQL twin, a WITH term.
OBS = """obs AS (SELECT CAST(user_id AS VARCHAR) AS point_id, ts AS valid, value, event_type AS kind, CAST(props->>'$.k' AS DOUBLE) AS k FROM events)"""


def observations(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select(F.col("user_id").cast("string").alias("point_id"), F.col("ts").cast("timestamp").alias("valid"), "value", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("double").alias("k"))


FLAGS = OBS + """, flagged AS (SELECT *, kind = 'error' AS ts_any, kind = 'purchase' AS fog, value >= 50 AS gale FROM obs)"""


def flagged(s: SparkSession, d: str) -> DataFrame:
    return observations(s, d).withColumns({"ts_any": F.col("kind") == "error", "fog": F.col("kind") == "purchase", "gale": F.col("value") >= 50})


HOURLY = FLAGS + """, hourly AS (SELECT point_id, CAST(date_trunc('hour', valid) AS TIMESTAMP) AS hour_utc, count(*) AS n_obs, bool_or(ts_any) AS ts_any, bool_or(fog) AS fog, bool_or(gale) AS gale,
  avg(value) AS value, min(k) AS k_min, max(value) AS value_max FROM flagged GROUP BY ALL)"""


def hourly(s: SparkSession, d: str) -> DataFrame:
    from ..operators.labels import hourly_labels

    return hourly_labels(flagged(s, d), ["ts_any", "fog", "gale"], ["value"], ["k"], ["value"])


FC = """fc AS (SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_suppkey AS VARCHAR) AS loc, CAST(s_nationkey AS VARCHAR) AS zone, CAST(o_orderdate AS DATE) AS run_date, month(o_orderdate) AS month,
  CAST(24 * (abs(date_diff('day', o_orderdate, l_shipdate)) % 10) + 3 AS INTEGER) AS lead_h, l_quantity AS quantity, l_extendedprice AS truth,
  l_extendedprice * (1 - l_discount) AS a, l_extendedprice * (1 + l_tax) AS b, l_extendedprice * (1 + l_tax - l_discount) AS c, l_quantity * p_retailprice AS d
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)"""


def forecasts(s: SparkSession, d: str) -> DataFrame:
    l, o, p, u = (table(s, d, t) for t in ("lineitem", "orders", "part", "supplier"))
    j = l.join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey")).join(u, F.col("s_suppkey") == F.col("l_suppkey"))
    x = F.col("l_extendedprice")
    return j.select(
        "l_orderkey", "l_partkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("loc"), F.col("s_nationkey").cast("string").alias("zone"), F.to_date("o_orderdate").alias("run_date"), F.month("o_orderdate").cast("long").alias("month"),
        (24 * (F.abs(F.datediff("l_shipdate", "o_orderdate")) % 10) + 3).cast("int").alias("lead_h"), F.col("l_quantity").alias("quantity"), x.alias("truth"),
        (x * (1 - F.col("l_discount"))).alias("a"), (x * (1 + F.col("l_tax"))).alias("b"), (x * (1 + F.col("l_tax") - F.col("l_discount"))).alias("c"), (F.col("l_quantity") * F.col("p_retailprice")).alias("d"),
    )


# A probability for the event "price above 50,000", from the quantity alone.
EVENT = FC + """, ev AS (SELECT *, CASE WHEN truth > 50000 THEN 1 ELSE 0 END AS y, quantity / 50.0 AS p,
  CASE WHEN lead_h <= 24 THEN 'h000-024' WHEN lead_h <= 48 THEN 'h024-048' WHEN lead_h <= 72 THEN 'h048-072' WHEN lead_h <= 120 THEN 'h072-120' WHEN lead_h <= 168 THEN 'h120-168' WHEN lead_h <= 240 THEN 'h168-240' END AS lead_bucket FROM fc)"""


def events_of(s: SparkSession, d: str) -> DataFrame:
    from ..functions.columns import lead_bucket

    return forecasts(s, d).withColumns({"y": F.when(F.col("truth") > 50000, 1).otherwise(0), "p": F.col("quantity") / 50.0, "lead_bucket": lead_bucket("lead_h")})


POINTS = """points AS (SELECT c_custkey AS id, CAST(c_custkey AS VARCHAR) AS point_id, 6 + (c_custkey * 37 % 3200) / 100.0 AS lat, 67 + (c_custkey * 53 % 3100) / 100.0 AS lon,
  CAST(c_custkey * 91 % 2500 AS DOUBLE) AS elevation_m, CAST(c_custkey * 17 % 600 AS DOUBLE) AS coast_km, (c_custkey * 13 % 100) / 100.0 AS land FROM customer)"""


def points(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(s, d, "customer").select(
        k.alias("id"), k.cast("string").alias("point_id"), (6 + (k * 37 % 3200) / 100.0).alias("lat"), (67 + (k * 53 % 3100) / 100.0).alias("lon"),
        (k * 91 % 2500).cast("double").alias("elevation_m"), (k * 17 % 600).cast("double").alias("coast_km"), ((k * 13 % 100) / 100.0).alias("land"),
    )


ZONE_SQL = """CASE WHEN (lon >= 92 AND lat < 14) OR (lon BETWEEN 71 AND 74.5 AND lat BETWEEN 8 AND 12.5) THEN 'islands'
  WHEN lat >= 30.5 OR (lat >= 27 AND elevation_m >= 1500) THEN 'himalaya_north' WHEN lat >= 21.5 AND lon >= 89.5 THEN 'northeast'
  WHEN lat >= 23.5 AND lon < 75.5 THEN 'northwest_arid' WHEN lat >= 23.5 AND lon < 89.5 THEN 'indo_gangetic'
  WHEN lat < 23.5 AND coast_km <= 120 AND lon <= 77.5 THEN 'west_coast' WHEN lat < 23.5 AND coast_km <= 120 THEN 'east_coast'
  WHEN lat < 16 THEN 'south_interior' ELSE 'central' END"""

# A grid of parts: row and column from the key, a field from price and size.
GRID = """grid AS (SELECT CAST(p_partkey // 40 AS INTEGER) AS row, CAST(p_partkey % 40 AS INTEGER) AS col, CAST(p_size AS DOUBLE) AS v, p_retailprice - 1000 AS u FROM part)"""


def grid(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(s, d, "part").select(F.floor(k / 40).cast("int").alias("row"), (k % 40).cast("int").alias("col"), F.col("p_size").cast("double").alias("v"), (F.col("p_retailprice") - 1000).alias("u"))
