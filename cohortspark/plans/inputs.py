"""The given tables read as operations, measurements and index events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.scalar import minutes
from cohortspark.operators.lookups import latest_wide, lookback
from cohortspark.operators.sequence import first_events
from cohortspark.session import cut
from cohortspark.sources.tables import table

ITEMS = ["af", "ao", "nf", "no", "rf", "ro"]
WIDE = ["preop_" + x for x in ITEMS]

OPS = """ops AS (
  SELECT o_custkey AS subject_id, o_orderkey AS op_id, o_totalprice AS price, o_orderstatus AS status,
         CAST(left(o_orderpriority, 1) AS INTEGER) AS asa,
         epoch_us(o_orderdate) / CAST(60000000 AS DOUBLE) AS start_time,
         epoch_us(o_orderdate) / CAST(60000000 AS DOUBLE) AS end_time
  FROM orders)"""
SEQ = OPS + """, seq AS (
  SELECT *, ROW_NUMBER() OVER w AS operation_number,
         COUNT(*) OVER (PARTITION BY subject_id) AS total_operations,
         LAG(end_time) OVER w AS prev_end
  FROM ops WINDOW w AS (PARTITION BY subject_id ORDER BY start_time NULLS LAST, op_id))"""
GAPS = SEQ + """, gaps AS (
  SELECT *, (start_time - prev_end) / CAST(1440 AS DOUBLE) AS days_since_prev
  FROM seq WHERE prev_end IS NOT NULL)"""
FIRST = SEQ + """, first_ops AS (SELECT * FROM seq WHERE operation_number = 1)"""
LABS = """labs AS (
  SELECT o_custkey AS subject_id, lower(l_returnflag || l_linestatus) AS item_name,
         epoch_us(l_shipdate) / CAST(60000000 AS DOUBLE) AS chart_time, l_quantity AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
LOOK = FIRST + ", " + LABS + """, look AS (
  SELECT f.subject_id, f.op_id, f.start_time, l.item_name, l.chart_time, l.value
  FROM first_ops f JOIN labs l ON f.subject_id = l.subject_id
  WHERE l.chart_time <= f.start_time AND l.chart_time >= f.start_time - 180 * 1440)"""
MODEL = LOOK + """, latest AS (
  SELECT *, ROW_NUMBER() OVER (
    PARTITION BY subject_id, op_id, item_name ORDER BY chart_time DESC, value DESC) AS rn
  FROM look), wide AS (
  SELECT subject_id, op_id, """ + ", ".join(
    f"MAX(value) FILTER (WHERE item_name = '{x}') AS preop_{x}" for x in ITEMS) + """
  FROM latest WHERE rn = 1 GROUP BY subject_id, op_id), model AS (
  SELECT f.subject_id, f.op_id, f.price, f.status, f.asa, """ + ", ".join("w." + x for x in WIDE) + """
  FROM first_ops f LEFT JOIN wide w ON f.subject_id = w.subject_id AND f.op_id = w.op_id)"""
MODEL_LONG = MODEL + """, long AS (
  """ + " UNION ALL ".join(f"SELECT '{x}' AS variable, {x} AS value FROM model" for x in WIDE) + ")"
WARD = """ward AS (
  SELECT user_id AS subject_id, event_id, event_type AS item_name, value,
         epoch_us(ts) / CAST(60000000 AS DOUBLE) AS chart_time
  FROM events), idx AS (
  SELECT subject_id, event_id AS op_id, chart_time AS orin_time FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY chart_time, event_id) AS rn
    FROM ward WHERE item_name = 'purchase') WHERE rn = 1)"""


def operations(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as operations whose start and end are the order date."""
    start = minutes(F.col("o_orderdate"))
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("op_id"),
        F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("asa"),
        start.alias("start_time"), start.alias("end_time"))


def first_operations(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """First operation per subject; naming columns keeps the scan narrow."""
    needed = dict.fromkeys(["subject_id", "op_id", "start_time", *columns])
    return first_events(operations(spark, sf).select(*needed), "subject_id", "start_time", "op_id")


def labs(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as measurements of their order's customer."""
    owners = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("subject_id"))
    return measured(table(spark, sf, "lineitem"), owners)


def measured(lines: DataFrame, owners: DataFrame) -> DataFrame:
    """Line items with the subject of their order."""
    return lines.join(owners, lines.l_orderkey == owners.o_orderkey).select(
        "subject_id", F.lower(F.concat("l_returnflag", "l_linestatus")).alias("item_name"),
        minutes(F.col("l_shipdate")).alias("chart_time"), F.col("l_quantity").alias("value"))


def lab_rows(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "lineitem").count()


def preop_rows(spark: SparkSession, sf: str, cohort: DataFrame | None = None) -> DataFrame:
    """Measurements in the 180 days up to each first operation."""
    cohort = first_operations(spark, sf) if cohort is None else cohort
    return lookback(
        cohort.select("subject_id", "op_id", "start_time"), labs(spark, sf), "subject_id",
        anchor="start_time", time="chart_time", item="item_name", items=ITEMS,
        reuse=True, row_bound=lab_rows(spark, sf))


def model_table(spark: SparkSession, sf: str) -> DataFrame:
    """First operations with the latest earlier value per item, one row each.

    The cohort is used twice, so it is written once.
    """
    cohort = cut(first_operations(spark, sf, "price", "status", "asa"))
    wide = latest_wide(preop_rows(spark, sf, cohort), ["subject_id", "op_id"], item="item_name",
                       time="chart_time", value="value", items=ITEMS)
    base = cohort.select("subject_id", "op_id", "price", "status", "asa")
    return base.join(wide, ["subject_id", "op_id"], "left")


def ward(spark: SparkSession, sf: str) -> DataFrame:
    """Events as measurements."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("subject_id"), "event_id", F.col("event_type").alias("item_name"),
        "value", minutes(F.col("ts")).alias("chart_time"))


def index_events(spark: SparkSession, sf: str) -> DataFrame:
    """The first purchase of each user."""
    purchases = ward(spark, sf).filter(F.col("item_name") == "purchase").select(
        "subject_id", "event_id", "chart_time")
    first = first_events(purchases, "subject_id", "chart_time", "event_id")
    return first.select("subject_id", F.col("event_id").alias("op_id"),
                        F.col("chart_time").alias("orin_time"))


def event_rows(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "events").count()
