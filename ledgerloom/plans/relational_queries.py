"""Joins, windows, sets, grouping and event windows over the star schema and the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import relational, schedule
from ledgerloom.session import checkpoint_dir, table
from ledgerloom.streaming import events as E


def join_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by nation and year: five tables joined."""
    li, o, c, n, r = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    revenue = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    out = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return out.groupBy("r_name", "n_name", F.year("o_orderdate").alias("year")).agg(F.sum(revenue).cast("double").alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


JOIN_REVENUE = """SELECT r_name, n_name, year(o_orderdate)::INTEGER AS year, sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2)))::DOUBLE AS revenue, count(DISTINCT o_orderkey) AS orders
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""


def join_outer(spark: SparkSession, d: str) -> DataFrame:
    """Filings and the rows loaded for them, also where one is missing."""
    rows = table(spark, d, "investment").groupBy("filing_id").agg(F.count("*").alias("n_rows"))
    issues = table(spark, d, "validation_issue").groupBy("filing_id").agg(F.count("*").alias("n_issues"))
    return table(spark, d, "filing").select("filing_id", "form").join(rows, "filing_id", "full").join(issues, "filing_id", "full")


JOIN_OUTER = """SELECT filing_id, form, n_rows, n_issues FROM (SELECT filing_id, form FROM filing) FULL JOIN (SELECT filing_id, count(*) AS n_rows FROM investment GROUP BY 1) USING (filing_id)
  FULL JOIN (SELECT filing_id, count(*) AS n_issues FROM validation_issue GROUP BY 1) USING (filing_id)"""


def join_skewed(spark: SparkSession, d: str) -> DataFrame:
    """Rows with the name of their company's fund; one ticker holds a tenth of them."""
    out = relational.skewed_join(table(spark, d, "investment").select("inv_id", "ticker"), table(spark, d, "bdc_profile").select("ticker", "bdc_name"), ["ticker"])
    return out.groupBy("ticker", "bdc_name").agg(F.count("*").alias("n"))


JOIN_SKEWED = "SELECT ticker, bdc_name, count(*) AS n FROM investment JOIN bdc_profile USING (ticker) GROUP BY ALL"


def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    """Customers with and without orders, by segment."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    on = c.c_custkey == o.o_custkey
    have, none = c.join(o, on, "left_semi").withColumn("side", F.lit("with")), c.join(o, on, "left_anti").withColumn("side", F.lit("without"))
    return have.unionByName(none).groupBy("c_mktsegment", "side").agg(F.count("*").alias("n"))


SEMI_ANTI = """SELECT c_mktsegment, side, count(*) AS n FROM (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'with' ELSE 'without' END AS side FROM customer) GROUP BY ALL"""


def as_of(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the latest view of its user."""
    e = table(spark, d, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    buys = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return relational.as_of(buys, views, ["user_id"], "ts", ["view_id", "view_value"], "view_id")


AS_OF = """SELECT user_id, ts, event_id, view_id, view_value FROM (SELECT b.user_id, b.ts, b.event_id, v.event_id AS view_id, v.value AS view_value, row_number() OVER (PARTITION BY b.event_id ORDER BY v.ts DESC, v.event_id DESC) AS rn
  FROM (SELECT * FROM events WHERE event_type = 'purchase') b LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = b.user_id AND v.ts <= b.ts) WHERE rn = 1"""


def range_join(spark: SparkSession, d: str) -> DataFrame:
    """Balances by the bands that hold them."""
    bands = spark.range(0, 12).select((F.col("id") * 1000 - 1000).cast("double").alias("low"), (F.col("id") * 1000).cast("double").alias("high"))
    return relational.in_ranges(table(spark, d, "customer").select("c_custkey", "c_acctbal"), bands, "c_acctbal", "low", "high", 1000).groupBy("low", "high").agg(F.count("*").alias("n"))


RANGE_JOIN = "SELECT low, high, count(*) AS n FROM customer JOIN (SELECT (i * 1000 - 1000)::DOUBLE AS low, (i * 1000)::DOUBLE AS high FROM range(0, 12) r(i)) ON c_acctbal >= low AND c_acctbal < high GROUP BY ALL"


def cube_rollup(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))


CUBE_ROLLUP = "SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::INTEGER AS level, count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"


def window_frames(spark: SparkSession, d: str) -> DataFrame:
    """Orders of each customer: running total, moving sum, rank and change."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return table(spark, d, "orders").select(
        "o_orderkey", F.sum(price).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("running"), F.sum(price).over(w.rowsBetween(-2, 0)).cast("double").alias("moving"),
        F.row_number().over(w).alias("nth"), (price - F.lag(price).over(w)).cast("double").alias("change"), F.ntile(4).over(w).alias("quarter"),
    )


WINDOW_FRAMES = """SELECT o_orderkey, sum(o_totalprice::DECIMAL(18,2)) OVER (w ROWS UNBOUNDED PRECEDING)::DOUBLE AS running, sum(o_totalprice::DECIMAL(18,2)) OVER (w ROWS 2 PRECEDING)::DOUBLE AS moving,
  (row_number() OVER w)::INTEGER AS nth, (o_totalprice::DECIMAL(18,2) - lag(o_totalprice::DECIMAL(18,2)) OVER w)::DOUBLE AS change, (ntile(4) OVER w)::INTEGER AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""


def set_ops(spark: SparkSession, d: str) -> DataFrame:
    """Names that are companies, industries or both."""
    i = table(spark, d, "investment")
    a, b = i.select(F.col("company_name").alias("name")), i.select(F.col("industry").alias("name"))
    parts = [a.intersect(b).withColumn("set", F.lit("both")), a.subtract(b).withColumn("set", F.lit("company only")), b.subtract(a).withColumn("set", F.lit("industry only"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SET_OPS = """(SELECT name, 'both' AS set FROM (SELECT company_name AS name FROM investment INTERSECT SELECT industry FROM investment)) UNION ALL (SELECT name, 'company only' FROM (SELECT company_name AS name FROM investment EXCEPT SELECT industry FROM investment))
  UNION ALL (SELECT name, 'industry only' FROM (SELECT industry AS name FROM investment EXCEPT SELECT company_name FROM investment))"""


def approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Estimates that need no exact count: distinct parts and quantiles by flag."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_extendedprice", [0.5, 0.9], 10_000).alias("price_quantiles"))


def pivot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))


PIVOT = """SELECT o_orderpriority, NULLIF(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS "F", NULLIF(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS "O", NULLIF(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS "P" FROM orders GROUP BY 1"""


def fill_down(spark: SparkSession, d: str) -> DataFrame:
    """The latest signup of a user at each event."""
    out = schedule.fill_down(table(spark, d, "events"), ["user_id"], ["event_id"], {"last_signup": F.when(F.col("event_type") == "signup", F.col("ts"))})
    return out.select("event_id", "last_signup")


FILL_DOWN = "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_signup FROM events"


def table_islands(spark: SparkSession, d: str) -> DataFrame:
    """Groups of events of a user: a signup opens one, purchases join it while at most two events lie between."""
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    signs = table(spark, d, "events").select("user_id", at.alias("n"), (F.col("event_type") == "signup").alias("is_header"), (F.col("event_type") == "purchase").alias("has_data"))
    return schedule.islands(signs, "user_id", "n")


TABLE_ISLANDS = """WITH s AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INTEGER AS n, event_type = 'signup' AS h, event_type = 'purchase' AS p FROM events),
  g AS (SELECT *, sum(h::INTEGER) OVER (PARTITION BY user_id ORDER BY n) AS g FROM s), k AS (SELECT *, n - lag(n) OVER (PARTITION BY user_id, g ORDER BY n) > 2 AS b FROM g WHERE g > 0 AND (h OR p)),
  c AS (SELECT *, sum(coalesce(b, false)::INTEGER) OVER (PARTITION BY user_id, g ORDER BY n) AS bs, first_value(n) OVER (PARTITION BY user_id, g ORDER BY n) AS header FROM k)
  SELECT user_id, g::INTEGER AS group_no, header, n FROM c WHERE bs = 0"""


def tumbling(spark: SparkSession, d: str) -> DataFrame:
    return E.by_window(table(spark, d, "events"), "1 hour").withColumn("total", F.round("total", 2))


_SUMS = "count(*) AS n, round(sum(value::DECIMAL(38,6))::DOUBLE, 2) AS total"
TUMBLING = f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, {_SUMS} FROM events GROUP BY ALL"


def sliding(spark: SparkSession, d: str) -> DataFrame:
    return E.by_window(table(spark, d, "events"), "2 hours", "1 hour").withColumn("total", F.round("total", 2))


SLIDING = f"SELECT s AS window_start, s + INTERVAL 2 HOUR AS window_end, event_type, {_SUMS} FROM (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY ALL"


def session(spark: SparkSession, d: str) -> DataFrame:
    return E.sessions(table(spark, d, "events"), "6 hours")


SESSION = """WITH m AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true)::INTEGER AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k"""


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """The hourly windows by a stream that reads all there is and ends."""
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    name = f"stream_tumbling_{uuid.uuid4().hex}"
    return E.drain(E.by_window(stream, "1 day"), name, "complete", f"{checkpoint_dir(spark)}/{name}").withColumn("total", F.round("total", 2)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


STREAM_TUMBLING = TUMBLING.replace("INTERVAL 1 HOUR", "INTERVAL 1 DAY")

ALL = {
    "join_revenue": (join_revenue, JOIN_REVENUE), "join_outer": (join_outer, JOIN_OUTER), "join_skewed": (join_skewed, JOIN_SKEWED), "semi_anti": (semi_anti, SEMI_ANTI), "as_of": (as_of, AS_OF), "range_join": (range_join, RANGE_JOIN),
    "cube_rollup": (cube_rollup, CUBE_ROLLUP), "window_frames": (window_frames, WINDOW_FRAMES), "set_ops": (set_ops, SET_OPS), "approx_distinct": (approx_distinct, None), "pivot": (pivot, PIVOT), "fill_down": (fill_down, FILL_DOWN),
    "table_islands": (table_islands, TABLE_ISLANDS), "tumbling": (tumbling, TUMBLING), "sliding": (sliding, SLIDING), "session": (session, SESSION), "stream_tumbling": (stream_tumbling, STREAM_TUMBLING),
}
