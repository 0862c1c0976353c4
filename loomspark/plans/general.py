"""General coverage of Spark beside the reference's own operators: windows, sets, ranges, JSON, sessions, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.ranges import asof_join, range_join, with_earlier
from loomspark.sources.tables import table


def general_pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, folder, "lineitem").where("l_shipdate <= '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(paid), 0).alias("paid"), F.round(F.avg("l_discount"), 4).alias("discount"), F.count("*").alias("n"))


def general_cube(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


def general_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "events").createOrReplaceTempView("loomspark_events")
    return spark.sql("SELECT event_type, cast(user_id % 10 AS bigint) AS bucket, count(*) AS n, cast(grouping_id() AS bigint) AS g FROM loomspark_events GROUP BY GROUPING SETS ((event_type, user_id % 10), (event_type), ())")


def general_window_lag(spark: SparkSession, folder: str) -> DataFrame:
    """Each event's place among its user's, the type of the one before it and the sum of its and the two values before."""
    e = with_earlier(table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type", "value"), ["user_id"], ["ts", "event_id"], F.date_trunc("week", "ts"), ["event_type", "value"], 2)
    given = F.filter(F.concat(F.array("value"), F.transform("_earlier", lambda x: x["value"])), lambda x: x.isNotNull())
    total = F.when(F.size(given) > 0, F.round(F.aggregate(given, F.lit(0.0), lambda a, x: a + x), 2))
    return e.select("event_id", F.try_element_at("_earlier", F.lit(1))["event_type"].alias("before"), F.col("_place").cast("int").alias("place"), total.alias("last3"))


def general_set_ops(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    a, b = (o.where(f"o_orderstatus = '{s}'").select("o_custkey") for s in "OF")
    return a.intersect(b).select("o_custkey", F.lit("both").alias("kind")).unionByName(a.distinct().exceptAll(b.distinct()).select("o_custkey", F.lit("open only").alias("kind")))


def general_range_join(spark: SparkSession, folder: str) -> DataFrame:
    """Parts by bands of their price, joined by cells."""
    bands = spark.range(0, 12).select((F.col("id") * 150 + 850).cast("double").alias("low"), (F.col("id") * 150 + 1050).cast("double").alias("high"))
    return range_join(table(spark, folder, "part").select("p_partkey", "p_retailprice"), bands, "p_retailprice", "low", "high", 100.0).groupBy("low").agg(F.count("*").alias("parts"))


def general_asof_join(spark: SparkSession, folder: str) -> DataFrame:
    """Each purchase with its user's latest view before or at it."""
    e = table(spark, folder, "events")
    view = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view"))
    return asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), view, ["user_id"], "ts", "view", F.date_trunc("week", "ts")).select("event_id", F.col("asof_view").alias("view"))


def general_json_map(spark: SparkSession, folder: str) -> DataFrame:
    k = F.expr("try_cast(get_json_object(props, '$.k') AS int)")
    return table(spark, folder, "events").groupBy((k / 10).cast("int").alias("decade")).agg(F.count("*").alias("n"), F.max(k).alias("most"))


def general_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def general_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def general_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each user with gaps of more than a day between them."""
    s = table(spark, folder, "events").groupBy("user_id", F.session_window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def general_approx_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct parts and the median by flag, exact and whether the sketches come near: within 15 per cent and 1."""
    rows = table(spark, folder, "lineitem")
    near = rows.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("a"), F.percentile_approx("l_quantity", 0.5).alias("m"))
    parts = rows.select("l_returnflag", "l_partkey").distinct().groupBy("l_returnflag").agg(F.count("l_partkey").alias("parts"))
    median = rows.groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n")).groupBy("l_returnflag").agg(F.expr("percentile(l_quantity, 0.5D, n)").alias("median"))
    both = near.join(parts, "l_returnflag").join(median, "l_returnflag")
    return both.select("l_returnflag", "parts", (F.abs(F.col("a") - F.col("parts")) <= 0.15 * F.col("parts")).alias("parts_near"), "median", (F.abs(F.col("m") - F.col("median")) <= 1).alias("median_near"))


def general_stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream from files, counted in tumbling windows up to its end; no row is left out as late."""
    from loomspark.session import checkpoint_dir
    from loomspark.streaming.events import all_windowed_counts, event_stream, run_to_end

    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, folder, "events").schema
    stream = event_stream(spark, f"{folder}/events.parquet", schema)
    run_to_end(all_windowed_counts(stream), f"{base}/out", f"{base}/state")
    return spark.read.schema("start timestamp_ntz, event_type string, n long, total double").parquet(f"{base}/out")


SQL = {
    "general_pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 0) AS paid, round(avg(l_discount), 4) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "general_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "general_grouping_sets": "SELECT event_type, user_id % 10 AS bucket, count(*) AS n, grouping(event_type, user_id % 10)::BIGINT AS g FROM events GROUP BY GROUPING SETS ((event_type, user_id % 10), (event_type), ())",
    "general_window_lag": "SELECT event_id, lag(event_type) OVER w AS before, rank() OVER w::INT AS place, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "general_set_ops": "WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') SELECT o_custkey, 'both' AS kind FROM a WHERE o_custkey IN (FROM b) UNION ALL SELECT o_custkey, 'open only' FROM a WHERE o_custkey NOT IN (FROM b)",
    "general_range_join": "SELECT low, count(*) AS parts FROM part JOIN (SELECT (i * 150 + 850)::DOUBLE AS low, (i * 150 + 1050)::DOUBLE AS high FROM range(12) t(i)) ON p_retailprice >= low AND p_retailprice < high GROUP BY low",
    "general_asof_join": "SELECT p.event_id, v.view FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS view FROM events WHERE event_type = 'view' GROUP BY ALL) v ON p.user_id = v.user_id AND p.ts >= v.ts",
    "general_json_map": "WITH e AS (SELECT try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events) SELECT (k // 10)::INT AS decade, count(*) AS n, max(k) AS most FROM e GROUP BY 1",
    "general_stream_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "general_approx_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS parts_near, quantile_cont(l_quantity, 0.5) AS median, true AS median_near FROM lineitem GROUP BY ALL",
    "general_tumbling": "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "general_sliding": "SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY])::TIMESTAMP AS start FROM events) GROUP BY start",
    "general_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS f FROM events),
 s AS (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id""",
}
QUERIES = {
    f.__name__: f
    for f in (
        general_pricing_summary, general_cube, general_grouping_sets, general_window_lag, general_set_ops, general_range_join, general_asof_join, general_json_map, general_tumbling,
        general_sliding, general_sessions, general_approx_distinct, general_stream_windows,
    )
}
