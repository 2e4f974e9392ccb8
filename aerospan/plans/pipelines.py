"""Text, relational and streaming queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerospan.plans.statistics import EVENTS
from aerospan.registry import query, rounded, table
from aerospan.session import shared_folder
from aerospan.sources import text as S
from aerospan.streaming import accumulate as A


@query(f"WITH {EVENTS} SELECT event_type, count(*) AS n, round(sum(dt * v) / max(t), 6) AS mean, round(sum(dt * v * v) / max(t), 3) AS second FROM e GROUP BY event_type")
def stream_weighted_mean(spark, sf_dir):
    """The events as a stream of files; the last state of each type."""
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2023-12-31 00:00:00', ts) / 1e6")
    s = stream.select("event_id", "event_type", t.alias("t"), F.col("value").alias("v"))
    rows = A.drained(A.weighted_moments(s, "event_type", "t", "v", ["t", "event_id"]), shared_folder(spark, "stream"), "update")
    return A.latest(rows, "event_type").select("event_type", "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("second"), 3).alias("second"))


@query("SELECT date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_windows(spark, sf_dir):
    """Hourly windows with a watermark, all of them at the end."""
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    since = F.expr("timestamp_seconds(timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts))")  # free of the session's zone
    w = A.windowed(stream.select(since.alias("ts"), "value"), "ts", "value", "1 hour", "10 minutes")
    rows = A.drained(w, shared_folder(spark, "windows"), "complete")
    last = rows.agg(F.max("batch").alias("batch"))
    kept = rows.join(F.broadcast(last), "batch")
    return kept.select(F.floor(F.unix_timestamp("start") / 3600).alias("hour"), "n", rounded(F.col("total"), 4).alias("total"))


@query("SELECT p_partkey AS id, 5 AS points, p_size::DOUBLE AS max_x, 2.0 * p_size AS max_y, p_size * 2.0 * p_size AS area FROM part")
def wkt_polygons(spark, sf_dir):
    """Rectangles written as WKT and read back; area by the shoelace formula."""
    p = table(spark, sf_dir, "part")
    s = F.col("p_size").cast("string")
    d = (2 * F.col("p_size")).cast("string")
    wkt = F.concat(F.lit("POLYGON ((0 0, "), s, F.lit(" 0, "), s, F.lit(" "), d, F.lit(", 0 "), d, F.lit(", 0 0))"))
    r = p.select(F.col("p_partkey").alias("id"), F.get(S.wkt_rings(wkt), F.lit(0)).alias("ring"))
    k = F.sequence(F.lit(1), F.size("ring") - 1)
    twice = F.aggregate(k, F.lit(0.0), lambda a, i: a + F.element_at("ring", i)["x"] * F.element_at("ring", i + 1)["y"] - F.element_at("ring", i + 1)["x"] * F.element_at("ring", i)["y"])
    return r.select("id", F.size("ring").cast("long").alias("points"), F.array_max(F.transform("ring", lambda q: q["x"])).alias("max_x"), F.array_max(F.transform("ring", lambda q: q["y"])).alias("max_y"), (F.abs(twice) / 2).alias("area"))


@query("SELECT row_number() OVER (ORDER BY c_custkey) AS id, c_custkey % 7 AS elements, c_custkey + 1 AS points, c_nationkey AS boundaries FROM customer WHERE c_custkey % 7 <> 0")
def partition_table(spark, sf_dir):
    """Lines of a partition file, one for each customer; those without elements are left out and the rest numbered anew."""
    k = F.col("c_custkey")
    lines = F.concat_ws("  ", k.cast("string"), (k % 7).cast("string"), (k + 1).cast("string"), F.col("c_nationkey").cast("string"))
    return S.partition_table(table(spark, sf_dir, "customer").select(lines.alias("value")))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'VELOC' ELSE 'PRESS' END AS var, o_custkey * 5 AS instant FROM orders")
def case_discovery(spark, sf_dir):
    """Variables and instants from file names, one for each order."""
    name = F.format_string("case-%s-%08d.bin", F.when(F.col("o_orderkey") % 2 == 0, F.lit("VELOC")).otherwise(F.lit("PRESS")), F.col("o_custkey") * 5)
    n = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), name.alias("name"))
    return n.select("id", *(F.regexp_extract("name", "([A-Z]+)-([0-9]+)", k).cast(t).alias(c) for k, t, c in ((1, "string", "var"), (2, "long", "instant"))))


@query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_totals(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus")
    return r.agg(F.grouping("l_returnflag").cast("long").alias("g"), F.count(F.lit(1)).alias("n"), rounded(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT q.event_id, max_by(e.event_id, (e.ts, e.event_id)) AS before FROM events q JOIN events e ON e.user_id = q.user_id AND e.event_id % 10 <> 0 AND e.ts <= q.ts WHERE q.event_id % 10 = 0 GROUP BY 1")
def as_of(spark, sf_dir):
    """For every tenth event the last other one of its user until then: a running last value over one sort, no pair is formed."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_id") % 10 == 0).alias("asks"))
    w = Window.partitionBy("user_id").orderBy("ts", "asks", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    j = e.withColumn("before", F.last(F.when(~F.col("asks"), F.col("event_id")), ignorenulls=True).over(w))
    return j.where("asks and before is not null").select("event_id", "before")
