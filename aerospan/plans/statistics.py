"""Series and statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerospan.operators import series as S
from aerospan.operators import statistics as A
from aerospan.registry import query, rounded, table

BY, ORDER = ["event_type"], ["ts", "event_id"]
#: In SQL: events with t (seconds since the last day of 2023) and dt.
EVENTS = """e0 AS (SELECT event_id, event_type, ts, user_id::DOUBLE AS u, value AS v, date_diff('microsecond', TIMESTAMP '2023-12-31', ts) / 1e6 AS t FROM events),
e AS (SELECT *, t - coalesce(lag(t) OVER (PARTITION BY event_type ORDER BY ts, event_id), 0.0) AS dt FROM e0)"""


def events(spark, sf_dir) -> DataFrame:
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2023-12-31 00:00:00', ts) / 1e6")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.col("user_id").cast("double").alias("u"), F.col("value").alias("v"), t.alias("t"))
    return S.steps(e, "t", ORDER, BY)


@query(f"WITH {EVENTS} SELECT event_type, count(*) AS n, round(sum(dt * v) / max(t), 6) AS mean FROM e GROUP BY event_type")
def ts_weighted_mean(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), rounded(S.weighted_moment([F.col("v")], "t")).alias("mean"))


@query(f"""WITH RECURSIVE {EVENTS}, k AS (SELECT event_type, t, dt, v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM e),
a AS (SELECT event_type, i, v AS mean FROM k WHERE i = 1 UNION ALL SELECT k.event_type, k.i, a.mean + k.dt / k.t * (k.v - a.mean) FROM a JOIN k ON k.event_type = a.event_type AND k.i = a.i + 1)
SELECT event_type, round(max_by(mean, i), 6) AS mean FROM a GROUP BY event_type""")
def ts_first_weight(spark, sf_dir):
    """Increments of weight 1, then dt / t: the first takes the seed away, so the whole is the weighted mean in closed form."""
    return events(spark, sf_dir).groupBy("event_type").agg(rounded(S.weighted_moment([F.col("v")], "t")).alias("mean"))


@query(f"WITH {EVENTS} SELECT event_id, event_type, round(sum(dt * v) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / t, 6) AS running FROM e")
def ts_running_mean(spark, sf_dir):
    return S.running_mean(events(spark, sf_dir), F.col("v"), "t", ORDER, BY).select("event_id", "event_type", rounded(F.col("running")).alias("running"))


@query(f"WITH {EVENTS} SELECT event_type, round(sum(dt * v * v) / max(t), 4) AS vv, round(sum(dt * v * u) / max(t), 3) AS vu, round(sum(dt * u * u) / max(t), 2) AS uu FROM e GROUP BY event_type")
def ts_second_moment(spark, sf_dir):
    v, u = F.col("v"), F.col("u")
    return events(spark, sf_dir).groupBy("event_type").agg(rounded(S.weighted_moment([v, v], "t"), 4).alias("vv"), rounded(S.weighted_moment([v, u], "t"), 3).alias("vu"), rounded(S.weighted_moment([u, u], "t"), 2).alias("uu"))


@query(f"WITH {EVENTS} SELECT event_type, round(sum(dt * v * v * v) / max(t), 2) AS vvv, round(sum(dt * v * v * u) / max(t), 1) AS vvu FROM e GROUP BY event_type")
def ts_third_moment(spark, sf_dir):
    v, u = F.col("v"), F.col("u")
    return events(spark, sf_dir).groupBy("event_type").agg(rounded(S.weighted_moment([v, v, v], "t"), 2).alias("vvv"), rounded(S.weighted_moment([v, v, u], "t"), 1).alias("vvu"))


@query(f"""WITH {EVENTS}, m AS (SELECT event_type, sum(dt * v) / max(t) AS mean FROM e GROUP BY event_type)
SELECT e.event_type, round(sum(dt * (v - mean) * (v - mean)) / max(t), 4) AS variance FROM e JOIN m ON e.event_type = m.event_type GROUP BY e.event_type""")
def ts_fluctuation(spark, sf_dir):
    f = S.fluctuation(events(spark, sf_dir), "v", "t", BY)
    x = F.col("fluctuation")
    return f.groupBy("event_type").agg(rounded(S.weighted_moment([x, x], "t"), 4).alias("variance"))


@query(f"WITH {EVENTS} SELECT event_id, round(dt, 6) AS dt, round(v - lag(v) OVER (PARTITION BY event_type ORDER BY ts, event_id), 6) AS dv FROM e")
def ts_steps(spark, sf_dir):
    s = S.sliced(events(spark, sf_dir), "t")
    before = Window.partitionBy(*BY).orderBy("_s")
    last = s.groupBy(*BY, "_s").agg(F.max_by("v", F.struct(*ORDER)).alias("_last")).select(*BY, "_s", F.lag("_last").over(before).alias("_last"))
    here = F.lag("v").over(Window.partitionBy(*BY, "_s").orderBy(*ORDER))
    out = S.with_carried(s.withColumn("_b", here), last, BY)
    return out.select("event_id", rounded(F.col("dt")).alias("dt"), rounded(F.col("v") - F.coalesce("_b", "_last")).alias("dv"))


@query(f"""WITH {EVENTS}, k AS (SELECT event_type, event_id, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE v END AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM e),
w AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ia,
 last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS va,
 first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib,
 first_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vb FROM k)
SELECT event_id, round(coalesce(v, va + (vb - va) * (i - ia) / nullif(ib - ia, 0)::DOUBLE, va, vb), 6) AS v FROM w""")
def fill_nan(spark, sf_dir):
    holes = events(spark, sf_dir).withColumn("v", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("v")))
    return S.fill(holes, "v", "event_id", BY).select("event_id", rounded(F.col("v")).alias("v"))


PAIRS = "p AS (SELECT l_returnflag AS flag, l_extendedprice AS r, l_quantity * p_retailprice AS m, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_tax, l_shipdate FROM lineitem JOIN part ON l_partkey = p_partkey)"


def pairs(spark, sf_dir) -> DataFrame:
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_shipdate"]
    return l.join(p, l.l_partkey == p.p_partkey).select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("r"), (F.col("l_quantity") * F.col("p_retailprice")).alias("m"), *keep)


@query(f"""WITH {PAIRS} SELECT flag, count(*) AS n, round(var_pop(r), 0) AS var_ref, round(var_pop(m), 0) AS var_model, round(median(r), 4) AS median_ref, round(median(m), 4) AS median_model, round(covar_pop(r, m), 0) AS covariance,
round(corr(r, m), 6) AS pearson, round(1 - avg((r - m) * (r - m)) / var_pop(r), 6) AS r2, round(avg(m - r), 4) AS bias, round(avg((r - m) * (r - m)), 0) AS mse, round(sqrt(avg((r - m) * (r - m))), 4) AS rmse, round(avg(abs(r - m)), 4) AS mae,
round(max(abs(r - m)), 4) AS ame, round(1 - avg((r - m) * (r - m)) / var_pop(r), 6) AS nse, round(sqrt(avg((r - m) * (r - m))) / stddev_pop(r), 6) AS rsr FROM p GROUP BY flag""")
def err_metrics(spark, sf_dir):
    digits = {"var_ref": 0, "var_model": 0, "covariance": 0, "mse": 0, "pearson": 6, "r2": 6, "nse": 6, "rsr": 6}
    return pairs(spark, sf_dir).groupBy("flag").agg(F.count(F.lit(1)).alias("n"), *(rounded(c, digits.get(k, 4)).alias(k) for k, c in A.errors(F.col("r"), F.col("m")).items()))


@query(f"""WITH {PAIRS}, a AS (SELECT flag, avg(r) AS mr, avg(m) AS mm FROM p GROUP BY flag)
SELECT p.flag, round(avg(abs(r - m)) / avg(abs(r - mr)), 6) AS rae, round(avg(abs(r - m)) / max(mr), 6) AS rmae, round(1 - sum((r - m) * (r - m)) / sum((abs(m - mr) + abs(m + mm)) * (abs(m - mr) + abs(m + mm))), 6) AS ioa_ref FROM p JOIN a ON p.flag = a.flag GROUP BY p.flag""")
def err_extended(spark, sf_dir):
    p = A.with_means(pairs(spark, sf_dir), ["flag"], "r", "m")
    relative = F.try_divide(A.mean(F.abs(F.col("r") - F.col("m"))), F.max("_mr"))
    return p.groupBy("flag").agg(rounded(A.relative_absolute("r", "m")).alias("rae"), rounded(relative).alias("rmae"), rounded(A.agreement("r", "m")).alias("ioa_ref"))


@query(f"""WITH {PAIRS}, d AS (SELECT flag, r, m, r - lag(r) OVER w AS step, row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY flag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, r, m, l_discount, l_tax, l_shipdate))
SELECT flag, round(1 - avg((r - m) * (r - m)) / (sum(CASE WHEN k > 2 THEN step * step ELSE 0.0 END) / count(*)), 6) AS persistence FROM d GROUP BY flag""")
def err_persistence(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "r", "m", "l_discount", "l_tax", "l_shipdate"]
    s = S.sliced(pairs(spark, sf_dir), "l_orderkey")
    before, w = Window.partitionBy("flag").orderBy("_s"), Window.partitionBy("flag", "_s").orderBy(*order)
    each = s.groupBy("flag", "_s").agg(F.count(F.lit(1)).alias("_n"), F.max_by("r", F.struct(*order)).alias("_last"))
    carried = each.select("flag", "_s", F.lag("_last").over(before).alias("_last"), F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_at"))
    d = S.with_carried(s.withColumn("_b", F.lag("r").over(w)).withColumn("_k", F.row_number().over(w)), carried, ["flag"])
    d = d.select("flag", "r", "m", (F.col("r") - F.coalesce("_b", "_last")).alias("step"), (F.col("_k") + F.col("_at")).alias("k"))
    e = F.avg((F.col("r") - F.col("m")) * (F.col("r") - F.col("m")))
    norm = F.sum(F.when(F.col("k") > 2, F.col("step") * F.col("step")).otherwise(0.0)) / F.count(F.lit(1))
    return d.groupBy("flag").agg(rounded(1 - F.try_divide(e, norm)).alias("persistence"))


LONG = "x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def components(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v")).select("vec_id", (F.col("k") + 1).alias("k"), F.col("v").cast("double").alias("v"))


@query(f"WITH {LONG} SELECT k::INT AS k, count(*) AS size, round(max(v), 6) AS largest, round(min(v), 6) AS smallest, round(avg(v), 6) AS mean, false AS has_nan FROM x GROUP BY k")
def array_summary(spark, sf_dir):
    return components(spark, sf_dir).groupBy("k").agg(*((rounded(c) if k in ("largest", "smallest", "mean") else c).alias(k) for k, c in A.summary(F.col("v")).items()))


@query("SELECT round(min(embedding[1]::DOUBLE), 6) AS x0, round(max(embedding[1]::DOUBLE), 6) AS x1, round(min(embedding[2]::DOUBLE), 6) AS y0, round(max(embedding[2]::DOUBLE), 6) AS y1, round(min(embedding[3]::DOUBLE), 6) AS z0, round(max(embedding[3]::DOUBLE), 6) AS z1 FROM embeddings")
def bbox(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.agg(*(rounded(f(F.get("embedding", F.lit(k)).cast("double"))).alias(f"{a}{j}") for k, a in enumerate("xyz") for j, f in enumerate((F.min, F.max))))


@query("SELECT l_quantity AS x, round(avg(l_extendedprice), 4) AS l_extendedprice, round(avg(l_discount), 6) AS l_discount FROM lineitem GROUP BY l_quantity")
def direction_avg(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), "l_extendedprice", "l_discount")
    d = A.direction_average(l, ["x"], ["l_extendedprice", "l_discount"])
    return d.select("x", rounded(F.col("l_extendedprice"), 4).alias("l_extendedprice"), rounded(F.col("l_discount")).alias("l_discount"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, round(avg(l_extendedprice) OVER (PARTITION BY l_quantity, l_linenumber), 4) AS l_extendedprice FROM lineitem")
def plane_avg(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber", "l_extendedprice")
    p = A.plane_average(l, ["l_quantity", "l_linenumber"], ["l_extendedprice"])
    return p.select("l_orderkey", "l_linenumber", "l_quantity", rounded(F.col("l_extendedprice"), 4).alias("l_extendedprice"))


@query("""WITH d AS (SELECT l_quantity AS x, avg(l_extendedprice) AS v FROM lineitem GROUP BY l_quantity), k AS (SELECT x, v, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM d)
SELECT a.x, round((a.v + b.v) / 2, 4) AS v FROM k a JOIN k b ON b.i = a.n - 1 - a.i""")
def midline_avg(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").alias("x")).agg(F.avg("l_extendedprice").alias("v"))  # a row for each profile point
    k = d.withColumn("i", F.row_number().over(Window.orderBy("x")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    return S.midline(k, "v", "i", "n").select("x", rounded(F.col("v"), 4).alias("v"))


ROW = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {ROW}) AS k FROM lineitem) WHERE k = 1")
def dedupe_first(spark, sf_dir):
    first = A.first_by(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ROW.split(", "))
    return first.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("SELECT o_orderkey, o_custkey, c_custkey - 1 AS place FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def semi_reorder(spark, sf_dir):
    """Rows whose node is in the target numbering, with its place there."""
    target = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") - 1).alias("place"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(target, "o_custkey").select("o_orderkey", "o_custkey", "place")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def scope_anti(spark, sf_dir):
    """Polygons without a vertex outside."""
    outside = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(outside, "o_custkey", "left_anti").select("o_orderkey")


@query("SELECT x, dense_rank() OVER (ORDER BY x) - 1 AS inverse, n FROM (SELECT l_quantity AS x, count(*) AS n FROM lineitem GROUP BY l_quantity)")
def distinct_inverse(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return A.in_places(d, F.col("x")).select("x", (F.col("place") - 1).alias("inverse"), "n")


@query("SELECT c_nationkey, round(sum(c_acctbal * c_custkey) / sum(c_custkey), 4) AS x, round(sum(c_custkey * c_custkey) / sum(c_custkey)::DOUBLE, 4) AS y FROM customer GROUP BY c_nationkey")
def weighted_barycentre(spark, sf_dir):
    w = F.col("c_custkey").cast("double")
    x, y = A.barycentre(w, [F.col("c_acctbal"), w])
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(rounded(x, 4).alias("x"), rounded(y, 4).alias("y"))


@query("""WITH s AS (SELECT l_returnflag AS flag, avg(l_quantity) AS cx, avg(l_extendedprice / 1000) AS cy, var_pop(l_quantity) AS a, covar_pop(l_quantity, l_extendedprice / 1000) AS b, var_pop(l_extendedprice / 1000) AS c FROM lineitem GROUP BY 1)
SELECT flag, round(cx, 5) AS cx, round(cy, 5) AS cy, round(cos(atan2(2 * b, a - c) / 2), 6) AS dx, round(sin(atan2(2 * b, a - c) / 2), 6) AS dy FROM s""")
def line_fit(spark, sf_dir):
    cols = A.fitted_line(F.col("l_quantity"), F.col("l_extendedprice") / 1000)
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(*(c.alias(n) for c, n in zip(cols, ("cx", "cy", "dx", "dy"), strict=True)))
    return l.select("flag", rounded(F.col("cx"), 5).alias("cx"), rounded(F.col("cy"), 5).alias("cy"), rounded(F.col("dx")).alias("dx"), rounded(F.col("dy")).alias("dy"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate IN (SELECT DISTINCT o_orderdate FROM orders ORDER BY 1 LIMIT 5)")
def instants_front(spark, sf_dir):
    return S.first_instants(table(spark, sf_dir, "orders"), "o_orderdate", 5).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate IN (SELECT DISTINCT o_orderdate FROM orders ORDER BY 1 DESC LIMIT 5)")
def instants_behind(spark, sf_dir):
    return S.last_instants(table(spark, sf_dir, "orders"), "o_orderdate", 5).select("o_orderkey", "o_totalprice")


@query("SELECT l_returnflag AS solid, l_linenumber AS part, n, sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) - n AS vertex_offset FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)")
def running_offset(spark, sf_dir):
    """Vertices of the parts before, within a solid."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("solid"), F.col("l_linenumber").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("solid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("vertex_offset", F.coalesce(F.sum("n").over(w), F.lit(0)))


@query("SELECT c_custkey, round(c_acctbal - min(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS z FROM customer")
def shift_to_zero(spark, sf_dir):
    w = Window.partitionBy("c_nationkey")
    return table(spark, sf_dir, "customer").select("c_custkey", rounded(F.col("c_acctbal") - F.min("c_acctbal").over(w), 4).alias("z"))


@query("SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) AS v FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")
def normalise(spark, sf_dir):
    """Min-max to 0..1: the two extremes are one row."""
    c = table(spark, sf_dir, "customer")
    ends = c.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    return c.crossJoin(F.broadcast(ends)).select("c_custkey", rounded(F.try_divide(F.col("c_acctbal") - F.col("lo"), F.col("hi") - F.col("lo"))).alias("v"))
