"""Detectors, features and driver health as named queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import series
from ..sources import domain
from .catalog import BRANDS, MONTHLY, detect_sql, med, query

_LOGGED = MONTHLY + ", lg AS (SELECT series_id, x, ln(greatest(y, 0.5::DOUBLE)) AS y FROM pts)"
_OUT = "series_id, n, split, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(sigma, 6) AS sigma, round(surprise, 6) AS surprise, fired, round(sustained_sigma, 6) AS sustained_sigma, n_consecutive, sustained, round(down_surprise, 6) AS down_surprise, n_consecutive_down, dissolving"


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


_FLOATS = ("slope", "intercept", "sigma", "surprise", "sustained_sigma", "down_surprise")


@query("detect_acceleration", f"WITH {MONTHLY}, {detect_sql()} SELECT {_OUT} FROM det")
def detect_acceleration(spark, sf_dir):
    """Which monthly series rose beyond their own noise in the held-out months (k = 3)?"""
    return _rounded(series.detect(domain.monthly(spark, sf_dir), ["series_id"]), *_FLOATS)


@query("detect_acceleration_log", f"WITH {_LOGGED}, {detect_sql('lg')} SELECT {_OUT} FROM det")
def detect_acceleration_log(spark, sf_dir):
    return _rounded(series.detect(domain.monthly(spark, sf_dir), ["series_id"], log=True), *_FLOATS)


@query("detector_summary", f"WITH {BRANDS}, {detect_sql(k=1.5)} SELECT (SELECT count(DISTINCT series_id) FROM pts)::BIGINT AS scanned, count(*) AS judged, count(*) FILTER (WHERE fired) AS fired, count(*) FILTER (WHERE sustained) AS sustained, count(*) FILTER (WHERE dissolving) AS dissolving FROM det")
def detector_summary(spark, sf_dir):
    pts = domain.monthly(spark, sf_dir, fine=False)
    det = series.detect(pts, ["series_id"], k=1.5)
    every = pts.select("series_id").distinct().join(det, "series_id", "left")
    return every.agg(F.count("*").alias("scanned"), F.count("n").alias("judged"), F.count_if("fired").alias("fired"), F.count_if("sustained").alias("sustained"), F.count_if("dissolving").alias("dissolving"))


def _threshold_sql(direction: str) -> str:
    level = "0.9::DOUBLE" if direction == "falling" else "1.1::DOUBLE"
    cross = {"falling": "current <= level", "rising": "current >= level", "peak": "slope < 0"}[direction]
    away = {"falling": "CASE WHEN slope < 0 AND NOT current <= level THEN (current - level) / (-slope) END", "rising": "CASE WHEN slope > 0 AND NOT current >= level THEN (level - current) / slope END", "peak": "NULL::DOUBLE"}[direction]
    status = "CASE WHEN slope < 0 THEN 'binding' ELSE 'approaching' END" if direction == "peak" else "CASE WHEN crossed THEN 'binding' WHEN ytc <= 10 THEN 'crossing_soon' WHEN ytc <= 30 THEN 'approaching' ELSE 'stable' END"
    return f"""WITH {MONTHLY},
o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY x DESC) AS back, count(*) OVER (PARTITION BY series_id) AS n FROM pts),
t AS (SELECT series_id, list(y) AS ys FROM pts GROUP BY ALL),
c AS (SELECT o.series_id, y AS current, {med("ys")} * {level} AS level FROM o JOIN t USING (series_id) WHERE back = 1 AND n >= 8),
sl AS (SELECT a.series_id, list((b.y - a.y) / (b.x - a.x)) AS s FROM o a JOIN o b USING (series_id) WHERE a.back <= 12 AND b.back < a.back GROUP BY ALL),
v AS (SELECT c.*, {med("s")} AS slope FROM c JOIN sl USING (series_id)),
w AS (SELECT series_id, current, slope, {cross} AS crossed, {away} AS ytc FROM v)
SELECT series_id, current, round(slope, 6) AS slope, crossed, round(ytc, 6) AS years_to_cross, {status} AS status FROM w"""


def _threshold(direction: str, factor: float):
    def run(spark, sf_dir):
        pts = domain.monthly(spark, sf_dir)
        level = series.median_of(F.transform("pts", lambda p: p["y"])) * factor
        return _rounded(series.detect_threshold(pts, ["series_id"], level, direction), "slope", "years_to_cross")

    return run


query("threshold_falling", _threshold_sql("falling"))(_threshold("falling", 0.9))
query("threshold_rising", _threshold_sql("rising"))(_threshold("rising", 1.1))
query("threshold_peak", _threshold_sql("peak"))(_threshold("peak", 1.0))

FEATURES = """
lagged AS (SELECT series_id, x, y, lead(y) OVER (PARTITION BY series_id ORDER BY x) AS nxt FROM pts),
rets AS (SELECT series_id, x, ln(nxt / y) AS r, row_number() OVER (PARTITION BY series_id ORDER BY x DESC) AS back FROM lagged WHERE y > 0 AND nxt > 0),
agg AS (SELECT series_id, count(*) AS m, avg(r) AS drift, stddev_samp(r) AS sd, arg_max(r, x) AS last, avg(r) FILTER (WHERE back <= 3) AS recent FROM rets GROUP BY ALL HAVING count(*) >= 3),
lv AS (SELECT series_id, max(y) AS peak, arg_max(y, x) AS value FROM pts GROUP BY ALL),
feat AS (SELECT series_id, drift, greatest(1e-6::DOUBLE, sd) AS vol, last, recent - drift AS accel, CASE WHEN peak > 0 THEN (value - peak) / peak ELSE 0 END AS drawdown, value FROM agg JOIN lv USING (series_id))"""


@query("series_features", f"WITH {MONTHLY}, {FEATURES} SELECT series_id, round(drift, 6) + 0.0::DOUBLE AS drift, round(vol, 6) AS vol, round(last, 6) AS last, round(accel, 6) AS accel, round(drawdown, 6) AS drawdown, value FROM feat")
def series_features(spark, sf_dir):
    return _rounded(series.features(domain.monthly(spark, sf_dir), ["series_id"]), "drift", "vol", "last", "accel", "drawdown")


_DRIVERS = f"""WITH {MONTHLY}, {FEATURES},
thr AS (SELECT series_id, avg(y) AS threshold FROM pts GROUP BY ALL),
d AS (SELECT *, value - threshold AS signed, (value - threshold) / greatest(abs(value) * vol, 1e-9) AS margin_sigma, drift / vol AS trend_score,
        CASE WHEN drift > vol * 0.1::DOUBLE THEN 'toward_confirm' WHEN drift < -vol * 0.1::DOUBLE THEN 'toward_falsify' ELSE 'flat' END AS trend
      FROM feat JOIN thr USING (series_id)),
st AS (SELECT series_id, margin_sigma, trend, 1 / (1 + exp(-greatest(-30.0::DOUBLE, least(30.0::DOUBLE, 1.5::DOUBLE * margin_sigma + 0.8::DOUBLE * trend_score)))) AS partial,
        CASE WHEN signed >= 0 THEN CASE WHEN margin_sigma < 1 AND trend = 'toward_falsify' THEN 'approaching' ELSE 'on_track' END
             ELSE CASE WHEN trend = 'toward_confirm' THEN 'approaching' ELSE 'falsified' END END AS status FROM d)"""


def _drivers(spark, sf_dir):
    pts = domain.monthly(spark, sf_dir)
    level = pts.groupBy("series_id").agg(F.avg("y").alias("threshold"))
    return series.driver_status(series.features(pts, ["series_id"]).join(level, "series_id"), F.col("threshold"))


@query("driver_status", f"{_DRIVERS} SELECT series_id, round(margin_sigma, 6) AS margin_sigma, trend, round(partial, 6) AS partial, status FROM st")
def driver_status(spark, sf_dir):
    return _rounded(_drivers(spark, sf_dir).select("series_id", "margin_sigma", "trend", "partial", "status"), "margin_sigma", "partial")


@query("driver_health", f"""{_DRIVERS} SELECT split_part(series_id, '|', 1) AS card, count(*) AS drivers, count(*) FILTER (WHERE status = 'on_track') AS on_track,
  count(*) FILTER (WHERE status = 'approaching') AS approaching, count(*) FILTER (WHERE status = 'falsified') AS falsified, round(avg(partial), 6) AS mean_partial,
  CASE max(CASE status WHEN 'falsified' THEN 3 WHEN 'approaching' THEN 2 ELSE 0 END) WHEN 3 THEN 'falsified' WHEN 2 THEN 'approaching' ELSE 'on_track' END AS worst FROM st GROUP BY ALL""")
def driver_health(spark, sf_dir):
    rank = F.max(F.when(F.col("status") == "falsified", 3).when(F.col("status") == "approaching", 2).otherwise(0))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("on_track", "approaching", "falsified")]
    g = _drivers(spark, sf_dir).groupBy(F.split_part("series_id", F.lit("|"), F.lit(1)).alias("card")).agg(F.count("*").alias("drivers"), *counts, F.round(F.avg("partial"), 6).alias("mean_partial"), rank.alias("r"))
    return g.withColumn("worst", F.when(F.col("r") == 3, "falsified").when(F.col("r") == 2, "approaching").otherwise("on_track")).drop("r")


@query("run_lengths_and_returns", f"""WITH {MONTHLY}, l AS (SELECT series_id, x, y, y - lag(y) OVER (PARTITION BY series_id ORDER BY x) AS diff, max(y) OVER (PARTITION BY series_id ORDER BY x) AS peak FROM pts),
g AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY x) - row_number() OVER (PARTITION BY series_id, diff > 0 ORDER BY x) AS island FROM l WHERE diff IS NOT NULL),
c AS (SELECT series_id, island, count(*) AS len FROM g WHERE diff > 0 GROUP BY ALL)
SELECT series_id, (SELECT max(len) FROM c WHERE c.series_id = g.series_id) AS longest_rise, min(y / peak - 1) AS deepest, count(*) AS steps FROM g GROUP BY ALL""")
def run_lengths_and_returns(spark, sf_dir):
    """Longest rise (gaps and islands), deepest drawdown from the running peak, steps."""
    w = Window.partitionBy("series_id").orderBy("x")
    l = domain.monthly(spark, sf_dir).withColumn("diff", F.col("y") - F.lag("y").over(w)).withColumn("peak", F.max("y").over(w)).filter("diff IS NOT NULL")
    g = l.withColumn("rise", F.col("diff") > 0).withColumn("rn", F.row_number().over(w)).withColumn("island", F.col("rn") - F.row_number().over(Window.partitionBy("series_id", "rise").orderBy("x")))
    part = g.groupBy("series_id", "rise", "island").agg(F.count("*").alias("len"), F.min(F.col("y") / F.col("peak") - 1).alias("low"))
    return part.groupBy("series_id").agg(F.max(F.when(F.col("rise"), F.col("len"))).alias("longest_rise"), F.min("low").alias("deepest"), F.sum("len").alias("steps"))


@query("control_is_silent", f"""WITH {MONTHLY.replace("pts AS (", "own AS (")}, pts AS (SELECT * FROM own UNION ALL SELECT 'control', 24000 + k, [{", ".join(f"{v}.0" for v in domain.CONTROL)}][k + 1]::DOUBLE FROM range({len(domain.CONTROL)}) t(k)), {detect_sql()}
SELECT series_id = 'control' AS control, count(*) AS series, count(*) FILTER (WHERE fired) AS fired, round(max(CASE WHEN series_id = 'control' THEN surprise END), 6) AS surprise FROM det GROUP BY ALL""")
def control_is_silent(spark, sf_dir):
    """How many series fire, and that the flat control among them does not."""
    got = series.detect(domain.with_control(domain.monthly(spark, sf_dir)), ["series_id"])
    own = F.col("series_id") == "control"
    return got.groupBy(own.alias("control")).agg(F.count("*").alias("series"), F.count_if("fired").alias("fired"), F.round(F.max(F.when(own, F.col("surprise"))), 6).alias("surprise"))
