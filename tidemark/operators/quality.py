"""Audits of series: freshness, completeness, validity, provenance, reconciliation, and the verdict over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import median_of
from .mining import completeness

#: How late each provider may be (annual: years, snapshot: days); any other is annual with two years.
CADENCE = {
    "openalex": ("annual", 2), "nih_reporter": ("annual", 3), "epoch_ai": ("annual", 2), "google_patents": ("annual", 6), "owid": ("annual", 3),
    "arxiv": ("snapshot", 120), "retro": ("frozen", None), "synthetic": ("frozen", None),
}
#: Weight of each check in the health score, and what a status is worth there.
WEIGHTS = {"fresh": 0.25, "complete": 0.25, "valid": 0.20, "prov": 0.20, "recon": 0.10}
WORTH = {"ok": 1.0, "warn": 0.6, "fail": 0.0, "n/a": 1.0}
SOURCELESS = ("synthetic",)


def _rank(status: Column) -> Column:
    return F.when(status == "fail", 2).when(status == "warn", 1).otherwise(0)


def worst(*statuses: Column) -> Column:
    top = F.greatest(*map(_rank, statuses))
    return F.when(top == 2, "fail").when(top == 1, "warn").otherwise("ok")


def _lookup(values: dict, key: Column, default) -> Column:
    col = F.lit(default)
    for k, v in values.items():
        col = F.when(key == k, v).otherwise(col)
    return col


def freshness(provider: Column, last: Column, today: Column) -> tuple[Column, Column]:
    """(status, days since the last point; null for frozen series). Annual series count calendar years, snapshots days; one step
    over the limit (twice the days) warns, more fails. No point at all fails."""
    kind = _lookup({k: v[0] for k, v in CADENCE.items()}, provider, "annual")
    most = _lookup({k: v[1] for k, v in CADENCE.items() if v[1]}, provider, 2)
    days, years = F.datediff(today, last), F.year(today) - F.year(last)
    late = lambda x, over: F.when(x <= most, "ok").when(x <= over, "warn").otherwise("fail")
    status = F.when(kind == "frozen", "ok").when(last.isNull(), "fail").when(kind == "snapshot", late(days, 2 * most)).otherwise(late(years, most + 1))
    return status, F.when(kind != "frozen", days)


def validity(points: DataFrame, key: list[str], factor: float = 100.0) -> DataFrame:
    """key, valid, outliers of points (y, unit, uncertainty, series_unit, is_count): another unit than the series', a negative count
    or a negative uncertainty fail; values `factor` times off the median of at least five positive ones warn."""
    g = points.groupBy(*key).agg(
        F.count_if(~F.col("unit").eqNullSafe(F.col("series_unit"))).alias("units"), F.count_if(F.col("is_count") & (F.col("y") < 0)).alias("below"), F.count_if(F.col("uncertainty") < 0).alias("sigmas"),
        F.collect_list(F.when(F.col("y") > 0, F.col("y"))).alias("plus"))
    g = g.withColumn("mid", F.when(F.size("plus") >= 5, median_of(F.col("plus"))))
    bad = (F.col("units") > 0) | (F.col("below") > 0) | (F.col("sigmas") > 0)
    off = F.size(F.filter("plus", lambda y: (y > F.col("mid") * factor) | (y < F.col("mid") / factor)))
    g = g.select(*key, bad.alias("bad"), F.when(bad, 0).otherwise(off).alias("outliers"))
    return g.select(*key, F.when(F.col("bad"), "fail").when(F.col("outliers") > 0, "warn").otherwise("ok").alias("valid"), "outliers")


def provenance(provider: Column, source: Column, source_ok: Column) -> Column:
    return F.when(source.isNull(), F.when(provider.isin(*SOURCELESS), "ok").otherwise("fail")).when(~source_ok, "fail").otherwise("ok")


def reconciliation(points: DataFrame, links: DataFrame) -> DataFrame:
    """series_id, recon: series of one entity that end more than 5 % above and below their start warn each other; a series under
    three points or alone is ok."""
    ends = points.groupBy("series_id").agg(F.count("*").alias("n"), F.min_by("y", "x").alias("a"), F.max_by("y", "x").alias("b"))
    way = F.when(F.col("n") >= 3, F.when(F.col("b") > F.col("a") * 1.05, 1).when(F.col("b") < F.col("a") * 0.95, -1).otherwise(0))
    own = links.select("entity", "series_id").distinct().join(ends.select("series_id", way.alias("way")), "series_id", "left")
    torn = own.groupBy("entity").agg((F.bool_or(F.col("way") == 1) & F.bool_or(F.col("way") == -1)).alias("torn"))
    return own.join(torn, "entity").groupBy("series_id").agg(F.when(F.bool_or(F.col("torn") & F.col("way").isNotNull()), "warn").otherwise("ok").alias("recon"))


def audit(series: DataFrame, points: DataFrame, links: DataFrame, revisions: DataFrame, today: Column) -> DataFrame:
    """One row per series: the five checks, the worst of them (no entity counts as n/a and harms neither status nor score), counts
    and the weighted score.

    series: series_id, provider, unit, source_id, source_ok, is_count; points: series_id, x (date), y, unit, uncertainty;
    links: entity, series_id; revisions: series_id."""
    last = points.groupBy("series_id").agg(F.max("x").alias("last"))
    years = points.select("series_id", F.year("x").alias("x")).distinct()
    gaps = completeness(years, ["series_id"]).select("series_id", F.col("missing").alias("gaps"), F.col("status").alias("complete"))
    valid = validity(points.join(series.select("series_id", F.col("unit").alias("series_unit"), "is_count"), "series_id"), ["series_id"])
    changed = revisions.groupBy("series_id").agg(F.count("*").alias("n_revisions"))
    df = series
    for part in (last, gaps, valid, reconciliation(points, links), changed):
        df = df.join(part, "series_id", "left")
    fresh, days = freshness(F.col("provider"), F.col("last"), today)
    df = df.withColumns({"fresh": fresh, "days_stale": days, "complete": F.coalesce("complete", F.lit("ok")), "valid": F.coalesce("valid", F.lit("fail")), "prov": provenance(F.col("provider"), F.col("source_id"), F.col("source_ok")), "recon": F.coalesce("recon", F.lit("n/a"))})
    score = sum((F.lit(w) * _lookup(WORTH, F.col(c), 0.0) for c, w in WEIGHTS.items()), F.lit(0.0))
    return df.select("series_id", worst(*map(F.col, WEIGHTS)).alias("status"), *WEIGHTS, "days_stale", F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("outliers", F.lit(0)).alias("outliers"), F.coalesce("n_revisions", F.lit(0)).alias("n_revisions"), F.round(score, 3).alias("score"))


def orphans(points: DataFrame, series: DataFrame) -> DataFrame:
    """Points whose series does not exist."""
    return points.join(series.select("series_id"), "series_id", "left_anti")


def look_ahead(cases: DataFrame, points: DataFrame) -> DataFrame:
    """Cases (series_id, origin, n_known) whose recorded number of known points is not that of the points up to the origin: each
    is a violation."""
    seen = cases.join(points.select("series_id", "x"), "series_id", "left").groupBy("series_id", "origin", "n_known").agg(F.count_if(F.col("x") <= F.col("origin")).alias("n_seen"))
    return seen.filter("n_seen <> n_known")
