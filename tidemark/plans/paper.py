"""Metrics of panels of forecasters beside a price, as named queries: four forecasters answer every labelled document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panels
from ..sources import domain
from ..streaming.flows import cut
from .catalog import RATED, query

_PANEL = f"{RATED}, panel AS (SELECT 'f' || f AS forecaster, doc_id AS question, (doc_id % 3)::INT AS round, least(0.99::DOUBLE, greatest(0.01::DOUBLE, p + ((doc_id * (f + 3)) % 11 - 5) / 20.0::DOUBLE)) AS p, p AS ref, outcome AS y FROM rated, (SELECT unnest([0, 1, 2, 3]) AS f))"


def panel(spark, sf_dir, balanced: bool = True):
    r = domain.rated(spark, sf_dir).withColumn("f", F.explode(F.array(*map(F.lit, range(4)))))
    p = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("p") + ((F.col("doc_id") * (F.col("f") + 3)) % 11 - 5) / F.lit(20.0)))
    df = r.select(F.concat(F.lit("f"), "f").alias("forecaster"), F.col("doc_id").alias("question"), (F.col("doc_id") % 3).cast("int").alias("round"), p.alias("p"), F.col("p").alias("ref"), F.col("outcome").alias("y"), "f")
    return df.drop("f") if balanced else df.filter((F.col("question") + F.col("f")) % 5 != 0).drop("f")


@query("marginal_edges", f"WITH {_PANEL} SELECT round, forecaster, count(*) AS n, round(avg(pow(ref - y, 2) - pow(p - y, 2)), 9) AS edge, round(avg(pow(p - y, 2)), 9) AS brier, round(avg(pow(ref - y, 2)), 9) AS constant FROM panel GROUP BY ALL")
def marginal_edges(spark, sf_dir):
    """Mean edge over the price; edge and Brier add up to one constant a round, so both rank alike."""
    return panels.mean_edges(panel(spark, sf_dir), ["round", "forecaster"]).withColumns({c: F.round(c, 9) for c in ("edge", "brier", "constant")})


@query("order_equivalence", f"WITH {_PANEL}, c AS (SELECT round, forecaster, avg(pow(ref - y, 2)) AS constant FROM panel GROUP BY ALL) SELECT round, count(*) AS forecasters, round(max(constant) - min(constant), 9) + 0.0 AS spread FROM c GROUP BY ALL")
def order_equivalence(spark, sf_dir):
    g = panels.mean_edges(panel(spark, sf_dir), ["round", "forecaster"]).groupBy("round").agg(F.count("*").alias("forecasters"), (F.round(F.max("constant") - F.min("constant"), 9) + 0.0).alias("spread"))
    return g


@query("adjusted_effects")
def adjusted_effects(spark, sf_dir):
    """Difficulty-adjusted effect of each forecaster on an unbalanced panel (alternating means, so no SQL)."""
    df = panels.edges(panel(spark, sf_dir, balanced=False))
    return panels.adjusted_effects(df, F.col("d"), cut)


@query("contributions")
def contributions(spark, sf_dir):
    """Encompassing weight and gain of log-likelihood beyond the price, raw, corrected and cross-fitted (Newton steps, so no SQL)."""
    return panels.contribution(panel(spark, sf_dir), cut)


@query("split_half_reliability")
def split_half_reliability(spark, sf_dir):
    """Rank correlation of mean Brier between two halves of the questions (halves by Spark's hash, so no SQL)."""
    return panels.split_half(panel(spark, sf_dir))
