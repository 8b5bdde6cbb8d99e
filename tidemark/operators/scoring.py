"""Scoring of probabilities: calibration, reliability, discrimination, base rates, resolution and scenario rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import brier, log_loss


def calibration(df: DataFrame, by: list[str] = (), p: str = "p", y: str = "outcome") -> DataFrame:
    """n, mean Brier, that of one half, mean log loss, hit rate at one half."""
    yes = F.col(y).cast("double")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(brier(F.col(p), F.col(y))).alias("brier"), F.avg(brier(F.lit(0.5), F.col(y))).alias("brier_half"), F.avg(log_loss(F.col(p), F.col(y))).alias("log_loss"),
        F.avg(((F.col(p) >= 0.5) == (yes == 1)).cast("double")).alias("hit_rate"), F.avg(yes).alias("base_rate"))


def reliability(df: DataFrame, bins: int = 5, p: str = "p", y: str = "outcome") -> DataFrame:
    """Equal bins of p, the last closed at 1: n, mean p, observed rate."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(p) * bins)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def auc(df: DataFrame, p: str = "p", y: str = "outcome") -> DataFrame:
    """Area under the curve with half credit for ties, from counts per distinct p (not pairs). Prefix counts go over the
    distinct values, by slices of equal ranges of p, so no task orders all of them."""
    pos, neg = F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)
    per = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(p).alias("v")).agg(pos.alias("pos"), neg.alias("neg"))
    per = per.withColumn("slice", F.floor(F.col("v") * 4096))
    slices = per.groupBy("slice").agg(F.sum("neg").alias("sneg")).withColumn("before", F.coalesce(F.sum("sneg").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("sneg")
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("slice").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = per.withColumn("inside", inside).join(F.broadcast(slices), "slice")  # 4097 slices of [0, 1] at most
    twice = F.sum(F.col("pos") * (2 * (F.col("before") + F.col("inside")) + F.col("neg")))
    return wins.agg(twice.alias("u2"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")).select("n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u2") / (2.0 * F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def unresolvable(cards: DataFrame) -> DataFrame:
    """Adds void: a conditional card whose parent came out false."""
    parents = cards.select(F.col("card_id").alias("__p"), F.col("outcome").alias("__po"))
    return cards.join(parents, F.col("parent_id") == F.col("__p"), "left").withColumn("void", F.coalesce(F.col("__po") == 0, F.lit(False))).drop("__p", "__po")


def live(cards: DataFrame) -> DataFrame:
    """Cards that none supersedes."""
    gone = cards.select(F.col("supersedes").alias("card_id")).filter("card_id IS NOT NULL")
    return cards.join(gone, "card_id", "left_anti")


def sums_to_one(tree: DataFrame, tol: float = 0.005) -> DataFrame:
    """Parents whose children's conditionals don't sum to 1 within the tolerance (a violation each)."""
    return tree.filter("parent_id IS NOT NULL").groupBy("parent_id").agg(F.sum("p").alias("total"), F.count("*").alias("children")).filter(F.abs(F.col("total") - 1) > tol)


def marginals(tree: DataFrame, cut) -> DataFrame:
    """card_id, depth, marginal: product of the conditionals from the root down, for trees of any depth: (card_id, parent_id, p).

    Pointer doubling: each round every card's pointer jumps over as many ancestors as all rounds before it, so the rounds are the
    logarithm of the depth. `cut` (a function of a DataFrame) writes each round down and reads it again. Cards on a cycle or below
    a missing parent have no root and are left out."""
    at = cut(tree.select("card_id", F.col("parent_id").alias("up"), F.col("p").cast("double").alias("marginal"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    before = None
    # Each round closes some cards of a tree that has open ones; those on a cycle never close.
    while (n := at.filter("up IS NOT NULL").count()) and n != before:
        before = n
        above = at.select(F.col("card_id").alias("up"), F.col("up").alias("next"), F.col("marginal").alias("m"), F.col("depth").alias("d"))
        open_ = at.filter("up IS NOT NULL").join(above, "up").select("card_id", F.col("next").alias("up"), (F.col("marginal") * F.col("m")).alias("marginal"), (F.col("depth") + F.col("d")).alias("depth"))
        at = cut(at.filter("up IS NULL").unionByName(open_))
    return at.filter("up IS NULL").select("card_id", "depth", "marginal")


def belief_net(edges: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with the target's probability as it is, if the source comes true, and if not, taking what has been resolved into
    account; live roots that no edge touches). edges: src, dst, p_true; cards: card_id, parent_id, p, outcome."""
    c = cards.select("card_id", F.coalesce(F.col("outcome").cast("double"), F.col("p")).alias("p_now"), F.col("outcome"))
    e = edges.join(c.toDF("src", "p_from", "from_outcome"), "src").join(c.toDF("dst", "p_to", "to_outcome"), "dst")
    false = given_false(F.col("p_to"), F.col("p_true"), F.col("p_from"))
    e = e.select("src", "dst", F.col("p_to").alias("prior"), F.when(F.col("from_outcome").isNull(), F.col("p_true")).alias("if_true"), F.when(F.col("from_outcome").isNull(), false).alias("if_false"))
    touched = edges.select(F.col("src").alias("card_id")).unionByName(edges.select(F.col("dst").alias("card_id")))
    return e, cards.filter("parent_id IS NULL AND outcome IS NULL").join(touched, "card_id", "left_anti").select("card_id")


def given_false(p_to: Column, p_true: Column, p_from: Column) -> Column:
    """P(to | not from) implied by P(to) and P(to | from); null if from is certain."""
    return F.when(p_from < 1, (p_to - p_true * p_from) / (1 - p_from))


def extremized(p: Column, a: float = 1.2, lo: float = 0.02, hi: float = 0.98) -> Column:
    from ..functions.stats import clipped_logit, logistic

    return F.greatest(F.lit(lo), F.least(F.lit(hi), logistic(F.lit(a) * clipped_logit(p))))
