"""The discovery funnel: which series survive the look-elsewhere control, and which entities lead without being priced."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Providers whose moves lead, those that follow, the fine-grained leads, and what no live scan reads.
LEAD = ("owid", "epoch_ai", "nih_reporter", "arxiv", "fred", "un_comtrade")
LAG = ("openalex", "wikipedia", "sec_edgar", "federal_register", "google_patents", "gdelt", "comtrade_china")
FINE = ("arxiv", "nih_reporter")
EXCLUDED = ("retro", "synthetic")


def mirrored_p(tests: DataFrame, up: str = "surprise", down: str = "down_surprise") -> DataFrame:
    """Adds p: the share of all scanned series that fall at least as far as this one rises, (1 + falls >= rise) / (n + 1). A
    trend broken by nothing but noise falls as often as it rises, so the falls are the null.

    Falls are counted by prefix sums inside slices of the values and over the slices: no task orders all series."""
    marks = tests.select(F.col(up).alias("v"), F.lit(0).alias("fall")).unionByName(tests.select(F.col(down).alias("v"), F.lit(1).alias("fall")))
    per = marks.groupBy("v").agg(F.sum("fall").alias("falls")).withColumn("slice", F.floor(F.least(F.col("v"), F.lit(1e5)) * 16))
    above = Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    slices = per.groupBy("slice").agg(F.sum("falls").alias("all")).select("slice", F.coalesce(F.sum("all").over(above), F.lit(0)).alias("higher"))
    inside = F.sum("falls").over(Window.partitionBy("slice").orderBy(F.desc("v")))
    counted = per.withColumn("inside", inside).join(slices, "slice").select(F.col("v").alias(up), (F.col("inside") + F.col("higher")).alias("falls"))
    n = tests.agg(F.count("*").alias("n_all"))
    return tests.join(counted, up).crossJoin(F.broadcast(n)).withColumn("p", (F.col("falls") + 1) / (F.col("n_all") + 1)).drop("falls", "n_all")  # n: one row


def live_series(series: DataFrame, health: DataFrame) -> DataFrame:
    """Series of providers that are scanned, without those whose audit failed."""
    failed = health.filter("status = 'fail'").select("series_id")
    return series.filter(~F.col("provider").isin(*EXCLUDED)).join(failed, "series_id", "left_anti")


def pre_consensus(evidence: DataFrame, saturation: DataFrame, tickers: DataFrame) -> DataFrame:
    """One row per entity of evidence (entity, series_id, provider, fired, survive, surprise): class, lead_sigma, coarse_only,
    n_lead, n_lag, n_unclassified, saturation, demoted, has_ticker, place.

    A lead must survive the control, a lag only fire. EARLY: leads alone; PRICED: both, or a measured saturation that says so;
    LAGGING: lags alone; else QUIET. place ranks the EARLY: fine evidence first, then the least saturated (unmeasured as 1), then
    the strongest."""
    lead, lag = F.col("provider").isin(*LEAD), F.col("provider").isin(*LAG)
    hit = lead & F.col("fired") & F.col("survive")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    e = evidence.groupBy("entity").agg(
        any_(hit).alias("leads"), any_(lag & F.col("fired")).alias("lags"), any_(hit & F.col("provider").isin(*FINE)).alias("fine"), F.coalesce(F.max(F.when(hit, F.greatest(F.col("surprise"), F.lit(0.0)))), F.lit(0.0)).alias("lead_sigma"),
        F.count_if(lead).alias("n_lead"), F.count_if(lag).alias("n_lag"), F.count_if(~lead & ~lag).alias("n_unclassified"))
    e = e.join(saturation.select("entity", "saturation", "verdict"), "entity", "left").join(tickers.select("entity", F.lit(True).alias("ticker")).distinct(), "entity", "left")
    early = F.col("leads") & ~F.col("lags")
    demoted = early & F.coalesce(F.col("verdict") == "priced/known", F.lit(False))
    kind = F.when(early & ~demoted, "EARLY").when(F.col("leads"), "PRICED").when(F.col("lags"), "LAGGING").otherwise("QUIET")
    e = e.withColumn("class", kind).withColumn("demoted", demoted).withColumn("coarse_only", F.col("leads") & ~F.col("fine"))
    order = Window.partitionBy("class").orderBy("coarse_only", F.coalesce("saturation", F.lit(1.0)), F.desc("lead_sigma"), "entity")
    first = e.filter("class = 'EARLY'").withColumn("place", F.row_number().over(order)).select("entity", "place")
    return e.join(first, "entity", "left").select("entity", "class", "lead_sigma", "coarse_only", "n_lead", "n_lag", "n_unclassified", "saturation", "demoted", F.coalesce("ticker", F.lit(False)).alias("has_ticker"), "place")


def instruments(proposals: DataFrame, filers: DataFrame) -> DataFrame:
    """Candidates from proposals (entity, layer, symbol, name, confidence): entity, symbol, layer, cik, label, confidence of those whose symbol
    is a filer's (filers: ticker, cik); what is not is dropped as invented. A symbol is compared in upper case; confidence is 0.7 at
    most, as a proposal is no measurement; of repeated proposals of an entity's layer and symbol the most confident holds."""
    p = proposals.withColumn("symbol", F.upper(F.trim("symbol"))).join(filers.select(F.col("ticker").alias("symbol"), "cik"), "symbol")
    label = F.concat("symbol", F.lit(" ["), "layer", F.lit("] "), F.substring("name", 1, 40))
    return p.groupBy("entity", "symbol", "layer", "cik").agg(F.max_by(label, F.struct("confidence", "name")).alias("label"), F.least(F.max("confidence"), F.lit(0.7)).alias("confidence"))


def pairs(accepted: DataFrame) -> DataFrame:
    """entity, inelastic, inelastic_cik, elastic, elastic_cik of the entities that have an accepted instrument in both layers (of several the
    least symbol): what the consensus gate prices."""
    of = lambda layer: F.min(F.when(F.col("layer") == layer, F.struct("symbol", "cik"))).alias(layer)
    both = accepted.groupBy("entity").agg(of("inelastic"), of("elastic")).filter("inelastic IS NOT NULL AND elastic IS NOT NULL")
    return both.select("entity", F.col("inelastic.symbol").alias("inelastic"), F.col("inelastic.cik").alias("inelastic_cik"), F.col("elastic.symbol").alias("elastic"), F.col("elastic.cik").alias("elastic_cik"))
