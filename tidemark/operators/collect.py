"""What collectors make of landed rows: yearly and monthly series, concentrations, trailing nets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enough(df: DataFrame, key: list[str], least: int = 8) -> DataFrame:
    """The series of at least so many periods; a shorter one is never stored."""
    return df.join(df.groupBy(*key).count().filter(F.col("count") >= least).select(*key), key, "left_semi")


def resolve(hits: DataFrame, pinned: DataFrame, considered: int = 5) -> DataFrame:
    """term, concept: the pinned id, else the most used of the first `considered` hits (term, place, concept, level, works) of level 1 to 3."""
    ok = hits.filter("level BETWEEN 1 AND 3")
    nth = F.row_number().over(Window.partitionBy("term").orderBy("place"))
    best = ok.withColumn("nth", nth).filter(F.col("nth") <= considered).groupBy("term").agg(F.max_by("concept", F.struct("works", -F.col("nth"))).alias("found"))
    return best.join(pinned.select("term", F.col("concept").alias("pin")), "term", "full_outer").select("term", F.coalesce("pin", "found").alias("concept"))


def breadth(rows: DataFrame, min_years: int = 5) -> DataFrame:
    """concept, year, breadth (inverse Simpson over fields), sigma = max(0.05, breadth / root of the total); rows without field are
    dropped, and concepts under `min_years` years."""
    per = rows.filter("field IS NOT NULL").groupBy("concept", "year", "field").agg(F.sum("n").alias("c"))
    d = F.pow(F.sum("c").cast("double"), 2) / F.sum(F.col("c").cast("double") * F.col("c"))
    g = per.groupBy("concept", "year").agg(F.sum("c").alias("total"), d.alias("breadth")).withColumn("sigma", F.greatest(F.lit(0.05), F.col("breadth") / F.sqrt("total")))
    return enough(g, ["concept"], min_years)


def citation_velocity(papers: DataFrame, citations: DataFrame, most: int = 15, low: int = 300, high: int = 8000, least: int = 5, min_years: int = 8) -> DataFrame:
    """term, year, received: citations per year of the term's seminal papers, the `most` most cited of those with low < cites < high;
    terms with fewer than `least` of them are left out."""
    nth = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("cites"), "paper"))
    seminal = papers.filter((F.col("cites") > low) & (F.col("cites") < high)).withColumn("nth", nth).filter(F.col("nth") <= most).select("term", "paper")
    seminal = seminal.join(seminal.groupBy("term").count().filter(F.col("count") >= least).select("term"), "term", "left_semi")
    return enough(seminal.join(citations, "paper").groupBy("term", "year").agg(F.sum("n").alias("received")), ["term"], min_years)


def frontier_max(rows: DataFrame) -> DataFrame:
    """domain, year, top: the greatest value of each domain of a comma-separated list."""
    d = F.explode(F.split("domains", ","))
    return rows.filter("value > 0").select("year", "value", d.alias("d")).select(F.trim("d").alias("domain"), "year", "value").filter("domain <> ''").groupBy("domain", "year").agg(F.max("value").alias("top"))


def affordability(costs: DataFrame, min_years: int = 8) -> DataFrame:
    """entity, year, value: the reference cost over the cost, or the cost itself without reference; sigma is a tenth of it."""
    v = F.when(F.col("ref").isNull(), F.col("cost")).otherwise(F.col("ref") / F.col("cost"))
    return enough(costs.filter("cost > 0").select("entity", "year", v.alias("value"), (v * 0.1).alias("sigma")), ["entity"], min_years)


def annual_filings(rows: DataFrame, tags: list[str]) -> DataFrame:
    """company, year, value: full-year rows (350 to 380 days) of filings; of a year the last filed wins, ties to the earlier tag."""
    days = F.datediff("end", "start")
    place = F.lit(len(tags))
    for i, t in enumerate(tags):
        place = F.when(F.col("tag") == t, i).otherwise(place)
    return rows.filter(F.col("tag").isin(tags) & days.between(350, 380)).groupBy("company", F.year("end").alias("year")).agg(F.max_by("value", F.struct("filed", -place, "value")).alias("value"))


def fiscal_sums(rows: DataFrame, first_month: int = 10) -> DataFrame:
    """key, year, value: sums by fiscal year; years that begin in October count to the next."""
    year = F.year("d") + F.when(F.month("d") >= first_month, 1).otherwise(0)
    return rows.groupBy("key", year.alias("year")).agg(F.sum("value").alias("value"))


def yearly_sums(rows: DataFrame, first: int, last: int) -> DataFrame:
    return rows.filter(F.year("d").between(first, last)).groupBy("key", F.year("d").alias("year")).agg(F.sum("value").alias("value"))


def monthly_means(rows: DataFrame) -> DataFrame:
    """key, as_of (the month's end; February always the 28th), value: means of daily values."""
    month = F.trunc("d", "MM")
    g = rows.groupBy("key", month.alias("m")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    end = F.when(F.month("m") == 2, F.date_add("m", 27)).otherwise(F.last_day("m"))
    return g.select("key", end.alias("as_of"), "value", "n")


def dependency(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """good, year, value, hhi, top, top_share, partners, reliance: from partner rows (good, year, partner, partner2, value) without the
    world as a partner and without second partners. reliance = (imports - exports) / imports."""
    clean = lambda d: d.filter("partner <> 0 AND coalesce(partner2, 0) = 0 AND value > 0")
    per = clean(imports).groupBy("good", "year", "partner").agg(F.sum("value").alias("v"))
    g = per.groupBy("good", "year").agg(F.sum("v").alias("value"), (F.sum(F.col("v") * F.col("v")) / F.pow(F.sum("v"), 2)).alias("hhi"), F.max_by("partner", F.struct("v", -F.col("partner"))).alias("top"), (F.max("v") / F.sum("v")).alias("top_share"), F.count("*").alias("partners"))
    out = clean(exports).groupBy("good", "year").agg(F.sum("value").alias("x"))
    return g.join(out, ["good", "year"], "left").withColumn("reliance", (F.col("value") - F.coalesce("x", F.lit(0.0))) / F.col("value")).drop("x")


def polarity(text: Column, inputs: list[str], relaxing: list[str], acting: list[str] | None = None) -> Column:
    """1 for a text that names an input (and an action, where those are given), -1 if it also relaxes; null for any other."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))
    named = has(inputs) if acting is None else has(inputs) & has(acting)
    return F.when(named, F.when(has(relaxing), -1).otherwise(1))


def trailing_net(events: DataFrame, key: list[str]) -> DataFrame:
    """key, as_of, net of events (d, sign): at each month's end between first and last event, the sum over (first day of the same
    month a year before, month's end]; February ends on the 28th.

    An event is exploded to the at most 14 month ends that count it and added there: no range join. The spine fills empty months."""
    first = F.trunc("d", "MM")
    ends = F.sequence(F.lit(0), F.lit(13))
    month = lambda i: F.add_months(first, i)
    end_of = lambda m: F.when(F.month(m) == 2, F.date_add(m, 27)).otherwise(F.last_day(m))
    daily = events.groupBy(*key, "d").agg(F.sum("sign").alias("s"))
    hit = daily.select(*key, "d", "s", F.explode(F.transform(ends, month)).alias("m")).filter((F.col("d") <= end_of(F.col("m"))) & (F.col("d") > F.add_months("m", -12)))
    sums = hit.groupBy(*key, "m").agg(F.sum("s").alias("s"))
    span = daily.groupBy(*key).agg(F.min(first).alias("a"), F.max(first).alias("b"))
    spine = span.select(*key, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    return spine.join(sums, [*key, "m"], "left").select(*key, end_of(F.col("m")).alias("as_of"), F.coalesce("s", F.lit(0)).alias("net"))


def deduped_years(rows: DataFrame) -> DataFrame:
    """key, year, value: one positive value per year, the last landed."""
    return rows.filter("value > 0").groupBy("key", "year").agg(F.max_by("value", "landed").alias("value"))


def yearly_counts(rows: DataFrame, by: list[str], first: int, last: int) -> DataFrame:
    """by, year, n of dated rows (d) within the window."""
    return rows.filter(F.year("d").between(first, last)).groupBy(*by, F.year("d").alias("year")).agg(F.count("*").alias("n"))


def full_year_value(rows: DataFrame) -> DataFrame:
    """company, tag, value, end: rows whose frame is a calendar year's (CY2020), or that a 10-K reports over 350 to 380 days; the
    latest end wins, ties to the last filed."""
    whole = F.coalesce(F.col("frame").rlike("^CY[0-9]{4}$"), F.lit(False)) | ((F.col("form") == "10-K") & F.datediff("end", "start").between(350, 380))
    return rows.filter(whole).groupBy("company", "tag").agg(F.max_by(F.struct("value", "end"), F.struct("end", "filed", "value")).alias("r")).select("company", "tag", "r.*")


def fresh_cache(fetched: DataFrame, now: Column, ttl_days: int) -> DataFrame:
    """The last answer of each url that may be used again: younger than the limit, or a refusal for good (404) of any age; other
    failures are asked again."""
    last = fetched.groupBy("url").agg(F.max_by(F.struct("status", "body", "at"), "at").alias("r")).select("url", "r.*")
    return last.filter((F.col("status") == 404) | ((F.col("status") == 200) & (F.datediff(now, F.col("at")) < ttl_days)))
