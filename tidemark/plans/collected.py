"""What collectors make of landed rows, on stand-ins from the star schema, as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collect
from ..sources import domain
from .catalog import query

_LP = "lp AS (SELECT *, l_shipdate::DATE AS d, year(l_shipdate) AS yr FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _items(spark, sf_dir):
    i = domain.table(spark, sf_dir, "lineitem").join(domain.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return i.withColumn("d", F.to_date("l_shipdate")).withColumn("yr", F.year("l_shipdate"))


@query("concept_resolution", "WITH h AS (SELECT p_brand AS term, p_name || p_partkey AS concept, p_size % 5 AS level, (p_retailprice * 100)::BIGINT AS works, row_number() OVER (PARTITION BY p_brand, p_size % 5 BETWEEN 1 AND 3 ORDER BY p_partkey) AS nth FROM part), b AS (SELECT term, arg_max(concept, struct_pack(a := works, b := -nth)) AS concept FROM h WHERE level BETWEEN 1 AND 3 AND nth <= 5 GROUP BY ALL) SELECT term, CASE term WHEN 'Brand#1' THEN 'pinned' ELSE concept END AS concept FROM b")
def concept_resolution(spark, sf_dir):
    p = domain.table(spark, sf_dir, "part")
    hits = p.select(F.col("p_brand").alias("term"), F.concat("p_name", "p_partkey").alias("concept"), (F.col("p_size") % 5).alias("level"), F.round(F.col("p_retailprice") * 100).cast("long").alias("works"), F.col("p_partkey").alias("place"))
    return collect.resolve(hits, spark.createDataFrame([("Brand#1", "pinned")], "term string, concept string"))


@query("breadth_series", f"WITH {_LP}, c AS (SELECT p_brand AS concept, yr AS year, l_returnflag || l_linestatus AS field, count(*) AS c FROM lp GROUP BY ALL), g AS (SELECT concept, year, sum(c)::BIGINT AS total, pow(sum(c)::DOUBLE, 2) / sum(c::DOUBLE * c) AS breadth FROM c GROUP BY ALL) SELECT concept, year, total, round(breadth, 6) AS breadth, round(greatest(0.05::DOUBLE, breadth / sqrt(total)), 6) AS sigma FROM g WHERE concept IN (SELECT concept FROM g GROUP BY ALL HAVING count(*) >= 5)")
def breadth_series(spark, sf_dir):
    rows = _items(spark, sf_dir).groupBy(F.col("p_brand").alias("concept"), F.col("yr").alias("year"), F.concat("l_returnflag", "l_linestatus").alias("field")).agg(F.count("*").alias("n"))
    return collect.breadth(rows).withColumns({c: F.round(c, 6) for c in ("breadth", "sigma")})


@query("citation_velocity", f"WITH {_LP}, pp AS (SELECT p_brand AS term, p_partkey AS paper, round(p_retailprice)::BIGINT AS cites FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY cites DESC, paper) AS nth FROM pp WHERE cites > 300 AND cites < 1800), s AS (SELECT term, paper FROM k WHERE nth <= 15 AND term IN (SELECT term FROM k WHERE nth <= 15 GROUP BY term HAVING count(*) >= 5)), v AS (SELECT term, yr AS year, count(*) AS received FROM s JOIN lp ON p_partkey = paper GROUP BY ALL) SELECT * FROM v WHERE term IN (SELECT term FROM v GROUP BY term HAVING count(*) >= 6)")
def citation_velocity(spark, sf_dir):
    """Yearly order lines of each brand's dearest parts, as citations of seminal papers (6 years, as the data have 7)."""
    papers = domain.table(spark, sf_dir, "part").select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("paper"), F.round("p_retailprice").cast("long").alias("cites"))
    cited = domain.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("paper"), F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"))
    return collect.citation_velocity(papers, cited, high=1800, min_years=6)


@query("frontier_maximum", f"WITH {_LP}, e AS (SELECT trim(unnest(string_split(p_type || ', ' || l_returnflag, ','))) AS domain, yr AS year, l_extendedprice AS v FROM lp WHERE l_extendedprice > 0) SELECT domain, year, max(v) AS top FROM e WHERE domain <> '' GROUP BY ALL")
def frontier_maximum(spark, sf_dir):
    rows = _items(spark, sf_dir).select(F.col("yr").alias("year"), F.col("l_extendedprice").alias("value"), F.concat("p_type", F.lit(", "), "l_returnflag").alias("domains"))
    return collect.frontier_max(rows)


@query("affordability", f"WITH {_LP}, c AS (SELECT p_brand AS entity, yr AS year, min(l_extendedprice) AS cost, CASE WHEN p_brand NOT LIKE 'Brand#1%' THEN 1000.0 END AS ref FROM lp GROUP BY ALL), v AS (SELECT entity, year, CASE WHEN ref IS NULL THEN cost ELSE ref / cost END::DOUBLE AS value FROM c WHERE cost > 0) SELECT entity, year, round(value, 9) AS value, round(value * 0.1::DOUBLE, 9) AS sigma FROM v WHERE entity IN (SELECT entity FROM v GROUP BY ALL HAVING count(*) >= 6)")
def affordability(spark, sf_dir):
    c = _items(spark, sf_dir).groupBy(F.col("p_brand").alias("entity"), F.col("yr").alias("year")).agg(F.min("l_extendedprice").alias("cost"))
    c = c.withColumn("ref", F.when(~F.col("entity").startswith("Brand#1"), 1000.0))
    return collect.affordability(c, 6).withColumns({k: F.round(k, 9) for k in ("value", "sigma")})


_FILED = "fl AS (SELECT o_custkey AS company, o_orderdate::DATE AS start, o_orderdate::DATE + (340 + o_orderkey % 50)::INT AS fin, CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS tag, o_orderdate::DATE + (400 + o_orderkey % 5)::INT AS filed, o_totalprice AS value, CASE WHEN o_orderkey % 4 = 0 THEN '10-K' ELSE '10-Q' END AS form, CASE WHEN o_orderkey % 9 = 0 THEN 'CY2000' WHEN o_orderkey % 9 = 1 THEN 'CY2000Q1' END AS frame FROM orders)"


def _filings(spark, sf_dir):
    i, start = F.col("o_orderkey"), F.to_date("o_orderdate")
    tag = F.when(i % 3 == 0, "A").when(i % 3 == 1, "B").otherwise("C")
    return domain.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company"), start.alias("start"), F.date_add(start, (340 + i % 50).cast("int")).alias("end"), tag.alias("tag"), F.date_add(start, (400 + i % 5).cast("int")).alias("filed"), F.col("o_totalprice").alias("value"), F.when(i % 4 == 0, "10-K").otherwise("10-Q").alias("form"), F.when(i % 9 == 0, "CY2000").when(i % 9 == 1, "CY2000Q1").alias("frame"))


@query("annual_filings", f"WITH {_FILED} SELECT company, year(fin) AS year, arg_max(value, struct_pack(a := filed, b := CASE tag WHEN 'A' THEN 0 ELSE -1 END, c := value)) AS value FROM fl WHERE tag IN ('A', 'B') AND date_diff('day', start, fin) BETWEEN 350 AND 380 GROUP BY ALL")
def annual_filings(spark, sf_dir):
    return collect.annual_filings(_filings(spark, sf_dir), ["A", "B"])


@query("full_year_values", f"WITH {_FILED}, r AS (SELECT *, row_number() OVER (PARTITION BY company, tag ORDER BY fin DESC, filed DESC, value DESC) AS rn FROM fl WHERE coalesce(regexp_full_match(frame, 'CY[0-9]{{4}}'), false) OR (form = '10-K' AND date_diff('day', start, fin) BETWEEN 350 AND 380)) SELECT company, tag, value, fin::VARCHAR AS \"end\" FROM r WHERE rn = 1")
def full_year_values(spark, sf_dir):
    return collect.full_year_value(_filings(spark, sf_dir)).withColumn("end", F.col("end").cast("string"))


@query("fiscal_year_sums", f"WITH {_LP} SELECT p_brand AS key, yr + CASE WHEN month(d) >= 10 THEN 1 ELSE 0 END AS year, sum(l_quantity) AS value FROM lp GROUP BY ALL")
def fiscal_year_sums(spark, sf_dir):
    return collect.fiscal_sums(_items(spark, sf_dir).select(F.col("p_brand").alias("key"), "d", F.col("l_quantity").alias("value")))


@query("yearly_sums", f"WITH {_LP} SELECT p_name AS key, yr AS year, sum(l_quantity) AS value FROM lp WHERE yr BETWEEN 1996 AND 2000 GROUP BY ALL")
def yearly_sums(spark, sf_dir):
    return collect.yearly_sums(_items(spark, sf_dir).select(F.col("p_name").alias("key"), "d", F.col("l_quantity").alias("value")), 1996, 2000)


@query("monthly_intensity", f"WITH {_LP}, dy AS (SELECT p_brand AS key, d, sum(l_quantity) AS v FROM lp GROUP BY ALL), m AS (SELECT key, date_trunc('month', d)::DATE AS m, avg(v) AS value, count(*) AS n FROM dy GROUP BY ALL) SELECT key, CASE WHEN month(m) = 2 THEN m + 27 ELSE last_day(m) END::VARCHAR AS as_of, round(value, 9) AS value, n FROM m")
def monthly_intensity(spark, sf_dir):
    """Means of daily sums by month, stamped at the month's end (February on the 28th)."""
    daily = _items(spark, sf_dir).groupBy(F.col("p_brand").alias("key"), "d").agg(F.sum("l_quantity").alias("value"))
    return collect.monthly_means(daily).withColumns({"value": F.round("value", 9), "as_of": F.col("as_of").cast("string")})


_TRADE = f"{_LP}, tr AS (SELECT p_type AS good, yr AS year, s_nationkey AS partner, CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS partner2, l_returnflag, l_quantity AS v FROM lp JOIN supplier ON s_suppkey = l_suppkey), im AS (SELECT good, year, partner, sum(v) AS v FROM tr WHERE l_returnflag <> 'A' AND partner <> 0 AND partner2 = 0 GROUP BY ALL), xp AS (SELECT good, year, sum(v) AS x FROM tr WHERE l_returnflag = 'A' AND partner <> 0 AND partner2 = 0 GROUP BY ALL)"


@query("trade_dependency", f"WITH {_TRADE} SELECT good, year, sum(v) AS value, round(sum(v * v) / pow(sum(v), 2), 9) AS hhi, arg_max(partner, struct_pack(a := v, b := -partner)) AS top, round(max(v) / sum(v), 9) AS top_share, count(*) AS partners, round((sum(v) - coalesce(any_value(x), 0)) / sum(v), 9) AS reliance FROM im LEFT JOIN xp USING (good, year) GROUP BY good, year")
def trade_dependency(spark, sf_dir):
    """Concentration and net reliance of imports by partner; the world and second partners are not partners."""
    s = domain.table(spark, sf_dir, "supplier")
    t = _items(spark, sf_dir).join(s, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("p_type").alias("good"), F.col("yr").alias("year"), F.col("s_nationkey").alias("partner"), F.when(F.col("l_linenumber") == 7, 1).otherwise(0).alias("partner2"), "l_returnflag", F.col("l_quantity").alias("value"))
    got = collect.dependency(t.filter("l_returnflag <> 'A'"), t.filter("l_returnflag = 'A'"))
    return got.withColumns({c: F.round(c, 9) for c in ("hhi", "top_share", "reliance")})


_DECREE = """de AS (SELECT p_name AS key, o_orderdate::DATE AS d, CASE WHEN o_orderpriority LIKE '%LOW%' THEN -1 ELSE 1 END AS sign FROM orders JOIN part ON p_partkey = o_orderkey % 2000 WHERE contains(lower(o_orderpriority), 'low') OR contains(lower(o_orderpriority), 'urgent')),
sp AS (SELECT key, unnest(generate_series(date_trunc('month', min(d))::DATE, date_trunc('month', max(d))::DATE, INTERVAL 1 MONTH))::DATE AS m FROM de GROUP BY key),
me AS (SELECT key, m, CASE WHEN month(m) = 2 THEN m + 27 ELSE last_day(m) END AS as_of FROM sp)"""


def _decrees(spark, sf_dir):
    o = domain.table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey") % 2000)
    e = o.join(domain.table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("k"))
    sign = collect.polarity(F.col("o_orderpriority"), ["low", "urgent"], ["low"])
    return e.select(F.col("p_name").alias("key"), F.to_date("o_orderdate").alias("d"), sign.alias("sign")).filter("sign IS NOT NULL")


@query("decree_velocity", f"WITH {_DECREE} SELECT me.key, me.as_of::VARCHAR AS as_of, coalesce(sum(sign), 0)::BIGINT AS net FROM me LEFT JOIN de ON de.key = me.key AND de.d <= me.as_of AND de.d > (m - INTERVAL 1 YEAR)::DATE GROUP BY ALL")
def decree_velocity(spark, sf_dir):
    """The trailing net of texts that tighten or relax, at each month's end."""
    return collect.trailing_net(_decrees(spark, sf_dir), ["key"]).withColumn("as_of", F.col("as_of").cast("string"))


@query("acting_decrees", "SELECT o_orderkey, CASE WHEN (contains(lower(o_orderpriority), 'low') OR contains(lower(o_orderpriority), 'medium')) AND contains(lower(o_orderstatus), 'f') THEN CASE WHEN contains(lower(o_orderpriority), 'low') THEN -1 ELSE 1 END END AS sign FROM orders")
def acting_decrees(spark, sf_dir):
    """A text must name an input and an action."""
    text = F.concat_ws(" ", F.regexp_replace("o_orderpriority", "[Ff]", ""), "o_orderstatus")
    return domain.table(spark, sf_dir, "orders").select("o_orderkey", collect.polarity(text, ["low", "medium"], ["low"], ["f"]).alias("sign"))


@query("deduped_years", f"WITH {_LP} SELECT p_brand AS key, yr AS year, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS value FROM lp WHERE l_quantity > 0 AND l_linenumber = 1 GROUP BY ALL")
def deduped_years(spark, sf_dir):
    r = _items(spark, sf_dir).filter("l_linenumber = 1").select(F.col("p_brand").alias("key"), F.col("yr").alias("year"), F.col("l_quantity").alias("value"), F.struct("l_orderkey", "l_quantity").alias("landed"))
    return collect.deduped_years(r)


@query("yearly_counts", f"WITH {_LP} SELECT p_type AS topic, yr AS year, count(*) AS n FROM lp WHERE yr BETWEEN 1996 AND 2001 GROUP BY ALL")
def yearly_counts(spark, sf_dir):
    return collect.yearly_counts(_items(spark, sf_dir).withColumnRenamed("p_type", "topic"), ["topic"], 1996, 2001)


@query("fetch_cache", "WITH f AS (SELECT o_custkey AS url, CASE o_orderkey % 5 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END AS status, o_orderkey AS body, o_orderdate AS ts FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts DESC, body DESC) AS rn, count(*) OVER (PARTITION BY url, ts) AS same FROM f) SELECT url, status FROM r WHERE rn = 1 AND same = 1 AND (status = 404 OR (status = 200 AND date_diff('day', ts::DATE, DATE '2001-08-01') < 200))")
def fetch_cache(spark, sf_dir):
    """Answers that may be used again (urls with two last answers at once are left out)."""
    i = F.col("o_orderkey")
    f = domain.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), F.when(i % 5 == 0, 404).when(i % 5 == 1, 500).otherwise(200).alias("status"), i.alias("body"), F.col("o_orderdate").alias("at"))
    twice = f.groupBy("url", "at").count().join(f.groupBy("url").agg(F.max("at").alias("at")), ["url", "at"]).filter("count > 1").select("url")
    return collect.fresh_cache(f.join(twice, "url", "left_anti"), F.lit("2001-08-01").cast("date"), 200).select("url", "status")
