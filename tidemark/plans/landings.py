"""Landed files as named queries: tables are written as the files that collectors would have left, and read back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import domain, landed
from ..streaming.flows import root
from .catalog import query


#: Rows of a landed document: more rows are more documents, so none grows with the table.
ROWS = 5000


def _nth(key: str):
    """The document that a row with this running number lands in."""
    return F.floor(F.col(key) / ROWS).cast("string").alias("name")


def _documents(df, path: str) -> str:
    """(name, value) rows -> a file for each name below the path."""
    df.select("name", "value").repartition("name").write.partitionBy("name").text(path)
    return path


@query("landed_works", "SELECT coalesce(source, 'none') AS concept, 2018 + (doc_id % 9)::INT AS year, count(*) AS works FROM documents WHERE 2018 + doc_id % 9 <= 2024 GROUP BY ALL")
def landed_works(spark, sf_dir):
    """Works of each concept by year, within the window."""
    d = domain.table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("name"), (F.col("doc_id") % 9 + 2018).cast("int").alias("year")).agg(F.count("*").alias("works_count"))
    doc = F.to_json(F.struct(F.col("name").alias("id"), F.col("rows").alias("counts_by_year")))
    return landed.works_by_year(spark, _documents(d.groupBy("name").agg(F.collect_list(F.struct("year", "works_count")).alias("rows")).withColumn("value", doc), root(spark)))


@query("landed_hits", "SELECT o_orderpriority AS phrase, year(o_orderdate)::INT AS year, CASE WHEN year(o_orderdate) % 3 <> 0 THEN count(*) END AS n FROM orders GROUP BY o_orderpriority, year(o_orderdate)")
def landed_hits(spark, sf_dir):
    """Hits of a phrase by year; a failed fetch stays unknown."""
    n = domain.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("phrase"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("total"))
    path = root(spark)
    n.withColumn("total", F.when(F.col("year") % 3 != 0, F.col("total"))).write.json(path)
    return landed.yearly_hits(spark, path)


_DAILY = "SELECT p_type AS symbol, l_shipdate::DATE AS d, sum(l_quantity) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"


def _daily(spark, sf_dir):
    part = domain.table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("symbol"))
    return domain.table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("symbol", F.to_date("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("close"))


@query("landed_quotes", f"SELECT symbol, d::VARCHAR AS d, close FROM ({_DAILY}) WHERE day(d) <> 13")
def landed_quotes(spark, sf_dir):
    """Daily quotes from files for each symbol; days without a number are no quotes."""
    path, none = root(spark), F.lit("N/D")
    close = F.when(F.dayofmonth("d") == 13, none).otherwise(F.col("close").cast("string"))
    rows = _daily(spark, sf_dir).select("symbol", F.col("d").cast("string").alias("Date"), none.alias("Open"), none.alias("High"), none.alias("Low"), close.alias("Close"), none.alias("Volume"))
    rows.repartition("symbol").write.option("header", True).partitionBy("symbol").csv(path)
    return landed.quotes(spark, path).withColumn("d", F.col("d").cast("string"))


@query("landed_averages", f"SELECT symbol AS series, year(d)::INT AS year, round(avg(close), 9) AS value FROM ({_DAILY}) WHERE day(d) <> 13 GROUP BY symbol, year(d)")
def landed_averages(spark, sf_dir):
    """Yearly means of a series whose missing values are points."""
    path = root(spark)
    v = F.when(F.dayofmonth("d") == 13, ".").otherwise(F.col("close").cast("string"))
    rows = _daily(spark, sf_dir).select("symbol", F.col("d").cast("string").alias("observation_date"), v.alias("value"))
    rows.repartition("symbol").write.option("header", True).partitionBy("symbol").csv(path)
    return landed.annual_averages(spark, path).withColumn("value", F.round("value", 9))


@query("landed_indicator", "SELECT 'n' || c_nationkey AS country, 'balance' AS indicator, 2000 + (c_custkey % 5)::INT AS year, sum(round(c_acctbal)::BIGINT)::DOUBLE AS value FROM customer WHERE c_custkey % 7 <> 0 GROUP BY c_nationkey, c_custkey % 5 HAVING value > 0")
def landed_indicator(spark, sf_dir):
    """Positive yearly values of an indicator; rows without a year are dropped."""
    path, c = root(spark), domain.table(spark, sf_dir, "customer")
    year = F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise((F.col("c_custkey") % 5 + 2000).cast("string"))
    rows = c.groupBy(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("country"), year.alias("date")).agg(F.sum(F.round("c_acctbal").cast("long")).cast("double").alias("value"))
    rows.withColumn("indicator", F.lit("balance")).write.json(path)
    return landed.indicator(spark, path)


@query("landed_totals", "SELECT lang AS category, count(*) AS total FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def landed_totals(spark, sf_dir):
    """The number of results that each category's feed states."""
    n = domain.table(spark, sf_dir, "documents").filter("lang IS NOT NULL").groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("n"))
    feed = F.format_string('<?xml version="1.0"?><feed xmlns:opensearch="http://a9.com/-/spec/opensearch/1.1/"><opensearch:totalResults type="int"> %d</opensearch:totalResults><opensearch:startIndex>0</opensearch:startIndex></feed>', "n")
    got = landed.category_totals(spark, _documents(n.withColumn("value", feed), root(spark)))
    return got.select(F.regexp_extract("file", r"/name=([^/]+)/", 1).alias("category"), "total")


@query("landed_papers", """SELECT doc_id::VARCHAR AS external_id, strftime(DATE '2018-01-01' + (doc_id % 1000)::INT, '%Y-%m-%d') AS published, strftime(DATE '2018-01-01' + (doc_id % 1000 + CASE WHEN doc_id % 3 = 0 THEN 30 ELSE 0 END)::INT, '%Y-%m-%d') AS updated,
  'On ' || lang || ' ' || doc_id AS title, lang || ' x.' || (doc_id % 7) AS categories, 'A B' || (doc_id % 5) || '; C' AS authors FROM documents WHERE doc_id % 11 <> 0""")
def landed_papers(spark, sf_dir):
    """Records of harvested XML files: deleted ones are no papers."""
    i, tag = F.col("doc_id"), lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    day = lambda more: F.date_format(F.date_add(F.lit("2018-01-01").cast("date"), (i % 1000).cast("int") + more), "yyyy-MM-dd")
    head = F.concat(F.lit("<header"), F.when(i % 11 == 0, ' status="deleted"').otherwise(""), F.lit(">"), tag("identifier", i.cast("string")), F.lit("</header>"))
    a = tag("authors", F.concat(tag("author", F.concat(tag("keyname", F.concat(F.lit("B"), (i % 5).cast("string"))), tag("forenames", F.lit("A")))), tag("author", tag("keyname", F.lit("C")))))
    body = F.concat(tag("id", i.cast("string")), tag("created", day(0)), F.when(i % 3 == 0, tag("updated", day(30))).otherwise(""), tag("title", F.concat(F.lit("On    "), "lang", F.lit("  "), i.cast("string"))), tag("abstract", F.lit("x")), tag("categories", F.concat("lang", F.lit(" x."), (i % 7).cast("string"))), a)
    record = F.concat(F.lit("<record>"), head, F.when(i % 11 == 0, "").otherwise(tag("metadata", tag("arXiv", body))), F.lit("</record>"))
    d = domain.table(spark, sf_dir, "documents").select(_nth("doc_id"), record.alias("r"))
    pages = d.groupBy("name").agg(F.concat(F.lit("<records>"), F.array_join(F.collect_list("r"), ""), F.lit("</records>")).alias("value"))
    return landed.papers_xml(spark, _documents(pages, root(spark))).drop("abstract")


@query("landed_rounds", """SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'q' || o_orderkey || ',q' || o_custkey ELSE 'q' || o_orderkey END AS ids, o_orderpriority AS source, (o_orderkey % 2)::DOUBLE AS outcome,
  strftime(o_orderdate, '%Y-%m-%d') AS resolves, CASE WHEN o_orderkey % 4 = 0 THEN '1,-1' END AS direction FROM orders WHERE o_orderkey % 5 <> 0""")
def landed_rounds(spark, sf_dir):
    """Resolutions of benchmark rounds, JSON documents; combinations have two ids and directions."""
    i, o = F.col("o_orderkey"), domain.table(spark, sf_dir, "orders")
    one, two, combined = F.concat(F.lit("q"), i.cast("string")), F.concat(F.lit("q"), F.col("o_custkey").cast("string")), i % 4 == 0
    ident = F.when(combined, F.to_json(F.array(one, two))).otherwise(F.concat(F.lit('"'), one, F.lit('"')))
    row = F.concat(F.lit('{"id":'), ident, F.lit(',"source":"'), "o_orderpriority", F.lit('","direction":'), F.when(combined, "[1,-1]").otherwise("null"), F.lit(',"resolution_date":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('","resolved_to":'), (i % 2).cast("string"), F.lit(',"resolved":'), F.when(i % 5 == 0, "false").otherwise("true"), F.lit("}"))
    asked = F.concat(F.lit('{"id":'), ident, F.lit(',"source":"'), "o_orderpriority", F.lit('","question":"?","freeze_datetime_value":"0.5","resolution_dates":["'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"]}'))
    doc = lambda kind, c: o.select(_nth("o_orderkey"), c.alias("r")).groupBy("name").agg(F.concat(F.lit(f'{{"{kind}":['), F.array_join(F.collect_list("r"), ","), F.lit("]}")).alias("value"))
    q, r = landed.rounds(spark, _documents(doc("questions", asked), root(spark)), _documents(doc("resolutions", row), root(spark)))
    got = r.join(q.select("ids", "source").distinct(), ["ids", "source"], "left_semi")
    return got.select(F.array_join("ids", ",").alias("ids"), "source", "outcome", "resolves", F.array_join(F.transform("direction", lambda d: d.cast("string")), ",").alias("direction"))


@query("landed_holdout", "SELECT count(*) AS n, count(*) FILTER (WHERE determined > 1998) AS scorable, count(*) FILTER (WHERE outcome = 1) AS yes FROM (SELECT o_orderkey % 2 AS outcome, year(o_orderdate) AS determined FROM orders)")
def landed_holdout(spark, sf_dir):
    """Hold-out questions of JSON lines; those determined after 1998 may be scored by a model of that year."""
    path, o = root(spark), domain.table(spark, sf_dir, "orders")
    o.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("?").alias("question"), (F.col("o_orderkey") % 2).alias("outcome"), F.year("o_orderdate").alias("determined")).write.json(path)
    return landed.holdout(spark, path).agg(F.count("*").alias("n"), F.count_if(F.col("determined") > 1998).alias("scorable"), F.count_if(F.col("outcome") == 1).alias("yes"))


@query("landed_tickers", "SELECT upper('t' || s_suppkey % 50) AS ticker, min(1000 + s_suppkey) AS cik FROM supplier GROUP BY ALL")
def landed_tickers(spark, sf_dir):
    """The register of filers: upper-case tickers, the least number of each."""
    s = domain.table(spark, sf_dir, "supplier").select(_nth("s_suppkey"), F.format_string('"%d": {"cik_str": %d, "ticker": "t%d", "title": "x"}', "s_suppkey", F.col("s_suppkey") + 1000, F.col("s_suppkey") % 50).alias("r"))
    docs = s.groupBy("name").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("r"), ", "), F.lit("}")).alias("value"))
    return landed.tickers(spark, _documents(docs, root(spark))).groupBy("ticker").agg(F.min("cik").alias("cik"))


@query("page_texts", r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS text_sha256 FROM a""")
def page_texts(spark, sf_dir):
    """All text that pages show."""
    return domain.table(spark, sf_dir, "pages").select("page_id", F.sha2(landed.plain_text(F.col("html")), 256).alias("text_sha256"))
