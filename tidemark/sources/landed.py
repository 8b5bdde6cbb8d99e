"""Readers of landed files: what a collector fetched, as rows. Every reader states its schema, so nothing is inferred by a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at the path with that schema; empty if there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def papers_xml(spark: SparkSession, path: str) -> DataFrame:
    """Harvested records (rowTag record): external_id, published, updated, title, abstract, categories, authors. Deleted records and
    those without id or date are dropped."""
    author = "struct<keyname:string,forenames:string>"
    schema = f"header struct<_status:string>, metadata struct<arXiv:struct<id:string,created:string,updated:string,title:string,abstract:string,categories:string,authors:struct<author:array<{author}>>>>"
    m = F.col("metadata.arXiv")
    names = F.transform(m["authors"]["author"], lambda a: F.trim(F.concat_ws(" ", a["forenames"], a["keyname"])))
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    raw = spark.read.format("xml").option("rowTag", "record").schema(schema).load(path)
    ok = raw.filter(F.coalesce(F.col("header._status"), F.lit("")) != "deleted").filter(m["id"].isNotNull() & m["created"].isNotNull())
    return ok.select(m["id"].alias("external_id"), m["created"].alias("published"), F.coalesce(m["updated"], m["created"]).alias("updated"), squeeze(m["title"]).alias("title"), squeeze(m["abstract"]).alias("abstract"), m["categories"].alias("categories"), F.array_join(names, "; ").alias("authors"))


def category_totals(spark: SparkSession, path: str) -> DataFrame:
    """file, total: the number of results that a feed states."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_extract("value", r"<opensearch:totalResults[^>]*>\s*(\d+)", 1).alias("t"))
    return t.select("file", F.when(F.col("t") != "", F.col("t").cast("long")).alias("total"))


def works_by_year(spark: SparkSession, path: str, first: int = 2000, last: int = 2024) -> DataFrame:
    """concept, year, works from JSON documents {id, counts_by_year: [{year, works_count}]}, within the window."""
    raw = spark.read.schema("id string, counts_by_year array<struct<year:int,works_count:long>>").json(path, multiLine=True)
    return raw.select(F.col("id").alias("concept"), F.inline("counts_by_year")).select("concept", "year", F.col("works_count").alias("works")).filter(F.col("year").between(first, last))


def yearly_hits(spark: SparkSession, path: str) -> DataFrame:
    """phrase, year, n from JSON lines {phrase, year, total}; a failed fetch has no total and stays null (not 0)."""
    return spark.read.schema("phrase string, year int, total long").json(path).groupBy("phrase", "year").agg(F.max("total").alias("n"))


def _called() -> Column:
    """What a CSV file is called: by its folder's value where that is a partition (name=value), else by its own name."""
    part = F.regexp_extract(F.input_file_name(), r"/[a-z]+=([^/]+)/[^/]+\.csv$", 1)
    return F.when(part != "", part).otherwise(F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))


def quotes(spark: SparkSession, path: str) -> DataFrame:
    """symbol, d, close from daily CSV (Date,Open,High,Low,Close,Volume), the symbol being the file's or its partition's name; rows
    without a number ('N/D') are dropped."""
    raw = spark.read.option("header", True).schema("Date string, Open string, High string, Low string, Close string, Volume string").csv(path)
    return raw.select(_called().alias("symbol"), F.col("Date").try_cast("date").alias("d"), F.col("Close").try_cast("double").alias("close")).filter("d IS NOT NULL AND close IS NOT NULL")


def annual_averages(spark: SparkSession, path: str) -> DataFrame:
    """series, year, value: means of a two-column CSV (date, value; '.' where missing) by year."""
    raw = spark.read.option("header", True).schema("d string, v string").csv(path).select(_called().alias("series"), F.col("d").try_cast("date").alias("d"), F.col("v").try_cast("double").alias("v"))
    return raw.filter("d IS NOT NULL AND v IS NOT NULL").groupBy("series", F.year("d").alias("year")).agg(F.avg("v").alias("value"))


def concept_facts(spark: SparkSession, path: str) -> DataFrame:
    """company, tag, unit, start, end, value, form, filed, frame from company-concept JSON {cik, tag, units: {unit: [rows]}}."""
    row = "array<struct<start:date,end:date,val:double,form:string,filed:date,frame:string>>"
    raw = spark.read.schema(f"cik long, tag string, units map<string,{row}>").json(path, multiLine=True)
    return raw.select(F.col("cik").alias("company"), "tag", F.explode("units").alias("unit", "rows")).select("company", "tag", "unit", F.inline("rows")).withColumnRenamed("val", "value")


def short_volumes(spark: SparkSession, path: str) -> DataFrame:
    """d, symbol, short, total from pipe-separated daily files; the trailing record count has no symbol and is dropped."""
    raw = spark.read.option("header", True).option("sep", "|").schema("Date string, Symbol string, ShortVolume double, ShortExemptVolume double, TotalVolume double, Market string").csv(path)
    return raw.select(F.to_date("Date", "yyyyMMdd").alias("d"), F.col("Symbol").alias("symbol"), F.col("ShortVolume").alias("short"), F.col("TotalVolume").alias("total")).filter("symbol IS NOT NULL")


def indicator(spark: SparkSession, path: str) -> DataFrame:
    """country, indicator, year, value from JSON lines {country, indicator, date, value}; only positive values."""
    return spark.read.schema("country string, indicator string, date string, value double").json(path).select("country", "indicator", F.col("date").try_cast("int").alias("year"), "value").filter("value > 0 AND year IS NOT NULL")


def rounds(spark: SparkSession, questions: str, resolutions: str) -> tuple[DataFrame, DataFrame]:
    """(questions, resolutions) of a round's two JSON documents. An id is a text or, for combinations, a list: ids holds the list,
    direction the list of signs (null for single questions).

    Documents are read once, as texts: the JSON reader opens a file again, from its beginning, for each list that is read as a text."""
    rows = lambda path, kind, fields: spark.read.text(path, wholetext=True).select(F.inline(F.from_json("value", f"struct<{kind}:array<struct<{fields}>>>")[kind]))
    as_list = lambda c: F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))
    q = rows(questions, "questions", "id:string,source:string,question:string,freeze_datetime_value:string,resolution_dates:string")
    dates = F.when(F.col("resolution_dates").startswith("["), F.from_json("resolution_dates", "array<string>"))
    q = q.select(as_list(F.col("id")).alias("ids"), "source", F.col("question").alias("text"), F.col("freeze_datetime_value").try_cast("double").alias("frozen"), dates.alias("resolution_dates"))
    r = rows(resolutions, "resolutions", "id:string,source:string,direction:string,resolution_date:string,resolved_to:double,resolved:boolean")
    r = r.filter("resolved").select(as_list(F.col("id")).alias("ids"), "source", F.from_json("direction", "array<int>").alias("direction"), F.col("resolution_date").alias("resolves"), F.col("resolved_to").alias("outcome"))
    return q, r


def holdout(spark: SparkSession, path: str) -> DataFrame:
    """id, question, outcome, determined (year) from JSON lines."""
    return spark.read.schema("id string, question string, outcome int, determined int").json(path)


def tickers(spark: SparkSession, path: str) -> DataFrame:
    """ticker (upper case), cik from {"0": {"cik_str": 1, "ticker": "X", "title": "..."}, ...}."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<cik_str:long,ticker:string,title:string>>").alias("m"))
    return raw.select(F.explode("m").alias("k", "r")).groupBy(F.upper("r.ticker").alias("ticker")).agg(F.min("r.cik_str").alias("cik"))


def raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """content_hash, path, length of landed files, whatever they hold."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("content_hash"), "path", "length")


#: The common character references of plain text, and what they stand for.
_MARKS = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "amp": "&"}


def plain_text(page: Column) -> Column:
    """What a page shows, without regard to what is its main text: scripts, styles and comments out, tags as spaces, the common
    character references decoded, white space squeezed. Null for null."""
    for gone in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        page = F.regexp_replace(page, gone, " ")
    for name, mark in _MARKS.items():
        page = F.replace(page, F.lit(f"&{name};"), F.lit(mark))
    return F.trim(F.regexp_replace(page, r"[ \t\n\x0B\f\r]+", " "))
