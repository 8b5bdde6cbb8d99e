"""Mining of dated texts: terms per month, grounding of quotes and numbers, excerpts, paper updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import occurrences


def category_series(papers: DataFrame, min_papers: int = 300, min_years: int = 8) -> DataFrame:
    """category, year, n, sigma (root of n) of the categories with enough papers in enough years, stamped at the first of December."""
    per = papers.filter("category IS NOT NULL AND month IS NOT NULL").groupBy("category", F.substring("month", 1, 4).cast("int").alias("year")).agg(F.count("*").alias("n")).filter("year BETWEEN 1995 AND 2025")
    enough = per.groupBy("category").agg(F.sum("n").alias("all"), F.count("*").alias("years")).filter((F.col("all") >= min_papers) & (F.col("years") >= min_years)).select("category")
    return per.join(enough, "category", "left_semi").select("category", "year", "n", F.sqrt(F.greatest("n", F.lit(1))).alias("sigma"), F.make_date("year", F.lit(12), F.lit(1)).alias("as_of"))


def term_signals(papers: DataFrame, terms: DataFrame, current: str, since: str = "2010-01", drop: int = 2) -> DataFrame:
    """term, month, matched, total, share, se, breadth (distinct categories), talent (distinct authors) for whole-word matches of each
    term (terms: term) in the months before the current one, less the last `drop` of the timeline.

    A text is read once, however many terms there are, and only matches come out; distinct counts are exact."""
    dated = papers.filter(F.col("month").between(since, current) & (F.col("month") < current))
    totals = dated.groupBy("month").agg(F.count("*").alias("total"))
    newest = Window.orderBy(F.desc("month"))  # a row for each month
    kept = totals.withColumn("age", F.row_number().over(newest)).filter(F.col("age") > drop).drop("age")
    texts = dated.select("month", F.coalesce("category", F.lit("?")).alias("category"), "authors", "text")
    found = occurrences(texts, "text", terms, "term")
    matched = found.groupBy("term", "month").agg(F.count("*").alias("matched"), F.count_distinct("category").alias("breadth"))
    people = found.select("term", "month", F.explode(F.split("authors", ";")).alias("a")).select("term", "month", F.trim("a").alias("a")).filter("a <> ''").groupBy("term", "month").agg(F.count_distinct("a").alias("talent"))
    df = matched.join(kept, "month").join(people, ["term", "month"], "left")
    p = F.col("matched") / F.col("total")
    return df.select("term", "month", "matched", "total", p.alias("share"), F.greatest(F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) / F.col("total")), F.lit(1e-6)).alias("se"), "breadth", F.coalesce("talent", F.lit(0)).alias("talent"))


def trailing_distinct(rows: DataFrame, cut, width: int = 12) -> DataFrame:
    """term, month, n: of rows (term, month as yyyy-MM, who) how many different ones there are in the `width` months up to and with each
    month that the term has. Exact: whoever there is gets a number, a month's are bits of a few words of 32768, and a window is the
    union of its months' words, so nobody is counted or moved again for each window. cut(frame) writes a frame and reads it again:
    the numbers must not change."""
    known = rows.filter("term IS NOT NULL AND month IS NOT NULL AND who IS NOT NULL")
    numbered = cut(known.select("who").distinct().withColumn("number", F.monotonically_increasing_id()))
    index = (F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int") - 1).alias("at")
    bits = known.select("term", index, "who").join(numbered, "who").groupBy("term", "at", F.bitmap_bucket_number("number").alias("word")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
    bits = cut(bits)
    months = bits.select("term", "at").distinct()
    spread = bits.withColumn("at", F.explode(F.sequence(F.col("at"), F.col("at") + width - 1))).join(months, ["term", "at"], "left_semi")
    whole = spread.groupBy("term", "at", "word").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    month = F.concat(F.floor(F.col("at") / 12).cast("string"), F.lit("-"), F.lpad((F.col("at") % 12 + 1).cast("string"), 2, "0"))
    return whole.groupBy("term", "at").agg(F.sum("n").alias("n")).select("term", month.alias("month"), "n")


def squeezed(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def grounded(claims: DataFrame, sure: float = 0.80) -> DataFrame:
    """claims (text, span, confidence) with found (the quote is in the text, white space and case aside) and tier."""
    found = (F.trim(F.coalesce("span", F.lit(""))) != "") & F.contains(squeezed(F.col("text")), squeezed(F.col("span")))
    return claims.withColumn("found", found).withColumn("tier", F.when((F.col("confidence") >= sure) & F.col("found"), "high").otherwise("low"))


def alnum(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def number_grounded(answers: DataFrame) -> DataFrame:
    """answers (value, evidence) with grounded: the value's letters and digits stand in the evidence's, and it has a digit."""
    v = alnum(F.col("value"))
    return answers.withColumn("grounded", v.rlike("[0-9]") & F.contains(alnum(F.col("evidence")), v))


def excerpt_lines(texts: DataFrame, key: str, terms: list[str], budget: int = 4500) -> DataFrame:
    """key, line, text of the lines to show: lines score a point for each term in them and a half for a digit; the best come
    first, each with its neighbours, until the budget of characters is used up (the line that passes it is still shown).

    A window per text; a text's lines are its own group."""
    lines = texts.select(key, F.posexplode(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\r\n|[\n\r]"), lambda s: F.trim(s)), lambda s: s != "")).alias("line", "own"))
    low = F.lower("own")
    score = sum((F.contains(low, F.lit(t)).cast("double") for t in terms), F.lit(0.0)) + F.when(F.col("own").rlike("[0-9]"), 0.5).otherwise(0.0)
    scored = lines.withColumn("score", score)
    w = Window.partitionBy(key)
    top = scored.filter("score > 0").withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), F.desc("line")))).select(key, "place", F.explode(F.array(F.col("line") - 1, F.col("line"), F.col("line") + 1)).alias("line"))
    # A line belongs to the best scorer that reaches it.
    first = top.groupBy(key, "line").agg(F.min("place").alias("place")).join(scored.select(key, "line", "own"), [key, "line"])
    spent = F.sum(F.length("own") + 1).over(w.orderBy("place").rangeBetween(Window.unboundedPreceding, -1))
    return first.withColumn("before", F.coalesce(spent, F.lit(0))).filter(F.col("before") <= budget).select(key, "line", F.col("own").alias("text"))


def upsert_papers(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """By provider and id: what exists keeps its first submission and author fields; updated, categories and abstract are revised."""
    key, revised = ["provider", "external_id"], ["updated", "categories", "abstract"]
    cols = [c for c in current.columns if c not in key]
    new = incoming.select(*key, F.struct(*cols).alias("new"))
    both = current.select(*key, F.struct(*cols).alias("old")).join(new, key, "full_outer")
    pick = [F.when(F.col("old").isNull() | (F.col("new").isNotNull() & F.lit(c in revised)), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in cols]
    return both.select(*key, *pick)
