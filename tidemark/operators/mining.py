"""Emerging phrases, diffusion over fields, audits of series, and leading against lagging evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import let, median_of

#: Words that carry no subject.
STOP = (
    "the a an of to in on for and or with by as at from is are be been this that these those we our it its their can may such than then thus also however which where when while into via using used use based show shows shown "
    "present presented propose proposed proposes paper study studies result results method methods approach approaches framework algorithm algorithms performance experiment experiments experimental dataset datasets task tasks "
    "problem problems novel new two three one first second high low large small given work analysis between over under more most many both each all any some non well good better best different various several recent recently "
    "general specific important significant significantly obtain obtained achieve achieved achieves improve improved improves able find found consider considered provide provides provided called etc respectively namely due order "
    "terms case cases set sets number value values function functions system systems data time space state report observation observations broad wide bridge baseline langle rangle mathcal mathbb mathbf mathrm textit textbf left "
    "right begin end let denote denotes respect leq geq cdot ldots"
).split()
#: Smoothing of shares, greatest recent share of an emerging phrase, phrases reported.
EPS, COMMON, TOP = 1e-5, 0.03, 40
#: Bits that hold the hashes of candidates, a row for each 64 with any (about 20 MB in each task's memory at most).
BITS = 1 << 25


def content_words(text: Column, stop: list[str] = STOP) -> Column:
    """Words of three or more letters (hyphens inside count), lower-cased, without the stop words; null for a null text."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z][a-z\-]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*stop))


def phrases(text: Column) -> Column:
    """Distinct neighbours of two and of three content words of a text; null for a null text."""

    def of(w: Column) -> Column:
        pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        triples = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda a, i: F.concat_ws(" ", a, F.element_at(w, i + 2), F.element_at(w, i + 3)))
        return F.array_distinct(F.concat(pairs, triples))

    return let(content_words(text), of)


def emerging(papers: DataFrame, last: str, min_docs: int = 40, top: int = TOP, window: int = 12, recent_months: int = 18, cut=lambda d: d) -> DataFrame:
    """term, n (papers of the newest `window` months), recent and prior share, score of the phrases whose share rises and does not
    slow. A share is the mean of the monthly shares of a window; the windows are the newest, second and third `window` months that
    have papers, up to and with `last` (yyyy-MM).

    A text is split once: a paper adds one over its month's papers to the share of its window. The newest window's papers are added up
    first, since a phrase must be in `min_docs` of them; of the other papers only phrases whose hash is one of those phrases' are moved
    (BITS bits, so a few others are too, which the join drops). No cap on candidates. cut(frame) writes a frame and reads it again, so that
    the newest papers are not split twice."""
    dated = papers.filter(F.col("month") <= last)
    # A row for each month.
    totals = dated.groupBy("month").agg(F.count("*").alias("total")).withColumn("age", F.row_number().over(Window.orderBy(F.desc("month"))) - 1)
    low = F.date_format(F.add_months(F.to_date(F.lit(f"{last}-01")), 1 - recent_months), "yyyy-MM")
    sizes = totals.agg(*(F.count_if((F.col("age") >= i * window) & (F.col("age") < (i + 1) * window)).alias(f"m{i}") for i in range(3)))
    part = totals.select("month", (F.lit(1.0) / F.col("total")).alias("part"), F.floor(F.col("age") / window).cast("int").alias("win"))
    placed = dated.join(F.broadcast(part), "month").withColumn("late", F.col("month") >= low)
    split = lambda rows: rows.select("win", "part", "late", F.explode(phrases(F.col("text"))).alias("term"))
    newest = cut(split(placed.filter("win = 0")).groupBy("term").agg(F.count("*").alias("n"), F.count_if("late").alias("seen"), F.sum("part").alias("s0")).filter(F.col("n") >= min_docs))
    word, bit = lambda h: F.shiftright(h, 6), lambda h: h.bitwiseAND(F.lit(63)).cast("int")
    h = F.xxhash64("term").bitwiseAND(F.lit(BITS - 1))
    marks = newest.select(h.alias("h")).groupBy(word(F.col("h")).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("h")))).alias("bits"))
    others = split(placed.filter((F.col("win") > 0) & ((F.col("win") < 3) | F.col("late")))).withColumn("word", word(h)).join(F.broadcast(marks), "word").filter(F.getbit("bits", bit(h)) == 1)
    of = lambda i: F.sum(F.when(F.col("win") == i, F.col("part")).otherwise(0)).alias(f"s{i}")
    rest = others.groupBy("term").agg(F.count_if("late").alias("more"), of(1), of(2))
    g = newest.join(rest, "term", "left").withColumn("seen", F.col("seen") + F.coalesce("more", F.lit(0))).fillna(0.0, ["s1", "s2"])
    df = g.filter(F.col("seen") >= min_docs).join(F.broadcast(sizes))  # one row
    df = df.select("term", "n", *((F.col(f"s{i}") / F.greatest(F.col(f"m{i}"), F.lit(1))).alias(name) for i, name in enumerate(("recent", "prior", "older"))))
    rise = F.col("recent") - F.col("prior")
    df = df.filter((rise > 1e-12) & (rise - (F.col("prior") - F.col("older")) >= -1e-12) & (F.col("recent") <= COMMON))
    score = F.round(F.log((F.col("recent") + EPS) / (F.col("prior") + EPS)) * F.log1p(F.col("n")), 6)
    return df.select("term", "n", "recent", "prior", score.alias("score")).orderBy(F.desc("score"), "term").limit(top)


def diffusion(df: DataFrame, by: list[str], field: str) -> DataFrame:
    """by, n, breadth: inverse Simpson index of the shares of fields (their effective number)."""
    per = df.filter(F.col(field).isNotNull()).groupBy(*by, field).agg(F.count("*").alias("c"))
    return per.groupBy(*by).agg(F.sum("c").alias("n"), (F.pow(F.sum("c").cast("double"), 2) / F.sum(F.col("c").cast("double") * F.col("c"))).alias("breadth"))


def completeness(points: DataFrame, key: list[str]) -> DataFrame:
    """key, missing, longest_gap, status: steps of 1 missing between first and last x; fail beyond a fifth of them or a gap of three."""
    before = F.lag("x").over(Window.partitionBy(*key).orderBy("x"))
    g = points.withColumn("gap", F.col("x") - before - 1).groupBy(*key).agg((F.max("x") - F.min("x") + 1).alias("span"), F.count("*").alias("n"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"))
    missing = F.col("span") - F.col("n")
    status = F.when((missing / F.col("span") > 0.2) | (F.col("longest_gap") >= 3), "fail").when(missing > 0, "warn").otherwise("ok")
    return g.select(*key, missing.alias("missing"), "longest_gap", status.alias("status"))


def validity(points: DataFrame, key: list[str], factor: float = 100.0) -> DataFrame:
    """key, negative, outliers, status: values below 0, and values `factor` times above or below the median of the positive ones (of
    five at least)."""
    g = points.groupBy(*key).agg(F.collect_list("y").alias("ys")).withColumn("plus", F.filter("ys", lambda y: y > 0))
    g = g.withColumn("mid", F.when(F.size("plus") >= 5, median_of(F.col("plus"))))
    out = F.size(F.filter("plus", lambda y: (y > F.col("mid") * factor) | (y < F.col("mid") / factor)))
    g = g.select(*key, F.size(F.filter("ys", lambda y: y < 0)).alias("negative"), out.alias("outliers"))
    return g.withColumn("status", F.when(F.col("negative") > 0, "fail").when(F.col("outliers") > 0, "warn").otherwise("ok"))
