"""Corpus mining, audits and discovery as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mining
from ..sources import domain
from ..streaming.flows import cut
from .catalog import MONTHLY, PAPERS, med, query

_LAST, _MIN = "2021-12", 3


_STOPPED = ", ".join(f"'{w}'" for w in mining.STOP)


@query("corpus_emergence", f"""WITH {PAPERS}, p AS (SELECT month, list_filter(regexp_extract_all(lower(text), '[a-z][a-z][a-z\\-]+'), lambda w: w NOT IN ({_STOPPED})) AS w FROM papers WHERE month <= '{_LAST}'),
t AS (SELECT month, count(*) AS total, row_number() OVER (ORDER BY month DESC) - 1 AS age FROM p GROUP BY month),
u AS (SELECT month, unnest(list_distinct(list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS term FROM p),
f AS (SELECT term FROM u WHERE month > '2020-06' GROUP BY term HAVING count(*) >= {_MIN}),
c AS (SELECT term, age // 12 AS win, count(*) AS c, any_value(total) AS total FROM u JOIN f USING (term) JOIN t USING (month) WHERE age < 36 GROUP BY term, month, age),
z AS (SELECT term, sum(c) FILTER (WHERE win = 0) AS n, coalesce(sum(c / total) FILTER (WHERE win = 0), 0) / 12 AS recent, coalesce(sum(c / total) FILTER (WHERE win = 1), 0) / 12 AS prior, coalesce(sum(c / total) FILTER (WHERE win = 2), 0) / 12 AS older FROM c GROUP BY term),
k AS (SELECT term, n::BIGINT AS n, recent, prior, round(ln((recent + 1e-5::DOUBLE) / (prior + 1e-5::DOUBLE)) * ln(1 + n), 6) AS score FROM z WHERE n >= {_MIN} AND recent - prior > 1e-12::DOUBLE AND (recent - prior) - (prior - older) >= -1e-12::DOUBLE AND recent <= 0.03::DOUBLE)
SELECT term, n, round(recent, 9) AS recent, round(prior, 9) AS prior, score FROM k ORDER BY score DESC, term LIMIT 40""")
def corpus_emergence(spark, sf_dir):
    """Phrases of two and three content words whose share of the corpus rises; `min_docs` is 3, as the corpus is small."""
    got = mining.emerging(domain.papers(spark, sf_dir), _LAST, _MIN, cut=cut)
    return got.withColumns({c: F.round(c, 9) for c in ("recent", "prior")})


@query("field_diffusion", f"WITH {PAPERS}, c AS (SELECT lang, month, category, count(*) AS c FROM papers WHERE category IS NOT NULL GROUP BY ALL) SELECT lang, month, sum(c)::BIGINT AS n, round(pow(sum(c)::DOUBLE, 2) / sum(c::DOUBLE * c), 6) AS breadth FROM c GROUP BY ALL")
def field_diffusion(spark, sf_dir):
    return mining.diffusion(domain.papers(spark, sf_dir), ["lang", "month"], "category").withColumn("breadth", F.round("breadth", 6))


@query("category_counts", f"WITH {PAPERS} SELECT category, substr(month, 1, 4) AS year, count(*) AS n, round(sqrt(count(*)), 6) AS sigma FROM papers GROUP BY ALL")
def category_counts(spark, sf_dir):
    g = domain.papers(spark, sf_dir).groupBy("category", F.substring("month", 1, 4).alias("year")).agg(F.count("*").alias("n"))
    return g.withColumn("sigma", F.round(F.sqrt("n"), 6))


@query("quality_completeness", f"""WITH {MONTHLY}, g AS (SELECT series_id, x, x - lag(x) OVER (PARTITION BY series_id ORDER BY x) - 1 AS gap FROM pts),
a AS (SELECT series_id, max(x) - min(x) + 1 AS span, count(*) AS n, coalesce(max(gap), 0) AS longest_gap FROM g GROUP BY ALL)
SELECT series_id, (span - n)::BIGINT AS missing, longest_gap::BIGINT AS longest_gap, CASE WHEN (span - n) / span > 0.2 OR longest_gap >= 3 THEN 'fail' WHEN span > n THEN 'warn' ELSE 'ok' END AS status FROM a""")
def quality_completeness(spark, sf_dir):
    got = mining.completeness(domain.monthly(spark, sf_dir), ["series_id"])
    return got.withColumns({c: F.col(c).cast("long") for c in ("missing", "longest_gap")})


@query("quality_validity", f"""WITH {MONTHLY}, p AS (SELECT series_id, list(y) AS ys, list(y) FILTER (WHERE y > 0) AS plus FROM pts GROUP BY ALL),
m AS (SELECT *, CASE WHEN len(plus) >= 5 THEN {med("plus")} END AS mid FROM p),
c AS (SELECT series_id, len(list_filter(ys, lambda v: v < 0)) AS negative, len(list_filter(plus, lambda v: v > mid * 10 OR v < mid / 10)) AS outliers FROM m)
SELECT series_id, negative::INT AS negative, outliers::INT AS outliers, CASE WHEN negative > 0 THEN 'fail' WHEN outliers > 0 THEN 'warn' ELSE 'ok' END AS status FROM c""")
def quality_validity(spark, sf_dir):
    return mining.validity(domain.monthly(spark, sf_dir), ["series_id"], 10.0)
