"""Where named queries register: a function of (spark, sf_dir) and, where SQL says the same, that SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers the decorated function under the name."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def med(values: str) -> str:
    """DuckDB: median of a list, the mean of the middle two."""
    return f"((list_sort({values})[(len({values}) + 1) // 2] + list_sort({values})[len({values}) // 2 + 1]) / 2)"


MONTHLY = """pts AS (
  SELECT p_brand || '|' || p_type AS series_id, (year(l_shipdate) * 12 + month(l_shipdate))::DOUBLE AS x, sum(l_quantity) AS y
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
BRANDS = MONTHLY.replace("p_brand || '|' || p_type", "p_brand")
QUARTERLY = """yr AS (
  SELECT p_brand || '|' || p_type AS series_id, p_type AS cohort, year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS x, sum(l_quantity) AS y
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
DAILY = """day AS (
  SELECT event_type, ts::DATE AS day, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL)"""
PAPERS = """papers AS (
  SELECT doc_id, strftime(DATE '2018-01-01' + to_months((doc_id % 48)::INT), '%Y-%m') AS month, source AS category, lang, text FROM documents)"""
RATED = """rated AS (
  SELECT doc_id, source, round(1.0::DOUBLE - 1.0::DOUBLE / (1.0::DOUBLE + n_chars / 800.0::DOUBLE), 6) AS p, quality AS outcome, toxic AS second
  FROM labels JOIN documents USING (doc_id))"""


def detect_sql(pts: str = "pts", key: str = "series_id", k: float = 3.0) -> str:
    """CTEs of the detector over (key, x, y); the last, det, has its verdicts."""
    return f"""
cnt AS (SELECT {key}, count(*) AS n, greatest(2, round_even(0.3::DOUBLE * count(*), 0))::INT AS holdout FROM {pts} GROUP BY ALL),
r AS (SELECT {", ".join("p." + c.strip() for c in key.split(","))}, p.x, p.y, n, holdout, n - holdout AS split, row_number() OVER (PARTITION BY {", ".join("p." + c.strip() for c in key.split(","))} ORDER BY x) AS rn
      FROM {pts} p JOIN cnt USING ({key}) WHERE n >= 8 AND n - holdout >= 4),
sl AS (SELECT {", ".join("a." + c.strip() for c in key.split(","))}, list((b.y - a.y) / (b.x - a.x)) AS s FROM r a JOIN r b USING ({key}) WHERE a.rn < b.rn AND b.rn <= b.split AND a.x <> b.x GROUP BY ALL),
sl2 AS (SELECT {key}, {med("s")} AS slope FROM sl),
ic AS (SELECT {key}, slope, list(y - slope * x) AS c FROM r JOIN sl2 USING ({key}) WHERE rn <= split GROUP BY ALL),
ic2 AS (SELECT {key}, slope, {med("c")} AS intercept FROM ic),
e AS (SELECT r.*, slope, intercept, y - (slope * x + intercept) AS e FROM r JOIN ic2 USING ({key})),
m AS (SELECT {key}, list(e) AS es, list(y) AS ys, stddev_pop(e) AS sd FROM e WHERE rn <= split GROUP BY ALL),
m2 AS (SELECT {key}, es, sd, {med("es")} AS mid, list_max(ys) - list_min(ys) AS span, abs({med("ys")}) AS level FROM m),
sg AS (SELECT {key}, 1.4826::DOUBLE * {med("list_transform(es, lambda v: abs(v - mid))")} AS mad, sd, greatest(span, level) AS scale FROM m2),
sg2 AS (SELECT {key}, CASE WHEN mad > 0 THEN mad ELSE greatest(sd, scale * 0.05::DOUBLE, 1e-9) END AS sigma FROM sg),
s AS (SELECT e.*, sigma, e / sigma AS s FROM e JOIN sg2 USING ({key}) WHERE rn > split),
runs AS (SELECT *, rn - row_number() OVER (PARTITION BY {key}, s > 0 ORDER BY rn) AS gu, rn - row_number() OVER (PARTITION BY {key}, s < 0 ORDER BY rn) AS gd FROM s),
upr AS (SELECT {key}, max(c) AS n_up FROM (SELECT {key}, gu, count(*) AS c FROM runs WHERE s > 0 GROUP BY ALL) GROUP BY ALL),
dnr AS (SELECT {key}, max(c) AS n_dn FROM (SELECT {key}, gd, count(*) AS c FROM runs WHERE s < 0 GROUP BY ALL) GROUP BY ALL),
det0 AS (SELECT {key}, n, split, holdout, slope, intercept, sigma, least(max(s), 1e6) AS surprise, least(greatest(0.0::DOUBLE, -min(s)), 1e6) AS down, avg(s) AS mean_s FROM s GROUP BY ALL),
det AS MATERIALIZED (SELECT {key}, n, split, slope, intercept, sigma, surprise, surprise >= {k} AS fired, least(mean_s, 1e6) AS sustained_sigma,
  coalesce(n_up, 0) AS n_consecutive, coalesce(n_up, 0) >= greatest(2, ceil(holdout / 2)) AS sustained, down AS down_surprise,
  coalesce(n_dn, 0) AS n_consecutive_down, down >= {k} AND coalesce(n_dn, 0) >= greatest(2, ceil(holdout / 2)) AS dissolving
  FROM det0 LEFT JOIN upr USING ({key}) LEFT JOIN dnr USING ({key}))"""
