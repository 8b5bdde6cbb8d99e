"""The streaming forms over the events table, drained, beside the SQL of the batch."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import merkle
from ..sources import domain, harvest
from ..streaming import flows, online
from .catalog import MONTHLY, detect_sql, query


def _events(spark, sf_dir):
    raw = flows.landing(spark, f"{sf_dir}/events.parquet*", domain.table(spark, sf_dir, "events").schema)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


_PLAIN = lambda c: F.date_format(c, "yyyy-MM-dd")


@query("stream_daily_counts", "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, sf_dir):
    """Tumbling counts, the last complete result."""
    got = flows.drain(flows.tumbling_counts(_events(spark, sf_dir)), flows.root(spark), "complete")
    return got.select("event_type", _PLAIN("start").alias("day"), "n")


@query("stream_without_trailing", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts::DATE + 1 <= (SELECT max(ts) FROM events) - INTERVAL 20 DAY GROUP BY ALL")
def stream_without_trailing(spark, sf_dir):
    """Only windows that the watermark has passed are emitted: here all but those of the last 20 days."""
    ev = _events(spark, sf_dir).withWatermark("ts", "20 days")
    days = ev.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")
    return flows.drain(days, flows.root(spark)).select(_PLAIN("start").alias("day"), "n")


@query("stream_sliding_net", "WITH d AS (SELECT unnest(generate_series((SELECT min(ts)::DATE - 6 FROM events), (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::DATE AS start) SELECT strftime(start, '%Y-%m-%d') AS day, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END)::BIGINT AS net, count(*) AS n FROM d JOIN events ON ts >= start AND ts < start + INTERVAL 7 DAY GROUP BY ALL")
def stream_sliding_net(spark, sf_dir):
    """Net of purchases over overlapping weeks."""
    ev = _events(spark, sf_dir).withColumn("sign", flows.signs(F.col("event_type"), "purchase"))
    got = flows.drain(flows.sliding_net(ev, "7 days", "1 day"), flows.root(spark), "complete")
    return got.select(_PLAIN("start").alias("day"), "net", "n")


@query("stream_store", """WITH e AS (SELECT event_type || '|' || user_id % 20 AS series_id, dayofyear(ts) AS x, event_id % 4 AS d, ts, value FROM events),
l AS (SELECT series_id, x, d, arg_max(value, (ts, value)) AS v FROM e GROUP BY ALL),
r AS (SELECT *, lag(v) OVER (PARTITION BY series_id, x ORDER BY d) AS p FROM l)
SELECT series_id, x::INT AS x, arg_max(v, d) AS value, 'u' || min(d) AS unit, count(*) FILTER (WHERE v <> p) AS revisions FROM r GROUP BY series_id, x""")
def stream_store(spark, sf_dir):
    """The revision-logged store under a stream whose files land in four drops, taken in by a run after each: values as they stand, the unit
    of each key's first commit, and how often it was revised."""
    e = domain.table(spark, sf_dir, "events").select(F.concat_ws("|", "event_type", (F.col("user_id") % 20).cast("string")).alias("series_id"), F.dayofyear("ts").alias("x"), "value", F.lit(0.1).alias("uncertainty"), F.concat(F.lit("u"), (F.col("event_id") % 4).cast("string")).alias("unit"), F.col("ts").cast("timestamp").alias("created"))
    where = flows.root(spark)
    kept = flows.Store(spark, f"{where}/store", buckets=8)
    for d in range(4):
        e.filter(F.col("unit") == f"u{d}").write.mode("append").parquet(f"{where}/landed")
        latest, log = kept.run(flows.landing(spark, f"{where}/landed", flows.Store.SCHEMA))
    revised = log.groupBy("series_id", "x").agg(F.count("*").alias("revisions"))
    return latest.join(revised, ["series_id", "x"], "left").select("series_id", "x", "value", "unit", F.coalesce("revisions", F.lit(0)).cast("long").alias("revisions"))


@query("online_verdicts", f"WITH {MONTHLY}, {detect_sql()} SELECT series_id, fired, sustained, dissolving FROM det")
def online_verdicts(spark, sf_dir):
    """The detector as state in a stream. Points land in three drops, out of order; half of the first drop's are wrong and come again
    corrected. Each series' verdict as it stands in the end is the batch detector's."""
    points = domain.monthly(spark, sf_dir).withColumn("seen", F.lit(1))
    wrong = points.filter("x % 6 = 2").withColumn("y", F.col("y") + 100).withColumn("seen", F.lit(0))
    where = flows.root(spark)
    for d in (points.filter("x % 6 = 5").unionByName(wrong), points.filter("x % 3 = 0"), points.filter("x % 3 = 1 OR x % 6 = 2")):
        d.write.mode("append").parquet(f"{where}/landed")
        stream = flows.landing(spark, f"{where}/landed", "series_id string, x int, y double, seen int")
        changes = online.verdict_changes(stream, f"{where}/online", {"series_id": "string"})
    return online.standing(changes, ["series_id"])


_TITLE = r"[^A-Za-z]+"
_HARVEST = """SELECT coalesce(source, 'none') AS "set", doc_id::VARCHAR AS external_id, strftime(DATE '2018-01-01' + (doc_id % 1000)::INT, '%Y-%m-%d') AS datestamp,
  nullif(trim(regexp_replace(substr(text, 1, 200), '[^A-Za-z]+', ' ', 'g')), '') AS title, lang AS categories FROM documents WHERE doc_id % 17 <> 0"""


def landed_pages(docs, path: str, size: int = 100, folder: int = 100) -> None:
    """Writes documents as the answers of a harvest: a set for each source, pages of ids, `folder` pages in a file; the set that comes second
    lost its token after two pages at most and was begun anew."""
    d = docs.select(F.coalesce("source", F.lit("none")).alias("set"), "doc_id", (F.col("doc_id") / size).cast("long").alias("cell"), "lang", F.trim(F.regexp_replace(F.substring("text", 1, 200), _TITLE, " ")).alias("title"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    status = F.when(F.col("doc_id") % 17 == 0, ' status="deleted"').otherwise("")
    day = F.date_format(F.date_add(F.lit("2018-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int")), "yyyy-MM-dd")
    meta = F.concat(tag("id", F.col("doc_id").cast("string")), tag("title", F.coalesce("title", F.lit(""))), tag("categories", F.coalesce("lang", F.lit(""))))
    record = F.concat(F.lit("<record><header"), status, F.lit(">"), tag("datestamp", day), F.lit("</header>"), tag("metadata", tag("arXiv", meta)), F.lit("</record>"))
    pages = d.select("set", "cell", F.struct("doc_id", record.alias("r")).alias("r")).groupBy("set", "cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["r"]), "").alias("records"))
    own = F.row_number().over(Window.partitionBy("set").orderBy("cell"))  # a row for each page
    pages = pages.withColumn("k", own).withColumn("last", F.count("*").over(Window.partitionBy("set"))).drop("cell")
    again = pages.join(F.broadcast(pages.select("set").distinct().orderBy("set").limit(2).orderBy(F.desc("set")).limit(1)), "set", "left_semi")
    token = lambda mark, k: F.when(k > 1, F.concat("set", F.lit(mark), k.cast("string"))).otherwise("")
    lost = F.least(F.lit(2), F.col("last") - 1)
    answer = lambda rows, page, asked, body, after: rows.select("set", page.alias("page"), F.concat(F.lit('<OAI-PMH><request resumptionToken="'), asked, F.lit('"/>'), body, after, F.lit("</OAI-PMH>")).alias("value"))
    after = lambda mark: tag("resumptionToken", F.when(F.col("k") < F.col("last"), token(mark, F.col("k") + 1)).otherwise(""))
    body, k = tag("ListRecords", F.col("records")), F.col("k")
    plain = pages.join(again.select("set").distinct(), "set", "left_anti").unionByName(again.filter(k <= lost))
    failed = again.filter("k = 1")
    every = answer(plain, k, token("-", k), body, after("-")).unionByName(answer(failed, lost + 1, token("-", lost + 1), F.lit('<error code="badResumptionToken"/>'), F.lit("")))
    every = every.unionByName(answer(again, lost + 1 + k, token("-again-", k), body, after("-again-")))
    first = F.col("page") - (F.col("page") - 1) % folder
    files = every.groupBy("set", first.alias("first")).agg(F.array_sort(F.collect_list(F.struct("page", "value"))).alias("rows"))
    files.select("set", F.col("first").alias("page"), F.array_join(F.col("rows")["value"], "\n").alias("value")).write.partitionBy("set", "page").text(path)


@query("harvested_papers", _HARVEST)
def harvested_papers(spark, sf_dir):
    """A paged harvest as a stream that goes on by tokens: what it has in the end, one row for each record."""
    where = flows.root(spark)
    landed_pages(domain.table(spark, sf_dir, "documents"), f"{where}/landed")
    got = harvest.drain(harvest.harvested(spark, f"{where}/landed", pages=20), f"{where}/harvest")
    return harvest.papers(got).select("set", "external_id", "datestamp", "title", "categories")


_ROWS = """r AS (SELECT o_orderkey, sha256(o_orderkey::VARCHAR) AS place, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}') AS h FROM orders)"""


def _orders(spark, sf_dir):
    return domain.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")


@query("seal_tree", f"""WITH {_ROWS},
l3 AS (SELECT substr(place, 1, 6) AS p, count(*) AS n, sha256(string_agg(h, '' ORDER BY place, h)) AS h FROM r GROUP BY 1),
l2 AS (SELECT substr(p, 1, 4) AS q, sum(n) AS n, sha256(string_agg(substr(p, 5, 2) || h, '' ORDER BY p)) AS h FROM l3 GROUP BY 1),
l1 AS (SELECT substr(q, 1, 2) AS s, sum(n) AS n, sha256(string_agg(substr(q, 3, 2) || h, '' ORDER BY q)) AS h FROM l2 GROUP BY 1)
SELECT sum(n)::BIGINT AS n, sha256(string_agg(s || h, '' ORDER BY s)) AS seal FROM l1""")
def seal_tree(spark, sf_dir):
    """The root of a table's hash tree."""
    return merkle.seal(merkle.tree(_orders(spark, sf_dir), "o_orderkey", flows.cut))


@query("seal_proofs", "SELECT o_orderkey, 4 AS steps, true AS proves FROM orders WHERE o_orderkey % 50 = 0")
def seal_proofs(spark, sf_dir):
    """Rows shown to be in the sealed table, each by the hashes beside its path."""
    o = _orders(spark, sf_dir)
    nodes = merkle.tree(o, "o_orderkey", flows.cut)
    got = merkle.proofs(o, "o_orderkey", nodes, o.filter("o_orderkey % 50 = 0"))
    return got.crossJoin(F.broadcast(merkle.seal(nodes))).select("o_orderkey", F.size("path").alias("steps"), (merkle.proven(got) == F.col("seal")).alias("proves"))


@query("seal_difference", """SELECT o_orderkey, 'removed' AS change FROM orders WHERE o_orderkey % 101 = 0
UNION ALL SELECT o_orderkey, 'changed' FROM orders WHERE o_orderkey % 101 <> 0 AND o_orderkey % 37 = 0
UNION ALL SELECT o_orderkey + 1000000000, 'added' FROM orders WHERE o_orderkey % 211 = 0""")
def seal_difference(spark, sf_dir):
    """What changed between two versions of a table, found by the branches in which their hash trees differ."""
    old = _orders(spark, sf_dir)
    moved = F.when(F.col("o_orderkey") % 37 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    new = old.filter("o_orderkey % 101 <> 0").withColumn("o_custkey", moved).unionByName(old.filter("o_orderkey % 211 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 1000000000))
    leaves = merkle.differing(*(merkle.tree(t, "o_orderkey", flows.cut) for t in (old, new)), flows.cut)
    return merkle.changes(old, new, "o_orderkey", leaves)
