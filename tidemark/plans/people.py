"""Entities, hypotheses, drivers, decisions and corpus terms as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus, entities, matching
from ..sources import domain
from ..streaming.flows import cut
from .catalog import PAPERS, query

_STOP = ", ".join(f"'{w}'" for w in entities.STOP)
_TOKENS = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: len(w) > 1 AND w NOT IN ({_STOP})))"
_ENT = f"""ent AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS entity, split_part(p_name, ' ', 1) || ' goods' AS name, [split_part(p_name, ' ', 1) || ' ' || 'ring'] AS aliases FROM part),
ser AS (SELECT DISTINCT p_name || '|' || p_type AS series_id, p_name || ' ' || p_type AS label FROM part),
lk AS (SELECT series_id FROM ser WHERE series_id LIKE 'red%'),
idx AS (SELECT entity, list_distinct([lower(name), lower(aliases[1])]) AS surfaces, list_distinct(list_concat({_TOKENS("name")}, {_TOKENS("aliases[1]")})) AS words FROM ent),
op AS (SELECT series_id, lower(label) AS norm, {_TOKENS("label")} AS own FROM ser WHERE series_id NOT IN (SELECT series_id FROM lk)),
pr AS (SELECT entity, series_id, len(list_filter(surfaces, lambda s: contains(norm, s) OR contains(s, norm))) > 0 AS exact, len(list_intersect(own, words)) / len(list_distinct(list_concat(own, words)))::DOUBLE AS jac FROM op, idx WHERE len(own) > 0),
cand AS (SELECT entity, series_id, CASE WHEN exact THEN 'exact_id' WHEN jac >= 0.5 THEN 'string_block' END AS generator, CASE WHEN exact THEN 0.9::DOUBLE ELSE round_even(least(0.6::DOUBLE, jac), 2) END AS confidence FROM pr WHERE exact OR jac >= 0.5),
open AS (SELECT * FROM cand WHERE NOT (generator = 'string_block' AND entity = 'old'))"""


def _parts(spark, sf_dir):
    return domain.table(spark, sf_dir, "part")


def _candidates(spark, sf_dir):
    p = _parts(spark, sf_dir)
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    ent = p.select(first.alias("entity")).distinct().select("entity", F.concat("entity", F.lit(" goods")).alias("name"), F.array(F.concat("entity", F.lit(" ring"))).alias("aliases"))
    ser = p.select(F.concat_ws("|", "p_name", "p_type").alias("series_id"), F.concat_ws(" ", "p_name", "p_type").alias("label")).distinct()
    seen = ser.select(F.lit("old").alias("entity"), "series_id", F.lit("string_block").alias("generator"))
    return entities.candidates(ser, ent, ser.filter(F.col("series_id").startswith("red")), seen)


@query("entity_candidates", f"WITH {_ENT} SELECT * FROM open")
def entity_candidates(spark, sf_dir):
    """Links proposed for series that have none."""
    return _candidates(spark, sf_dir)


_DECIDED = f"{_ENT}, de AS (SELECT *, CASE hash_of % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'proposed' END AS status FROM (SELECT *, length(series_id) AS hash_of FROM open))"


def _decided(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    n = F.length("series_id") % 3
    said = c.filter(n < 2).select("entity", "series_id", F.when(n == 0, "accepted").otherwise("rejected").alias("status"), F.lit(1).alias("at"))
    return entities.decided(c, said)


@query("candidate_decisions", f"WITH {_DECIDED} SELECT status, generator, count(*) AS n FROM de GROUP BY ALL")
def candidate_decisions(spark, sf_dir):
    return _decided(spark, sf_dir)[0].groupBy("status", "generator").agg(F.count("*").alias("n"))


@query("entities_board", f"WITH {_DECIDED}, l AS (SELECT entity, series_id, max(confidence) AS confidence, split_part(series_id, '|', 2) AS pillar FROM de WHERE status = 'accepted' GROUP BY ALL) SELECT entity, count(*) AS links, count(DISTINCT pillar) AS pillars, array_to_string(list_sort(list(DISTINCT pillar)), ',') AS named FROM l GROUP BY ALL")
def entities_board(spark, sf_dir):
    """Entities with their links, those that reach over most pillars first."""
    l = _decided(spark, sf_dir)[1].withColumn("pillar", F.split_part("series_id", F.lit("|"), F.lit(2)))
    g = l.groupBy("entity").agg(F.count("*").alias("links"), F.count_distinct("pillar").alias("pillars"), F.array_join(F.sort_array(F.collect_set("pillar")), ",").alias("named"))
    return g.orderBy(F.desc("pillars"), F.desc("links"), "entity")


@query("entity_spans", "WITH l AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS entity, p_name AS series_id, p_type AS pillar FROM part) SELECT entity, count(DISTINCT series_id) AS n_series, array_to_string(list_sort(list(DISTINCT pillar)), ',') AS pillars FROM l GROUP BY ALL HAVING count(DISTINCT pillar) > 1")
def entity_spans(spark, sf_dir):
    l = _parts(spark, sf_dir).select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("entity"), F.col("p_name").alias("series_id"), F.col("p_type").alias("pillar"))
    return entities.spans(l).withColumn("pillars", F.array_join("pillars", ","))


@query("entity_edges_board", "WITH e AS (SELECT DISTINCT n_regionkey AS src, n_nationkey AS dst FROM nation) SELECT r_name AS src, n_name AS dst, 'supplies' AS rel, round(1.0::DOUBLE / (1 + dst), 6) AS confidence FROM e JOIN region ON r_regionkey = src JOIN nation ON n_nationkey = dst")
def entity_edges_board(spark, sf_dir):
    """Edges between entities by their names: the names join twice."""
    n, r = domain.table(spark, sf_dir, "nation"), domain.table(spark, sf_dir, "region")
    e = n.select(F.col("n_regionkey").alias("s"), F.col("n_nationkey").alias("d")).distinct()
    j = e.join(r, F.col("s") == F.col("r_regionkey")).join(n, F.col("d") == F.col("n_nationkey"))
    return j.select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"), F.lit("supplies").alias("rel"), F.round(F.lit(1.0) / (1 + F.col("d")), 6).alias("confidence")).orderBy(F.desc("confidence"), "src")


@query("label_taxonomy", r"""WITH l AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE replace(p_name, ' ', '-') || ' (topic share)' END AS label FROM part),
c AS (SELECT label, trim(regexp_replace(replace(regexp_replace(lower(label), '\s*\((topic share|talent inflow)\)\s*$', ''), '-', ' '), '\s+', ' ', 'g')) AS core, length(regexp_replace(label, '[^A-Z]', '', 'g')) AS caps FROM l),
f AS (SELECT label, caps, CASE core WHEN 'small ring' THEN 'tiny ring' ELSE core END AS core FROM c)
SELECT core, arg_min(label, struct_pack(a := -caps, b := label)) AS display, CASE WHEN regexp_matches(core, 'ring|gear') THEN 'round' WHEN regexp_matches(core, 'bolt') THEN 'fastener' ELSE 'other' END AS domain, count(*) AS n FROM f GROUP BY ALL""")
def label_taxonomy(spark, sf_dir):
    """Labels of channels folded onto their entity, with its best surface and domain."""
    even = F.col("p_size") % 2 == 0
    l = _parts(spark, sf_dir).select(F.when(even, F.upper("p_name")).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(" (topic share)"))).alias("label")).distinct()
    return entities.taxonomy(l, {"small ring": "tiny ring"}, {"round": "ring|gear", "fastener": "bolt"}, ("topic share", "talent inflow"))


_HYP = """hyp AS (SELECT c_custkey AS hypothesis, 'h' || c_custkey AS title, CASE WHEN c_custkey % 17 = 0 THEN 'promoted' END AS status, c_custkey % 5 = 0 AS refuted, c_custkey % 3 <> 0 AS measurable, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE 'falls' END AS kill, CASE WHEN c_custkey % 7 <> 0 THEN 0.3 END AS base_rate, CASE WHEN c_custkey % 6 <> 0 THEN 2030 END AS horizon FROM customer),
votes AS (SELECT o_custkey AS hypothesis, o_orderkey % 2 = 0 AS against FROM orders)"""
_GATE = "CASE WHEN status = 'promoted' THEN 'promoted' WHEN {r} THEN 'killed' WHEN measurable AND trim(kill) <> '' AND base_rate IS NOT NULL AND horizon IS NOT NULL THEN 'survived' ELSE 'parked' END"


def hypotheses(spark, sf_dir):
    k = F.col("c_custkey")
    return domain.table(spark, sf_dir, "customer").select(k.alias("hypothesis"), F.concat(F.lit("h"), k).alias("title"), F.when(k % 17 == 0, "promoted").alias("status"), (k % 5 == 0).alias("refuted"), (k % 3 != 0).alias("measurable"), F.array(F.when(k % 4 == 0, " ").otherwise("falls")).alias("kills"), F.when(k % 7 != 0, 0.3).alias("base_rate"), F.when(k % 6 != 0, 2030).alias("horizon"))


@query("hypothesis_gate", f"WITH {_HYP} SELECT hypothesis, {_GATE.format(r='refuted')} AS status FROM hyp")
def hypothesis_gate(spark, sf_dir):
    c = F.col
    return hypotheses(spark, sf_dir).select("hypothesis", entities.gate(c("status"), c("refuted"), c("measurable"), c("kills"), c("base_rate"), c("horizon")).alias("status"))


@query("skeptic_panel", f"WITH {_HYP}, v AS (SELECT hypothesis, count(*) AS n, count(*) FILTER (WHERE against) AS r FROM votes GROUP BY ALL), p AS (SELECT hyp.*, n, r, CASE WHEN n IS NOT NULL AND status IS DISTINCT FROM 'promoted' THEN r * 2 > n ELSE refuted END AS ref FROM hyp LEFT JOIN v USING (hypothesis)) SELECT hypothesis, n AS n_skeptics, r AS n_refute, ref AS refuted, {_GATE.format(r='ref')} AS status FROM p")
def skeptic_panel(spark, sf_dir):
    votes = domain.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("hypothesis"), (F.col("o_orderkey") % 2 == 0).alias("against"))
    return entities.panel(hypotheses(spark, sf_dir), votes).select("hypothesis", "n_skeptics", "n_refute", "refuted", "status")


@query("hypotheses_board", f"WITH {_HYP}, g AS (SELECT {_GATE.format(r='refuted')} AS status FROM hyp) SELECT status, count(*) AS n, CASE status WHEN 'promoted' THEN 0 WHEN 'survived' THEN 1 WHEN 'parked' THEN 2 ELSE 3 END AS place FROM g GROUP BY ALL")
def hypotheses_board(spark, sf_dir):
    place = F.when(F.col("status") == "promoted", 0).when(F.col("status") == "survived", 1).when(F.col("status") == "parked", 2).otherwise(3)
    return hypothesis_gate(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n")).withColumn("place", place).orderBy("place")


@query("hypothesis_upsert", f"WITH {_HYP}, inc AS (SELECT title, 'survived' AS status, 0.9::DOUBLE AS base_rate FROM hyp WHERE hypothesis % 2 = 0 UNION ALL SELECT 'new', 'parked', 0.1) SELECT coalesce(h.title, i.title) AS title, CASE WHEN h.status = 'promoted' THEN h.status WHEN i.title IS NOT NULL THEN i.status ELSE h.status END AS status, CASE WHEN h.status = 'promoted' THEN h.base_rate WHEN i.title IS NOT NULL THEN i.base_rate ELSE h.base_rate END::DOUBLE AS base_rate FROM hyp h FULL JOIN inc i ON h.title = i.title")
def hypothesis_upsert(spark, sf_dir):
    h = hypotheses(spark, sf_dir).select("hypothesis", "title", "status", "base_rate")
    inc = h.filter("hypothesis % 2 = 0").select("title", F.lit("survived").alias("status"), F.lit(0.9).alias("base_rate"))
    new = spark.range(1).select(F.lit("new").alias("title"), F.lit("parked").alias("status"), F.lit(0.1).alias("base_rate"))
    return entities.upsert_hypotheses(h.drop("hypothesis"), inc.unionByName(new))


@query("driver_link_violations", """WITH d AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS card, CASE WHEN o_orderkey % 3 = 1 OR o_orderkey % 12 = 0 THEN o_custkey END AS hypothesis, CASE WHEN o_orderkey % 13 <> 0 THEN 's' || o_custkey END AS series_id, 0 AS kill_index, CASE o_orderkey % 7 WHEN 0 THEN '=' ELSE '>=' END AS direction, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE 'why' END AS rationale FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 12 = 2),
w AS (SELECT card, hypothesis, series_id, kill_index, CASE WHEN (card IS NULL) = (hypothesis IS NULL) THEN 'one parent' WHEN series_id IS NULL THEN 'series' WHEN direction NOT IN ('>=', '<=') THEN 'direction' WHEN trim(rationale) = '' THEN 'rationale' END AS why FROM d WHERE card IS NOT NULL)
SELECT * FROM w WHERE why IS NOT NULL""")
def driver_link_violations(spark, sf_dir):
    i = F.col("o_orderkey")
    o = domain.table(spark, sf_dir, "orders").filter(i % 3 == 0)
    d = o.select(i.alias("card"), F.when(i % 12 == 0, F.col("o_custkey")).alias("hypothesis"), F.when(i % 13 != 0, F.concat(F.lit("s"), "o_custkey")).alias("series_id"), F.lit(0).alias("kill_index"), F.when(i % 7 == 0, "=").otherwise(">=").alias("direction"), F.when(i % 11 == 0, " ").otherwise("why").alias("rationale"))
    return entities.driver_violations(d)


@query("decisions_board", "WITH p AS (SELECT user_id AS prompt, min(ts) AS opened FROM events WHERE event_type = 'signup' GROUP BY ALL), a AS (SELECT user_id AS prompt, arg_max(event_id, ts) AS choice, max(ts) AS resolved FROM events JOIN p ON p.prompt = user_id WHERE event_type = 'purchase' AND ts >= opened GROUP BY ALL) SELECT prompt, opened, choice, resolved FROM p LEFT JOIN a USING (prompt)")
def decisions_board(spark, sf_dir):
    """Each user's first sign-up opens a prompt, the last purchase after it answers it."""
    ev = domain.table(spark, sf_dir, "events")
    opened = ev.filter("event_type = 'signup'").select(F.col("user_id").alias("prompt"), F.col("ts").alias("at"))
    said = ev.filter("event_type = 'purchase'").select(F.col("user_id").alias("prompt"), F.col("ts").alias("at"), F.col("event_id").alias("choice"))
    return entities.decisions(opened, said)


@query("prefix_resolution", "WITH q AS (SELECT DISTINCT substr(c_name, 1, 17) AS prefix FROM customer) SELECT prefix, CASE WHEN count(c_name) = 1 THEN min(c_name) END AS match FROM q LEFT JOIN customer ON starts_with(c_name, prefix) GROUP BY ALL")
def prefix_resolution(spark, sf_dir):
    """The one name that begins with a prefix, if only one does."""
    c = domain.table(spark, sf_dir, "customer")
    return entities.unique_prefix(c, "c_name", c.select(F.substring("c_name", 1, 17).alias("prefix")).distinct())


# Corpus terms.
@query("category_series", f"WITH {PAPERS}, c AS (SELECT category, substr(month, 1, 4)::INT AS year, count(*) AS n FROM papers WHERE category IS NOT NULL GROUP BY ALL), e AS (SELECT category FROM c GROUP BY ALL HAVING sum(n) >= 5 AND count(*) >= 4) SELECT category, year, n, round(sqrt(n), 6) AS sigma, make_date(year, 12, 1)::VARCHAR AS as_of FROM c JOIN e USING (category)")
def category_series(spark, sf_dir):
    """Yearly counts of categories with enough papers (5 in 4 years here: the corpus has four years)."""
    return corpus.category_series(domain.papers(spark, sf_dir), 5, 4).withColumns({"sigma": F.round("sigma", 6), "as_of": F.col("as_of").cast("string")})


_TERMS = ["the", "und", "de la"]


@query("term_signals", f"""WITH {PAPERS}, t AS (SELECT month, count(*) AS total, row_number() OVER (ORDER BY month DESC) AS age FROM papers WHERE month >= '2010-01' AND month < '2021-12' GROUP BY month),
m AS (SELECT month, coalesce(category, '?') AS category, category || ';' || lang AS authors, unnest(list_filter([CASE WHEN regexp_matches(lower(text), '(^|[^\\pL\\pN_])the($|[^\\pL\\pN_])') THEN 'the' END, CASE WHEN regexp_matches(lower(text), '(^|[^\\pL\\pN_])und($|[^\\pL\\pN_])') THEN 'und' END, CASE WHEN regexp_matches(lower(text), '(^|[^\\pL\\pN_])de\\s+la($|[^\\pL\\pN_])') THEN 'de la' END], lambda x: x IS NOT NULL)) AS term FROM papers WHERE month < '2021-12'),
a AS (SELECT term, month, trim(unnest(string_split(authors, ';'))) AS a FROM m), c AS (SELECT term, month, count(*) AS matched, count(DISTINCT category) AS breadth FROM m GROUP BY ALL), tl AS (SELECT term, month, count(DISTINCT a) AS talent FROM a WHERE a <> '' GROUP BY ALL)
SELECT term, month, matched, total, round(matched / total, 9) AS share, round(greatest(sqrt(greatest(matched / total * (1 - matched / total), 1e-9) / total), 1e-6), 9) AS se, breadth, coalesce(talent, 0) AS talent FROM c JOIN t USING (month) LEFT JOIN tl USING (term, month) WHERE age > 2""")
def term_signals(spark, sf_dir):
    """Share, breadth and talent of terms per month; source and language stand in for authors."""
    p = domain.papers(spark, sf_dir).withColumn("authors", F.concat("category", F.lit(";"), "lang"))
    return corpus.term_signals(p, spark.createDataFrame([(t,) for t in _TERMS], "term string"), "2021-12").withColumns({c: F.round(c, 9) for c in ("share", "se")})


@query("pattern_counts", r"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\pL\pN_]+')) AS term FROM benchmark),
w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\pL\pN_]+')) AS ws FROM documents), u AS (SELECT doc_id, unnest(ws) AS term FROM w)
SELECT term, count(*) AS texts FROM u JOIN t USING (term) GROUP BY ALL""")
def pattern_counts(spark, sf_dir):
    """Texts that hold each word of the benchmark as a whole word: thousands of patterns in one pass."""
    terms = domain.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("term"))
    texts = domain.table(spark, sf_dir, "documents").select("doc_id", "text")
    return matching.occurrences(texts, "text", terms, "term").groupBy("term").agg(F.count("*").alias("texts"))


@query("trailing_talent", f"""WITH {PAPERS}, r AS (SELECT lang AS term, month, substr(month, 1, 4)::INT * 12 + substr(month, 6, 2)::INT AS mth, unnest([category, 'a' || doc_id % 97, 'b' || doc_id % 41]) AS who FROM papers),
m AS (SELECT DISTINCT term, month, mth FROM r WHERE term IS NOT NULL) SELECT m.term, m.month, count(DISTINCT who) AS n FROM m JOIN r ON r.term = m.term AND r.mth BETWEEN m.mth - 11 AND m.mth GROUP BY ALL""")
def trailing_talent(spark, sf_dir):
    """Different authors of each language's papers over the trailing twelve months."""
    p = domain.papers(spark, sf_dir)
    who = F.explode(F.array(F.col("category"), F.concat(F.lit("a"), (F.col("doc_id") % 97).cast("string")), F.concat(F.lit("b"), (F.col("doc_id") % 41).cast("string"))))
    return corpus.trailing_distinct(p.select(F.col("lang").alias("term"), "month", who.alias("who")), cut)


@query("span_grounding", r"""WITH c AS (SELECT doc_id, item_id, d.text AS text, b.text AS span FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40) SELECT doc_id, item_id, coalesce(trim(span) <> '' AND contains(lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))), lower(trim(regexp_replace(span, '[ \t\n\x0B\f\r]+', ' ', 'g')))), false) AS found FROM c""")
def span_grounding(spark, sf_dir):
    """Is a quote in the text it is said to come from?"""
    b = domain.table(spark, sf_dir, "benchmark").withColumnRenamed("text", "span")
    c = domain.table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("item_id")).join(b, "item_id").withColumn("confidence", F.lit(0.9))
    return corpus.grounded(c).select("doc_id", "item_id", "found")


@query("number_grounding", "SELECT o_orderkey, regexp_replace(lower(o_totalprice::VARCHAR), '[^a-z0-9]', '', 'g') <> '' AND contains(regexp_replace(lower('Total: ' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR ELSE 'none' END || ' USD'), '[^a-z0-9]', '', 'g'), o_orderkey::VARCHAR) AS grounded FROM orders")
def number_grounding(spark, sf_dir):
    o = domain.table(spark, sf_dir, "orders")
    said = F.concat(F.lit("Total: "), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise("none"), F.lit(" USD"))
    return corpus.number_grounded(o.select("o_orderkey", F.col("o_orderkey").cast("string").alias("value"), said.alias("evidence"))).select("o_orderkey", "grounded")


@query("relevant_excerpts")
def relevant_excerpts(spark, sf_dir):
    """The lines of each page's source that say most about the terms, within a budget (tested against a loop)."""
    p = domain.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", ">", ">\n").alias("text"))
    return corpus.excerpt_lines(p, "page_id", ["title", "price", "name"], 600)


@query("paper_upsert", f"WITH {PAPERS}, cur AS (SELECT 'p' AS provider, doc_id AS external_id, month AS published, month AS updated, category AS categories, lang AS abstract FROM papers WHERE doc_id % 3 <> 0), inc AS (SELECT 'p' AS provider, doc_id AS external_id, '2099-01' AS published, '2099-02' AS updated, 'x' AS categories, 'new' AS abstract FROM papers WHERE doc_id % 2 = 0) SELECT provider, external_id, coalesce(cur.published, inc.published) AS published, coalesce(inc.updated, cur.updated) AS updated, coalesce(inc.categories, cur.categories) AS categories, coalesce(inc.abstract, cur.abstract) AS abstract FROM cur FULL JOIN inc USING (provider, external_id)")
def paper_upsert(spark, sf_dir):
    p = domain.papers(spark, sf_dir)
    cur = p.filter("doc_id % 3 <> 0").select(F.lit("p").alias("provider"), F.col("doc_id").alias("external_id"), F.col("month").alias("published"), F.col("month").alias("updated"), F.col("category").alias("categories"), F.col("lang").alias("abstract"))
    inc = p.filter("doc_id % 2 = 0").select(F.lit("p").alias("provider"), F.col("doc_id").alias("external_id"), F.lit("2099-01").alias("published"), F.lit("2099-02").alias("updated"), F.lit("x").alias("categories"), F.lit("new").alias("abstract"))
    return corpus.upsert_papers(cur, inc)
