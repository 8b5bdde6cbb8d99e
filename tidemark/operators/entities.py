"""Entities, their candidates and taxonomy, hypotheses and their gate, decisions: ledgers that grow by merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import occurrences

#: Words that tell nothing about an entity.
STOP = ("the", "a", "of", "and", "for", "in", "to", "system", "model", "method", "technology")


def tokens(label: Column) -> Column:
    """Distinct words of two or more letters or digits, without the stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(label, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP)))


def index(entities: DataFrame) -> DataFrame:
    """entity, surfaces (lower-cased name and aliases), words."""
    s = F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), F.lower))
    df = entities.select("entity", "name", s.alias("surfaces"))
    return df.withColumn("words", F.array_distinct(F.flatten(F.transform("surfaces", tokens))))


def _even(text: Column) -> Column:
    """Runs of white space as one space: surfaces and labels are compared so."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def candidates(series: DataFrame, entities: DataFrame, linked: DataFrame, proposed: DataFrame, least: float = 0.5) -> DataFrame:
    """entity, series_id, generator, confidence for series (series_id, label) that no link names: 'exact_id' (0.9) where the label
    holds a surface or the reverse, else 'string_block' where at least half of all words are shared; pairs already proposed by
    that generator are left out.

    Words are an inverted index: pairs that share a word meet in an equi-join. A surface inside a longer word shares no whole
    word: all surfaces are searched in the labels at once, and the labels in the surfaces."""
    open_ = series.join(linked.select("series_id").distinct(), "series_id", "left_anti").select("series_id", "label", F.lower("label").alias("norm"), tokens(F.col("label")).alias("own")).filter(F.size("own") > 0)
    idx = index(entities)
    block = open_.select("series_id", F.explode("own").alias("w")).join(idx.select("entity", F.explode("words").alias("w")), "w").select("series_id", "entity").distinct()
    surf = idx.select("entity", F.explode("surfaces").alias("s")).withColumn("s", _even(F.col("s"))).filter("s <> ''")
    named = open_.select("series_id", _even(F.col("norm")).alias("label")).filter("label <> ''")
    inside = occurrences(named, "label", surf, "s", whole_words=False).join(surf, "s")
    around = occurrences(surf, "s", named, "label", whole_words=False).join(named, "label")
    exact = inside.select("series_id", "entity").unionByName(around.select("series_id", "entity")).distinct().withColumn("exact", F.lit(True))
    pairs = block.unionByName(exact.select("series_id", "entity")).distinct().join(exact, ["series_id", "entity"], "left").join(open_, "series_id").join(idx, "entity")
    jac = F.size(F.array_intersect("own", "words")) / F.size(F.array_union("own", "words"))
    got = pairs.select("entity", "series_id", F.when(F.col("exact"), "exact_id").when(jac >= least, "string_block").alias("generator"), F.when(F.col("exact"), 0.9).otherwise(F.bround(F.least(F.lit(0.6), jac), 2)).alias("confidence")).filter("generator IS NOT NULL")
    return got.join(proposed.select("entity", "series_id", "generator"), ["entity", "series_id", "generator"], "left_anti")


def decided(candidates_: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates with status, new links): a candidate is proposed until the last decision on it accepts or rejects; each accepted
    one becomes a link, once per entity and series."""
    last = decisions.groupBy("entity", "series_id").agg(F.max_by("status", "at").alias("said"))
    df = candidates_.join(last, ["entity", "series_id"], "left").withColumn("status", F.coalesce("said", F.lit("proposed"))).drop("said")
    links = df.filter("status = 'accepted'").groupBy("entity", "series_id").agg(F.max("confidence").alias("confidence"))
    return df, links


def core_label(label: Column, suffixes: tuple[str, ...]) -> Column:
    """The label without a trailing channel suffix, hyphens as spaces, lower-cased and squeezed."""
    cut = F.regexp_replace(F.lower(label), r"\s*\((?:" + "|".join(suffixes) + r")\)\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(cut, "-", " "), r"\s+", " "))


def taxonomy(labels: DataFrame, folds: dict[str, str], domains: dict[str, str], suffixes: tuple[str, ...] = ()) -> DataFrame:
    """core, display, domain, n: labels (label) folded onto their entity. display is the surface with the most capitals (ties to the
    lesser text); the domain is that of the first pattern that the core matches."""
    core = core_label(F.col("label"), suffixes) if suffixes else F.trim(F.regexp_replace(F.regexp_replace(F.lower("label"), "-", " "), r"\s+", " "))
    for a, b in folds.items():
        core = F.when(core == a, b).otherwise(core)
    domain = F.lit("other")
    for name, pattern in reversed(domains.items()):
        domain = F.when(F.col("core").rlike(pattern), name).otherwise(domain)
    capitals = F.length(F.regexp_replace("label", "[^A-Z]", ""))
    g = labels.withColumn("core", core).groupBy("core").agg(F.min_by("label", F.struct(-capitals, F.col("label"))).alias("display"), F.count("*").alias("n"))
    return g.withColumn("domain", domain)


def spans(links: DataFrame) -> DataFrame:
    """entity, n_series, pillars of the entities that reach over several pillars."""
    g = links.groupBy("entity").agg(F.count_distinct("series_id").alias("n_series"), F.sort_array(F.collect_set("pillar")).alias("pillars"))
    return g.filter(F.size("pillars") > 1)


def gate(status: Column, refuted: Column, measurable: Column, kill_criteria: Column, base_rate: Column, horizon: Column) -> Column:
    """promoted stays; refuted is killed; measurable with a kill criterion, a base rate and a horizon survives; else parked."""
    kills = F.exists(F.coalesce(kill_criteria, F.array().cast("array<string>")), lambda k: F.trim(k) != "")
    testable = F.coalesce(measurable, F.lit(False)) & kills & base_rate.isNotNull() & horizon.isNotNull()
    return F.when(F.coalesce(status, F.lit("")) == "promoted", "promoted").when(F.coalesce(refuted, F.lit(False)), "killed").when(testable, "survived").otherwise("parked")


def panel(hypotheses: DataFrame, votes: DataFrame) -> DataFrame:
    """hypotheses with n_skeptics, n_refute, refuted and status after the votes: a strict majority refutes, a tie does not; the
    promoted are left as they are."""
    v = votes.groupBy("hypothesis").agg(F.count("*").alias("n_skeptics"), F.count_if("against").alias("n_refute"))
    df = hypotheses.join(v, "hypothesis", "left")
    heard = F.col("n_skeptics").isNotNull() & (F.coalesce("status", F.lit("")) != "promoted")
    df = df.withColumn("refuted", F.when(heard, F.col("n_refute") * 2 > F.col("n_skeptics")).otherwise(F.col("refuted")))
    return df.withColumn("status", gate(F.col("status"), F.col("refuted"), F.col("measurable"), F.col("kills"), F.col("base_rate"), F.col("horizon")))


def upsert_hypotheses(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """By title: new fields replace old ones, but a promoted hypothesis keeps its own."""
    cols = [c for c in incoming.columns if c != "title"]
    new = incoming.select("title", F.struct(*cols).alias("new"))
    both = current.select("title", F.struct(*cols).alias("old")).join(new, "title", "full_outer")
    pick = F.when(F.col("old.status") == "promoted", F.col("old")).otherwise(F.coalesce("new", "old"))
    return both.select("title", pick.alias("r")).select("title", "r.*")


def driver_violations(links: DataFrame) -> DataFrame:
    """Driver links that break a rule: exactly one of card and hypothesis, a series, a direction, a rationale, each key once."""
    key = ["card", "hypothesis", "series_id", "kill_index"]
    g = links.groupBy(*key).agg(F.count("*").alias("n"), F.first("direction").alias("direction"), F.first("rationale").alias("rationale"))
    why = F.when(F.col("card").isNull() == F.col("hypothesis").isNull(), "one parent").when(F.col("series_id").isNull(), "series").when(~F.coalesce(F.col("direction").isin(">=", "<="), F.lit(False)), "direction").when(F.trim(F.coalesce("rationale", F.lit(""))) == "", "rationale").when(F.col("n") > 1, "twice")
    return g.withColumn("why", why).filter("why IS NOT NULL").select(*key, "why")


def decisions(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """prompt, opened, choice, resolved: a prompt is opened once (its first time); the last answer after that resolves it."""
    opened = prompts.groupBy("prompt").agg(F.min("at").alias("opened"))
    said = answers.join(opened, "prompt").filter("at >= opened").groupBy("prompt").agg(F.max_by("choice", "at").alias("choice"), F.max("at").alias("resolved"))
    return opened.join(said, "prompt", "left")


def unique_prefix(rows: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """asked (prefix) -> prefix, match: the one row whose key is or begins with the prefix; null if none or several do. Prefixes
    meet keys by their first characters, as many as the shortest prefix has."""
    n = asked.agg(F.coalesce(F.min(F.length("prefix")), F.lit(0))).first()[0]
    heads = asked.withColumn("head", F.substring("prefix", 1, n))
    hit = heads.join(rows.select(F.col(key).alias("k"), F.substring(F.col(key), 1, n).alias("head")), "head").filter(F.col("k").startswith(F.col("prefix")))
    g = hit.groupBy("prefix").agg(F.count("*").alias("n"), F.min("k").alias("only"), F.max(F.when(F.col("k") == F.col("prefix"), F.col("k"))).alias("same"))
    return asked.join(g, "prefix", "left").select("prefix", F.coalesce("same", F.when(F.col("n") == 1, F.col("only"))).alias("match"))
