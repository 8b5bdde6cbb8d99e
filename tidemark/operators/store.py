"""The revision-logged store: merges are joins that return new frames; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["series_id", "x"]


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key: the largest `order`, among equals the largest of the other columns in their order."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max(F.struct(F.col(order).alias("__o"), *[F.col(c) for c in rest])).alias("__r")).select(*[F.col(c) if c in key else F.col(f"__r.{c}") for c in rows.columns])


def merge(current: DataFrame, incoming: DataFrame, key: list[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """(latest, revisions). A key that exists with another value logs old and new; value and uncertainty are replaced, unit and
    creation are kept; a changed uncertainty alone logs nothing. incoming must hold a key once (last_wins)."""
    new = incoming.select(*key, F.col("value").alias("__v"), F.col("uncertainty").alias("__u"), F.col("unit").alias("__unit"), F.col("created").alias("__c"))
    both = current.join(new, key, "full_outer")
    revisions = both.filter(F.col("value").isNotNull() & F.col("__v").isNotNull() & (F.col("value") != F.col("__v"))).select(*key, F.col("value").alias("old_value"), F.col("__v").alias("new_value"), F.col("__c").alias("revised_at"))
    known = F.col("created").isNotNull()
    latest = both.select(*key, F.coalesce("__v", "value").alias("value"), F.when(F.col("__v").isNotNull(), F.col("__u")).otherwise(F.col("uncertainty")).alias("uncertainty"), F.when(known, F.col("unit")).otherwise(F.col("__unit")).alias("unit"), F.when(known, F.col("created")).otherwise(F.col("__c")).alias("created"))
    return latest, revisions


def as_of(revisions: DataFrame, latest: DataFrame, when, key: list[str] = KEY) -> DataFrame:
    """Values as they stood at a time: the old value of the first later revision, else the latest."""
    later = revisions.filter(F.col("revised_at") > when).groupBy(*key).agg(F.min_by("old_value", "revised_at").alias("__old"))
    return latest.filter(F.col("created") <= when).join(later, key, "left").withColumn("value", F.coalesce("__old", "value")).drop("__old")


def compact(x: Column) -> Column:
    """A number in six significant digits without trailing zeros, with an exponent below 1e-4 and from 1e6 on."""
    e = F.format_string("%.5e", x)
    digits, power = F.regexp_replace(F.substring_index(e, "e", 1), "[-.]", ""), F.substring_index(e, "e", -1).cast("int")
    fixed = F.when(power >= 5, digits).when(power >= 0, F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
    trim = lambda s: F.regexp_replace(F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, "0+$", "")).otherwise(s), r"\.$", "")
    long = F.concat(trim(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 9))), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return F.when(x == 0, "0").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), F.when((power < -4) | (power >= 6), long).otherwise(trim(fixed))))


def endpoints(points: DataFrame) -> DataFrame:
    """Per series n, first and last point and a sparkline of its values."""
    return points.groupBy("series_id").agg(
        F.count("*").alias("n_obs"), F.min("x").alias("first_x"), F.max("x").alias("last_x"), F.min_by("y", "x").alias("first_y"), F.max_by("y", "x").alias("last_y"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "y"))), lambda p: compact(p["y"])), ",").alias("spark"))


def upsert(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows replace those of their key (nulls too); the rest stays."""
    return current.join(incoming.select(*key), key, "left_anti").unionByName(incoming)


def rewrite(current: DataFrame, incoming: DataFrame, partition: list[str]) -> DataFrame:
    """Delete and rewrite: the partitions that incoming holds are replaced whole."""
    return current.join(incoming.select(*partition).distinct(), partition, "left_anti").unionByName(incoming)


def upsert_counts(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """written, revised: rows of a batch, and those whose value differs from what stood before the batch."""
    both = incoming.select(*key, F.col("value").alias("new")).join(current.select(*key, "value"), key, "left")
    return both.agg(F.count("*").alias("written"), F.count_if(F.col("new") != F.col("value")).alias("revised"))


def missing_only(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Insert or ignore: what of incoming has no key in current yet."""
    return incoming.join(current.select(*key), key, "left_anti")


def coalesce_merge(current: DataFrame, incoming: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """New values where there are any, else the old ones."""
    new = incoming.select(*key, *[F.col(c).alias(f"__{c}") for c in cols])
    return current.join(new, key, "full_outer").select(*key, *[F.coalesce(f"__{c}", c).alias(c) for c in cols])


def cost_status(cents: str = "cents", free_below: int = 0, approve_upto: int = 500):
    """auto for nothing, approved up to the limit, else pending."""
    return F.when(F.col(cents) <= free_below, "auto").when(F.col(cents) <= approve_upto, "approved").otherwise("pending")


def content_hash(*columns: str) -> Column:
    """sha256 of a row as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def chain(rows: DataFrame, key: str, most: int = 1 << 20) -> DataFrame:
    """n, seal: the hash over all rows' hashes in the order of the key (unique), for tables of up to `most` rows; larger ones are sealed
    as a hash tree (merkle.tree)."""
    each = rows.select(F.col(key).alias("k"), content_hash(*rows.columns).alias("h"))
    n = each.count()
    if n > most:
        raise ValueError(f"{n} rows are no chain: seal them as a hash tree")
    chained = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda r: r["h"]), ""), 256)
    return each.agg(F.lit(n).cast("long").alias("n"), chained.alias("seal"))


def export_lines(rows: DataFrame, key: str, path: str, cut) -> str:
    """Writes the rows as JSON lines sorted by key, in files that follow each other, and returns the seal that belongs beside them: the root
    of their hash tree, which a table of any size and layout reproduces. cut(frame) writes a frame and reads it again."""
    from . import merkle

    rows.select(F.col(key).alias("__k"), F.to_json(F.struct(*sorted(rows.columns))).alias("value")).orderBy("__k").select("value").write.text(path)
    return merkle.seal(merkle.tree(rows, key, cut)).first()["seal"]


def submission(forecasts: DataFrame, organization: str, model: str, due: str) -> DataFrame:
    """One row: the name of the file and the document of a submission, with exactly the keys organization, model, question_set,
    forecast_due_date and forecasts."""
    rows = F.array_sort(F.collect_list(F.struct("id", "source", "resolution_date", "direction", "forecast")))
    doc = F.struct(F.lit(organization).alias("organization"), F.lit(model).alias("model"), F.lit(f"{due}-llm.json").alias("question_set"), F.lit(due).alias("forecast_due_date"), F.col("rows").alias("forecasts"))
    return forecasts.agg(rows.alias("rows")).select(F.lit(f"{due}.{organization}.1.json").alias("name"), F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


def ledgered(rows: DataFrame, actions: DataFrame, free_below: int = 0, approve_upto: int = 500) -> tuple[DataFrame, DataFrame]:
    """(ledger with status, refused actions): actions (id, cents) are logged first whatever comes of them; what is pending is refused."""
    new = actions.withColumn("status", cost_status("cents", free_below, approve_upto))
    return rows.unionByName(new), new.filter("status = 'pending'")
