"""Seals of tables as hash trees.

A row's place is the sha256 of its key, so places do not depend on partitions, order or size. Leaves are the ranges of places that share
their first DEPTH bytes; every node above has 256 children. A leaf's hash covers the row hashes in it in the order of their places,
a node's hash its children's bytes and hashes. Only nodes with rows exist. The root is the seal; a row is shown to be in a sealed
table by the hashes beside its path, and two tables are compared from their roots down, by the children of nodes that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import content_hash

#: Levels below the root: 256^3 ranges, so that 10^12 rows leave about 60,000 in each.
DEPTH = 3


def _hash(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def hashed(rows: DataFrame, key: str) -> DataFrame:
    """place, hash of each row: sha256 of the key (as text) and of the row as JSON with sorted keys."""
    return rows.select(F.sha2(F.col(key).cast("string"), 256).alias("place"), content_hash(*rows.columns).alias("hash"))


def tree(rows: DataFrame, key: str, cut, depth: int = DEPTH) -> DataFrame:
    """level (0 the root), prefix (hex), n (rows below), hash of every node with rows; the keys must be unique and not null. Equal tables
    have equal trees. cut(frame) writes a frame and reads it again; each level above the leaves reads the one below it."""
    own = F.substring("place", 1, 2 * depth)
    level = hashed(rows, key).groupBy(own.alias("prefix")).agg(F.count("*").alias("n"), _hash(F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda r: r["hash"])).alias("hash"))
    level = cut(level.withColumn("level", F.lit(depth)))
    every = level
    for k in range(depth - 1, -1, -1):
        child = F.struct(F.substring("prefix", 2 * k + 1, 2).alias("byte"), F.col("hash"))
        above = F.substring("prefix", 1, 2 * k)
        level = level.groupBy(above.alias("prefix")).agg(F.sum("n").alias("n"), _hash(F.transform(F.array_sort(F.collect_list(child)), lambda r: F.concat(r["byte"], r["hash"]))).alias("hash"))
        level = cut(level.withColumn("level", F.lit(k)))
        every = every.unionByName(level)
    return every.select("level", "prefix", "n", "hash")


def seal(nodes: DataFrame) -> DataFrame:
    """n, seal of a tree: one row; of an empty one 0 and the hash of nothing."""
    root = nodes.filter("level = 0")
    return root.agg(F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.max("hash"), F.sha2(F.lit(""), 256)).alias("seal"))


def proofs(rows: DataFrame, key: str, nodes: DataFrame, asked: DataFrame, depth: int = DEPTH) -> DataFrame:
    """For rows whose key `asked` holds: key, place, hash, path: an array from the leaf to the root, each step the sorted entries that are
    hashed there (in the leaf the row hashes, above bytes and hashes) with the row's or its node's own left out, and where it belongs."""
    named = rows.join(asked.select(key).distinct(), key, "left_semi")
    mine = named.select(F.col(key), F.sha2(F.col(key).cast("string"), 256).alias("place"), content_hash(*rows.columns).alias("hash")).withColumn("prefix", F.substring("place", 1, 2 * depth))
    beside = hashed(rows, key).withColumn("prefix", F.substring("place", 1, 2 * depth)).join(mine.select("prefix").distinct(), "prefix", "left_semi")
    # A node's entries are gathered once, for all rows below it. The widest come last, and what a row has got is not moved any more.
    path = mine.join(_entries(beside, "prefix", F.col("place"), F.col("hash"), "leaf"), "prefix").withColumn("own_leaf", F.col("place"))
    steps = ["leaf"]
    for k in range(depth - 1, -1, -1):
        byte, name = F.substring("prefix", 2 * k + 1, 2), f"level{k}"
        near = _entries(nodes.filter(F.col("level") == k + 1), F.substring("prefix", 1, 2 * k), byte, F.concat(byte, "hash"), name, f"above{k}")
        path = path.withColumns({f"above{k}": F.substring("place", 1, 2 * k), f"own_{name}": F.substring("place", 2 * k + 1, 2)})
        path = path.join(F.broadcast(near) if k < 2 else near, f"above{k}")  # 256 nodes at most, of 256 entries
        steps.append(name)

    def step(name: str) -> Column:
        entries, before = F.col(name)["entries"], F.array_position(F.col(name)["marks"], F.col(f"own_{name}")).cast("int") - 1
        others = F.concat(F.slice(entries, F.lit(1), before), F.slice(entries, before + 2, F.size(entries) - before - 1))
        return F.struct(others.alias("others"), before.alias("before"))

    return path.select(key, "place", "hash", F.array(*map(step, steps)).alias("path"))


def _entries(rows: DataFrame, at: Column | str, mark: Column, entry: Column, name: str, called: str = "prefix") -> DataFrame:
    """A row for each node: its children's marks and entries, in the order of the marks."""
    g = rows.select((F.col(at) if isinstance(at, str) else at).alias(called), F.struct(mark.alias("mark"), entry.alias("entry")).alias("r")).groupBy(called).agg(F.array_sort(F.collect_list("r")).alias("all"))
    return g.select(called, F.struct(F.col("all")["mark"].alias("marks"), F.col("all")["entry"].alias("entries")).alias(name))


def proven(proof: DataFrame, depth: int = DEPTH) -> Column:
    """The seal that a proof leads to: equal to the table's if the row is in it as its hash says."""
    value = F.col("hash")
    for k in range(depth + 1):
        others, before = F.col("path")[k]["others"], F.col("path")[k]["before"]
        own = value if k == 0 else F.concat(F.substring("place", 2 * (depth - k) + 1, 2), value)
        value = _hash(F.concat(F.slice(others, F.lit(1), before), F.array(own), F.slice(others, before + 1, F.greatest(F.size(others) - before, F.lit(0)))))
    return value


def differing(left: DataFrame, right: DataFrame, cut, depth: int = DEPTH) -> DataFrame:
    """prefix of the leaves in which two trees differ, read from the roots down: of each level only children of nodes that differ."""
    at = None
    for k in range(depth + 1):
        a, b = (t.filter(F.col("level") == k).select("prefix", F.col("hash").alias(n)) for t, n in ((left, "a"), (right, "b")))
        if at is not None:
            a, b = (x.withColumn("above", F.substring("prefix", 1, 2 * (k - 1))).join(at, "above", "left_semi").drop("above") for x in (a, b))
        both = cut(a.join(b, "prefix", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("prefix"))
        at = both.withColumnRenamed("prefix", "above")
    return both


def changes(old: DataFrame, new: DataFrame, key: str, leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """key, change (added, removed, changed) of the rows in the leaves that differ; rows elsewhere are not compared."""
    leaf = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 2 * depth)
    some = lambda d, n: d.withColumn("prefix", leaf).join(leaves, "prefix", "left_semi").select(key, content_hash(*d.columns).alias(n))
    both = some(old, "a").join(some(new, "b"), key, "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(key, F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))
