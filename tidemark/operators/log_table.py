"""A keyed table with a revision log, kept as sorted runs.

A commit writes its own rows only: one run for each bucket of keys that it touches. What stood before is read for those buckets alone,
to log the values that changed. A manifest names the runs that make up the table; reading merges them by key. Where a bucket has
gathered `fan` runs of about one size (a power of `fan`) they become one, so a row is written again as often as its run grows by that
factor: bytes written follow the batches, and buckets that a batch does not touch are left alone.

The manifest is kept in two places that take turns, so one of them is whole at any time; a commit that failed half-way leaves runs
that no manifest names, and is overwritten when it comes again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.landed import table_or_empty

MANIFEST = "version long, bucket int, run string, n long"


@dataclass
class LogTable:
    """where: a folder that all executors share. key, last (replaced by a later commit) and first (kept from the first one) are columns
    with their types; a change of `logged` is a revision. A later commit's null is a value like others."""

    spark: SparkSession
    where: str
    key: dict[str, str] = field(default_factory=lambda: {"series_id": "string", "x": "int"})
    last: dict[str, str] = field(default_factory=lambda: {"value": "double", "uncertainty": "double"})
    first: dict[str, str] = field(default_factory=lambda: {"unit": "string", "created": "timestamp"})
    logged: str = "value"
    buckets: int = 64
    fan: int = 4

    @property
    def _row(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in (self.key | self.last | self.first | {"since": "long", "version": "long"}).items())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def manifest(self) -> list[dict]:
        """The newest whole manifest: a row for each run of each bucket, under buckets * fan for each power of fan."""
        every = [r.asDict() for half in (0, 1) for r in table_or_empty(self.spark, f"{self.where}/manifest/{half}", MANIFEST).collect()]
        newest = max((r["version"] for r in every), default=-1)
        return [r for r in every if r["version"] == newest]

    def _name(self, runs: list[dict], version: int) -> None:
        rows = [(version, r["bucket"], r["run"], r["n"]) for r in runs]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.where}/manifest/{version % 2}")

    def _runs(self, runs: list[dict]) -> DataFrame:
        paths = sorted({f"{self.where}/runs/{r['run']}/bucket={r['bucket']}" for r in runs})
        return self.spark.read.schema(self._row).parquet(*paths) if paths else self.spark.createDataFrame([], self._row)

    def _merged(self, rows: DataFrame) -> DataFrame:
        """A row for each key: the newest values, the oldest of those that are kept."""
        newest, oldest = F.max_by(F.struct(*self.last), "version").alias("new"), F.min_by(F.struct(*self.first, "since"), "since").alias("old")
        got = rows.groupBy(*self.key).agg(newest, oldest, F.max("version").alias("version"))
        return got.select(*self.key, "new.*", "old.*", "version")

    def _write(self, rows: DataFrame, run: str) -> dict[int, int]:
        """Writes a run; the rows of each bucket. A bucket's rows lie sorted in one file (or in slices, where it is large)."""
        cols = [*self.key, *self.last, *self.first, "since", "version"]
        parted = rows.select(*cols).withColumn("bucket", self._bucket()).repartition("bucket").sortWithinPartitions("bucket", *self.key)
        parted.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.where}/runs/{run}")
        back = self.spark.read.schema(f"{self._row}, bucket int").parquet(f"{self.where}/runs/{run}")
        return {r["bucket"]: r["n"] for r in back.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # a row a bucket

    def commit(self, rows: DataFrame, version: int) -> None:
        """Merges rows (each key once) as a version above all before; one that is there already is left as it is."""
        before = self.manifest()
        if before and before[0]["version"] >= version:
            return
        sizes = self._write(rows.withColumns({"since": F.lit(version).cast("long"), "version": F.lit(version).cast("long")}), f"{version}-0")
        if not sizes:
            return
        own = [{"bucket": b, "run": f"{version}-0", "n": n} for b, n in sorted(sizes.items())]
        new = self._runs(own).select(*self.key, F.col(self.logged).alias(f"new_{self.logged}"), *[F.col(c).alias(f"at_{c}") for c in self.first])
        stood = self._merged(self._runs([r for r in before if r["bucket"] in sizes]).join(new.select(*self.key), list(self.key), "left_semi"))
        both = stood.join(new, list(self.key)).withColumn(f"old_{self.logged}", F.col(self.logged))
        changed = both.filter(F.col(f"old_{self.logged}") != F.col(f"new_{self.logged}"))
        at = [F.col(f"at_{c}") for c in self.first]
        changed.select(*self.key, f"old_{self.logged}", f"new_{self.logged}", *at, F.lit(version).cast("long").alias("version")).write.mode("overwrite").parquet(f"{self.where}/log/{version}")
        self._name(self._compacted(before + own, sizes, version), version)

    def _size(self, run: dict) -> int:
        """The power of `fan` that a run's rows reach."""
        n, size = run["n"], 0
        while n >= self.fan:
            n, size = n // self.fan, size + 1
        return size

    def _compacted(self, runs: list[dict], touched, version: int) -> list[dict]:
        for turn in range(1, len(runs) + 1):
            old = []
            for b in touched:
                sizes = [(self._size(r), r) for r in runs if r["bucket"] == b]
                full = [s for s, _ in sizes if sum(s == t for t, _ in sizes) >= self.fan]
                old += [r for s, r in sizes if full and s == min(full)]
            if not old:
                break
            now = self._write(self._merged(self._runs(old)), f"{version}-{turn}")
            runs = [r for r in runs if r not in old] + [{"bucket": b, "run": f"{version}-{turn}", "n": n} for b, n in sorted(now.items())]
        return runs

    def read(self) -> DataFrame:
        """The table as it stands: key, last and first columns."""
        return self._merged(self._runs(self.manifest())).select(*self.key, *self.last, *self.first)

    def log(self) -> DataFrame:
        """The revisions: key, old and new value, the first columns of the row that changed it (as at_...), version."""
        old = self.last[self.logged]
        schema = ", ".join(f"{c} {t}" for c, t in (self.key | {f"old_{self.logged}": old, f"new_{self.logged}": old} | {f"at_{c}": t for c, t in self.first.items()} | {"version": "long"}).items())
        return table_or_empty(self.spark, f"{self.where}/log/*", schema)
