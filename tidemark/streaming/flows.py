"""The batch operators on streams: files that land one after another, late and corrected values, windows over event time.

Sources are directories of files read with a checkpoint, so a stopped run goes on where it was. `drain` runs what has landed and
returns the result."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import store
from ..operators.log_table import LogTable
from ..session import shared_root
from ..sources.landed import table_or_empty


def root(spark: SparkSession) -> str:
    """A new folder below the one that drivers and executors share."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes a frame below the shared folder and reads it again: its lineage ends there."""
    path = root(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def landing(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder, `files` at most in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(stream: DataFrame, where: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all that has landed. Append: the rows it emitted, as a table; complete: the last result."""
    spark = stream.sparkSession
    out = stream.writeStream.option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        out.format("parquet").option("path", f"{where}/rows").outputMode("append").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{where}/rows")
    # Two results take turns, so that one of them is whole at any time, and a resumed run without new files finds the last.
    turn = "batch_"
    while turn in stream.columns:
        turn += "_"

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn(turn, F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{where}/result/{n % 2}")

    out.outputMode("complete").foreachBatch(keep).start().awaitTermination()
    schema = StructType(stream.schema.fields).add(turn, "long")
    both = table_or_empty(spark, f"{where}/result/0", schema).unionByName(table_or_empty(spark, f"{where}/result/1", schema))
    newest = both.agg(F.max(turn)).first()[0]
    return both.filter(F.col(turn) == F.lit(newest)).drop(turn)


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "2 days", by: list[str] = ("event_type",)) -> DataFrame:
    """by, start, n of events (ts timestamp) per window; a window closes when the watermark has passed it."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), *by).agg(F.count("*").alias("n"))
    return g.select(*by, F.col("window.start").alias("start"), "n")


def without_trailing(events: DataFrame, months: int = 2, by: list[str] = ("event_type",)) -> DataFrame:
    """The windows of a day that the stream is sure of: those younger than so many months (of 31 days) before the newest event stay open
    and are not emitted, as recent months are under-reported."""
    return tumbling_counts(events, "1 day", f"{31 * months} days", by)


def sliding_net(events: DataFrame, width: str = "30 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, net, n of events (ts, sign) over overlapping windows."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide)).agg(F.sum("sign").alias("net"), F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), "net", "n")


class Store:
    """The revision-logged store under a stream: each batch is committed to a log-structured table, whose manifest names the version. A
    late or corrected value replaces the old one and leaves it in the log; nothing is dropped for being late. A batch that is run
    again finds its version and leaves it as it is."""

    SCHEMA = "series_id string, x int, value double, uncertainty double, unit string, created timestamp"

    def __init__(self, spark: SparkSession, where: str, buckets: int = 64, fan: int = 4):
        self.where, self.table = where, LogTable(spark, where, buckets=buckets, fan=fan)

    def merge(self, batch: DataFrame, n: int) -> None:
        self.table.commit(store.last_wins(batch, store.KEY, "created"), n)

    def run(self, stream: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(latest, log) after all that has landed, whether this run had anything new or not."""
        stream.writeStream.option("checkpointLocation", f"{self.where}/checkpoint").trigger(availableNow=True).foreachBatch(self.merge).start().awaitTermination()
        log = self.table.log().withColumnRenamed("at_created", "revised_at").drop("at_unit")
        return self.table.read(), log


def signs(column: Column, up: str) -> Column:
    return F.when(column == up, 1).otherwise(-1)
