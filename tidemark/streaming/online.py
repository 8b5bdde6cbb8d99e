"""The detector as state: each series keeps its points, sorted by x, and says so when its verdict changes.

State lies in RocksDB, one map of points and one verdict for each series; a batch touches only the series that it has points of, and a
point that comes late or again replaces what stood at its x. A stopped stream goes on from its checkpoint with all that it knew."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.robust import verdict

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
FLAGS = ["fired", "sustained", "dissolving"]


class Verdicts(StatefulProcessor):
    """Rows (x, y, seen) of one series -> a row for each change of its verdict: n, flags, surprise and the change's number. Of rows with
    one x the one seen last holds (ties: the larger y)."""

    def __init__(self, k: float):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getMapState("points", "x double", "y double, seen long")
        self.said = handle.getValueState("said", "change int, fired boolean, sustained boolean, dissolving boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["x", "seen", "y"]).drop_duplicates("x", keep="last")
        known = {p[0]: tuple(v) for p, v in self.points.iterator()}
        for x, y, seen in zip(new["x"].tolist(), new["y"].tolist(), new["seen"].tolist(), strict=True):
            old = known.get(x)
            if old is None or (old[1], old[0]) < (seen, y):
                known[x] = (y, seen)
                self.points.updateValue((x,), (y, int(seen)))
        every = np.array(sorted((x, v[0]) for x, v in known.items()))
        now = verdict(every[:, 0], every[:, 1], self.k)
        if now is None:
            return
        flags = [bool(now[f]) for f in FLAGS]
        before = self.said.get() if self.said.exists() else None
        if before is None or list(before[1:]) != flags:
            change = (before[0] if before else 0) + 1
            self.said.update((change, *flags))
            yield pd.DataFrame({**{c: [v] for c, v in zip(self.names, key, strict=True)}, "change": [change], "n": [now["n"]], **{f: [v] for f, v in zip(FLAGS, flags, strict=True)}, "surprise": [now["surprise"]]})

    names: list[str] = []

    def close(self) -> None:
        pass


def verdict_changes(stream: DataFrame, where: str, key: dict[str, str], k: float = 3.0, **options) -> DataFrame:
    """All changes of verdicts so far, after all that has landed in the stream (key columns, x, y and seen: which of two values of one x
    is the later) has been taken in: key, change (1, 2, ...), n, fired, sustained, dissolving, surprise. where: the shared folder of
    checkpoint and result; run again, it goes on where it was."""
    spark = stream.sparkSession
    processor = Verdicts(k)
    processor.names = list(key)
    schema = ", ".join(f"{c} {t}" for c, t in key.items()) + ", change int, n int, fired boolean, sustained boolean, dissolving boolean, surprise double"
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        out = stream.select(*key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("seen").cast("long").alias("seen")).groupBy(*key)
        got = out.transformWithStateInPandas(processor, schema, "Append", "None")
        got.writeStream.option("checkpointLocation", f"{where}/checkpoint").format("parquet").option("path", f"{where}/changes").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(schema).parquet(f"{where}/changes")


def standing(changes: DataFrame, key: list[str]) -> DataFrame:
    """Each series' verdict as it stands: its last change."""
    return changes.groupBy(*key).agg(F.max_by(F.struct(*FLAGS), "change").alias("v")).select(*key, "v.*")
