"""Streams over the event log: windows, sessions, duplicates, a stateful fold and an index that grows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.functions.text import base_tokens
from docloom.operators.index import grow

LATE = "1 hour"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files of events as a stream, with event times in the session's zone."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str = LATE) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    counts = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counts.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = LATE) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


class EvidenceFold(StatefulProcessor):
    """Per session: how often each action came, folded over all batches; one row a session and batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "action string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for action, n in frame["event_type"].value_counts().items():
                before = self.counts.getValue((action,))
                self.counts.updateValue((action,), ((before[0] if before else 0) + int(n),))
        found = {k[0]: v[0] for k, v in self.counts.iterator()}
        yield pd.DataFrame({"user_id": [key[0]], "actions": [len(found)], "n": [sum(found.values())]})

    def close(self) -> None:
        pass


def fold(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").transformWithStateInPandas(EvidenceFold(), "user_id long, actions long, n long", outputMode="Update", timeMode="None")


def grow_index(documents: DataFrame, path: str, checkpoint: str) -> None:
    """Adds the terms of new documents to an index that operators.index searches; a batch that is tried again writes over its own part."""
    grow(documents, path, checkpoint, lambda d: d.select("doc_id", base_tokens(F.coalesce("text", F.lit(""))).alias("terms")), ["doc_id"])


def run_once(frame: DataFrame, name: str, checkpoint: str, mode: str = "append", each: Callable | None = None) -> None:
    """Runs a stream over what is there into a memory table (or `each` batch) and stops."""
    writer = frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer = writer.foreachBatch(each) if each else writer.format("memory").queryName(name)
    writer.start().awaitTermination()
