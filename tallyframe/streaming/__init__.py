"""Decks and events as they arrive: re-audit, learning that adds each batch once, sessions with a watermark.

Sinks are idempotent: a batch is a folder named by its number, so one that is replayed after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyframe import learn
from tallyframe.operators import stats
from tallyframe.rules import catalogue, engine  # noqa: F401  the catalogue registers its rules
from tallyframe.sources.pptx import tables_of


def _decks(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pptx")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(folder)


def append_once(rows: DataFrame, path: str, number: int) -> None:
    """Write a batch's rows below path as the batch of that number; writing it again replaces it and adds nothing."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")


def watch(spark: SparkSession, folder: str, profile: dict, sink: Callable[[DataFrame, int], None], checkpoint: str, include: list[str] | None = None) -> StreamingQuery:
    """Check every new .pptx below a folder; sink gets the outcome rows of a batch, once they are complete."""
    files = _decks(spark, folder)

    def batch(df: DataFrame, number: int) -> None:
        result, _ = engine.check(tables_of(df.select(F.col("path").alias("deck_id"), "content")), profile, include)
        sink(result, number)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


COUNTS = "key string, value string, weight double, support long"


def learned(counts: DataFrame) -> DataFrame:
    """One classification for each convention, from counts (key, value, weight, support) of any number of batches."""
    summed = counts.groupBy("key", "value").agg(F.sum("weight").alias("weight"), F.sum("support").alias("support"))
    return stats.classify(stats.ranked(summed, ["key"]), ["key"], stats.SUPPORT["deck"])


def observed(tables: dict[str, DataFrame]) -> DataFrame:
    """Counts of what decks show of their conventions."""
    return learn.observations(tables).groupBy("key", "value").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("support"))


def learn_from(spark: SparkSession, folder: str, state: str, sink: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int | None = None) -> StreamingQuery:
    """Learn from every new .pptx below a folder. A batch adds its counts to the table at `state`, and sink gets the
    classifications of all decks so far, which are those of one batch over all of them."""

    def batch(df: DataFrame, number: int) -> None:
        append_once(observed(tables_of(df.select(F.col("path").alias("deck_id"), "content"))), state, number)
        sink(learned(spark.read.schema(COUNTS).parquet(state)), number)

    return _decks(spark, folder, files_per_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, keys: list[str], at: str, gap: str, late: str | None = None) -> DataFrame:
    """keys, started, ended, n: runs of events of a key without a pause of `gap`; a run ends that long after its last event.

    With `late`, for streams: a session is final once events so much later have come, and what comes later still is dropped
    and counted by `late_rows`.
    """
    rows = events.where(F.col(at).isNotNull())
    rows = rows.withWatermark(at, late) if late else rows
    grouped = rows.groupBy(*keys, F.session_window(at, gap).alias("window")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(*keys, F.col("window.start").alias("started"), F.col("window.end").alias("ended"), "n")


def keep_sessions(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the final rows of a stream of sessions below path, each batch once."""
    return stream.writeStream.outputMode("append").foreachBatch(lambda rows, number: append_once(rows, path, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them and were left out, over the query's reported batches."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
