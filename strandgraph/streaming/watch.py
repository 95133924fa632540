"""File-change streams: debounced syncs and the set of pending paths."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANGE_EVENTS = T.StructType([
    T.StructField("project", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])
# Quiet time before a sync in milliseconds, and its bounds.
DEBOUNCE_MS, LEAST_MS, MOST_MS = 2000, 100, 60_000


def debounce_ms(value: str | int | None) -> int:
    """A configured quiet time brought into its bounds; the default if it is no number."""
    try:
        return min(max(int(value), LEAST_MS), MOST_MS)
    except (TypeError, ValueError):
        return DEBOUNCE_MS


def change_stream(spark: SparkSession, folder: str, fmt: str = "json") -> DataFrame:
    """Change events dropped as files into a folder."""
    return spark.readStream.schema(CHANGE_EVENTS).format(fmt).load(folder)


def bursts(events: DataFrame, quiet_ms: int = DEBOUNCE_MS, late: str = "10 seconds") -> DataFrame:
    """One row per burst of changes of a project, emitted once it has been quiet long enough.

    Session windows keep one state row per open burst; the partial merge before the shuffle
    keeps a busy project cheap. Works on streams and on static frames alike.
    """
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    window = F.session_window("ts", f"{quiet_ms} milliseconds")
    return events.groupBy("project", window.alias("burst")).agg(
        F.count("*").alias("events"), F.max("ts").alias("last_ts")).select(
        "project", F.col("burst.start").alias("started"), "last_ts", "events")


def changed_paths(events: DataFrame, late: str = "10 seconds", every: str = "10 seconds") -> DataFrame:
    """Distinct changed paths per time slice with the last change, for the sync that follows."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", every).alias("w"), "project", "path").agg(F.max("ts").alias("ts")).select(
        "project", "path", "ts")


def run_sync(events: DataFrame, sync: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False):
    """Call `sync(paths, batch_id)` with the distinct paths of every micro-batch.

    A batch is repeated after a failure with the same id, so a sync that writes by key stays
    exact. `available_now` catches up and stops, to be awaited before the first query.
    """
    def batch(frame: DataFrame, batch_id: int) -> None:
        sync(frame.groupBy("project", "path").agg(F.max("ts").alias("ts")), batch_id)

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
