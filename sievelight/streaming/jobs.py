"""Change streams: priorities, removal of like jobs, lanes, status, debouncing, upserts by micro-batch and watched folders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.store import IndexStore

HIGH, LOW = "HIGH", "LOW"


def in_order(jobs: DataFrame, priority: str = "priority", ts: str = "ts", *ties: str) -> DataFrame:
    """Jobs of high priority first, then by time; the order within a micro-batch."""
    return jobs.orderBy(F.when(F.col(priority) == HIGH, 0).otherwise(1), ts, *ties)


def without_similar(jobs: DataFrame, key: Sequence[str], priority: str = "priority", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """One job of each key: the first of high priority, or else the first."""
    by = Window.partitionBy(*key).orderBy(F.when(F.col(priority) == HIGH, 0).otherwise(1), ts, *([tie] if tie else []))
    return jobs.withColumn("__nth", F.row_number().over(by)).where("__nth = 1").drop("__nth")


def after_clear(jobs: DataFrame, index: str = "index", kind: str = "kind", ts: str = "ts") -> DataFrame:
    """Without the jobs of an index that were queued before its last clear job."""
    last = F.max(F.when(F.col(kind) == "clear", F.col(ts))).over(Window.partitionBy(index))
    return jobs.withColumn("__clear", last).where(F.col("__clear").isNull() | (F.col(ts) >= F.col("__clear"))).drop("__clear")


def lanes(jobs: DataFrame, single: str = "single", key: Sequence[str] = ("index",), many: int = 10) -> DataFrame:
    """jobs with their `lane`: 0 for those that have to run one by one, else one of `many`, the same for all jobs of a key."""
    return jobs.withColumn("lane", F.when(F.col(single), F.lit(0)).otherwise(F.pmod(F.xxhash64(*key), F.lit(many)).cast("int") + 1))


def status(jobs: DataFrame, index: str | None = None, requester: str | None = None, priority: str = "priority", ts: str = "ts") -> DataFrame:
    """Queued jobs of an index, of a requester, of both or all, in the order in which they will run."""
    found = jobs if index is None else jobs.where(F.col("index") == index)
    found = found if requester is None else found.where(F.col("requester") == requester)
    return in_order(found, priority, ts)


def debounce(jobs: DataFrame, key: Sequence[str], gap: str, ts: str = "ts") -> DataFrame:
    """(key.., first, last, n): runs of jobs of a key less than or as much as `gap` apart; each fires once, `gap` after its last.

    A batch and a stream alike; a stream needs a watermark on ts, and the end of its input flushes what is pending.
    """
    session = F.session_window(F.col(ts), gap)
    found = jobs.groupBy(*key, session.alias("w")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))
    return found.select(*key, "first", "last", F.col("w.end").alias("fires"), "n")


def upsert_stream(jobs: DataFrame, store: IndexStore, key: str, order: Sequence[str], deleted: str | None = None, checkpoint: str | None = None, on_batch: Callable[[int, int], None] | None = None):
    """A writer that keeps the store at the latest row of each key, one version for each micro-batch.

    A batch that is repeated after a loss gives the same table again. Rows with `deleted` take their key away.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        by = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
        latest = batch.withColumn("__nth", F.row_number().over(by)).where("__nth = 1").drop("__nth")
        new = latest.where(~F.col(deleted)).drop(deleted) if deleted else latest
        # Only the batch is written: its rows as a segment, and what it replaces as tombstones
        version = store.replace(latest, key, new) if store.exists() else store.publish(new)
        if on_batch:
            on_batch(batch_id, version)

    writer = jobs.writeStream.foreachBatch(publish)
    return writer.option("checkpointLocation", checkpoint) if checkpoint else writer


def watch(spark, path: str, schema: str, files_per_trigger: int = 100, kind: str = "parquet") -> DataFrame:
    """A stream of the rows of new files in a folder."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def watch_folder(spark: SparkSession, root: str, act: Callable[[DataFrame], None], known: DataFrame | None = None, regex: str | None = None, every: str = "5 seconds", rounds: int | None = None, checkpoint: str | None = None):
    """A running query that lists a folder again and again and calls act with (path, action) of what was created, changed or deleted.

    A file source only sees what is new, so each micro-batch is a listing, compared with the one before.
    known: (path, modified) of what is there at the start. Changes that come in one interval are one
    action for each file. rounds: how many listings, without end if None.
    """
    from ..sources.folders import changes, listing

    empty = spark.createDataFrame([], "path string, modified timestamp")
    held = {"known": (known if known is not None else empty).collect(), "left": rounds}  # names and times of one folder's files

    def look(_: DataFrame, batch_id: int) -> None:
        if held["left"] is not None and held["left"] <= 0:
            return
        files = listing(spark, root, regex).select("path", "modified").collect()
        now = spark.createDataFrame(files, empty.schema)
        found = changes(now, spark.createDataFrame(held["known"], empty.schema))
        if not found.isEmpty():
            act(found)
        held["known"] = files
        if held["left"] is not None:
            held["left"] -= 1

    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = ticks.writeStream.foreachBatch(look).trigger(processingTime=every)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def progress(query) -> dict:
    """Batches and rows done so far, and the last batch's duration."""
    last = query.lastProgress or {}
    return {"batch": last.get("batchId"), "rows": last.get("numInputRows"), "rows_per_second": last.get("processedRowsPerSecond"), "ms": last.get("batchDuration"), "active": query.isActive}
