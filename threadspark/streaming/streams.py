"""Captured sights as streams.

``sights`` is a streaming DataFrame ``post_id, ts, seq, post_date, ...`` whose
``ts`` is an instant (see ``to_instant``), as a watermark needs one.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from threadspark.functions.times import hours_before, to_instant, to_wall
from threadspark.operators.history import kind_moments, sight_kind
from threadspark.operators.state import first_changes, split_touched
from threadspark.sources.state import Snapshots

SALTS = 32
HOUR_MS = 3_600_000


def read_sights(spark: SparkSession, folder: str, ddl: str) -> DataFrame:
    """Parquet files landing in a folder; ``ts`` arrives as UTC wall time."""
    return spark.readStream.schema(ddl).parquet(folder).withColumn("ts", to_instant(F.col("ts")))


def first_seen(sights: DataFrame, delay: str) -> DataFrame:
    """Each post once within the watermark delay.

    Duplicates fall away per slice of a post first, so a post that most sights
    are of reaches the second step with one row per slice.
    """
    return _once(sights.withWatermark("ts", delay))


def _once(marked: DataFrame) -> DataFrame:
    sliced = marked.withColumn("_slice", F.pmod(F.xxhash64("seq"), F.lit(SALTS)))
    once = sliced.dropDuplicatesWithinWatermark(["post_id", "_slice"])
    return once.dropDuplicatesWithinWatermark(["post_id"]).drop("_slice")


def young_enough(sights: DataFrame, hours: float, as_of: datetime) -> DataFrame:
    """Sights of posts not older than ``hours``."""
    return sights.filter(F.col("post_date") >= hours_before(as_of, hours))


def due_visits(sights: DataFrame, hours: float, delay: str) -> DataFrame:
    """``post_id, due``: posts seen while younger than ``hours``, once the watermark passes their due time.

    Each sight opens a session of its post that lasts until the post is due; the sessions of a post overlap, so they are one, which ends
    and is given when it is due.
    """
    marked = sights.withWatermark("ts", delay)
    due = F.unix_micros(to_instant(F.col("post_date"))) + F.lit(int(hours * HOUR_MS) * 1000)
    left = due - F.unix_micros("ts")
    # the watermark comes before the filter: sights of older posts move the clock too
    young = _once(marked.withColumn("_left", left).filter("_left > 0"))
    wait = F.make_interval(secs=(F.col("_left").cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))
    sessions = young.groupBy("post_id", F.session_window("ts", wait).alias("_open")).agg(F.count(F.lit(1)).alias("_sights"))
    return sessions.select("post_id", to_wall(F.col("_open.end")).alias("due"))


PARTITIONS_KEY = "spark.sql.shuffle.partitions"


def _run(
    spark: SparkSession, writer: DataStreamWriter, checkpoint: str, partitions: int | None, path: str | None = None
) -> None:
    """Process everything that is available, then stop.

    A stream's number of state partitions is fixed by its first run, so it is an
    argument here; the session's own setting is back in place once the stream has
    taken its copy.
    """
    before = spark.conf.get(PARTITIONS_KEY)
    if partitions:
        spark.conf.set(PARTITIONS_KEY, str(partitions))
    try:
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    finally:
        spark.conf.set(PARTITIONS_KEY, before)
    query.awaitTermination()


def append_to(stream: DataFrame, path: str, checkpoint: str, partitions: int | None = None) -> None:
    """Append everything that is available to a parquet table and stop."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    _run(stream.sparkSession, writer, checkpoint, partitions, path)


def each_batch(
    stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, partitions: int | None = None
) -> None:
    """Run ``work`` on everything that is available, batch by batch, and stop."""
    _run(stream.sparkSession, stream.writeStream.foreachBatch(work), checkpoint, partitions)


def stream_of(batch: DataFrame) -> str:
    """Id of the query a micro-batch belongs to; its checkpoint keeps it, and a fresh checkpoint has a new one."""
    name = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not name:
        raise RuntimeError("the batch belongs to no streaming query, so a repeated one could not be told from a new one")
    return name


def upsert_into(table: Snapshots, to_rows: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Batch function that adds the rows which a micro-batch changes to a state table; a batch that comes again changes nothing."""
    def work(batch: DataFrame, batch_id: int) -> None:
        stream = stream_of(batch)
        if not table.has(stream, batch_id):
            rows = to_rows(batch)
            touched, _ = split_touched(table.read(), rows)
            table.commit_changes(first_changes(touched, rows), stream, batch_id)

    return work


SIGHT_STATE = "post_id string, first struct<ts:timestamp,seq:long>, young boolean, again struct<ts:timestamp,seq:long>"


def classify_into(table: Snapshots, path: str, hours: float) -> Callable[[DataFrame, int], None]:
    """Batch function that appends every sight with its ``kind`` to a history table.

    Per post only the first sight, whether it was young then, and the revisit are
    kept between batches, so a hot post costs no more state than any other. A batch that comes again
    writes its part of the history again, under the name of its stream, and leaves the state as it is.
    """
    def work(batch: DataFrame, batch_id: int) -> None:
        stream = stream_of(batch)
        due = F.timestamp_micros(F.unix_micros(to_instant(F.col("post_date"))) + F.lit(int(hours * HOUR_MS) * 1000))
        fresh = kind_moments(batch, due)
        first = F.coalesce("first", F.struct("_first.ts", "_first.seq"))
        young = F.coalesce("young", F.col("_first.ts") < F.col("_first.due"))
        if not table.has(stream, batch_id):
            touched, _ = split_touched(table.read(), batch)
            changes = fresh.join(touched, "post_id", "left").select(
                "post_id",
                first.alias("first"),
                young.alias("young"),
                F.coalesce("again", F.when(young, F.col("_late"))).alias("again"),
            )
            table.commit_changes(changes, stream, batch_id)
        touched, _ = split_touched(table.read(), batch)
        marked = batch.join(touched, "post_id")
        history = marked.withColumn("kind", sight_kind(F.col("first"), F.col("again"))).select(*batch.columns, "kind")
        history.write.mode("overwrite").parquet(f"{path}/stream={stream}/batch_id={batch_id}")

    return work
