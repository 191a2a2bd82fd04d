"""Checks of the streams; each must equal its batch twin.

Sights land in three slices. After each the stream runs until it has read
everything, from the same checkpoint, as a scheduled job would.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadspark.catalog.inputs import SIGHT_AS_OF, Inputs
from threadspark.catalog.q_state import KIND_HOURS, KIND_SQL
from threadspark.catalog.registry import query
from threadspark.functions.times import to_wall
from threadspark.operators.state import conform
from threadspark.session import fresh_path
from threadspark.sources.state import Snapshots
from threadspark.streaming import streams

SIGHTS_DDL = "event_id long, post_id string, ts timestamp_ntz, routine string, query string, post_date timestamp_ntz, value double, seq long"
# Days the slices end before; the last one has all that is left.
SLICE_ENDS = ("2024-01-11", "2024-01-21", None)
LONG_DELAY = "60 days"


def landing(i: Inputs, folder: str) -> Iterator[None]:
    """Write the next slice of the sights into ``folder`` at each step."""
    sights = i.observations.withColumn("seq", F.col("event_id"))
    start = None
    for end in SLICE_ENDS:
        part = sights
        if end is not None:
            part = part.filter(F.col("ts") < F.expr(f"TIMESTAMP_NTZ '{end} 00:00:00'"))
        if start is not None:
            late = F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{start} 00:00:00'")
            part = part.filter(late if end is not None else late | F.col("ts").isNull())
        part.write.mode("append").parquet(folder)
        start = end
        yield


def append_run(i: Inputs, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table an append stream has written after all slices."""
    folder, out, checkpoint = (fresh_path(i.spark, name) for name in ("landed", "out", "checkpoint"))
    cores = i.spark.sparkContext.defaultParallelism
    for _ in landing(i, folder):
        streams.append_to(build(streams.read_sights(i.spark, folder, SIGHTS_DDL)), out, checkpoint, cores)
    return i.spark.read.parquet(out)


def batch_run(i: Inputs, work: Callable[[DataFrame, int], None]) -> None:
    folder, checkpoint = fresh_path(i.spark, "landed"), fresh_path(i.spark, "checkpoint")
    cores = i.spark.sparkContext.defaultParallelism
    for _ in landing(i, folder):
        streams.each_batch(streams.read_sights(i.spark, folder, SIGHTS_DDL), work, checkpoint, cores)


@query("stream_first_seen", "SELECT DISTINCT post_id FROM observations")
def stream_first_seen(i: Inputs):
    return append_run(i, lambda sights: streams.first_seen(sights, LONG_DELAY)).select("post_id")


@query(
    "stream_age_filter",
    f"SELECT event_id, post_id FROM observations WHERE post_date >= TIMESTAMP '{SIGHT_AS_OF}' - INTERVAL '720' HOUR",
)
def stream_age_filter(i: Inputs):
    return append_run(i, lambda sights: streams.young_enough(sights, 720, SIGHT_AS_OF)).select("event_id", "post_id")


@query("stream_classify", f"WITH {KIND_SQL} SELECT event_id, kind FROM kinds")
def stream_classify(i: Inputs):
    table = Snapshots(i.spark, fresh_path(i.spark, "sights"), streams.SIGHT_STATE).start()
    out = fresh_path(i.spark, "history")
    batch_run(i, streams.classify_into(table, out, KIND_HOURS))
    return i.spark.read.parquet(out).select("event_id", "kind")


DUE_DELAY_HOURS = 24


@query(
    "stream_due",
    f"""SELECT DISTINCT post_id, post_date + INTERVAL '{KIND_HOURS}' HOUR AS due FROM observations
        WHERE ts < post_date + INTERVAL '{KIND_HOURS}' HOUR
        AND post_date + INTERVAL '{KIND_HOURS}' HOUR <= (SELECT max(ts) FROM observations) - INTERVAL '{DUE_DELAY_HOURS}' HOUR""",
)
def stream_due(i: Inputs):
    return append_run(i, lambda sights: streams.due_visits(sights, KIND_HOURS, f"{DUE_DELAY_HOURS} hours"))


def seen_rows(batch: DataFrame) -> DataFrame:
    at = to_wall(F.col("ts"))
    return conform(
        batch.select(
            "post_id", F.concat(F.lit("seen by "), "routine").alias("title"), F.floor("value").cast("int").alias("score"),
            F.col("routine").alias("sort_method"), F.col("post_date").alias("post_timestamp"),
            at.alias("first_scrape_timestamp"), at.alias("last_scrape_timestamp"),
        )
    )


@query(
    "stream_upsert",
    """SELECT post_id, 'seen by ' || routine AS title, CAST(floor(value) AS INT) AS score, post_date AS post_timestamp,
         first_ts AS first_scrape_timestamp, ts AS last_scrape_timestamp
       FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY ts DESC) AS rn,
               min(ts) OVER (PARTITION BY post_id) AS first_ts FROM observations) WHERE rn = 1""",
)
def stream_upsert(i: Inputs):
    table = Snapshots(i.spark, fresh_path(i.spark, "state")).start()
    batch_run(i, streams.upsert_into(table, seen_rows))
    return table.read().select(
        "post_id", "title", "score", "post_timestamp", "first_scrape_timestamp", "last_scrape_timestamp"
    )


@query("stream_history", "SELECT event_id, post_id, ts, routine AS type, query FROM observations")
def stream_history(i: Inputs):
    log = append_run(i, lambda sights: sights.select("event_id", "post_id", "ts", F.col("routine").alias("type"), "query"))
    return log.withColumn("ts", to_wall(F.col("ts")))
