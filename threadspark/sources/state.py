"""Tracking state: versioned snapshots, older layouts, import from a log."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadspark.functions.times import ntz, parse_plain
from threadspark.operators.state import BROADCAST_ROWS, conform, known_ids
from threadspark.schema import RENAMED_STATE_COLUMNS, STATE_DDL

#: Versions of changed rows that are read together before the whole table is written again.
COMPACT_AFTER = 16


class Snapshots:
    """A table with one row per ``key``, kept as one folder per version, with an append-only list of versions.

    A version counts once it is listed, after its folder is complete, so a lost job leaves the previous version
    in place. Folders have names of their own: nothing that is listed is ever written again. A version may name the stream
    and the batch that it holds, so that a batch which comes again is known. A version holds the whole table, or only the rows
    that changed, which reading puts in the place of older ones.
    """

    LISTED = "version long, folder string, stream string, batch long, whole boolean"

    def __init__(self, spark: SparkSession, root: str, ddl: str = STATE_DDL, key: str = "post_id"):
        self.spark = spark
        self.root = root.rstrip("/")
        self.ddl = ddl
        self.key = key

    def _versions(self) -> DataFrame:
        listed = self.spark.read.schema(self.LISTED).parquet(f"{self.root}/versions")
        return listed.withColumn("whole", F.coalesce("whole", F.lit(True)))  # lists of older tables don't say

    def latest(self) -> int | None:
        """Number of the newest version."""
        return self._versions().agg(F.max("version")).first()[0]

    def has(self, stream: str, batch: int) -> bool:
        """Whether a version already holds this batch of this stream."""
        return not self._versions().filter((F.col("stream") == stream) & (F.col("batch") == batch)).isEmpty()

    def start(self) -> "Snapshots":
        """Create the empty version list if this is a new table."""
        self._list([])
        return self

    def _live(self) -> list[tuple[int, str, bool]]:
        """(version, folder, whole) from the newest whole version on; ``COMPACT_AFTER`` bounds their number."""
        listed = self._versions()
        whole = listed.filter("whole").agg(F.max("version")).first()[0] or 0
        return sorted(tuple(r) for r in listed.filter(F.col("version") >= whole).select("version", "folder", "whole").collect())

    def _rows(self, folder: str) -> DataFrame:
        return self.spark.read.schema(self.ddl).parquet(f"{self.root}/data/{folder}")

    def read(self) -> DataFrame:
        """The newest row of each key. Changed rows are few as a rule: their keys are counted and broadcast to the whole version."""
        live = self._live()
        base = self._rows(live[0][1]) if live and live[0][2] else None
        changes = [self._rows(folder).withColumn("_version", F.lit(version)) for version, folder, whole in live if not whole]
        if not changes:
            return self.spark.createDataFrame([], self.ddl) if base is None else base
        columns = [c for c in changes[0].columns if c not in (self.key, "_version")]
        together = reduce(DataFrame.union, changes)
        newest = together.groupBy(self.key).agg(F.max_by(F.struct(*columns), "_version").alias("_row")).select(self.key, "_row.*")
        if base is None:
            return newest
        keys = together.select(self.key).distinct()
        keys = F.broadcast(keys) if together.count() <= BROADCAST_ROWS else keys
        return base.join(keys, self.key, "left_anti").select(newest.columns).union(newest)

    def commit(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        """Write ``rows``, the whole table, as the version after the newest one, list it and return its number."""
        return self._add(rows, stream, batch, True)

    def commit_changes(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        """Write only the rows that are new or other than before. After ``COMPACT_AFTER`` such versions the whole table is written again."""
        version = self._add(rows, stream, batch, False)
        if sum(not whole for _, _, whole in self._live()) >= COMPACT_AFTER:
            version = self.commit(self.read())
        return version

    def _add(self, rows: DataFrame, stream: str | None, batch: int | None, whole: bool) -> int:
        version = (self.latest() or 0) + 1
        folder = f"v{version:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/data/{folder}")
        self._list([(version, folder, stream, batch, whole)])
        return version

    def _list(self, entries: list[tuple]) -> None:
        self.spark.createDataFrame(entries, self.LISTED).coalesce(1).write.mode("append").parquet(f"{self.root}/versions")


def upgrade(rows: DataFrame) -> DataFrame:
    """Rows of an older state table with today's columns."""
    present = set(rows.columns)
    renames = {old: new for old, new in RENAMED_STATE_COLUMNS.items() if old in present and new not in present}
    return conform(rows.withColumnsRenamed(renames))


LOG_TIME = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


def import_log(lines: DataFrame, state: DataFrame, as_of: datetime) -> DataFrame:
    """``post_id, label, first_scrape_timestamp, last_scrape_timestamp`` of unknown posts.

    ``lines`` has one ``line`` of a pipe table per row. Header and rule lines are
    skipped; a bad date becomes ``as_of``; of several lines of a post the earliest
    counts.
    """
    table = lines.filter(
        F.startswith("line", F.lit("|"))
        & ~F.contains("line", F.lit("|--"))
        & ~F.contains("line", F.lit("Post ID"))
    )
    cells = table.select(F.transform(F.split("line", r"\|", -1), lambda cell: F.trim(cell)).alias("c"))
    rows = cells.filter(F.size("c") > 3).select(
        F.col("c")[2].alias("post_id"),
        F.coalesce(parse_plain(F.col("c")[1], LOG_TIME), ntz(as_of)).alias("at"),
        F.col("c")[3].alias("label"),
    )
    new = rows.filter(F.col("post_id") != "").join(known_ids(state), "post_id", "left_anti")
    first = new.groupBy("post_id").agg(F.min(F.struct("at", "label")).alias("f"))
    return first.select(
        "post_id",
        F.col("f.label").alias("label"),
        F.col("f.at").alias("first_scrape_timestamp"),
        F.col("f.at").alias("last_scrape_timestamp"),
    )
