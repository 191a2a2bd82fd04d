"""Notes on disk and their frontmatter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadspark.functions.text import BLANKS
from threadspark.sources.documents import read_documents

LOG_NAME = "Scrape Log.md"
FRONTMATTER = r"(?s)\A---\n(.*?)\n---\n"


def read_notes(spark: SparkSession, folder: str, log_name: str = LOG_NAME) -> DataFrame:
    """``path, content`` of every note below a folder, but for the log."""
    files = read_documents(spark, folder, "*.md")
    return files.filter(~F.endswith("path", F.lit("/" + log_name.replace(" ", "%20"))))


def _pairs(content: Column) -> Column:
    block = F.regexp_extract(content, FRONTMATTER, 1)
    lines = F.filter(F.split(block, "\n"), lambda line: F.contains(line, F.lit(":")))
    return F.transform(
        lines,
        lambda line: F.struct(
            F.btrim(F.substring_index(line, ":", 1), F.lit(BLANKS)).alias("key"),
            F.btrim(F.substr(line, F.instr(line, ":") + 1), F.lit(BLANKS)).alias("value"),
        ),
    )


def _last_wins(pairs: Column) -> Column:
    keys = F.array_distinct(F.transform(pairs, lambda pair: pair["key"]))
    last = F.transform(keys, lambda key: F.element_at(F.filter(pairs, lambda pair: pair["key"] == key), -1)["value"])
    # only a note that repeats a key looks for its last lines, in time square to their number
    return F.when(F.size(keys) == F.size(pairs), F.map_from_entries(pairs)).otherwise(F.map_from_arrays(keys, last))


def with_frontmatter(notes: DataFrame) -> DataFrame:
    """Adds ``frontmatter``: the ``key: value`` lines of ``content`` as a map.

    The last line of a key counts; a note without frontmatter gets an empty map.
    The lines and the map pass through one-row explodes, so that a later filter on the map is
    not pushed below them and does not make them again.
    """
    split = notes.select("*", F.explode(F.array(_pairs(F.col("content")))).alias("_pairs"))
    return split.select("*", F.explode(F.array(_last_wins(F.col("_pairs")))).alias("frontmatter")).drop("_pairs")
