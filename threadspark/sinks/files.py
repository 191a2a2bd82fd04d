"""Output tables: clean posts as JSON, notes by folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadspark.functions.text import note_name, safe_folder
from threadspark.functions.times import minute_text


def folder(posts: DataFrame, group_by: str) -> Column:
    """Folder of a post's note: the value of any field, or the field's own name without it."""
    if group_by not in posts.columns:
        return safe_folder(F.lit(group_by))
    value = F.col(group_by)
    if posts.schema[group_by].dataType.typeName().startswith("timestamp"):
        value = minute_text(value)
    return safe_folder(F.coalesce(value.cast("string"), F.lit(group_by)))


def note_path(posts: DataFrame, group_by: str | None) -> Column:
    file_name = F.concat(note_name(F.col("subreddit"), F.col("post_id")), F.lit(".md"))
    return file_name if not group_by else F.concat(folder(posts, group_by), F.lit("/"), file_name)


def with_comments(posts: DataFrame, nested: DataFrame) -> DataFrame:
    """Posts with their kept comments as a nested value, an empty list without any."""
    joined = posts.join(nested, "post_id", "left")
    text = F.coalesce("comments_json", F.lit("[]"))
    return joined.withColumn("comments", F.parse_json(text)).drop("comments_json")


def write_json(posts: DataFrame, path: str) -> None:
    """One JSON object per line, many posts per file."""
    posts.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_notes(notes: DataFrame, path: str) -> None:
    """Notes as a table partitioned by ``folder``.

    The rebalance hint gathers small folders and splits large ones by size, so a
    folder that holds most notes is written by many tasks.
    """
    notes.hint("rebalance", "folder").write.mode("errorifexists").partitionBy("folder").parquet(path)


def write_text(lines: DataFrame, path: str) -> None:
    """Lines of the dashboard, in the order given."""
    lines.select("line").write.mode("errorifexists").text(path)
