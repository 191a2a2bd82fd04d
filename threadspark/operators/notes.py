"""Changes to notes that already exist."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadspark.functions.times import minute_text, ntz

HEAD = r"(?s)\A(---\n.*?\n)(---\n)(.*)\z"


def patch_notes(notes: DataFrame, updates: DataFrame, as_of: datetime) -> DataFrame:
    """Notes of revisited posts, refreshed.

    ``notes`` has ``post_id, path, content``; ``updates`` has ``post_id, score,
    update_block``. Inside the frontmatter the score is replaced, the revisit line
    dropped and the visit's date added; the update block goes to the end.
    """
    joined = notes.join(updates, "post_id")
    head = F.regexp_extract("content", HEAD, 1)
    body = F.regexp_extract("content", HEAD, 3)
    new_score = F.concat(F.lit("${key}"), F.col("score").cast("string"))
    patched = F.regexp_replace(head, F.lit(r"(?m)^(?<key>score:\s*)\d+"), new_score)
    patched = F.regexp_replace(patched, r"(?m)^rescrape_after:.*$\n", "")
    stamp = F.concat(F.lit("rescraped_date: "), minute_text(ntz(as_of)), F.lit("\n---\n"))
    whole = F.when(head != "", F.concat(patched, stamp, body)).otherwise(F.col("content"))
    return joined.select("post_id", "path", F.concat(whole, F.lit("\n"), F.col("update_block")).alias("content"))
