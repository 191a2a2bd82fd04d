"""Fixed shapes of the state table, the clean post and a routine row."""

from __future__ import annotations

# The 24 columns of the state table, in order.
STATE_COLUMNS = {
    "post_id": "string",
    "title": "string",
    "author": "string",
    "subreddit": "string",
    "label": "string",
    "score": "int",
    "sort_method": "string",
    "post_timestamp": "timestamp_ntz",
    "first_scrape_timestamp": "timestamp_ntz",
    "last_scrape_timestamp": "timestamp_ntz",
    "rescrape_after": "timestamp_ntz",
    "file_path": "string",
    "json_path": "string",
    "ignored_reason": "string",
    "upvote_ratio": "double",
    "num_comments": "int",
    "domain": "string",
    "is_nsfw": "boolean",
    "is_video": "boolean",
    "is_gallery": "boolean",
    "post_flair": "string",
    "selftext_snippet": "string",
    "comments_dump": "string",
    "ingestion_history": "string",
}

# Columns a later scrape overwrites, and columns it only overwrites with a value.
CORE_COLUMNS = [
    "title", "author", "subreddit", "label", "score", "sort_method", "post_timestamp",
    "last_scrape_timestamp", "rescrape_after", "file_path", "json_path", "ignored_reason",
]
RICH_COLUMNS = [
    "upvote_ratio", "num_comments", "domain", "is_nsfw", "is_video", "is_gallery",
    "post_flair", "selftext_snippet", "comments_dump", "ingestion_history",
]

# Names of columns in older state tables.
RENAMED_STATE_COLUMNS = {"id": "post_id", "project": "label", "source": "subreddit"}

STATE_DDL = ", ".join(f"{name} {kind}" for name, kind in STATE_COLUMNS.items())
