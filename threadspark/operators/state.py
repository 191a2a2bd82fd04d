"""The tracking table: lookups, upserts, retention, reconciliation, rebuild."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadspark.functions.text import BLANKS, digits_or_zero
from threadspark.functions.times import epoch_micros, ntz, parse_iso, parse_plain
from threadspark.plans.rules import is_due
from threadspark.schema import CORE_COLUMNS, RICH_COLUMNS, STATE_COLUMNS
from threadspark.session import cut_lineage

#: Touched rows of a batch that are broadcast to the state; more of them are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Equal time slices that one round of the search for the oldest row kept counts.
SLICES = 16_384
#: Rows left in a slice that are sorted.
FEW_ROWS = 10_000


def conform(rows: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Rows with exactly the state columns, in order; missing ones are null. ``extra`` columns follow."""
    present = set(rows.columns)
    return rows.select(
        *[
            (F.col(name) if name in present else F.lit(None)).cast(kind).alias(name)
            for name, kind in STATE_COLUMNS.items()
        ],
        *extra,
    )


def known_ids(state: DataFrame) -> DataFrame:
    """Ids in the state; the state holds each once."""
    return state.select("post_id")


def lookup(feed: DataFrame, state: DataFrame) -> DataFrame:
    """Every feed entry beside what the state knows about it."""
    slim = state.select("post_id", F.lit(True).alias("known"), "rescrape_after")
    joined = feed.join(slim, "post_id", "left")
    return joined.withColumn("known", F.coalesce("known", F.lit(False)))


def unknown_posts(feed: DataFrame, state: DataFrame) -> DataFrame:
    return feed.join(known_ids(state), "post_id", "left_anti")


def needs_scrape(feed: DataFrame, state: DataFrame, as_of: datetime) -> DataFrame:
    """Entries that are new, or known and due again; ``first_scrape`` tells which."""
    due = F.coalesce(is_due(F.col("rescrape_after"), as_of), F.lit(False))
    wanted = lookup(feed, state).filter(~F.col("known") | due)
    return wanted.withColumn("first_scrape", ~F.col("known"))


def hits(feed: DataFrame, state: DataFrame, as_of: datetime) -> DataFrame:
    """Known entries that are not due: they are only recorded as seen."""
    due = F.coalesce(is_due(F.col("rescrape_after"), as_of), F.lit(False))
    return feed.join(state.filter(~due).select("post_id"), "post_id", "left_semi")


def maturing(state: DataFrame, as_of: datetime, subreddit: str | None = None) -> DataFrame:
    """State rows whose next visit is due, of one community if named."""
    due = state.filter(is_due(F.col("rescrape_after"), as_of))
    return due if subreddit is None else due.filter(F.col("subreddit") == subreddit)


def detailed(posts: DataFrame, keep: Column) -> DataFrame:
    """Posts with the rich state columns, filled where ``keep`` is true."""
    rich: dict[str, Column] = {
        "upvote_ratio": F.col("upvote_ratio"),
        "num_comments": F.col("num_comments"),
        "domain": F.col("domain"),
        "is_nsfw": F.col("over_18"),
        "is_video": F.col("is_video"),
        "is_gallery": F.col("is_gallery"),
        "post_flair": F.col("post_flair"),
        "selftext_snippet": F.col("selftext"),
    }
    return posts.withColumns({name: F.when(keep, value) for name, value in rich.items()})


def latest(
    batch: DataFrame, columns: Sequence[str], when: str, keep_values: Sequence[str] = (), earliest: Sequence[str] = ()
) -> DataFrame:
    """One row per post of a batch that may hold several: the last value of each column.

    Columns in ``keep_values`` take their last value that is not null, those in
    ``earliest`` their smallest. All of it combines on the map side, so a post with
    many copies does not gather them in one task.
    """
    whole = F.max_by(F.struct(*[c for c in columns if c not in keep_values]), when).alias("_row")
    values = [F.expr(f"max_by({c}, {when}) FILTER (WHERE {c} IS NOT NULL)").alias(c) for c in keep_values]
    starts = [F.min(c).alias(c) for c in earliest]
    return batch.groupBy("post_id").agg(whole, *values, *starts).select("post_id", "_row.*", *keep_values, *earliest)


def split_touched(state: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state's rows of the posts in ``ids`` (post_id), and all others.

    The ids are written once and counted; few of them are broadcast, so that the state isn't shuffled.
    """
    ids = cut_lineage(ids.select("post_id").filter("post_id is not null").distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return state.join(ids, "post_id", "left_semi"), state.join(ids, "post_id", "left_anti")


def first_changes(touched: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows that a batch of first scrapes adds or replaces; ``touched`` has the state's rows of its posts."""
    rows = [c for c in STATE_COLUMNS if c not in ("post_id", "first_scrape_timestamp")]
    fresh = latest(batch, rows, "last_scrape_timestamp", earliest=["first_scrape_timestamp"])
    known = touched.select("post_id", F.col("first_scrape_timestamp").alias("_first"))
    first = F.coalesce("_first", "first_scrape_timestamp")
    return conform(fresh.join(known, "post_id", "left").withColumn("first_scrape_timestamp", first))


def later_changes(touched: DataFrame, batch: DataFrame) -> DataFrame:
    """The known rows that a batch of later scrapes replaces: core columns by its values, rich ones by a value that isn't null."""
    fresh = latest(batch, [*CORE_COLUMNS, *RICH_COLUMNS], "last_scrape_timestamp", RICH_COLUMNS)
    both = touched.alias("old").join(fresh.alias("new"), "post_id")
    out = []
    for c in STATE_COLUMNS:
        if c in CORE_COLUMNS:
            out.append(F.col(f"new.{c}").alias(c))
        elif c in RICH_COLUMNS:
            out.append(F.coalesce(f"new.{c}", f"old.{c}").alias(c))
        else:
            out.append(F.col(c) if c == "post_id" else F.col(f"old.{c}"))
    return both.select(*out)


def upsert_first(state: DataFrame, batch: DataFrame) -> DataFrame:
    """First-scrape writes: new posts are added, known ones replaced but for their first visit."""
    touched, rest = split_touched(state, batch)
    return conform(rest).unionByName(first_changes(touched, batch))


def update_later(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Later writes: core columns are replaced, rich ones only by a value; unknown ids add no row."""
    touched, rest = split_touched(state, batch)
    return conform(rest).unionByName(later_changes(touched, batch))


def touch_hits(state: DataFrame, seen: DataFrame) -> DataFrame:
    """Posts seen again without a scrape only move their last visit forward."""
    last = cut_lineage(seen.filter("post_id is not null").groupBy("post_id").agg(F.max("ts").alias("_seen")))
    last = F.broadcast(last) if last.count() <= BROADCAST_ROWS else last
    moved = state.join(last, "post_id", "left")
    latest_visit = F.greatest("last_scrape_timestamp", "_seen")
    return moved.withColumn("last_scrape_timestamp", latest_visit).select(*state.columns)


def newest_first(state: DataFrame) -> DataFrame:
    return state.orderBy(F.desc("last_scrape_timestamp"), "post_id")


def _time_of_rank(keys: DataFrame, rank: int) -> tuple[int, int] | None:
    """The ``rank``-th largest ``seen`` of ``keys`` and the rank within the rows that share it; null for fewer rows.

    Each round counts equal slices of the range that is left and goes on in the one that holds the rank: a slice per row reaches the driver.
    """
    low, high, rows = keys.agg(F.min("seen"), F.max("seen"), F.count(F.lit(1))).first()
    if rows < rank:
        return None
    while low < high:
        width = -(-(high - low + 1) // SLICES)
        inside = keys.filter(F.col("seen").between(low, high))
        counted = inside.groupBy(F.expr(f"(seen - {low}L) div {width}L").alias("slice")).count()
        for place, count in sorted(counted.collect(), reverse=True):
            if rank <= count:
                break
            rank -= count
        low, high = low + place * width, min(high, low + (place + 1) * width - 1)
    return low, rank


def _id_of_rank(ids: DataFrame, rank: int) -> str:
    """The ``rank``-th ``post_id`` in order, found by the counts of ever longer beginnings."""
    start, count = "", None
    while count is None or count > FEW_ROWS:
        length = len(start) + 1
        inside = ids.filter(F.startswith("post_id", F.lit(start)))
        counted = inside.groupBy(F.substring("post_id", 1, length).alias("head")).count()
        # as many beginnings as there are characters that can follow; code points sort as Spark sorts texts
        for head, count in sorted(counted.collect()):
            if rank <= count:
                break
            rank -= count
        if len(head) < length:
            return head
        start = head
    last = ids.filter(F.startswith("post_id", F.lit(start))).orderBy("post_id").limit(rank)
    return last.agg(F.max("post_id")).first()[0]


def prune(state: DataFrame, keep_rows: int) -> DataFrame:
    """State with ``keep``: false for the oldest rows beyond the limit; a limit of 0 keeps all. Of equal times the smallest ids stay.

    The last row that stays is selected by counts of time slices and then of the ids of its time; nothing is sorted or written, and the
    table itself is compared with that one row. Rows never visited are the oldest.
    """
    never = epoch_micros(F.expr("TIMESTAMP_NTZ '0001-01-01 00:00:00'"))
    seen = F.coalesce(epoch_micros(F.col("last_scrape_timestamp")), never)
    found = _time_of_rank(state.select(seen.alias("seen")), keep_rows) if keep_rows > 0 else None
    if found is None:
        return state.withColumn("keep", F.lit(True))
    edge, rank = found
    last = _id_of_rank(state.filter(seen == edge).select("post_id"), rank)
    return state.withColumn("keep", (seen > edge) | ((seen == edge) & (F.col("post_id") <= F.lit(last))))


def _named(column: str) -> Column:
    """A file name, or a text no file has where there is none, so that such rows do not share one key."""
    return F.coalesce(F.col(column), F.concat(F.lit("/no file/"), F.col("post_id")))


def reconcile(state: DataFrame, md_files: DataFrame, json_files: DataFrame) -> DataFrame:
    """Verdict per state row whose files are incomplete.

    A missing note or JSON drops the row and asks for the other file to be deleted.
    Files are only expected where the state names them.
    """
    rows = state.select(
        "post_id",
        F.col("file_path").isNotNull().alias("_md"), _named("file_path").alias("_md_key"),
        F.col("json_path").isNotNull().alias("_js"), _named("json_path").alias("_js_key"),
    )
    md = md_files.select(F.col("path").alias("_md_key"), F.lit(True).alias("_md_found"))
    js = json_files.select(F.col("path").alias("_js_key"), F.lit(True).alias("_js_found"))
    joined = rows.join(md, "_md_key", "left").join(js, "_js_key", "left")
    md_missing = F.col("_md") & F.col("_md_found").isNull()
    json_missing = F.col("_js") & F.col("_js_found").isNull()
    return joined.select(
        "post_id",
        (md_missing | json_missing).alias("drop_row"),
        (md_missing & F.col("_js_found").isNotNull()).alias("delete_json"),
        (json_missing & F.col("_md_found").isNotNull()).alias("delete_md"),
    )


def reconcile_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(
        F.count_if("drop_row").alias("dropped_rows"),
        F.count_if("delete_json").alias("deleted_json"),
        F.count_if("delete_md").alias("deleted_md"),
    )


def apply_edits(state: DataFrame, frontmatter: DataFrame) -> DataFrame:
    """User edits in notes win: a changed flair, and a removed revisit line cancels the visit.

    Notes without frontmatter change nothing.
    """
    edits = frontmatter.filter(F.size("frontmatter") > 0).select(
        F.col("path").alias("_key"),
        F.try_element_at("frontmatter", F.lit("flair")).alias("_flair"),
        F.try_element_at("frontmatter", F.lit("rescrape_after")).alias("_visit"),
        F.lit(True).alias("_note"),
    )
    joined = state.withColumn("_key", _named("file_path")).join(edits, "_key", "left")
    edited = F.coalesce("_flair", F.lit("")) != ""
    cancelled = F.col("_note") & (F.coalesce("_visit", F.lit("")) == "")
    return joined.withColumns(
        {
            "label": F.when(edited, F.col("_flair")).otherwise(F.col("label")),
            "rescrape_after": F.when(F.coalesce(cancelled, F.lit(False)), F.lit(None)).otherwise(F.col("rescrape_after")),
        }
    ).select(*state.columns)


def rebuild(notes: DataFrame, state: DataFrame, as_of: datetime) -> DataFrame:
    """State rows for notes whose post id is not in the state.

    ``notes`` has ``path, content, frontmatter``. The title is the first heading
    after the frontmatter, else the file name.
    """
    def value(key: str) -> Column:
        return F.try_element_at("frontmatter", F.lit(key))

    body = F.regexp_replace("content", r"(?s)\A---\n.*?\n---\n", "")
    heading = F.nullif(F.regexp_extract(body, r"(?m)^# (.*)$", 0), F.lit(""))
    file_name = F.element_at(F.split("path", "/"), -1)
    posted = parse_plain(value("date_posted"), r"^\d{4}-\d{2}-\d{2}$")
    rows = notes.filter(value("post_id").isNotNull()).select(
        value("post_id").alias("post_id"),
        F.coalesce(F.btrim(F.substring(heading, 3, 2**31 - 1), F.lit(BLANKS)), file_name).alias("title"),
        F.coalesce(value("author"), F.lit("N/A")).alias("author"),
        F.coalesce(value("subreddit"), F.lit("N/A")).alias("subreddit"),
        F.coalesce(value("flair"), F.lit("N/A")).alias("label"),
        digits_or_zero(F.coalesce(value("score"), F.lit("0"))).alias("score"),
        F.lit("rebuilt").alias("sort_method"),
        F.coalesce(posted, ntz(as_of)).alias("post_timestamp"),
        ntz(as_of).alias("first_scrape_timestamp"),
        ntz(as_of).alias("last_scrape_timestamp"),
        parse_iso(value("rescrape_after")).alias("rescrape_after"),
        F.col("path").alias("file_path"),
    )
    new = rows.join(known_ids(state), "post_id", "left_anti")
    columns = [c for c in rows.columns if c != "post_id"]
    # two notes of one post: the first path wins
    return new.groupBy("post_id").agg(*[F.min_by(c, "file_path").alias(c) for c in columns])
