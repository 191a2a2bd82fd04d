"""Checks of captured sources and output tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadspark.catalog.inputs import AS_OF, POST_COLUMNS, SIGHT_AS_OF, Inputs
from threadspark.catalog.q_comments import nested_sql, sorted_node, tree_sql
from threadspark.catalog.q_posts import NOTES_WITH_SQL, all_notes
from threadspark.catalog.q_state import written_notes
from threadspark.catalog.registry import query
from threadspark.operators.comments import PRESETS, nested_comments, trim_tree
from threadspark.session import fresh_path
from threadspark.sinks import files
from threadspark.sources import feeds, state, threads
from threadspark.sources.notes import with_frontmatter

SIGHT_CLOCK = f"TIMESTAMP '{SIGHT_AS_OF}'"

ENTRIES_SQL = """entries AS (
  SELECT subreddit || '/' || CAST(CAST(floor(k / 100) AS BIGINT) AS VARCHAR) AS feed_id,
    CAST(row_number() OVER (PARTITION BY subreddit, floor(k / 100) ORDER BY k) - 1 AS INT) AS pos, post_id,
    'https://www.reddit.com' || permalink AS url, created_utc AS post_date, k % 10 <> 3 AND k % 11 <> 5 AS whole FROM captured)"""


@query("src_feed", f"WITH {ENTRIES_SQL} SELECT feed_id, pos, post_id, url, post_date FROM entries WHERE whole")
def src_feed(i: Inputs):
    return feeds.read_feeds(i.feeds())


@query(
    "src_feed_offset",
    f"""WITH {ENTRIES_SQL} SELECT feed_id, pos - 3 AS pos, post_id, url, post_date FROM entries
        WHERE whole AND pos >= 3 AND pos < 13""",
)
def src_feed_offset(i: Inputs):
    return feeds.read_feeds(i.feeds(), offset=3, cap=10)


COMMUNITIES = ("FURNITURE", "BUILDING", "AUTOMOBILE", "HOUSEHOLD", "MACHINERY")


@query(
    "feed_union",
    " UNION ALL ".join(f"SELECT post_id, {k} AS feed_no FROM posts WHERE subreddit = '{name}'" for k, name in enumerate(COMMUNITIES)),
)
def feed_union(i: Inputs):
    posts = i.posts.select("post_id", "subreddit")
    pages = [posts.filter(F.col("subreddit") == name) for name in COMMUNITIES]
    return feeds.union_feeds(*pages).select("post_id", "feed_no")


@query(
    "direct_targets",
    r"""SELECT post_id, title FROM posts WHERE post_id IN (
          SELECT regexp_extract(url_overridden_by_dest, 'comments/([^/]+)', 1) FROM posts
          WHERE contains(url_overridden_by_dest, 'reddit.com'))""",
)
def direct_targets(i: Inputs):
    targets = i.posts.select(F.col("url_overridden_by_dest").alias("target")).filter("target IS NOT NULL")
    return feeds.direct_targets(targets, i.posts).select("post_id", "title")


@query(
    "src_thread_json",
    """SELECT p.post_id, n.n FROM posts p JOIN (SELECT post_id, count(*) AS n FROM comments GROUP BY post_id) n
       ON p.post_id = n.post_id""",
)
def src_thread_json(i: Inputs):
    # payloads that are no list beside each thread: an error object, a broken document and a null
    payloads = F.array("raw", F.lit('{"error": 404}'), F.lit("[{broken"), F.lit("null"))
    parsed = threads.parse_threads(i.threads().select("post_id", F.explode(payloads).alias("raw")))
    rows = threads.flatten_comments(parsed)
    return rows.groupBy("post_id").agg(F.count("*").alias("n"))


CLEAN_COLUMNS = [c for c in POST_COLUMNS if c not in ("url_overridden_by_dest", "post_flair")]


@query(
    "clean_posts",
    f"""SELECT {', '.join(CLEAN_COLUMNS)}, coalesce(post_flair, '') AS post_flair, '' AS author_flair,
        CAST(0 AS BIGINT) AS subreddit_subscribers, coalesce(url_overridden_by_dest, '-') AS url_overridden_by_dest,
        TIMESTAMP '{AS_OF}' AS scraped_utc
        FROM posts""",
)
def clean_posts(i: Inputs):
    rows = threads.clean_posts(threads.parse_threads(i.threads()), AS_OF)
    return rows.withColumn("url_overridden_by_dest", F.coalesce("url_overridden_by_dest", F.lit("-")))


@query(
    "src_comment_flatten",
    """WITH RECURSIVE tree AS (
         SELECT post_id, comment_id, 0 AS depth, author, score, body, stickied FROM comments WHERE parent_id IS NULL
         UNION ALL
         SELECT c.post_id, c.comment_id, t.depth + 1, c.author, c.score, c.body, c.stickied
         FROM comments c JOIN tree t ON c.parent_id = t.comment_id)
       SELECT post_id, CAST(depth AS INT) AS depth, author, score, body, stickied FROM tree
       WHERE post_id IN (SELECT post_id FROM posts)""",
)
def src_comment_flatten(i: Inputs):
    rows = threads.flatten_comments(threads.parse_threads(i.threads()))
    return rows.select("post_id", "depth", "author", "score", "body", "stickied")


@query(
    "src_notes_frontmatter",
    """SELECT post_id AS note_id, author, CAST(score AS VARCHAR) AS score, '' AS tags FROM captured WHERE k % 8 <> 1""",
)
def src_notes_frontmatter(i: Inputs):
    notes = with_frontmatter(written_notes(i)).filter(F.size("frontmatter") > 0)
    return notes.select(
        *[
            F.try_element_at("frontmatter", F.lit(key)).alias(name)
            for key, name in (("post_id", "note_id"), ("author", "author"), ("score", "score"), ("tags", "tags"))
        ]
    )


@query(
    "src_log_import",
    f"""SELECT post_id, coalesce(post_flair, '') AS label,
          CASE WHEN k % 10 = 3 THEN {SIGHT_CLOCK} ELSE created_utc END AS last_scrape_timestamp
        FROM captured WHERE post_id NOT IN (SELECT post_id FROM known_state)""",
)
def src_log_import(i: Inputs):
    stamp = F.when(F.col("k") % 10 == 3, "last week").otherwise(F.col("created_utc").cast("string"))
    cells = F.concat_ws(" | ", stamp, "post_id", F.coalesce("post_flair", F.lit("")), "title")
    row = F.concat(F.lit("| "), cells, F.lit(" |"))
    # each post's row stands between a header, a rule and a line of prose
    lines = F.array(F.lit("| Date | Post ID | Label |"), F.lit("|--|--|--|"), row, F.lit("prose"), F.lit("| |"))
    log = i.captured.select(F.explode(lines).alias("line"))
    return state.import_log(log, i.known_state, SIGHT_AS_OF).drop("first_scrape_timestamp")


@query(
    "sink_json_roundtrip",
    "SELECT post_id, title, score, upvote_ratio, coalesce(post_flair, '-') AS post_flair, over_18, created_utc FROM posts",
)
def sink_json_roundtrip(i: Inputs):
    posts = i.posts
    path = fresh_path(i.spark, "json")
    files.write_json(posts, path)
    back = i.spark.read.schema(posts.schema).json(path)
    return back.select(
        "post_id", "title", "score", "upvote_ratio", F.coalesce("post_flair", F.lit("-")).alias("post_flair"),
        "over_18", "created_utc",
    )


@query(
    "sink_notes_roundtrip",
    f"""{NOTES_WITH_SQL} SELECT subreddit AS folder, post_id, content FROM notes_text""",
)
def sink_notes_roundtrip(i: Inputs):
    posts = i.posts
    where = posts.select("post_id", files.note_path(posts, "subreddit").alias("path"), files.folder(posts, "subreddit").alias("folder"))
    path = fresh_path(i.spark, "notes")
    files.write_notes(all_notes(i).join(where, "post_id"), path)
    return i.spark.read.parquet(path).select("folder", "post_id", "content")


@query(
    "sink_json_comments",
    f"""WITH RECURSIVE {tree_sql(PRESETS['LG'])}, {nested_sql(sorted_node)}
        SELECT p.post_id, p.title, coalesce(n.comments_json, '[]') AS comments FROM posts p LEFT JOIN nested n ON p.post_id = n.post_id""",
)
def sink_json_comments(i: Inputs):
    nested = nested_comments(trim_tree(i.comments, "LG"))
    path = fresh_path(i.spark, "json")
    files.write_json(files.with_comments(i.posts, nested), path)
    back = i.spark.read.schema("post_id string, title string, comments string").json(path)
    return back.select("post_id", "title", "comments")
