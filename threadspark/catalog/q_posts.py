"""Checks of projections, links and rendered text."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadspark.catalog.inputs import AS_OF, SIGHT_AS_OF, Inputs
from threadspark.catalog.registry import query
from threadspark.functions import text
from threadspark.functions.times import minute_text, ntz
from threadspark.operators import links, notes, render
from threadspark.plans import rules
from threadspark.session import fresh_path
from threadspark.sinks.files import folder, note_path, write_text

CLOCK = f"TIMESTAMP '{AS_OF}'"
LABEL_SQL = """CASE WHEN post_flair IS NULL OR post_flair = '' THEN 'N/A'
  WHEN contains(post_flair, ':') THEN trim(split_part(post_flair, ':', 1)) ELSE post_flair END"""
PERMALINK_SQL = r"'https?://(?:www\.)?reddit\.com/r/[^/]+/comments/([a-z0-9]+)(?:/[^/\s]*)?'"
URL_SQL = r"'https?://[^\s)\]]+'"
LINKS_SQL = f"""links AS (
  SELECT DISTINCT post_id, url FROM (
    SELECT post_id, url_overridden_by_dest AS url FROM posts WHERE url_overridden_by_dest IS NOT NULL
    UNION ALL SELECT post_id, unnest(regexp_extract_all(selftext, {URL_SQL})) FROM posts))"""
RESOLVED_SQL = f"""resolved AS (
  SELECT l.post_id, l.url, coalesce('[[' || s.subreddit || '_' || s.post_id || ']]', l.url) AS link
  FROM links l LEFT JOIN known_state s ON s.post_id = regexp_extract(l.url, {PERMALINK_SQL}, 1))"""
JOINED_SQL = """joined AS (
  SELECT post_id, string_agg(link, ', ' ORDER BY first_url) AS post_links
  FROM (SELECT post_id, link, min(url) AS first_url FROM resolved GROUP BY post_id, link) GROUP BY post_id)"""
INLINE_SQL = f"""inlined AS (
  SELECT p.post_id, CASE WHEN s.post_id IS NULL THEN p.selftext ELSE replace(p.selftext,
      regexp_extract(p.selftext, {URL_SQL}), '[[' || s.subreddit || '_' || s.post_id || ']]') END AS selftext
  FROM posts p LEFT JOIN known_state s ON s.post_id = regexp_extract(p.selftext, {PERMALINK_SQL}, 1))"""


@query("label", f"SELECT post_id, {LABEL_SQL} AS label FROM posts")
def label(i: Inputs):
    return i.posts.select("post_id", text.label(F.col("post_flair")).alias("label"))


@query(
    "note_name",
    """SELECT post_id, subreddit || '_' || post_id AS note_name, '[[' || subreddit || '_' || post_id || ']]' AS wiki_link
       FROM posts""",
)
def note_name(i: Inputs):
    named = i.posts.withColumn("subreddit", F.concat(F.lit("r/"), "subreddit"))
    sub, post_id = F.col("subreddit"), F.col("post_id")
    return named.select(
        "post_id", text.note_name(sub, post_id).alias("note_name"), text.wiki_link(sub, post_id).alias("wiki_link")
    )


@query(
    "date_fields",
    f"""SELECT post_id, strftime(created_utc, '%Y-%m-%d %H:%M') AS date_created,
       strftime({CLOCK}, '%Y-%m-%d %H:%M') AS date_scraped FROM posts""",
)
def date_fields(i: Inputs):
    return i.posts.select(
        "post_id",
        minute_text(F.col("created_utc")).alias("date_created"),
        minute_text(ntz(AS_OF)).alias("date_scraped"),
    )


@query(
    "rescrape_after",
    f"""SELECT post_id, created_utc + INTERVAL '2400' HOUR AS rescrape_after FROM posts
        WHERE created_utc > {CLOCK} - INTERVAL '2400' HOUR""",
)
def rescrape_after(i: Inputs):
    visit = rules.rescrape_after(F.col("created_utc"), 2400, AS_OF)
    return i.posts.select("post_id", visit.alias("rescrape_after")).filter("rescrape_after IS NOT NULL")


@query(
    "extract_urls",
    rf"SELECT post_id, array_to_string(regexp_extract_all(selftext, {URL_SQL}), ' ') AS urls FROM posts",
)
def extract_urls(i: Inputs):
    return i.posts.select("post_id", F.array_join(text.urls(F.col("selftext")), " ").alias("urls"))


@query(
    "permalink_id",
    f"""SELECT post_id, regexp_extract(url_overridden_by_dest, {PERMALINK_SQL}, 1) AS linked_id FROM posts
        WHERE regexp_matches(url_overridden_by_dest, {PERMALINK_SQL})""",
)
def permalink_id(i: Inputs):
    linked = text.permalink_id(F.col("url_overridden_by_dest"))
    return i.posts.select("post_id", linked.alias("linked_id")).filter("linked_id IS NOT NULL")


@query(
    "post_urls",
    f"""WITH {LINKS_SQL}
        SELECT p.post_id, coalesce(u.urls, '') AS urls FROM posts p LEFT JOIN
        (SELECT post_id, string_agg(url, ' ' ORDER BY url) AS urls FROM links GROUP BY post_id) u ON p.post_id = u.post_id""",
)
def post_urls(i: Inputs):
    found = links.post_urls(F.col("url_overridden_by_dest"), F.col("selftext"))
    return i.posts.select("post_id", F.array_join(found, " ").alias("urls"))


@query("resolve_links", f"WITH {LINKS_SQL}, {RESOLVED_SQL} SELECT post_id, url, link FROM resolved")
def resolve_links(i: Inputs):
    return links.resolve_links(links.post_edges(i.posts), i.known_state).select("post_id", "url", "link")


@query("post_links", f"WITH {LINKS_SQL}, {RESOLVED_SQL}, {JOINED_SQL} SELECT post_id, post_links FROM joined")
def post_links(i: Inputs):
    return links.post_links(i.posts, i.known_state)


@query("inline_links", f"WITH {INLINE_SQL} SELECT post_id, selftext FROM inlined")
def inline_links(i: Inputs):
    return links.inline_links(i.posts.select("post_id", "selftext"), ["post_id"], "selftext", i.known_state)


BOOL_SQL = "CASE WHEN p.over_18 THEN 'True' ELSE 'False' END"
NOTE_SQL = f"""notes_text AS (
  SELECT p.post_id, p.subreddit, p.k, '---' || chr(10)
    || 'post_URL: https://reddit.com' || p.permalink || chr(10) || 'community: ' || p.subreddit || chr(10)
    || 'flair: ' || coalesce(p.post_flair, '') || chr(10) || 'author: ' || p.author || chr(10)
    || 'subreddit: ' || p.subreddit || chr(10)
    || 'date_posted: ' || strftime(p.created_utc, '%Y-%m-%d') || chr(10)
    || 'date_created: ' || strftime(p.created_utc, '%Y-%m-%d %H:%M') || chr(10)
    || 'date_scraped: ' || strftime({CLOCK}, '%Y-%m-%d %H:%M') || chr(10)
    || 'post_id: ' || p.post_id || chr(10) || 'score: ' || CAST(p.score AS VARCHAR) || chr(10)
    || 'upvote_ratio: ' || CAST(p.upvote_ratio AS VARCHAR) || chr(10)
    || 'comments_count: ' || CAST(p.num_comments AS VARCHAR) || chr(10) || 'is_nsfw: ' || {BOOL_SQL} || chr(10)
    || CASE WHEN p.created_utc > {CLOCK} - INTERVAL '2400' HOUR
         THEN 'rescrape_after: ' || strftime(p.created_utc + INTERVAL '2400' HOUR, '%Y-%m-%dT%H:%M:%S') || chr(10)
         ELSE '' END
    || coalesce('post_links: ' || j.post_links || chr(10), '')
    || 'tags: ' || chr(10) || '  - reddit' || chr(10) || '  - ' || p.subreddit || chr(10) || '---' || chr(10)
    || '# ' || p.title || chr(10) || chr(10) || t.selftext || chr(10) || chr(10) || '---' || chr(10)
    || '## Top Comments' || chr(10) || chr(10) || chr(10) || chr(10) || chr(10) AS content
  FROM captured p JOIN inlined t ON p.post_id = t.post_id LEFT JOIN joined j ON p.post_id = j.post_id)"""
NOTES_WITH_SQL = f"WITH {LINKS_SQL}, {RESOLVED_SQL}, {JOINED_SQL}, {INLINE_SQL}, {NOTE_SQL}"


def all_notes(i: Inputs):
    return render.render_posts(i.posts, AS_OF, state=i.known_state, hours=2400).select("post_id", "content")


@query("render_post", f"{NOTES_WITH_SQL} SELECT post_id, content FROM notes_text")
def render_post(i: Inputs):
    return all_notes(i)


@query(
    "note_update",
    rf"""{NOTES_WITH_SQL}
        SELECT n.post_id, p.subreddit || '/' || p.subreddit || '_' || p.post_id || '.md' AS path,
          regexp_replace(regexp_replace(regexp_replace(n.content, '\nscore: \d+', chr(10) || 'score: ' || CAST(p.score + 7 AS VARCHAR)),
            '\nrescrape_after: [^\n]*', ''), '\n---\n', chr(10) || 'rescraped_date: 2024-01-31 00:00' || chr(10) || '---' || chr(10))
          || chr(10) || 'again' AS content
        FROM notes_text n JOIN posts p ON n.post_id = p.post_id JOIN known_state s ON s.post_id = p.post_id""",
)
def note_update(i: Inputs):
    posts = i.posts
    written = all_notes(i).join(posts.select("post_id", note_path(posts, "subreddit").alias("path")), "post_id")
    known = posts.join(i.known_state.select("post_id"), "post_id", "left_semi")
    updates = known.select("post_id", (F.col("score") + 7).alias("score"), F.lit("again").alias("update_block"))
    return notes.patch_notes(written, updates, SIGHT_AS_OF)


@query(
    "group_by_folder",
    """SELECT post_id, coalesce(regexp_replace(post_flair, '[\\\\/*?:"<>|]', '', 'g'), 'post_flair') AS by_flair,
         subreddit || '/' || subreddit || '_' || post_id || '.md' AS by_subreddit, 'mood' AS by_missing FROM posts""",
)
def group_by_folder(i: Inputs):
    posts = i.posts
    return posts.select(
        "post_id",
        folder(posts, "post_flair").alias("by_flair"),
        note_path(posts, "subreddit").alias("by_subreddit"),
        folder(posts, "mood").alias("by_missing"),
    )


@query(
    "dashboard",
    f"""SELECT post_id, last_scrape_timestamp,
       CASE WHEN rescrape_after IS NULL THEN '✅' WHEN {CLOCK} < rescrape_after THEN '⏳ *Maturing*' ELSE '🔄 *Pending*' END AS status,
       coalesce(label, '') AS label,
       CASE WHEN file_path IS NULL THEN title ELSE '[[' || subreddit || '_' || post_id || '.md|' || title || ']]' END AS title,
       CAST(score AS VARCHAR) AS score, sort_method AS sort,
       strftime(post_timestamp, '%Y-%m-%d %H:%M') AS post_date,
       strftime(last_scrape_timestamp, '%Y-%m-%d %H:%M') AS last_scrape,
       CASE WHEN rescrape_after IS NULL THEN '-' WHEN {CLOCK} < rescrape_after
         THEN strftime(rescrape_after, '%Y-%m-%d %H:%M') ELSE '**Ready Now**' END AS rescrape_after
       FROM known_state""",
)
def dashboard(i: Inputs):
    return render.dashboard(i.known_state, AS_OF)


BOARD_LINE_SQL = f"""'| ' || CASE WHEN rescrape_after IS NULL THEN '✅' WHEN {CLOCK} < rescrape_after THEN '⏳ *Maturing*'
         ELSE '🔄 *Pending*' END || ' | ' || coalesce(label, '') || ' | '
       || CASE WHEN file_path IS NULL THEN title ELSE '[[' || subreddit || '_' || post_id || '.md|' || title || ']]' END
       || ' | ' || CAST(score AS VARCHAR) || ' | ' || sort_method || ' | ' || strftime(post_timestamp, '%Y-%m-%d %H:%M')
       || ' | ' || strftime(last_scrape_timestamp, '%Y-%m-%d %H:%M') || ' | '
       || CASE WHEN rescrape_after IS NULL THEN '-' WHEN {CLOCK} < rescrape_after
         THEN strftime(rescrape_after, '%Y-%m-%d %H:%M') ELSE '**Ready Now**' END || ' |'"""


@query("dashboard_lines", f"SELECT post_id, {BOARD_LINE_SQL} AS line FROM known_state")
def dashboard_lines(i: Inputs):
    return render.dashboard_lines(render.dashboard(i.known_state, AS_OF))


@query(
    "dashboard_text",
    f"""SELECT {BOARD_LINE_SQL} AS line FROM known_state
        UNION ALL SELECT unnest(['{"', '".join(render.DASHBOARD_HEAD)}'])""",
)
def dashboard_text(i: Inputs):
    path = fresh_path(i.spark, "dashboard")
    write_text(render.dashboard_text(render.dashboard(i.known_state, AS_OF)), path)
    return i.spark.read.text(path).withColumnRenamed("value", "line")
