"""Checks of the tracking state and the ingestion history."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadspark.catalog.inputs import AS_OF, SIGHT_AS_OF, Inputs
from threadspark.catalog.q_posts import LABEL_SQL, NOTES_WITH_SQL, all_notes
from threadspark.catalog.registry import query
from threadspark.functions.text import label
from threadspark.functions.times import iso_text, ntz
from threadspark.operators import history, state
from threadspark.sinks.files import note_path
from threadspark.sources.notes import with_frontmatter
from threadspark.sources.state import Snapshots, upgrade
from threadspark.session import fresh_path

CLOCK = f"TIMESTAMP '{AS_OF}'"
SIGHT_CLOCK = f"TIMESTAMP '{SIGHT_AS_OF}'"


def feed(i: Inputs):
    return i.posts.select("post_id", F.col("permalink").alias("url"), F.col("created_utc").alias("post_date"))


query("state_all", "SELECT post_id, title, score, last_scrape_timestamp FROM known_state")(
    lambda i: state.newest_first(i.known_state).select("post_id", "title", "score", "last_scrape_timestamp")
)
query("state_ids", "SELECT post_id FROM known_state")(lambda i: state.known_ids(i.known_state))
query("state_count", "SELECT count(*) AS n FROM known_state")(lambda i: i.known_state.agg(F.count("*").alias("n")))


@query(
    "join_feed_state",
    """SELECT p.post_id, s.post_id IS NOT NULL AS known, coalesce(CAST(s.rescrape_after AS VARCHAR), '-') AS visit
       FROM posts p LEFT JOIN known_state s ON p.post_id = s.post_id""",
)
def join_feed_state(i: Inputs):
    joined = state.lookup(feed(i), i.known_state)
    return joined.select("post_id", "known", F.coalesce(F.col("rescrape_after").cast("string"), F.lit("-")).alias("visit"))


query("anti_new_posts", "SELECT post_id FROM posts WHERE post_id NOT IN (SELECT post_id FROM known_state)")(
    lambda i: state.unknown_posts(feed(i), i.known_state).select("post_id")
)
query(
    "hits",
    f"""SELECT p.post_id FROM posts p JOIN known_state s ON p.post_id = s.post_id
        WHERE s.rescrape_after IS NULL OR NOT s.rescrape_after < {CLOCK}""",
)(lambda i: state.hits(feed(i), i.known_state, AS_OF).select("post_id"))
query(
    "needs_scrape",
    f"""SELECT p.post_id, s.post_id IS NULL AS first_scrape FROM posts p LEFT JOIN known_state s ON p.post_id = s.post_id
        WHERE s.post_id IS NULL OR s.rescrape_after < {CLOCK}""",
)(lambda i: state.needs_scrape(feed(i), i.known_state, AS_OF).select("post_id", "first_scrape"))
query("maturing_due", f"SELECT post_id FROM known_state WHERE rescrape_after < {CLOCK}")(
    lambda i: state.maturing(i.known_state, AS_OF).select("post_id")
)
query(
    "maturing_due_subreddit",
    f"SELECT post_id FROM known_state WHERE rescrape_after < {CLOCK} AND subreddit = 'BUILDING'",
)(lambda i: state.maturing(i.known_state, AS_OF, "BUILDING").select("post_id"))

# A run's writes: every captured post with a JSON file, some of them more than once.
SCRAPED_SQL = f"""scraped AS (
  SELECT post_id, title || ' (edited)' AS title, author, subreddit, {LABEL_SQL} AS label, score + step AS score,
    'top' AS sort_method, created_utc AS post_timestamp, {CLOCK} + step * INTERVAL '1' HOUR AS seen_at,
    CASE WHEN step = 0 THEN domain END AS domain, CASE WHEN score > 250 THEN post_flair END AS post_flair
  FROM posts, (SELECT unnest([0, 1]) AS step) WHERE step = 0 OR spoiler)"""
LATEST_SQL = "latest AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY seen_at DESC) AS rn FROM scraped)"


def scraped(i: Inputs):
    steps = F.when(F.col("spoiler"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = i.posts.withColumn("step", F.explode(steps))
    at = ntz(AS_OF) + F.make_dt_interval(hours=F.col("step"))
    return state.conform(
        rows.select(
            "post_id", F.concat("title", F.lit(" (edited)")).alias("title"), "author", "subreddit",
            label(F.col("post_flair")).alias("label"), (F.col("score") + F.col("step")).alias("score"),
            F.lit("top").alias("sort_method"), F.col("created_utc").alias("post_timestamp"),
            at.alias("first_scrape_timestamp"), at.alias("last_scrape_timestamp"),
            F.when(F.col("step") == 0, F.col("domain")).alias("domain"),
            F.when(F.col("score") > 250, F.col("post_flair")).alias("post_flair"),
        )
    )


@query(
    "state_upsert",
    f"""WITH {SCRAPED_SQL}, {LATEST_SQL}, starts AS (SELECT post_id, min(seen_at) AS seen_at FROM scraped GROUP BY post_id)
        SELECT coalesce(n.post_id, s.post_id) AS post_id, coalesce(n.title, s.title) AS title,
          coalesce(n.score, s.score) AS score, coalesce(n.sort_method, s.sort_method) AS sort_method,
          coalesce(s.first_scrape_timestamp, f.seen_at) AS first_scrape_timestamp,
          coalesce(n.seen_at, s.last_scrape_timestamp) AS last_scrape_timestamp,
          coalesce(CASE WHEN n.post_id IS NULL THEN s.file_path END, '-') AS file_path,
          coalesce(n.domain, '-') AS domain
        FROM known_state s FULL JOIN (SELECT * FROM latest WHERE rn = 1) n ON s.post_id = n.post_id
        LEFT JOIN starts f ON f.post_id = n.post_id""",
)
def state_upsert(i: Inputs):
    table = Snapshots(i.spark, fresh_path(i.spark, "state")).start()
    table.commit(state.conform(i.known_state))
    table.commit(state.upsert_first(table.read(), scraped(i)))
    return table.read().select(
        "post_id", "title", "score", "sort_method", "first_scrape_timestamp", "last_scrape_timestamp",
        F.coalesce("file_path", F.lit("-")).alias("file_path"), F.coalesce("domain", F.lit("-")).alias("domain"),
    )


@query(
    "state_update_coalesce",
    f"""WITH {SCRAPED_SQL}, {LATEST_SQL}, rich AS (
          SELECT post_id, max_by(domain, seen_at) FILTER (WHERE domain IS NOT NULL) AS domain,
            max_by(post_flair, seen_at) FILTER (WHERE post_flair IS NOT NULL) AS post_flair FROM scraped GROUP BY post_id)
        SELECT s.post_id, n.title, n.score, s.first_scrape_timestamp, n.seen_at AS last_scrape_timestamp,
          r.domain, coalesce(r.post_flair, '-') AS post_flair, '-' AS file_path
        FROM known_state s JOIN (SELECT * FROM latest WHERE rn = 1) n ON s.post_id = n.post_id
        JOIN rich r ON r.post_id = s.post_id""",
)
def state_update_coalesce(i: Inputs):
    updated = state.update_later(state.conform(i.known_state), scraped(i))
    return updated.select(
        "post_id", "title", "score", "first_scrape_timestamp", "last_scrape_timestamp", "domain",
        F.coalesce("post_flair", F.lit("-")).alias("post_flair"), F.coalesce("file_path", F.lit("-")).alias("file_path"),
    )


@query(
    "state_touch_hits",
    """SELECT s.post_id, greatest(s.last_scrape_timestamp, coalesce(o.ts, s.last_scrape_timestamp)) AS last_scrape_timestamp
       FROM known_state s LEFT JOIN (SELECT post_id, max(ts) AS ts FROM observations GROUP BY post_id) o
       ON s.post_id = o.post_id""",
)
def state_touch_hits(i: Inputs):
    return state.touch_hits(i.known_state, i.observations).select("post_id", "last_scrape_timestamp")


@query(
    "state_detailed",
    """SELECT post_id, over_18 AS is_nsfw, selftext AS selftext_snippet, domain, num_comments,
       coalesce(post_flair, '-') AS post_flair FROM posts""",
)
def state_detailed(i: Inputs):
    rich = state.detailed(i.posts, F.lit(True))
    return rich.select(
        "post_id", "is_nsfw", "selftext_snippet", "domain", "num_comments",
        F.coalesce("post_flair", F.lit("-")).alias("post_flair"),
    )


KEEP_ROWS = 1000
RANKED_STATE = """SELECT post_id, coalesce(json_path, '-') AS json_path,
  row_number() OVER (ORDER BY last_scrape_timestamp DESC, post_id) AS rn FROM known_state"""


def _pruned(i: Inputs, keep: bool):
    rows = state.prune(i.known_state, KEEP_ROWS).filter(F.col("keep") == keep)
    return rows.select("post_id", F.coalesce("json_path", F.lit("-")).alias("json_path"))


query("prune_keep", f"SELECT post_id, json_path FROM ({RANKED_STATE}) WHERE rn <= {KEEP_ROWS}")(lambda i: _pruned(i, True))
query("prune_drop", f"SELECT post_id, json_path FROM ({RANKED_STATE}) WHERE rn > {KEEP_ROWS}")(lambda i: _pruned(i, False))

VERDICT_SQL = """verdicts AS (
  SELECT post_id, (file_path IS NOT NULL AND m.path IS NULL) OR j.path IS NULL AS drop_row,
    file_path IS NOT NULL AND m.path IS NULL AND j.path IS NOT NULL AS delete_json,
    j.path IS NULL AND m.path IS NOT NULL AS delete_md
  FROM known_state s LEFT JOIN md_files m ON s.file_path = m.path LEFT JOIN json_files j ON s.json_path = j.path)"""


def verdicts(i: Inputs):
    return state.reconcile(i.known_state, i.md_files, i.json_files)


query("reconcile", f"WITH {VERDICT_SQL} SELECT * FROM verdicts")(verdicts)
query(
    "reconcile_counts",
    f"""WITH {VERDICT_SQL} SELECT count(*) FILTER (WHERE drop_row) AS dropped_rows,
        count(*) FILTER (WHERE delete_json) AS deleted_json, count(*) FILTER (WHERE delete_md) AS deleted_md FROM verdicts""",
)(lambda i: state.reconcile_counts(verdicts(i)))


def written_notes(i: Inputs):
    """Notes on disk: rendered posts below their community's folder; one in eight lost its frontmatter."""
    posts = i.captured
    paths = posts.select("post_id", "k", note_path(posts, "subreddit").alias("path"))
    notes = all_notes(i).join(paths, "post_id")
    bare = F.concat(F.lit("# bare "), "post_id")
    content = F.when(F.col("k") % 8 == 1, bare).otherwise(F.col("content"))
    return notes.select("path", content.alias("content"))


VISIT_SQL = f"p.created_utc > {CLOCK} - INTERVAL '2400' HOUR"


@query(
    "reconcile_edits",
    f"""SELECT s.post_id,
          coalesce(CASE WHEN s.file_path IS NOT NULL AND p.k % 8 <> 1 THEN p.post_flair END, s.label, '-') AS label,
          coalesce(CAST(CASE WHEN s.file_path IS NOT NULL AND p.k % 8 <> 1 AND NOT {VISIT_SQL} THEN NULL
            ELSE s.rescrape_after END AS VARCHAR), '-') AS visit
        FROM known_state s JOIN captured p ON s.post_id = p.post_id""",
)
def reconcile_edits(i: Inputs):
    edited = state.apply_edits(i.known_state.withColumn("label", F.lit("N/A")), with_frontmatter(written_notes(i)))
    plain = i.known_state.select("post_id", F.col("label").alias("own_label"))
    joined = edited.join(plain, "post_id")
    return joined.select(
        "post_id",
        F.coalesce(F.nullif("label", F.lit("N/A")), "own_label", F.lit("-")).alias("label"),
        F.coalesce(F.col("rescrape_after").cast("string"), F.lit("-")).alias("visit"),
    )


@query(
    "state_rebuild",
    f"""SELECT p.post_id, p.title, p.author, p.subreddit, coalesce(p.post_flair, '') AS label, p.score,
          'rebuilt' AS sort_method, CAST(CAST(p.created_utc AS DATE) AS TIMESTAMP) AS post_timestamp,
          {SIGHT_CLOCK} AS last_scrape_timestamp,
          coalesce(CAST(CASE WHEN {VISIT_SQL} THEN p.created_utc + INTERVAL '2400' HOUR END AS VARCHAR), '-') AS visit,
          p.subreddit || '/' || p.subreddit || '_' || p.post_id || '.md' AS file_path
        FROM captured p LEFT JOIN known_state s ON p.post_id = s.post_id WHERE s.post_id IS NULL AND p.k % 8 <> 1""",
)
def state_rebuild(i: Inputs):
    rows = state.rebuild(with_frontmatter(written_notes(i)), i.known_state, SIGHT_AS_OF)
    visit = F.coalesce(F.col("rescrape_after").cast("string"), F.lit("-"))
    return rows.withColumn("visit", visit).drop("rescrape_after", "first_scrape_timestamp")


@query(
    "state_schema_upgrade",
    """SELECT post_id, coalesce(label, '-') AS label, subreddit, '-' AS domain, last_scrape_timestamp FROM known_state""",
)
def state_schema_upgrade(i: Inputs):
    old = i.known_state.withColumnsRenamed({"post_id": "id", "label": "project", "subreddit": "source"})
    rows = upgrade(old.drop("json_path", "score", "sort_method"))
    return rows.select(
        "post_id", F.coalesce("label", F.lit("-")).alias("label"), "subreddit",
        F.coalesce("domain", F.lit("-")).alias("domain"), "last_scrape_timestamp",
    )


def sight_log(i: Inputs):
    settings = F.map_from_arrays(
        F.array(F.lit("k"), F.lit("ignore_urls")), F.array(F.get_json_object("query", "$.k"), F.lit("x"))
    )
    return i.observations.select(
        "post_id", "ts", F.col("event_id").alias("seq"), F.col("routine").alias("type"),
        history.query_map(settings).alias("query"),
    )


ENTRY_SQL = """type || '@' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '#' || k"""
LOG_SQL = """log AS (SELECT post_id, ts, event_id AS seq, routine AS type, json_extract_string(query, '$.k') AS k FROM observations)"""


@query(
    "ingestion_history",
    f"""WITH {LOG_SQL}, ranked AS (
          SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY ts, seq) AS rn FROM log)
        SELECT post_id, CAST((rn - 1) // 50 AS INT) AS part, string_agg({ENTRY_SQL}, ' ' ORDER BY rn) AS entries
        FROM ranked GROUP BY post_id, (rn - 1) // 50""",
)
def ingestion_history(i: Inputs):
    parts = history.history_parts(sight_log(i), part_entries=50)
    entries = F.transform(
        "items",
        lambda e: F.concat(e["type"], F.lit("@"), iso_text(e["ts"]), F.lit("#"), F.try_element_at(e["query"], F.lit("k"))),
    )
    return parts.select("post_id", "part", F.array_join(entries, " ").alias("entries"))


@query(
    "history_query_map",
    "SELECT event_id, 'k=' || json_extract_string(query, '$.k') AS kept FROM observations",
)
def history_query_map(i: Inputs):
    kept = F.transform(F.map_entries("query"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return sight_log(i).select(F.col("seq").alias("event_id"), F.array_join(kept, ",").alias("kept"))


@query(
    "history_json",
    """SELECT event_id, CASE WHEN routine = 'error' THEN '' ELSE '[{"type":"initial","timestamp":"2024-01-01T00:00:00","query":{"k":"1"}}' || ',' END
         || CASE WHEN routine = 'error' THEN '[' ELSE '' END
         || '{"type":"' || routine || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","query":{"k":"'
         || json_extract_string(query, '$.k') || '"}}]' AS history FROM observations""",
)
def history_json(i: Inputs):
    old = '[{"type":"initial","timestamp":"2024-01-01T00:00:00","query":{"k":"1"}}]'
    stored = F.when(F.col("type") == "error", "[{broken").otherwise(old)
    new = history.entry(F.col("type"), F.col("ts"), F.col("query"))
    return sight_log(i).select(F.col("seq").alias("event_id"), history.append(stored, new).alias("history"))


KIND_HOURS = 240
KIND_SQL = f"""firsts AS (
  SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY ts, event_id) AS rn,
    first_value(ts) OVER (PARTITION BY post_id ORDER BY ts, event_id) AS first_ts,
    post_date + INTERVAL '{KIND_HOURS}' HOUR AS due FROM observations),
  late AS (
  SELECT *, first_ts < due AND ts > due AS after_due,
    row_number() OVER (PARTITION BY post_id, first_ts < due AND ts > due ORDER BY ts, event_id) AS late_rn FROM firsts),
  kinds AS (
  SELECT *, CASE WHEN rn = 1 THEN 'initial' WHEN after_due AND late_rn = 1 THEN 'rescrape' ELSE 'hit' END AS kind FROM late)"""


@query("history_kinds", f"WITH {KIND_SQL} SELECT event_id, kind FROM kinds")
def history_kinds(i: Inputs):
    sights = i.observations.withColumn("seq", F.col("event_id"))
    return history.classify_sights(sights, KIND_HOURS).select("event_id", "kind")
