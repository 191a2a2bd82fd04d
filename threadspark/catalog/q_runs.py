"""Checks of routines: settings, matching, limits and whole runs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from threadspark.catalog.inputs import AS_OF, Inputs
from threadspark.catalog.q_comments import LINE_SQL, WHOLE_JSON_SQL, nested_sql, plain_node, tree_sql
from threadspark.catalog.q_posts import LABEL_SQL
from threadspark.catalog.registry import query
from threadspark.functions.text import label
from threadspark.operators import render
from threadspark.operators.comments import PRESETS, trim_tree
from threadspark.plans import routines as r
from threadspark.plans.routine_table import routine_table_totals
from threadspark.plans.run import accepted_posts, history_rows, revisit, run, run_targets
from threadspark.session import cut_lineage
from threadspark.sinks.files import note_path

CLOCK = f"TIMESTAMP '{AS_OF}'"

DEFAULTS = {
    "sort": "new", "max_results": 8, "ignore_below_score": 50, "rescrape_newer_than_hours": 12, "detail": "MD",
    "db_limit": 1000,
}


@query(
    "routine_resolve",
    """SELECT routine_id, name, coalesce(array_to_string(subreddit, '+'), '') AS subreddit,
         coalesce(sort, 'new') AS sort, 5 AS max_results, coalesce(ignore_below_score, 50) AS ignore_below_score,
         coalesce(ignore_older_than_hours, ignore_older_than_days * 24, -1) AS ignore_older_than_hours,
         coalesce(rescrape_newer_than_hours, 12) AS rescrape_newer_than_hours, coalesce(detail, 'MD') AS detail,
         coalesce(array_to_string(exclude_terms, '+'), '') AS exclude_terms, coalesce(db_limit, 1000) AS db_limit
       FROM routine_rows""",
)
def routine_resolve(i: Inputs):
    rows = r.resolve(i.routine_rows, DEFAULTS, {"max_results": 5})
    return rows.withColumns(
        {
            "subreddit": F.array_join("subreddit", "+"),
            "exclude_terms": F.array_join("exclude_terms", "+"),
            "ignore_older_than_hours": F.coalesce("ignore_older_than_hours", F.lit(-1)),
        }
    )


query("routine_by_name", "SELECT routine_id, name FROM routine_rows WHERE lower(name) = 'customer#000000042'")(
    lambda i: r.routines_named(i.routine_rows, "CUSTOMER#000000042").select("routine_id", "name")
)
query("retention_limit", "SELECT greatest(1000, max(db_limit)) AS keep_rows FROM routine_rows")(
    lambda i: r.retention_limit(i.routine_rows)
)

ROUTINES = [
    r.make_routine({"name": "all-new", "max_results": 20}, routine_id=1),
    r.make_routine({"name": "furniture", "subreddit": "FURNITURE", "sort": "top", "max_results": 12}, routine_id=2),
    r.make_routine(
        {"name": "busy", "subreddits": ["BUILDING", "MACHINERY"], "sort": "comments", "ignore_below_score": 0}, routine_id=3
    ),
    r.make_routine({"name": "liked", "sort": "top", "ignore_below_upvote_ratio": 0.85, "max_results": 15}, routine_id=4),
    r.make_routine(
        {"name": "old", "ignore_newer_than_days": 10, "exclude_terms": ["ring"], "offset": 10, "allow_nsfw": True}, routine_id=5
    ),
    r.make_routine({"name": "nothing", "sort": "top", "min_score": 100000}, routine_id=6),
]
MATCHED_SQL = f"""matched AS (
  SELECT 1 AS routine_id, post_id, CAST(epoch_us(created_utc) AS DOUBLE) AS sort_key,
    CASE WHEN score < 50 THEN 'Score below 50' END AS reason FROM posts WHERE NOT over_18
  UNION ALL
  SELECT 2, post_id, score, CASE WHEN score < 50 THEN 'Score below 50' END FROM posts
    WHERE NOT over_18 AND subreddit = 'FURNITURE'
  UNION ALL
  SELECT 3, post_id, num_comments, CASE WHEN score < 0 THEN 'Score below 0' END FROM posts
    WHERE NOT over_18 AND subreddit IN ('BUILDING', 'MACHINERY')
  UNION ALL
  SELECT 4, post_id, score, CASE WHEN score < 50 THEN 'Score below 50'
    WHEN upvote_ratio < 0.85 THEN 'Upvote ratio below 0.85' END FROM posts WHERE NOT over_18
  UNION ALL
  SELECT 5, post_id, CAST(epoch_us(created_utc) AS DOUBLE), CASE WHEN score < 50 THEN 'Score below 50'
    WHEN contains(lower(title), 'ring') THEN 'Excluded term: ring'
    WHEN created_utc > {CLOCK} - INTERVAL '240' HOUR THEN 'Newer than 240h' END FROM posts
    WHERE NOT regexp_matches(title || ' ' || selftext, '(?i)(^|[^\\p{{L}}\\p{{N}}])ring([^\\p{{L}}\\p{{N}}]|$)')
  UNION ALL
  SELECT 6, post_id, score, CASE WHEN score < 100000 THEN 'Score below 100000' END FROM posts WHERE NOT over_18)"""
LIMITS_SQL = "limits(routine_id, feed_start, most) AS (VALUES (1, 0, 20), (2, 0, 12), (3, 0, 8), (4, 0, 15), (5, 10, 8), (6, 0, 8))"
FEED_SQL = f"""{MATCHED_SQL}, {LIMITS_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY routine_id ORDER BY sort_key DESC, post_id) - 1 AS pos FROM matched),
feed AS (SELECT m.*, l.most, l.feed_start FROM ranked m JOIN limits l ON m.routine_id = l.routine_id WHERE pos >= feed_start)"""


def seen_sql(state: str) -> str:
    return f"""{FEED_SQL},
judged AS (
  SELECT f.*, CASE WHEN s.post_id IS NULL THEN 'initial' WHEN s.rescrape_after < {CLOCK} THEN 'rescrape' ELSE 'hit' END AS kind
  FROM feed f LEFT JOIN {state} s ON f.post_id = s.post_id),
verdicts AS (SELECT *, CASE WHEN kind = 'hit' THEN 'hit' WHEN reason IS NOT NULL THEN 'rejected' ELSE 'accepted' END AS status
  FROM judged),
counted AS (SELECT *, coalesce(sum(CASE WHEN status = 'accepted' THEN 1 ELSE 0 END) OVER (
    PARTITION BY routine_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM verdicts),
seen AS (SELECT * FROM counted WHERE taken < most)"""


SEEN_SQL = seen_sql("known_state")
SEEN_COLUMNS = "routine_id, CAST(pos AS INT) AS pos, post_id, kind, status, CASE WHEN status = 'rejected' THEN reason ELSE '-' END AS reason"


def seen(i: Inputs):
    return r.run_routines(i.posts, ROUTINES, AS_OF, i.known_state)


def seen_columns(rows):
    return rows.select("routine_id", "pos", "post_id", "kind", "status", F.coalesce("ignored_reason", F.lit("-")).alias("reason"))


@query(
    "routines_match",
    f"WITH {MATCHED_SQL} SELECT routine_id, post_id, coalesce(reason, 'accepted') AS verdict FROM matched",
)
def routines_match(i: Inputs):
    rows = r.match_routines(i.posts, ROUTINES, AS_OF)
    return rows.select("routine_id", "post_id", F.coalesce("ignored_reason", F.lit("accepted")).alias("verdict"))


@query("accept_horizon", f"WITH {FEED_SQL} SELECT routine_id, CAST(pos AS INT) AS pos, post_id FROM feed WHERE pos < feed_start + 75")
def accept_horizon(i: Inputs):
    bounded = [replace(routine, horizon=75) for routine in ROUTINES]
    rows = r.feed_window(r.match_routines(i.posts, bounded, AS_OF), bounded)
    return rows.select("routine_id", "pos", "post_id")


@query("accept_limit", f"WITH {SEEN_SQL} SELECT {SEEN_COLUMNS} FROM seen")
def accept_limit(i: Inputs):
    return seen_columns(seen(i))


DEEP = [
    r.make_routine({"name": "many", "max_results": 500, "allow_nsfw": True}, routine_id=1),
    r.make_routine({"name": "rare", "sort": "comments", "min_score": 400_000, "max_results": 6, "allow_nsfw": True}, routine_id=2),
    r.make_routine({"name": "late", "sort": "top", "max_results": 40, "offset": 200, "allow_nsfw": True}, routine_id=3),
]


@query(
    "accept_deep",
    f"""WITH matched AS (
          SELECT 1 AS routine_id, post_id, CAST(epoch_us(created_utc) AS DOUBLE) AS sort_key, CASE WHEN score < 50 THEN 'Score below 50' END AS reason FROM posts
          UNION ALL SELECT 2, post_id, num_comments, CASE WHEN score < 400000 THEN 'Score below 400000' END FROM posts
          UNION ALL SELECT 3, post_id, score, CASE WHEN score < 50 THEN 'Score below 50' END FROM posts),
        limits(routine_id, feed_start, most) AS (VALUES (1, 0, 500), (2, 0, 6), (3, 200, 40)),
        {seen_sql("known_state").split("VALUES (1, 0, 20), (2, 0, 12), (3, 0, 8), (4, 0, 15), (5, 10, 8), (6, 0, 8)),")[1]}
        SELECT {SEEN_COLUMNS} FROM seen""",
)
def accept_deep(i: Inputs):
    """Limits, rejections and an offset that no first window satisfies."""
    return seen_columns(r.run_routines(i.posts, DEEP, AS_OF, i.known_state))


@query(
    "routine_table_run",
    f"""WITH settings AS (
          SELECT routine_id, subreddit, coalesce(sort, 'new') AS sort, coalesce(max_results, 8) AS most, coalesce(ignore_below_score, 50) AS floor,
            coalesce(ignore_older_than_hours, ignore_older_than_days * 24) AS hours, coalesce(exclude_terms, []) AS terms FROM routine_rows),
        worded AS (SELECT *, regexp_matches(title || ' ' || selftext, '(?i)(^|[^\\p{{L}}\\p{{N}}])(ring|bolt)([^\\p{{L}}\\p{{N}}]|$)') AS worded FROM posts),
        fed AS (
          SELECT s.routine_id, s.most, p.post_id, CASE s.sort WHEN 'top' THEN score WHEN 'comments' THEN num_comments ELSE CAST(epoch_us(created_utc) AS DOUBLE) END AS sort_key,
            CASE WHEN score < s.floor THEN 'Score below ' || s.floor WHEN len(terms) > 0 AND contains(lower(title), 'ring') THEN 'Excluded term: ring'
              WHEN len(terms) > 0 AND contains(lower(title), 'bolt') THEN 'Excluded term: bolt'
              WHEN created_utc < {CLOCK} - to_hours(s.hours) THEN 'Older than ' || s.hours || 'h' END AS reason
          FROM worded p JOIN settings s ON (s.subreddit IS NULL OR s.subreddit[1] = p.subreddit)
          WHERE NOT over_18 AND (len(terms) = 0 OR NOT worded)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY routine_id ORDER BY sort_key DESC, post_id) - 1 AS pos FROM fed),
        judged AS (
          SELECT f.*, CASE WHEN s.post_id IS NULL THEN 'initial' WHEN s.rescrape_after < {CLOCK} THEN 'rescrape' ELSE 'hit' END AS kind
          FROM ranked f LEFT JOIN known_state s ON f.post_id = s.post_id),
        verdicts AS (SELECT *, CASE WHEN kind = 'hit' THEN 'hit' WHEN reason IS NOT NULL THEN 'rejected' ELSE 'accepted' END AS status FROM judged),
        counted AS (SELECT *, coalesce(sum(CASE WHEN status = 'accepted' THEN 1 ELSE 0 END) OVER (
            PARTITION BY routine_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM verdicts)
        SELECT routine_id, count(*) AS n_seen, count(*) FILTER (WHERE status = 'accepted') AS n_accepted, count(*) FILTER (WHERE status = 'hit') AS n_hits,
          max(pos)::INT AS last_pos, max(CASE WHEN status = 'accepted' THEN post_id END) AS largest, max(CASE WHEN status = 'rejected' THEN reason END) AS last_reason
        FROM counted WHERE taken < most GROUP BY routine_id""",
)
def routine_table_run(i: Inputs):
    """Every row of the routine table run on all posts; what each one saw, in one row."""
    return routine_table_totals(i.posts, i.routine_rows, AS_OF, i.known_state)


@query(
    "run_dedup",
    f"""WITH {SEEN_SQL} SELECT post_id, routine_id, CAST(pos AS INT) AS pos FROM (
          SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY routine_id, pos) AS rn FROM seen WHERE status = 'accepted')
        WHERE rn = 1""",
)
def run_dedup(i: Inputs):
    return r.once_per_run(seen(i))


@query(
    "run_totals",
    f"""WITH {SEEN_SQL} SELECT routine_id, count(*) FILTER (WHERE status = 'accepted' AND kind = 'initial') AS new_posts,
        count(*) FILTER (WHERE status = 'accepted' AND kind = 'rescrape') AS updated_posts FROM seen GROUP BY routine_id""",
)
def run_totals(i: Inputs):
    return r.run_totals(seen(i))


@query(
    "untracked_select",
    f"""WITH empty_state AS (SELECT * FROM known_state WHERE FALSE), {seen_sql('empty_state')}
        SELECT {SEEN_COLUMNS} FROM seen""",
)
def untracked_select(i: Inputs):
    return seen_columns(r.run_routines(i.posts, ROUTINES, AS_OF, None))


def one_after_the_other() -> str:
    """SQL of the second and fourth routine run in this order on one state."""
    base = seen_sql("known_state")
    return f"""{base},
first_run AS (SELECT * FROM seen WHERE routine_id = 2),
judged_next AS (
  SELECT f.*, CASE WHEN a.post_id IS NOT NULL THEN 'hit' WHEN s.post_id IS NULL THEN 'initial'
      WHEN s.rescrape_after < {CLOCK} THEN 'rescrape' ELSE 'hit' END AS kind
  FROM feed f LEFT JOIN known_state s ON f.post_id = s.post_id
  LEFT JOIN (SELECT post_id FROM first_run WHERE status = 'accepted') a ON f.post_id = a.post_id WHERE f.routine_id = 4),
verdicts_next AS (SELECT *, CASE WHEN kind = 'hit' THEN 'hit' WHEN reason IS NOT NULL THEN 'rejected' ELSE 'accepted' END AS status
  FROM judged_next),
counted_next AS (SELECT *, coalesce(sum(CASE WHEN status = 'accepted' THEN 1 ELSE 0 END) OVER (
    ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM verdicts_next)"""


@query(
    "routines_sequential",
    f"""WITH {one_after_the_other()} SELECT {SEEN_COLUMNS} FROM first_run
        UNION ALL SELECT {SEEN_COLUMNS} FROM counted_next WHERE taken < most""",
)
def routines_sequential(i: Inputs):
    return seen_columns(r.run_sequential(i.posts, [ROUTINES[1], ROUTINES[3]], AS_OF, i.known_state))


@query(
    "run_state",
    f"""WITH {SEEN_SQL}, chosen AS (
          SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY routine_id, pos) AS rn
            FROM seen WHERE status = 'accepted') WHERE rn = 1),
        hit_ids AS (SELECT DISTINCT post_id FROM seen WHERE status = 'hit')
        SELECT coalesce(s.post_id, c.post_id) AS post_id, coalesce(p.title, s.title) AS title,
          coalesce(CASE WHEN c.post_id IS NULL THEN s.label ELSE {LABEL_SQL} END, '-') AS label,
          CASE WHEN c.post_id IS NULL THEN s.sort_method WHEN c.routine_id IN (1, 5) THEN 'new'
            WHEN c.routine_id = 3 THEN 'comments' ELSE 'top' END AS sort_method,
          coalesce(s.first_scrape_timestamp, {CLOCK}) AS first_scrape_timestamp,
          CASE WHEN c.post_id IS NOT NULL THEN {CLOCK} WHEN h.post_id IS NOT NULL
            THEN greatest(s.last_scrape_timestamp, {CLOCK}) ELSE s.last_scrape_timestamp END AS last_scrape_timestamp
        FROM known_state s FULL JOIN chosen c ON s.post_id = c.post_id LEFT JOIN posts p ON p.post_id = c.post_id
        LEFT JOIN hit_ids h ON h.post_id = s.post_id""",
)
def run_state(i: Inputs):
    after = run(i.posts, i.comments, i.known_state, ROUTINES, AS_OF).state
    return after.select(
        "post_id", "title", F.coalesce("label", F.lit("-")).alias("label"), "sort_method",
        "first_scrape_timestamp", "last_scrape_timestamp",
    )


@query(
    "run_history",
    f"""WITH {SEEN_SQL} SELECT post_id, CAST(routine_id AS BIGINT) * 1000000000 + pos AS seq, {CLOCK} AS ts, kind AS type,
          CASE routine_id WHEN 1 THEN 'all-new' WHEN 2 THEN 'furniture' WHEN 3 THEN 'busy' WHEN 4 THEN 'liked' WHEN 5 THEN 'old'
            ELSE 'nothing' END AS routine, CASE WHEN routine_id IN (1, 5) THEN 'new' WHEN routine_id = 3 THEN 'comments' ELSE 'top' END AS sort
        FROM seen WHERE status <> 'rejected'""",
)
def run_history(i: Inputs):
    rows = history_rows(seen(i), ROUTINES, AS_OF)
    return rows.select(
        "post_id", "seq", "ts", "type", F.col("query")["name"].alias("routine"), F.col("query")["sort"].alias("sort")
    )


KEEPERS = [
    r.make_routine({"name": "kept", "sort": "top", "save_json": False, "max_results": 20_000, "allow_nsfw": True}, routine_id=1),
    r.make_routine({"name": "lean", "sort": "comments", "max_results": 30, "allow_nsfw": True}, routine_id=2),
]
WHOLE = [
    r.make_routine({"name": "whole", "sort": "new", "detail": "XL", "detailed_db": True, "max_results": 20_000, "min_score": 0, "allow_nsfw": True}, routine_id=1),
]


def kept_sql(order: str, least: int) -> str:
    return f"""known AS (SELECT p.*, s.post_id IS NULL AS fresh, s.rescrape_after < {CLOCK} AS due
          FROM posts p LEFT JOIN known_state s ON p.post_id = s.post_id),
        fed AS (SELECT *, row_number() OVER (ORDER BY {order}, post_id) AS rn FROM known),
        kept AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY rn) AS taken FROM fed WHERE (fresh OR due) AND score >= {least})
          WHERE taken <= 20000)
        SELECT k.post_id, k.upvote_ratio, k.domain, k.over_18 AS is_nsfw, coalesce(n.comments_json, '-') AS comments_dump
        FROM kept k LEFT JOIN nested n ON k.post_id = n.post_id"""


def kept_details(i: Inputs, routines):
    after = run(i.posts, i.comments, i.known_state, routines, AS_OF).state
    kept = after.filter(F.col("domain").isNotNull())
    return kept.select("post_id", "upvote_ratio", "domain", "is_nsfw", F.coalesce("comments_dump", F.lit("-")).alias("comments_dump"))


@query("run_details", f"WITH RECURSIVE {tree_sql(PRESETS['MD'])}, {nested_sql(plain_node)}, {kept_sql('score DESC', 50)}")
def run_details(i: Inputs):
    return kept_details(i, KEEPERS)


@query("run_details_whole", f"WITH RECURSIVE {tree_sql(None)}, {WHOLE_JSON_SQL}, {kept_sql('created_utc DESC', 0)}")
def run_details_whole(i: Inputs):
    """Whole threads in the state, replies of any depth nested in their parents."""
    return kept_details(i, WHOLE)


REVISIT = r.make_routine({"sort": "new", "ignore_below_score": 100, "rescrape_newer_than_hours": 12}, routine_id=1)
REVISITED_SQL = f"""revisited AS (
  SELECT p.* FROM posts p JOIN known_state s ON p.post_id = s.post_id WHERE s.rescrape_after < {CLOCK} AND p.score >= 100)"""


def revisited(i: Inputs):
    posts = i.posts
    old = posts.select(
        "post_id",
        note_path(posts, "subreddit").alias("path"),
        F.concat(F.lit("---\nscore: 1\nrescrape_after: soon\n---\n# "), "title", F.lit("\n")).alias("content"),
    )
    return revisit(posts, i.comments, i.known_state, old, REVISIT, AS_OF)


@query(
    "revisit_state",
    f"""WITH {REVISITED_SQL}
        SELECT s.post_id, s.title, CASE WHEN r.post_id IS NULL THEN coalesce(s.label, '-') ELSE {LABEL_SQL.replace('post_flair', 'r.post_flair')} END AS label,
          coalesce(s.file_path, CASE WHEN r.post_id IS NOT NULL THEN r.subreddit || '_' || r.post_id || '.md' END, '-') AS file_path,
          CASE WHEN r.post_id IS NULL THEN s.last_scrape_timestamp ELSE {CLOCK} END AS last_scrape_timestamp,
          coalesce(CAST(CASE WHEN r.post_id IS NULL THEN s.rescrape_after WHEN r.created_utc > {CLOCK} - INTERVAL '12' HOUR
            THEN r.created_utc + INTERVAL '12' HOUR END AS VARCHAR), '-') AS visit
        FROM known_state s LEFT JOIN revisited r ON s.post_id = r.post_id""",
)
def revisit_state(i: Inputs):
    after = revisited(i).state
    return after.select(
        "post_id", "title", F.coalesce("label", F.lit("-")).alias("label"),
        F.coalesce("file_path", F.lit("-")).alias("file_path"), "last_scrape_timestamp",
        F.coalesce(F.col("rescrape_after").cast("string"), F.lit("-")).alias("visit"),
    )


@query(
    "revisit_notes",
    f"""WITH RECURSIVE {tree_sql(PRESETS['MD'])}, {REVISITED_SQL},
        sections AS (SELECT post_id, string_agg({LINE_SQL}, '' ORDER BY path) AS section FROM tree GROUP BY post_id)
        SELECT r.post_id, r.subreddit || '/' || r.subreddit || '_' || r.post_id || '.md' AS path,
          '---' || chr(10) || 'score: ' || CAST(r.score AS VARCHAR) || chr(10) || 'rescraped_date: 2001-07-01 00:00' || chr(10)
          || '---' || chr(10) || '# ' || r.title || chr(10) || chr(10) || chr(10) || '---' || chr(10)
          || '## Updated Comments (2001-07-01 00:00)' || chr(10) || chr(10) || coalesce(s.section, '') || chr(10) AS content
        FROM revisited r LEFT JOIN sections s ON r.post_id = s.post_id""",
)
def revisit_notes(i: Inputs):
    return revisited(i).notes.select("post_id", "path", "content")


@query(
    "targets_run",
    rf"""WITH targets AS (SELECT DISTINCT regexp_extract(url_overridden_by_dest, 'comments/([^/]+)', 1) AS post_id FROM posts
          WHERE contains(url_overridden_by_dest, 'reddit.com'))
        SELECT p.post_id, CASE WHEN s.post_id IS NULL THEN 'initial' WHEN s.rescrape_after < {CLOCK} THEN 'rescrape' ELSE 'hit' END AS kind,
          CASE WHEN s.post_id IS NOT NULL AND (s.rescrape_after IS NULL OR NOT s.rescrape_after < {CLOCK}) THEN 'hit'
            WHEN p.score < 100 THEN 'rejected' ELSE 'accepted' END AS status
        FROM posts p JOIN targets t ON p.post_id = t.post_id LEFT JOIN known_state s ON s.post_id = p.post_id""",
)
def targets_run(i: Inputs):
    posts = i.posts
    targets = posts.select(F.col("url_overridden_by_dest").alias("target")).filter("target LIKE '%reddit.com%'")
    return run_targets(targets, posts, i.comments, i.known_state, REVISIT, AS_OF).seen.select("post_id", "kind", "status")


DIGEST = r.make_routine({"name": "digest", "sort": "top", "max_results": 10, "allow_nsfw": True}, routine_id=1)


@query(
    "routine_notes",
    f"""WITH RECURSIVE {tree_sql(PRESETS['MD'])},
      candidates AS (SELECT * FROM posts WHERE score >= 50 AND post_id NOT IN (SELECT post_id FROM known_state)),
      chosen AS (SELECT * FROM candidates ORDER BY score DESC, post_id LIMIT 10),
      sections AS (SELECT post_id, count(*) AS n_comments, string_agg({LINE_SQL}, '' ORDER BY path) AS comment_section
        FROM tree GROUP BY post_id)
      SELECT c.post_id, title, {LABEL_SQL} AS label, score, coalesce(n_comments, 0) AS n_comments,
        '# ' || title || chr(10) || coalesce(comment_section, '') AS note
      FROM chosen c LEFT JOIN sections s ON c.post_id = s.post_id""",
)
def routine_notes(i: Inputs):
    """New posts: the ten best, with their best comments, as notes."""
    unknown = i.posts.join(i.known_state.select("post_id"), "post_id", "left_anti")
    judged = r.run_routines(unknown, [DIGEST], AS_OF, None)
    chosen = cut_lineage(accepted_posts(i.posts, judged, [DIGEST]))
    # at most max_results ids
    tree = trim_tree(i.comments.join(F.broadcast(chosen.select("post_id")), "post_id", "left_semi"), DIGEST.detail)
    ordered = F.array_sort(F.collect_list(F.struct("path", "line")))
    lines = render.comment_lines(tree).groupBy("post_id").agg(F.count("*").alias("n_comments"), ordered.alias("lines"))
    section = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    notes = chosen.join(lines.select("post_id", "n_comments", section.alias("section")), "post_id", "left")
    return notes.select(
        "post_id", "title", label(F.col("post_flair")).alias("label"), "score",
        F.coalesce("n_comments", F.lit(0)).alias("n_comments"),
        F.concat(F.lit("# "), "title", F.lit("\n"), F.coalesce("section", F.lit(""))).alias("note"),
    )
