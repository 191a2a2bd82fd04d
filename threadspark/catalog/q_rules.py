"""Checks of the local rules, the query rules and the feed orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadspark.catalog.inputs import AS_OF, SIGHT_AS_OF, Inputs
from threadspark.catalog.registry import query
from threadspark.operators import phrases
from threadspark.operators.comments import is_valid
from threadspark.operators.links import post_urls, without_ignored
from threadspark.plans import query as q
from threadspark.plans import rules
from threadspark.plans.routines import Routine

CLOCK = f"TIMESTAMP '{AS_OF}'"
SIGHT_CLOCK = f"TIMESTAMP '{SIGHT_AS_OF}'"


def _kept(condition):
    return lambda i: i.posts.filter(~condition()).select("post_id")


def _matching(condition, *columns):
    return lambda i: i.posts.filter(condition()).select("post_id", *columns)


query("flt_score", "SELECT post_id FROM posts WHERE NOT score < 50")(_kept(lambda: rules.below_score(50)))
query("flt_ratio", "SELECT post_id FROM posts WHERE NOT upvote_ratio < 0.85")(_kept(lambda: rules.below_ratio(0.85)))
query("flt_comments", "SELECT post_id FROM posts WHERE NOT num_comments < 20")(_kept(lambda: rules.below_comments(20)))
query("flt_older", f"SELECT post_id FROM posts WHERE NOT created_utc < {CLOCK} - INTERVAL '9600' HOUR")(
    _kept(lambda: rules.older_than(9600, AS_OF))
)
query("flt_newer", f"SELECT post_id FROM posts WHERE NOT created_utc > {CLOCK} - INTERVAL '480' HOUR")(
    _kept(lambda: rules.newer_than(480, AS_OF))
)


@query(
    "flt_exclude_terms",
    """SELECT post_id, CASE WHEN contains(lower(title), 'ring') THEN 'Excluded term: Ring'
         WHEN contains(lower(title), 'old') THEN 'Excluded term: old' ELSE 'none' END AS reason FROM posts""",
)
def flt_exclude_terms(i: Inputs):
    reason = rules.excluded_term(["Ring", "old"])
    return i.posts.select("post_id", F.coalesce(reason, F.lit("none")).alias("reason"))


CASCADE = Routine(
    ignore_below_score=50,
    ignore_below_upvote_ratio=0.1,
    ignore_below_comments=5,
    exclude_terms=("ring", "old"),
    ignore_older_than_hours=30000,
    ignore_newer_than_hours=100,
)


@query(
    "rule_cascade",
    f"""SELECT post_id, CASE WHEN score < 50 THEN 'Score below 50'
         WHEN upvote_ratio < 0.1 THEN 'Upvote ratio below 0.1'
         WHEN num_comments < 5 THEN 'Comments below 5'
         WHEN contains(lower(title), 'ring') THEN 'Excluded term: ring'
         WHEN contains(lower(title), 'old') THEN 'Excluded term: old'
         WHEN created_utc < {CLOCK} - INTERVAL '30000' HOUR THEN 'Older than 30000h'
         WHEN created_utc > {CLOCK} - INTERVAL '100' HOUR THEN 'Newer than 100h'
         ELSE 'accepted' END AS verdict FROM posts""",
)
def rule_cascade(i: Inputs):
    judged = rules.with_verdict(i.posts, CASCADE, AS_OF)
    return judged.select("post_id", F.coalesce("ignored_reason", F.lit("accepted")).alias("verdict"))


@query(
    "flt_comment_valid",
    """SELECT comment_id FROM comments WHERE body NOT IN ('[deleted]', '[removed]')
       AND author <> '[deleted]' AND NOT stickied""",
)
def flt_comment_valid(i: Inputs):
    return i.comments.filter(is_valid()).select("comment_id")


@query(
    "flt_ignore_urls",
    r"""WITH links AS (SELECT post_id, unnest(list_distinct(list_concat(
            CASE WHEN url_overridden_by_dest IS NULL THEN [] ELSE [url_overridden_by_dest] END,
            regexp_extract_all(selftext, 'https?://[^\s)\]]+')))) AS url FROM posts)
        SELECT post_id, url FROM links WHERE NOT contains(url, 'example.com/a3') AND NOT contains(url, 'youtube.com')""",
)
def flt_ignore_urls(i: Inputs):
    links = post_urls(F.col("url_overridden_by_dest"), F.col("selftext"))
    kept = without_ignored(links, ["example.com/a3", "youtube.com"])
    return i.posts.select("post_id", F.explode(kept).alias("url"))


query("q_subreddit", "SELECT post_id FROM posts WHERE subreddit IN ('FURNITURE', 'BUILDING')")(
    _matching(lambda: q.subreddit_is(["FURNITURE", "r/BUILDING"]))
)
query("q_user_source", "SELECT post_id, author FROM posts WHERE author = 'user_7'")(
    _matching(lambda: q.subreddit_is("u/user_7"), "author")
)
query("q_timeframe", f"SELECT post_id FROM posts WHERE created_utc >= {CLOCK} - INTERVAL '1' MONTH")(
    _matching(lambda: q.within("month", AS_OF))
)
query("q_post_type", "SELECT post_id, domain FROM posts WHERE domain LIKE 'self.%'")(
    _matching(lambda: q.post_type_is("self"), "domain")
)
query("q_allow_nsfw", "SELECT post_id FROM posts WHERE NOT over_18")(_matching(lambda: ~q.flag_is("over_18")))
query("q_nsfw_only", "SELECT post_id FROM posts WHERE over_18")(_matching(lambda: q.flag_is("over_18")))
query("q_spoiler", "SELECT post_id FROM posts WHERE spoiler")(_matching(lambda: q.flag_is("spoiler")))
query("q_author", "SELECT post_id, author FROM posts WHERE author IN ('user_1', 'user_2')")(
    _matching(lambda: q.one_of("author", ["user_1", "user_2"]), "author")
)
query("q_exclude_author", "SELECT post_id FROM posts WHERE author NOT IN ('user_1', 'user_2')")(
    _matching(lambda: q.none_of("author", ["user_1", "user_2"]))
)
query(
    "q_domain",
    """SELECT post_id, domain FROM posts WHERE domain = 'imgur.com' OR domain LIKE '%.imgur.com'
       OR domain = 'github.com' OR domain LIKE '%.github.com'""",
)(_matching(lambda: q.domain_is(["imgur.com", "github.com"]), "domain"))
query(
    "q_exclude_urls",
    "SELECT post_id, domain FROM posts WHERE NOT (domain = 'imgur.com' OR domain LIKE '%.imgur.com')",
)(_matching(lambda: q.domain_is_not("imgur.com"), "domain"))
query(
    "q_title",
    r"""SELECT post_id, title FROM posts
        WHERE regexp_matches(title, '(?i)(^|[^\p{L}\p{N}])(red|hot ring)([^\p{L}\p{N}]|$)')""",
)(_matching(lambda: q.words_in("title", ["Red", "hot ring"]), "title"))
query(
    "q_selftext",
    r"SELECT post_id FROM posts WHERE regexp_matches(selftext, '(?i)(^|[^\p{L}\p{N}])(body)([^\p{L}\p{N}]|$)')",
)(_matching(lambda: q.words_in("selftext", "body")))
query(
    "q_flair_contains",
    r"""SELECT post_id, post_flair FROM posts
        WHERE regexp_matches(post_flair, '(?i)(^|[^\p{L}\p{N}])(discussion|low)([^\p{L}\p{N}]|$)')""",
)(_matching(lambda: q.words_in("post_flair", ["Discussion", "low"]), "post_flair"))
query("q_flair", "SELECT post_id, post_flair FROM posts WHERE post_flair = 'Weekly Discussion'")(
    _matching(lambda: q.one_of("post_flair", "Weekly Discussion"), "post_flair")
)
query(
    "q_exclude_flair",
    r"""SELECT post_id FROM posts WHERE post_flair IS NULL
        OR NOT regexp_matches(post_flair, '(?i)(^|[^\p{L}\p{N}])(discussion)([^\p{L}\p{N}]|$)')""",
)(_matching(lambda: q.words_not_in(["post_flair"], "discussion")))
query(
    "q_exclude_text",
    r"""SELECT post_id FROM posts
        WHERE NOT regexp_matches(title, '(?i)(^|[^\p{L}\p{N}])(bolt|plain)([^\p{L}\p{N}]|$)')
        AND NOT regexp_matches(selftext, '(?i)(^|[^\p{L}\p{N}])(bolt|plain)([^\p{L}\p{N}]|$)')""",
)(_matching(lambda: q.words_not_in(["title", "selftext"], ["bolt", "plain"])))

TREE = {
    "all": [("text", "ring"), {"any": [("site", "imgur.com"), ("author", "user_3"), ("selftext", "plain body")]}],
    "none": [("title", "old"), ("title", "cold")],
}
query(
    "q_search_bool",
    r"""SELECT post_id, title FROM posts
        WHERE (regexp_matches(title, '(?i)(^|[^\p{L}\p{N}])ring([^\p{L}\p{N}]|$)')
            OR regexp_matches(selftext, '(?i)(^|[^\p{L}\p{N}])ring([^\p{L}\p{N}]|$)'))
        AND (domain = 'imgur.com' OR domain LIKE '%.imgur.com' OR author = 'user_3'
            OR regexp_matches(selftext, '(?i)(^|[^\p{L}\p{N}])plain body([^\p{L}\p{N}]|$)'))
        AND NOT (regexp_matches(title, '(?i)(^|[^\p{L}\p{N}])old([^\p{L}\p{N}]|$)')
            OR regexp_matches(title, '(?i)(^|[^\p{L}\p{N}])cold([^\p{L}\p{N}]|$)'))""",
)(_matching(lambda: q.search(TREE), "title"))

COMBINED = Routine(
    subreddit=("FURNITURE", "MACHINERY"),
    timeframe="year",
    post_type="link",
    exclude_author=("user_4",),
    domain=("imgur.com", "youtube.com"),
    flair_contains=("Discussion", "News"),
    exclude_flair=("weekly",),
    exclude_terms=("anvil",),
    search={"any": [("title", "red"), ("title", "ring"), ("text", "widget")]},
)
query(
    "q_combined",
    rf"""SELECT post_id, title FROM posts
        WHERE subreddit IN ('FURNITURE', 'MACHINERY') AND created_utc >= {CLOCK} - INTERVAL '1' YEAR
        AND domain NOT LIKE 'self.%' AND author <> 'user_4' AND NOT over_18
        AND (domain IN ('imgur.com', 'youtube.com') OR domain LIKE '%.imgur.com' OR domain LIKE '%.youtube.com')
        AND regexp_matches(post_flair, '(?i)(^|[^\p{{L}}\p{{N}}])(discussion|news)([^\p{{L}}\p{{N}}]|$)')
        AND NOT regexp_matches(post_flair, '(?i)(^|[^\p{{L}}\p{{N}}])weekly([^\p{{L}}\p{{N}}]|$)')
        AND NOT regexp_matches(title, '(?i)(^|[^\p{{L}}\p{{N}}])anvil([^\p{{L}}\p{{N}}]|$)')
        AND NOT regexp_matches(selftext, '(?i)(^|[^\p{{L}}\p{{N}}])anvil([^\p{{L}}\p{{N}}]|$)')
        AND (regexp_matches(title, '(?i)(^|[^\p{{L}}\p{{N}}])(red|ring|widget)([^\p{{L}}\p{{N}}]|$)')
            OR regexp_matches(selftext, '(?i)(^|[^\p{{L}}\p{{N}}])widget([^\p{{L}}\p{{N}}]|$)'))""",
)(_matching(lambda: q.matches(COMBINED, AS_OF), "title"))

AGE = f"(epoch_us({CLOCK}) - epoch_us(created_utc)) / 3600000000.0::DOUBLE"


def _sorted(sort: str, terms: tuple[str, ...] = ()):
    return lambda i: q.sort_posts(i.posts, sort, AS_OF, terms).select("post_id", "sort_key")


query("sort_new", "SELECT post_id, CAST(epoch_us(created_utc) AS DOUBLE) AS sort_key FROM posts")(_sorted("new"))
query("sort_top", "SELECT post_id, CAST(score AS DOUBLE) AS sort_key FROM posts")(_sorted("top"))
query("sort_comments", "SELECT post_id, CAST(num_comments AS DOUBLE) AS sort_key FROM posts")(_sorted("comments"))
query(
    "sort_relevance",
    r"""SELECT post_id, CAST(
          CAST(regexp_matches(title || ' ' || selftext, '(?i)(^|[^\p{L}\p{N}])red([^\p{L}\p{N}]|$)') AS INT)
        + CAST(regexp_matches(title || ' ' || selftext, '(?i)(^|[^\p{L}\p{N}])ring([^\p{L}\p{N}]|$)') AS INT)
        + CAST(regexp_matches(title || ' ' || selftext, '(?i)(^|[^\p{L}\p{N}])body([^\p{L}\p{N}]|$)') AS INT)
        AS DOUBLE) AS sort_key FROM posts""",
)(_sorted("relevance", ("red", "ring", "body")))
query(
    "sort_hot",
    f"SELECT post_id, round(ln(1 + CAST(greatest(score, 0) AS DOUBLE)) - {AGE} / 24, 6) AS sort_key FROM posts",
)(_sorted("hot"))
query(
    "sort_rising",
    f"SELECT post_id, round(score / greatest({AGE}, CAST(1 AS DOUBLE)), 6) AS sort_key FROM posts",
)(_sorted("rising"))


@query("limit_single", "SELECT post_id, score FROM posts ORDER BY score DESC, post_id LIMIT 25")
def limit_single(i: Inputs):
    return q.sort_posts(i.posts, "top", AS_OF).limit(25).select("post_id", "score")


@query(
    "post_age",
    f"SELECT post_id, (epoch_us({CLOCK}) - epoch_us(created_utc)) // 60000000 AS age_minutes FROM posts",
)
def post_age(i: Inputs):
    minutes = F.round(q.age_hours(AS_OF) * 60).cast("long")
    return i.posts.select("post_id", minutes.alias("age_minutes"))


# Phrases of one and of two words: beginnings of benchmark items, names of parts, and one without a word.
PHRASES_SQL = r"""firsts AS (
    SELECT item_id, split(text, ' ') AS w FROM benchmark),
  phrases AS (
    SELECT item_id * 4 AS phrase_id, lower(w[1]) AS phrase FROM firsts
    UNION ALL SELECT item_id * 4 + 1, upper(w[2]) || ' ' || w[3] FROM firsts
    UNION ALL SELECT min(p_partkey) * 4 + 2, p_name FROM part GROUP BY p_name
    UNION ALL SELECT -1, '(+)'),
  words AS (
    SELECT doc_id, unnest(list_append(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')), '')) AS word FROM documents),
  candidates AS (
    SELECT doc_id, phrase_id, phrase FROM words JOIN phrases ON word = regexp_extract(lower(phrase), '[\p{L}\p{N}]+'))"""


def some_phrases(i: Inputs):
    words = F.split("text", " ", -1)
    items = i.table("benchmark").select(F.col("item_id").alias("k"), words.alias("w"))
    one = items.select((F.col("k") * 4).alias("phrase_id"), F.lower(F.col("w")[0]).alias("phrase"))
    two = items.select(F.col("k") * 4 + 1, F.concat(F.upper(F.col("w")[1]), F.lit(" "), F.col("w")[2]))
    names = i.table("part").groupBy("p_name").agg(F.min("p_partkey").alias("k")).select(F.col("k") * 4 + 2, "p_name")
    none = i.spark.range(1).select(F.lit(-1).cast("long"), F.lit("(+)"))
    return one.union(two).union(names).union(none)


@query(
    "phrase_hits",
    rf"""WITH {PHRASES_SQL}
        SELECT doc_id, phrase_id FROM candidates JOIN documents USING (doc_id)
        WHERE regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}])(' || regexp_replace(phrase, '([\\.^$|?*+()\[\]{{}}])', '\\\1', 'g') || ')([^\p{{L}}\p{{N}}]|$)')""",
)
def phrase_hits(i: Inputs):
    return phrases.phrase_hits(i.table("documents"), ["doc_id"], "text", some_phrases(i))
