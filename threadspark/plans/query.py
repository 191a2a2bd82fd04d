"""Query rules as column predicates over a posts table, and the feed orders.

Values inside one rule are alternatives (OR); rules are combined with AND. Every
exclusion treats a missing value as "does not match", so the row stays. Missing
values are named by null tests on the bare column, which a scan can take over.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadspark.functions.text import has_word
from threadspark.functions.times import TIMEFRAMES, epoch_micros, ntz

ANY_SUBREDDIT = {"", "all", "none"}
POST_TYPES = ("link", "self")


def listed(value: str | Sequence[str] | None) -> list[str]:
    """One text, a list or nothing, as a list without empty entries."""
    if value is None:
        return []
    items = [value] if isinstance(value, str) else list(value)
    return [item.strip() for item in items if item and item.strip()]


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def subreddit_is(value: str | Sequence[str] | None) -> Column:
    """Communities by name; ``u/name`` or ``user/name`` means the posts of that user."""
    names = listed(value)
    if isinstance(value, str) and value.strip().lower() in ANY_SUBREDDIT:
        names = []
    if not names:
        return F.lit(True)
    users = [n.split("/", 1)[1] for n in names if n.startswith(("u/", "user/"))]
    communities = [n.removeprefix("r/") for n in names if not n.startswith(("u/", "user/"))]
    alternatives = []
    if communities:
        alternatives.append(F.col("subreddit").isin(communities))
    if users:
        alternatives.append(F.col("author").isin(users))
    return any_of(alternatives)


def within(timeframe: str | None, as_of: datetime) -> Column:
    if not timeframe or timeframe == "all":
        return F.lit(True)
    return F.col("created_utc") >= ntz(as_of) - F.expr(TIMEFRAMES[timeframe])


def post_type_is(post_type: str | None) -> Column:
    if post_type is None:
        return F.lit(True)
    if post_type not in POST_TYPES:
        raise ValueError(f"post_type must be one of {POST_TYPES}")
    own_text = F.col("domain").isNotNull() & F.startswith(F.col("domain"), F.lit("self."))
    return own_text if post_type == "self" else ~own_text


def flag_is(column: str) -> Column:
    return F.col(column).eqNullSafe(True)


def one_of(column: str, values: str | Sequence[str] | None) -> Column:
    names = listed(values)
    return F.col(column).isNotNull() & F.col(column).isin(names) if names else F.lit(True)


def none_of(column: str, values: str | Sequence[str] | None) -> Column:
    names = listed(values)
    return F.col(column).isNull() | ~F.col(column).isin(names) if names else F.lit(True)


def _on_site(domains: Sequence[str]) -> Column:
    domain = F.col("domain")
    hits = [(domain == d) | F.endswith(domain, F.lit("." + d)) for d in domains]
    return domain.isNotNull() & any_of(hits)


def domain_is(values: str | Sequence[str] | None) -> Column:
    names = listed(values)
    return _on_site(names) if names else F.lit(True)


def domain_is_not(values: str | Sequence[str] | None) -> Column:
    names = listed(values)
    return ~_on_site(names) if names else F.lit(True)


def words_in(column: str, phrases: str | Sequence[str] | None) -> Column:
    names = listed(phrases)
    return has_word(F.col(column), names) if names else F.lit(True)


def words_not_in(columns: Sequence[str], phrases: str | Sequence[str] | None) -> Column:
    names = listed(phrases)
    if not names:
        return F.lit(True)
    return ~any_of([has_word(F.col(c), names) for c in columns])


def search(tree: Mapping | Sequence | None) -> Column:
    """Nested ``{"all"|"any"|"none": [...]}`` over ``(field, phrase)`` leaves.

    Fields: ``text`` (title or body), ``title``, ``selftext``, ``site``, ``author``.
    Always evaluated as one bracketed condition.
    """
    if not tree:
        return F.lit(True)
    if isinstance(tree, Mapping):
        parts = []
        if tree.get("all"):
            parts.append(all_of([search(t) for t in tree["all"]]))
        if tree.get("any"):
            parts.append(any_of([search(t) for t in tree["any"]]))
        if tree.get("none"):
            parts.append(~any_of([search(t) for t in tree["none"]]))
        return all_of(parts)
    field, phrase = tree
    if field == "text":
        return has_word(F.col("title"), [phrase]) | has_word(F.col("selftext"), [phrase])
    if field in ("title", "selftext"):
        return has_word(F.col(field), [phrase])
    if field == "site":
        return _on_site([phrase])
    if field == "author":
        return F.col("author").isNotNull() & (F.col("author") == phrase)
    raise ValueError(f"unknown search field {field!r}")


def narrowed(routine, as_of: datetime) -> Column:
    """The rules of a routine that look at whole values and not into texts; a scan can take them over."""
    conditions = [
        subreddit_is(routine.subreddit),
        within(routine.timeframe, as_of),
        post_type_is(routine.post_type),
        one_of("author", routine.author),
        none_of("author", routine.exclude_author),
        domain_is(routine.domain),
        domain_is_not(routine.exclude_urls),
        one_of("post_flair", routine.flair),
    ]
    if routine.nsfw_only:
        conditions.append(flag_is("over_18"))
    elif not routine.allow_nsfw:
        conditions.append(~flag_is("over_18"))
    if routine.spoiler:
        conditions.append(flag_is("spoiler"))
    return all_of(conditions)


def matches(routine, as_of: datetime) -> Column:
    """All query rules of a routine as one condition."""
    return all_of([
        narrowed(routine, as_of),
        words_in("title", routine.title_search),
        words_in("selftext", routine.selftext),
        words_in("post_flair", routine.flair_contains),
        words_not_in(["post_flair"], routine.exclude_flair),
        words_not_in(["title", "selftext"], routine.exclude_terms),
        search(routine.search),
    ])


def age_hours(as_of: datetime) -> Column:
    return (epoch_micros(ntz(as_of)) - epoch_micros(F.col("created_utc"))) / F.lit(3_600_000_000)


def hotness(as_of: datetime) -> Column:
    liked = F.log1p(F.greatest(F.col("score"), F.lit(0)).cast("double"))
    return F.round(liked - age_hours(as_of) / 24, 6)


def rise(as_of: datetime) -> Column:
    return F.round(F.col("score") / F.greatest(age_hours(as_of), F.lit(1.0)), 6)


def relevance(terms: Sequence[str]) -> Column:
    """Number of search terms found in title or body."""
    found = [(has_word(F.col("title"), [t]) | has_word(F.col("selftext"), [t])).cast("int") for t in terms]
    return reduce(lambda a, b: a + b, found, F.lit(0))


def search_terms(tree: Mapping | Sequence | None) -> list[str]:
    """Positive phrases of a search tree, the terms that relevance counts."""
    if not tree:
        return []
    if isinstance(tree, Mapping):
        branches = [*tree.get("all", []), *tree.get("any", [])]
        return [term for branch in branches for term in search_terms(branch)]
    return [tree[1]] if tree[0] in ("text", "title", "selftext") else []


def order_key(sort: str, as_of: datetime, terms: Sequence[str] = ()) -> Column:
    """The number a feed is sorted by, highest first."""
    keys = {
        "new": lambda: epoch_micros(F.col("created_utc")).cast("double"),
        "top": lambda: F.col("score").cast("double"),
        "comments": lambda: F.col("num_comments").cast("double"),
        "relevance": lambda: relevance(terms).cast("double"),
        "hot": lambda: hotness(as_of),
        "rising": lambda: rise(as_of),
    }
    if sort not in keys:
        raise ValueError(f"sort must be one of {sorted(keys)}")
    return keys[sort]()


def sort_posts(posts: DataFrame, sort: str, as_of: datetime, terms: Sequence[str] = ()) -> DataFrame:
    """Posts in feed order, with the number they are sorted by in ``sort_key``."""
    keyed = posts.withColumn("sort_key", order_key(sort, as_of, terms))
    return keyed.orderBy(F.desc("sort_key"), "post_id")
