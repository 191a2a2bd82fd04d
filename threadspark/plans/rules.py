"""Local rules: the first failing rule names the reason a post is rejected."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadspark.functions.times import hours_before, ntz


def _below(column: str, limit: float) -> Column:
    """Whether a number is below ``limit``, a missing one counting as 0; never null, and it or its negation reaches the scan."""
    low = F.col(column) < F.lit(limit)
    return F.col(column).isNull() | low if limit > 0 else F.col(column).isNotNull() & low


def below_score(limit: float) -> Column:
    return _below("score", limit)


def below_ratio(limit: float) -> Column:
    return _below("upvote_ratio", float(limit))


def below_comments(limit: int) -> Column:
    return _below("num_comments", limit)


def title_has(term: str) -> Column:
    return F.contains(F.lower(F.coalesce(F.col("title"), F.lit(""))), F.lit(term.lower()))


def older_than(hours: float, as_of: datetime) -> Column:
    return F.col("created_utc") < hours_before(as_of, hours)


def newer_than(hours: float, as_of: datetime) -> Column:
    return F.col("created_utc") > hours_before(as_of, hours)


def excluded_term(terms: Sequence[str]) -> Column:
    """Reason text of the first listed term the title holds, else null."""
    reason = F.lit(None).cast("string")
    for term in reversed(list(terms)):
        reason = F.when(title_has(term), F.lit(f"Excluded term: {term}")).otherwise(reason)
    return reason


def reject_reason(routine, as_of: datetime) -> Column:
    """One expression for the whole cascade; null means accepted."""
    # The reason texts.
    steps: list[tuple[Column, str]] = []
    if routine.ignore_below_score is not None:
        steps.append((below_score(routine.ignore_below_score), f"Score below {routine.ignore_below_score}"))
    if routine.ignore_below_upvote_ratio is not None:
        ratio = routine.ignore_below_upvote_ratio
        steps.append((below_ratio(ratio), f"Upvote ratio below {ratio}"))
    if routine.ignore_below_comments is not None:
        floor = routine.ignore_below_comments
        steps.append((below_comments(floor), f"Comments below {floor}"))
    for term in routine.exclude_terms:
        steps.append((title_has(term), f"Excluded term: {term}"))
    if routine.ignore_older_than_hours is not None:
        hours = routine.ignore_older_than_hours
        steps.append((older_than(hours, as_of), f"Older than {hours}h"))
    if routine.ignore_newer_than_hours is not None:
        hours = routine.ignore_newer_than_hours
        steps.append((newer_than(hours, as_of), f"Newer than {hours}h"))
    reason = F.lit(None).cast("string")
    for condition, text in reversed(steps):
        reason = F.when(condition, F.lit(text)).otherwise(reason)
    return reason


def with_verdict(posts: DataFrame, routine, as_of: datetime) -> DataFrame:
    """Posts with ``ignored_reason``; accepted rows carry null."""
    return posts.withColumn("ignored_reason", reject_reason(routine, as_of))


def rescrape_after(post_date: Column, hours: float | None, as_of: datetime) -> Column:
    """When a young post is to be visited again; null for posts old enough."""
    if not hours or hours <= 0:
        return F.lit(None).cast("timestamp_ntz")
    later = post_date + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours) * 3600))
    return F.when(post_date > hours_before(as_of, hours), later)


def is_due(column: Column, as_of: datetime) -> Column:
    return column < ntz(as_of)
