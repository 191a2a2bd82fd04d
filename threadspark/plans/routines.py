"""Routines: named settings, their merge with defaults, and their evaluation on posts."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, fields
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadspark.operators.ranking import rank_within, top_k
from threadspark.plans import query, rules
from threadspark.session import cut_lineage

BROADCAST_ROWS = 100_000
#: Feed positions a run looks at first, and how much deeper it looks each time that wasn't enough.
FIRST_POSITIONS, DEEPER = 100, 16
#: Positions that are still taken from the top; beyond them the rest of a feed is ranked whole.
MOST_POSITIONS = 50_000


@dataclass(frozen=True)
class Routine:
    """Settings of one routine; the values here are the defaults of every routine."""

    routine_id: int = 0
    name: str | None = None
    subreddit: Sequence[str] = ()
    sort: str = "new"
    max_results: int = 8
    offset: int = 0
    horizon: int | None = None  # feed positions behind the offset that a run may look at; the whole feed if None
    timeframe: str | None = None
    post_type: str | None = None
    allow_nsfw: bool = False
    nsfw_only: bool = False
    spoiler: bool = False
    search: Mapping | None = None
    flair_contains: Sequence[str] = ()
    flair: Sequence[str] = ()
    exclude_flair: Sequence[str] = ()
    exclude_terms: Sequence[str] = ()
    exclude_urls: Sequence[str] = ()
    exclude_author: Sequence[str] = ()
    author: Sequence[str] = ()
    domain: Sequence[str] = ()
    selftext: Sequence[str] = ()
    title_search: Sequence[str] = ()
    ignore_urls: Sequence[str] = ()
    ignore_below_score: int | None = 50
    ignore_below_upvote_ratio: float | None = None
    ignore_below_comments: int | None = None
    ignore_older_than_hours: float | None = None
    ignore_newer_than_hours: float | None = None
    rescrape_newer_than_hours: float | None = 12
    detail: str = "MD"
    group_by: str | None = None
    save_json: bool = True
    save_md: bool = True
    detailed_db: bool = False
    track: bool = True
    enable_md_log: bool = True
    db_limit: int = 1000
    extra: Mapping = field(default_factory=dict)

    def settings(self) -> dict[str, str]:
        """The settings a run used, as texts for the history; unset ones are left out."""
        out = {}
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name in ("routine_id", "extra") or value is None or value == ():
                continue
            out[f.name] = value if isinstance(value, str) else json.dumps(value)
        return out

    def terms(self) -> list[str]:
        return [*query.search_terms(self.search), *self.title_search, *self.selftext]


# Other spellings of the settings.
ALIASES = {
    "subreddits": "subreddit",
    "label": "flair_contains",
    "flair_exact": "flair",
    "label_exact": "flair",
    "exact_flair": "flair",
    "exclude_label": "exclude_flair",
    "exclude_authors": "exclude_author",
    "query": "search",
    "min_score": "ignore_below_score",
    "time_filter": "timeframe",
    "max_age_hours": "ignore_older_than_hours",
    "min_age_hours": "ignore_newer_than_hours",
}
AGE_SETTINGS = ("ignore_older_than", "ignore_newer_than", "rescrape_newer_than")
LIST_SETTINGS = {f.name for f in fields(Routine) if f.default == ()}


def make_routine(*layers: Mapping | None, routine_id: int = 0) -> Routine:
    """Merge setting layers, weakest first; within each the last value that is not null wins."""
    known = {f.name for f in fields(Routine)}
    merged: dict = {}
    for layer in layers:
        given = {k: v for k, v in (layer or {}).items() if v is not None}
        for key, value in given.items():
            target = ALIASES.get(key, key)
            if target == key or target not in given:
                merged[target] = value
    for base in AGE_SETTINGS:
        days = merged.pop(f"{base}_days", None)
        if days is not None and merged.get(f"{base}_hours") is None:
            merged[f"{base}_hours"] = days * 24
    values = {k: v for k, v in merged.items() if k in known}
    for key in LIST_SETTINGS & values.keys():
        if key == "subreddit" and isinstance(values[key], str):
            values[key] = [] if values[key].strip().lower() in query.ANY_SUBREDDIT else [values[key]]
        values[key] = tuple(query.listed(values[key]))
    values["extra"] = {k: v for k, v in merged.items() if k not in known}
    values["routine_id"] = routine_id
    return Routine(**values)


def routines_named(routines: DataFrame, name: str) -> DataFrame:
    """Rows of a routine table with this name in any case."""
    return routines.filter(F.lower(F.coalesce("name", F.lit(""))) == name.lower())


def resolve(routines: DataFrame, defaults: Mapping[str, object], overrides: Mapping[str, object] | None = None) -> DataFrame:
    """Settings of every row of a routine table: override, else own value, else default.

    ``defaults`` and ``overrides`` are single sets of settings, so they enter as
    literals and the merge is a projection. Day values fill hours that are null in
    the routine and in the defaults; list columns are never null.
    """
    overrides = {k: v for k, v in (overrides or {}).items() if v is not None}
    columns: dict[str, Column] = {}
    for name in routines.columns:
        kind = routines.schema[name].dataType.simpleString()
        if kind.startswith("array"):
            value = F.coalesce(F.col(name), F.array().cast(kind))
        else:
            value = F.col(name)
        if name in defaults and defaults[name] is not None and not kind.startswith("array"):
            value = F.coalesce(value, F.lit(defaults[name]).cast(kind))
        if name in overrides:
            literal = overrides[name]
            literal = F.array(*[F.lit(v) for v in literal]) if isinstance(literal, (list, tuple)) else F.lit(literal)
            value = literal.cast(kind)
        columns[name] = value
    for base in AGE_SETTINGS:
        days, hours = f"{base}_days", f"{base}_hours"
        if days in columns and hours in columns:
            columns[hours] = F.coalesce(columns[hours], columns.pop(days) * 24)
    return routines.select(*[value.alias(name) for name, value in columns.items()])


def retention_limit(routines: DataFrame) -> DataFrame:
    """State rows to keep: the largest ``db_limit`` of all routines, at least 1000."""
    return routines.agg(F.greatest(F.lit(1000), F.coalesce(F.max("db_limit"), F.lit(0))).alias("keep_rows"))


def match_routines(posts: DataFrame, routines: Sequence[Routine], as_of: datetime) -> DataFrame:
    """One row per post and matching routine, with the routine's feed order and verdict.

    Routines are settings, so their rules become columns: the posts are read once
    and never joined to a routine table. Posts that no routine can want, by the rules
    that look at whole values, are left out in the scan.
    """
    posts = posts.filter(query.any_of([query.narrowed(r, as_of) for r in routines]))
    hits = [
        F.when(
            query.matches(r, as_of),
            F.struct(
                F.lit(r.routine_id).alias("routine_id"),
                query.order_key(r.sort, as_of, r.terms()).alias("sort_key"),
                rules.reject_reason(r, as_of).alias("ignored_reason"),
            ),
        )
        for r in routines
    ]
    matched = posts.withColumn("_hit", F.explode(F.array_compact(F.array(*hits))))
    return matched.select("*", "_hit.*").drop("_hit")


def by_routine(routines: Sequence[Routine], value: Callable[[Routine], Column]) -> Column:
    """A setting, or an expression made from it, chosen by each row's ``routine_id``."""
    chosen: Column | None = None
    for routine in routines:
        mine = F.col("routine_id") == routine.routine_id
        chosen = F.when(mine, value(routine)) if chosen is None else chosen.when(mine, value(routine))
    return F.lit(None) if chosen is None else chosen


def within_horizon(feed: DataFrame, routines: Sequence[Routine]) -> DataFrame:
    """Feed positions from a routine's offset up to its horizon."""
    first = by_routine(routines, lambda r: F.lit(r.offset))
    bound = by_routine(routines, lambda r: F.lit(None if r.horizon is None else r.offset + r.horizon).cast("int"))
    return feed.filter((F.col("pos") >= first) & F.coalesce(F.col("pos") < bound, F.lit(True)))


def _ranked(matched: DataFrame, size: int | None) -> DataFrame:
    """The first ``size`` rows of each routine's feed, or all of them, with ``pos`` from 0."""
    order = [F.desc("sort_key"), F.col("post_id")]
    if size is None:
        ranked = rank_within(matched, ["routine_id"], order, "_rank")
    else:
        ranked = top_k(matched, ["routine_id"], order, size, "_rank", ["post_id"])
    return ranked.withColumn("pos", (F.col("_rank") - 1).cast("int")).drop("_rank")


def feed_window(matched: DataFrame, routines: Sequence[Routine]) -> DataFrame:
    """The feed positions each routine may look at, numbered from 0 in ``pos``."""
    bounded = all(r.horizon is not None for r in routines)
    deepest = max(r.offset + r.horizon for r in routines) if bounded else None
    return within_horizon(_ranked(matched, deepest), routines)


@dataclass
class _Feed:
    """How far a routine's feed has been read: positions, and the key and id of the last one."""

    routine: Routine
    read: int = 0
    last: tuple[float | None, str] | None = None
    ended: bool = False

    def rest(self) -> Column:
        """Rows behind the last one, in feed order."""
        mine = F.col("routine_id") == self.routine.routine_id
        if self.last is None:
            return mine
        key, post = self.last
        behind = F.col("post_id") > post
        if key is None:
            return mine & F.col("sort_key").isNull() & behind
        lower = F.col("sort_key").isNull() | (F.col("sort_key") < key)
        return mine & (lower | ((F.col("sort_key") == key) & behind))


def _deeper(source: DataFrame, feeds: Sequence[_Feed], size: int) -> DataFrame:
    """The next ``size`` positions of each feed, written; what was read is noted in ``feeds``. Feeds read to their end aren't written here."""
    routines = [f.routine for f in feeds]
    before = {f.routine.routine_id: f.read for f in feeds}
    whole = size > MOST_POSITIONS
    window = _ranked(source.filter(query.any_of([f.rest() for f in feeds])), None if whole else size)
    window = window.withColumn("pos", F.col("pos") + by_routine(routines, lambda r: F.lit(before[r.routine_id])))
    if whole:
        for feed in feeds:
            feed.ended = True
        return within_horizon(window, routines)
    window = cut_lineage(window)
    # one row per routine
    ends = window.groupBy("routine_id").agg(F.count(F.lit(1)), F.max(F.struct("pos", "sort_key", "post_id"))).collect()
    found = {row[0]: (row[1], row[2]) for row in ends}
    for feed in feeds:
        count, last = found.get(feed.routine.routine_id, (0, None))
        feed.read += count
        feed.last = feed.last if last is None else (last["sort_key"], last["post_id"])
        horizon = feed.routine.horizon
        feed.ended = count < size or (horizon is not None and feed.read >= feed.routine.offset + horizon)
    return within_horizon(window, routines)


def lookup_state(feed: DataFrame, state: DataFrame, feed_rows: int) -> DataFrame:
    """Feed rows with ``known`` and the state's ``rescrape_after``.

    ``feed_rows`` bounds the feed. While that bound is small the state is reduced by a broadcast of the feed's ids
    instead of being shuffled; beyond it both sides are shuffled once.
    """
    seen = state.select("post_id", "rescrape_after", F.lit(True).alias("known"))
    if feed_rows <= BROADCAST_ROWS:
        seen = seen.join(F.broadcast(feed.select("post_id").distinct()), "post_id", "left_semi")
    joined = feed.join(seen, "post_id", "left")
    return joined.withColumn("known", F.coalesce("known", F.lit(False)))


def classify(feed: DataFrame, as_of: datetime) -> DataFrame:
    """``kind`` of each feed row: initial, rescrape or hit; verdicts only matter for the first two."""
    due = F.coalesce(rules.is_due(F.col("rescrape_after"), as_of), F.lit(False))
    kind = F.when(~F.col("known"), "initial").when(due, "rescrape").otherwise("hit")
    return feed.withColumn("kind", kind)


def with_status(feed: DataFrame) -> DataFrame:
    """``status`` of classified rows: hit, rejected or accepted; only rejected rows keep a reason."""
    status = (
        F.when(F.col("kind") == "hit", "hit")
        .when(F.col("ignored_reason").isNotNull(), "rejected")
        .otherwise("accepted")
    )
    reason = F.when(F.col("status") == "rejected", F.col("ignored_reason"))
    return feed.withColumn("status", status).withColumn("ignored_reason", reason)


def accept(feed: DataFrame, routines: Sequence[Routine]) -> DataFrame:
    """Rows a run really sees: in feed order until ``max_results`` are accepted.

    ``status`` is accepted, rejected or hit. Only the accepted rows are ranked, and of those no more than the limits; the position of a
    routine's last one cuts its feed, so a feed in which everything is rejected gathers in no task.
    """
    judged = with_status(feed)
    limit = by_routine(routines, lambda r: F.lit(r.max_results))
    most = max(1, *(r.max_results for r in routines))
    taken = judged.filter(F.col("status") == "accepted").select("routine_id", "pos", "post_id")
    last = top_k(taken, ["routine_id"], [F.col("pos")], most, "_rank", ["post_id"]).filter(F.col("_rank") == limit)
    # one row per routine
    cut = F.broadcast(last.select("routine_id", F.col("pos").alias("_cut")))
    seen = judged.join(cut, "routine_id", "left").filter((limit > 0) & (F.col("_cut").isNull() | (F.col("pos") <= F.col("_cut"))))
    return seen.drop("_cut")


def accept_in_turn(feed: DataFrame, routines: Sequence[Routine]) -> DataFrame:
    """``accept`` for routines that run one after the other: a post that an earlier one accepted is a hit for later ones.

    All routines are judged together, again and again, each time with the posts that the last pass gave to earlier routines. A pass
    settles the first routine that isn't settled yet and mostly all others; the passes end when none changes. Only the accepted posts, bounded by
    the limits, are written between passes.
    """
    turn = {r.routine_id: k for k, r in enumerate(routines)}
    own = by_routine(routines, lambda r: F.lit(turn[r.routine_id]))
    bound = sum(r.max_results for r in routines)
    seen, mark = accept(feed, routines), None
    while True:
        taken = seen.filter(F.col("status") == "accepted").groupBy("post_id").agg(F.min(own).alias("_turn"))
        taken = cut_lineage(taken)
        new = taken.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("post_id", "_turn"))).first()
        if new == mark:
            return seen
        mark = new
        blocked = feed.join(F.broadcast(taken) if bound <= BROADCAST_ROWS else taken, "post_id", "left")
        kind = F.when(F.col("_turn") < own, "hit").otherwise(F.col("kind"))
        seen = accept(blocked.withColumn("kind", kind).drop("_turn"), routines)


def run_routines(
    posts: DataFrame, routines: Sequence[Routine], as_of: datetime, state: DataFrame | None,
    settle: Callable[[DataFrame, Sequence[Routine]], DataFrame] = accept,
) -> DataFrame:
    """All routines in one job, each judged against the state at the start of the run.

    Gives ``routine_id, pos, post_id, kind, status, ignored_reason`` of every feed row seen. Feeds are read from the top in windows of growing
    depth, and only for routines that are neither filled nor at their end or horizon. The posts are scanned for the first window, and once
    more if some routine needs a second one; that scan writes the keys of what is left of those feeds. Only the ids and keys of the posts are ranked,
    and each window is written before the state is asked about it. Without a state every post counts as new.
    """
    keys = ["post_id", "routine_id", "sort_key", "ignored_reason"]
    feeds = [_Feed(r) for r in routines]
    wanted, covered = feeds, set()
    judged: DataFrame | None = None
    size = max((r.offset for r in routines), default=0) + FIRST_POSITIONS
    while True:
        ids = {f.routine.routine_id for f in wanted}
        if not ids <= covered:
            source = match_routines(posts, [f.routine for f in wanted], as_of).select(keys)
            if judged is not None:
                source, covered = cut_lineage(source.filter(query.any_of([f.rest() for f in wanted]))), ids
        window = _deeper(source, wanted, size)
        if state is None:
            window = window.withColumn("known", F.lit(False)).withColumn("rescrape_after", F.lit(None).cast("timestamp_ntz"))
        else:
            window = lookup_state(window, state, size * len(wanted) if size <= MOST_POSITIONS else BROADCAST_ROWS + 1)
        window = cut_lineage(classify(window, as_of))
        judged = window if judged is None else judged.unionByName(window)
        seen = settle(judged, routines)
        if all(f.ended for f in feeds):
            return seen
        counts = seen.filter(F.col("status") == "accepted").groupBy("routine_id").count().collect()  # one row per routine
        taken = {row["routine_id"]: row["count"] for row in counts}
        # a routine that lost posts to an earlier one may be open again
        wanted = [f for f in feeds if not f.ended and taken.get(f.routine.routine_id, 0) < f.routine.max_results]
        if not wanted:
            return seen
        size *= DEEPER


def run_sequential(posts: DataFrame, routines: Sequence[Routine], as_of: datetime, state: DataFrame) -> DataFrame:
    """Routines one after the other: a post an earlier routine accepted is a hit for later ones.

    The posts are read as often as by ``run_routines``, whatever the number of routines.
    """
    return run_routines(posts, routines, as_of, state, accept_in_turn)


def once_per_run(seen: DataFrame) -> DataFrame:
    """Accepted rows with each post once, kept for the routine that saw it first.

    A minimum per post combines on the map side, so a post that every routine
    returns does not gather its rows in one task.
    """
    accepted = seen.filter(F.col("status") == "accepted")
    first = F.min(F.struct("routine_id", "pos"))
    return accepted.groupBy("post_id").agg(first.alias("_first")).select("post_id", "_first.*")


def run_totals(seen: DataFrame) -> DataFrame:
    """New and updated posts per routine."""
    return seen.groupBy("routine_id").agg(
        F.count_if((F.col("status") == "accepted") & (F.col("kind") == "initial")).alias("new_posts"),
        F.count_if((F.col("status") == "accepted") & (F.col("kind") == "rescrape")).alias("updated_posts"),
    )
