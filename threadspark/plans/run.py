"""One whole run: select, judge, trim, render, record."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadspark.functions.text import label
from threadspark.functions.times import ntz
from threadspark.operators import render
from threadspark.operators import state as tracking
from threadspark.operators.comments import PRESETS, nested_comments, trim_tree
from threadspark.operators.history import query_map
from threadspark.operators.notes import patch_notes
from threadspark.plans import rules
from threadspark.plans.routines import (
    BROADCAST_ROWS,
    Routine,
    by_routine,
    classify,
    once_per_run,
    run_routines,
    with_status,
)
from threadspark.session import cut_lineage
from threadspark.sinks.files import note_path
from threadspark.sources.feeds import direct_targets


def judge(posts: DataFrame, state: DataFrame, routine: Routine, as_of: datetime) -> DataFrame:
    """Named posts with ``kind`` and ``status``, judged by one routine's rules and no limit."""
    known = classify(tracking.lookup(posts, state), as_of)
    return with_status(rules.with_verdict(known, routine, as_of).withColumn("routine_id", F.lit(routine.routine_id)))


class Revisit(NamedTuple):
    """``accepted``: due posts that still pass the rules; ``notes``: their patched
    notes; ``state``: the tracking table afterwards; ``history``: the entries to append."""

    accepted: DataFrame
    notes: DataFrame
    state: DataFrame
    history: DataFrame


def refreshed_notes(
    accepted: DataFrame, threads: DataFrame, state: DataFrame, notes: DataFrame, detail: str, as_of: datetime
) -> DataFrame:
    """``post_id, path, content, part``: the notes of accepted posts, patched and with their update blocks."""
    sections = render.render_comments(threads, detail, state)
    blocks = render.render_updates(sections.filter(F.col("part") == 0).drop("part"), as_of)
    bare = render.update_block(F.lit(""), as_of)
    updates = accepted.select("post_id", "score").join(blocks, "post_id", "left")
    updates = updates.withColumn("update_block", F.coalesce("update_block", bare))
    patched = patch_notes(notes, updates, as_of).withColumn("part", F.lit(0))
    more = sections.filter(F.col("part") > 0).join(patched.select("post_id", "path"), "post_id")
    return patched.unionByName(more.select("post_id", "path", F.col("comment_section").alias("content"), "part"))


def revisit(
    posts: DataFrame, comments: DataFrame, state: DataFrame, notes: DataFrame, settings: Routine, as_of: datetime
) -> Revisit:
    """Visit every post again whose time has come.

    ``posts`` and ``comments`` are fresh captures, ``notes`` has ``post_id, path,
    content``. A post that no longer passes keeps its row and its note.
    """
    due = posts.join(tracking.maturing(state, as_of).select("post_id"), "post_id", "left_semi")
    accepted = cut_lineage(judge(due, state, settings, as_of).filter(F.col("status") == "accepted"))
    threads = comments.join(accepted.select("post_id"), "post_id", "left_semi")
    rows = state_rows(accepted, [settings], as_of, comment_dumps(accepted, comments, [settings])).drop("kind")
    rows = with_known_paths(rows, state)
    return Revisit(
        accepted,
        refreshed_notes(accepted, threads, state, notes, settings.detail, as_of),
        tracking.update_later(tracking.conform(state), rows),
        history_rows(accepted.withColumn("pos", F.lit(0)), [settings], as_of),
    )


class Run(NamedTuple):
    """``seen``: every feed row looked at; ``accepted``: each accepted post once, with
    its routine; ``notes``: rendered notes; ``state``: the tracking table afterwards;
    ``history``: the entries to append to the history; ``changes``: the rows of ``state`` that are new or were
    written again, as ``Snapshots.commit_changes`` takes them."""

    seen: DataFrame
    accepted: DataFrame
    notes: DataFrame
    state: DataFrame
    history: DataFrame
    changes: DataFrame


def _only(rows: DataFrame, ids: DataFrame, bound: int | None) -> DataFrame:
    """Rows of the given posts; the ids are broadcast if their bound is known and small."""
    ids = F.broadcast(ids) if bound is not None and bound <= BROADCAST_ROWS else ids
    return rows.join(ids, "post_id", "left_semi")


def with_known_paths(rows: DataFrame, state: DataFrame, bound: int | None = None) -> DataFrame:
    """Rows with the ``file_path`` that the state has for them, or their own where it has none."""
    paths = _only(state.select("post_id", F.col("file_path").alias("_path")), rows.select("post_id"), bound)
    return rows.join(paths, "post_id", "left").withColumn("file_path", F.coalesce("_path", "file_path")).drop("_path")


def _note_path(rows: DataFrame, routines: Sequence[Routine]) -> Column:
    return by_routine(routines, lambda r: note_path(rows, r.group_by) if r.save_md else F.lit(None))


def render_run(
    accepted: DataFrame,
    comments: DataFrame,
    state: DataFrame,
    routines: Sequence[Routine],
    as_of: datetime,
    bound: int | None = None,
    old_notes: DataFrame | None = None,
) -> DataFrame:
    """``post_id, path, part, content`` of the accepted posts, each by its routine's settings.

    A revisited post that has a note in ``old_notes`` gets that note back, patched; one without gets a whole note
    under its known path. Routines with the same rendering settings share one plan. ``bound`` is the most
    posts there can be, if that is known.
    """
    alike: dict[tuple, list[Routine]] = {}
    for routine in routines:
        if routine.save_md:
            key = (routine.detail, routine.rescrape_newer_than_hours, tuple(routine.ignore_urls))
            alike.setdefault(key, []).append(routine)
    notes = None
    for (detail, hours, ignored), group in alike.items():
        rows = accepted.filter(F.col("routine_id").isin([r.routine_id for r in group]))
        if old_notes is not None:
            again = rows.filter(F.col("kind") == "rescrape")
            old = _only(old_notes, again.select("post_id"), bound)
            rows = rows.join(old.select("post_id"), "post_id", "left_anti")
            part = refreshed_notes(again, _only(comments, again.select("post_id"), bound), state, old, detail, as_of)
            notes = part if notes is None else notes.unionByName(part)
        threads = _only(comments, rows.select("post_id"), bound)
        texts = render.render_posts(rows, as_of, state, threads, detail, hours, ignored)
        paths = with_known_paths(rows.select("post_id", _note_path(rows, group).alias("file_path")), state, bound)
        part = texts.join(paths.withColumnRenamed("file_path", "path"), "post_id")
        notes = part if notes is None else notes.unionByName(part)
    return notes


def history_rows(seen: DataFrame, routines: Sequence[Routine], as_of: datetime) -> DataFrame:
    """``post_id, ts, seq, type, query``: the history entries a run adds; rejected posts leave none."""
    def settings(routine: Routine) -> Column:
        pairs = [F.lit(text) for pair in routine.settings().items() for text in pair]
        return query_map(F.create_map(*pairs))

    kept = seen.filter(F.col("status") != "rejected")
    return kept.select(
        "post_id",
        ntz(as_of).alias("ts"),
        (F.col("routine_id").cast("long") * 1_000_000_000 + F.col("pos")).alias("seq"),
        F.col("kind").alias("type"),
        by_routine(routines, settings).alias("query"),
    )


def _keeps_detail(routine: Routine) -> bool:
    return routine.detailed_db or not routine.save_json


def comment_dumps(
    accepted: DataFrame, comments: DataFrame, routines: Sequence[Routine], bound: int | None = None
) -> DataFrame | None:
    """``post_id, comments_dump`` for routines that keep details: the tree their preset keeps, whole threads for XL."""
    dumps = None
    for detail in PRESETS:
        group = [r.routine_id for r in routines if _keeps_detail(r) and (r.detail if r.detail in PRESETS else "MD") == detail]
        if not group:
            continue
        ids = accepted.filter(F.col("routine_id").isin(group)).select("post_id")
        part = nested_comments(trim_tree(_only(comments, ids, bound), detail))
        dumps = part if dumps is None else dumps.unionByName(part)
    return None if dumps is None else dumps.withColumnRenamed("comments_json", "comments_dump")


def state_rows(
    accepted: DataFrame, routines: Sequence[Routine], as_of: datetime, dumps: DataFrame | None = None
) -> DataFrame:
    """State columns of the accepted posts, plus the ``kind`` of the visit."""
    if dumps is not None:
        accepted = accepted.join(dumps, "post_id", "left")
    written = accepted.withColumns(
        {
            "label": label(F.col("post_flair")),
            "sort_method": by_routine(routines, lambda r: F.lit(r.sort)),
            "post_timestamp": F.col("created_utc"),
            "first_scrape_timestamp": ntz(as_of),
            "last_scrape_timestamp": ntz(as_of),
            "rescrape_after": by_routine(
                routines, lambda r: rules.rescrape_after(F.col("created_utc"), r.rescrape_newer_than_hours, as_of)
            ),
            "file_path": _note_path(accepted, routines),
            "json_path": by_routine(
                routines, lambda r: F.concat("post_id", F.lit(".json")) if r.save_json else F.lit(None)
            ),
            "ignored_reason": F.lit(None),
        }
    )
    keep = F.col("routine_id").isin([r.routine_id for r in routines if _keeps_detail(r)])
    return tracking.conform(tracking.detailed(written, keep), ["kind"])


def accepted_posts(posts: DataFrame, seen: DataFrame, routines: Sequence[Routine]) -> DataFrame:
    """The posts of the accepted feed rows, each once, with ``routine_id, pos, kind``."""
    first = seen.join(once_per_run(seen), ["post_id", "routine_id", "pos"], "left_semi")
    first = first.select("post_id", "routine_id", "pos", "kind")
    bound = sum(r.max_results for r in routines)
    return posts.join(F.broadcast(first) if bound <= BROADCAST_ROWS else first, "post_id")


def run(
    posts: DataFrame,
    comments: DataFrame,
    state: DataFrame,
    routines: Sequence[Routine],
    as_of: datetime,
    notes: DataFrame | None = None,
) -> Run:
    """All routines on the captured posts, against one state; ``notes`` (post_id, path, content) are the existing ones.

    What the routines look at is bounded by their horizons. It is written once, and
    the accepted posts are fetched once by id; every later step starts from those.
    """
    seen = cut_lineage(run_routines(posts, routines, as_of, state))
    accepted = cut_lineage(accepted_posts(posts, seen, routines))
    bound = sum(r.max_results for r in routines)
    notes = render_run(accepted, comments, state, routines, as_of, bound, notes)
    changes, after = _recorded(seen, accepted, comments, state, routines, as_of, bound)
    return Run(seen, accepted, notes, after, history_rows(seen, routines, as_of), changes)


def _recorded(
    seen: DataFrame,
    accepted: DataFrame,
    comments: DataFrame,
    state: DataFrame,
    routines: Sequence[Routine],
    as_of: datetime,
    bound: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The rows that a run changes, and the tracking table afterwards.

    Whole rows are written for accepted posts only, whose number the limits bound. Posts that were only seen again may be most of the
    state: their ids are written once and meet it in one join, and where they are few, untouched rows pass by without a shuffle.
    """
    state = tracking.conform(state)
    touched = cut_lineage(_only(state, accepted.select("post_id"), bound))
    rows = state_rows(accepted, routines, as_of, comment_dumps(accepted, comments, routines, bound))
    first = tracking.first_changes(touched, rows.filter(F.col("kind") == "initial").drop("kind"))
    later = with_known_paths(rows.filter(F.col("kind") == "rescrape").drop("kind"), touched, bound)
    # written at the run's moment, so a hit of another routine moves them no further
    written = cut_lineage(tracking.conform(first.unionByName(tracking.later_changes(touched, later))))
    ids = accepted.select("post_id")
    others = state.join(F.broadcast(ids) if bound is not None and bound <= BROADCAST_ROWS else ids, "post_id", "left_anti")
    again = seen.filter(F.col("status") == "hit").select("post_id").distinct()
    again = cut_lineage(again.join(ids, "post_id", "left_anti"))
    few = again.count() <= tracking.BROADCAST_ROWS
    last = again.withColumn("_seen", ntz(as_of))
    moved = others.join(F.broadcast(last) if few else last, "post_id", "left")
    moved = moved.withColumn("last_scrape_timestamp", F.greatest("last_scrape_timestamp", "_seen"))
    changes = tracking.conform(moved.filter(F.col("_seen").isNotNull())).unionByName(written)
    return changes, tracking.conform(moved).unionByName(written)


def run_targets(
    targets: DataFrame,
    posts: DataFrame,
    comments: DataFrame,
    state: DataFrame,
    settings: Routine,
    as_of: datetime,
    notes: DataFrame | None = None,
) -> Run:
    """Visit the posts named in ``targets(target)`` by id or URL, by the same rules and with no limit."""
    judged = judge(direct_targets(targets, posts), state, settings, as_of)
    seen = cut_lineage(judged.withColumn("pos", F.lit(0)))
    accepted = seen.filter(F.col("status") == "accepted")
    notes = render_run(accepted, comments, state, [settings], as_of, None, notes)
    changes, after = _recorded(seen, accepted, comments, state, [settings], as_of)
    return Run(seen, accepted, notes, after, history_rows(seen, [settings], as_of), changes)
