"""Comment trees: valid comments, sibling ranks and the best replies per level.

A tree is a table of ``post_id, comment_id, parent_id, seq, author, score, body,
stickied``; ``parent_id`` is null for a top-level comment and ``seq`` is the order
in which siblings were read. Ties in score keep that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadspark.operators.ranking import rank_within, top_k
from threadspark.session import cut_lineage

# Comments kept per level, top level first; None keeps all.
PRESETS: dict[str, tuple[int, ...] | None] = {
    "XS": (3,),
    "SM": (5, 1),
    "MD": (8, 2),
    "LG": (10, 3, 1),
    "XL": None,
}

#: Comments of one part of a thread's JSON text.
JSON_ROWS = 1000


def is_valid(kind: Column | None = None) -> Column:
    """Neither deleted, removed nor stickied; ``kind`` must be a comment if given."""
    # The marks of deleted and removed comments.
    gone = F.coalesce(F.col("body").isin("[deleted]", "[removed]"), F.lit(False))
    anonymous = F.coalesce(F.col("author") == "[deleted]", F.lit(False))
    valid = ~gone & ~anonymous & ~F.coalesce(F.col("stickied"), F.lit(False))
    if kind is not None:
        valid = valid & F.coalesce(kind == "t1", F.lit(False))
    return valid


def valid_comments(comments: DataFrame) -> DataFrame:
    return comments.filter(is_valid()).withColumn("score", F.coalesce("score", F.lit(0)))


def sibling_ranks(comments: DataFrame) -> DataFrame:
    """Rank of each valid comment among its siblings, best score first."""
    keyed = valid_comments(comments).withColumn("_parent", F.coalesce(F.col("parent_id").cast("string"), F.lit("")))
    ranked = rank_within(keyed, ["post_id", "_parent"], [F.desc("score"), F.col("seq")], "sibling_rank")
    return ranked.drop("_parent")


def _step() -> Column:
    """One element of a path; paths sort depth first, best score first."""
    return F.struct((-F.col("score")).alias("down"), F.col("seq").alias("seq"))


def _ranked(comments: DataFrame, limit: int) -> DataFrame:
    order = [F.desc("score"), F.col("seq")]
    return top_k(comments, ["post_id", "parent_id"], order, limit, "_rank", ["comment_id"])


def _best(comments: DataFrame, limit: int) -> DataFrame:
    return _ranked(comments, limit).drop("_rank")


def _level_tree(comments: DataFrame, limits: tuple[int, ...]) -> DataFrame:
    """One read and one ranking of the comments, whatever the number of levels.

    Siblings are cut to the largest limit that any level has for them and written with their ranks; the parents kept then go down
    level by level through joins with that table.
    """
    valid = valid_comments(comments)
    top = F.col("parent_id").isNull()
    if len(limits) == 1:
        return _best(valid.filter(top), limits[0]).withColumn("depth", F.lit(0)).withColumn("path", F.array(_step()))
    most = F.when(top, limits[0]).otherwise(max(limits[1:]))
    best = cut_lineage(_ranked(valid, max(limits)).filter(F.col("_rank") <= most))
    level = best.filter(top).drop("_rank").withColumn("depth", F.lit(0)).withColumn("path", F.array(_step()))
    columns, tree = level.columns, level
    for depth, limit in enumerate(limits[1:], start=1):
        parents = level.select("post_id", F.col("comment_id").alias("parent_id"), F.col("path").alias("_up"))
        below = best.filter(~top & (F.col("_rank") <= limit)).join(parents, ["post_id", "parent_id"])
        below = below.withColumn("depth", F.lit(depth)).withColumn("path", F.concat("_up", F.array(_step())))
        level = cut_lineage(below.select(columns)) if depth < len(limits) - 1 else below.select(columns)
        tree = tree.unionByName(level)
    return tree


def ancestor_paths(comments: DataFrame) -> DataFrame:
    """``post_id, comment_id, path`` of every comment whose ancestors are all present.

    Each round doubles the number of levels a path reaches up, so a thread of
    depth d takes about log2(d) joins. A comment below a missing ancestor finds no
    partner and drops out; one in a circle never reaches the top.
    """
    reach = comments.select("post_id", "comment_id", F.col("parent_id").alias("up"), F.array(_step()).alias("path"))
    reach = cut_lineage(reach)
    finished = -1
    while True:
        counts = reach.agg(F.count_if(F.col("up").isNull()), F.count_if(F.col("up").isNotNull())).first()
        if counts[1] == 0 or counts[0] == finished:
            return reach.filter(F.col("up").isNull()).drop("up")
        finished = counts[0]
        above = reach.select(
            "post_id", F.col("comment_id").alias("up"), F.col("up").alias("_next"), F.col("path").alias("_above")
        )
        longer = reach.filter(F.col("up").isNotNull()).join(above, ["post_id", "up"])
        longer = longer.select(
            "post_id", "comment_id", F.col("_next").alias("up"), F.concat("_above", "path").alias("path")
        )
        reach = cut_lineage(reach.filter(F.col("up").isNull()).unionByName(longer))


def _full_tree(comments: DataFrame) -> DataFrame:
    valid = valid_comments(comments)
    placed = valid.join(ancestor_paths(valid), ["post_id", "comment_id"])
    return placed.withColumn("depth", F.size("path") - 1)


def trim_tree(comments: DataFrame, detail: str = "MD") -> DataFrame:
    """The comments a detail preset keeps, with ``depth`` and a sortable ``path``.

    A comment is kept if its rank among valid siblings is within its level's limit
    and its parent is kept. An unknown preset means MD.
    """
    limits = PRESETS.get(detail, PRESETS["MD"])
    return _full_tree(comments) if limits is None else _level_tree(comments, limits)


def _closing(levels: Column) -> Column:
    return F.repeat(F.lit("]}"), levels)


def nested_parts(tree: DataFrame, part_rows: int = JSON_ROWS) -> DataFrame:
    """``post_id, part, text``: a tree of any depth as nested JSON text, best first, in ordered parts of at most ``part_rows`` comments.

    In path order a comment follows its parent or closes what lies between: the text of each needs the depth of the one before only,
    so there is no loop over levels, and a thread of any size is dealt in parts. The parts of a thread join to one JSON array.
    """
    # The fields of a comment in the output.
    own = F.to_json(F.struct(F.col("author").alias("poster"), "score", "body"))
    rows = tree.withColumn("_own", own).select("post_id", "path", "depth", F.expr("substring(_own, 1, length(_own) - 1)").alias("_own"))
    ranked = rank_within(rows, ["post_id"], [F.col("path")], "_rank")
    ranked = ranked.withColumn("part", F.floor((F.col("_rank") - 1) / part_rows).cast("int"))
    inside = Window.partitionBy("post_id", "part").orderBy("_rank")
    ranked = ranked.withColumns({"_before": F.lag("depth").over(inside), "_own": F.concat("_own", F.lit(',"replies":['))})
    between = F.when(F.col("depth") > F.col("_before"), F.lit("")).otherwise(F.concat(_closing(F.col("_before") - F.col("depth") + 1), F.lit(",")))
    # what stands between parts is left to their ends
    text = F.concat(F.when(F.col("_before").isNull(), F.lit("")).otherwise(between), "_own")
    parts = ranked.groupBy("post_id", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", text.alias("_text")))), lambda x: x["_text"]), "").alias("_text"),
        F.min_by("depth", "_rank").alias("_first"), F.max_by("depth", "_rank").alias("_last"),
    )
    # one row per part
    after = Window.partitionBy("post_id").orderBy("part")
    parts = parts.withColumn("_next", F.lead("_first").over(after))
    end = F.when(F.col("_next").isNull(), F.concat(_closing(F.col("_last") + 1), F.lit("]")))
    end = end.when(F.col("_next") > F.col("_last"), F.lit("")).otherwise(F.concat(_closing(F.col("_last") - F.col("_next") + 1), F.lit(",")))
    start = F.when(F.col("part") == 0, F.lit("[")).otherwise(F.lit(""))
    return parts.select("post_id", "part", F.concat(start, "_text", end).alias("text"))


def nested_comments(tree: DataFrame, part_rows: int = JSON_ROWS) -> DataFrame:
    """``post_id, comments_json``: the whole nested JSON text of each thread. ``parse_json`` turns it into a nested value."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "")
    return nested_parts(tree, part_rows).groupBy("post_id").agg(joined.alias("comments_json"))
