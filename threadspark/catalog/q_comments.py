"""Checks of comment trees and their rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadspark.catalog.inputs import SIGHT_AS_OF, Inputs
from threadspark.catalog.registry import query
from threadspark.operators import render
from threadspark.operators.comments import PRESETS, nested_comments, sibling_ranks, trim_tree

RANKED_SQL = """ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY post_id, parent_id ORDER BY score DESC, seq) AS INT) AS sibling_rank
  FROM comments WHERE body NOT IN ('[deleted]', '[removed]') AND author <> '[deleted]' AND NOT stickied)"""


def tree_sql(limits: tuple[int, ...] | None) -> str:
    """Top-down walk over ranked siblings; ``path`` sorts depth first."""
    if limits is None:
        top, below = "TRUE", "TRUE"
    else:
        top = f"sibling_rank <= {limits[0]}"
        cases = " ".join(f"WHEN {d} THEN {n}" for d, n in enumerate(limits[1:], start=1))
        below = f"c.sibling_rank <= CASE t.depth + 1 {cases} ELSE 0 END" if cases else "FALSE"
    return f"""{RANKED_SQL},
tree AS (
  SELECT post_id, comment_id, parent_id, 0 AS depth, author, score, body, [sibling_rank] AS path
  FROM ranked WHERE parent_id IS NULL AND {top}
  UNION ALL
  SELECT c.post_id, c.comment_id, c.parent_id, t.depth + 1, c.author, c.score, c.body, list_append(t.path, c.sibling_rank)
  FROM ranked c JOIN tree t ON c.parent_id = t.comment_id AND c.post_id = t.post_id WHERE {below})"""


LINE_SQL = """repeat(chr(9), depth) || '- **' || author || '** (' || CAST(score AS VARCHAR) || ' pts):' || chr(10)
  || repeat(chr(9), depth) || '  ' || replace(body, chr(10), chr(10) || repeat(chr(9), depth + 1)) || chr(10)"""


def section_sql(preset: str) -> str:
    return f"""WITH RECURSIVE {tree_sql(PRESETS[preset])}
      SELECT post_id, string_agg({LINE_SQL}, '' ORDER BY path) AS comment_section FROM tree GROUP BY post_id"""


@query("comment_sibling_rank", f"WITH {RANKED_SQL} SELECT comment_id, sibling_rank FROM ranked")
def comment_sibling_rank(i: Inputs):
    return sibling_ranks(i.comments).select("comment_id", "sibling_rank")


for preset, limits in PRESETS.items():
    query(
        f"comment_tree_{preset.lower()}",
        f"""WITH RECURSIVE {tree_sql(limits)}
            SELECT post_id, comment_id, coalesce(parent_id, -1) AS parent_id, CAST(depth AS INT) AS depth, score FROM tree""",
    )(
        lambda i, preset=preset: trim_tree(i.comments, preset).select(
            "post_id", "comment_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), "depth", "score"
        )
    )


@query("render_comments", section_sql("LG"))
def render_comments(i: Inputs):
    return render.render_comments(i.comments, "LG").select("post_id", "comment_section")


@query("render_whole_threads", section_sql("XL"))
def render_whole_threads(i: Inputs):
    return render.render_comments(i.comments, "XL").select("post_id", "comment_section")


@query(
    "render_update",
    f"""WITH RECURSIVE {tree_sql(PRESETS['MD'])}
      SELECT post_id, chr(10) || '---' || chr(10) || '## Updated Comments (2024-01-31 00:00)' || chr(10) || chr(10)
        || string_agg({LINE_SQL}, '' ORDER BY path) || chr(10) AS update_block FROM tree GROUP BY post_id""",
)
def render_update(i: Inputs):
    sections = render.render_comments(i.comments, "MD").drop("part")
    return render.render_updates(sections, SIGHT_AS_OF).select("post_id", "update_block")


AUTHOR_SQL = "to_json(author)::VARCHAR"
BODY_SQL = "to_json(body)::VARCHAR"


def plain_node(replies: str) -> str:
    return f"""'{{"poster":' || {AUTHOR_SQL} || ',"score":' || CAST(score AS VARCHAR) || ',"body":' || {BODY_SQL}
      || ',"replies":[' || {replies} || ']}}'"""


def sorted_node(replies: str) -> str:
    """The same with its fields in name order, as a nested value keeps them."""
    return f"""'{{"body":' || {BODY_SQL} || ',"poster":' || {AUTHOR_SQL} || ',"replies":[' || {replies}
      || '],"score":' || CAST(score AS VARCHAR) || '}}'"""


def nested_sql(node) -> str:
    inner = node("coalesce(r, '')")
    return f"""replies2 AS (SELECT post_id, parent_id, string_agg({node("''")}, ',' ORDER BY path) AS r
      FROM tree WHERE depth = 2 GROUP BY post_id, parent_id),
    replies1 AS (SELECT t.post_id, t.parent_id, string_agg({inner}, ',' ORDER BY path) AS r
      FROM tree t LEFT JOIN replies2 c ON t.comment_id = c.parent_id WHERE depth = 1 GROUP BY t.post_id, t.parent_id),
    nested AS (SELECT t.post_id, '[' || string_agg({inner}, ',' ORDER BY path) || ']' AS comments_json
      FROM tree t LEFT JOIN replies1 c ON t.comment_id = c.parent_id WHERE depth = 0 GROUP BY t.post_id)"""


#: A node opens its replies; the next one closes what lies between. ``nested`` has the text of each thread.
WHOLE_JSON_SQL = f"""stepped AS (SELECT *, lag(depth) OVER (PARTITION BY post_id ORDER BY path) AS up FROM tree),
    nested AS (SELECT post_id, '[' || string_agg(
        CASE WHEN up IS NULL OR depth > up THEN '' ELSE repeat(']}}', up - depth + 1) || ',' END
        || '{{"poster":' || {AUTHOR_SQL} || ',"score":' || CAST(score AS VARCHAR) || ',"body":' || {BODY_SQL} || ',"replies":[', '' ORDER BY path)
        || repeat(']}}', last(depth ORDER BY path) + 1) || ']' AS comments_json FROM stepped GROUP BY post_id)"""


@query("comments_nested_whole", f"WITH RECURSIVE {tree_sql(None)}, {WHOLE_JSON_SQL} SELECT post_id, comments_json FROM nested")
def comments_nested_whole(i: Inputs):
    return nested_comments(trim_tree(i.comments, "XL"))


@query("comments_nested", f"WITH RECURSIVE {tree_sql(PRESETS['LG'])}, {nested_sql(plain_node)} SELECT post_id, comments_json FROM nested")
def comments_nested(i: Inputs):
    return nested_comments(trim_tree(i.comments, "LG"))
