import json
import random

import pytest

from tests.conftest import rows
from threadspark.operators import comments, render
from threadspark.operators.comments import nested_comments, nested_parts, trim_tree
from threadspark.sources import threads
from threadspark.catalog.inputs import Inputs

DDL = "post_id string, comment_id long, parent_id long, seq long, author string, score int, body string, stickied boolean"


def tree(spark, *nodes):
    """Nodes as (id, parent, score) with optional body, author, stickied."""
    data = []
    for seq, node in enumerate(nodes):
        cid, parent, score, *rest = node
        body, author, stickied = (list(rest) + ["b", "a", False][len(rest):])[:3]
        data.append(("p", cid, parent, seq, author, score, body, stickied))
    return spark.createDataFrame(data, DDL)


def kept(df, detail):
    return sorted(r["comment_id"] for r in comments.trim_tree(df, detail).collect())


def test_ties_keep_reading_order(spark):
    df = tree(spark, *[(n, None, 5) for n in range(6)])
    assert kept(df, "XS") == [0, 1, 2]
    assert kept(df, "SM") == [0, 1, 2, 3, 4]


def test_a_cut_or_removed_parent_takes_its_replies_along(spark):
    df = tree(
        spark,
        (1, None, 9), (2, None, 8, "[removed]"), (3, None, 7), (4, None, 6), (5, None, 5),
        (11, 1, 1), (12, 2, 100), (13, 5, 100), (14, 1, 3, "b", "[deleted]"), (15, 1, 2, "b", "a", True),
    )
    assert kept(df, "XS") == [1, 3, 4]
    assert kept(df, "SM") == [1, 3, 4, 5, 11, 13]
    assert kept(df, "XL") == [1, 3, 4, 5, 11, 13]


def test_unknown_preset_is_the_middle_one(spark):
    df = tree(spark, *[(n, None, n) for n in range(10)])
    assert kept(df, "HUGE") == kept(df, "MD") == list(range(2, 10))


def test_levels_beyond_the_preset_are_dropped(spark):
    df = tree(spark, (1, None, 1), (2, 1, 1), (3, 2, 1), (4, 3, 1))
    assert kept(df, "XS") == [1]
    assert kept(df, "MD") == [1, 2]
    assert kept(df, "LG") == [1, 2, 3]
    assert kept(df, "XL") == [1, 2, 3, 4]


def test_long_chain_orphans_and_circles(spark):
    chain = [(0, None, 1)] + [(n, n - 1, 1) for n in range(1, 150)]
    odd = [(900, 899, 1), (901, 900, 1), (950, 951, 1), (951, 950, 1)]
    df = tree(spark, *chain, *odd)
    full = comments.trim_tree(df, "XL")
    assert sorted(r["comment_id"] for r in full.collect()) == list(range(150))
    assert sorted(r["depth"] for r in full.collect()) == list(range(150))


def test_null_score_counts_as_zero(spark):
    df = tree(spark, (1, None, None), (2, None, 1), (3, None, -1), (4, None, 2))
    assert kept(df, "XS") == [1, 2, 4]


def test_rendering_is_depth_first_and_indented(spark):
    df = tree(spark, (1, None, 5, "one\ntwo"), (2, None, 9, "top"), (3, 1, 1, "re\nply"))
    section = render.render_comments(df, "XL").first()["comment_section"]
    assert section == (
        "- **a** (9 pts):\n  top\n"
        "- **a** (5 pts):\n  one\n\ttwo\n"
        "\t- **a** (1 pts):\n\t  re\n\t\tply\n"
    )
    assert render.render_comments(df, "MD").first()["comment_section"] == section


def test_a_layout_may_close_after_the_replies(spark):
    df = tree(spark, (1, None, 5), (2, 1, 1), (3, None, 4))
    layout = "<${score}>${replies}</${score}>"
    for detail in ("MD", "XL"):
        assert render.render_comments(df, detail, layout=layout).first()["comment_section"] == "<5><1></1></5><4></4>"


def test_large_threads_come_in_parts(spark):
    df = tree(spark, *[(n, None, 100 - n, f"c{n}") for n in range(25)])
    lines = render.comment_lines(comments.trim_tree(df, "XL"))
    parts = render.comment_parts(lines, part_lines=10, hot_rows=5).orderBy("part").collect()
    whole = render.comment_parts(lines).first()["comment_section"]
    assert [r["part"] for r in parts] == [0, 1, 2]
    assert "".join(r["comment_section"] for r in parts) == whole


def node(body, *replies, kind="t1"):
    listing = {"data": {"children": list(replies)}} if replies else ""
    return {"kind": kind, "data": {"author": "a", "score": 1, "body": body, "stickied": False, "replies": listing}}


@pytest.mark.parametrize("levels,count", [(1, 2), (2, 3), (None, 21)])
def test_raw_threads_flatten_to_any_depth(spark, levels, count):
    deep = node("d0")
    for n in range(1, 20):
        deep = node(f"d{n}", deep)
    raw = json.dumps([{"data": {"children": [{"data": {"id": "p"}}]}}, {"data": {"children": [deep, node("flat", kind="more")]}}])
    parsed = threads.parse_threads(spark.createDataFrame([("p", raw), ("q", "{}"), ("r", "null"), ("s", "[")], "post_id string, raw string"))
    flat = threads.flatten_comments(parsed, levels)
    assert flat.count() == count
    if levels is None:
        last = flat.orderBy("depth", ascending=False).first()
        assert (last["depth"], last["body"], last["comment_id"]) == (19, "d0", ".".join(["0"] * 20))
        assert last["parent_id"] == ".".join(["0"] * 19)


def test_empty_thread_has_no_rows(spark):
    raw = '[{"data":{"children":[{"data":{"id":"p"}}]}},{"data":{"children":[]}}]'
    parsed = threads.parse_threads(spark.createDataFrame([("p", raw)], "post_id string, raw string"))
    assert rows(threads.flatten_comments(parsed)) == []


def deep_rows(seed, count):
    """A thread of ``count`` comments, many of them in long chains."""
    rng = random.Random(seed)
    out = []
    for n in range(count):
        parent = None if n == 0 or rng.random() < 0.02 else rng.choice([n - 1] * 12 + [rng.randrange(n)])
        out.append(("p", n, parent, n, f"a{n}", rng.randint(-3, 3), 'quote " and \\ and\nline', False))
    return out


def plain_nested(rows, parent=None):
    mine = sorted((r for r in rows if r[2] == parent), key=lambda r: (-r[5], r[3]))
    return [{"poster": r[4], "score": r[5], "body": r[6], "replies": plain_nested(rows, r[1])} for r in mine]


@pytest.mark.parametrize("part_rows", [1, 7, 1000])
def test_nested_json_of_any_depth(spark, part_rows):
    rows = deep_rows(part_rows, 160)
    ddl = "post_id string, comment_id long, parent_id long, seq long, author string, score int, body string, stickied boolean"
    df = spark.createDataFrame(rows + [("q", 500, None, 1, "z", 1, "alone", False)], ddl)
    tree = trim_tree(df, "XL")
    assert tree.agg({"depth": "max"}).first()[0] > 29
    got = {r["post_id"]: json.loads(r["comments_json"]) for r in nested_comments(tree, part_rows).collect()}
    assert got == {"p": plain_nested(rows), "q": plain_nested([("q", 500, None, 1, "z", 1, "alone", False)])}
    parts = nested_parts(tree, part_rows).filter("post_id = 'p'").orderBy("part").collect()
    assert len(parts) == -(-160 // part_rows) and json.loads("".join(r["text"] for r in parts)) == got["p"]


def test_documents_are_parsed_once(spark):
    given = spark.createDataFrame([("p", "[null]"), ("q", "[]"), ("r", '{"0": 1}'), ("s", "[")], "post_id string, raw string")
    parsed = threads.parse_threads(given)
    assert [r["post_id"] for r in parsed.select("post_id").collect()] == ["p"]
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_listings_leave_out_replies_to_missing_comments(spark, tmp_path):
    ids = [n for n in range(300) if n not in (22, 13, 128 + 5)]
    cells = "id AS event_id, id AS user_id, TIMESTAMP_NTZ '2024-01-01' AS ts, 'view' AS event_type, 1.0D AS value, '{}' AS props"
    spark.createDataFrame([(n,) for n in ids], "id long").selectExpr(*cells.split(", ")).write.parquet(str(tmp_path / "events.parquet"))
    got = {r["post_id"]: json.loads(f"[{r['listing']}]") for r in Inputs(spark, str(tmp_path)).thread_listings().collect()}

    def below(k, up):
        own = [n for n in ids if n // 128 == k and parent(n % 128) == up]
        return [below(k, n % 128) for n in own]

    def parent(seq):
        return None if seq < 12 else seq - 1 if seq > 100 else (seq - 12) // 4

    def shape(nodes):
        return [shape(n["data"]["replies"]["data"]["children"]) if n["data"]["replies"] else [] for n in nodes]

    assert {k: shape(v) for k, v in got.items()} == {f"p{k}": below(k, None) for k in range(3)}
