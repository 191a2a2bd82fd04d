from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from threadspark.operators import history, state
from threadspark.sources import feeds
from threadspark.sources.state import Snapshots, import_log, upgrade
from threadspark.streaming import streams

DAY = datetime(2024, 1, 1)


def table(spark, *items):
    """State rows from dicts."""
    names = sorted({k for item in items for k in item})
    kinds = {"score": "int", "last_scrape_timestamp": "timestamp_ntz", "first_scrape_timestamp": "timestamp_ntz", "rescrape_after": "timestamp_ntz"}
    ddl = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)
    return state.conform(spark.createDataFrame([tuple(item.get(n) for n in names) for item in items], ddl))


def at(days):
    return DAY + timedelta(days=days)


def test_upsert_twice_is_upsert_once(spark):
    old = table(spark, {"post_id": "a", "title": "old", "first_scrape_timestamp": at(0), "last_scrape_timestamp": at(0), "file_path": "f"})
    batch = table(
        spark,
        {"post_id": "a", "title": "mid", "first_scrape_timestamp": at(1), "last_scrape_timestamp": at(1)},
        {"post_id": "a", "title": "new", "first_scrape_timestamp": at(2), "last_scrape_timestamp": at(2)},
        {"post_id": "b", "title": "b", "first_scrape_timestamp": at(2), "last_scrape_timestamp": at(2)},
    )
    once = state.upsert_first(old, batch)
    assert rows(state.upsert_first(once, batch)) == rows(once)
    a = once.filter("post_id = 'a'").first()
    assert (a["title"], a["first_scrape_timestamp"], a["last_scrape_timestamp"], a["file_path"]) == ("new", at(0), at(2), None)
    assert once.count() == 2


def test_later_writes_keep_rich_values_and_add_no_rows(spark):
    old = table(spark, {"post_id": "a", "title": "old", "author": "x", "domain": "d", "post_flair": "f", "last_scrape_timestamp": at(0)})
    batch = table(
        spark,
        {"post_id": "a", "title": "new", "domain": "e", "post_flair": None, "last_scrape_timestamp": at(1)},
        {"post_id": "a", "title": "newer", "domain": None, "post_flair": None, "last_scrape_timestamp": at(2)},
        {"post_id": "zzz", "title": "?", "last_scrape_timestamp": at(1)},
    )
    got = state.update_later(old, batch).collect()
    assert [(r["post_id"], r["title"], r["author"], r["domain"], r["post_flair"]) for r in got] == [("a", "newer", None, "e", "f")]


def test_prune_keeps_the_newest(spark):
    df = table(spark, *[{"post_id": f"p{n}", "last_scrape_timestamp": at(n // 2)} for n in range(20)])
    marked = state.prune(df, 5)
    assert sorted(r["post_id"] for r in marked.filter("keep").collect()) == ["p14", "p16", "p17", "p18", "p19"]
    assert marked.count() == 20
    assert state.prune(df, 0).filter("NOT keep").count() == 0
    assert state.prune(df, 100).filter("NOT keep").count() == 0


def test_reconcile_only_expects_named_files(spark):
    df = table(
        spark,
        {"post_id": "both", "file_path": "a.md", "json_path": "a.json"},
        {"post_id": "no_md", "file_path": "b.md", "json_path": "b.json"},
        {"post_id": "no_json", "file_path": "c.md", "json_path": "c.json"},
        {"post_id": "neither", "file_path": "d.md", "json_path": "d.json"},
        {"post_id": "unnamed", "file_path": None, "json_path": None},
    )
    md = spark.createDataFrame([("a.md",), ("c.md",)], "path string")
    js = spark.createDataFrame([("a.json",), ("b.json",)], "path string")
    assert rows(state.reconcile(df, md, js)) == sorted(
        [
            ("both", False, False, False), ("no_md", True, True, False), ("no_json", True, False, True),
            ("neither", True, False, False), ("unnamed", False, False, False),
        ],
        key=repr,
    )


def test_edits_in_notes_win(spark):
    df = table(
        spark,
        {"post_id": "a", "file_path": "a", "label": "old", "rescrape_after": at(1)},
        {"post_id": "b", "file_path": "b", "label": "old", "rescrape_after": at(1)},
        {"post_id": "c", "file_path": "c", "label": "old", "rescrape_after": at(1)},
        {"post_id": "d", "file_path": None, "label": "old", "rescrape_after": at(1)},
    )
    notes = spark.createDataFrame(
        [("a", {"flair": "new", "rescrape_after": "x"}), ("b", {"flair": ""}), ("c", {})], "path string, frontmatter map<string,string>"
    )
    got = state.apply_edits(df, notes).select("post_id", "label", "rescrape_after")
    assert rows(got) == sorted([("a", "new", at(1)), ("b", "old", None), ("c", "old", at(1)), ("d", "old", at(1))], key=repr)


def test_rebuild_fills_in_what_a_note_lacks(spark):
    data = [
        ("n/x.md", "---\npost_id: x\n---\ntext", {"post_id": "x"}),
        ("n/y.md", "---\npost_id: y\n# not a title\n---\nintro\n# Real \n# Second", {"post_id": "y", "score": "1k", "date_posted": "2024-02-30"}),
        ("n/known.md", "---\npost_id: k\n---\n", {"post_id": "k"}),
        ("n/none.md", "plain", {}),
    ]
    notes = spark.createDataFrame(data, "path string, content string, frontmatter map<string,string>")
    got = {r["post_id"]: r for r in state.rebuild(notes, table(spark, {"post_id": "k"}), at(5)).collect()}
    assert sorted(got) == ["x", "y"]
    assert (got["x"]["title"], got["x"]["author"], got["x"]["score"]) == ("x.md", "N/A", 0)
    assert (got["y"]["title"], got["y"]["score"], got["y"]["post_timestamp"]) == ("Real", 0, at(5))


def test_snapshots_know_their_batches(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s")).start()
    assert store.read().count() == 0 and store.latest() is None
    store.commit(table(spark, {"post_id": "a", "title": "1"}))
    store.commit(store.read().withColumn("title", F.concat("title", F.lit("+"))), "q", 0)
    assert store.has("q", 0) and not store.has("q", 1) and not store.has("r", 0)
    assert [r["title"] for r in store.read().collect()] == ["1+"] and store.latest() == 2


def test_a_folder_without_its_listing_is_no_version(spark, tmp_path, monkeypatch):
    store = Snapshots(spark, str(tmp_path / "s")).start()
    store.commit(table(spark, {"post_id": "a", "title": "1"}))
    with monkeypatch.context() as broken:
        broken.setattr(store, "_list", lambda entries: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.commit(table(spark, {"post_id": "b", "title": "2"}), "q", 0)
    assert not store.has("q", 0) and [r["post_id"] for r in store.read().collect()] == ["a"]
    store.commit(table(spark, {"post_id": "b", "title": "2"}), "q", 0)
    assert [r["post_id"] for r in store.read().collect()] == ["b"]


def test_stream_upsert_keeps_what_the_table_had(spark, tmp_path):
    landed = str(tmp_path / "landed")
    store = Snapshots(spark, str(tmp_path / "state")).start()
    store.commit(table(spark, {"post_id": "old", "title": "o"}))
    work = streams.upsert_into(store, lambda batch: state.conform(batch.select("post_id", F.lit("new").alias("title"))))

    def run(checkpoint):
        stream = streams.read_sights(spark, landed, "seq long, post_id string, ts timestamp_ntz, post_date timestamp_ntz")
        streams.each_batch(stream, work, str(tmp_path / checkpoint), 4)
        return {r["post_id"] for r in store.read().collect()}

    sights(spark, ("a", 0, 0)).write.mode("append").parquet(landed)
    assert run("one") == {"old", "a"}
    sights(spark, ("b", 1, 0)).write.mode("append").parquet(landed)
    assert run("one") == {"old", "a", "b"}
    assert run("fresh") == {"old", "a", "b"}  # batch ids start anew, nothing is lost
    versions = store.latest()
    batch = store._versions().filter("stream is not null").first()
    assert store.has(batch["stream"], batch["batch"]) and versions == 4


def test_older_tables_get_todays_columns(spark):
    old = spark.createDataFrame([("a", "L", "s")], "id string, project string, source string")
    got = upgrade(old)
    assert len(got.columns) == 24
    assert tuple(got.select("post_id", "label", "subreddit", "score").first()) == ("a", "L", "s", None)


def test_log_lines(spark):
    lines = ["| 2024-01-01 10:00:00 | a | X |", "|--|--|--|", "| Date | Post ID | L |", "text", "| bad | b | Y | more |", "| 2024-01-01 10:00:00 | known | Z |", "| x |  | y |"]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    got = import_log(df, table(spark, {"post_id": "known"}), at(9))
    assert rows(got.select("post_id", "label", "first_scrape_timestamp")) == [("a", "X", datetime(2024, 1, 1, 10)), ("b", "Y", at(9))]


def test_feeds_count_positions_before_dropping_entries(spark):
    entry = '<entry><id>t3_{0}</id>{1}<updated>{2}</updated></entry>'
    good = '<link href="u"/>'
    body = entry.format("a", good, "2024-01-01T00:00:00Z") + entry.format("b", "", "2024-01-01T00:00:00Z") + entry.format("c", good, "soon")
    body += entry.format("d_e", good, "2024-01-01T02:00:00+02:00")
    xml = f'<feed xmlns="http://www.w3.org/2005/Atom">{body}</feed>'
    df = spark.createDataFrame([("f", xml), ("broken", "<feed")], "feed_id string, xml string")
    assert rows(feeds.read_feeds(df).select("pos", "post_id", "post_date")) == [(0, "a", DAY), (3, "e", DAY)]
    assert rows(feeds.read_feeds(df, cap=3).select("post_id")) == [("a",)]
    assert rows(feeds.read_feeds(df, offset=1, cap=3).select("pos", "post_id")) == [(2, "e")]


def sights(spark, *items):
    data = [(n, post, at(day), at(created)) for n, (post, day, created) in enumerate(items)]
    return spark.createDataFrame(data, "seq long, post_id string, ts timestamp_ntz, post_date timestamp_ntz")


def test_sight_kinds(spark):
    df = sights(spark, ("a", 0, 0), ("a", 1, 0), ("a", 2.5, 0), ("a", 3, 0), ("b", 5, 0), ("b", 6, 0))
    got = {r["seq"]: r["kind"] for r in history.classify_sights(df, 48).collect()}
    assert got == {0: "initial", 1: "hit", 2: "rescrape", 3: "hit", 4: "initial", 5: "hit"}


def test_history_json_survives_bad_text(spark):
    df = spark.createDataFrame([("[{",), (None,), ('[{"type":"hit","timestamp":"t","query":{"a":"1"}}]',)], "h string")
    entry = history.entry(F.lit("initial"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"), F.create_map(F.lit("ignore_urls"), F.lit("x"), F.lit("q"), F.lit("y")))
    got = [r[0] for r in df.select(history.append(F.col("h"), entry)).collect()]
    new = '{"type":"initial","timestamp":"2024-01-01T00:00:00","query":{"q":"y"}}'
    assert got == [f"[{new}]", f"[{new}]", '[{"type":"hit","timestamp":"t","query":{"a":"1"}},' + new + "]"]


def test_stream_marks_sights_across_runs(spark, tmp_path):
    landed, out, checkpoint = (str(tmp_path / n) for n in ("landed", "out", "checkpoint"))
    store = Snapshots(spark, str(tmp_path / "state"), streams.SIGHT_STATE).start()
    steps = [[("a", 0, 0), ("b", 5, 0)], [("a", 1, 0)], [("a", 2.5, 0), ("b", 6, 0)], [("a", 3, 0)]]
    whole = []
    for step in steps:
        whole += step
        sights(spark, *whole).filter(F.col("seq") >= len(whole) - len(step)).write.mode("append").parquet(landed)
        stream = streams.read_sights(spark, landed, "seq long, post_id string, ts timestamp_ntz, post_date timestamp_ntz")
        streams.each_batch(stream, streams.classify_into(store, out, 48), checkpoint, 4)
    got = {r["seq"]: r["kind"] for r in spark.read.parquet(out).collect()}
    assert got == {r["seq"]: r["kind"] for r in history.classify_sights(sights(spark, *whole), 48).collect()}


def test_due_timer_waits_for_the_watermark(spark, tmp_path):
    landed, out, checkpoint = (str(tmp_path / n) for n in ("landed", "out", "checkpoint"))

    def run(*items):
        sights(spark, *items).write.mode("append").parquet(landed)
        stream = streams.read_sights(spark, landed, "seq long, post_id string, ts timestamp_ntz, post_date timestamp_ntz")
        streams.append_to(streams.due_visits(stream, 48, "1 hour"), out, checkpoint, 4)
        return rows(spark.read.schema("post_id string, due timestamp_ntz").parquet(out))

    assert run(("a", 0, 0), ("old", 5 / 24, -9)) == []
    assert run(("a", 1, 0), ("late", 2, 1.5)) == []
    assert run(("x", 2.5, -9)) == [("a", at(2))]
    assert run(("y", 9, -9)) == [("a", at(2)), ("late", at(3.5))]


def test_a_changed_row_writes_one_row(spark, tmp_path, monkeypatch):
    from threadspark.sources import state as source

    monkeypatch.setattr(source, "COMPACT_AFTER", 3)
    store = Snapshots(spark, str(tmp_path / "s")).start()
    store.commit(table(spark, *[{"post_id": f"p{n}", "title": "old"} for n in range(50)]))
    for step, name in enumerate(("p7", "new", "p7")):
        batch = table(spark, {"post_id": name, "title": f"t{step}", "last_scrape_timestamp": at(step)})
        touched, _ = state.split_touched(store.read(), batch)
        version = store.commit_changes(state.first_changes(touched, batch), "q", step)
        written = [spark.read.parquet(f"{store.root}/data/{folder}").count() for _, folder, whole in store._live() if not whole]
        assert written == [1] * (step + 1 if step < 2 else 0) and store.has("q", step)
        assert {r["post_id"]: r["title"] for r in store.read().filter("title <> 'old'").collect()}[name] == f"t{step}"
    assert version == 5 and store.read().count() == 51  # the third one made the table whole again


@pytest.mark.parametrize("few", [100_000, 0])
def test_changes_are_read_in_place_of_older_rows(spark, tmp_path, monkeypatch, few):
    from threadspark.sources import state as source

    monkeypatch.setattr(source, "BROADCAST_ROWS", few)
    monkeypatch.setattr(state, "BROADCAST_ROWS", few)
    store = Snapshots(spark, str(tmp_path / "s")).start()
    store.commit_changes(table(spark, {"post_id": "a", "title": "1"}, {"post_id": "b", "title": "1"}))
    store.commit_changes(table(spark, {"post_id": "a", "title": None}))
    assert rows(store.read().select("post_id", "title")) == [("a", None), ("b", "1")]
    store.commit(store.read())
    store.commit_changes(table(spark, {"post_id": "b", "title": "2"}, {"post_id": "c", "title": "2"}))
    assert rows(store.read().select("post_id", "title")) == [("a", None), ("b", "2"), ("c", "2")]
    touched, rest = state.split_touched(store.read(), spark.createDataFrame([("a",), ("a",), (None,), ("z",)], "post_id string"))
    assert rows(touched.select("post_id")) == [("a",)] and rows(rest.select("post_id")) == [("b",), ("c",)]


def test_upsert_has_no_full_outer_join(spark):
    old = table(spark, *[{"post_id": f"p{n}", "title": "old"} for n in range(9)])
    plan = state.upsert_first(old, table(spark, {"post_id": "p1", "title": "new"}))._jdf.queryExecution().toString()
    assert "FullOuter" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("slices, few", [(16_384, 10_000), (256, 2)])
def test_prune_selects_what_a_sort_would(spark, monkeypatch, slices, few):
    monkeypatch.setattr(state, "SLICES", slices)
    monkeypatch.setattr(state, "FEW_ROWS", few)
    ids = ["a", "ab", "abc", "abd", "b", "é", "z", "\U0001f600", "\uffee"]
    items = [{"post_id": f"{name}{n}", "last_scrape_timestamp": None if n == 0 else at(n // 3)} for n in range(4) for name in ids]
    df = table(spark, *items)
    ordered = sorted(items, key=lambda r: (-(r["last_scrape_timestamp"] or datetime(1, 1, 1)).timestamp() if r["last_scrape_timestamp"] else 1e18, r["post_id"].encode()))
    for keep in (5, 28, 36):
        assert {r["post_id"] for r in state.prune(df, keep).filter("keep").collect()} == {r["post_id"] for r in ordered[:keep]}
    marked = state.prune(df, 5)._jdf.queryExecution().toString()
    assert "Sort" not in marked and "Exchange" not in marked


def test_rebuild_cuts_the_frontmatter_off_once(spark):
    notes = spark.createDataFrame([("n/x.md", "---\npost_id: x\n---\n# \r\n", {"post_id": "x"})], "path string, content string, frontmatter map<string,string>")
    got = state.rebuild(notes, table(spark, {"post_id": "k"}), at(5))
    assert [r["title"] for r in got.collect()] == [""]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
