"""Whole runs: which notes they write, and what the scan of the posts takes over."""

from datetime import timedelta

from pyspark.sql import functions as F

from tests.test_rules import DDL, NOW, post, posts
from threadspark.catalog.inputs import AS_OF, Inputs
from threadspark.operators.state import conform
from threadspark.plans.routines import make_routine, match_routines
from threadspark.plans.run import run
from tests.conftest import rows
from threadspark.plans import run as run_module
from threadspark.session import cut_lineage

FOLDER = "/root/testdata/sf0.001"


def test_a_revisited_post_gets_its_note_patched(spark):
    i = Inputs(spark, FOLDER)
    best = i.posts.filter("score >= 50").orderBy(F.desc("score"), "post_id").limit(3).select("post_id").collect()
    patched, gone, new = (r["post_id"] for r in best)
    early = AS_OF - timedelta(hours=1)
    state = conform(spark.createDataFrame(
        [(patched, "keep/me.md", early), (gone, "keep/lost.md", early)],
        "post_id string, file_path string, rescrape_after timestamp_ntz",
    ))
    old = spark.createDataFrame(
        [(patched, "keep/me.md", "---\nscore: 1\n---\nbody"), (new, "other.md", "unrelated")], "post_id string, path string, content string"
    )
    routine = make_routine({"sort": "top", "max_results": 3, "allow_nsfw": True}, routine_id=1)
    result = run(i.posts, i.comments, state, [routine], AS_OF, old)
    notes = {r["post_id"]: r for r in result.notes.collect()}
    assert set(notes) == {patched, gone, new}
    assert notes[patched]["path"] == "keep/me.md"
    assert "body" in notes[patched]["content"] and "## Updated Comments" in notes[patched]["content"]
    assert "score: 1\n" not in notes[patched]["content"]
    assert notes[gone]["path"] == "keep/lost.md" and "## Updated Comments" not in notes[gone]["content"]
    assert notes[new]["content"] != "unrelated"
    paths = {r["post_id"]: r["file_path"] for r in result.state.collect()}
    assert (paths[patched], paths[gone]) == ("keep/me.md", "keep/lost.md")


def test_the_scan_takes_over_the_rules_on_whole_values(spark, tmp_path, capsys):
    posts(spark, post("a"), post("b", nsfw=True)).write.partitionBy("subreddit").parquet(str(tmp_path / "posts"))
    stored = spark.read.schema(DDL).parquet(str(tmp_path / "posts"))
    one = make_routine({"subreddit": "s", "timeframe": "day", "exclude_author": ["x"]}, routine_id=1)
    two = make_routine({"subreddit": "t", "domain": ["self.s"], "title_search": ["t"]}, routine_id=2)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    for routines in ([one], [one, two]):
        match_routines(stored, routines, NOW).explain()
        plan = capsys.readouterr().out
        assert "PartitionFilters: []" not in plan and "PushedFilters: []" not in plan
        assert "over_18" in plan.split("PushedFilters:")[1].split("ReadSchema")[0]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert [r["post_id"] for r in match_routines(stored, [one, two], NOW).collect()] == ["a"]


def test_posts_seen_again_are_written_as_ids(spark, monkeypatch):
    written = []

    def noted(df):
        done = cut_lineage(df)
        written.append((len(done.columns), done.count()))
        return done

    monkeypatch.setattr(run_module, "cut_lineage", noted)
    i = Inputs(spark, "/root/testdata/sf0.001")
    nothing = make_routine({"sort": "top", "min_score": 100_000, "allow_nsfw": True}, routine_id=1)
    after = run_module.run(i.posts, i.comments, i.known_state, [nothing], AS_OF)
    hits = after.seen.filter("status = 'hit'").count()
    assert hits > 100 and all(count == 0 for columns, count in written if columns > 10)
    assert after.changes.count() == hits and after.state.count() == i.known_state.count()
    assert rows(after.changes.select("post_id")) == rows(after.seen.filter("status = 'hit'").select("post_id"))
    assert after.changes.filter(F.col("last_scrape_timestamp") < AS_OF).count() == 0
