import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from threadspark.plans import query, rules
from threadspark.plans import routines as plans
from threadspark.plans.routines import make_routine, match_routines, resolve, routines_named, run_routines, run_totals

DDL = (
    "post_id string, title string, author string, subreddit string, selftext string, score int, upvote_ratio double, "
    "num_comments int, domain string, spoiler boolean, over_18 boolean, post_flair string, created_utc timestamp_ntz"
)
NOW = datetime(2024, 1, 10)


def post(post_id="p", title="t", author="a", subreddit="s", selftext="", score=100, ratio=0.9, comments=10,
         domain="self.s", spoiler=False, nsfw=False, flair=None, hours=5.0):
    created = NOW - timedelta(hours=hours)
    return (post_id, title, author, subreddit, selftext, score, ratio, comments, domain, spoiler, nsfw, flair, created)


def posts(spark, *items):
    return spark.createDataFrame(list(items), DDL)


def ids(df, condition):
    return sorted(r["post_id"] for r in df.filter(condition).collect())



def reason(spark, item, **settings):
    return rules.with_verdict(posts(spark, item), make_routine(settings), NOW).first()["ignored_reason"]


def test_limits_are_strict(spark):
    assert reason(spark, post(score=50)) is None
    assert reason(spark, post(score=49)) == "Score below 50"
    assert reason(spark, post(hours=24), ignore_older_than_hours=24) is None
    assert reason(spark, post(hours=24.1), ignore_older_than_hours=24) == "Older than 24h"
    assert reason(spark, post(hours=2), ignore_newer_than_hours=2) is None
    assert reason(spark, post(hours=1.9), ignore_newer_than_hours=2) == "Newer than 2h"
    assert reason(spark, post(ratio=0.85), ignore_below_upvote_ratio=0.85) is None


def test_first_failing_rule_is_recorded(spark):
    settings = {"ignore_below_comments": 20, "exclude_terms": ["Two", "one"], "ignore_older_than_days": 0.1}
    assert reason(spark, post(comments=1, title="one two"), **settings) == "Comments below 20"
    assert reason(spark, post(comments=20, title="one two"), **settings) == "Excluded term: Two"
    assert reason(spark, post(comments=20, title="zone"), **settings) == "Excluded term: one"


def test_missing_numbers_take_their_defaults(spark):
    assert reason(spark, post(score=None)) == "Score below 50"
    assert reason(spark, post(ratio=None), ignore_below_upvote_ratio=0.1) == "Upvote ratio below 0.1"
    assert reason(spark, post(title=None), exclude_terms=["x"]) is None


def test_rescrape_after(spark):
    df = posts(spark, post("young", hours=11), post("old", hours=12))
    visit = df.select("post_id", rules.rescrape_after(F.col("created_utc"), 12, NOW).alias("v"))
    assert {r["post_id"]: r["v"] for r in visit.collect()} == {"young": NOW + timedelta(hours=1), "old": None}
    none = df.select(rules.rescrape_after(F.col("created_utc"), 0, NOW).alias("v"))
    assert [r["v"] for r in none.collect()] == [None, None]


def test_flair_is_matched_by_whole_words(spark):
    df = posts(
        spark, post("a", flair="Weekly Discussion"), post("b", flair="[Discussion]"), post("c", flair="Discussions"),
        post("d", flair=None), post("e", flair="C++ help"),
    )
    assert ids(df, query.words_in("post_flair", "discussion")) == ["a", "b"]
    assert ids(df, query.words_in("post_flair", ["Discussion", "c++"])) == ["a", "b", "e"]
    assert ids(df, query.words_in("post_flair", "Disc")) == []
    assert ids(df, query.words_not_in(["post_flair"], "discussion")) == ["c", "d", "e"]
    assert ids(df, query.one_of("post_flair", "Weekly Discussion")) == ["a"]


def test_sources(spark):
    df = posts(spark, post("a", subreddit="x"), post("b", subreddit="y", author="me"), post("c", subreddit="z"))
    assert ids(df, query.subreddit_is(["r/x", " z "])) == ["a", "c"]
    assert ids(df, query.subreddit_is("u/me")) == ids(df, query.subreddit_is("user/me")) == ["b"]
    for everything in (None, "all", "None", "", []):
        assert ids(df, query.subreddit_is(everything)) == ["a", "b", "c"]


def test_domains_include_their_subdomains(spark):
    df = posts(spark, post("a", domain="imgur.com"), post("b", domain="i.imgur.com"), post("c", domain="notimgur.com"), post("d", domain=None))
    assert ids(df, query.domain_is("imgur.com")) == ["a", "b"]
    assert ids(df, query.domain_is_not(["imgur.com"])) == ["c", "d"]
    assert ids(df, query.post_type_is("self")) == []
    with pytest.raises(ValueError):
        query.post_type_is("video")


def test_search_trees(spark):
    df = posts(
        spark, post("a", title="marvel news"), post("b", title="disney marvel"), post("c", selftext="the spider-man film"),
        post("d", author="spez"), post("e", domain="www.youtube.com"),
    )
    assert ids(df, query.search({"all": [("text", "marvel")], "none": [("text", "disney")]})) == ["a"]
    assert ids(df, query.search({"any": [("text", "spider-man"), ("author", "spez"), ("site", "youtube.com")]})) == ["c", "d", "e"]
    assert ids(df, query.search({"all": [{"any": [("title", "news"), ("title", "disney")]}, ("title", "marvel")]})) == ["a", "b"]
    with pytest.raises(ValueError):
        query.search(("colour", "red"))


def test_nsfw_and_spoiler(spark):
    df = posts(spark, post("a"), post("b", nsfw=True), post("c", spoiler=True), post("d", nsfw=None))
    assert ids(df, query.matches(make_routine({}), NOW)) == ["a", "c", "d"]
    assert ids(df, query.matches(make_routine({"allow_nsfw": True}), NOW)) == ["a", "b", "c", "d"]
    assert ids(df, query.matches(make_routine({"nsfw_only": True}), NOW)) == ["b"]
    assert ids(df, query.matches(make_routine({"spoiler": True}), NOW)) == ["c"]


def test_relevance_counts_terms(spark):
    df = posts(spark, post("a", title="red ring"), post("b", title="red", selftext="ring ring"), post("c"))
    ordered = query.sort_posts(df, "relevance", NOW, ["red", "ring", "blue"]).collect()
    assert [(r["post_id"], r["sort_key"]) for r in ordered] == [("a", 2.0), ("b", 2.0), ("c", 0.0)]


def test_settings_merge_and_aliases():
    routine = make_routine({"max_results": 10, "sort": "new"}, {"sort": "top", "max_age_hours": 5, "label": "News"}, {"sort": None})
    assert (routine.sort, routine.max_results, routine.ignore_older_than_hours) == ("top", 10, 5)
    assert routine.flair_contains == ("News",)
    assert make_routine({"ignore_older_than_days": 2}).ignore_older_than_hours == 48
    both = make_routine({"ignore_older_than_days": 2, "ignore_older_than_hours": 3})
    assert both.ignore_older_than_hours == 3
    assert make_routine({"subreddit": "all"}).subreddit == ()
    assert make_routine({"min_score": 7}).ignore_below_score == 7
    assert make_routine({}).ignore_below_score == 50
    assert make_routine({"unheard_of": 1}).extra == {"unheard_of": 1}


def test_routine_table(spark):
    table = spark.createDataFrame(
        [(1, "Tech", ["a"], None, 3, None), (2, None, None, 9, None, 24)],
        "routine_id int, name string, subreddit array<string>, max_results int, ignore_older_than_days int, ignore_older_than_hours int",
    )
    assert [r["routine_id"] for r in routines_named(table, "tECH").collect()] == [1]
    resolved = resolve(table, {"max_results": 8}, {"name": "x"}).orderBy("routine_id").collect()
    assert [tuple(r) for r in resolved] == [(1, "x", ["a"], 8, 72), (2, "x", [], 9, 24)]


def test_scan_stops_at_the_limit_and_at_the_horizon(spark):
    items = [post(f"p{n:03}", score=200 if n % 2 else 10, hours=float(n + 1)) for n in range(120)]
    df = posts(spark, *items)
    routines = [
        make_routine({"max_results": 3}, routine_id=1),
        make_routine({"max_results": 100}, routine_id=2),
        make_routine({"max_results": 2, "offset": 4}, routine_id=3),
        make_routine({"max_results": 100, "offset": 1, "horizon": 74}, routine_id=4),
        make_routine({"max_results": 0}, routine_id=5),
    ]
    seen = run_routines(df, routines, NOW, None)
    got = {k: [r["post_id"] for r in seen.filter(f"routine_id = {k} AND status = 'accepted'").orderBy("pos").collect()] for k in range(1, 6)}
    assert got[1] == ["p001", "p003", "p005"]
    assert got[2] == [f"p{n:03}" for n in range(1, 120, 2)]
    assert got[4] == [f"p{n:03}" for n in range(1, 75, 2)] and got[5] == []
    assert got[3] == ["p005", "p007"]
    assert seen.filter("routine_id = 1").count() == 6
    assert rows(run_totals(seen)) == [(1, 3, 0), (2, 60, 0), (3, 2, 0), (4, 37, 0)]


def test_every_candidate_is_accepted_or_rejected(spark):
    df = posts(spark, *[post(f"p{n}", score=n) for n in range(100)])
    matched = match_routines(df, [make_routine({}, routine_id=1), make_routine({"subreddit": "other"}, routine_id=2)], NOW)
    assert matched.count() == 100
    assert matched.filter("ignored_reason IS NULL").count() == 50


def plain_run(items, routines, known, in_turn):
    """Feeds walked post by post; ``known`` maps ids to whether a visit is due."""
    out, given = [], set()
    for r in routines:
        feed = sorted((i for i in items if not r.subreddit or i["subreddit"] in r.subreddit), key=lambda i: (-i["score"] if r.sort == "top" else i["age"], i["post_id"]))
        taken = []
        end = None if r.horizon is None else r.offset + r.horizon
        for pos, i in list(enumerate(feed))[r.offset : end]:
            if len(taken) >= r.max_results:
                break
            name = i["post_id"]
            hit = known.get(name) is False or (in_turn and name in given)
            status = "hit" if hit else "accepted" if i["score"] >= r.ignore_below_score else "rejected"
            out.append((r.routine_id, pos, name, status))
            if status == "accepted":
                taken.append(name)
        given.update(taken)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_feeds_are_read_as_deep_as_needed(spark, monkeypatch, seed):
    """Windows of three positions, then six and so on, against a walk; the posts are scanned twice, whatever the number of routines."""
    for name, value in (("FIRST_POSITIONS", 3), ("DEEPER", 2), ("MOST_POSITIONS", 30)):
        monkeypatch.setattr(plans, name, value)
    rng = random.Random(seed)
    items = [
        {"post_id": f"p{n:03}", "score": rng.choice([5, 60, 60, 80]), "age": n + 1, "subreddit": rng.choice(["a", "b", "c"])} for n in range(150)
    ]
    df = posts(spark, *[post(i["post_id"], score=i["score"], hours=float(i["age"]), subreddit=i["subreddit"]) for i in items])
    routines = [
        make_routine({
            "subreddit": rng.choice([None, ["a"], ["b", "c"]]), "sort": rng.choice(["top", "new"]), "max_results": rng.choice([0, 2, 5, 40, 500]),
            "ignore_below_score": rng.choice([50, 70, 1000]), "offset": rng.choice([0, 0, 7]), "horizon": rng.choice([None, None, 25]), "allow_nsfw": True,
        }, routine_id=k)
        for k in range(1, 9)
    ]
    known = {i["post_id"]: rng.random() < 0.3 for i in rng.sample(items, 70)}
    late, early = datetime(2030, 1, 1), datetime(2000, 1, 1)
    state = spark.createDataFrame([(k, early if due else late) for k, due in known.items()], "post_id string, rescrape_after timestamp_ntz")
    scans = []
    match = plans.match_routines
    monkeypatch.setattr(plans, "match_routines", lambda *a: scans.append(1) or match(*a))
    got = plans.run_routines(df, routines, NOW, state).select("routine_id", "pos", "post_id", "status")
    assert rows(got) == sorted(plain_run(items, routines, known, False), key=repr)
    assert len(scans) == 2
    got = plans.run_sequential(df, routines, NOW, state).select("routine_id", "pos", "post_id", "status")
    assert rows(got) == sorted(plain_run(items, routines, known, True), key=repr)
