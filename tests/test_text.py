from datetime import datetime

from pyspark.sql import functions as F

from threadspark.functions import template, text, times
from threadspark.operators import links, notes
from threadspark.sinks import files
from threadspark.sources.documents import read_feed_files, read_thread_files
from threadspark.sources.notes import read_notes, with_frontmatter

STATE = "post_id string, subreddit string"


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column).first()[0]


def test_labels(spark):
    cases = {"News: Urgent": "News", "Plain": "Plain", " padded ": " padded ", "": "N/A", None: "N/A", ":x": "", "a : b: c": "a"}
    for flair, label in cases.items():
        assert one(spark, text.label(F.col("f")), f=flair) == label


def test_urls_stop_at_blanks_and_brackets(spark):
    body = "a [x](https://e.com/1) b https://e.com/2] http://e.com/3\nend"
    assert one(spark, text.urls(F.col("t")), t=body) == ["https://e.com/1", "https://e.com/2", "http://e.com/3"]


def test_permalinks_and_targets(spark):
    link = "https://www.reddit.com/r/x/comments/ab12/title"
    assert one(spark, text.permalink_id(F.col("u")), u=link) == "ab12"
    assert one(spark, text.permalink_id(F.col("u")), u="https://reddit.com/r/x/comments/zz") == "zz"
    assert one(spark, text.permalink_id(F.col("u")), u="https://example.com/r/x/comments/zz") is None
    assert one(spark, text.direct_id(F.col("u")), u=link) == "ab12"
    assert one(spark, text.direct_id(F.col("u")), u="ab12") == "ab12"
    assert one(spark, text.direct_id(F.col("u")), u="https://www.reddit.com/r/x") == "https://www.reddit.com/r/x"


def test_iso_times_become_utc(spark):
    cases = {
        "2024-01-01T10:00:00+00:00": datetime(2024, 1, 1, 10), "2024-01-01T10:00:00Z": datetime(2024, 1, 1, 10),
        "2024-01-01T10:00:00+02:00": datetime(2024, 1, 1, 8), "2024-01-01T10:00:00": datetime(2024, 1, 1, 10),
        "soon": None, None: None,
    }
    for given, want in cases.items():
        assert one(spark, times.parse_iso(F.col("t")), t=given) == want


def test_templates_drop_unknown_and_missing_values(spark):
    values = {"a": F.col("a"), "b": F.col("b")}
    assert one(spark, template.render("<${a}|${b}|${c}> $5 $$${a} $a$$5 $$a", values), a="1", b=None) == "<1||> $5 $1 1$5 $a"
    assert one(spark, template.render("", values), a="1", b=None) == ""


def test_folders_are_safe(spark):
    df = spark.createDataFrame([("p", "s", 'a/b:c*"d"', None)], "post_id string, subreddit string, post_flair string, domain string")
    got = df.select(
        files.note_path(df, "post_flair"), files.note_path(df, "domain"), files.note_path(df, "mood"), files.note_path(df, None)
    ).first()
    assert tuple(got) == ("abcd/s_p.md", "domain/s_p.md", "mood/s_p.md", "s_p.md")


def test_links_resolve_to_known_posts_only(spark):
    body = "see https://reddit.com/r/x/comments/known/a, https://reddit.com/r/x/comments/other and (https://e.com)"
    posts = spark.createDataFrame([("p", body, "https://reddit.com/r/y/comments/known"), ("q", "", "")], "post_id string, selftext string, url_overridden_by_dest string")
    state = spark.createDataFrame([("known", "r/cats")], STATE)
    joined = {r["post_id"]: r["post_links"] for r in links.post_links(posts, state, ["e.com"]).collect()}
    # one note link for two URLs of the same post; the comma belongs to the first URL
    assert joined == {"p": "[[cats_known]], https://reddit.com/r/x/comments/other"}
    texts = {r["post_id"]: r["selftext"] for r in links.inline_links(posts, ["post_id"], "selftext", state).collect()}
    assert texts["p"] == "see [[cats_known]] https://reddit.com/r/x/comments/other and (https://e.com)"
    assert texts["q"] == ""


NOTE = "---\nscore: 12\nrescrape_after: 2024\nflair: a: b\nflair: last\n---\n# T\nscore: 5\nrescrape_after: x\n"


def test_patching_touches_the_frontmatter_only(spark):
    given = spark.createDataFrame([("p", "f", NOTE), ("q", "g", "# bare\n"), ("r", "h", NOTE)], "post_id string, path string, content string")
    updates = spark.createDataFrame([("p", 99, "NEW"), ("q", 1, "NEW")], "post_id string, score int, update_block string")
    got = {r["post_id"]: r["content"] for r in notes.patch_notes(given, updates, datetime(2024, 1, 10)).collect()}
    assert got == {
        "p": "---\nscore: 99\nflair: a: b\nflair: last\nrescraped_date: 2024-01-10 00:00\n---\n# T\nscore: 5\nrescrape_after: x\n\nNEW",
        "q": "# bare\n\nNEW",
    }


def test_notes_on_disk(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text(NOTE)
    (tmp_path / "b.md").write_text("no frontmatter: here\n")
    (tmp_path / "Scrape Log.md").write_text("---\npost_id: log\n---\n")
    (tmp_path / "c.txt").write_text("---\npost_id: text\n---\n")
    got = {r["path"].rsplit("/", 1)[1]: r["frontmatter"] for r in with_frontmatter(read_notes(spark, str(tmp_path))).collect()}
    assert got == {"a.md": {"score": "12", "rescrape_after": "2024", "flair": "last"}, "b.md": {}}


def test_captured_files(spark, tmp_path):
    (tmp_path / "a1.json").write_text("[1,\n2]")
    (tmp_path / "f.xml").write_text("<feed>\n</feed>")
    assert [tuple(r) for r in read_thread_files(spark, str(tmp_path)).collect()] == [("a1", "[1,\n2]")]
    assert [r["xml"] for r in read_feed_files(spark, str(tmp_path)).collect()] == ["<feed>\n</feed>"]


def test_frontmatter_is_read_once(spark):
    given = spark.createDataFrame([("a", NOTE), ("b", "---\nx: 1\n y :2 \n---\n"), ("c", "bare")], "path string, content string")
    got = with_frontmatter(given).filter(F.size("frontmatter") > 0).select("path", F.map_entries("frontmatter").alias("m"))
    assert {r["path"]: dict(r["m"]) for r in got.collect()} == {"a": {"score": "12", "rescrape_after": "2024", "flair": "last"}, "b": {"x": "1", "y": "2"}}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("map_from_arrays") == 1
