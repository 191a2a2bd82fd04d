"""Links: each target meets the state once, whatever the number of links to it."""

import pytest

from tests.conftest import rows
from threadspark.operators import links


def state_of(spark):
    return spark.createDataFrame([("hot", "s"), ("b", "r/t"), ("unlinked", "u")], "post_id string, subreddit string")


@pytest.mark.parametrize("few", [100_000, 0])
def test_a_third_of_all_links_point_to_one_post(spark, monkeypatch, few):
    monkeypatch.setattr(links, "BROADCAST_ROWS", few)
    known = "https://www.reddit.com/r/x/comments/{}/t"
    data = []
    for n in range(90):
        url, target = [(known.format("hot"), "hot"), (f"https://example.com/{n}", None), (known.format(f"q{n}"), f"q{n}")][n % 3]
        data.append((f"p{n}", url, target))
    data.append(("p0", known.format("b"), "b"))
    edges = spark.createDataFrame(data, "post_id string, url string, dst_id string")
    names = {"hot": "[[s_hot]]", "b": "[[t_b]]"}
    got = links.resolve_links(edges, state_of(spark))
    assert rows(got) == sorted(((p, u, d, names.get(d, u)) for p, u, d in data), key=repr)
    found, count = links.known_targets(edges, state_of(spark))
    assert rows(found) == [("b", "[[t_b]]"), ("hot", "[[s_hot]]")] and count == 2


@pytest.mark.parametrize("few", [100_000, 0])
def test_inline_links(spark, monkeypatch, few):
    monkeypatch.setattr(links, "BROADCAST_ROWS", few)
    url = "https://reddit.com/r/x/comments/{}"
    df = spark.createDataFrame([("p", f"a {url.format('hot')} b {url.format('none')} c {url.format('hot')}"), ("q", "plain"), ("r", None)], "post_id string, body string")
    got = links.inline_links(df, ["post_id"], "body", state_of(spark))
    assert rows(got.select("post_id", "body")) == [("p", f"a [[s_hot]] b {url.format('none')} c [[s_hot]]"), ("q", "plain"), ("r", None)]
