from pyspark.sql import functions as F

from tests.conftest import rows
from threadspark.operators import ranking


def skewed(spark):
    """One group holds most rows and all its scores are equal."""
    data = [("hot", 1, n) for n in range(500)] + [(f"g{n % 7}", n % 3, n) for n in range(100)]
    return spark.createDataFrame(data, "g string, score int, n int").repartition(6)


def expected(df):
    groups = {}
    for g, score, n in (tuple(r) for r in df.collect()):
        groups.setdefault(g, []).append((-score, n))
    return sorted((g, n, i + 1) for g, items in groups.items() for i, (_, n) in enumerate(sorted(items)))


def test_hot_groups_rank_like_any_other(spark):
    df = skewed(spark)
    order = [F.desc("score"), F.col("n")]
    ranked = ranking.rank_within(df, ["g"], order, "rk", hot_rows=100)
    assert sorted(tuple(r) for r in ranked.select("g", "n", "rk").collect()) == expected(df)
    usual = ranking.rank_within(df, ["g"], order, "rk")
    assert rows(usual.select("g", "n", "rk")) == rows(ranked.select("g", "n", "rk"))


def test_global_position_counts_every_row_once(spark):
    placed = ranking.global_position(skewed(spark).filter("g = 'hot'"), [F.desc("n")], "pos")
    assert rows(placed.select("pos", "n")) == sorted(((i + 1, 499 - i) for i in range(500)), key=repr)


def test_parts_keep_groups_whole(spark):
    parts = ranking.pack_parts(skewed(spark), ["g"], [F.col("n")], F.col("n"), 64, hot_rows=100)
    hot = parts.filter("g = 'hot'").orderBy("part").collect()
    assert [len(r["items"]) for r in hot] == [64] * 7 + [52]
    assert [n for r in hot for n in r["items"]] == list(range(500))


def test_top_k_is_the_same_on_both_ways(spark, monkeypatch):
    df = skewed(spark)
    order = [F.desc("score"), F.col("n")]
    plain = rows(ranking.top_k(df, ["g"], order, 5, "rk", ["n"]).select("g", "n", "rk"))
    monkeypatch.setattr(ranking, "GROUP_LIMIT", 1)
    assert rows(ranking.top_k(df, ["g"], order, 5, "rk", ["n"]).select("g", "n", "rk")) == plain
    assert plain == sorted((r for r in expected(df) if r[2] <= 5), key=repr)
