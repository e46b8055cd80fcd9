"""Numbering, running totals, ranks and joins give the same with and without hot keys."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from penstroke.operators import distributed as D
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds more than a third of the rows, with many equal values of the order."""
    rng = random.Random(1)
    data = [("hot" if i % 5 < 2 else f"k{rng.randrange(40)}", rng.randrange(300), i, rng.randrange(10)) for i in range(3000)]
    return spark.createDataFrame(data, "k string, o bigint, id bigint, v bigint").cache()


def expected(skewed):
    inside = Window.partitionBy("k").orderBy("o", "id")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    return skewed.withColumns({"rn": F.row_number().over(inside), "before": F.coalesce(F.sum("v").over(earlier), F.lit(0))})


@pytest.mark.parametrize("hot_rows", [10, 100, 1_000_000])
def test_number_rows(skewed, hot_rows):
    got = D.number_rows(skewed, ["k"], "o", ["id"], "rn", {"before": "v"}, hot_rows=hot_rows)
    assert rows(got, "id", "rn", "before") == rows(expected(skewed), "id", "rn", "before")


@pytest.mark.parametrize("top", [1, 25, 700])
def test_top_of_a_hot_key(skewed, top):
    got = D.number_rows(skewed, ["k"], "o", ["id"], "rn", top=top, hot_rows=20)
    assert rows(got, "id", "rn") == rows(expected(skewed).where(F.col("rn") <= top), "id", "rn")


def test_hot_key_is_divided(skewed):
    hot = D.hot_keys(skewed, ["k"], 100)
    assert [r.k for r in hot.collect()] == ["hot"]
    ordinary, divided = D.divide_hot_keys(skewed, hot, ["k"], "o", ["id"], 100)
    sizes = [r["count"] for r in divided.groupBy("_part").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 400
    assert rows(ordinary) == rows(skewed.where("k <> 'hot'"))
    place = F.struct("o", "id")
    spans = divided.groupBy("_part").agg(F.min(place).alias("a"), F.max(place).alias("b")).orderBy("_part").collect()
    assert all(x.b < y.a for x, y in zip(spans, spans[1:]))


def test_hot_key_in_very_many_parts(skewed):
    hot = D.hot_keys(skewed, ["k"], 3)
    _, divided = D.divide_hot_keys(skewed, hot, ["k"], "o", ["id"], 3)
    assert divided.where("k = 'hot'").select("_part").distinct().count() > 256
    got = D.number_rows(skewed, ["k"], "o", ["id"], "rn", {"before": "v"}, hot_rows=3)
    assert rows(got, "id", "rn", "before") == rows(expected(skewed), "id", "rn", "before")


def test_more_hot_keys_than_are_kept(skewed, monkeypatch):
    monkeypatch.setattr(D, "MAX_HOT_KEYS", 2)
    hot = D.hot_keys(skewed, ["k"], 10)
    sizes = sorted((r["count"] for r in skewed.groupBy("k").count().collect()), reverse=True)
    assert sorted((r._n for r in hot.collect()), reverse=True) == sizes[:2]
    got = D.number_rows(skewed, ["k"], "o", ["id"], "rn", hot_rows=10)
    assert rows(got, "id", "rn") == rows(expected(skewed), "id", "rn")


def test_missing_hot_key(spark, skewed):
    missing = skewed.withColumn("k", F.when(F.col("k") != "hot", F.col("k")))
    got = D.number_rows(missing, ["k"], "o", ["id"], "rn", {"before": "v"}, hot_rows=50)
    assert rows(got, "id", "rn", "before") == rows(expected(skewed), "id", "rn", "before")


def test_all_values_of_a_hot_key_equal(spark):
    same = spark.range(500).select(F.lit("k").alias("k"), F.lit(7).cast("bigint").alias("o"), "id")
    got = D.number_rows(same, ["k"], "o", ["id"], "rn", hot_rows=10)
    assert rows(got, "id", "rn") == [(i, i + 1) for i in sorted(range(500), key=lambda i: repr((i, i + 1)))]


def test_global_rank(skewed):
    got = D.global_rank(skewed, [F.desc("o"), F.asc("id")], "at").collect()
    assert [r.at for r in sorted(got, key=lambda r: (-r.o, r.id))] == list(range(3000))


def test_rank_within(skewed):
    got = D.global_rank(skewed, ["o", "id"], "at", within=["k"])
    assert rows(got.select("id", (F.col("at") + 1).alias("rn"))) == rows(expected(skewed), "id", "rn")


@pytest.fixture
def no_broadcast(spark):
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, skewed, how):
    small = spark.createDataFrame([("hot", 1), ("k3", 2), ("other", 3)], "k string, w int")
    assert rows(D.salted_join(skewed, small, ["k"], how)) == rows(skewed.join(small, "k", how))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("columns", [["k"], ["k", "o", "id", "v"]])
def test_salted_join_of_hot_keys(spark, skewed, how, columns, no_broadcast):
    small = spark.createDataFrame([("hot", 1), ("k3", 2), ("other", 3)], "k string, w int")
    large = skewed.select(*columns).unionByName(spark.createDataFrame([(None,)] * 300, "k string"), allowMissingColumns=True)
    assert rows(D.salted_join(large, small, ["k"], how, hot_rows=200)) == rows(large.join(small, "k", how))


@pytest.mark.parametrize("columns", [["k"], ["k", "id"]])
def test_only_hot_keys_are_copied_and_their_rows_spread(skewed, columns):
    large, small = skewed.select(*columns), skewed.select("k").distinct()
    hot, alike = D.heavy_hitters(large, ["k"], 300)
    assert list(hot.values()) == [1200] and alike == (columns == ["k"])
    dealt, copied = D.deal_hot_keys(large, small, ["k"], hot, alike, 300)
    copies = {r.k: r["count"] for r in copied.groupBy("k").count().collect()}
    assert copies.pop("hot") == 4 and set(copies.values()) == {1}
    salts = {r["_salt"]: r["count"] for r in dealt.where("k = 'hot'").groupBy("_salt").count().collect()}
    assert set(salts) == set(range(4)) and max(salts.values()) < 400
    assert dealt.where("k <> 'hot' and _salt <> 0").count() == 0


def test_members(spark, skewed):
    members = spark.createDataFrame([("hot",), ("hot",), ("k3",)], "k string")
    kept, dropped = D.keep_members(skewed, members, ["k"]), D.drop_members(skewed, members, ["k"])
    assert rows(kept) == rows(skewed.where("k in ('hot', 'k3')"))
    assert kept.count() + dropped.count() == skewed.count()


def test_joins_of_empty_tables(spark, skewed, no_broadcast):
    small = spark.createDataFrame([("hot", 1)], "k string, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert D.salted_join(skewed.limit(0), small, ["k"], how).count() == 0
        assert rows(D.salted_join(skewed, small.limit(0), ["k"], how, hot_rows=100)) == rows(skewed.join(small.limit(0), "k", how))
    assert D.number_rows(skewed.limit(0), ["k"], "o", ["id"], hot_rows=1).count() == 0
