"""Samples and splits."""

import pytest
from pyspark.sql import functions as F

from penstroke.operators import batches as B
from penstroke.operators import reports as P
from penstroke.operators import sampling as S
from tests.conftest import rows


@pytest.fixture(scope="module")
def chunks(spark):
    """Author a0 of corpus s0 holds a third of the chunks; the same names occur in all corpora."""
    n = F.col("id")
    author = F.when(n % 3 == 0, "a0").otherwise(F.concat(F.lit("a"), n % 50))
    source = F.when(n % 3 == 0, "s0").otherwise(F.concat(F.lit("s"), (n / 50).cast("int") % 3))
    return spark.range(3000).select(source.alias("source"), author.alias("author"), F.concat(F.lit("d"), n).alias("doc_id"), (n % 7).alias("chunk_idx")).cache()


@pytest.mark.parametrize("hot_rows", [9, 1_000_000])
def test_split_is_disjoint_and_whole(chunks, hot_rows):
    split = S.split_by_author(chunks, 4, {"s1": 10}, hot_rows=hot_rows).cache()
    sides = split.select("source", "author", "split").distinct()
    assert sides.groupBy("source", "author").count().where("count > 1").count() == 0
    sizes = {(r.source, r.split): r["count"] for r in sides.groupBy("source", "split").count().collect()}
    everyone = {r.source: r["count"] for r in S.distinct_authors(chunks).groupBy("source").count().collect()}
    for source, n in everyone.items():
        assert sizes[source, "val"] == 4
        assert sizes[source, "train"] == (10 if source == "s1" else n - 4)
    assert split.where("source <> 's1'").count() == chunks.where("source <> 's1'").count()


def test_split_equals_its_steps(chunks):
    everyone = S.distinct_authors(chunks)
    val = S.val_authors(everyone, 4, hot_rows=6)
    train = S.cap_train_authors(S.train_candidates(everyone, val), {"s1": 10})
    split = S.split_authors(everyone, 4, {"s1": 10})
    assert rows(split.where("split = 'val'"), "source", "author") == rows(val, "source", "author")
    assert rows(split.where("split = 'train'"), "source", "author") == rows(train, "source", "author")
    parts = S.split_by_author(chunks, 4, {"s1": 10})
    assert rows(parts.where("split = 'val'").drop("split")) == rows(S.select_validation(chunks, val))
    assert rows(parts.where("split = 'train'").drop("split")) == rows(S.select_train(chunks, train))


@pytest.mark.parametrize("hot_rows", [11, 1_000_000])
def test_views(chunks, hot_rows):
    views = S.sample_views(chunks, 5, epoch=1, hot_rows=hot_rows)
    counts = {r.author: r["count"] for r in views.groupBy("author").count().collect()}
    sizes = {r.author: r["count"] for r in chunks.groupBy("author").count().collect()}
    assert counts == {a: min(5, n) for a, n in sizes.items()}
    assert rows(views) == rows(S.sample_views(chunks, 5, epoch=1))
    assert rows(views) != rows(S.sample_views(chunks, 5, epoch=2))
    assert {r.author for r in S.short_authors(chunks, 45).collect()} == {a for a, n in sizes.items() if n < 45}


def test_shuffle_keeps_all(chunks):
    shuffled = S.shuffle_within_author(chunks, hot_rows=50)
    assert rows(shuffled.drop("chunk_rn")) == rows(chunks)
    spans = shuffled.groupBy("source", "author").agg(F.min("chunk_rn").alias("a"), F.max("chunk_rn").alias("b"), F.count_distinct("chunk_rn").alias("n"))
    assert spans.where("a <> 1 or b <> n").count() == 0


def test_reports(spark, chunks):
    report = P.partition_report(chunks).collect()
    assert [r.source for r in report] == ["s0", "s1", "s2"] and sum(r.n_rows for r in report) == 3000
    rolled = P.file_rollup_report(chunks.withColumnRenamed("source", "file")).collect()
    assert rolled[-1].file is None and rolled[-1].n_rows == 3000
    assert rolled[-1].n_authors == chunks.select("author").distinct().count()
    meta = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y"), ("4", None)], "id string, author string")
    files = spark.createDataFrame([("1",), ("4",)], "id string")
    assert tuple(P.corpus_coverage_report(meta, files).first()) == (2, 1, 2, 2)


# --- batches

SLOTS, WORLD = 3, 2


@pytest.fixture(scope="module")
def sharded(spark):
    """Corpora of 41, 14, 6 and 2 authors: per shard 21/20, 7, 3 and 1."""
    names = [(f"{s}{i:02}", s) for s, n in (("p", 41), ("q", 14), ("r", 6), ("t", 2)) for i in range(n)]
    authors = spark.createDataFrame(names, "author string, source string")
    return B.shard_authors(B.label_encode(authors), WORLD).cache()


def test_labels_and_shards(sharded):
    listed = sharded.orderBy("author").collect()
    assert [r.label for r in listed] == list(range(63))
    for source in "pqrt":
        of_source = [r.shard for r in listed if r.source == source]
        assert of_source == [i % WORLD for i in range(len(of_source))]


def test_keyed_permutation(spark):
    """Every key gives a permutation, and different keys different ones; no place is preferred."""
    sizes = [1, 2, 3, 4, 5, 9, 10, 17, 99, 100, 101, 1000, 1025, 4000]
    made = spark.createDataFrame([(n, k) for n in sizes for k in range(12)], "n int, k int").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    sent = made.select("n", "k", "x", B.keyed_permutation(F.col("x"), F.col("n"), F.concat_ws(":", F.lit("s"), "k")).alias("y")).toPandas()
    orders = {}
    for (n, k), rows_ in sent.groupby(["n", "k"]):
        order = tuple(rows_.sort_values("x")["y"])
        assert sorted(order) == list(range(n))
        orders.setdefault(n, set()).add(order)
    assert all(len(orders[n]) == 12 for n in sizes if n >= 9) and len(orders[3]) > 2
    first = sent[(sent["n"] == 100) & (sent["x"] == 0)]["y"]
    assert first.nunique() > 6


def test_no_pass_is_sorted_or_moved(spark):
    rows_ = [("a", "s", 0, 0, 0)]
    sharded = spark.createDataFrame(rows_, "author string, source string, label long, shard int, ordinal long")
    shape = B.balanced_batches(sharded, SLOTS)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in shape and "_pass#" not in "".join(line for line in shape.splitlines() if "Exchange" in line)


def test_ordinals_with_gaps_are_an_error(sharded):
    with pytest.raises(Exception, match="gaps"):
        B.balanced_batches(sharded.where("ordinal <> 1"), SLOTS).collect()


def test_balanced_batches(sharded):
    batches = B.balanced_batches(sharded, SLOTS, epoch=2).collect()
    of = {}
    for r in batches:
        of.setdefault((r.shard, r.batch_id), []).append(r)
    assert {k: len([b for b in of if b[0] == k]) for k in (0, 1)} == {0: 7, 1: 7}
    shard_of = {r.author: r.shard for r in sharded.collect()}
    for (shard, _), members in of.items():
        assert all(shard_of[r.author] == shard for r in members)
        for source in "pqrt":
            mine = [r for r in members if r.source == source]
            assert len(mine) == SLOTS
            assert len({r.author for r in mine}) == (1 if source == "t" else SLOTS)
            assert sum(r.repeated for r in mine) == (2 if source == "t" else 0)
    visits = [(r.author, r.visit) for r in batches]
    assert len(visits) == len(set(visits))
    first_pass = [r.author for r in batches if r.source == "p" and r.shard == 0]
    assert len(first_pass) == len(set(first_pass)) == 21


def test_epochs_differ_and_repeat(sharded):
    one = rows(B.balanced_batches(sharded, SLOTS, epoch=1).drop("epoch"))
    assert one == rows(B.balanced_batches(sharded, SLOTS, epoch=1).drop("epoch"))
    assert one != rows(B.balanced_batches(sharded, SLOTS, epoch=2).drop("epoch"))


def test_slots():
    assert B.slots_per_corpus(4096, 4, 4) == 256
    with pytest.raises(ValueError):
        B.slots_per_corpus(10, 4, 1)
    with pytest.raises(ValueError):
        B.slots_per_corpus(8, 2, 3)


def test_collate(spark, sharded):
    n = F.when(F.col("label") % 10 == 0, 2).otherwise(F.col("label") % 5 + 4)
    ids = F.array(F.lit(0), F.col("label").cast("int"), F.col("i").cast("int"), F.lit(2))
    ranks = F.array(F.lit(-1), F.lit(5), F.lit(1), F.lit(-1))
    chunks = sharded.select("author", "source", "label", F.explode(F.sequence(F.lit(1), n)).alias("i")).select(
        "author", "source", F.concat(F.lit("d"), "author").alias("doc_id"), F.col("i").alias("chunk_idx"), ids.alias("input_ids"), ranks.alias("ranks")
    )
    chosen = sharded.where(F.col("label") % 10 != 0).drop("shard", "ordinal")
    batches = B.balanced_batches(B.shard_authors(chosen, WORLD), SLOTS)
    out = B.collate_batches(batches, chunks, 3, True, 2, hot_rows=5).collect()
    enough = {r.author for r in sharded.collect() if r.label % 10}
    visits = {}
    for r in out:
        visits.setdefault((r.author, r.visit), []).append(r)
        assert r.input_ids == [0, 4, r.chunk_idx, 2] and r.author in enough
    members = [(r.author, r.visit) for r in batches.collect()]
    assert sorted(visits) == sorted(members)
    for seen in visits.values():
        assert sorted(r.view for r in seen) == [0, 1, 2] and len({r.chunk_idx for r in seen}) == 3
    assert len({tuple(r.chunk_idx for r in v) for k, v in visits.items() if k[0] == "t01"}) > 1
    with pytest.raises(ValueError):
        B.collate_batches(batches, chunks, 3, True)
    with pytest.raises(Exception, match="too few chunks"):
        B.collate_batches(B.balanced_batches(sharded, SLOTS), chunks, 3, True, 2).collect()


def test_first_source(spark):
    data = [("x", "b", "d1", 0), ("x", "a", "d0", 5), ("y", "c", "d0", 0)]
    chunks = spark.createDataFrame(data, "author string, source string, doc_id string, chunk_idx int")
    assert rows(B.first_source_of_author(chunks)) == [("x", "a"), ("y", "c")]
