"""Shapes of physical plans that must hold at any scale."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks import QUERIES
from checks import fixtures as X
from penstroke.operators import batches as B
from penstroke.operators import chunking as C
from penstroke.operators import distributed as D
from penstroke.operators import ranks as R
from penstroke.operators import sampling as S
from penstroke.sources import writers as O
from penstroke.staging import stage
from tests.conftest import SMALL

ROOT = Path(__file__).resolve().parent.parent


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def vocab(spark):
    return X.vocab(X.raw_docs(spark, SMALL))


@pytest.mark.parametrize(
    "name",
    ["split_by_author", "chunk_packed", "attach_word_ranks", "attach_token_ranks", "balanced_batches", "knn1_report",
     "pairwise_similarity", "match_problems", "align_centroids", "sample_per_author"],
)
def test_no_product_joins(spark, name):
    shape = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in shape and "NestedLoop" not in shape


def test_no_row_carries_the_vocabulary(spark, vocab):
    """The lookup table stays a subquery inside one projection."""
    encoded = plan(C.encode(X.raw_docs(spark, SMALL), vocab))
    assert not re.search(r"AS _table#", encoded) and "Subquery" in encoded
    chunks = spark.createDataFrame([], C.CHUNK_SCHEMA)
    lookup = spark.createDataFrame([([1],)], "lookup array<int>")
    assert "AS _lookup#" not in plan(R.attach_token_ranks(chunks, lookup))
    assert "Exchange hash" not in plan(R.attach_token_ranks(chunks, lookup))


def test_word_ranks_are_looked_up_in_the_row(spark, vocab):
    chunks = spark.createDataFrame([], C.CHUNK_SCHEMA)
    ranks = spark.createDataFrame([("word", 0)], "key string, rank bigint")
    shape = plan(R.attach_word_ranks(chunks, ranks, vocab))
    shape = "".join(line for line in shape.splitlines() if not re.match(r"\s*:", line))  # without the subqueries
    assert "Exchange" not in shape and "Generate" not in shape and "Join" not in shape


def test_contents_of_stored_chunks_are_not_moved(spark):
    """Chunks in buckets by their keys: nothing above the chosen keys is exchanged, and few exchanges are left."""
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chunks = [(f"a{i % 6}", f"d{i}", f"s{i % 2}", i, [0, i, 2], [-1, 0, -1]) for i in range(60)]
        stored = O.store_by_key(spark.createDataFrame(chunks, C.CHUNK_SCHEMA), B.CONTENT_KEYS, 4, "plan_chunks")
        members = B.shard_authors(B.label_encode(B.first_source_of_author(stored)), 1)
        batches = stage(B.balanced_batches(members, 2))
        out = B.collate_batches(batches, stored, 3)
        shape = plan(out)
        assert "SelectedBucketsCount: 4 out of 4" in shape
        assert not any("Exchange" in line and "input_ids" in line for line in shape.splitlines())
        below = [line for line in shape.splitlines() if "Exchange" in line]
        assert len(below) <= 10, shape
        assert out.count() == batches.count() * 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_no_python_in_the_text_path(spark, vocab):
    chunks = C.chunk_packed(C.encode(X.raw_docs(spark, SMALL), vocab), length=X.LENGTH)
    for df in (chunks, R.count_words(chunks, vocab), S.sample_views(chunks, 4)):
        assert not re.search("Python|Pandas|Arrow", plan(df))


def test_scan_reads_only_what_it_needs(spark):
    shape = plan(S.distinct_authors(X.raw_docs(spark, SMALL)))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in shape
    pushed = plan(X.table(spark, SMALL, "documents").where("lang = 'en'").select("doc_id"))
    assert "EqualTo(lang,en)" in pushed


def test_top_per_author_is_cut_before_the_shuffle(spark):
    docs = X.raw_docs(spark, SMALL).select("author", "doc_id", "source")
    shape = plan(S.sample_per_author(docs, 10))
    assert "WindowGroupLimit" in shape and shape.rindex("WindowGroupLimit") > shape.index("Exchange hashpartitioning")


def test_hot_keys_are_shuffled_by_part(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"))
    assert "hashpartitioning(k#" in plan(D.number_rows(df, ["k"], "o", []))
    assert re.search(r"hashpartitioning\(_hot#\d+L?, _part#\d+", plan(D.number_rows(df, ["k"], "o", [], hot_rows=10)))


def test_ranks_use_ranges(spark, monkeypatch):
    """The total order comes from a range shuffle; only the offsets, one per partition, meet in one task."""
    shapes = []
    monkeypatch.setattr(D, "stage", lambda df, name: (shapes.append(plan(df)), df)[1])
    D.global_rank(spark.range(100), ["id"])
    assert "rangepartitioning" in shapes[0] and "SinglePartition" not in shapes[0]


def test_lineage_is_cut_in_the_shared_folder():
    source = "".join(p.read_text() for p in (ROOT / "penstroke").rglob("*.py"))
    assert "localCheckpoint" not in source and "crossJoin" not in source
    assert re.findall(r"tempfile\.\w+", source) == ["tempfile.mkdtemp"]


def test_a_cluster_needs_the_setting():
    from penstroke import staging

    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        staging.shared_folder(Session)
