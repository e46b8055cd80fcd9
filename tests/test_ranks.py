"""Counts, ranks, thresholds and masks against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from penstroke.operators import chunking as C
from penstroke.operators import ranks as R
from tests.conftest import rows


@pytest.fixture(scope="module")
def vocab(spark):
    tokens = [*C.RESERVED, "ab", "cd", "X", "12", ".", "é"]
    return spark.createDataFrame(list(enumerate(tokens)), "id int, token string").cache()


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(5)
    data = []
    for i in range(60):
        ids, words, w = [0], [-1], -1
        while len(ids) < 15:
            if rng.random() < 0.1:
                ids, words = ids + [rng.choice([0, 2])], words + [-1]
                continue
            w += 1
            for _ in range(rng.randrange(1, 4)):
                ids, words = ids + [rng.choice([5, 6, 7, 7, 7, 8, 9, 10, 11, 12])], words + [w]
        data.append((f"a{i % 9}", f"d{i}", "s", i % 4, ids + [2], words + [-1]))
    return spark.createDataFrame(data, C.CHUNK_SCHEMA).cache()


def words_of(chunk, tokens):
    out = {}
    for t, w in zip(chunk.input_ids, chunk.word_ids):
        if w >= 0:
            out[w] = out.get(w, "") + tokens[t]
    return [out[w].lower() for w in range(len(out))]


def countable(word):
    return any(c.isalpha() for c in word)


@pytest.fixture(scope="module")
def counted(chunks, vocab):
    tokens = [r.token for r in vocab.orderBy("id").collect()]
    return Counter(w for c in chunks.collect() for w in words_of(c, tokens) if countable(w)), tokens


def test_words(chunks, vocab, counted):
    runs = R.word_runs(chunks, vocab)
    got = {(r.doc_id, r.word_id): r.word for r in runs.collect()}
    want = {(c.doc_id, i): w for c in chunks.collect() for i, w in enumerate(words_of(c, counted[1]))}
    assert got == want


def test_words_of_tokens_with_blanks(spark):
    tokens = [*C.RESERVED, " new", " york", " ", "s\n"]
    vocab = spark.createDataFrame(list(enumerate(tokens)), "id int, token string")
    data = [(a, "packed_nan", "s", 0, [0, *ids, 2], [-1, *w, -1]) for a, ids, w in (("x", [7, 8, 10, 9], [0, 1, 1, 2]), ("y", [8, 8, 8, 7], [0, 1, 2, 3]))]
    chunks = spark.createDataFrame(data, C.CHUNK_SCHEMA)
    words = {r.author: r.words for r in R.detokenize_words(chunks, vocab).collect()}
    assert words == {"x": ["new", "yorks", ""], "y": ["york", "york", "york", "new"]}
    ranked = R.attach_word_ranks(chunks, R.rank_map(R.count_words(chunks, vocab)), vocab)
    assert {r.author: r.ranks for r in ranked.collect()} == {"x": [-1, 1, 2, 2, -1, -1], "y": [-1, 0, 0, 0, 1, -1]}


def test_stored_words_are_spelled_once(spark, chunks, vocab, counted):
    stored = R.store_words(chunks, vocab)
    assert {r.key: r.n for r in R.count_words(stored, vocab).collect()} == counted[0]
    ranks = R.rank_map(R.count_words(stored, vocab))
    for table_bytes in (0, 1 << 20):
        ranked, again = (R.attach_word_ranks(c, ranks, vocab, 3, table_bytes) for c in (stored, chunks))
        assert ranked.columns == again.columns and rows(ranked) == rows(again)
        assert "array_join" not in ranked._jdf.queryExecution().executedPlan().toString()


def test_only_rare_words_are_listed_for_the_join(spark, chunks, vocab, monkeypatch):
    listed = []
    joined = R.salted_join
    monkeypatch.setattr(R, "salted_join", lambda large, small, keys: (listed.append(large), joined(large, small, keys))[1])
    ranks = R.rank_map(R.count_words(chunks, vocab))
    R.attach_word_ranks(chunks, ranks, vocab, 5, 0)
    head = {r.key for r in ranks.where("rank < 5").collect()}
    words = {r["_word"] for r in listed[0].collect()}
    assert words and not words & head and all(countable(w) for w in words)


def test_the_pattern_of_letters_meets_distinct_words(spark, chunks, vocab, monkeypatch):
    """Words are split at a single sign, counted, and only then told from numbers and signs."""
    shapes, staged = [], R.stage
    monkeypatch.setattr(R, "stage", lambda df, name="stage": (shapes.append(df._jdf.queryExecution().executedPlan().toString()), staged(df, name))[1])
    R.count_words(chunks, vocab)
    lines = [line for line in shapes[0].splitlines() if not line.lstrip().startswith(":")]  # without the subqueries
    assert "RLIKE" not in "".join(lines) and "HashAggregate" in shapes[0]


def test_words_lowered_at_their_ends(spark):
    """A word ends where its neighbour starts, also for a sign whose lower case depends on that."""
    tokens = [*C.RESERVED, "ΟΔΟ", "Σ", "É", "1"]
    vocab = spark.createDataFrame(list(enumerate(tokens)), "id int, token string")
    chunk = ("x", "d", "s", 0, [0, 7, 8, 7, 8, 9, 10, 9, 2], [-1, 0, 0, 1, 1, 2, 3, 4, -1])
    chunks = spark.createDataFrame([chunk], C.CHUNK_SCHEMA)
    assert R.detokenize_words(chunks, vocab).first().words == ["οδος", "οδος", "é", "1", "é"]
    assert rows(R.count_words(chunks, vocab)) == [("é", 2), ("οδος", 2)]


def test_count_words(chunks, vocab, counted):
    assert {r.key: r.n for r in R.count_words(chunks, vocab).collect()} == counted[0]


def test_count_tokens(chunks, vocab, counted):
    want = Counter(t for c in chunks.collect() for t in c.input_ids if t > 4 and countable(counted[1][t]))
    assert {r.key: r.n for r in R.count_tokens(chunks, vocab).collect()} == want


def ordered(counts):
    return sorted(counts, key=lambda k: (-counts[k], k.encode()))


def test_rank_map(chunks, vocab, counted):
    ranks = R.rank_map(R.count_words(chunks, vocab)).collect()
    assert [r.key for r in sorted(ranks, key=lambda r: r["rank"])] == ordered(counted[0])
    assert sorted(r["rank"] for r in ranks) == list(range(len(counted[0])))


@pytest.mark.parametrize(("head", "table_bytes"), [(1, 0), (5, 0), (1000, 0), (1, 1 << 20)])
@pytest.mark.parametrize("top", [8, 10_000])
def test_word_ranks(chunks, vocab, counted, head, table_bytes, top):
    counts, tokens = counted
    by_word = {w: i for i, w in enumerate(ordered(counts)[:top])}
    ranked = R.attach_word_ranks(chunks, R.rank_map_top_k(R.count_words(chunks, vocab), top), vocab, head, table_bytes)
    assert ranked.count() == chunks.count()
    for r in ranked.collect():
        of_word = [by_word.get(w, len(by_word)) if countable(w) else -1 for w in words_of(r, tokens)]
        assert r.ranks == [of_word[w] if w >= 0 else -1 for w in r.word_ids]


def test_token_ranks_and_mask(chunks, vocab, counted):
    counts = R.count_tokens(chunks, vocab)
    ranks = R.rank_map(counts)
    by_id = {r.key: r["rank"] for r in ranks.collect()}
    lookup = R.rank_lookup_table(ranks, vocab)
    assert lookup.first()[0] == [-1 if i < 4 else by_id.get(i, len(by_id)) for i in range(13)]
    ranked = R.attach_token_ranks(chunks, lookup)
    before = {r.doc_id: (r.input_ids, r.ranks) for r in ranked.collect()}
    for r in R.mask_content(ranked, R.threshold_percentile(counts, 0.5)).collect():
        ids, known = before[r.doc_id]
        t = len(by_id) // 2
        assert r.input_ids == [C.MASK if k >= t and k != -1 else i for i, k in zip(ids, known)]


def table(spark, values):
    return spark.createDataFrame([(f"k{i}", v) for i, v in enumerate(values)], "key string, n bigint")


@pytest.mark.parametrize("share", [0.0, 0.7, 1.0])
def test_percentile(spark, share):
    assert R.threshold_percentile(table(spark, range(1, 11)), share).first()[0] == int(10 * share)


def test_percentile_of_many_types(spark):
    counts = spark.range(68_724).select(F.col("id").cast("string").alias("key"), F.lit(1).cast("bigint").alias("n"))
    assert R.threshold_percentile(counts, 0.70).first()[0] == 48_106


def test_relative_frequency(spark):
    assert R.threshold_relative_frequency(table(spark, [50, 30, 15, 5]), 0.15).first()[0] == 3
    assert rows(R.relative_frequency(table(spark, [1, 3])), "freq") == [(0.25,), (0.75,)]


def test_strategies(spark):
    counts = table(spark, [5, 4])
    assert R.masking_threshold(counts, "top_k", 7.9).first()[0] == 7
    assert R.masking_threshold(counts.limit(0), "top_k", 7.9).first()[0] == 7
    with pytest.raises(ValueError):
        R.masking_threshold(counts, "other", 1)
    with pytest.raises(ValueError):
        R.threshold_percentile(counts, 1.5)


def test_vocabulary(spark):
    counts = spark.createDataFrame([("b", 3), ("a", 3), ("c", 9), ("d", 1)], "piece string, n bigint")
    vocab = C.build_vocab(counts, len(C.RESERVED) + 3)
    assert [r.token for r in vocab.orderBy("id").collect()] == [*C.RESERVED, "c", "a", "b"]
