"""Chunks against a plain Python rendering of packed texts."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from penstroke.functions import text as X
from penstroke.operators import chunking as C
from penstroke.operators import corpus as D
from penstroke.plans import training as P
from tests.conftest import rows

LENGTH = 12
PAYLOAD = LENGTH - 2
WORD = re.compile(r"</?s>|<[uh]>|[^\W\d_]+|\d+|[^\s\w<]+|_+|<")


def split(text):
    """(piece, word index or -1 for a separator) of a text."""
    out, n = [], 0
    for word in WORD.findall(text):
        separator = word in ("<s>", "</s>")
        out += [(word[i : i + 4], -1 if separator else n) for i in range(0, len(word), 4)]
        n += not separator
    return out


def chunks_of(tokens, keep_tail=False):
    for at in range(0, max(len(tokens), 1) if keep_tail else len(tokens), PAYLOAD):
        part = tokens[at : at + PAYLOAD]
        if len(part) < PAYLOAD and not keep_tail:
            continue
        local, seen = [], []
        for _, w in part:
            if w >= 0 and w not in seen[-1:]:
                seen.append(w)
            local.append(len(seen) - 1 if w >= 0 else -1)
        yield at // PAYLOAD, [p for p, _ in part], local


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["a", "the", "abcdefgh", "it's", "12345", "<u>", "<h>", "<s>", "</s>", "x", "...", "naïve", "<b"]
    data = [(f"d{i}", "hot" if i % 3 else f"k{i % 7}", " ".join(rng.choices(words, k=rng.randrange(0, 14)))) for i in range(120)]
    data += [("e0", "edge", ""), ("e1", "edge", ""), ("e2", "edge", "solo"), ("e3", "only", ""), ("e4", "none", None)]
    data += [(f"n{n}", f"len{n}", " ".join(["w"] * n)) for n in (PAYLOAD - 1, PAYLOAD, PAYLOAD + 1, 2 * PAYLOAD, 3 * PAYLOAD)]
    df = spark.createDataFrame([(a, t, d, "s") for d, a, t in data], "author string, text string, doc_id string, source string")
    return df.cache()


@pytest.fixture(scope="module")
def vocab(docs):
    return C.build_vocab(C.piece_counts(docs), 1000).cache()


def by_author(docs, separator):
    """Packed tokens of every author, in the order of the digest."""
    texts = defaultdict(list)
    ordered = docs.withColumn("digest", X.seeded_digest("doc_id")).orderBy("digest", "doc_id").collect()
    for r in ordered:
        if r.text is not None:
            texts[r.author].append(r.text.strip(" "))
    return {a: separator.join(t) for a, t in texts.items()}


def decoded(chunks, vocab):
    tokens = [r.token for r in vocab.orderBy("id").collect()]
    return sorted((r.author, r.chunk_idx, [tokens[i] for i in r.input_ids[1:-1]], r.word_ids[1:-1]) for r in chunks.collect())


def test_whole_chunks_are_not_shuffled(spark, docs, vocab, monkeypatch):
    """Only the ends of a document meet others; a piece is counted as the words are cut."""
    chunks = C.chunk_packed(C.encode(D.trim_text(docs), vocab), length=LENGTH)
    shape = chunks._jdf.queryExecution().executedPlan().toString()
    first, second = shape.split("ObjectHashAggregate" if "ObjectHashAggregate" in shape else "SortAggregate", 1)
    assert "Union" in first and "Exchange" not in first and "Exchange" in second
    cut = docs.select(X.pieces(X.words("text")).alias("a"), X.text_pieces("text").alias("b"))
    assert all(r.a == r.b for r in cut.collect())


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_only_sizes_are_put_in_order(spark, docs, vocab, monkeypatch, threshold):
    """No window or sort sees a token: they meet their document's place by a hash join, broadcast while it is small."""
    encoded = C.number_stored(C.encode(D.trim_text(docs), vocab))
    want = decoded(C.chunk_packed(encoded, length=LENGTH), vocab)
    before, shapes, staged = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), {}, C.stage

    def watched(df, name):
        shapes[name] = df._jdf.queryExecution().executedPlan().toString()
        return staged(df, name)

    monkeypatch.setattr(C, "stage", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        assert decoded(C.chunk_packed(encoded, length=LENGTH), vocab) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert set(shapes) == {"places", "placed-documents"}  # numbered rows are not stored again
    assert "Window" in shapes["places"] and "word_at" not in shapes["places"].split("FileScan")[0]
    joined = "ShuffledHashJoin" if threshold == "-1" else "BroadcastHashJoin"
    assert joined in shapes["placed-documents"] and "Sort" not in shapes["placed-documents"] and "Window" not in shapes["placed-documents"]


@pytest.mark.parametrize("hot_tokens", [25, 1_000_000])
@pytest.mark.parametrize("separator", [C.PAGE_BREAK_SEPARATOR, C.BLANK_LINES_SEPARATOR])
@pytest.mark.parametrize("keep_tail", [False, True])
def test_chunk_packed(docs, vocab, separator, hot_tokens, keep_tail):
    text, ids = separator
    encoded = C.encode(D.trim_text(docs), vocab)
    got = C.chunk_packed(encoded, ids, LENGTH, hot_tokens=hot_tokens, keep_tail=keep_tail)
    want = sorted((a, i, p, w) for a, t in by_author(docs, text).items() for i, p, w in chunks_of(split(t), keep_tail))
    assert decoded(got, vocab) == want
    edges = got.select((F.element_at("input_ids", 1)).alias("a"), F.element_at("input_ids", -1).alias("b")).distinct()
    assert rows(edges) == [(C.BOS, C.EOS)]
    if not keep_tail:
        counts = C.packed_chunk_counts(encoded, ids, LENGTH).where("n_chunks > 0")
        assert rows(counts, "author", "n_chunks") == rows(got.groupBy("author").count())


@pytest.mark.parametrize("hot_tokens", [25, 1_000_000])
def test_packed_doc_id(docs, vocab, hot_tokens):
    got = C.chunk_packed(C.encode(docs, vocab), length=LENGTH, hot_tokens=hot_tokens)
    least = docs.groupBy("author").agg(F.concat(F.lit("packed_"), F.min("doc_id")).alias("doc_id"))
    assert got.count() > 0 and got.join(least, ["author", "doc_id"], "left_anti").count() == 0


@pytest.mark.parametrize("hot_chars", [60, 1_000_000])
@pytest.mark.parametrize("part_chars", [7, 1_000_000])
def test_pack_authors(docs, part_chars, hot_chars):
    got = D.pack_authors(docs, part_chars=part_chars, hot_chars=hot_chars)
    assert got.where(F.length("text") > part_chars).count() == 0
    joined = defaultdict(str)
    for r in got.orderBy("part").collect():
        joined[r.author] += r.text
    assert joined == by_author(docs, " </s> <s> ")


def test_documents_apart(docs, vocab):
    encoded = C.encode(docs, vocab)
    chunks = C.chunk_documents(encoded, LENGTH)
    want = sorted((r.doc_id, i, p, w) for r in docs.collect() if r.text is not None for i, p, w in chunks_of(split(r.text), True))
    tokens = [r.token for r in vocab.orderBy("id").collect()]
    got = sorted((r.doc_id, r.chunk_idx, [tokens[i] for i in r.input_ids[1:-1]], r.word_ids[1:-1]) for r in chunks.collect())
    assert got == want
    inner = C.keep_full_chunks(C.drop_edge_chunks(chunks), LENGTH)
    n_chunks = {r.doc_id: max(1, -(-len(split(r.text)) // PAYLOAD)) for r in docs.collect() if r.text is not None}
    assert {(r.doc_id, r.chunk_idx) for r in inner.collect()} == {(d, i) for d, n in n_chunks.items() for i in range(1, n - 1)}
    counts = C.inner_chunk_counts(encoded, LENGTH).where("n_chunks > 0")
    assert rows(counts, "author", "n_chunks") == rows(inner.groupBy("author").count())


def test_padding(docs, vocab):
    chunks = C.chunk_tokens_keep_tail(C.encode(docs.where("text is not null"), vocab), LENGTH)
    assert {len(r.input_ids) for r in chunks.collect()} == {LENGTH}
    for r in chunks.collect():
        n = sum(r.attention_mask)
        assert r.attention_mask == [1] * n + [0] * (LENGTH - n)
        assert all(t == C.PAD for t in r.input_ids[n:]) and C.PAD not in r.input_ids[:n]


def test_filter_valid_authors(spark):
    data = [("x", "s1", f"d{i}", i) for i in range(3)] + [("x", "s2", "d", 0), ("y", "s1", "d", 0)]
    chunks = spark.createDataFrame(data, "author string, source string, doc_id string, chunk_idx int")
    assert C.filter_valid_authors(chunks, 4).count() == 4
    assert C.filter_valid_authors(chunks, 3, ["source", "author"]).count() == 3


def test_user_tokenizer(spark, docs):
    def load():
        def tokenize(texts):
            return [([len(w) for w in t.split()], list(range(len(t.split())))) for t in texts]

        return tokenize

    got = C.encode_with(docs, load)
    for r, t in zip(got.orderBy("doc_id").collect(), docs.orderBy("doc_id").collect()):
        if t.text is None:
            assert r.ids is None and r.n_tokens is None
        else:
            assert r.ids == [len(w) for w in t.text.split()] and r.n_words == r.n_tokens == len(r.ids)


@pytest.mark.parametrize("unify", [True, False])
def test_chunk_corpora_filters_as_chunks_do(spark, docs, vocab, unify):
    both = docs.unionByName(docs.withColumn("source", F.lit("t")).withColumn("doc_id", F.concat(F.lit("t"), "doc_id")))
    settings = {"s": P.CorpusSettings(), "t": P.CorpusSettings(pack=False)}
    every = P.chunk_corpora(both, settings, vocab, LENGTH, min_chunks=0, unify=unify)
    some = P.chunk_corpora(both, settings, vocab, LENGTH, min_chunks=4, unify=unify, hot_tokens=40)
    want = C.filter_valid_authors(every, 4, ["author"] if unify else ["source", "author"])
    assert 0 < want.count() < every.count()
    assert rows(some) == rows(want)
