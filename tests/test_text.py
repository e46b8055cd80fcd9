"""Cleaning, predicates and digests."""

import hashlib

import pytest
from pyspark.sql import functions as F

from penstroke.functions import arrays as A
from penstroke.functions import text as X
from penstroke.operators import corpus as D


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression).first()[0]


def test_clean_social_text(spark):
    text = "hi @bob see http://x.y/@z, mail a@b.com www.q.r end"
    assert one(spark, text, X.clean_social_text("x")) == "hi <u> see <h> mail a<u>.com <h> end"


NAMES = [
    ("A Lady", False), ("An Officer", False), ("A . B", True), ("A  .", False), ("A. Smith", True), ("Twain, Mark", True),
    ("Smith and Co", False), ("Anderson, X", True), ("Various", False), ("anon", False), ("Anonson", True), ("a ", False),
    ("A", True), ("Brown & Co", False), (None, False), ("Émile andré", True),
]


@pytest.mark.parametrize("name, kept", NAMES)
def test_anonymous_names(spark, name, kept):
    assert D.filter_anonymous_authors(spark.createDataFrame([(name,)], "author string")).count() == int(kept)


def test_sentinels(spark):
    names = spark.createDataFrame([("x",), ("None",), ("nan",), ("[deleted]",), (None,)], "author string")
    assert [r.author for r in D.filter_sentinel_authors(names).collect()] == ["x"]
    assert D.filter_sentinel_authors(names, ("None", "nan")).count() == 2


def test_trim_keeps_line_breaks(spark):
    assert one(spark, "  a \n", F.trim("x")) == "a \n"


@pytest.mark.parametrize("word, yes", [("abc", True), ("ß1", True), ("12", False), ("...", False), ("", False), (None, False)])
def test_countable(spark, word, yes):
    assert one(spark, word, X.is_countable_word("x")) is yes


def test_digest(spark):
    digest = hashlib.md5(b"doc42").hexdigest()
    assert one(spark, "doc", X.seeded_digest("x")) == digest
    assert one(spark, "doc", X.digest_number(X.seeded_digest("x"))) == int(digest[:15], 16)


def test_words_and_pieces(spark):
    text = "abcdefghi (<u>) <s>12345 it's"
    assert one(spark, text, X.words("x")) == ["abcdefghi", "(", "<u>", ")", "<s>", "12345", "it", "'", "s"]
    assert one(spark, text, X.pieces(X.words("x")))[:4] == ["abcd", "efgh", "i", "("]
    assert one(spark, text, X.piece_words(X.words("x"))) == [0, 0, 0, 1, 2, 3, -5, 5, 5, 6, 7, 8]


def test_local_word_ids(spark):
    # 12 is a separator inside the text, null one between texts.
    numbers = [10, 10, 11, -13, 13, None, 14, 14]
    assert one(spark, numbers, A.local_word_ids("x"), "array<bigint>") == [0, 0, 1, -1, 2, -1, 3, 3]


def test_content_mask(spark):
    df = spark.createDataFrame([([5, 6, 7, 8], [-1, 2, 3, 9])], "ids array<int>, ranks array<int>")
    assert df.select(A.content_mask("ids", "ranks", F.lit(3), F.lit(4))).first()[0] == [5, 6, 4, 4]


def test_language(spark):
    meta = spark.createDataFrame([("['en']",), ("['en', 'fr']",), (None,)], "language string")
    assert D.filter_language(meta, "['en']").count() == 1
