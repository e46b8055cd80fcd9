"""Quality, hard negatives and manifests against brute force, SQL and defined edge cases."""

import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from penstroke.llm import manifest, negatives, quality, queries
from tests.conftest import SMALL


# --- manifest


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, lower=False):
    doc_id, source, lang, n_chars, text = row
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return digest("".join(map(field, (doc_id, source, lang, n_chars, text))))


def tree(leaves):
    """Levels of a tree, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def plain_manifest(rows, tampered):
    """Leaf, subroot, root, proof and folded root of every row, node by node."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for s in sources}
    trees = {s: tree([leaf_of(r) for r in of[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for i, s in enumerate(sources):
        for j, row in enumerate(of[s]):
            siblings, h = "", leaf_of(row, tampered(row[0]))
            for levels, at in ((trees[s], j), (top, i)):
                for level in levels[:-1]:
                    run = level[at // 16 * 16 : at // 16 * 16 + 16]
                    before, after = "".join(run[: at % 16]), "".join(run[at % 16 + 1 :])
                    siblings, h, at = siblings + before + after, digest(before + h + after), at // 16
            root = top[-1][0]
            out.append((row[0], leaf_of(row), trees[s][-1][0], root, digest(siblings), h, h == root))
    return sorted(out, key=repr)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, grp int, pos string, hash string, item int"


def fifth(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "p", "h", 2) for r in rows], DOCS).repartition(4)
    got = manifest.verify_documents(docs, queries.fold("doc_id", 5) == 0 if rows else F.lit(False))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_manifest(rows, fifth)


def made_rows(n, sources, seed):
    random = np.random.default_rng(seed)
    return [(int(i), sources[random.integers(len(sources)) if random.random() > 0.4 else 0], "en", 3, f"Text É {i % 9}") for i in random.permutation(n)]


@pytest.mark.parametrize(("n", "sources"), [(0, ["a"]), (1, ["a"]), (2, [None]), (17, ["a"]), (300, ["hot", "", None, "é", "Z"]), (700, [f"s{i}" for i in range(300)])])
def test_manifest_equals_plain_trees(spark, n, sources):
    check(spark, made_rows(n, sources, n))


def test_manifest_of_odd_rows(spark):
    """Missing values in every column, empty and long texts, equal rows, rows that share an id; clashing columns stay out."""
    rows = [(1, "a", "en", 3, "ABC"), (1, "a", "en", 3, "ABC"), (1, "a", "en", 3, "abd"), (None, "a", None, None, None), (None, None, "x", 0, ""), (0, "a", "en", 1, "É" * 300_000 + "Q"),
            (5, "-", "-", None, "-"), (7, None, None, 7, "x:1-")]
    check(spark, rows + [(i, "a", "en", 2, "same") for i in range(10, 60)] + [(70, "b", "en", 2, "Same")] * 40)


def test_manifest_twin(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = sorted(c.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLES['op13_manifest']})").fetchall())
    got = queries.dataset_manifest(spark, SMALL)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == want
    assert {r.verified for r in got.collect()} == {True, False}


# --- hard negatives


@pytest.mark.parametrize("width", [1, 64, 65, 200])
@pytest.mark.parametrize("size", [1, 300, 2**20, 2**27])
def test_products_are_exact(width, size):
    random = np.random.default_rng(width)
    a, b = (random.integers(-size, size + 1, (n, width)) for n in (7, 11))
    a[0], b[0], b[1] = size, size, -size
    bound = width * size * size
    got = negatives.integer_products(a.astype(float), b.astype(float), negatives.primes_for(bound))
    assert got.dtype == np.int64 and got.tolist() == (a.astype(object) @ b.T.astype(object)).tolist()


def test_scores_past_63_bits_are_an_error():
    assert negatives.primes_for(0) == () and len(negatives.primes_for(2**62)) == 7
    with pytest.raises(ValueError):
        negatives.primes_for(2**70)
    assert (negatives.integer_products(np.zeros((2, 0)), np.zeros((3, 0)), ()) == 0).all()


def plain_negatives(rows, is_anchor):
    """All pairs, in plain Python."""
    used = set()
    for key, label, v in rows:
        if key is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        used.add((key, (label + 1) % 10 if key % 7 == 0 else label, tuple(int(np.floor(256.0 * np.float32(x))) for x in v)))
    dot = lambda v, w: sum(x * y for x, y in zip(v, w))
    out = []
    for key, label, v in used:
        if not is_anchor(key):
            continue
        scored = sorted((-dot(v, w), k, lab) for k, lab, w in used)
        for minus, k, _ in [s for s in scored if s[2] == label and s[1] != key][:5]:
            window = [s for s in scored if s[2] != label and 80 * -minus <= 100 * -s[0] <= 100 * -minus]
            out += [(key, k, rank, n, -minus, -m) for rank, (m, n, _) in enumerate(window[:5], 1)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<float>, id string, vec int, no int"


def mined(spark, rows, condition="id % 10 = 0"):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mine_hard_negatives(df, condition, label=label)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_negatives_equal_all_pairs(spark, seed, monkeypatch):
    random = np.random.default_rng(seed)
    rows = [(i, int(random.integers(3)), (np.round(random.normal(size=6) * 4) / 4 + 0.3).tolist()) for i in range(300)]
    rows += [(1000 + i, 1, rows[10][2]) for i in range(40)]  # a large group of copies
    want = plain_negatives(rows, lambda k: k % 10 == 0)
    assert want and mined(spark, rows) == want
    monkeypatch.setattr(negatives, "CELL", 50)
    monkeypatch.setattr(negatives, "GROUP_ROWS", 7)
    monkeypatch.setattr(negatives, "ANCHORS_PER_GROUP", 9)
    assert mined(spark, rows) == want


def test_negatives_of_odd_rows(spark):
    rows = [(0, 1, [1.0, 2.0]), (10, 1, [2.0, 2.0]), (11, 1, [1.0, 1.5]), (11, 1, [1.0, 1.5]), (11, 2, [1.0, 1.5]), (12, 2, [2.0]), (13, 2, []), (15, 3, [1.0, float("nan")]),
            (16, 3, [float("inf"), 0.0]), (17, 3, [None, 1.0]), (18, None, [1.0, 1.0]), (19, 3, None), (None, 3, [1.0, 1.0]), (20, 4, [-1.0, 0.1]), (22, 5, [1.1, 1.9]), (23, 5, [-0.0, 0.0])]
    assert mined(spark, rows) == plain_negatives(rows, lambda k: k % 10 == 0)
    assert mined(spark, []) == [] and mined(spark, rows, "id < 0") == []
    assert mined(spark, [(0, 1, [1.0])]) == []


# --- quality


def plain_contexts(texts):
    total, index = np.zeros((quality.BUCKETS, quality.DIMENSIONS + 1), np.int64), quality.index_vectors().T.astype(np.int64)
    for text in texts:
        at = [zlib.crc32(w.encode()) % quality.BUCKETS for token in (text or "").split() for w in quality.words_of(token)]
        for i, b in enumerate(at):
            total[b, -1] += 1
            for j in range(max(0, i - quality.NEIGHBOURS), min(len(at), i + quality.NEIGHBOURS + 1)):
                if j != i:
                    total[b, :-1] += index[at[j]]
    return total


def plain_pool(text, vectors):
    at = [zlib.crc32(w.encode()) % quality.BUCKETS for token in (text or "").split() for w in quality.words_of(token)]
    if not at:
        return np.zeros(quality.FEATURES)
    v = vectors.T[at]
    steps = np.abs(np.diff(v, axis=0)).sum(axis=0) / len(at)
    return np.concatenate([v.mean(axis=0), v.std(axis=0), steps, [np.log1p(len(at))]])


TEXTS = ["One two THREE, two one!!!", "", None, "a", "| x | y |", "É é É " * 400, "two one", "no_name 12-13", "w " * 3000]


@pytest.mark.parametrize("positions", [5, 1 << 18])
def test_word_vectors_and_pooling_equal_plain_python(spark, positions, monkeypatch):
    monkeypatch.setattr(quality, "POSITIONS", positions)
    total = np.zeros((quality.BUCKETS, quality.DIMENSIONS + 1), np.int64)
    table = quality.TokenTable()
    bucket, row = table.positions(pa.array([t or "" for t in TEXTS], pa.string()))
    quality.add_contexts(total, bucket, row, quality.index_vectors())
    assert (total == plain_contexts(TEXTS)).all()
    vectors = quality.word_vectors(total)
    got = quality.pool(bucket, row, len(TEXTS), vectors)
    assert np.allclose(got, [plain_pool(t, vectors) for t in TEXTS], atol=2e-5)
    if positions > 5:
        docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(4)
        assert (quality.count_contexts(docs, "text") == total).all()
        pooled = {r.doc_id: r.features for r in quality.pooled_vectors(docs, vectors, "doc_id", "text").collect()}
        assert np.allclose([pooled[i] for i in range(len(TEXTS))], got, atol=2e-5)


def test_words():
    assert quality.words_of("THREE,") == ["<capitals>", "three", ","] and quality.words_of("OF!!!!") == ["<capitals>", "of", "!!"]
    assert quality.words_of("A") == ["a"] and quality.words_of("don't") == ["don", "'", "t"] and quality.words_of("ÉÉ") == ["<capitals>", "éé"]


def test_temperature_and_network():
    random = np.random.default_rng(0)
    x = random.normal(size=(3000, quality.FEATURES))
    truth = 1 / (1 + np.exp(-(4 * x[:, 0] - x[:, 1] * x[:, 2])))
    y = (random.random(3000) < truth).astype(int)
    network = quality.fit_network(x, y, np.ones(3000))
    fresh = random.normal(size=(3000, quality.FEATURES))
    p = network.scores(fresh)
    real = (random.random(3000) < 1 / (1 + np.exp(-(4 * fresh[:, 0] - fresh[:, 1] * fresh[:, 2])))).astype(int)
    assert ((p >= 0.5) == real).mean() > 0.7 and ((0 <= p) & (p <= 1)).all()
    assert quality.best_temperature(np.array([8.0, 8, 8, -8]), np.array([1, 1, 0, 0]), np.ones(4)) > 4
    assert quality.best_temperature(np.empty(0), np.empty(0), np.empty(0)) == 1.0


def test_quality_on_rows_held_out(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality")
    got = queries.quality_scores(spark, SMALL)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.85


def test_quality_of_odd_rows(spark, monkeypatch):
    """Missing and empty texts and ids, ids that repeat, clashing columns; labels missing, of one kind, or none."""
    rows = [(i, t, "x", 3) for i, t in enumerate(TEXTS)] + [(None, "no id", "y", 1), (0, "twice", "z", 2), (0, None, "z", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, features string, label int")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (3, 1), (4, 0), (5, None), (None, 1), (99, 0), (6, 1)], "doc_id long, quality int")
    every = F.lit(True)
    got = quality.quality_scores(docs, labels, every).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.quality_scores(docs, labels.where("quality = 1"), every).collect()} == {1.0}
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0), every).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels, every).count() == 0
    monkeypatch.setattr(quality, "LABELLED_ROWS", 1)
    assert quality.quality_scores(docs, labels, every).count() == len(rows)
