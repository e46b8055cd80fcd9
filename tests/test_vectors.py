"""Vectors, neighbours, loss, reports and verification against NumPy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from penstroke.functions import vectors as V
from penstroke.operators import embeddings as M
from penstroke.operators import evaluation as E
from penstroke.operators import neighbours as N
from tests.conftest import rows

AUTHORS, VIEWS, D = 13, 5, 6


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(AUTHORS, 1, D))
    return centers + 0.8 * rng.normal(size=(AUTHORS, VIEWS, D))


@pytest.fixture(scope="module")
def embeddings(spark, data):
    out = [(a * VIEWS + v, a, v, a % 3, data[a, v].tolist()) for a in range(AUTHORS) for v in range(VIEWS)]
    return spark.createDataFrame(out, "vec_id bigint, author int, view int, batch_id int, embedding array<double>").cache()


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


@pytest.mark.parametrize("strip_rows", [3, 20, 1000])
def test_knn(embeddings, data, strip_rows):
    u, want = unit(data), []
    for v in range(VIEWS):
        for a in range(AUTHORS):
            for w in range(VIEWS):
                if w != v:
                    want.append((v, a * VIEWS + w, a, int(np.argmax(u[:, v] @ u[a, w]))))
    got = N.knn1_leave_one_view(embeddings, strip_rows=strip_rows)
    assert rows(got, "view", "vec_id", "truth", "pred") == sorted(want, key=repr)


def test_knn_ties_go_to_the_lowest_label(spark):
    same = [(i, label, view, [1.0, 0.0]) for i, (label, view) in enumerate((a, v) for a in (4, 2, 9) for v in (0, 1))]
    df = spark.createDataFrame(same, "vec_id bigint, author int, view int, embedding array<double>")
    assert {r.pred for r in N.knn1_leave_one_view(df, strip_rows=1).collect()} == {2}


def test_knn_rows_cross_no_shuffle(embeddings):
    """A row per vector and view grows with their product, so it leaves the cells as it is; a report leaves counts there."""
    found = N.knn1_leave_one_view(embeddings)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "SortAggregate" not in plan
    counts = [tuple(r) for r in found.groupBy("truth", "pred").count().collect()]
    assert sorted(counts, key=repr) == rows(N.knn1_confusion(embeddings), "truth", "pred", "n") == rows(N.knn1_confusion(embeddings, strip_rows=3))
    plan = N.knn1_confusion(embeddings)._jdf.queryExecution().executedPlan().toString()
    assert "sum(n" in plan and "sim#" not in plan


def test_knn_of_repeated_keys(embeddings):
    """Of several vectors with a key and label the nearest counts, whether a view is in one strip or in several."""
    twice = embeddings.withColumn("vec_id", (F.col("vec_id") / 2).cast("bigint")).cache()
    for strip_rows in (3, 1000):
        got = N.knn1_leave_one_view(twice, strip_rows=strip_rows)
        assert rows(got) == rows(got.dropDuplicates(["view", "vec_id", "truth"])) == rows(N.knn1_leave_one_view(twice, strip_rows=20))
        counted = sorted((tuple(r) for r in got.groupBy("truth", "pred").count().collect()), key=repr)
        assert rows(N.knn1_confusion(twice, strip_rows=strip_rows)) == counted


@pytest.mark.parametrize("strip_rows", [3, 1000])
def test_knn_copies_no_vector(embeddings, strip_rows):
    """However many strips there are, a vector is stored once and shuffled once as a query: disk grows with the vectors."""
    found = N.knn1_leave_one_view(embeddings, strip_rows=strip_rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CoGroups" not in plan and plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan
    views = N._stored_views(embeddings, "author", "vec_id", "view", strip_rows, 0)
    assert views.queries.count() == AUTHORS * VIEWS and views.queries.rdd.getNumPartitions() >= AUTHORS * VIEWS / strip_rows
    stored = pa.Table.from_batches(N._batches(views.path, views.files, 4))
    assert stored.select(["view", "author"]).to_pylist() == [{"view": v, "author": a} for v in range(VIEWS) for a in range(AUTHORS)]


@pytest.mark.parametrize("sizes", [[1, 2, 3], [9, 1, 4, 4, 1], [4], [5, 5], [1, 8, 1]])
@pytest.mark.parametrize("rows", [1, 2, 4, 100])
def test_pieces_hold_whole_views_or_parts_of_one(sizes, rows):
    views = np.repeat(np.arange(len(sizes)), sizes)
    batches = pa.table({"view": views, "n": np.arange(len(views))}).to_batches(max_chunksize=max(1, rows - 1))
    pieces = [(p["view"].to_pylist(), p["n"].to_pylist(), ended) for p, ended in N._in_pieces(iter(batches), "view", rows)]
    assert [n for _, part, _ in pieces for n in part] == list(range(len(views))) and all(len(part) <= 2 * rows for part, _, _ in pieces)
    whole = []
    for of, _, ended in pieces:
        assert len(set(of)) == 1 or ended and not set(of) & set(whole)
        whole += [v for v in set(of) if ended]
    assert sorted(whole) == list(range(len(sizes)))


def test_knn_of_names_and_missing_labels(spark, embeddings):
    """Keys, labels and views may be text and labels missing; those come last among equal similarities."""
    named = embeddings.select(
        F.concat(F.lit("k"), "vec_id").alias("vec_id"),
        F.when(F.col("author") != 5, F.format_string("a%02d", "author")).alias("author"),
        F.concat(F.lit("v"), "view").alias("view"),
        F.when(F.col("author").isin(5, 6), F.array(*[F.lit(1.0)] * D)).otherwise(F.col("embedding")).alias("embedding"),
    ).cache()
    got = {(r.view, r.vec_id): (r.truth, r.pred) for r in N.knn1_leave_one_view(named, strip_rows=3).collect()}
    plain = embeddings.where("author <> 5").withColumn("embedding", F.when(F.col("author") == 6, F.array(*[F.lit(1.0)] * D)).otherwise(F.col("embedding")))
    for r in N.knn1_leave_one_view(plain).collect():
        assert got.pop((f"v{r.view}", f"k{r.vec_id}")) == (f"a{r.truth:02d}", f"a{r.pred:02d}")
    assert set(got.values()) == {(None, "a06")} and len(got) == VIEWS * (VIEWS - 1)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_pivots_skip_blocks_and_change_nothing(spark, spread):
    """Two views of 1200 authors in 8 clusters: the nearest are the same, and tight clusters are skipped."""
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(8, 5))
    x = unit(centers[np.arange(2400) % 8] + spread * rng.normal(size=(2400, 5)))
    place, sim, blocks, skipped = N.nearest_of_run(x[:1200], x[1200:], x[:8])
    sims = np.round(x[:1200] @ x[1200:].T, 9)
    assert (place == sims.argmax(axis=1)).all() and (sim == sims.max(axis=1)).all()
    assert blocks == 100 and (skipped > 50 if spread < 0.1 else skipped >= 0)
    df = spark.createDataFrame([(i, i % 1200, i // 1200, x[i].tolist()) for i in range(2400)], "vec_id bigint, author int, view int, embedding array<double>")
    assert rows(N.knn1_leave_one_view(df)) == rows(N.knn1_leave_one_view(df, pivots=0))
    assert rows(N.knn1_leave_one_view(df, strip_rows=500)) == rows(N.knn1_leave_one_view(df, pivots=0))
    counted = N.skipped_blocks(df).agg(F.sum("blocks"), F.sum("skipped")).first()
    assert counted[0] >= 200 and (counted[1] > 0 or spread == 1.0)


@pytest.mark.parametrize("strip_rows", [2, 1000])
def test_supcon(embeddings, data, strip_rows):
    sims = N.pairwise_similarity(embeddings, label="author", strip_rows=strip_rows)
    got = {r.batch_id: (r.n, r.loss) for r in N.supcon_loss(sims).collect()}
    for batch in range(3):
        authors = np.array([a for a in range(AUTHORS) if a % 3 == batch])
        x, labels = unit(data[authors]).reshape(-1, D), np.repeat(authors, VIEWS)
        logits = x @ x.T / 0.07
        np.fill_diagonal(logits, -np.inf)
        log_prob = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        positive = (labels[:, None] == labels[None]) & ~np.eye(len(x), dtype=bool)
        loss = -np.mean(np.where(positive, log_prob, 0).sum(axis=1) / positive.sum(axis=1))
        assert got[batch][0] == len(x) and got[batch][1] == pytest.approx(loss, abs=1e-8)


def test_supcon_of_single_vectors(spark):
    df = spark.createDataFrame([(0, 0, 1, [1.0, 0.0]), (1, 0, 2, [0.0, 1.0])], "vec_id bigint, batch_id int, label int, embedding array<double>")
    assert N.supcon_loss(N.pairwise_similarity(df)).first().loss == 0


def test_centroids(embeddings, data):
    got = {r.author: r.centroid for r in M.author_centroids(embeddings).collect()}
    for a in range(AUTHORS):
        assert np.allclose(got[a], unit(data[a]).mean(axis=0), atol=1e-12)


def test_pooling(spark):
    df = spark.createDataFrame(
        [("a", 1, [1.0, 2.0]), ("a", 0, [9.0, 9.0]), ("a", 1, [3.0, 4.0]), ("b", 0, [1.0, 1.0])], "k string, mask int, vector array<double>"
    )
    assert rows(M.masked_mean_pool(df, ["k"])) == [("a", 0, 2.0), ("a", 1, 3.0), ("b", 0, 0.0), ("b", 1, 0.0)]


def test_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(V.l2_normalize("a"), V.cosine_similarity("a", "b"), V.siamese_features("a", "b")).collect()
    assert got[0][0] == [0.6, 0.8] and got[0][1] == 0.8 and got[0][2] == [3, 4, 0, 2, 3, 2, 0, 8]
    assert got[1][0] == [0, 0] and got[1][1] == 0


def test_embedding_hook(spark):
    chunks = spark.createDataFrame([(i, [0, i, i, 2], [1, 1, 1, 0]) for i in range(150)], "k int, input_ids array<int>, attention_mask array<int>")
    got = {r.k: r.embedding for r in M.embed_chunks(chunks, M.token_identity, ["k"], batch_rows=7).collect()}
    bags = {r.k: r.embedding for r in M.embed_chunks(chunks, M.hashed_bag(5), ["k"]).collect()}
    for k in range(150):
        assert np.allclose(got[k], unit(np.array([0.0, k, k, 2])))
        bag = np.bincount([0, k % 5, k % 5], minlength=5)
        assert np.allclose(bags[k], unit(bag.astype(float)))


def test_masked_embedding(spark):
    chunks = spark.createDataFrame([([0, 5, 6, 2],)], "input_ids array<int>").withColumn("k", F.lit(1))
    lookup = spark.createDataFrame([([-1, -1, -1, -1, 9, 0, 7],)], "lookup array<int>")
    got = M.embed_masked_chunks(chunks, M.token_identity, ["k"], lookup, 3).first().embedding
    assert np.allclose(got, unit(np.array([0, 5, 4, 2.0])))


def test_report(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (2, 2), (3, 0)]
    report = {r["class"]: r for r in E.classification_report(spark.createDataFrame(pairs, "truth int, pred int")).collect()}
    assert set(report) == {"0", "1", "2", "3", "accuracy", "macro avg", "weighted avg"}
    assert (report["2"].precision, report["2"].recall, report["2"].support) == (1.0, pytest.approx(2 / 3), 3)
    assert report["3"].precision == report["3"].f1 == 0
    assert report["accuracy"].f1 == pytest.approx(4 / 7)
    assert report["macro avg"].recall == pytest.approx((0.5 + 1 + 2 / 3 + 0) / 4)
    assert report["weighted avg"].recall == pytest.approx(4 / 7)


def features(spark, n, seed, corpus="c"):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=n) > 0.8).astype(int)
    out = [(corpus, f"k{i}", f"u{i}", x[i].tolist(), int(y[i])) for i in range(n)]
    return spark.createDataFrame(out, "corpus string, known_author string, unknown_author string, features array<double>, label int"), x, y


def newton_by_hand(x, y):
    """The optimum of the penalised, class-balanced loss, intercept first."""
    n = len(y)
    x = np.hstack([np.ones((n, 1)), x])
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    penalty, w = np.r_[0.0, np.ones(x.shape[1] - 1)], np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ w)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        w = w - 0.5 * np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
    assert np.abs(gradient).max() < 1e-10
    return w


def test_verifiers_are_at_the_optimum(spark, monkeypatch):
    """Many corpora in the same jobs, one of them separable, over many parts, and in several turns."""
    made = [features(spark, n, i, f"c{i}") for i, n in enumerate((300, 40, 900))]
    x = np.r_[np.full((9, 4), -30.0), np.full((9, 4), 30.0)] + np.arange(72).reshape(18, 4)
    y = np.r_[np.zeros(9, int), np.ones(9, int)]
    apart = spark.createDataFrame([("apart", f"k{i}", f"u{i}", x[i].tolist(), int(y[i])) for i in range(18)], made[0][0].schema)
    one_class = made[0][0].where("label = 1").withColumn("corpus", F.lit("flat"))
    df = made[0][0].unionByName(made[1][0]).unionByName(made[2][0]).unionByName(apart).unionByName(one_class).repartition(7)
    want = {f"c{i}": newton_by_hand(m[1], m[2]) for i, m in enumerate(made)} | {"apart": newton_by_hand(x, y)}
    fitted = E.fit_verifier(df)
    for state_bytes, held, group in ((E.STATE_BYTES, 64, 32), (8 * 5 * 2, 1, 2)):
        monkeypatch.setattr(E, "STATE_BYTES", state_bytes)
        monkeypatch.setattr(E, "MODELS_HELD", held)
        monkeypatch.setattr(E, "SUMS_PER_GROUP", group)
        fitted = E.fit_verifier(df)
        got = {r.corpus: np.r_[r.intercept, r.coefficients] for r in fitted.collect()}
        assert set(got) == set(want)
        for corpus, w in want.items():
            assert np.allclose(got[corpus], w, atol=1e-6, rtol=1e-6)
    predicted = E.predict_verifier(fitted, df)
    assert predicted.columns == list(E.PREDICTION_COLUMNS)
    for i, (_, xs, _) in enumerate(made):
        w = want[f"c{i}"]
        side = {f"u{j}": int(z > 0) for j, z in enumerate(w[0] + xs @ w[1:])}
        assert {r.unknown_author: r.predicted for r in predicted.where(f"corpus = 'c{i}'").collect()} == side
    assert predicted.where("correct <> cast(predicted = ground_truth as int) or corpus = 'flat'").count() == 0


def test_no_verifier(spark):
    df = features(spark, 30, 1)[0]
    assert E.fit_verifier(df.where("label = 1")).count() == 0
    assert E.predict_verifier(E.fit_verifier(df.limit(0)), df).count() == 0


def test_all_corpora(spark):
    one, two = features(spark, 80, 3, "one")[0], features(spark, 80, 4, "two")[0]
    train = one.unionByName(two).unionByName(one.where("label = 1").withColumn("corpus", F.lit("flat")))
    test = one.unionByName(one.withColumn("corpus", F.lit("flat")))
    predictions, skipped = E.verify_all_corpora(train, test, ["one", "two", "flat", "none"])
    assert {r.corpus for r in predictions.collect()} == {"one"} and predictions.count() == 80
    assert set(skipped) == {"two", "flat", "none"}
    assert E.verify_all_corpora(train, test, ["none"])[0] is None


def test_problems(spark):
    texts = spark.createDataFrame([("c", "x", "known"), ("c", "y", "unknown"), ("d", "x", "unknown"), ("c", "x", "unknown")], "corpus string, author string, texttype string")
    problems = spark.createDataFrame([("c", "x", "y"), ("c", "x", "x"), ("c", "y", "x"), ("d", "x", "x"), ("c", "x", "y")], "corpus string, known_author string, unknown_author string")
    known, unknown = E.split_texttype(texts)
    assert rows(E.match_problems(problems, known, unknown)) == [("c", "x", "x"), ("c", "x", "y"), ("c", "x", "y")]
    assert rows(E.match_diagnostics(problems, known, unknown)) == [("c", 4, 3, 1), ("d", 1, 0, 1)]
