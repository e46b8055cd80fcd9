"""Reports of predictions, and authorship verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penstroke.functions import vectors as V
from penstroke.operators.distributed import global_rank, keep_members, salted_join
from penstroke.operators.neighbours import knn1_confusion
from penstroke.staging import stage

MAX_ITERATIONS = 1000
TOLERANCE = 1e-9
"""The largest change of a coefficient, against their size, with which a fit ends."""

STATE_BYTES = 64 << 20
"""Coefficients that are fitted, and sent to all tasks, at a time."""

MODELS_HELD, SUMS_PER_GROUP = 64, 32
"""Models whose sums a task holds before it passes them on, and sums of tasks that are added up at a time."""

PREDICTION_COLUMNS = ("known_author", "unknown_author", "corpus", "ground_truth", "predicted", "correct")


def confusion(predictions: DataFrame, truth: str, pred: str) -> DataFrame:
    return predictions.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def classification_report(predictions: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Per class precision, recall, F1 and support, then accuracy, macro and weighted average.

    A division by zero gives 0; classes are those of the truth and of the prediction. The predictions are read once
    and reduced to a confusion table, which is stored, as each average reads it.
    """
    return confusion_report(confusion(predictions, truth, pred))


def confusion_report(counts: DataFrame) -> DataFrame:
    """``classification_report`` from ``truth``, ``pred`` and ``n``."""
    table = stage(counts, "confusion")
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    sides = F.explode(
        F.array(
            F.struct(F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.alias("hits")),
            F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
        )
    )
    sums = (
        table.select(sides.alias("s"))
        .groupBy(F.col("s.class").alias("class"))
        .agg(*(F.sum(f"s.{c}").alias(c) for c in ("support", "predicted", "hits")))
    )

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    scored = sums.withColumns({"precision": ratio(F.col("hits"), F.col("predicted")), "recall": ratio(F.col("hits"), F.col("support"))})
    both = F.col("precision") + F.col("recall")
    scored = scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both))
    measures = ("precision", "recall", "f1")
    support = F.sum("support")
    per_class = scored.select(F.col("class").cast("string").alias("class"), *measures, "support")
    macro = scored.agg(*(F.avg(m).alias(m) for m in measures), support.alias("support"))
    weighted = scored.agg(*((F.sum(F.col(m) * F.col("support")) / support).alias(m) for m in measures), support.alias("support"))
    hit_share = F.sum("hits") / support
    accuracy = scored.agg(*(hit_share.alias(m) for m in measures), support.alias("support"))
    named = ((accuracy, "accuracy"), (macro, "macro avg"), (weighted, "weighted avg"))
    for rows, name in named:
        per_class = per_class.unionByName(rows.withColumn("class", F.lit(name)))
    return per_class


def knn1_report(embeddings: DataFrame, label: str = "author", **kwargs) -> DataFrame:
    """Report of the folds of ``knn1_leave_one_view`` together."""
    return confusion_report(knn1_confusion(embeddings, label, **kwargs))


def corpus_filter(df: DataFrame, corpus: str) -> DataFrame:
    return df.where(F.col("corpus") == corpus)


def split_texttype(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known and unknown texts."""
    return texts.where(F.col("texttype") == "known"), texts.where(F.col("texttype") == "unknown")


def match_problems(problems: DataFrame, known: DataFrame, unknown: DataFrame, keys: Sequence[str] = ("corpus",)) -> DataFrame:
    """Pairs whose two authors both have text."""
    matched = problems
    for side, texts in (("known_author", known), ("unknown_author", unknown)):
        authors = texts.select(*keys, F.col("author").alias(side))
        matched = keep_members(matched, authors, [*keys, side])
    return matched


def match_diagnostics(problems: DataFrame, known: DataFrame, unknown: DataFrame, keys: Sequence[str] = ("corpus",)) -> DataFrame:
    """Per corpus: ``total``, ``matched`` and ``skipped`` pairs."""
    flagged = problems
    for side, texts, flag in (("known_author", known, "_k"), ("unknown_author", unknown, "_u")):
        authors = texts.select(*keys, F.col("author").alias(side)).distinct().withColumn(flag, F.lit(True))
        flagged = salted_join(flagged, authors, [*keys, side], "left")
    matched = F.count_if(F.col("_k").isNotNull() & F.col("_u").isNotNull())
    return flagged.groupBy(*keys).agg(
        F.count("*").alias("total"), matched.alias("matched"), (F.count("*") - matched).alias("skipped")
    )


def align_centroids(problems: DataFrame, known: DataFrame, unknown: DataFrame, keys: Sequence[str] = ("corpus",)) -> DataFrame:
    """Give every pair the centroids ``known`` and ``unknown`` of its authors; each author was embedded once."""
    aligned = problems
    for side, centroids, name in (("known_author", known, "known"), ("unknown_author", unknown, "unknown")):
        of_author = centroids.select(*keys, F.col("author").alias(side), F.col("centroid").alias(name))
        aligned = salted_join(aligned, of_author, [*keys, side])
    return aligned


def verification_features(
    problems: DataFrame,
    known: DataFrame,
    unknown: DataFrame,
    keys: Sequence[str] = ("corpus",),
    features: Callable[[str, str], Column] = V.siamese_features,
) -> DataFrame:
    """Pairs with ``features`` of their centroids (by default the siamese vector) and ``label``; pairs without both
    centroids drop out."""
    aligned = align_centroids(problems, known, unknown, keys)
    return aligned.withColumns(
        {"features": features("known", "unknown"), "label": V.pair_label("known_author", "unknown_author")}
    ).drop("known", "unknown")


def _partial_sums(coefficients: Mapping[int, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of a task, per model: loss, gradient and Hessian of the weighted log loss at the given coefficients."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            sums = [x.astype("<f8").tobytes() for x in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(sums, pa.binary())], names=["model", "sums"])

        for batch in batches:
            model, y, weight = (batch.column(c).to_numpy() for c in ("model", "label", "weight"))
            flat = batch.column("features").flatten().to_numpy().astype(np.float64)
            x = np.hstack([np.ones((batch.num_rows, 1)), flat.reshape(batch.num_rows, -1)])
            for m in np.unique(model).tolist():
                if m not in coefficients:
                    continue
                at = model == m
                xs, ys, ws = x[at], y[at], weight[at]
                z = xs @ coefficients[m]
                p = 1 / (1 + np.exp(-z))
                loss = (ws * np.logaddexp(0, np.where(ys == 1, -z, z))).sum()
                gradient, hessian = xs.T @ (ws * (p - ys)), (xs * (ws * p * (1 - p))[:, None]).T @ xs
                sums = np.concatenate([[loss], gradient, hessian.ravel()])
                held[m] = held[m] + sums if m in held else sums
                if len(held) > MODELS_HELD:
                    yield flush()
                    held = {}
        if held:
            yield flush()

    return run


def _added_up(frame: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(s, "<f8") for s in frame["sums"].to_pylist())
    return pa.table({"model": frame["model"][:1], "place": frame["place"][:1], "sums": pa.array([total.tobytes()], pa.binary())})


def _newton_step(coefficients: Mapping[int, np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    """The penalised loss of a model at its coefficients, and the step from there to the minimum of its quadratic."""

    def run(frame: pa.Table) -> pa.Table:
        model = frame["model"][0].as_py()
        at = coefficients[model]
        total = sum(np.frombuffer(s, "<f8") for s in frame["sums"].to_pylist())
        penalty = np.r_[0.0, np.ones(len(at) - 1)]
        loss = total[0] + 0.5 * (penalty * at * at).sum()
        gradient = total[1 : len(at) + 1] + penalty * at
        hessian = total[len(at) + 1 :].reshape(len(at), -1) + np.diag(np.where(penalty > 0, penalty, 1e-12))
        step = np.linalg.solve(hessian, gradient)
        return pa.table({"model": [model], "loss": [loss], "step": pa.array([step.tobytes()], pa.binary())})

    return run


def _evaluate(rows: DataFrame, coefficients: Mapping[int, np.ndarray], parts: int) -> dict[int, tuple[float, np.ndarray]]:
    """Loss and Newton step of all models in one job: sums per task, added up in groups of ``SUMS_PER_GROUP``."""
    sums = rows.mapInArrow(_partial_sums(coefficients), "model long, sums binary")
    sums = sums.withColumn("place", F.spark_partition_id().cast("long"))
    while parts > SUMS_PER_GROUP:
        parts = -(-parts // SUMS_PER_GROUP)
        sums = sums.withColumn("place", F.pmod("place", F.lit(parts))).groupBy("model", "place")
        sums = sums.applyInArrow(_added_up, "model long, place long, sums binary")
    found = sums.groupBy("model").applyInArrow(_newton_step(coefficients), "model long, loss double, step binary")
    return {r["model"]: (r["loss"], np.frombuffer(r["step"], "<f8")) for r in found.collect()}


def fit_verifier(
    features: DataFrame, max_iter: int = MAX_ITERATIONS, keys: Sequence[str] = ("corpus",), tolerance: float = TOLERANCE
) -> DataFrame:
    """One logistic regression per corpus, with an L2 penalty at C = 1 and balanced class weights n / (2 * n_class).

    Result, stored: ``keys``, ``intercept``, ``coefficients``, ``iterations``. A corpus whose pairs are of one class has none.

    All corpora are fitted together by Newton's method: a job adds up gradient and Hessian of every corpus from the
    rows, on the map side first, and solves for the steps; a step that does not lower the loss is halved. The driver
    holds the coefficients alone; corpora whose coefficients would pass ``STATE_BYTES`` are fitted in several turns.
    """
    keys, spark = list(keys), features.sparkSession
    sizes = features.groupBy(*keys).agg(F.count_if(F.col("label") == 1).alias("_1"), F.count_if(F.col("label") != 1).alias("_0"))
    both = sizes.where((F.col("_0") > 0) & (F.col("_1") > 0))
    models = stage(global_rank(both, keys, "model"), "models")
    n = F.col("_0") + F.col("_1")
    weight = F.when(F.col("label") == 1, n / (2 * F.col("_1"))).otherwise(n / (2 * F.col("_0")))
    wanted = salted_join(features.select(*keys, "label", "features"), models, keys)
    rows = wanted.select("model", (F.col("label") == 1).cast("double").alias("label"), weight.alias("weight"), F.col("features").cast("array<double>").alias("features"))
    rows = stage(rows, "verifier-rows")
    width = 1 + (rows.agg(F.max(F.size("features"))).first()[0] or 0)
    in_turn, n_models = max(1, STATE_BYTES // (8 * width)), models.count()
    out = None
    for first in range(0, max(1, n_models), in_turn):
        last = min(first + in_turn, n_models)
        of_turn = rows if last - first == n_models else rows.where(F.col("model").between(first, last - 1))
        fitted = _newton(of_turn, range(first, last), width, max_iter, tolerance)
        frame = [(m, float(w[0]), [float(v) for v in w[1:]], i) for m, (w, i) in fitted.items()]
        found = stage(spark.createDataFrame(frame, "model long, intercept double, coefficients array<double>, iterations int"), "coefficients")
        out = found if out is None else out.unionByName(found)
    return models.join(out, "model").select(*keys, "intercept", "coefficients", "iterations")


def _newton(rows: DataFrame, models: range, width: int, max_iter: int, tolerance: float) -> dict[int, tuple[np.ndarray, int]]:
    """Coefficients of the models, the intercept first, and how many evaluations each took."""
    at = {m: np.zeros(width) for m in models}
    base, done = {}, {}
    parts = rows.rdd.getNumPartitions() if len(models) else 0
    for i in range(1, max_iter + 1):
        if not at:
            break
        for m, (loss, step) in _evaluate(rows, at, parts).items():
            before = base.get(m)
            if before is not None and loss > before[1] + 1e-12 * abs(before[1]):
                # The step went too far: half of it from where it started.
                base[m] = (before[0], before[1], before[2] / 2)
            else:
                base[m] = (at[m], loss, step)
            start, _, taken = base[m]
            at[m] = start - taken
            if np.abs(taken).max() <= tolerance * (1 + np.abs(start).max()):
                done[m] = (at.pop(m), i)
    return done | {m: (w, max_iter) for m, w in at.items()}


def predict_verifier(models: DataFrame, features: DataFrame, keys: Sequence[str] = ("corpus",)) -> DataFrame:
    """``known_author, unknown_author, corpus, ground_truth, predicted, correct`` of the pairs whose corpus has a model."""
    joined = salted_join(features, models.select(*keys, "intercept", "coefficients"), list(keys))
    side = F.col("intercept") + V.dot("features", "coefficients")
    scored = joined.withColumnRenamed("label", "ground_truth").withColumn("predicted", (side > 0).cast("int"))
    return scored.withColumn("correct", (F.col("predicted") == F.col("ground_truth")).cast("int")).select(*PREDICTION_COLUMNS)


def union_predictions(predictions: Sequence[DataFrame]) -> DataFrame:
    first, *others = predictions
    for other in others:
        first = first.unionByName(other)
    return first


def verify_all_corpora(
    train: DataFrame, test: DataFrame, corpora: Sequence[str]
) -> tuple[DataFrame | None, Mapping[str, str]]:
    """Fit and predict per corpus; returns all predictions, and why a corpus was skipped.

    ``train`` and ``test`` come from ``verification_features`` and should be stored. Which of the named corpora can be
    fitted comes from one aggregate per table. All of them are fitted in the same jobs.
    """
    named = F.col("corpus").isin(*corpora)
    classes = train.where(named).groupBy("corpus").agg(F.count_distinct("label").alias("n"))
    train_classes = {r["corpus"]: r["n"] for r in classes.collect()}  # at most one row per named corpus
    tested = {r["corpus"] for r in test.where(named).select("corpus").distinct().collect()}
    skipped, fitted = {}, []
    for corpus in corpora:
        if corpus not in train_classes:
            skipped[corpus] = "no training pair has text on both sides"
        elif corpus not in tested:
            skipped[corpus] = "no test pair has text on both sides"
        elif train_classes[corpus] < 2:
            skipped[corpus] = "training pairs are of one class only"
        else:
            fitted.append(corpus)
    if not fitted:
        return None, skipped
    of_fitted = F.col("corpus").isin(*fitted)
    return predict_verifier(fit_verifier(train.where(of_fitted)), test.where(of_fitted)), skipped
