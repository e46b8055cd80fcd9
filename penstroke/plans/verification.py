"""From verification corpora and problems to predictions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.functions import vectors as V
from penstroke.operators import chunking as C
from penstroke.operators import corpus as D
from penstroke.operators import embeddings as M
from penstroke.operators import evaluation as E
from penstroke.operators import ranks as R
from penstroke.operators.distributed import keep_members
from penstroke.sources.readers import read_verification_tables
from penstroke.staging import stage

TEXT_KEYS = ("source", "author")


def concat_author_texts(
    texts: DataFrame, order: str = "pos", part_chars: int = D.PART_CHARS, hot_chars: int = D.HOT_CHARS, keys: Sequence[str] = TEXT_KEYS
) -> DataFrame:
    """Texts of an author as they are, joined by one blank in row order, in bounded parts; missing texts are skipped."""
    return D.pack_authors(texts, " ", keys, order, part_chars=part_chars, hot_chars=hot_chars, trim=False)


def author_vectors(
    texts: DataFrame,
    vocab: DataFrame,
    encoder=M.hashed_bag(),
    lookup: DataFrame | None = None,
    threshold: DataFrame | int | None = None,
    length: int = C.CHUNK_LENGTH,
    order: str = "pos",
    hot_tokens: int = C.HOT_TOKENS,
) -> DataFrame:
    """``(source, author, centroid)``: texts in order, cut to chunks with a short tail, masked, embedded, averaged."""
    encoded = C.number_stored(C.encode(texts, vocab))
    chunks = C.chunk_packed(encoded, (), length, TEXT_KEYS, order, keep_tail=True, hot_tokens=hot_tokens)
    padded = C.pad_chunks(chunks, length)
    keep = [*TEXT_KEYS, "doc_id", "chunk_idx"]
    embedded = M.embed_masked_chunks(padded, encoder, keep, lookup, threshold)
    return M.author_centroids(embedded, TEXT_KEYS)


def verification_split(
    corpus: DataFrame,
    problems: DataFrame,
    vocab: DataFrame,
    order: str = "pos",
    features: Callable[[str, str], Column] = V.siamese_features,
    **kwargs,
) -> DataFrame:
    """Features and labels of the pairs whose two authors have text. Only authors of such pairs are embedded, once.

    ``corpus`` has ``corpus, author, texttype, text, doc_id`` and the row order ``order``. With ``lookup`` and ``threshold``
    among the further arguments, which go to ``author_vectors``, content is masked.
    """
    known, unknown = E.split_texttype(corpus)
    matched = stage(E.match_problems(problems, known, unknown), "matched")
    sides = {}
    for texts, side in ((known, "known_author"), (unknown, "unknown_author")):
        asked = matched.select("corpus", F.col(side).alias("author")).distinct()
        wanted = keep_members(texts, asked, ["corpus", "author"]).withColumnRenamed("corpus", "source")
        sides[side] = author_vectors(wanted, vocab, order=order, **kwargs).withColumnRenamed("source", "corpus")
    return E.verification_features(matched, sides["known_author"], sides["unknown_author"], features=features)


def verify_folder(
    spark: SparkSession,
    folder: str,
    vocab: DataFrame,
    corpora: Sequence[str] | None = None,
    counts: DataFrame | None = None,
    strategy: str = "percentile",
    value: float = 0.70,
    **kwargs,
) -> tuple[DataFrame | None, Mapping[str, str]]:
    """From the four tables of ``read_verification_tables`` to the predictions of all corpora, and why one was skipped.

    ``counts`` are token counts of the training chunks; with them, content is masked by rank before it is embedded.
    Without ``corpora`` all corpora of the training problems are taken. ``write_predictions_csv`` writes the result.
    """
    tables = read_verification_tables(spark, folder)
    if counts is not None:
        kwargs["lookup"] = R.rank_lookup_table(R.rank_map(counts), vocab)
        kwargs["threshold"] = R.masking_threshold(counts, strategy, value)
    splits = [
        stage(verification_split(stage(tables[f"{part}_corpus"]), tables[f"{part}_problems"], vocab, **kwargs), f"{part}-features")
        for part in ("train", "test")
    ]
    if corpora is None:
        corpora = sorted(r["corpus"] for r in tables["train_problems"].select("corpus").dropna().distinct().collect())
    return E.verify_all_corpora(*splits, corpora)
