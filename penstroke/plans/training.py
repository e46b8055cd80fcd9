"""From raw corpora to chunks, ranks and masked batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.functions import text as X
from penstroke.operators import batches as B
from penstroke.operators import chunking as C
from penstroke.operators import corpus as D
from penstroke.operators import ranks as R
from penstroke.operators import sampling as S
from penstroke.operators.distributed import HOT_ROWS, keep_members, salted_join
from penstroke.sources import writers as O
from penstroke.staging import stage

KEYS = ("source", "author")


@dataclass(frozen=True)
class CorpusSettings:
    """How one corpus is prepared.

    ``pack``: join the texts of an author; otherwise documents stay apart and lose their first and last chunk.
    ``texts_per_author``: sample this many texts of an author. ``social``: hide addresses and mentions.
    """

    pack: bool = True
    separator_ids: Sequence[int] = C.PAGE_BREAK_SEPARATOR[1]
    texts_per_author: int | None = None
    social: bool = False
    sentinels: Sequence[str] = ("[deleted]", "None", "nan")


def prepare_texts(
    docs: DataFrame, settings: Mapping[str, CorpusSettings], seed: str = "42", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Documents of the named corpora, filtered, sampled, trimmed and cleaned, each corpus in its own way."""
    source = F.col("source")
    kept = docs.where(source.isin(*settings))
    for name, how in settings.items():
        kept = kept.where((source != name) | ~X.is_sentinel_author("author", how.sentinels))
    limits = {name: how.texts_per_author for name, how in settings.items() if how.texts_per_author is not None}
    if limits:
        sampled = S.sample_per_author(kept.where(source.isin(*limits)), max(limits.values()), seed, KEYS, hot_rows)
        for name, k in limits.items():
            sampled = sampled.where((source != name) | (F.col("rn") <= k))
        kept = kept.where(~source.isin(*limits)).unionByName(sampled.drop("rn"))
    social = [name for name, how in settings.items() if how.social]
    text = F.trim("text")
    cleaned = F.when(source.isin(*social), X.clean_social_text(text)).otherwise(text) if social else text
    return kept.withColumn("text", cleaned)


def chunk_corpora(
    docs: DataFrame,
    settings: Mapping[str, CorpusSettings],
    vocab: DataFrame,
    length: int = C.CHUNK_LENGTH,
    min_chunks: int = C.MIN_CHUNKS,
    unify: bool = True,
    seed: str = "42",
    hot_rows: int = HOT_ROWS,
    hot_tokens: int = C.HOT_TOKENS,
) -> DataFrame:
    """Full chunks of the authors that have at least ``min_chunks``, over all corpora.

    ``unify`` counts an author's chunks over all corpora, otherwise in each apart. Texts are tokenized once, into a
    stored table. How many chunks an author will have follows from its token counts, so the authors are chosen before
    any token is shuffled, and texts of the many authors with little text never are.
    """
    encoded = C.number_stored(C.encode(prepare_texts(docs, settings, seed, hot_rows), vocab))
    packed = [name for name, how in settings.items() if how.pack]
    between = F.array().cast("array<int>")
    for name in packed:
        ids = F.array(*(F.lit(i) for i in settings[name].separator_ids)).cast("array<int>")
        between = F.when(F.col("source") == name, ids).otherwise(between)
    to_pack = encoded.where(F.col("source").isin(*packed)).withColumn("between", between)
    apart = encoded.where(~F.col("source").isin(*packed))

    counts = C.packed_chunk_counts(to_pack, "between", length).unionByName(C.inner_chunk_counts(apart, length))
    keys = ("author",) if unify else KEYS
    valid = counts.groupBy(*keys).agg(F.sum("n_chunks").alias("n")).where(F.col("n") >= min_chunks)
    valid = stage(valid, "valid-authors")

    chunks = C.chunk_packed(keep_members(to_pack, valid, keys), "between", length, seed=seed, hot_tokens=hot_tokens)
    inner = C.drop_edge_chunks(C.chunk_documents(keep_members(apart, valid, keys), length))
    parts = (chunks, C.keep_full_chunks(inner, length))
    return D.union_corpora([part.select(*C.CHUNK_SCHEMA.names) for part in parts])


def masked_training_chunks(
    split_chunks: DataFrame, vocab: DataFrame, strategy: str = "percentile", value: float = 0.70, unit: str = "token"
) -> DataFrame:
    """Split chunks with ranks counted on the training part, content masked by the threshold.

    ``unit`` is what is counted and ranked: ``token`` or ``word``. Ranks past the threshold all mean masked, so of the words
    only those before it are kept. ``split_chunks`` should be a stored table: it is read for the counts and for the
    result.
    """
    split_chunks = R.store_words(split_chunks, vocab) if unit == "word" else split_chunks
    train = split_chunks.where(F.col("split") == "train")
    if unit == "word":
        counts = stage(R.count_words(train, vocab), "word-counts")
        threshold = R.masking_threshold(counts, strategy, value).first()["threshold"]
        ranked = R.attach_word_ranks(split_chunks, stage(R.rank_map_top_k(counts, threshold), "word-ranks"), vocab)
        return R.mask_content(ranked, threshold)
    counts = stage(R.count_tokens(train, vocab), "token-counts")
    ranks = R.rank_map(counts)
    ranked = R.attach_token_ranks(split_chunks, R.rank_lookup_table(ranks, vocab))
    return R.mask_content(ranked, R.masking_threshold(counts, strategy, value))


def training_members(chunks: DataFrame, n_views: int, world: int) -> DataFrame:
    """``author, source, label, shard`` of the authors with enough chunks for a visit, stored."""
    enough = C.filter_valid_authors(chunks.select("author", "source", "doc_id", "chunk_idx"), n_views)
    return stage(B.shard_authors(B.label_encode(B.first_source_of_author(enough)), world), "members")


def write_training_batches(
    members: DataFrame, chunks: DataFrame, path: str, epochs: Sequence[int], slots: int, n_views: int, seed: str = "42", **masking
) -> None:
    """The trainer's input of several epochs, as folders by epoch and shard; a file holds whole batches in their order.

    A trainer process reads the folder of its shard alone, with ``read_training_batches``.
    """
    of_epochs = D.union_corpora([B.balanced_batches(members, slots, epoch, seed) for epoch in epochs])
    batches = stage(B.shuffle_batch(of_epochs, seed), "batches")
    rows = B.collate_batches(batches, chunks, n_views, seed=seed, **masking)
    order = ["epoch", "shard", "batch_id", "position", "view"]
    O.write_parquet(rows.repartitionByRange(*order[:3]).sortWithinPartitions(*order), path, ["epoch", "shard"])


def read_training_batches(spark: SparkSession, path: str, epoch: int, shard: int) -> DataFrame:
    """The batches of one shard in one epoch; no other folder is read."""
    return spark.read.parquet(path).where((F.col("epoch") == epoch) & (F.col("shard") == shard))


def validation_batches(
    chunks: DataFrame, n_views: int, batch_size: int, seed: str = "42", threshold: DataFrame | int | None = None
) -> DataFrame:
    """The validation input: every author with its fixed views, in the order of authors, masked when there is a threshold.

    ``batch_id`` and ``position`` follow from ``label``, the author's place; the last batch may be smaller.
    """
    keys = ["author", "source", "doc_id", "chunk_idx"]
    views = stage(S.fixed_val_views(C.filter_valid_authors(chunks.select(*keys), n_views), n_views, seed), "views")
    labelled = salted_join(views, B.label_encode(views.select("author").distinct()), ["author"])
    if threshold is not None:
        chunks = R.mask_content(chunks, threshold)
    placed = labelled.withColumns({"batch_id": F.floor(F.col("label") / batch_size), "position": F.col("label") % batch_size})
    return placed.join(chunks.select(*keys, "input_ids"), keys)


def masked_share(masked: DataFrame) -> DataFrame:
    """Per split and corpus: chunks, authors, tokens, masked tokens and their share."""
    n_masked = F.size(F.filter("input_ids", lambda t: t == C.MASK))
    sums = masked.groupBy("split", "source").agg(
        F.count("*").alias("n_chunks"),
        F.count_distinct("author").alias("n_authors"),
        F.sum(F.size("input_ids")).alias("n_tokens"),
        F.sum(n_masked).alias("n_masked"),
    )
    return sums.withColumn("masked_share", F.round(F.col("n_masked") / F.col("n_tokens"), 6))
