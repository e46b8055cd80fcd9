"""Corpus-wide counts, frequency ranks, thresholds and masking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penstroke.functions import arrays as A
from penstroke.functions import text as X
from penstroke.operators.chunking import MASK, PROTECTED_TOKENS, SLOTS, id_to_token, token_slots
from penstroke.operators.distributed import global_rank, salted_join
from penstroke.staging import stage

PROTECTED_RANK = -1
CHUNK_KEY = ("source", "author", "doc_id", "chunk_idx")
HEAD_RANKS = 20_000
"""Ranks of the most frequent words that are broadcast; a word past them is too rare to be a hot join key."""

TABLE_BYTES, ENTRY_BYTES = 64 << 20, 32
"""Bytes of a rank table that every task may hold, and what an entry takes besides its word."""


def spelled_tokens(vocab: DataFrame) -> DataFrame:
    """One row: every token as ``chunk_words`` reads it, plain and with the mark of a word's start."""
    return id_to_token(vocab).select(F.flatten(F.transform("tokens", lambda t: F.array(t, F.concat(F.lit("\x00"), t)))).alias("spelled"))


def has_white_space(vocab: DataFrame) -> DataFrame:
    """One row: whether any token holds white space."""
    return vocab.agg(F.coalesce(F.bool_or(F.col("token").rlike(f"[{A.WHITE_SPACE}]")), F.lit(False)).alias("blanks"))


def detokenize_words(chunks: DataFrame, vocab: DataFrame, keep: Sequence[str] = CHUNK_KEY) -> DataFrame:
    """The lower-cased words of every chunk as the array ``words``, indexed by chunk-local word id. Chunks that
    ``store_words`` has stored have them already."""
    if "words" in chunks.columns:
        return chunks.select(*keep, "words")
    read = {"_tokens": spelled_tokens(vocab).scalar(), "_blanks": has_white_space(vocab).scalar()}
    with_tokens = chunks.select(*dict.fromkeys([*keep, "input_ids", "word_ids"])).withColumns(read)
    return with_tokens.select(*keep, A.chunk_words("input_ids", "word_ids", F.col("_tokens"), F.col("_blanks")).alias("words"))


def store_words(chunks: DataFrame, vocab: DataFrame) -> DataFrame:
    """Chunks stored with their ``words``, for jobs that count them and rank them: each chunk is spelled once."""
    return stage(detokenize_words(chunks, vocab, chunks.columns), "chunk-words")


def word_runs(chunks: DataFrame, vocab: DataFrame, keep: Sequence[str] = CHUNK_KEY) -> DataFrame:
    """One row per word of every chunk: ``word_id`` and ``word``. A word cut by a chunk edge is two fragments."""
    # The outer form keeps the optimizer from pushing a filter on the array below the step that makes the array.
    listed = detokenize_words(chunks, vocab, keep).select(*keep, F.posexplode_outer("words").alias("word_id", "word"))
    return listed.where(F.col("word").isNotNull())


def count_words(chunks: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(key, n)`` over the words that have a letter.

    All words are counted and stored, so the pattern of letters is matched once per distinct word.
    """
    listed = detokenize_words(chunks, vocab, ()).select(F.explode_outer("words").alias("key"))
    return stage(listed.groupBy("key").agg(F.count("*").alias("n")), "all-words").where(X.is_countable_word("key"))


def countable_tokens(vocab: DataFrame) -> DataFrame:
    """Tokens that have a letter and are not protected; the placeholders ``<u>`` and ``<h>`` count."""
    return vocab.where(X.is_countable_word("token") & ~F.col("token").isin(*PROTECTED_TOKENS))


def count_tokens(chunks: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(key, n)`` over countable token ids; the histogram is made first, so the join sees one row per id."""
    histogram = chunks.select(F.explode_outer("input_ids").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    countable = countable_tokens(vocab).select(F.col("id").alias("key"))
    return histogram.join(countable, "key", "left_semi")


def rank_map(counts: DataFrame, key: str = "key", n: str = "n") -> DataFrame:
    """Add ``rank`` from 0 by falling count, equal counts by key."""
    return global_rank(counts, [F.desc(n), F.asc(key)], "rank")


def rank_map_top_k(counts: DataFrame, k: int, key: str = "key", n: str = "n") -> DataFrame:
    """The first ``k`` of ``rank_map``: everything past a masking threshold equals out of vocabulary."""
    return rank_map(counts.orderBy(F.desc(n), F.asc(key)).limit(k), key, n)


def out_of_vocabulary_rank(ranks: DataFrame) -> Column:
    """The rank of words without one: the size of the map."""
    return ranks.agg(F.count("*").cast("int")).scalar()


def relative_frequency(counts: DataFrame) -> DataFrame:
    """Add ``freq``, the share of all occurrences."""
    return counts.withColumn("freq", F.col("n") / counts.agg(F.sum("n")).scalar())


def threshold_top_k(counts: DataFrame, k: float) -> DataFrame:
    """One row ``threshold``: ``k`` itself, whatever the counts, which are not read."""
    return counts.sparkSession.range(1).select(F.lit(int(k)).alias("threshold"))


def threshold_percentile(counts: DataFrame, share: float) -> DataFrame:
    """One row ``threshold``: the rank up to which lies this share of the types."""
    if not 0.0 <= share <= 1.0:
        raise ValueError("the share of types must lie between 0 and 1")
    kept = F.floor(F.count("*").cast("double") * F.lit(float(share)))
    return counts.agg(kept.cast("int").alias("threshold"))


def threshold_relative_frequency(counts: DataFrame, frequency: float) -> DataFrame:
    """One row ``threshold``: how many types have at least this relative frequency."""
    frequent = F.count_if(F.col("freq") >= F.lit(float(frequency)))
    return relative_frequency(counts).agg(frequent.cast("int").alias("threshold"))


def masking_threshold(counts: DataFrame, strategy: str, value: float) -> DataFrame:
    """One row ``threshold`` by the named strategy."""
    strategies = {
        "top_k": threshold_top_k,
        "percentile": threshold_percentile,
        "relative_frequency": threshold_relative_frequency,
    }
    if strategy not in strategies:
        raise ValueError(f"no masking strategy {strategy!r}; choose one of {sorted(strategies)}")
    return strategies[strategy](counts, value)


def token_ranks_table(ranks: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(id, token, rank)`` of every token: its rank, else -1 when protected, else out of vocabulary."""
    by_id = ranks.select(F.col("key").cast("int").alias("id"), F.col("rank").cast("int").alias("rank"))
    unranked = F.when(F.col("token").isin(*PROTECTED_TOKENS), PROTECTED_RANK).otherwise(F.col("_oov"))
    counted = vocab.withColumn("_oov", out_of_vocabulary_rank(ranks))
    return counted.join(by_id, "id", "left").select("id", "token", F.coalesce("rank", unranked).alias("rank"))


def rank_lookup_table(ranks: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row ``lookup``: the rank of every token as an array indexed by token id, bounded by the vocabulary."""
    by_id = F.array_sort(F.collect_list(F.struct("id", "rank")))
    return token_ranks_table(ranks, vocab).agg(F.transform(by_id, lambda r: r["rank"]).alias("lookup"))


def attach_token_ranks(chunks: DataFrame, lookup: DataFrame) -> DataFrame:
    """Add ``ranks`` by token id: an array read per token, without explode or shuffle."""
    looked_up = chunks.withColumn("_lookup", lookup.scalar())
    return looked_up.select(*chunks.columns, A.token_ranks("input_ids", F.col("_lookup")).alias("ranks"))


def word_slots(ranks: DataFrame) -> DataFrame:
    """One row ``table``: the ranks as an array of ``SLOTS`` small maps, each word in the map its hash picks."""
    by_word = ranks.select(F.col("key").alias("token"), F.col("rank").cast("int").alias("id"))
    return token_slots(by_word)


def attach_word_ranks(
    chunks: DataFrame, ranks: DataFrame, vocab: DataFrame, head_ranks: int = HEAD_RANKS, table_bytes: int = TABLE_BYTES
) -> DataFrame:
    """Add ``ranks`` by word, written to every token of the word; -1 for words without a letter and special tokens.

    A rank table of up to ``table_bytes`` is looked up in the row itself, without explode, join or shuffle; masking
    needs no ranks past its threshold, so ``rank_map_top_k`` keeps a table as small as that. A larger table is joined.
    """
    n, size = ranks.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key") + ENTRY_BYTES), F.lit(0))).first()
    columns = [c for c in chunks.columns if c != "words"]
    words = detokenize_words(chunks, vocab, columns)
    if size > table_bytes:
        return _join_word_ranks(words, ranks, n, head_ranks)
    held = words.withColumn("_table", word_slots(ranks).scalar())
    unranked = lambda w: F.when(X.is_countable_word(w), F.lit(n)).otherwise(PROTECTED_RANK)
    found = lambda w: F.coalesce(_looked_up(w), unranked(w))
    return held.select(*columns, _written("word_ids", F.transform("words", found)).alias("ranks"))


def _looked_up(word: Column) -> Column:
    """The rank of a word in the row's ``_table``, null for a word that it has not."""
    of_slot = F.get(F.col("_table"), F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int"))
    return F.try_element_at(of_slot, word)


def _written(word_ids: str, by_word: Column) -> Column:
    """The ranks of words at their tokens."""
    at_tokens = lambda ranks: F.transform(word_ids, lambda w: F.when(w < 0, PROTECTED_RANK).otherwise(F.get(ranks, w.cast("int"))))
    return A.with_value(by_word, at_tokens)


def _join_word_ranks(chunks: DataFrame, ranks: DataFrame, n: int, head_ranks: int) -> DataFrame:
    """The ``head_ranks`` most frequent words are looked up in the row. Only the other words that have a letter are listed,
    by the number of their stored chunk, and joined by shuffle: none of them can have more than 1/head_ranks of the tokens,
    and words that still are hot are copied. Those found there come back to their chunks; the others are out of vocabulary.
    """
    columns = [c for c in chunks.columns if c != "words"]
    head = chunks.withColumn("_table", word_slots(ranks.where(F.col("rank") < head_ranks)).scalar())
    known = F.transform("words", lambda w: F.when(X.is_countable_word(w), _looked_up(w)).otherwise(PROTECTED_RANK))
    rare = F.zip_with("words", "_known", lambda w, rank: F.when(rank.isNull(), w))
    numbered = head.select(*columns, "words", known.alias("_known")).select(
        *columns, "_known", rare.alias("_rare"), F.monotonically_increasing_id().alias("_row")
    )
    stored = stage(numbered, "numbered-chunks")
    tail = ranks.where(F.col("rank") >= head_ranks).select(F.col("key").alias("_word"), F.col("rank").cast("int").alias("_rank"))
    listed = stored.select("_row", F.posexplode_outer("_rare").alias("_at", "_word")).where(F.col("_word").isNotNull())
    found = salted_join(listed, tail, ["_word"]).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_rank"))).alias("_found"))
    of_word = lambda rank, at: F.coalesce(rank, F.try_element_at(F.col("_found"), at), F.lit(n))
    joined = stored.drop("_rare").join(found, "_row", "left")
    return joined.select(*columns, _written("word_ids", F.transform("_known", of_word)).alias("ranks"))


def mask_content(chunks: DataFrame, threshold: DataFrame | int, mask_id: int = MASK) -> DataFrame:
    """Replace ``input_ids`` whose rank is at or past the threshold and not protected."""
    limit = F.lit(threshold) if isinstance(threshold, int) else threshold.scalar()
    bounded = chunks.withColumn("_threshold", limit)
    masked = A.content_mask("input_ids", "ranks", F.col("_threshold"), F.lit(mask_id))
    return bounded.withColumn("input_ids", masked).drop("_threshold")
