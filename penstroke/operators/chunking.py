"""Tokens, vocabulary and fixed-length chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penstroke.functions import arrays as A
from penstroke.functions import text as X
from penstroke.operators.distributed import broadcast_by_spark, keep_members, number_rows
from penstroke.staging import stage

# Token ids that are never learned from text.
RESERVED = ("<s>", "<pad>", "</s>", "<unk>", "<mask>", "<u>", "<h>")
BOS, PAD, EOS, UNK, MASK = range(5)
PROTECTED_TOKENS = ("<s>", "<pad>", "</s>", "<unk>")
CHUNK_LENGTH = 512
MIN_CHUNKS = 16
VOCABULARY_SIZE = 50_267
SLOTS = 1 << 16
HOT_TOKENS = 50_000_000
"""Tokens one author may have before its documents are divided into ordered parts."""

PAGE_BREAK_SEPARATOR = (" </s> <s> ", (EOS, BOS))
BLANK_LINES_SEPARATOR = ("\n\n\n", ())

CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("author", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("chunk_idx", T.LongType()),
        T.StructField("input_ids", T.ArrayType(T.IntegerType())),
        T.StructField("word_ids", T.ArrayType(T.ShortType())),
    ]
)


def tokenize(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by ``words``."""
    return docs.withColumn("words", X.words(text)).drop(text)


def piece_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(piece, n)`` over all texts, without the reserved pieces.

    Short pieces have few types, so the partial counts of a task are small and little is shuffled.
    """
    listed = docs.select(F.explode(X.text_pieces(text)).alias("piece"))
    return listed.where(~F.col("piece").isin(*RESERVED)).groupBy("piece").agg(F.count("*").alias("n"))


def build_vocab(counts: DataFrame, size: int = VOCABULARY_SIZE) -> DataFrame:
    """``(id, token)``: the reserved tokens, then the most frequent pieces, equal counts by piece.

    The window runs over at most ``size`` rows, kept by a distributed top-k.
    """
    order = [F.desc("n"), F.asc("piece")]
    frequent = counts.orderBy(*order).limit(size - len(RESERVED))
    learned = frequent.select(
        (F.row_number().over(Window.orderBy(*order)) + (len(RESERVED) - 1)).cast("int").alias("id"),
        F.col("piece").alias("token"),
    )
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("id"), F.lit(t).alias("token")) for i, t in enumerate(RESERVED))))
    reserved = counts.sparkSession.range(1).select(rows.alias("r")).select("r.id", "r.token")
    return reserved.unionByName(learned)


def id_to_token(vocab: DataFrame) -> DataFrame:
    """One row: the tokens as an array indexed by id. Bounded by the vocabulary size."""
    tokens = F.array_sort(F.collect_list(F.struct("id", "token")))
    return vocab.agg(F.transform(tokens, lambda t: t["token"]).alias("tokens"))


def token_slots(vocab: DataFrame) -> DataFrame:
    """One row: the vocabulary as an array of ``SLOTS`` small maps, each token in the map its hash picks.

    Bounded by the vocabulary size. It lets ``encode`` find an id in the row itself, where a join would need one row
    per token and a shuffle to put the documents together again. A single map would be searched from end to end.
    """
    slot = F.pmod(F.xxhash64("token"), F.lit(SLOTS)).cast("int")
    entries = F.map_from_entries(F.collect_list(F.struct("token", "id")))
    listed = vocab.groupBy(slot.alias("slot")).agg(entries.alias("ids"))
    empty = vocab.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot"))
    filled = empty.join(listed, "slot", "left")
    # Maps have no order to sort by, so the array is put in order by its slots alone.
    table = F.array_sort(F.collect_list(F.struct("slot", "ids")), lambda a, b: a["slot"] - b["slot"])
    return filled.agg(F.transform(table, lambda s: s["ids"]).alias("table"))


def encoded(piece_list: Column, table: Column) -> Column:
    """Ids of a list of pieces, ``UNK`` for those not in the vocabulary."""

    def find(piece):
        ids = F.get(table, F.pmod(F.xxhash64(piece), F.lit(SLOTS)).cast("int"))
        return F.coalesce(F.try_element_at(ids, piece), F.lit(UNK))

    return F.transform(piece_list, find)


def encode(docs: DataFrame, vocab: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by ``ids`` and ``word_at`` (index of the word, or ``-index - 1`` for a separator in the text),
    ``n_words`` and ``n_tokens``."""
    kept = [c for c in docs.columns if c != text]
    tokens = docs.select(*kept, X.words(text).alias("words"), X.text_pieces(text).alias("_pieces"))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    cut = tokens.select(*kept, "_pieces", X.piece_words("words").alias("word_at"), size("words").alias("n_words"), size("_pieces").alias("n_tokens"))
    # The table is read once in the next projection, so the optimizer puts the subquery there and no row carries it.
    looked_up = cut.withColumn("_table", token_slots(vocab).scalar())
    return looked_up.select(*kept, encoded(F.col("_pieces"), F.col("_table")).alias("ids"), "word_at", "n_words", "n_tokens")


def number_stored(encoded_docs: DataFrame) -> DataFrame:
    """``encode`` stored with ``_row``, by which ``chunk_packed`` finds a document's tokens again."""
    return stage(encoded_docs.withColumn("_row", F.monotonically_increasing_id()), "encoded")


def encode_with(
    docs: DataFrame, tokenizer: Callable[[], Callable[[list[str]], Sequence[tuple[list[int], list[int]]]]], text: str = "text"
) -> DataFrame:
    """``encode`` with a user's tokenizer.

    ``tokenizer()`` is called once per task and returns a function from a list of texts to pairs
    ``(ids, word_at)`` in the form ``encode`` gives.
    """
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType(
        kept
        + [
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("word_at", T.ArrayType(T.IntegerType())),
            T.StructField("n_words", T.IntegerType()),
            T.StructField("n_tokens", T.IntegerType()),
        ]
    )
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = tokenizer()
        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = iter(split([t for t in texts if t is not None]))
            pairs = [None if t is None else next(found) for t in texts]
            ids = pa.array([p and p[0] for p in pairs], pa.list_(pa.int32()))
            at = pa.array([p and p[1] for p in pairs], pa.list_(pa.int32()))
            n = pa.array([p and 1 + max((w if w >= 0 else -w - 1 for w in p[1]), default=-1) for p in pairs], pa.int32())
            size = pa.array([p and len(p[0]) for p in pairs], pa.int32())
            made = {"ids": ids, "word_at": at, "n_words": n, "n_tokens": size}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made.values()], [*names, *made])

    return docs.select(*names, text).mapInArrow(run, schema)


def _framed(keys: list[str], ids: Column, numbers: Column) -> list[Column | str]:
    """Chunk columns from payload arrays: both ends get their special token."""
    edge = F.array(F.lit(-1).cast("smallint"))
    return [
        *keys,
        F.concat(F.array(F.lit(BOS)), ids, F.array(F.lit(EOS))).alias("input_ids"),
        F.concat(edge, A.local_word_ids(numbers), edge).alias("word_ids"),
    ]


def chunk_documents(encoded_docs: DataFrame, length: int = CHUNK_LENGTH) -> DataFrame:
    """All chunks of every document, the last one as short as it falls; ``n_chunks`` is the document's number.

    An empty document has one chunk without payload, a missing text none.
    """
    payload = length - 2
    encoded_docs = encoded_docs.where(F.col("ids").isNotNull())
    starts = F.sequence(F.lit(0), F.greatest(F.size("ids") - 1, F.lit(0)), F.lit(payload))
    pieces = F.transform(
        starts,
        lambda s: F.struct(F.slice("ids", s + 1, payload).alias("ids"), F.slice("word_at", s + 1, payload).alias("at")),
    )
    n_chunks = F.size(starts).cast("bigint")
    exploded = encoded_docs.select("author", "doc_id", "source", n_chunks.alias("n_chunks"), F.posexplode(pieces).alias("i", "p"))
    keys = ["author", "doc_id", "source", F.col("i").cast("bigint").alias("chunk_idx"), "n_chunks"]
    return exploded.select(*_framed(keys, F.col("p.ids"), F.col("p.at").cast("array<bigint>")))


def chunk_tokens(encoded_docs: DataFrame, length: int = CHUNK_LENGTH) -> DataFrame:
    """Full chunks of single documents."""
    return keep_full_chunks(chunk_documents(encoded_docs, length), length).drop("n_chunks")


def chunk_tokens_keep_tail(encoded_docs: DataFrame, length: int = CHUNK_LENGTH) -> DataFrame:
    """All chunks, the short ones padded, with ``attention_mask``."""
    return pad_chunks(chunk_documents(encoded_docs, length), length).drop("n_chunks")


def pad_chunks(chunks: DataFrame, length: int = CHUNK_LENGTH) -> DataFrame:
    """Fill short chunks up to ``length`` and add ``attention_mask``."""
    missing = F.lit(length) - F.size("input_ids")
    filled = {
        "input_ids": F.concat("input_ids", F.array_repeat(F.lit(PAD), missing)),
        "word_ids": F.concat("word_ids", F.array_repeat(F.lit(-1).cast("smallint"), missing)),
    }
    return chunks.withColumns(filled).withColumn("attention_mask", A.attention_mask("input_ids", PAD))


def keep_full_chunks(chunks: DataFrame, length: int = CHUNK_LENGTH) -> DataFrame:
    return chunks.where(F.size("input_ids") == length)


def drop_edge_chunks(chunks: DataFrame, sources: Sequence[str] | None = None) -> DataFrame:
    """Without the first and last chunk of every document (of ``sources``, when given).

    Edges are judged by ``n_chunks`` of the whole document, so a short tail counts as its last chunk.
    """
    inner = (F.col("chunk_idx") > 0) & (F.col("chunk_idx") < F.col("n_chunks") - 1)
    return chunks.where(inner if sources is None else ~F.col("source").isin(*sources) | inner)


def cut_stream(rows: DataFrame, keys: Sequence[str], start: Column, size: Column, width: int) -> DataFrame:
    """Explode every row into the fixed-width cells of its key's stream that it touches.

    A row covers ``size`` positions of the stream from ``start``. Each output row has ``cell``, ``from_`` (0-based
    position in the row) and ``take`` (how many positions). A cell is a bounded group even when its key is not.
    """
    placed = rows.withColumns({"_start": start.cast("bigint"), "_size": size.cast("bigint")})
    last = F.col("_start") + F.greatest(F.col("_size"), F.lit(1)) - 1
    first_cell, last_cell = (F.floor(F.col("_start") / width), F.floor(last / width))
    cells = placed.withColumn("cell", F.explode(F.sequence(first_cell.cast("bigint"), last_cell.cast("bigint"))))
    from_ = F.greatest(F.col("cell") * width - F.col("_start"), F.lit(0))
    until = F.least((F.col("cell") + 1) * width - F.col("_start"), F.col("_size"))
    return cells.withColumns({"from_": from_.cast("int"), "take": (until - from_).cast("int")})


def packed_chunk_counts(
    encoded_docs: DataFrame,
    separator: Sequence[int] | str = PAGE_BREAK_SEPARATOR[1],
    length: int = CHUNK_LENGTH,
    keys: Sequence[str] = ("source", "author"),
) -> DataFrame:
    """``n_chunks`` of every author as ``chunk_packed`` will cut them, from token counts alone."""
    gaps = F.size(_separator(separator))
    with_text = encoded_docs.where(F.col("n_tokens").isNotNull())
    sums = with_text.groupBy(*keys).agg(F.sum("n_tokens").alias("_n"), F.sum(gaps).alias("_gaps"), F.max(gaps).alias("_gap"))
    filled = F.col("_n") + F.col("_gaps") - F.col("_gap")
    return sums.select(*keys, F.floor(filled / (length - 2)).alias("n_chunks"))


def inner_chunk_counts(
    encoded_docs: DataFrame, length: int = CHUNK_LENGTH, keys: Sequence[str] = ("source", "author")
) -> DataFrame:
    """``n_chunks`` of every author after ``drop_edge_chunks``, from token counts alone."""
    of_doc = F.greatest(F.ceil(F.coalesce("n_tokens", F.lit(0)) / (length - 2)) - 2, F.lit(0))
    return encoded_docs.groupBy(*keys).agg(F.sum(of_doc).alias("n_chunks"))


def _separator(separator: Sequence[int] | str) -> Column:
    if isinstance(separator, str):
        return F.col(separator)
    return F.array(*(F.lit(i) for i in separator)).cast("array<int>")


def join_places(tokens: DataFrame, places: DataFrame) -> DataFrame:
    """Every document's tokens with its place. Places too many to broadcast are hashed: the tokens are moved once, never sorted."""
    return tokens.join(places if broadcast_by_spark(places) else places.hint("shuffle_hash"), "_row")


def chunk_packed(
    encoded_docs: DataFrame,
    separator: Sequence[int] | str = PAGE_BREAK_SEPARATOR[1],
    length: int = CHUNK_LENGTH,
    keys: Sequence[str] = ("source", "author"),
    order: str | None = None,
    seed: str = "42",
    keep_tail: bool = False,
    hot_tokens: int = HOT_TOKENS,
) -> DataFrame:
    """Chunks of the packed texts of every author, without ever building a packed text.

    A document's place in its author's token stream is a running total over the author's documents; from there it is
    cut straight into the chunks it touches. A chunk that lies in one document is made in the document's row; only what a
    document has of its first and last chunk is shuffled, by the chunk, so a prolific author spreads over tasks.
    ``separator`` holds the token ids between documents, or names a column with them, constant for every key.
    Documents follow each other by ``order`` (a numeric column; default a seeded digest of ``doc_id``). Documents
    without text (null ``ids``) are skipped. ``doc_id`` becomes ``packed_`` and the author's smallest document id.

    Only sizes are put in order. The tokens wait in the stored rows and meet their places by ``_row``, in no order and with no
    group by author; ``encoded_docs`` is stored first unless ``number_stored`` did.
    """
    keys, payload = list(keys), length - 2
    stored = encoded_docs if "_row" in encoded_docs.columns else number_stored(encoded_docs)
    sizes = {"_gap": F.size(_separator(separator)), "_texts": F.col("ids").isNotNull().cast("int"), "_n": F.coalesce("n_tokens", F.lit(0))}
    ordered = [] if order is None else [order]
    docs = stored.select(*dict.fromkeys([*keys, "doc_id", "_row", "n_words", *ordered]), *(size.alias(c) for c, size in sizes.items()))
    if order is None:
        docs = docs.withColumn("_digest", X.seeded_digest("doc_id", seed=seed))
        docs = docs.withColumn("_order", X.digest_number("_digest"))
        order, ties = "_order", ["_digest", "doc_id"]
    else:
        ties = ["doc_id"]
    totals = {"_tokens_before": "_n", "_words_before": "n_words", "_texts_before": "_texts"}
    rows = number_rows(docs, keys, order, ties, "_rn", totals, {"_first_id": "doc_id"}, hot_rows=hot_tokens, weight="_n")
    follows = F.col("_texts_before") > 0
    at = F.col("_tokens_before") + F.col("_gap") * F.greatest(F.col("_texts_before") - 1, F.lit(0))
    touched = (F.col("_texts") == 1) & ((F.col("_gap") + F.col("_n") > 0) | ~follows)
    places = stage(rows.where(touched).select("_row", "_first_id", "_texts_before", "_words_before", at.alias("_at")), "places")
    tokens = stored.select(*keys, "_row", "ids", "word_at", _separator(separator).alias("_separator"))
    no_word = F.array_repeat(F.lit(None).cast("int"), F.size("_separator"))
    placed = join_places(tokens, places).select(
        *keys,
        "_first_id",
        "_texts_before",
        "_words_before",
        F.when(follows, F.concat("_separator", "ids")).otherwise(F.col("ids")).alias("ids"),
        F.when(follows, F.concat(no_word, "word_at")).otherwise(F.col("word_at")).alias("word_at"),
        "_at",
    )
    placed = stage(placed, "placed-documents")
    cells = cut_stream(placed, keys, F.col("_at"), F.size("ids"), payload)
    cut = lambda c: F.slice(c, F.col("from_") + 1, F.col("take"))
    named = [*keys, F.concat(F.lit("packed_"), "_first_id").alias("doc_id"), F.col("cell").alias("chunk_idx")]
    whole = cells.where(F.col("take") == payload).select(*named, cut("ids").alias("ids"), cut("word_at").alias("numbers"))
    before = F.col("_words_before")
    shifted = F.transform(cut("word_at"), lambda w: F.when(w < 0, w - before).otherwise(w + before))
    fragment = F.struct("_at", "_texts_before", cut("ids").alias("ids"), shifted.alias("numbers"))
    gathered = (
        cells.where(F.col("take") < payload)
        .select(*keys, "cell", "_first_id", fragment.alias("fragment"))
        .groupBy(*keys, "cell")
        .agg(F.array_sort(F.collect_list("fragment")).alias("fragments"), F.min("_first_id").alias("_first_id"))
        .select(*named, F.flatten("fragments.ids").alias("ids"), F.flatten("fragments.numbers").alias("numbers"))
    )
    if not keep_tail:
        gathered = gathered.where(F.size("ids") == payload)
    others = [k for k in keys if k not in ("author", "source")]
    have = [c for c in ("author", "doc_id", "source") if c in gathered.columns]
    columns = [*others, *have, "chunk_idx"]
    return whole.select(*_framed(columns, F.col("ids"), F.col("numbers"))).unionByName(gathered.select(*_framed(columns, F.col("ids"), F.col("numbers"))))


def author_chunk_counts(chunks: DataFrame, keys: Sequence[str] = ("author",)) -> DataFrame:
    return chunks.groupBy(*keys).agg(F.count("*").alias("n_chunks"))


def filter_valid_authors(chunks: DataFrame, n: int = MIN_CHUNKS, keys: Sequence[str] = ("author",)) -> DataFrame:
    """Chunks of authors that have at least ``n``. By name alone unless ``keys`` says otherwise."""
    valid = author_chunk_counts(chunks, keys).where(F.col("n_chunks") >= n)
    return keep_members(chunks, valid, keys)
