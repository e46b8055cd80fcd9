"""Batches with equally many authors of every corpus, for an external trainer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penstroke.functions import text as X
from penstroke.functions.arrays import with_value
from penstroke.operators.chunking import MASK
from penstroke.operators.distributed import HOT_ROWS, global_rank, salted_join
from penstroke.operators.ranks import mask_content
from penstroke.operators.sampling import number_by_digest

VIEWS = 16
CONTENT_KEYS = ("source", "author", "doc_id", "chunk_idx")
ROUNDS, MOST_STEPS = 4, 64
"""Rounds of a permutation, and times that a result is sent on; past 1000 ordinals not even a few in a row are needed."""



def first_source_of_author(chunks: DataFrame) -> DataFrame:
    """``(author, source)``: the corpus of an author's first chunk by document and chunk number."""
    first = F.min_by("source", F.struct("doc_id", "chunk_idx", "source"))
    return chunks.groupBy("author").agg(first.alias("source"))


def label_encode(authors: DataFrame) -> DataFrame:
    """Add ``label``, the position of the author in the list of authors."""
    return global_rank(authors, ["author"], "label")


def shard_authors(authors: DataFrame, world: int) -> DataFrame:
    """Add ``shard``, the authors of each corpus, in order, dealt in turn to ``world`` shards, and ``ordinal``, the place from 0
    among those of a corpus in a shard."""
    placed = global_rank(authors, ["author"], "_at", within=["source"])
    dealt = {"shard": F.pmod("_at", F.lit(world)).cast("int"), "ordinal": F.floor(F.col("_at") / world)}
    return placed.withColumns(dealt).drop("_at")


def slots_per_corpus(batch_size: int, world: int, n_corpora: int) -> int:
    """Authors of one corpus in one shard's batch."""
    if batch_size % world:
        raise ValueError(f"batch size {batch_size} is not a multiple of {world} shards")
    if batch_size // world % n_corpora:
        raise ValueError(f"{batch_size // world} authors per shard do not divide over {n_corpora} corpora")
    return batch_size // world // n_corpora


def n_batches(sharded: DataFrame, slots: int) -> DataFrame:
    """``(shard, n_batches)``: as many as the largest corpus of the shard fills."""
    sizes = sharded.groupBy("shard", "source").agg(F.count("*").alias("n"))
    return sizes.groupBy("shard").agg(F.ceil(F.max("n") / slots).alias("n_batches"))


def keyed_permutation(ordinal: Column, n: Column, key: Column) -> Column:
    """Where a permutation of 0 … n - 1, one for every key, sends ``ordinal``: a random order without sorting.

    Four rounds permute the least square that holds n, as pairs of numbers below its side; a result past n - 1 is sent
    on until it lies below n, which makes a permutation of those. Few are past it, and at most as many as the square
    has places over n can follow each other.
    """
    side = F.ceil(F.sqrt(n.cast("double")))

    def turned(b: Column) -> Column:
        def swap(pair: Column, i: Column) -> Column:
            digest = F.md5(F.concat_ws(":", b["key"], i.cast("string"), pair["r"].cast("string")))
            added = F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")
            return F.struct(pair["r"].alias("l"), F.pmod(pair["l"] + added, b["side"]).alias("r"))

        def step(state: Column, _: Column) -> Column:
            pair = F.struct(F.floor(state["at"] / b["side"]).alias("l"), F.pmod(state["at"], b["side"]).alias("r"))
            sent = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), pair, swap, lambda p: p["l"] * b["side"] + p["r"])
            moved = with_value(sent, lambda at: F.struct(at.alias("at"), (at < b["n"]).alias("done")))
            return F.when(state["done"], state).otherwise(moved)

        steps = F.sequence(F.lit(1), F.least(b["side"] * b["side"] - b["n"] + 1, F.lit(MOST_STEPS)).cast("int"))
        start = F.struct(b["at"].alias("at"), F.lit(False).alias("done"))
        lost = F.raise_error(F.lit("no place found for an ordinal")).cast("bigint")
        return F.aggregate(steps, start, step, lambda s: F.when(s["done"], s["at"]).otherwise(lost))

    bound = {"at": ordinal.cast("bigint"), "n": n.cast("bigint"), "side": side.cast("bigint"), "key": key}
    return with_value(F.struct(*(v.alias(k) for k, v in bound.items())), turned)


def balanced_batches(sharded: DataFrame, slots: int, epoch: int = 0, seed: str = "42") -> DataFrame:
    """Batches of one epoch: ``epoch, shard, batch_id, source, author, label, visit, repeated``.

    A corpus with n authors fills floor(n / slots) batches in one pass over a fresh shuffle and drops the remainder;
    it goes through as many passes as the largest corpus needs. Batch and slot follow from an author's place in the
    shuffle of its pass, which is computed from its ``ordinal`` in the row: no pass is sorted or moved. A corpus with
    fewer authors than slots repeats them in turn (``repeated``). ``visit`` counts the uses of an author.
    """
    dense = F.max("ordinal") + 1 == F.count("*")
    gaps = F.raise_error(F.lit("ordinals have gaps: authors are to be chosen before they are sharded")).cast("bigint")
    sizes = sharded.groupBy("shard", "source").agg(F.when(dense, F.count("*")).otherwise(gaps).alias("_n"))
    most = n_batches(sharded, slots).withColumnRenamed("n_batches", "_batches")
    per_pass = F.greatest(F.floor(F.col("_n") / slots), F.lit(1))
    plan = sizes.join(most, "shard").withColumn("_per", per_pass)
    passes = F.sequence(F.lit(0), (F.ceil(F.col("_batches") / F.col("_per")) - 1).cast("int"))
    turns = salted_join(sharded, plan, ["shard", "source"]).withColumn("_pass", F.explode(passes))
    key = F.concat_ws(":", F.lit(seed), F.lit(str(epoch)), *(F.col(c).cast("string") for c in ("shard", "source", "_pass")))
    placed = turns.withColumn("_place", keyed_permutation(F.col("ordinal"), F.col("_n"), key))
    place = F.col("_place")
    in_turn = F.sequence(place, F.lit(slots - 1).cast("bigint"), F.col("_n"))
    seats = F.when(F.col("_n") >= slots, F.array(place)).otherwise(in_turn)
    seated = placed.withColumn("_seat", F.explode(seats)).withColumn("_slot", F.floor(F.col("_seat") / slots))
    batch = F.col("_pass") * F.col("_per") + F.col("_slot")
    again = F.floor(F.col("_seat") / F.col("_n"))
    repeats = F.ceil(F.lit(slots) / F.col("_n"))
    return (
        seated.withColumns({"batch_id": batch, "repeated": again > 0, "visit": F.col("_pass") * repeats + again})
        .where((F.col("_slot") < F.col("_per")) & (F.col("batch_id") < F.col("_batches")))
        .select(
            F.lit(epoch).alias("epoch"), "shard", "batch_id", "source", "author", "label", "visit", "repeated"
        )
    )


def shuffle_batch(batches: DataFrame, seed: str = "42") -> DataFrame:
    """Add ``position``, a seeded random order inside each batch, which is a group of fixed size."""
    digest = X.seeded_digest(F.concat_ws(":", "author", "batch_id", "epoch", "visit"), seed=seed)
    inside = Window.partitionBy("epoch", "shard", "batch_id").orderBy(digest, "author", "visit")
    return batches.withColumn("position", F.row_number().over(inside))


def collate_batches(
    batches: DataFrame,
    chunks: DataFrame,
    n_views: int = VIEWS,
    content_masking: bool = False,
    threshold: DataFrame | int | None = None,
    mask_id: int = MASK,
    seed: str = "42",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The trainer's input: every batch member with ``n_views`` chunks, masked when asked.

    Each epoch puts the chunks of an author in a random order; the v-th visit takes the v-th run of ``n_views``
    places, cyclically. Contents are joined last, on ``CONTENT_KEYS``; chunks stored by these keys stay where they are, and
    only the keys chosen move. A visit never repeats a chunk, and the join key is (author, place), which is unique, so an
    author with very many chunks is no hot key. A member with fewer chunks than views is an error: such authors are to
    be kept out before the batches are made.
    """
    if content_masking and threshold is None:
        raise ValueError("masking needs a threshold")
    if content_masking:
        chunks = mask_content(chunks, threshold, mask_id)
    counts = chunks.groupBy("author").agg(F.count("*").alias("_chunks"))
    short = F.raise_error(F.concat(F.lit("too few chunks for a batch: author "), F.coalesce("author", F.lit("null"))))
    enough = F.when(F.col("_chunks") >= n_views, F.col("_chunks")).otherwise(short.cast("long"))
    place = F.pmod(F.col("visit") * n_views + F.col("view"), enough)
    visits = (
        salted_join(batches, counts, ["author"], "left")
        .withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(n_views - 1))))
        .withColumn("_place", place)
        .drop("_chunks", "source")
    )
    drawn = ["doc_id", "chunk_idx"]
    # An epoch's own order of chunk keys; the contents are joined afterwards.
    drawing = batches.select("author", "epoch").distinct()
    keys = salted_join(chunks.select("author", "source", *drawn), drawing, ["author"])
    order = number_by_digest(keys, ["epoch", "author"], [*drawn, "epoch"], drawn, seed, "_rn", hot_rows=hot_rows)
    order = order.withColumn("_place", F.col("_rn").cast("bigint") - 1).drop("_rn")
    chosen = visits.join(order, ["epoch", "author", "_place"]).drop("_place")
    return chosen.join(chunks.select(*CONTENT_KEYS, "input_ids"), list(CONTENT_KEYS))
