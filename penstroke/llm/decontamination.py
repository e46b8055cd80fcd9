"""Benchmark passages in documents: a prefix-filtered join of word shingles, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penstroke.staging import stage

WINDOW = 13
SHINGLE = 5
SHARE = 20
"""A document is contaminated if at least one in ``SHARE`` of its words is hit."""

BROADCAST_SHINGLES = 1_000_000
"""Distinct shingles of the benchmark, 8 bytes each, up to which they are sent to every executor."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, small letters and characters beyond ASCII, after lowering A-Z; none for a missing text."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN_WORDS), "")


def _shingles(words_: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order."""
    one = lambda i: F.xxhash64(*(F.get(words_, i + k) for k in range(size)))
    return F.when(F.size(words_) >= size, F.transform(F.sequence(F.lit(0), F.size(words_) - size), one))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``(item_id, window, length)``: ``WINDOW`` words in a row joined by blanks; a shorter item is one window."""
    cut = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    length = F.least(F.size("w"), F.lit(WINDOW))
    each = cut.select("item_id", "w", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("at"))
    return each.select("item_id", F.concat_ws(" ", F.slice("w", F.col("at"), F.col("length"))).alias("window"), "length").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and
    ``text_hash``, which tells rows of one id apart.

    The elements of the join are shingles of five words (all words of a shorter window). One pass over the texts keeps
    the positions whose shingle occurs in the benchmark, each with the words around it; these give the rarity of every
    shingle over all documents. A window occurs only where its rarest shingle does, so that shingle alone is joined.
    The window must lie within the document (length and position) and is compared word by word with the kept words.

    A missing or empty text has no words. Rows with equal id and text are reported each. An item without words is
    never found; a missing item id counts as the empty one. Either table may be empty.
    """
    docs = docs.select(F.col("doc_id"), F.col("text"))
    windows = stage(item_windows(benchmark.select("item_id", "text")), "windows")
    distinct = windows.select("window", "length").distinct()
    sizes = sorted({SHINGLE, *(r[0] for r in distinct.select(F.least("length", F.lit(SHINGLE))).distinct().collect())}, reverse=True)
    parts = []
    for size in sizes:
        of_size = distinct.where(F.least("length", F.lit(SHINGLE)) == size).withColumn("w", F.split("window", " "))
        parts.append(of_size.select("window", "length", F.posexplode(_shingles(F.col("w"), size)).alias("offset", "shingle"), F.lit(size).alias("size")))
    elements = parts[0]
    for part in parts[1:]:
        elements = elements.unionByName(part)
    elements = stage(elements, "window-shingles")

    found = [_occurrences(docs, elements.where(F.col("size") == size).select("shingle").distinct(), size, size == SHINGLE) for size in sizes]
    kept = found[0]
    for part in found[1:]:
        kept = kept.unionByName(part)
    kept = stage(kept, "shingle-occurrences")
    rows, hits = kept.where("at < 0").select("doc_id", "text_hash", "n_words"), kept.where("at >= 0")

    rarity = hits.groupBy("size", "shingle").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("window").orderBy("n", "offset")
    prefix = elements.join(rarity, ["size", "shingle"]).withColumn("rank", F.row_number().over(rarest)).where("rank = 1")
    candidates = hits.join(prefix.select("size", "shingle", "window", "length", "offset"), ["size", "shingle"])
    candidates = candidates.withColumn("start", F.col("at") - F.col("offset")).where("start >= 0 and start + length <= n_words")
    same = F.concat_ws(" ", F.slice("around", F.col("start") - F.col("first") + 1, F.col("length"))) == F.col("window")
    key = ["doc_id", "text_hash"]
    occurring = stage(candidates.where(same).select(*key, "start", "length", "window").distinct(), "occurrences")

    covered = occurring.select(*key, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("at")).distinct()
    n_hit = covered.groupBy(*key).agg(F.count("*").alias("n_hit"))
    items = occurring.select(*key, "window").distinct().join(windows.select("window", "item_id"), "window").select(*key, "item_id").distinct()
    listed = items.groupBy(*key).agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    listed = listed.select(*key, F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    per_row = n_hit.join(listed, _same_key(n_hit, listed)).select(n_hit["doc_id"], n_hit["text_hash"], "n_hit", "n_items", "items_sha256")
    out = rows.join(per_row, _same_key(rows, per_row), "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        rows["doc_id"],
        rows["text_hash"],
        F.col("n_words").cast("long").alias("n_words"),
        hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((hit > 0) & (hit * SHARE >= F.col("n_words"))).alias("contaminated"),
    )


def _same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def _occurrences(docs: DataFrame, shingles: DataFrame, size: int, with_rows: bool) -> DataFrame:
    """Where documents hold a shingle of the benchmark: its position ``at`` and the words ``around`` it from word
    ``first`` on, as far as a window that has the shingle may reach. With ``with_rows`` every document also has a row
    ``at = -1``.

    Up to ``BROADCAST_SHINGLES`` hashes are sent to the executors, and the exploded rows never leave their task.
    Beyond, they are shuffled by hash with the words around them, without the documents' own rows.
    """
    cut = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    hashes = F.coalesce(_shingles(F.col("w"), size), F.array().cast("array<long>"))
    # The first element stands for the document itself; it joins with the row added to the other side.
    own = F.lit(0).cast("long")
    listed = cut.select("*", F.size("w").alias("n_words"), F.posexplode(F.concat(F.array(own), hashes)).alias("p", "shingle"))
    listed = listed.withColumn("at", F.col("p") - 1)
    first = F.greatest(F.lit(0), F.col("at") - (WINDOW - size))
    around = F.when(F.col("at") >= 0, F.slice("w", first + 1, F.lit(2 * WINDOW - size)))
    marked = shingles.select("shingle", F.lit(True).alias("real")).unionByName(docs.sparkSession.range(1).select(own.alias("shingle"), F.lit(False).alias("real")))
    marked = marked.groupBy("shingle").agg(F.max("real").alias("real"))
    out = ["doc_id", "text_hash", "n_words", "at", "shingle", F.lit(size).alias("size"), first.alias("first"), around.alias("around")]
    if shingles.count() <= BROADCAST_SHINGLES:
        joined = listed.join(F.broadcast(marked), "shingle")
    else:
        listed = listed.select(*out)
        found = listed.where("at >= 0").join(shingles, "shingle")
        return found.unionByName(listed.where("at < 0"), allowMissingColumns=True) if with_rows else found
    return joined.where((F.col("at") >= 0) & F.col("real") | F.lit(with_rows) & (F.col("at") < 0)).select(*out)
