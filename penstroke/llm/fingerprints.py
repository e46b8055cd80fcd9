"""I-Match document fingerprints over randomised lexicons, with built-in functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penstroke.staging import stage

BAND = (0.0005, 0.05)
"""Shares of the documents between which a term's document frequency lies: neither rare nor common."""

SLOTS = 1 << 17
"""Places of the lexicon table; terms that meet in one are listed there together."""

SUBSETS = 32
BLOCK_BYTES, MOST_BLOCKS = 4 << 20, 62_500
"""Text of a range of ids in which documents are put in order, about, and ranges at most; as many numbers as that
are held by the driver and looked up in two steps."""

_EMPTY = "...."


def term_hashes(text: Column) -> Column:
    """Distinct hashes of the runs of letters and digits in small letters."""
    terms = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame, text: str = "text", band: tuple[float, float] = BAND, slots: int = SLOTS) -> DataFrame:
    """One row, one array of arrays: the sorted hashes of all terms in ``band``, each listed at its hash modulo ``slots``.

    Frequencies count all documents. At most (terms per document) / ``band[0]`` terms can lie in the band whatever the
    number of documents, so the table is safe to send to every task. A place without terms is null.
    """
    counted = docs.select(F.explode(term_hashes(F.col(text))).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    total = docs.agg(F.count("*").alias("total"))
    low, high = F.greatest(F.lit(2.0), F.col("total") * band[0]), F.greatest(F.lit(2.0), F.col("total") * band[1])
    in_band = counted.withColumn("total", total.scalar()).where((F.col("n") >= low) & (F.col("n") <= high))
    placed = in_band.groupBy(F.pmod("h", F.lit(slots)).cast("int").alias("slot")).agg(F.array_sort(F.collect_list("h")).alias("hs"))
    places = placed.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    listed = F.array_sort(F.collect_list(F.struct("slot", "hs")))
    return places.join(placed, "slot", "left").agg(F.transform(listed, lambda s: s["hs"]).alias("table"))


def _subset_hashes(chosen: Column) -> Column:
    """The hash of the sorted terms of every subset, 4 hex digits each; a subset without terms has dots.

    A subset is the terms with the same first five bits, so it is a run of the sorted terms: its bounds are where the
    subset of a term differs from that of the one before.
    """
    subset = lambda h: F.shiftrightunsigned(h, 59).cast("int")

    def cut(terms: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(terms) - 1), lambda i: (i == 0) | (subset(F.get(terms, i)) != subset(F.get(terms, i - 1))))
        return _let(F.struct(terms.alias("terms"), F.when(F.size(terms) > 0, starts).otherwise(F.array().cast("array<int>")).alias("starts")), runs)

    def runs(b: Column) -> Column:
        def run(at: Column, i: Column) -> Column:
            end = F.coalesce(F.get(b["starts"], i + 1), F.size(b["terms"]))
            value = F.xxhash64(F.slice(b["terms"], at + 1, end - at)).bitwiseAND(F.lit(65535))
            return F.struct(subset(F.get(b["terms"], at)).alias("k"), F.lpad(F.hex(value), 4, "0").alias("h"))

        return _let(F.transform(b["starts"], run), placed)

    def placed(found: Column) -> Column:
        def add(done: Column, k: Column) -> Column:
            # Runs come with subsets 16 to 31 first, as signed numbers do, and so do the steps.
            here = F.get(found, done["n"])
            hit = here["k"] == k
            return F.struct((done["n"] + F.when(hit, 1).otherwise(0)).alias("n"), F.concat(done["out"], F.when(hit, here["h"]).otherwise(_EMPTY)).alias("out"))

        order = F.concat(F.sequence(F.lit(SUBSETS // 2), F.lit(SUBSETS - 1)), F.sequence(F.lit(0), F.lit(SUBSETS // 2 - 1)))
        start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))
        half = 4 * (SUBSETS // 2)
        return F.aggregate(order, start, add, lambda done: F.concat(F.substr(done["out"], F.lit(half + 1), F.lit(half)), F.substr(done["out"], F.lit(1), F.lit(half))))

    return _let(chosen, cut)


def _fingerprint(kept: str) -> Column:
    """The fingerprint of the sorted terms ``kept`` of a document.

    The lexicon is split at random into ``SUBSETS`` smaller ones, thinned by halves until a document has about one
    term in each: two digits give the number of halvings, then come the hashes at that level and at the next, so that
    two documents of nearly equal size share a level.
    """

    def leveled(b: Column) -> Column:
        held = lambda bits: lambda h: F.shiftrightunsigned(h, 24).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1) == 0
        this = F.filter(b["terms"], held(b["level"]))
        both = lambda t: F.concat(_subset_hashes(t), _subset_hashes(F.filter(t, held(b["level"] + 1))))
        return F.concat(F.lpad(b["level"].cast("string"), 2, "0"), _let(this, both))

    def sized(terms: Column) -> Column:
        halvings = F.when(F.size(terms) > SUBSETS, F.ceil(F.log2(F.size(terms) / SUBSETS))).otherwise(0).cast("int")
        return _let(F.struct(terms.alias("terms"), halvings.alias("level")), leveled)

    return _let(F.col(kept), sized)


def with_fingerprints(rows: DataFrame, shared: str, ends: dict[str, str], table: DataFrame) -> DataFrame:
    """Add a fingerprint per entry ``column: end`` of ``ends``: that of the text ``shared`` followed by ``end``.

    No word may reach over the place where the two meet, so the shared part is cut and looked up once. A document
    without a term in the band uses all its terms; one without terms has empty subsets only. A missing end gives null.
    """
    columns = rows.columns
    # The next projection reads the table once and drops it, so the optimizer puts the subquery there; as a column of
    # its own it would be copied into every row.
    held = rows.withColumn("__table", table.scalar())

    def looked_up(b: Column) -> Column:
        found = lambda all_: F.filter(all_, lambda h: F.array_contains(F.get(b["table"], F.pmod(h, F.lit(SLOTS)).cast("int")), h))
        return F.transform(b["parts"], lambda p: F.struct(p.alias("all"), found(p).alias("kept")))

    def joined(parts: Column) -> Column:
        def one(i: int) -> Column:
            first, last = F.get(parts, 0), F.get(parts, i)
            kept = F.array_union(first["kept"], last["kept"])
            return _let(kept, lambda k: F.array_sort(F.when(F.size(k) > 0, k).otherwise(F.array_union(first["all"], last["all"]))))

        return F.struct(*(one(i).alias(c) for i, c in enumerate(ends, 1)))

    parts = F.array(*(term_hashes(F.col(c)) for c in (shared, *ends.values())))
    bound = F.struct(parts.alias("parts"), F.col("__table").alias("table"))
    held = held.select(*columns, _let(_let(bound, looked_up), joined).alias("__terms"))
    return held.withColumns({c: _fingerprint(f"__terms.{c}") for c in ends}).drop("__terms")


def with_fingerprint(rows: DataFrame, text: str, out: str, table: DataFrame) -> DataFrame:
    """Add the fingerprint of ``text`` as ``out``."""
    return with_fingerprints(rows.withColumn("__none", F.lit("")), "__none", {out: text}, table).drop("__none")


def likeness(a: Column, b: Column) -> Column:
    """The share of subsets with equal hashes among those that hold terms in either document, at the levels both have;
    1 for equal fingerprints, 0 without a common level."""
    def of(h: Column) -> Column:
        n = F.when(h["level_a"] == h["level_b"], 2 * SUBSETS).otherwise(SUBSETS)
        part = lambda s, start, k: F.substr(s, start + 4 * k, F.lit(4))
        pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(part(h["a"], h["from_a"], k).alias("x"), part(h["b"], h["from_b"], k).alias("y")))
        filled = F.filter(pairs, lambda p: (p["x"] != _EMPTY) | (p["y"] != _EMPTY))
        share = _let(filled, lambda f: F.when(F.size(f) > 0, F.size(F.filter(f, lambda p: p["x"] == p["y"])) / F.size(f)).otherwise(0.0))
        return F.when(h["a"] == h["b"], 1.0).when(F.abs(h["level_a"] - h["level_b"]) > 1, 0.0).otherwise(share)

    def placed(h: Column) -> Column:
        later = 3 + 4 * SUBSETS
        starts = F.when(h["level_a"] < h["level_b"], later).otherwise(3), F.when(h["level_b"] < h["level_a"], later).otherwise(3)
        return _let(F.struct(h["a"].alias("a"), h["b"].alias("b"), h["level_a"].alias("level_a"), h["level_b"].alias("level_b"), starts[0].alias("from_a"), starts[1].alias("from_b")), of)

    level = lambda s: F.substring(s, 1, 2).cast("int")
    return _let(F.struct(a.alias("a"), b.alias("b"), level(a).alias("level_a"), level(b).alias("level_b")), placed)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def _place(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are at most ``value``: looked up among every so many, then between two of them."""
    if not cuts:
        return F.lit(0)
    width = math.ceil(len(cuts) ** 0.5)
    groups = [cuts[k : k + width] for k in range(0, len(cuts), width)]
    firsts, inner = F.lit([g[0] for g in groups]).cast("array<long>"), F.array(*(F.lit(g).cast("array<long>") for g in groups))

    def fine(group: Column) -> Column:
        return F.when(group < 0, 0).otherwise(group * width + F.size(F.filter(F.get(inner, group), lambda c: c <= value)))

    return _let(F.size(F.filter(firsts, lambda c: c <= value)) - 1, fine)


def _cuts(rows: DataFrame, value: Column, blocks: int) -> list[int]:
    """Approximate percentiles of ``value`` that cut ``rows`` into at most ``blocks`` ranges."""
    if blocks < 2:
        return []
    found = rows.agg(F.percentile_approx(value, [i / blocks for i in range(1, blocks)], max(10_000, 20 * blocks)).alias("c")).first()["c"]
    return sorted(set(found or []))


def with_next_text(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows ``(doc_id, text, block, ghost, next_text)`` where ``next_text`` belongs to the next id, or to the first.

    Ids are cut at approximate percentiles into ranges of about ``block_bytes`` of text, each a window partition. The
    first row of a range also stands, as a ghost, behind the rows of the range before it. The texts are shuffled
    once. Only the cut points and the numbers of ranges, at most ``MOST_BLOCKS`` each, reach the driver. Rows without an
    id come last, in the order of texts, and in ranges of the first bytes of them; rows of one id are ordered by text.
    """
    spark, no_id = docs.sparkSession, F.col("doc_id").isNull()
    # Ordered like the texts: their first seven bytes as a number.
    head = F.conv(F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    size = F.octet_length("text")
    with_id, without = docs.agg(F.sum(F.when(~no_id, size)), F.sum(F.when(no_id, size))).first()
    wanted = lambda n: min(MOST_BLOCKS // 2, -(-(n or 0) // block_bytes))
    cuts = _cuts(docs.where(~no_id), F.col("doc_id"), wanted(with_id))
    later = _cuts(docs.where(no_id), head, wanted(without)) if without else []
    block = F.when(no_id, len(cuts) + 1 + _place(head, later)).otherwise(_place(F.col("doc_id"), cuts)).cast("int")
    placed = docs.withColumn("block", block)
    firsts = sorted((tuple(r) for r in placed.groupBy("block").agg(F.min("doc_id")).collect()))
    before = [(block, first, firsts[i - 1][0]) for i, (block, first) in enumerate(firsts)]
    ghost_of = spark.createDataFrame(before, "of_block int, first long, ghost_block int")
    same = (F.col("block") == F.col("of_block")) & F.col("doc_id").eqNullSafe(F.col("first"))
    heads = placed.join(F.broadcast(ghost_of), same).groupBy("doc_id", "ghost_block").agg(F.min("text").alias("text"))
    rows = placed.select("doc_id", "text", "block", F.lit(False).alias("ghost"))
    rows = rows.unionByName(heads.select("doc_id", "text", F.col("ghost_block").alias("block"), F.lit(True).alias("ghost")))
    order = Window.partitionBy("block").orderBy("ghost", F.asc_nulls_last("doc_id"), "text")
    return rows.withColumn("next_text", F.lead("text").over(order))


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text with its last quarter replaced by the beginning of the next document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. A missing text is
    empty. A single document is its own next. Rows of one id are documents of their own, in the order of their texts;
    rows without an id come last. An empty table gives no row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    table = stage(lexicon(docs), "lexicon")
    rows = with_next_text(docs)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - quarter), F.substr("next_text", F.lit(1), quarter))
    # Both texts begin alike; they are cut before the word that the edit may change.
    start = F.substr("text", F.lit(1), n - quarter)
    whole = F.length(start) - F.length(F.regexp_extract(F.reverse(start), r"^[\p{L}\p{N}]*", 0))
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": F.when(~F.col("ghost"), edited), "whole": whole})
    end = lambda c: F.substr(c, F.col("whole") + 1, F.length(c))
    rows = rows.withColumns({"start": F.substr("text", F.lit(1), F.col("whole")), "end": end("text"), "edited_end": end("edited")})
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256)).drop("next_text", "edited", "whole")
    rows = with_fingerprints(rows, "start", {"fingerprint": "end", "edited_fingerprint": "edited_end"}, table)
    order = Window.partitionBy("block").orderBy("ghost", F.asc_nulls_last("doc_id"), "text")
    rows = rows.withColumn("next_fingerprint", F.lead("fingerprint").over(order)).where(~F.col("ghost"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
