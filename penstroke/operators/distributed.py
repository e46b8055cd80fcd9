"""Ordered numbering, running totals and joins that stay distributed when one key holds much of the table."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penstroke.staging import stage

HOT_ROWS = 200_000
"""Rows, or units of a weight, that one key may have before its rows are divided into ordered parts."""

MAX_HOT_KEYS = 65_536
"""Keys that count as hot at most, the largest first: a colder key has at most this share of the table."""

SKETCH_ITEMS, SKETCH_SIZE = 1_024, 16_384
"""Keys that the sketch of a join's heavy keys reports, and counters that it holds."""


def hot_keys(
    df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, weight: str | None = None
) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows, or weight, and how much they have (``_n``), stored; ``None`` without any.

    One pass with partial sums on the map side. Past ``MAX_HOT_KEYS`` of them the largest are taken, so the table may
    be broadcast at any scale.
    """
    size = F.count("*") if weight is None else F.sum(weight)
    hot = stage(df.groupBy(*keys).agg(size.alias("_n")).where(F.col("_n") > hot_rows), "hot-keys")
    n = hot.count()
    if n > MAX_HOT_KEYS:
        hot = stage(hot.orderBy(F.desc("_n"), *keys).limit(MAX_HOT_KEYS), "hottest-keys")
    return hot if n else None


def divide_hot_keys(
    df: DataFrame, hot: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], hot_rows: int
) -> tuple[DataFrame, DataFrame]:
    """The rows of ordinary keys, and those of hot keys with ``_hot`` (the key's number) and ``_part``, stored.

    The rows of hot keys are range-partitioned by key, ``order`` and ``ties`` into as many parts as they need, however
    many that are; a part is an ascending run of a key or of several. Equal values of ``order`` may spread over parts.
    """
    named = hot.select(*(F.col(k).alias(f"_hot_{k}") for k in keys), F.monotonically_increasing_id().alias("_hot"))
    same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    marked = df.join(F.broadcast(named), same, "left").select(*df.columns, "_hot")  # at most MAX_HOT_KEYS rows
    parts = max(2, math.ceil(hot.agg(F.sum("_n")).first()[0] / hot_rows))
    divided = marked.where(F.col("_hot").isNotNull()).repartitionByRange(parts, "_hot", order, *ties)
    return (
        marked.where(F.col("_hot").isNull()).drop("_hot"),
        stage(divided.withColumn("_part", F.spark_partition_id()), "hot-parts"),
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str],
    name: str = "rn",
    totals: Mapping[str, str] | None = None,
    least: Mapping[str, str] | None = None,
    top: int | None = None,
    hot_rows: int = HOT_ROWS,
    weight: str | None = None,
) -> DataFrame:
    """Number the rows of every key from 1 by (``order``, ``ties``).

    ``totals`` maps an output name to a column summed over all earlier rows of the key, ``least`` to a column whose
    minimum over the whole key is added. ``top`` keeps the first rows only.

    The keys are sized first, by rows or by ``weight``. Without hot keys this is a plain window. The rows of hot keys
    are laid out in ranges, numbered within each range, and get a carry: what the earlier ranges of their key amount
    to, a prefix sum over one row per key and range. ``df`` is read for the sizes and for the result, so it should
    be cheap to read.
    """
    keys, totals, least = list(keys), dict(totals or {}), dict(least or {})
    hot = hot_keys(df, keys, hot_rows, weight)
    if hot is None:
        return _number(df, keys, order, ties, name, totals, least, top)
    ordinary, divided = divide_hot_keys(df, hot, keys, order, ties, hot_rows)
    group = ["_hot", "_part"]
    whole = Window.partitionBy("_hot")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"_carry": F.count("*"), **{f"_carry_{out}": F.sum(source) for out, source in totals.items()}}
    lows = {f"_least_{out}": F.min(source) for out, source in least.items()}
    carry = (
        divided.groupBy(*group)
        .agg(*(value.alias(c) for c, value in (sums | lows).items()))
        .select(
            *group,
            *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in sums),
            *(F.min(c).over(whole).alias(c) for c in lows),
        )
    )
    rows = divided.join(carry, group)
    if top is not None:
        rows = rows.where(F.col("_carry") < top)
    numbered = _number(rows, group, order, ties, name, totals, least, top)
    added = {c: F.col(c) + F.col(f"_carry_{c}") for c in totals} | {name: F.col(name) + F.col("_carry")}
    added |= {c: F.coalesce(f"_least_{c}", c) for c in least}
    columns = [*df.columns, name, *totals, *least]
    numbered = numbered.withColumns(added).select(*columns)
    numbered = numbered if top is None else numbered.where(F.col(name) <= top)
    return _number(ordinary, keys, order, ties, name, totals, least, top).select(*columns).unionByName(numbered)


def _number(df, keys, order, ties, name, totals, least, top) -> DataFrame:
    whole = Window.partitionBy(*keys)
    inside = whole.orderBy(order, *ties)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    sums = {out: F.coalesce(F.sum(source).over(earlier), F.lit(0)) for out, source in totals.items()}
    lows = {out: F.min(source).over(whole) for out, source in least.items()}
    numbered = df.withColumns({name: F.row_number().over(inside), **sums, **lows})
    return numbered if top is None else numbered.where(F.col(name) <= top)


def global_rank(
    df: DataFrame,
    order: Sequence[str | Column],
    name: str = "rank",
    within: Sequence[str] = (),
) -> DataFrame:
    """Add the position from 0 in the total order ``order``, or in each ``within`` group.

    Rows are range-partitioned and sorted by the whole order, so a large group or many equal counts spread over
    partitions. ``order`` must be unique per row. The numbered table is staged, since both the offsets and the rows
    must come from the same partitioning. Offsets are one row per partition.
    """
    columns = [*within, *order]
    numbered = stage(
        df.repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .withColumn("_gid", F.monotonically_increasing_id()),
        "global-rank",
    )
    split = numbered.withColumn("_pid", F.shiftright("_gid", 33))
    offsets = (
        split.groupBy("_pid")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_base", F.sum("_rows").over(Window.orderBy("_pid")) - F.col("_rows"))
        .drop("_rows")
    )
    inside = F.col("_gid").bitwiseAND(F.lit((1 << 33) - 1))
    placed = split.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_base") + inside)
    placed = placed.select(*df.columns, name)
    if not within:
        return placed
    first = placed.groupBy(*within).agg(F.min(name).alias("_first"))
    return salted_join(placed, first, list(within)).withColumn(name, F.col(name) - F.col("_first")).drop("_first")


def _plain(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "variant")]


def heavy_hitters(df: DataFrame, keys: Sequence[str], hot_rows: int) -> tuple[dict[int, int], bool]:
    """Hashes of keys with more than about ``hot_rows`` rows and how many they have; whether equal rows make them up.

    A mergeable sketch of ``SKETCH_SIZE`` counters sums up each task, so one small row per task is all that moves. A key
    that the sketch can't tell from others has too few rows to matter: at most 4 in ``SKETCH_SIZE`` of the table.
    """
    columns = {"_key": F.xxhash64(*keys), "_row": F.xxhash64(*_plain(df))}
    found = df.select(*(v.alias(k) for k, v in columns.items())).agg(
        *(F.expr(f"approx_top_k({c}, {SKETCH_ITEMS}, {SKETCH_SIZE})").alias(c) for c in columns)
    )
    of_key, of_row = found.first()
    return {r["item"]: r["count"] for r in of_key if r["count"] > hot_rows}, any(r["count"] > hot_rows for r in of_row)


def deal_hot_keys(
    large: DataFrame, small: DataFrame, keys: Sequence[str], hot: Mapping[int, int], alike: bool, hot_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_salt``: a copy of a hot key in ``small`` per ``hot_rows`` of its rows, one of any other key."""
    tasks = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = {k: min(math.ceil(n / hot_rows), 4 * tasks) for k, n in hot.items()}
    listed = F.create_map(*(F.lit(x).cast("bigint") for pair in copies.items() for x in pair))  # SKETCH_ITEMS at most
    of_key = F.coalesce(F.try_element_at(listed, F.xxhash64(*keys)), F.lit(1).cast("bigint"))
    rows = stage(large.withColumn("_number", F.monotonically_increasing_id()), "numbered-rows") if alike else large
    salt = F.when(of_key > 1, F.pmod(F.xxhash64(*_plain(rows)), of_key)).otherwise(0).cast("int")
    copied = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), (of_key - 1).cast("int"))))
    return rows.withColumn("_salt", salt), copied


def broadcast_by_spark(df: DataFrame) -> bool:
    """Whether Spark's own size check lets it broadcast ``df``."""
    plan = df._jdf.queryExecution().optimizedPlan()
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    return int(str(plan.stats().sizeInBytes())) <= conf.autoBroadcastJoinThreshold()


def salted_join(
    large: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Join a table that may have hot keys with one that has at most one row per key.

    A small side that Spark may broadcast is joined as it is. Otherwise a sketch finds the hot keys of ``large``; only
    their rows in ``small`` are copied, in proportion to their share, and their rows in ``large`` are dealt to the
    copies by a digest of the row. Where a hot key consists of equal rows, they are stored with a number first,
    which then deals them, the same again when a task is repeated. ``large`` is read for the sketch and for the result.
    """
    keys = list(keys)
    added = [] if how in ("left_semi", "left_anti") else [c for c in small.columns if c not in keys]
    hot, alike = ({}, False) if broadcast_by_spark(small) else heavy_hitters(large, keys, hot_rows)
    if not hot:
        return large.join(small, keys, how).select(*large.columns, *added)
    rows, copied = deal_hot_keys(large, small, keys, hot, alike, hot_rows)
    return rows.join(copied, [*keys, "_salt"], how).select(*large.columns, *added)


def keep_members(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is in ``members``."""
    return salted_join(df, members.select(*keys).distinct(), keys, "left_semi")


def drop_members(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``members``."""
    return salted_join(df, members.select(*keys).distinct(), keys, "left_anti")
