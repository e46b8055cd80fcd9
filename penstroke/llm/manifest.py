"""Merkle manifests of a dataset by slot pivot: a tree per group of rows, and one over the roots of the groups.

A level of a tree is a table with a row per parent and a column per slot, spread out of the children by conditional
aggregates. The columns together hash to the parent; without the column of a child they are its siblings. Parents have
at most ``FANOUT`` children, so no row or key grows with a group, however many of the rows it holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penstroke.operators.distributed import global_rank, salted_join
from penstroke.staging import stage

FANOUT = 16
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def row_digest(*values: str | Column) -> Column:
    """The SHA-256 of values: ``-`` for null, else the number of UTF-8 bytes, a colon, and the value as text."""
    texts = [(F.col(v) if isinstance(v, str) else v).cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def ascii_lower(text: str | Column) -> Column:
    return F.translate(text, CAPITALS, SMALL)


@dataclass(frozen=True)
class Manifest:
    """Stored levels of the trees of the groups (``levels``) and of the tree over their roots (``top``).

    ``leaves`` and the node tables derived from the levels have ``grp, pos, n, item``: the group, the place in it from
    0, how many nodes the group has on this level, and a struct with the node's ``hash``; the items of the leaves
    hold the caller's fields as well. ``root`` is ``None`` for an empty table.
    """

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: str | None


def _slots() -> list[str]:
    return [f"s{i}" for i in range(FANOUT)]


def _hash(slot: str) -> Column:
    return F.coalesce(F.col(f"{slot}.hash"), F.lit(""))


def _pivot(nodes: DataFrame) -> DataFrame:
    """The parents of all nodes that are not alone in their group: ``grp, pos, n`` and the slots."""
    slot = F.col("pos") % FANOUT
    spread = [F.max(F.when(slot == i, F.col("item"))).alias(s) for i, s in enumerate(_slots())]
    parents = nodes.where("n > 1").groupBy("grp", F.expr(f"pos div {FANOUT}").alias("parent"))
    n = F.expr(f"(max(n) + {FANOUT - 1}) div {FANOUT}").alias("n")
    return parents.agg(n, *spread).withColumnRenamed("parent", "pos")


def _nodes(level: DataFrame) -> DataFrame:
    """The parents of a level as nodes of the next one."""
    return level.select("grp", "pos", "n", F.struct(F.sha2(F.concat(*map(_hash, _slots())), 256).alias("hash")).alias("item"))


def _climb(leaves: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The stored levels above the leaves, and the nodes of every level."""
    n = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes = [], [leaves]
    while n > 1:
        levels.append(stage(_pivot(nodes[-1]), f"level-{len(levels)}"))
        nodes.append(_nodes(levels[-1]))
        n = -(-n // FANOUT)
    return levels, nodes


def _roots(nodes: Sequence[DataFrame]) -> DataFrame:
    """``(grp, hash)``: the nodes that are alone in their group."""
    first, *others = (x.where("n = 1").select("grp", F.col("item.hash").alias("hash")) for x in nodes)
    for other in others:
        first = first.unionByName(other)
    return first


def build_manifest(rows: DataFrame, group: str, order: Sequence[str], leaf: str, fields: Sequence[str] = ()) -> Manifest:
    """Trees over ``rows``: the leaves of a group ascend by ``order`` (nulls first), the groups by name (null first).

    ``leaf`` holds the digest of a row; ``fields`` are carried along in the items. Rows of equal ``order`` follow in the
    order of their digests, so equal rows share a leaf and may change places without changing any hash. ``rows`` should
    be narrow; it is stored once, sorted by range, so neither a group nor many equal rows come to one task.
    """
    name = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("+"), F.col(group).cast("string")))
    item = F.struct(F.col(leaf).alias("hash"), *fields)
    keys = [f"_o{i}" for i in range(len(order))]
    narrow = rows.select(name.alias("grp"), *(F.col(c).alias(k) for c, k in zip(order, keys)), item.alias("item"))
    narrow = stage(narrow.withColumns({"_leaf": F.col("item.hash"), "_row": F.monotonically_increasing_id()}), "leaves")
    placed = global_rank(narrow, ["grp", *keys, "_leaf", "_row"], "_rank").select("grp", "_rank", "item")
    sizes = placed.groupBy("grp").agg(F.min("_rank").alias("_first"), F.count("*").alias("n"))
    place = (F.col("_rank") - F.col("_first")).alias("pos")
    leaves = stage(salted_join(placed, sizes, ["grp"]).select("grp", place, "n", "item"), "placed-leaves")
    levels, nodes = _climb(leaves)

    subroots = stage(_roots(nodes), "subroots")
    count = subroots.count()
    ranked = global_rank(subroots, ["grp"], "pos").select(
        F.lit("").alias("grp"), "pos", F.lit(count).cast("long").alias("n"), F.struct("hash", F.col("grp").alias("of")).alias("item")
    )
    top, tops = _climb(ranked)
    root = _roots(tops).first()
    return Manifest(leaves, levels, ranked, top, root["hash"] if root else None)


def _descend(levels: Sequence[DataFrame], leaves: DataFrame, above: DataFrame) -> DataFrame:
    """``item``, ``path`` and ``subroot`` of every leaf; ``above`` has ``grp, path, subroot`` of the roots.

    A path holds, from the leaf upwards, what stands ``before`` and ``after`` the node among the children of its parent.
    """
    from_root = ["grp", "pos", "item", "path", "subroot"]
    nodes = [leaves, *map(_nodes, levels)]
    below: DataFrame | None = None
    for k in range(len(levels), -1, -1):
        alone = salted_join(nodes[k].where("n = 1").select("grp", "pos", "item"), above, ["grp"]).select(*from_root)
        if below is not None:
            parents = levels[k].drop("n").join(below.select("grp", "pos", "path", "subroot"), ["grp", "pos"])
            slots = _slots()
            children = []
            for i, s in enumerate(slots):
                before = F.concat(F.lit(""), *map(_hash, slots[:i])).alias("before")
                after = F.concat(F.lit(""), *map(_hash, slots[i + 1 :])).alias("after")
                children.append(F.struct(F.lit(i).alias("slot"), F.col(s).alias("item"), F.struct(before, after).alias("step")))
            child = parents.select("grp", "pos", "path", "subroot", F.inline(F.array(*children))).where("item is not null")
            expanded = child.select(
                "grp", (F.col("pos") * FANOUT + F.col("slot")).alias("pos"), "item", F.concat(F.array("step"), "path").alias("path"), "subroot"
            )
            alone = alone.unionByName(expanded)
        below = alone
    return below


def proofs(manifest: Manifest) -> DataFrame:
    """``item, path, subroot`` of every leaf; the path leads over the group's root to the root of all."""
    steps = "array<struct<before: string, after: string>>"
    whole = manifest.subroots.sparkSession.createDataFrame([("", [], manifest.root or "")], f"grp string, path {steps}, subroot string")
    above = _descend(manifest.top, manifest.subroots, whole).select(F.col("item.of").alias("grp"), "path", F.col("item.hash").alias("subroot"))
    return _descend(manifest.levels, manifest.leaves, stage(above, "group-paths")).select("item", "path", "subroot")


def proof_digest(path: str | Column) -> Column:
    """The SHA-256 of all siblings of a path, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def fold(leaf: Column, path: str | Column) -> Column:
    """The root that a leaf and its siblings come to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def verify_documents(docs: DataFrame, tampered: Column) -> DataFrame:
    """Manifest of documents, with a proof for each, folded from the leaf of its text or, where ``tampered`` is true, of the text
    in small letters.

    Result: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, one row per row of ``docs``; other columns
    are not read. A row without an id comes first in its source and a missing condition is not tampering. Rows that
    share an id each have a leaf. The texts are read once, in the scan that hashes them; they cross no shuffle.
    """
    changed = F.coalesce(tampered, F.lit(False)) & F.col("text").rlike("[A-Z]")
    altered = row_digest(*LEAF_COLUMNS[:-1], ascii_lower("text"))
    rows = docs.select("doc_id", "source", row_digest(*LEAF_COLUMNS).alias("leaf"), F.when(changed, altered).alias("altered"))
    manifest = build_manifest(rows, "source", ["doc_id"], "leaf", ["doc_id", "altered"])
    found = proofs(manifest).select(
        "item.doc_id",
        F.col("item.hash").alias("leaf"),
        "subroot",
        F.lit(manifest.root).cast("string").alias("root"),
        proof_digest("path").alias("proof_sha256"),
        fold(F.coalesce("item.altered", "item.hash"), "path").alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
