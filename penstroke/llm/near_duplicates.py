"""SimHash fingerprints, and groups of near copies found with BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penstroke.staging import stage

SHINGLE = 3
RADIUS = 2
SEED = 42
TREE_SIZE = 4096
"""Fingerprints in one tree. A larger shard has several trees, and each of its fingerprints asks all of them."""

_HASHES = 1 << 17
"""Hashes of shingles that a worker holds at a time, at about 70 bytes each; results don't depend on it."""


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fp)``: a 64-bit fingerprint of every text, as a signed long; then the long columns ``carried``.

    A-Z are lowered and words are runs without ASCII white space. A bit is set if it is set in more than half of the
    hashes of the shingles, repeats included. A text with fewer words than a shingle has one hash; without words, or
    missing, the fingerprint is zero.
    """

    def flush(hashes: list[int], counts: list[int]) -> np.ndarray:
        n = np.array(counts, np.int64)
        out = np.zeros(len(n), np.uint64)
        full = np.flatnonzero(n)
        if len(full):
            h = np.array(hashes, np.uint64)
            start = (np.cumsum(n) - n)[full]
            for bit in range(64):
                ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), start)
                out[full] |= (2 * ones > n[full]).astype(np.uint64) << np.uint64(bit)
        return out.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for rows in batches:
            ids, texts = rows.column(0), rows.column(1)
            hashes, counts, made = [], [], []
            for text in texts:
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").lower().split()
                if len(words) < SHINGLE:
                    new = [digest(b" ".join(words), SEED)] if words else []
                else:
                    joined, start = b" ".join(words), list(accumulate((len(w) + 1 for w in words), initial=0))
                    new = [digest(joined[a : b - 1], SEED) for a, b in zip(start, start[SHINGLE:])]
                hashes += new
                counts.append(len(new))
                if len(hashes) >= _HASHES:
                    made.append(flush(hashes, counts))
                    hashes, counts = [], []
            made.append(flush(hashes, counts))
            others = [rows.column(2 + i) for i in range(len(carried))]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(made)), *others], names=["doc_id", "fp", *carried])

    schema = ", ".join(f"{c} long" for c in ("doc_id", "fp", *carried))
    return docs.select(F.col(id_column).cast("long"), F.col(text), *carried).mapInArrow(run, schema)


class Trees:
    """Many BK-trees over 64-bit values, built and searched side by side.

    A node's children are keyed by their Hamming distance to it. ``tree`` numbers the tree of every value; equal
    values of a tree are given once. All trees grow by one level per step: the first value waiting at an edge becomes
    the child there, the others move on below it.
    """

    def __init__(self, tree: np.ndarray, value: np.ndarray) -> None:
        self.value = value
        root, first = np.unique(tree, return_index=True)
        self.roots = dict(zip(root.tolist(), first.tolist()))
        parent, waiting = np.full(len(value), -1, np.int64), np.arange(len(value))
        at = first[np.searchsorted(root, tree)]
        edge = np.zeros(len(value), np.int64)
        waiting = waiting[at != waiting]
        while len(waiting):
            distance = np.bitwise_count(value[waiting] ^ value[at[waiting]]).astype(np.int64)
            _, chosen, where = np.unique(at[waiting] * 65 + distance, return_index=True, return_inverse=True)
            child = waiting[chosen]
            parent[child], edge[child] = at[child], distance[chosen]
            at[waiting] = child[where]
            waiting = waiting[at[waiting] != waiting]
        order = np.argsort(parent * 65 + edge, kind="stable")
        self.child = order
        self.key = parent[order] * 65 + edge[order]

    def near(self, tree: np.ndarray, query: np.ndarray, radius: int, links) -> None:
        """Call ``links(query numbers, node numbers)`` for all nodes of a query's tree within ``radius``."""
        asks = np.arange(len(query))
        roots = np.fromiter((self.roots[t] for t in tree.tolist()), np.int64, len(tree))
        while len(asks):
            distance = np.bitwise_count(query[asks] ^ self.value[roots]).astype(np.int64)
            hit = distance <= radius
            links(asks[hit], roots[hit])
            low = np.searchsorted(self.key, roots * 65 + np.maximum(distance - radius, 1), "left")
            high = np.searchsorted(self.key, roots * 65 + np.minimum(distance + radius, 64), "right")
            many = high - low
            asks = np.repeat(asks, many)
            ends = np.cumsum(many)
            roots = self.child[np.arange(len(asks)) + np.repeat(low - (ends - many), many)]


class Groups:
    """Union-find over the rows of one portion; the smaller value leads a group."""

    def __init__(self, n: int) -> None:
        self.lead = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self._top(a), self._top(b)
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low < high
            a, b = low[apart], high[apart]
            np.minimum.at(self.lead, b, a)

    def _top(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.lead[x]
            if (up == x).all():
                return x
            self.lead[x] = self.lead[up]
            x = up

    def leads(self) -> np.ndarray:
        return self._top(np.arange(len(self.lead)))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(a, b)``, ``a < b``, over distinct fingerprints ``fp`` whose components are those of all links.

    The 64 bits are four bands of 16. Two fingerprints that differ in at most two bits agree in two bands at least, so
    the shards are the values of the six pairs of bands, and a shard's trees are asked by its own members only.
    Shards that hold one fingerprint are dropped before the search. A shard past ``TREE_SIZE`` has several trees, each
    dealt to a task of its own together with all members as queries. A task gives an edge to the leader of each group
    that it sees instead of all pairs.
    """
    if not 0 <= radius <= 2:
        raise ValueError("two common bands are certain only up to two differing bits")
    bands = [f"shiftright(fp, {16 * i}) & 65535" for i in range(4)]
    pairs = [f"struct({n} as pair, (({bands[i]}) * 65536 + ({bands[j]})) as band)" for n, (i, j) in enumerate((i, j) for i in range(4) for j in range(i + 1, 4))]
    keyed = fps.select("fp", F.explode(F.expr(f"array({', '.join(pairs)})")).alias("s")).select("s.pair", "s.band", "fp")
    sizes = keyed.groupBy("pair", "band").agg(F.count("*").alias("n")).where("n > 1")
    trees = F.ceil(F.col("n") / TREE_SIZE).cast("int")
    member = keyed.join(sizes, ["pair", "band"]).withColumn("trees", trees)
    member = member.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    dealt = member.withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    dealt = dealt.select("pair", "band", "tree", (F.col("own") == F.col("tree")).alias("node"), "fp")
    keys = ["pair", "band", "tree"]

    def search(rows: pa.Table) -> pa.RecordBatch:
        pair, band, tree = (rows[c].to_numpy() for c in keys)
        value, node = rows["fp"].to_numpy().view(np.uint64), rows["node"].to_numpy()
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (band[1:] != band[:-1]) | (tree[1:] != tree[:-1])
        shard = np.cumsum(new) - 1
        distinct, number = np.unique(value.view(np.int64), return_inverse=True)
        with_tree = np.isin(shard, shard[node])
        asks = np.flatnonzero(with_tree)
        groups, nodes = Groups(len(distinct)), np.flatnonzero(node)
        found = Trees(shard[nodes], value[nodes])
        for at in range(0, len(asks), 1 << 16):
            mine = asks[at : at + (1 << 16)]
            found.near(shard[mine], value[mine], radius, lambda q, n, mine=mine: groups.join(number[mine[q]], number[nodes[n]]))
        lead = groups.leads()
        other = np.flatnonzero(lead != np.arange(len(lead)))
        return pa.RecordBatch.from_arrays([pa.array(distinct[lead[other]]), pa.array(distinct[other])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= 1 << 18:  # search all but the last shard, which may go on
                rows = pa.Table.from_batches(held).combine_chunks()
                same = pc.and_(*(pc.equal(rows[c], rows[c][-1]) for c in keys[:2]))
                same = pc.and_(same, pc.equal(rows["tree"], rows["tree"][-1])).to_numpy()
                cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
                if cut:
                    yield search(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                size = len(rows) - cut
        if size:
            yield search(pa.Table.from_batches(held).combine_chunks())

    ordered = dealt.repartition(*keys).sortWithinPartitions(*keys, "fp")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, lead)`` with the smallest node of every component of ``edges`` ``(a, b)``, for nodes with an edge.

    Large-star and small-star steps in turn until nothing changes; each is one grouping by a minimum and a join, and
    the edges of a round are a stored table.
    """
    edges = stage(edges.selectExpr("greatest(a, b) as u", "least(a, b) as v").where("u > v").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v as u", "m as v").where("u > v").distinct()
        large = stage(large, "edges")
        lead = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lead, "u").selectExpr("if(v = m, u, v) as u", "m as v").where("u > v").distinct()
        after = stage(small, "edges")
        changed = after.select("u", "v").exceptAll(edges.select("u", "v")).isEmpty()
        same = changed and after.count() == edges.count()
        edges = after
        if same:
            return edges.selectExpr("u as node", "v as lead").union(edges.selectExpr("v as node", "v as lead")).distinct()


def near_duplicate_groups(docs: DataFrame, radius: int = RADIUS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest id reachable over links of at most ``radius`` differing bits.

    Every row of the input has one row; rows of one id are members of all their groups' searches alike. Rows without
    an id keep a null id and never lead a group, unless no member has one. Only fingerprints, never texts, are
    shuffled. An empty table gives no row.
    """
    rows = stage(fingerprints(docs, id_column, text), "simhash")
    lead = _leads(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), radius)
    first = lead.groupBy("lead").agg(F.min("least").alias("component_id"))
    named = lead.join(first, "lead").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def _leads(classes: DataFrame, radius: int) -> DataFrame:
    """``(fp, least, lead)`` for ``classes`` ``(fp, least)``, one row per fingerprint: ``lead`` names its component."""
    classes = stage(classes, "simhash-classes")
    joined = stage(components(links(classes.select("fp"), radius)), "components")
    return classes.join(joined, classes.fp == joined.node, "left").select("fp", "least", F.coalesce("lead", "fp").alias("lead"))


def one_of_each_group(docs: DataFrame, radius: int = RADIUS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` per group of near copies, found by the row's own fingerprint and not by its id.

    The smallest id stays, one without an id only if no member has one; then the smallest digest of the text, then of
    the row. The least row of a group is a minimum with partial aggregation, first per fingerprint. Columns stay.
    """
    keys = ["__text", "__row"]
    # A map has no order; its entries, sorted, have one.
    values = [F.array_sort(F.map_entries(f.name)) if f.dataType.typeName() == "map" else F.col(f.name) for f in docs.schema.fields]
    hashed = {keys[0]: F.xxhash64(text), keys[1]: F.xxhash64(*values, *(F.col(c).isNull() for c in docs.columns))}
    marked = docs.withColumns(hashed)
    rows = stage(fingerprints(marked, id_column, text, tuple(keys)), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", *keys)
    lead = _leads(rows.groupBy("fp").agg(F.min(order).alias("least")), radius)
    first = stage(lead.groupBy("lead").agg(F.min("least").alias("least")).select(*(f"least.{k}" for k in keys)), "kept-rows")
    # Most rows stay, so the join is a shuffle at any size that matters; it is one at small sizes as well.
    found = marked.join(first.hint("merge"), keys, "left_semi")
    repeated = stage(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys), "repeated-rows")
    if repeated.isEmpty():
        return found.drop(*keys)
    single = found.join(repeated, keys, "left_anti")
    several = found.join(repeated, keys, "left_semi").dropDuplicates(keys)
    return single.unionByName(several).drop(*keys)
