"""SimHash near-duplicates through a vantage-point tree over Hamming distance.

Fingerprints are compared, not documents: equal ones are one point. A small tree, built from a bounded
sample, deals the points to shards; a point whose distance to a node's vantage point lies within the search
radius beyond the node's border also visits the shard inside as a query, which by the triangle inequality
finds every pair that the border parts. Inside a shard the same rule goes on with local vantage points until
few points are left, and those are compared exactly. A shard returns a spanning forest of its links, not all
pairs, and the components of these forests are joined by label propagation with pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .shared import fresh, materialise, text_key

#: Fingerprints from which the tree is built, and points that a shard owns on average.
TREE_SAMPLE = 32_768
SHARD_POINTS = 16_384
_LEAF = 256
_BLOCK = 1 << 21
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_OFFSETS = (np.arange(8) * 256).astype(np.int64)


def majority(hashed: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes as a signed integer: a bit is 1 if it is set in over half of them; zero of none."""
    seen = np.bincount((hashed.view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = (2 * seen.ravel() > len(hashed)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        parts = [joined[a:b] for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return majority(np.array([xxhash.xxh64_intdigest(p, 42) for p in parts], np.uint64))


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, th, fp) of each row. Null and empty texts have fingerprint zero."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("th"), run(F.col(text_col)).alias("fp"))


def _split(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """A vantage point and a border for which few points lie just beyond it; None if nothing parts the points."""
    best, found = None, None
    for v in rng.choice(points, min(8, len(points)), replace=False):
        spread = np.bincount(np.bitwise_count(points[:4096] ^ v), minlength=66 + radius)
        share = np.cumsum(spread) / spread.sum()
        for border in range(64):
            if 0.3 <= share[border] <= 0.7:
                cost = share[border + radius] - share[border] + abs(share[border] - 0.5) / 4
                if best is None or cost < best:
                    best, found = cost, (int(v), border)
    return found


def build_tree(sample: np.ndarray, depth: int, radius: int) -> list[tuple]:
    """Nodes: ("split", vantage, border, inside, outside) or ("shard", number)."""
    nodes: list[tuple] = []
    shards = 0
    rng = np.random.default_rng(7)

    def grow(points: np.ndarray, left: int) -> int:
        nonlocal shards
        cut = _split(points, radius, rng) if left and len(points) >= 16 else None
        at = len(nodes)
        if cut is None:
            nodes.append(("shard", shards))
            shards += 1
            return at
        nodes.append(())
        inside = np.bitwise_count(points ^ np.uint64(cut[0])) <= cut[1]
        nodes[at] = ("split", *cut, grow(points[inside], left - 1), grow(points[~inside], left - 1))
        return at

    grow(sample, depth)
    return nodes


def _visit(nodes: list[tuple], points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """Where points go: (shard, points, whether the shard owns them)."""
    todo = [(0, points, True), (0, points[:0], False)]
    while todo:
        at, held, own = todo.pop()
        if not len(held):
            continue
        node = nodes[at]
        if node[0] == "shard":
            yield node[1], held, own
            continue
        _, vantage, border, inside, outside = node
        d = np.bitwise_count(held ^ np.uint64(vantage)).astype(int)
        if own:
            todo += [(inside, held[d <= border], True), (outside, held[d > border], True)]
            todo.append((inside, held[(d > border) & (d <= border + radius)], False))
        else:
            todo += [(inside, held[d <= border + radius], False), (outside, held[d > border - radius], False)]


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of i and j; afterwards each point's parent is the least of its tree."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


def link(points: np.ndarray, own: np.ndarray, radius: int, direct: bool = False) -> np.ndarray:
    """For each point the place of the least point it is linked to, over pairs of which one is owned; where direct, of the least
    other point within the radius. A point without one has its own place."""
    parent = np.full(len(points), len(points)) if direct else np.arange(len(points))
    rng = np.random.default_rng(11)

    def compare(mine: np.ndarray, others: np.ndarray) -> None:
        if not len(mine):
            return
        rows = max(1, _BLOCK // len(mine))
        for at in range(0, len(others), rows):
            some = others[at : at + rows]
            i, j = np.nonzero(np.bitwise_count(points[some][:, None] ^ points[mine]) <= radius)
            if direct:
                other = some[i] != mine[j]
                x, y = some[i][other], mine[j][other]
                np.minimum.at(parent, x, y)
                np.minimum.at(parent, y, x)
            else:
                _unite(parent, some[i], mine[j])

    def walk(mine: np.ndarray, others: np.ndarray, depth: int) -> None:
        cut = _split(points[mine], radius, rng) if len(mine) > _LEAF and depth < 40 else None
        if cut is None:
            compare(mine, mine)
            compare(mine, others)
            return
        vantage, border = np.uint64(cut[0]), cut[1]
        d = np.bitwise_count(points[mine] ^ vantage).astype(int)
        e = np.bitwise_count(points[others] ^ vantage).astype(int)
        beyond = mine[(d > border) & (d <= border + radius)]
        walk(mine[d <= border], np.concatenate([others[e <= border + radius], beyond]), depth + 1)
        walk(mine[d > border], others[e > border - radius], depth + 1)

    walk(np.flatnonzero(own), np.flatnonzero(~own), 0)
    return np.where(parent == len(points), np.arange(len(points)), parent)


def linked_pairs(points: DataFrame, radius: int = 2, direct: bool = False) -> DataFrame:
    """points: distinct (fp), none null. A forest (a, b) whose components are those of all pairs within radius bits; a point
    that links to none is in no edge, and no point gives no edge. Where direct, the ends of each edge are within radius bits
    themselves: of every point that has such a neighbour, the least one in each shard."""
    spark = points.sparkSession
    n = points.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / SHARD_POINTS))))
    sample = [r.fp for r in points.orderBy(F.xxhash64("fp"), "fp").limit(TREE_SAMPLE).collect()] if depth else []
    nodes = build_tree(np.array(sample, np.int64).view(np.uint64), depth, radius)
    shared = spark.sparkContext.broadcast(nodes)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            held = rows["fp"].to_numpy(np.int64).view(np.uint64)
            for shard, some, own in _visit(shared.value, held, radius):
                yield pd.DataFrame({"shard": shard, "fp": some.view(np.int64), "own": own})

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        fps = rows["fp"].to_numpy(np.int64)
        parent = link(fps.view(np.uint64), rows["own"].to_numpy(bool), radius, direct)
        moved = parent != np.arange(len(parent))
        return pd.DataFrame({"a": fps[moved], "b": fps[parent[moved]]})

    dealt = points.select("fp").mapInPandas(deal, "shard int, fp long, own boolean")
    return dealt.groupBy("shard").applyInPandas(within, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for every end of edges (a, b): root is the least fp of its component."""
    both = materialise(edges.select("a", "b").unionAll(edges.select("b", "a")).distinct(), "simhash-edges")
    labels = materialise(both.groupBy(F.col("a").alias("fp")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "simhash-labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"fp": "b", "root": "near"}), "b").groupBy(F.col("a").alias("fp")).agg(F.min("near").alias("near"))
        step = labels.join(near, "fp").select("fp", F.least("root", "near").alias("to"), F.col("root").alias("old"))
        jump = step.join(labels.withColumnsRenamed({"fp": "to", "root": "further"}), "to", "left")
        new = materialise(jump.select("fp", F.least("to", F.coalesce("further", "to")).alias("root"), "old"), "simhash-labels")
        labels, changed = new.select("fp", "root"), not new.filter("root <> old").isEmpty()
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, th, fp, component_id, keep) of each row: the least id of its group, and whether it stays.

    Fingerprints link at radius or fewer differing bits, and links chain. Null, empty and blank texts share
    fingerprint zero and link like any other. Rows without id take part; a group that has none but such rows
    has component_id null. One row of a group stays, that of the least id and then text hash; rows equal in
    both count as one document and are marked alike. An empty table gives an empty result.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash-fingerprints")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("th").alias("th"))
    points = materialise(rows.groupBy("fp").agg(F.min(order).alias("least")), "simhash-points")
    roots = components(linked_pairs(points, radius))
    joined = points.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = joined.groupBy("root").agg(F.min("least").alias("rep"))
    by_fp = joined.select("fp", "root").join(groups, "root").select("fp", "rep")
    keep = F.col("id").eqNullSafe(F.col("rep.id")) & (F.col("th") == F.col("rep.th"))
    return rows.join(by_fp, "fp").select("id", "th", "fp", F.col("rep.id").alias("component_id"), keep.alias("keep"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """docs with one row of each group, columns unchanged; of rows equal in id and text the first stays."""
    found = near_duplicates(docs, id_col, text_col, shingle, radius).filter("keep")
    i, t, key, group = fresh(docs, "keep_id", "keep_th", "row_th", "row_group")
    found = found.select(F.col("id").alias(i), F.col("th").alias(t)).distinct()
    keyed = docs.withColumn(key, text_key(F.col(text_col)))
    kept = keyed.join(found, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(key) == F.col(t)))
    return kept.dropDuplicates([i, t]).drop(i, t, key, group)
