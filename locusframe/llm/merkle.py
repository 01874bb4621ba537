"""Merkle manifest of a table: a digest for each row, a tree over each group's rows, and one root over all groups.

A row's leaf is the SHA-256 of its fields, each with its length before it. The leaves of a group, in order, are
joined in runs of `fanout`: conditional aggregates spread a run's children into one column each, the columns joined
are the parent's input, and all but a child's own column are its siblings. The groups' roots are joined likewise.

Ranks come from one sort over all partitions, whatever the groups' sizes, and each level is written once: it
is read on the way up for the parents, and on the way down for the siblings. A level holds an eighth of the one below,
and a run's siblings go down once, with the run, until they reach the leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import lower_ascii, materialise

FANOUT = 8
_PATH = "array<struct<l:string,r:string>>"


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 over the fields, as 32 bytes: `-` for null, else the length in UTF-8 bytes, `:` and the value as text."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def tampered_text(doc_id: Column, text: Column) -> Column:
    """A third of the texts in lower case (A-Z), by the id's crc32; rows without id or text stay."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, lower_ascii(text)).otherwise(text)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give, as hex text."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step.l, node, step.r), 256))


def siblings_hash(path: Column) -> Column:
    """SHA-256 of all siblings, lowest level first, left to right, as hex text."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step.l, step.r)), ""), 256)


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _ranked(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """rows (g, ...) with pos, the 0-based place in g by order, and n, the rows of g. Rows equal in order stay as they come."""
    # equal rows, however many, can be split between partitions by their place in the input
    spread = rows.withColumn("near", F.monotonically_increasing_id()).orderBy("g", *order, "near").drop("near")
    placed = materialise(spread.withColumn("at", F.monotonically_increasing_id()), f"{label}-rows").withColumn("part", F.shiftright("at", 33))
    # a partition holds one stretch of each of its groups
    runs = placed.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("k"))
    group = Window.partitionBy("g")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("g", "part", "first", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"), F.sum("k").over(group).alias("n"))
    # written, so that Spark knows its size when it chooses the join
    starts = materialise(starts, f"{label}-starts")
    return placed.join(starts, ["g", "part"]).withColumn("pos", F.col("start") + F.col("at") - F.col("first")).drop("part", "at", "first", "start")


def _runs(nodes: DataFrame, fanout: int) -> DataFrame:
    """One row for each run of children: (g, up, n, c0 .. c<fanout-1>); a child is (h) or (h, item)."""
    child = F.struct("h", *[c for c in nodes.columns if c == "item"])
    slots = [F.max(F.when(F.col("pos") % fanout == j, child)).alias(f"c{j}") for j in range(fanout)]
    return nodes.filter("n > 1").groupBy("g", F.expr(f"pos div {fanout}").alias("up"), "n").agg(*slots)


def _joined(slots: list[int]) -> Column:
    """The digests of these slots as one text; slots without a child are passed over."""
    return F.concat_ws("", *[hex_text(F.col(f"c{j}.h")) for j in slots])


def _parents(runs: DataFrame, fanout: int) -> DataFrame:
    return runs.select("g", F.col("up").alias("pos"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), F.unhex(F.sha2(_joined(list(range(fanout))), 256)).alias("h"))


def _children(runs: DataFrame, fanout: int) -> DataFrame:
    """Each child of runs (.., path) with its own path: (g, pos, c, path)."""
    slots = range(fanout)
    each = [
        F.struct(
            (F.col("up") * fanout + j).alias("pos"), F.col(f"c{j}").alias("c"),
            F.struct(_joined([i for i in slots if i < j]).alias("l"), _joined([i for i in slots if i > j]).alias("r")).alias("step"),
        )
        for j in slots
    ]
    found = runs.select("g", "path", F.explode(F.array(*each)).alias("x")).filter("x.c is not null")
    return found.select("g", F.col("x.pos").alias("pos"), F.col("x.c").alias("c"), F.concat(F.array("x.step"), "path").alias("path"))


def _tree(nodes: DataFrame, fanout: int, label: str) -> tuple[DataFrame, DataFrame]:
    """From ranked nodes (g, pos, n, h, item): (g, h) of the root of each g, and (g, h, item, path) of each node."""
    nodes = nodes.select("g", "pos", "n", "h", "item")
    # one number; a group of n nodes has log(n) levels
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots, up = [], nodes.filter("n = 1").select("g", "h"), nodes
    while most > 1:
        levels.append(materialise(_runs(up, fanout), f"{label}-level{len(levels)}"))
        up = _parents(levels[-1], fanout)
        roots = roots.unionAll(up.filter("n = 1").select("g", "h"))
        most = -(-most // fanout)
    empty = F.array().cast(_PATH)
    paths = nodes.filter("n = 1").select("g", "h", "item", empty.alias("path"))
    above = None
    for level in reversed(levels):
        # runs of a group's highest level have none above
        runs = level.withColumn("path", empty) if above is None else level.join(above, ["g", "up"], "left").withColumn("path", F.coalesce("path", empty))
        found = _children(runs, fanout)
        above = found.select("g", F.col("pos").alias("up"), "path")
        if level is levels[0]:
            paths = paths.unionAll(found.select("g", "c.h", "c.item", "path"))
    return roots, paths


def manifest(rows: DataFrame, leaf: str, group: str, order: str, fanout: int = FANOUT) -> DataFrame:
    """rows with subroot, root (hex text) and path, the siblings from the leaf up to the root: array<struct<l, r>>, those to
    the left and to the right of each node as joined hex text.

    leaf: the column with the digest (32 bytes). Groups are ordered bytewise as text, null first, and null is a group of its
    own. In a group rows ascend by order, null first, then by leaf; repeated rows are leaves of their own. A lone leaf is its group's
    subroot, with no siblings there. An empty table gives an empty result. Columns named subroot, root or path are replaced.
    """
    rows = rows.drop(*[c for c in ("subroot", "root", "path") if c not in (leaf, group, order)])
    # a text that orders as the group does, null first, and is never null
    g = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    packed = rows.select(g.alias("g"), F.col(order).alias("key"), F.col(leaf).alias("h"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("item"))
    # written first: the sort reads its input twice, and must not hash every text again
    nodes = _ranked(materialise(packed, "merkle-leaves"), ["key", "h"], "merkle")
    subroots, paths = _tree(nodes, fanout, "merkle")
    tops = subroots.select(F.lit("").alias("g"), F.col("g").alias("key"), "h", F.struct("g").alias("item"))
    roots, top_paths = _tree(_ranked(materialise(tops, "merkle-subroots"), ["key"], "merkle-top"), fanout, "merkle-top")
    ends = top_paths.join(roots.select("g", F.col("h").alias("root")), "g")
    ends = materialise(ends.select(F.col("item.g").alias("g"), F.col("h").alias("subroot"), "root", F.col("path").alias("rest")), "merkle-ends")
    found = paths.join(ends, "g")
    return found.select("item.*", hex_text(F.col("subroot")).alias("subroot"), hex_text(F.col("root")).alias("root"), F.concat("path", "rest").alias("path"))
