"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `virtual` points of the ring. A row belongs to the first point clockwise of the hash of its
id. A shard may hold the row count divided by the shards, rounded down or up so that the bounds add up to all
rows. Rows that find their shard full continue clockwise to the next point of a shard that has room, so the
shards' row counts differ by one at most, and only the surplus of crowded shards leaves its place.

This runs in rounds. In each, the rows still without a place go to their points on the ring of the shards
with room; a shard takes rows in the order of a second hash until it is full, and the rest go into the next
round. A round places all rows or fills a shard, so there are no more rounds than shards, and each after the
first sees the surplus alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import fresh, materialise

#: Rows of one cell on average; a cell is the unit in which rows are ranked.
CELL_ROWS = 2_000
_BUCKET_BITS = 12


def _points(spark: SparkSession, shards: int, virtual: int) -> DataFrame:
    """The ring: (shard, node, at), one row for each virtual node."""
    rows = spark.range(shards * virtual).select(
        (F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).cast("int").alias("node")
    )
    return rows.withColumn("at", F.xxhash64(F.lit("virtual node"), "shard", "node"))


def _arcs(points: DataFrame) -> DataFrame:
    """(shard, low, high, open, bucket): the arc (low, high] of each point, once for each bucket it meets.

    The first point also owns what lies beyond the last; an open arc includes its low end.
    """
    order = Window.orderBy("at", "shard", "node")
    ring = points.select(
        "*", (F.row_number().over(order) - 1).alias("point"), F.lag("at").over(order).alias("low"),
        F.max("at").over(Window.partitionBy()).alias("last"),
    )
    least, most = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
    plain = ring.select("shard", F.coalesce("low", least).alias("low"), F.col("at").alias("high"), F.col("low").isNull().alias("open"))
    beyond = ring.filter("point = 0").select("shard", F.col("last").alias("low"), most.alias("high"), F.lit(False).alias("open"))
    arcs = plain.unionAll(beyond)
    return arcs.withColumn("bucket", F.explode(F.sequence(_bucket("low"), _bucket("high"))))


def _bucket(name: str):
    return F.shiftright(F.col(name), 64 - _BUCKET_BITS)


def assign_shards(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", virtual: int = 128
) -> DataFrame:
    """docs with shard (0 .. shards-1) and slot (gapless from 0 in each shard).

    The hash is of the id; rows without id are spread by their text, null texts included. Rows equal in id
    share a place of the ring and may part where their shard is full; rows equal in all columns are
    interchangeable. An empty table gives an empty result; with fewer rows than shards, some shards stay
    empty. Other columns pass through (a column of docs named shard or slot is replaced).
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    total = docs.count()
    bounds = {s: total // shards + (s < total % shards) for s in range(shards)}
    room = dict(bounds)
    bits = max(0, (total // (shards * CELL_ROWS)).bit_length())
    at, turn, fits = fresh(docs, "ring_at", "ring_turn", "ring_fits")
    id_ = F.col(id_col)
    hashable = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    pending = docs.withColumns(
        {
            at: F.when(id_.isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(id_.cast("string"))),
            # the order in which a full shard takes rows; rows equal in it are equal in every column
            turn: F.xxhash64(F.lit("turn"), *hashable),
        }
    )
    points = _points(spark, shards, virtual)
    out = None
    while True:
        open_shards = [s for s in room if room[s]] or list(room)
        placed, demand = _place(pending, points.filter(F.col("shard").isin(open_shards)), at, turn, bits)
        shard_room, taken = (F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col("shard")) for m in (room, {s: bounds[s] - room[s] for s in room}))
        # written once, so that what is kept and what goes on are of one ranking
        sized = materialise(placed.withColumn("slot", F.col("slot") + taken).withColumn(fits, F.col("slot") < taken + shard_room), "shard-round")
        kept = sized.filter(F.col(fits)).drop(fits)
        out = kept if out is None else out.unionByName(kept)
        over = {s: max(0, demand.get(s, 0) - room[s]) for s in room}
        room = {s: max(0, room[s] - demand.get(s, 0)) for s in room}
        if not any(over.values()):
            return out.drop(at, turn)
        pending = sized.filter(~F.col(fits)).drop("shard", "slot", fits)
        bits = max(0, (sum(over.values()) // (shards * CELL_ROWS)).bit_length())


def _place(rows: DataFrame, points: DataFrame, at: str, turn: str, bits: int) -> tuple[DataFrame, dict[int, int]]:
    """rows with shard and slot, their 0-based rank in it by turn; and the rows of each shard.

    Ranks are taken in cells of some CELL_ROWS rows, and cells are counted before; no task ranks a whole shard.
    """
    arcs = _arcs(points).select(*[F.col(c).alias(f"arc_{c}") for c in ("shard", "bucket", "low", "high", "open")])
    names = {c: n for c, n in zip(arcs.columns, fresh(rows, *arcs.columns), strict=True)}
    shard, bucket, low, high, is_open = names.values()
    # shards * virtual points and at most 2^12 more pieces: a fixed number of rows
    inside = (F.shiftright(F.col(at), 64 - _BUCKET_BITS) == F.col(bucket)) & (F.col(at) <= F.col(high)) & ((F.col(at) > F.col(low)) | F.col(is_open))
    placed = rows.join(F.broadcast(arcs.withColumnsRenamed(names)), inside).drop(bucket, low, high, is_open)
    cell, rank, s, c, start = fresh(placed, "ring_cell", "ring_rank", "ring_s", "ring_c", "ring_start")
    placed = placed.withColumn(cell, F.shiftright(F.col(turn), 64 - bits) if bits else F.lit(0).cast("long"))
    sizes = materialise(placed.groupBy(F.col(shard).alias(s), F.col(cell).alias(c)).agg(F.count("*").alias("n")), "shard-cells")
    before = Window.partitionBy(s).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(s, c, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    demand = {r[0]: r[1] for r in sizes.groupBy(s).agg(F.sum("n")).collect()}
    ranked = placed.withColumn(rank, F.row_number().over(Window.partitionBy(shard, cell).orderBy(turn, at)))
    joined = ranked.join(starts, (F.col(shard) == F.col(s)) & (F.col(cell) == F.col(c)))
    out = joined.withColumns({"shard": F.col(shard), "slot": F.col(start) + F.col(rank) - 1})
    return out.drop(shard, cell, rank, s, c, start), demand
