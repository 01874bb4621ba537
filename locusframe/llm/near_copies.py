"""Near copies by the exact rule: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

First come SimHash and its vantage-point tree (simhash.py): each set has a fingerprint, the tree finds those within a few bits, and
the pairs that are similar by whole sets are links. Similar sets differ by up to 16 bits or so, a radius at which no tree over 64 bits
can prune, so the tree's links are a beginning, and the rest is found exactly by prefixes: under any one order of all shingles, two sets
that are so similar share a shingle among their first n - ceil(0.8 n) + 1, so no pair is missed. The order puts shingles that are
frequent in a share of the rows last, which only makes the groups small. What the tree has joined is not compared again.

Texts that have a shingle in their prefixes are a group. A group is never gathered: its members are rows, dealt by shingle and salt, and
meet rows of some members taken as centres. Two members need no comparison once links join them, so all pairs that matter have an
end outside the largest joined part. Where few members lie outside, all of these are centres, and the group is done; else some of
them are, and the next round takes those that are still outside and more centres. Large groups go first, so that near copies of one
text are joined by a few centres, and neither they nor the small groups that they share become all pairs.

Sets differ in no fewer shingles than the parities of their shingles' buckets do. A member row carries 256
parities, whatever its text's length; pairs within bounds are made different, then compared by a bit a shingle, and only
what is left meets whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_package
from ..storage import discard
from .shared import fresh, materialise, text_key
from .simhash import components, linked_pairs, majority

SHINGLE = 5
#: Bits within which the tree looks for similar sets. Each bit more makes it deal more rows and compare more of them; results do not
#: depend on it.
RADIUS = 3
#: Of which share of the rows, and of how many at least, shingles are counted, and from which count on one is put last; how
#: many are put last at most. Results do not depend on any of these.
ORDER_SHARE, ORDER_SAMPLE = 1 / 32, 5_000
_FREQUENT, _MOST_FREQUENT = 3, 200_000
#: Centres of a group in the first round, if it has more than twice as many members outside its largest part; smaller groups wait for
#: the second. In each further round there are so many times more. Members of one salt of a group.
CENTRES, _FACTOR, SALT_ROWS = 4, 64, 4_096
#: Up to how many shingles in both sets the sketch alone decides whether whole sets are compared.
_SHORT = 1_024
#: 64-bit words of bucket parities at least, how many shared shingles before its own a member row holds, and up to how many sets are
#: looked up by broadcast.
_PARITY, _BEFORE, _BROADCAST_SETS = 4, 3, 1_000_000
#: Texts whose sets a Python worker holds at once, at most.
_BATCH, _BATCH_KEY = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None) -> np.ndarray:
    """The different shingles' hashes, sorted; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.int64)
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, 5)], np.uint64).view(np.int64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], 5) for a, b in spans], np.uint64).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 0.8 or more, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def prefix(found: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order: those not among the known ones first, then by rank."""
    if not len(found):
        return found
    at = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
    place = np.where(known[at] == found, rank[at], -1) if len(known) else np.full(len(found), -1)
    return found[np.lexsort((found, place))][: len(found) - (4 * len(found) + 4) // 5 + 1]


def parities(found: np.ndarray) -> np.ndarray:
    """For each bucket of hashes whether an odd number of the shingles falls in it, as bits: a power of two of buckets, one
    for each shingle at least."""
    words = max(_PARITY, 1 << (-(-len(found) // 64) - 1).bit_length())
    odd = np.bincount(found & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def sketch(found: np.ndarray) -> np.ndarray:
    """The parities of a set, folded to the least width."""
    return np.bitwise_xor.reduce(parities(found).reshape(-1, _PARITY), axis=0)


def apart(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """In how many parities a set and each row of others, of one width, differ; wider ones are folded, as a bucket of half
    as many is the sum of two. The sets themselves differ in as many shingles at least."""
    while len(one) > others.shape[1]:
        one = one[: len(one) // 2] ^ one[len(one) // 2 :]
    while others.shape[1] > len(one):
        half = others.shape[1] // 2
        others = others[:, :half] ^ others[:, half:]
    return np.bitwise_count(others ^ one).sum(axis=1, dtype=np.int64)


def frequent(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a sample, sorted, and the rank of each by its count."""

    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(shingles)

    cut = -(1 << 63) + int((1 << 64) * min(1.0, max(ORDER_SHARE, ORDER_SAMPLE / max(1, docs.count())))) - 1
    sample = docs.select(F.col(text_col).alias("text")).filter(F.xxhash64("text") <= cut)
    counts = sample.select(F.explode(run("text")).alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= _FREQUENT)
    top = counts.orderBy(F.desc("n"), "h").limit(_MOST_FREQUENT).toPandas().sort_values("h")
    h, n = top["h"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, n))] = np.arange(len(h))
    return h, rank


def _confirmed(pairs: DataFrame, points: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar. Only their sets are made again, from texts: (id, th, text).

    Of a set's texts the least is read, not all its copies. Pairs far apart in their parities, a bit a shingle, go before sets
    meet; sets are compared a row at a time, so that a task holds two of them however long the texts are.
    """

    @F.pandas_udf("found array<long>, bits array<long>")
    def again(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t) for t in texts]
        return pd.DataFrame({"found": sets, "bits": [parities(s) for s in sets]})

    @F.pandas_udf("boolean")
    def within(n: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([9 * apart(x.view(np.uint64), y.view(np.uint64)[None])[0] <= k for k, x, y in zip(n, a, b, strict=True)], dtype=bool)

    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    ends = materialise(ends.join(points.select("sid", "least.id", "least.th"), "sid").select("sid", F.col("id").alias("own"), "th"), "near-ends")
    sought = F.broadcast(ends) if ends.count() <= _BROADCAST_SETS else ends
    rows = texts.join(sought, "th").filter(F.col("id").eqNullSafe(F.col("own"))).dropDuplicates(["sid"]).select("sid", again("text").alias("s"))
    sets = materialise(rows.select("sid", F.size("s.found").alias("n"), "s.found", "s.bits"), "near-sought")

    def ends_of(found: DataFrame, column: str) -> DataFrame:
        one = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col(column).alias("xa"))
        two = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col(column).alias("xb"))
        return found.join(one, "a").join(two, "b")

    size = sets.select("sid", "n")
    sized = pairs.join(size.withColumnsRenamed({"sid": "a", "n": "na"}), "a").join(size.withColumnsRenamed({"sid": "b", "n": "nb"}), "b")
    # of small sets the sketch has a bit for each few shingles, and has been compared
    long = ends_of(sized.filter(F.col("na") + F.col("nb") > _SHORT).select("a", "b"), "bits").filter(within(F.col("na") + F.col("nb"), "xa", "xb"))
    near = materialise(sized.filter(F.col("na") + F.col("nb") <= _SHORT).select("a", "b").unionAll(long.select("a", "b")), "near-within")
    both = F.size(F.array_intersect("xa", "xb"))
    # 5 * both >= 4 * (na + nb - both)
    found = materialise(ends_of(near, "found").filter(9 * both >= 4 * (F.col("na") + F.col("nb"))).select("a", "b"), "near-links")
    discard(ends, sets, near)
    return found


def tree_pairs(points: DataFrame) -> DataFrame:
    """Different pairs (a, b) of sets whose fingerprints the tree finds within RADIUS bits, not yet compared by their sets; points: (sid, fp).

    Sets of one fingerprint meet the least of them, and that one meets the least neighbour of its fingerprint in each shard: some pairs a
    set, however many are near each other.
    """
    firsts = materialise(points.groupBy("fp").agg(F.min("sid").alias("sid")), "near-fingerprints")
    same = points.select("fp", F.col("sid").alias("b")).join(firsts.withColumnRenamed("sid", "a"), "fp").filter("a <> b").select("a", "b")
    edges = linked_pairs(firsts.select("fp"), RADIUS, direct=True).withColumnsRenamed({"a": "fa", "b": "fb"})
    ends = [firsts.withColumnsRenamed({"fp": f"f{x}", "sid": x}) for x in "ab"]
    near = edges.join(ends[0], "fa").join(ends[1], "fb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return same.unionAll(near)


def _members(points: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each text and prefix shingle that another text has too: (h, i, sid, n, s, root, major, others, size).

    i: h's place in the prefix. root: the text's part, by labels or itself. major: a part of h's group, others: how many
    members lie outside at most, size: of the group. Only numbers of a shingle and a text are dealt by shingle.
    """

    def rooted(rows: DataFrame, column: str, to: str) -> DataFrame:
        known = labels.select(F.col("fp").alias(column), F.col("root").alias("known"))
        return rows.join(known, column, "left").withColumn(to, F.coalesce("known", column)).drop("known")

    postings = points.select("sid", F.posexplode("p").alias("i", "h"))
    sizes = postings.groupBy("h").agg(F.count("*").alias("size"), F.max("sid").alias("major")).filter("size > 1")
    shared = postings.join(materialise(rooted(sizes, "major", "major"), "near-groups"), "h")
    joined = shared.join(rooted(points.select("sid", "n", "s"), "sid", "root"), "sid")
    return joined.select("h", "i", "sid", "n", "s", "root", "major", (F.col("size") - 1).alias("others"), "size")


def _regrouped(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members with their roots of now, of groups that still have more than one part."""
    rows = members.drop("root", "major", "others").join(labels.withColumnRenamed("fp", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    counts = rows.groupBy("h", "root").agg(F.count("*").alias("k")).groupBy("h").agg(F.max(F.struct("k", "root")).alias("most"), F.sum("k").alias("all"))
    groups = counts.select("h", F.col("most.root").alias("major"), (F.col("all") - F.col("most.k")).alias("others")).filter("others > 0")
    return rows.join(groups, "h").select("h", "i", "sid", "n", "s", "root", "major", "others", "size")


def _candidates(members: DataFrame, step: int, turn: int) -> DataFrame:
    """Different pairs (a, b) of members of a group that may be similar and are not joined, one of which is a centre.

    q: the last few of the given shingles of the same text before h. Two members that have one of them in common meet in its group, so
    that most pairs come up once and not once for each common shingle.
    """
    # the rows of a text, as many as its prefix has shingles at most
    own = Window.partitionBy("sid").orderBy("i").rowsBetween(-_BEFORE, -1)
    members = members.withColumn("q", F.collect_list("h").over(own)).drop("i")
    outside = members.filter("root <> major")
    key = F.xxhash64("sid", F.lit(turn))
    some = outside.filter(F.col("others") > 2 * step).groupBy("h", F.pmod(key, F.lit(step)).alias("bucket"))
    some = some.agg(F.min(F.struct(key.alias("key"), "sid", "n", "s", "q", "root", "size")).alias("c")).select("h", "c.*").drop("key")
    centres = outside.filter(F.col("others") <= 2 * step).select("h", *some.columns[1:]).unionByName(some)
    salts = F.floor(F.col("size") / SALT_ROWS)
    centres = centres.select("h", F.explode(F.sequence(F.lit(0).cast("long"), salts)).alias("salt"), *[F.col(c).alias(f"c{c}") for c in ("sid", "n", "s", "q", "root")])
    met = members.withColumn("salt", F.pmod(F.xxhash64("sid"), salts + 1)).join(centres, ["h", "salt"])
    differ = sum((F.bit_count(F.col("s")[k].bitwiseXOR(F.col("cs")[k])) for k in range(_PARITY)), F.lit(0))
    n, m = F.col("n"), F.col("cn")
    # of two centres one meets the other; where the pair has met by an earlier shingle, it is known
    once = (F.col("root") == F.col("major")) | (F.col("others") > 2 * step) | (F.col("sid") < F.col("csid"))
    fits = (F.col("root") != F.col("croot")) & (5 * n >= 4 * m) & (5 * m >= 4 * n) & (9 * differ <= n + m) & once & ~F.arrays_overlap("q", "cq")
    return met.filter(fits).select(F.least("sid", "csid").alias("a"), F.greatest("sid", "csid").alias("b")).distinct()


def linked(points: DataFrame, texts: DataFrame) -> DataFrame:
    """(fp, root) of each set that is similar to another; points: (sid, fp, n, s, p, least), different sids.

    The tree's links come first, then those by prefixes. A group of any size is spread over tasks by salt; a round adds at most CENTRES, then _FACTOR times as many centres a group, and
    the rounds end when no group has more members outside its largest part than there were centres. Tables of a round go with it.
    """
    tree = materialise(tree_pairs(points), "near-tree")
    edges = _confirmed(tree, points, texts)
    labels = components(edges)
    discard(tree)
    members = materialise(_members(points, labels), "near-members")
    step, turn = CENTRES, 0
    while True:
        large = members.filter(F.col("others") > 2 * step)
        last = large.isEmpty()
        # small groups of near copies mostly vanish once the large ones are joined
        pairs = materialise(_candidates(large if not turn and not last else members, step, turn), "near-pairs")
        edges = edges.unionAll(_confirmed(pairs, points, texts))
        labels = components(edges)
        if last:
            return labels
        left = materialise(_regrouped(members if not turn else large, labels), "near-members")
        discard(pairs, members)
        members, step, turn = left, step * _FACTOR, turn + 1
        if members.isEmpty():
            return labels


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Python workers get at most _BATCH rows at once from the jobs within; the session's own number comes back after them."""
    before = spark.conf.get(_BATCH_KEY)
    if not 0 < int(before) <= _BATCH:
        spark.conf.set(_BATCH_KEY, _BATCH)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_KEY, before)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies, columns unchanged.

    Links chain. Null, empty and blank texts are one group, as are texts of equal sets. The row of the least
    id and then text hash stays, rows without id after all others; of rows equal in id and text the first.
    """
    with _small_batches(docs.sparkSession):
        return _drop_near_copies(docs, id_col, text_col)


def _drop_near_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, text_col))

    @F.pandas_udf("sid long, fp long, n long, s array<long>, p array<long>")
    def describe(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t) for t in texts]
        rows = [(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63), majority(s), len(s), sketch(s), prefix(s, *shared.value)) for s in sets]
        return pd.DataFrame(rows, columns=["sid", "fp", "n", "s", "p"])

    i, none, t = fresh(docs, "near_id", "near_none", "near_th")
    keys = {i: F.coalesce(F.col(id_col).cast("string"), F.lit("")), none: F.col(id_col).isNull(), t: text_key(F.col(text_col))}
    described = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("th"), describe(F.col(text_col)).alias("d"))
    rows = materialise(described.select("id", "th", "d.*"), "near-sets")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("th").alias("th"))
    points = materialise(rows.groupBy("sid").agg(F.min(order).alias("least"), *[F.first(c).alias(c) for c in ("fp", "n", "s", "p")]), "near-points")
    discard(rows)
    roots = linked(points, docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("th"), F.col(text_col).alias("text")))
    grouped = points.select("sid", "least").join(roots.withColumnRenamed("fp", "sid"), "sid", "left").groupBy(F.coalesce("root", "sid").alias("root"))
    kept = grouped.agg(F.min("least").alias("r")).select(F.coalesce(F.col("r.id").cast("string"), F.lit("")).alias(i), F.col("r.none").alias(none), F.col("r.th").alias(t))
    return docs.withColumns(keys).dropDuplicates([i, none, t]).join(kept, [i, none, t]).select(docs.columns)
