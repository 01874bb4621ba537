"""Product codes of integer vectors, with codebooks trained by rounds of assignment and averaging.

A vector's components become floor(scale * x), and the vector is cut into equal consecutive parts. Each part takes the index
of the nearest entry of its position's codebook, by squared Euclidean distance, the lower index of equals.

The nearest entry is found by equal-average search. Entries are sorted by the sum of their components. By Cauchy and
Schwarz, the squared gap between the sums of a part and an entry is at most the part's dimension times their squared distance.
So the search starts at the part's own sum and goes outward, always to the side of the smaller gap, until the squared gap over
the dimension strictly exceeds the best distance so far: no entry further out is nearer or as near. All is whole numbers,
so results do not depend on how rows are dealt out.

Each round reads the vectors once. A task adds up its rows' parts by entry, and these sums, of a fixed number a
task, are what is shuffled and what reaches the driver once added up; so do the codebooks on the way back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..session import ship_package
from .shared import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
_UNSEEN = (1 << 63) - 1


def limit(dim: int, parts: int = PARTS) -> int:
    """Above which magnitude of components squared gaps or a vector's error might not fit 64 bits."""
    return int(2**30.5 / max(dim // parts, dim**0.5))


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of points the index of its nearest entry and the squared distance; ties to the lower index."""
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, ranked = sums[order], entries[order]
    own, dim = points.sum(axis=1), points.shape[1]
    right = np.searchsorted(sums, own)
    left = right - 1
    code, best = np.zeros(len(points), np.int64), np.full(len(points), _UNSEEN)
    live = np.arange(len(points) if len(entries) else 0)
    while len(live):
        a, z, s = left[live], right[live], own[live]
        below = np.where(a >= 0, s - sums[np.maximum(a, 0)], _UNSEEN)
        above = np.where(z < len(sums), sums[np.minimum(z, len(sums) - 1)] - s, _UNSEEN)
        gap = np.minimum(below, above)
        # a gap as large as _UNSEEN: both sides are used up
        more = gap != _UNSEEN
        more[more] = gap[more] ** 2 <= np.minimum(best[live[more]], _UNSEEN // dim) * dim
        live, down = live[more], (below <= above)[more]
        at = np.where(down, left[live], right[live])
        found, distance = order[at], ((points[live] - ranked[at]) ** 2).sum(axis=1)
        better = (distance < best[live]) | ((distance == best[live]) & (found < code[live]))
        best[live[better]], code[live[better]] = distance[better], found[better]
        left[live[down]] -= 1
        right[live[~down]] += 1
    return code, best


def _parts(column: pa.Array, dim: int, parts: int) -> np.ndarray:
    """(rows, parts, dim / parts) of an Arrow column of vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), parts, dim // parts)


def usable(vector: Column, parts: int = PARTS) -> Column:
    """Whether a vector is there, has a length that can be cut, and holds finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & (F.size(vector) % parts == 0) & finite, F.lit(False))


def whole(vectors: DataFrame, vector_col: str, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """The usable rows, with vector_col as floor(scale * x)."""
    exact = F.transform(F.col(vector_col), lambda x: F.floor(scale * x.cast("double")).cast("long"))
    return vectors.filter(usable(F.col(vector_col).cast("array<double>"), parts)).withColumn(vector_col, exact)


def train(rows: DataFrame, id_col: str, vector_col: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts, entries, dim / parts) of whole() rows, or None without rows.

    They start as the parts of the `entries` smallest ids' vectors, null ids last, repeated ids by their vectors; fewer rows give
    fewer entries. The length of the first of these is the one that all coded vectors have.
    """
    start = [r[0] for r in rows.select(vector_col).orderBy(F.col(id_col).asc_nulls_last(), vector_col).limit(entries).collect()]
    if not start:
        return None
    dim = len(start[0])
    books = np.array([v for v in start if len(v) == dim], np.int64).reshape(-1, parts, dim // parts).transpose(1, 0, 2)
    vectors = rows.filter(F.size(vector_col) == dim).select(F.col(vector_col).alias("v"))
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(books)

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            books = shared.value
            totals, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                points = _parts(batch.column(0), dim, parts)
                _check(points, dim, parts)
                for p in range(parts):
                    code, _ = nearest(points[:, p], books[p])
                    np.add.at(totals[p], code, points[:, p])
                    counts[p] += np.bincount(code, minlength=len(counts[p]))
            p, e = np.nonzero(counts)
            each = totals.shape[2]
            columns = [np.repeat(p, each), np.repeat(e, each), np.tile(np.arange(each), len(p)), totals[p, e].ravel(), np.repeat(counts[p, e], each)]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "at", "total", "n"])

        summed = vectors.mapInArrow(add, "part long, entry long, at long, total long, n long").groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        got = np.array([tuple(r) for r in summed.collect()], np.int64).reshape(-1, 5)
        books = books.copy()
        books[got[:, 0], got[:, 1], got[:, 2]] = got[:, 3] // got[:, 4]
    return books


def _check(points: np.ndarray, dim: int, parts: int) -> None:
    if points.size and max(points.max(), -points.min()) > limit(dim, parts):
        raise EngineError(f"a component's magnitude is over {limit(dim, parts)}")


def encode(rows: DataFrame, books: np.ndarray, vector_col: str) -> DataFrame:
    """rows of the codebooks' length with code (two hex digits a part) and error in place of vector_col; other columns stay, and
    those named code or error are replaced."""
    parts, _, each = books.shape
    dim = parts * each
    shared = rows.sparkSession.sparkContext.broadcast(books)
    kept = [c for c in rows.columns if c not in (vector_col, "code", "error")]
    given = rows.filter(F.size(vector_col) == dim).select(*[F.col(f"`{c}`") for c in kept], F.col(vector_col).alias("vector_col_"))
    shape = given.drop("vector_col_").withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            points = _parts(batch.column(len(kept)), dim, parts)
            _check(points, dim, parts)
            codes, error = np.zeros((len(points), parts), np.uint8), np.zeros(len(points), np.int64)
            for p in range(parts):
                code, distance = nearest(points[:, p], books[p])
                codes[:, p] = code
                error += distance
            columns = [*batch.columns[: len(kept)], pa.array([row.tobytes().hex() for row in codes], pa.string()), pa.array(error)]
            yield pa.record_batch(columns, [*kept, "code", "error"])

    return given.mapInArrow(run, shape)


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for, in whole numbers."""
    return np.concatenate([books[p][e] for p, e in enumerate(bytes.fromhex(code))])


def books_sha256(books: np.ndarray) -> str:
    """Of all components in decimals, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """vectors with code, error, label_error (error summed over equal labels, null being one) and codebooks_sha256 in place of vector_col.

    Rows go whose vector is null, empty, of a length that parts do not divide, holds null or non-finite components, or is not as
    long as that of the smallest id left. Repeated rows are coded each. Without rows the result is empty. A
    component too large for 64-bit sums (see limit) is an error. At most 256 entries.
    """
    if not 0 < entries <= 256:
        raise EngineError("codebooks have 1 to 256 entries")
    ship_package(vectors.sparkSession)
    vectors = vectors.drop(*[c for c in ("code", "error", "label_error", "codebooks_sha256") if c not in (id_col, vector_col, label_col)])
    rows = whole(vectors, vector_col, parts)
    books = train(rows, id_col, vector_col, parts, entries, rounds)
    if books is None:
        rest = rows.drop(vector_col)
        return rest.select("*", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
    coded = materialise(encode(rows, books, vector_col), "vector-codes")
    # written, so that Spark knows the size when it chooses the join
    sums = materialise(coded.groupBy(F.col(label_col).alias("label_")).agg(F.sum("error").alias("label_error")), "vector-labels")
    joined = coded.join(sums, F.col(label_col).eqNullSafe(F.col("label_"))).drop("label_")
    return joined.withColumn("codebooks_sha256", F.lit(books_sha256(books)))
