"""Binary matrices: genotypes, pair matrices, correlation rows and eigen blocks.

A task opens the file and reads the byte ranges of its own rows only, so a file of any size is read in
parallel and none passes through the driver.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..session import ship_package
from ..storage import materialise

BED_MAGIC = b"\x6c\x1b\x01"
#: Sparse pair matrix with a three-word header.
SPARSE_3F = 0x40400000
#: Entries of correlation rows in one Arrow batch.
ENTRIES = 200_000
_CODES = np.array([2, -1, 1, 0], np.int8)
_DECODED = _CODES[(np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3]


def open_file(path: str):
    """A random-access file in any store that pyarrow knows."""
    if "://" not in path and not path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem().open_input_file(path)
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(at)


def file_exists(path: str) -> bool:
    try:
        open_file(path).close()
    except FileNotFoundError:
        return False
    return True


def decode_bed(raw: bytes, people: int) -> np.ndarray:
    """Dosages of one variant, -1 where missing."""
    return _DECODED[np.frombuffer(raw, np.uint8)].ravel()[:people]


def dosage_array(raw: bytes, variants: int, people: int, keep: np.ndarray | list[int] | None = None) -> pa.ListArray:
    """Packed variants as Arrow lists of dosages, null where missing, of all or the kept people."""
    g = _DECODED[np.frombuffer(raw, np.uint8)].reshape(variants, -1)[:, :people]
    g = np.ascontiguousarray(g if keep is None else g[:, keep])
    flat = g.ravel()
    offsets = np.arange(variants + 1, dtype=np.int32) * g.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int8(), mask=flat < 0))


def read_bed(path: str, variants: DataFrame, people: int, keep: list[int] | None = None) -> DataFrame:
    """A3: variants (snp, file_idx, any more) with dosage, an array with null for missing, of all or the kept people."""
    ship_package(variants.sparkSession)
    with open_file(path) as file:
        if file.read(3) != BED_MAGIC:
            raise EngineError(f"{path} is not a variant-major genotype file")
    width = -(-people // 4)
    # variants read together, so that their dosages stay some megabytes
    most = max(1, (4 << 20) // max(1, people))
    schema = T.StructType([*variants.schema, T.StructField("dosage", T.ArrayType(T.ByteType()))])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open_file(path) as file:
            for rows in batches:
                for at in range(0, len(rows), most):
                    some = rows.slice(at, most)
                    raw = []
                    for k in some.column("file_idx").to_pylist():
                        file.seek(3 + k * width)
                        raw.append(file.read(width))
                    dosage = dosage_array(b"".join(raw), len(some), people, keep)
                    yield pa.record_batch([*some.columns, dosage], schema.names)

    return variants.repartitionByRange("file_idx").sortWithinPartitions("file_idx").mapInArrow(load, schema)


def genotype_stats(genotypes: DataFrame, scale: bool = True) -> DataFrame:
    """A3: af, twopq, the imputed and centred genotype (scaled by sqrt(2pq)) and its sum of squares."""
    known = F.filter("dosage", lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    rows = genotypes.withColumn("mean", mean).withColumn("af", F.col("mean") / 2).withColumn("twopq", 2 * F.col("af") * (1 - F.col("af")))
    unit = F.sqrt("twopq") if scale else F.lit(1.0)
    z = F.transform("dosage", lambda x: F.coalesce(x - F.col("mean"), F.lit(0.0)) / unit)
    rows = rows.withColumn("z", z)
    return rows.withColumn("sum_squares", F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x)).drop("mean")


def cis_genotypes(genotypes: DataFrame, pairs: DataFrame) -> DataFrame:
    """A4: genotypes of variants that a gene has, without monomorphic ones."""
    kept = genotypes.join(pairs.select("snp").distinct(), "snp", "left_semi")
    return kept.filter((F.array_max("dosage") != F.array_min("dosage")) & (F.array_max("dosage") > 0))


def besd_layout(path: str) -> tuple[str, int]:
    """Kind ("sparse" or "dense") of a pair matrix and the bytes before its data, from the header alone."""
    with open_file(path) as file:
        kind = struct.unpack("<I", file.read(4))[0]
        if kind in (0, 5):
            return "dense", 4 if kind == 0 else 4 + 60
        if kind not in (SPARSE_3F, 3):
            raise EngineError(f"{path}: unknown type {kind:#x}")
        at = 4 if kind == SPARSE_3F else 4 + 60
        file.seek(at)
        head = file.read(16)
    if len(head) < 16 or struct.unpack("<2Q", head)[1] != 0:
        raise EngineError(f"{path}: column offsets do not start at 0")
    return "sparse", at + 8


def read_besd(spark: SparkSession, path: str, esi: DataFrame, epi: DataFrame, missing: float = -9.0) -> DataFrame:
    """(gene_id, snp, beta, se); pairs whose se is missing go. esi and epi give the file's order in ord.

    The pairs come from the locus_besd source, a partition for some megabytes of columns.
    """
    from ..operators.filters import reindex
    from .datasource import register

    register(spark)
    genes = reindex(epi, "ord", name="gene_idx").select(F.col("gene_idx").cast("long").alias("gene_idx"), "gene_id")
    variants = reindex(esi, "ord", name="row").select("snp", F.col("row").cast("long").alias("row"))
    pairs = spark.read.format("locus_besd").option("genes", epi.count()).option("missing", missing).load(path)
    return pairs.drop("gene_id").join(genes, "gene_idx").join(variants, "row").select("gene_id", "snp", "beta", "se")


def ld_row_places(info: DataFrame, sparse: bool = False) -> DataFrame:
    """info (shard, idx, window_size) with byte_at, where each row begins in its shard's file."""
    from ..operators.filters import running_sum

    size = F.col("window_size") * (12 if sparse else 8)
    placed = running_sum(info, ("shard", "idx"), size, "byte_at")
    starts = placed.groupBy("shard").agg(F.min("byte_at").alias("__first"))
    return placed.join(F.broadcast(starts), "shard").withColumn("byte_at", F.col("byte_at") - F.col("__first")).drop("__first")


def read_ld_rows(info: DataFrame, sparse: bool = False) -> DataFrame:
    """(shard, i, j, r) of correlation files. info: shard, idx, window_start, window_size, byte_at and path of each row.

    Dense rows hold window_size doubles from column window_start on; sparse ones window_size column numbers
    (u32) and then as many doubles. Rows are dealt by file and place, and a task reads its own rows only.
    """
    ship_package(info.sparkSession)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_hand, file, held, n = None, None, [], 0

        def batch() -> pa.RecordBatch:
            shard, i, j, r = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.record_batch([pa.array(shard, pa.int32()), pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(r)], ["shard", "i", "j", "r"])

        for rows in batches:
            for shard, path, i, first, size, at in zip(*[rows.column(c).to_pylist() for c in ("shard", "path", "idx", "window_start", "window_size", "byte_at")], strict=True):
                if path != at_hand:
                    at_hand, file = path, open_file(path)
                file.seek(at)
                j = np.frombuffer(file.read(4 * size), "<u4").astype(np.int64) if sparse else np.arange(first, first + size)
                held.append((np.full(size, shard), np.full(size, i), j, np.frombuffer(file.read(8 * size), "<f8")))
                n += size
                # some rows of the matrix make a batch
                if n >= ENTRIES:
                    yield batch()
                    held, n = [], 0
        if held:
            yield batch()

    wanted = info.select("shard", "path", "idx", "window_start", "window_size", "byte_at")
    dealt = wanted.repartitionByRange("path", "byte_at").sortWithinPartitions("path", "byte_at")
    return dealt.mapInArrow(load, "shard int, i long, j long, r double")


def read_ld_set(spark: SparkSession, prefixes: list[str], sparse: bool | None = None, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(info, ld) of one correlation set or several shards in order; prefixes end in .ldm.<type>.

    Shards whose own numbers begin at 0 again are moved behind those before them. keep (snp) restricts rows and columns;
    idx is then dense anew, and in either case ld_sum, ldsc, sampling_var, diag, window_start, window_end and window_size
    are those of the entries that are left. A mean of the diagonal outside 0.8 to 1.2 is an error.
    """
    from ..operators.filters import reindex
    from .text import read_ld_info

    sparse = prefixes[0].endswith(".sparse") if sparse is None else sparse
    number = F.create_map(*[F.lit(v) for k, p in enumerate(prefixes) for v in (p.rsplit("/", 1)[-1] + ".info", k)])
    paths = F.array(*[F.lit(p + ".bin") for p in prefixes])
    info = read_ld_info(spark, *[p + ".info" for p in prefixes])
    info = info.withColumn("shard", F.try_element_at(number, F.element_at(F.split("file_path", "/"), -1)).cast("int")).withColumn("path", F.get(paths, F.col("shard")))
    info = materialise(info, "ld-info")
    # one row a shard
    shards = {r.shard: (r.n, r.first) for r in info.groupBy("shard").agg(F.count("*").alias("n"), F.min("idx").alias("first")).collect()}
    again = len(shards) > 1 and shards[1][1] == 0
    offsets = [sum(shards[q][0] for q in range(k)) if again else 0 for k in range(len(shards))]
    ahead = F.get(F.array(*[F.lit(v) for v in offsets]).cast("array<bigint>"), F.col("shard"))
    rows = read_ld_rows(ld_row_places(info, sparse), sparse)
    ld = rows.select((F.col("i") + ahead).alias("i"), (F.col("j") + ahead).alias("j"), "r")
    info = info.withColumn("idx", F.col("idx") + ahead).drop("window_start", "window_end", "window_size", "sampling_var", "ld_sum", "file_path", "path", "shard", "ord")
    if keep is not None:
        info = reindex(info.join(keep.select("snp").distinct(), "snp", "left_semi"), "idx", name="new_idx")
        for end in ("i", "j"):
            ld = ld.join(info.select(F.col("idx").alias(end), F.col("new_idx").alias(f"new_{end}")), end)
        ld = ld.select(F.col("new_i").alias("i"), F.col("new_j").alias("j"), "r")
        info = info.drop("idx").withColumnRenamed("new_idx", "idx")
    ld = materialise(ld, "ld-entries")
    r2 = F.col("r") * F.col("r")
    stats = ld.join(info.select(F.col("idx").alias("i"), "n"), "i").groupBy(F.col("i").alias("idx")).agg(
        F.min("j").alias("window_start"), F.max("j").alias("window_end"), F.count("*").alias("window_size"), F.sum("r").alias("ld_sum"), F.sum(r2).alias("ldsc"),
        F.sum((1 - r2) * (1 - r2) / F.col("n")).alias("sampling_var"), F.sum(F.when(F.col("i") == F.col("j"), F.col("r"))).alias("diag"),
    )
    return info.join(stats, "idx"), check_diagonal(ld)


def read_ld_text(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, r) of a full matrix in text, one row of it a line, in the order of the file."""
    from ..functions.scalar import tokens
    from ..operators.filters import reindex
    from .text import read_lines

    lines = reindex(read_lines(spark, path).select("value", "ord"), "ord", name="i")
    cells = lines.select("i", F.posexplode(tokens(F.col("value"))).alias("j", "r"))
    return cells.select("i", F.col("j").cast("long").alias("j"), F.col("r").cast("double").alias("r"))


def check_diagonal(ld: DataFrame, low: float = 0.8, high: float = 1.2) -> DataFrame:
    """An error if the mean of the diagonal is off."""
    mean = ld.filter("i = j").agg(F.avg("r")).first()[0]
    if mean is None or not low <= mean <= high:
        raise EngineError(f"mean of the diagonal is {mean}")
    return ld


_EIGEN = "m int, k int, sum_pos double, cutoff double, values array<double>, vectors array<double>"


def eigen_places(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, at, offset, m, k) of every block of eigen files: i32 m, i32 k, f32 sum, f32 cutoff, k values (ascending),
    m k vectors by column. Only headers are read, and Spark lists the files without reading them."""
    ship_package(spark)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for path, length in zip(files["path"], files["length"].tolist(), strict=True):
                rows, offset = [], 0
                with open_file(path) as file:
                    while offset < length:
                        file.seek(offset)
                        m, k = struct.unpack("<ii", file.read(8))
                        rows.append((path, len(rows), offset, m, k))
                        offset += 16 + 4 * k + 4 * m * k
                yield pd.DataFrame(rows, columns=["path", "at", "offset", "m", "k"])

    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    return files.mapInPandas(index, "path string, at int, offset long, m int, k int")


def read_eigen(spark: SparkSession, paths: str | list[str], members: DataFrame) -> DataFrame:
    """Eigen rows of files block<id>.eigen.bin or of files of many blocks, in the order of members.

    members: region, region_ord, snp, ord, and for several files of many blocks name, the last part of the file's path
    without its suffixes. A file of one block names its region; else blocks follow region_ord. Another number of variants
    than a region lists is an error. Blocks are dealt by place, and a task reads the bytes of its own only.
    """
    from ..operators.filters import reindex

    names = [c.split()[0] for c in _EIGEN.split(", ")]
    places = materialise(eigen_places(spark, [paths] if isinstance(paths, str) else paths), "eigen-places")
    named = F.regexp_extract("path", r"/block([^/]*?)\.eigen\.bin$", 1)
    file = F.regexp_extract("path", r"([^/]*?)\.eigen\.(gene|ldblock)\.bin$", 1)
    places = places.withColumn("block", named).withColumn("name", file)
    many = "name" in members.columns
    regions = members.groupBy("region", *(["name"] if many else [])).agg(F.min("region_ord").alias("region_ord"), F.sort_array(F.collect_list(F.struct("ord", "snp"))).alias("s"))
    regions = regions.select("region", "region_ord", F.col("s.snp").alias("snps"), *(["name"] if many else []))
    order = ("name", "region_ord") if many else ("region_ord",)
    by_place = reindex(regions, *order, name="at")
    if many:
        first = by_place.groupBy("name").agg(F.min("at").alias("__first"))
        by_place = by_place.join(F.broadcast(first), "name").withColumn("at", F.col("at") - F.col("__first")).drop("__first")
    by_place = by_place.withColumn("at", F.col("at").cast("int"))
    own = places.filter("block <> ''").join(regions.drop("name"), F.col("block") == F.col("region"))
    rest = places.filter("block = ''").join(by_place, ["name", "at"] if many else "at")
    found = own.select("region", "snps", "path", "offset", "m", "k").unionByName(rest.select("region", "snps", "path", "offset", "m", "k"))
    found = materialise(found, "eigen-regions")
    wrong = found.filter(F.size("snps") != F.col("m")).first()
    if wrong is not None:
        raise EngineError(f"region {wrong.region}: {len(wrong.snps)} variants listed, {wrong.m} stored")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.to_dict("records"):
                with open_file(row["path"]) as file:
                    file.seek(row["offset"] + 8)
                    total, cutoff = struct.unpack("<ff", file.read(8))
                    values = np.frombuffer(file.read(4 * row["k"]), "<f4").astype(float)
                    vectors = np.frombuffer(file.read(4 * row["m"] * row["k"]), "<f4").astype(float)
                out = {"region": row["region"], "snps": row["snps"], "m": row["m"], "k": row["k"], "sum_pos": total, "cutoff": cutoff, "values": values, "vectors": vectors}
                yield pd.DataFrame([out], columns=["region", "snps", *names])

    return found.repartition("region").mapInPandas(load, f"region string, snps array<string>, {_EIGEN}")


def read_block_ld(spark: SparkSession, folder: str, members: DataFrame, cutoff: float = 0.9999) -> DataFrame:
    """Eigen rows of the correlation matrices block<id>.ldm.bin (m m f32) of a folder; members: region, snp, ord.

    A region is one row of the result, so its matrix is in one task, which reads that file. Another size than the
    members ask for is an error.
    """
    from ..operators.ld import decompose

    ship_package(spark)
    regions = members.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("ord", "snp"))).alias("s")).select("region", F.col("s.snp").alias("snps"))

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for region, snps in zip(rows["region"], rows["snps"], strict=True):
                m = len(snps)
                with open_file(f"{folder}/block{region}.ldm.bin") as file:
                    raw = file.read()
                if len(raw) != 4 * m * m:
                    raise EngineError(f"region {region}: {len(raw)} bytes stored, {m} variants listed")
                values, vectors, total = decompose(np.frombuffer(raw, "<f4").reshape(m, m), cutoff)
                out = {"region": region, "snps": list(snps), "m": m, "k": len(values), "sum_pos": total, "cutoff": cutoff, "values": values, "vectors": vectors.T.ravel()}
                yield pd.DataFrame([out])

    return regions.repartition("region").mapInPandas(load, f"region string, snps array<string>, {_EIGEN}")
