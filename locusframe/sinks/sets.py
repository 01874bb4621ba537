"""A transactional sink for binary sets (B1, B6, B8, B9): genotypes, pair matrices, correlations, eigen blocks.

    rows.write.format("locus_sets").mode("append").options(kind="bed", job="...", ...).save(folder)

Each task writes whole sets under names that begin with the job's. Commit removes what failed or repeated attempts have
left and writes the list of the job's sets; abort removes all of the job's files. So a folder holds listed
sets only. Rows arrive as Arrow batches, in the order in which they are to stand.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as S

from ..errors import EngineError
from ..session import ship_package
from ..sources.binary import BED_MAGIC, SPARSE_3F


def create(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of a path, and the path in it."""
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return (pyarrow.fs.LocalFileSystem(), path) if "://" not in path else pyarrow.fs.FileSystem.from_uri(path)


class Files:
    """The files of one job in a folder."""

    def __init__(self, folder: str, job: str):
        self.folder, self.job = folder.rstrip("/"), job
        self.fs, self.at = create(self.folder)
        self.fs.create_dir(self.at, recursive=True)

    def name(self, start: str = "", end: str = "") -> str:
        """A name of a set that no other attempt uses."""
        return f"{self.job}-{start}{uuid.uuid4().hex}{end}"

    def open(self, name: str):
        return self.fs.open_output_stream(f"{self.at}/{name}")

    def put(self, name: str, lines: list[str]) -> None:
        with self.open(name) as out:
            out.write(("\n".join(lines) + "\n").encode())

    def written(self) -> list[str]:
        found = self.fs.get_file_info(pyarrow.fs.FileSelector(self.at))
        return [f.base_name for f in found if f.base_name.startswith(self.job + "-")]

    def remove(self, names: list[str]) -> None:
        for name in names:
            self.fs.delete_file(f"{self.at}/{name}")


def bed_codes(dosages: pa.Array) -> bytes:
    """Packed variants from an Arrow column of dosages, null for missing; as many people in each."""
    if isinstance(dosages, pa.ChunkedArray):
        dosages = dosages.combine_chunks()
    flat = dosages.flatten().cast(pa.int8()).fill_null(-1).to_numpy(zero_copy_only=False).reshape(len(dosages), -1)
    code = np.array([3, 2, 0, 1], np.uint8)[flat]
    code = np.pad(code, ((0, 0), (0, -code.shape[1] % 4))).reshape(len(dosages), -1, 4)
    return (code << np.array([0, 2, 4, 6], np.uint8)).sum(axis=2).astype(np.uint8).tobytes()


def bed_sets(batches: Iterator[pa.RecordBatch], files: Files, options: dict) -> Iterator[dict]:
    """(snp, chrom, pos, gen_pos, a1, a2, dosage) as a .bed, .bim and .fam set; option people: the file of .fam lines."""
    name, bed, bim = files.name(), None, []
    for rows in batches:
        bed = bed or files.open(name + ".bed")
        if not bim:
            bed.write(BED_MAGIC)
        bed.write(bed_codes(rows.column("dosage")))
        about = rows.drop_columns(["dosage"]).to_pylist()
        bim += [f"{r['chrom']} {r['snp']} {r['gen_pos']} {r['pos']} {r['a1']} {r['a2']}" for r in about]
    if bed is None:
        return
    bed.close()
    files.put(name + ".bim", bim)
    fs, at = create(options["people"])
    with fs.open_input_stream(at) as source, files.open(name + ".fam") as out:
        while raw := source.read(1 << 20):
            out.write(raw)
    yield {"name": name, "n_variants": len(bim)}


def pair_columns(gene: np.ndarray, at: np.ndarray, beta: np.ndarray, se: np.ndarray, n_genes: int) -> tuple[np.ndarray, bytes, bytes]:
    """Of pairs ordered by gene and place: offsets (from 0) of the genes' columns of effects and errors, and the places and
    values of these columns."""
    counts = np.bincount(gene, minlength=n_genes)
    offsets = np.concatenate([[0], np.cumsum(np.repeat(counts, 2))])
    first = offsets[::2][gene] + np.arange(len(gene)) - np.repeat(np.cumsum(counts) - counts, counts)
    ids, values = np.empty(2 * len(gene), "<u4"), np.empty(2 * len(gene), "<f4")
    ids[first] = ids[first + counts[gene]] = at
    values[first], values[first + counts[gene]] = beta, se
    return offsets, ids.tobytes(), values.tobytes()


def besd_sets(batches: Iterator[pa.RecordBatch], files: Files, options: dict) -> Iterator[dict]:
    """Pairs in order of their genes, with the descriptions of both, as a .besd, .esi and .epi set of its own genes and
    variants. Of a pair 16 bytes are held, and a description is held once."""
    snps, ids, variants, genes, held = {}, {}, [], [], []
    for rows in batches:
        snp, first = _numbered(rows.column("snp"), snps)
        variants.append(rows.select(["snp", "v_chrom", "pos", "a1", "a2", "af"]).take(first))
        gene, first = _numbered(rows.column("gene_id"), ids)
        genes.append(rows.select(["gene_id", "g_chrom", "mid"]).take(first))
        held.append((gene, snp, *(rows.column(c).to_numpy(zero_copy_only=False).astype("<f4") for c in ("beta", "se"))))
    if not ids:
        return
    name = files.name()
    gene, snp, *values = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    esi = pa.Table.from_batches(variants).to_pandas().sort_values(["v_chrom", "pos", "snp"])
    place = np.empty(len(esi), np.int32)
    place[esi.index] = np.arange(len(esi))
    place = place[snp]
    order = np.lexsort((place, gene))
    offsets, places, numbers = pair_columns(gene[order], place[order], *(x[order] for x in values), len(ids))
    with files.open(name + ".besd") as out:
        for part in (struct.pack("<IQ", SPARSE_3F, int(offsets[-1])), offsets.astype("<u8").tobytes(), places, numbers):
            out.write(part)
    files.put(name + ".esi", [esi_line(r) for r in esi.itertuples()])
    epi = pa.Table.from_batches(genes).to_pandas()
    files.put(name + ".epi", [f"{r.g_chrom}\t{r.gene_id}\t0\t{r.mid}\t{r.gene_id}\tNA" for r in epi.itertuples()])
    yield {"name": name, "n_genes": len(ids)}


def _numbered(names: pa.Array, numbers: dict[str, int]) -> tuple[np.ndarray, pa.Array]:
    """The number of each name, new ones going on in the order in which they come; and where in names the new ones come first."""
    coded, known = names.dictionary_encode(), len(numbers)
    own = np.array([numbers.setdefault(x, len(numbers)) for x in coded.dictionary.to_pylist()], np.int32)
    codes = coded.indices.to_numpy()
    first = np.unique(codes, return_index=True)[1]
    return own[codes], pa.array(first[own >= known])


def esi_line(r) -> str:
    return f"{r.v_chrom}\t{r.snp}\t0\t{r.pos}\t{r.a1}\t{r.a2}\t{r.af:.6f}"


def ld_sets(batches: Iterator[pa.RecordBatch], files: Files, options: dict) -> Iterator[dict]:
    """Matrix rows (part, line, js, rs) as a <name>.info and <name>.bin for each part; one row is held at a time."""
    kind, part, name, lines, stream = options["matrix"], None, "", [], None

    def close() -> Iterator[dict]:
        if stream is not None:
            stream.close()
            files.put(name + ".info", [options["title"], *lines])
            yield {"part": part, "name": name, "n_rows": len(lines)}

    for rows in batches:
        js, rs = rows.column("js"), rows.column("rs")
        for k, (own, line) in enumerate(zip(rows.column("part").to_pylist(), rows.column("line").to_pylist(), strict=True)):
            if own != part:
                yield from close()
                part, lines = own, []
                name = files.name(f"part{part:05d}-", f".ldm.{kind}")
                stream = files.open(name + ".bin")
            lines.append(line)
            if kind == "sparse":
                stream.write(js[k].values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            stream.write(rs[k].values.to_numpy(zero_copy_only=False).astype("<f8").tobytes())
    yield from close()


def eigen_sets(batches: Iterator[pa.RecordBatch], files: Files, options: dict) -> Iterator[dict]:
    """Eigen rows with their places and their variants' lines as <name>.eigen.<kind>.bin, .info and .snp.info; one region's
    vectors are held at a time."""
    gene = options["regions"] == "gene"
    name, stream, info, described, n_regions = files.name(), None, [], {}, 0
    for rows in batches:
        for k, row in enumerate(rows.drop_columns(["vectors", "values"]).to_pylist()):
            stream = stream or files.open(f"{name}.eigen.{options['regions']}.bin")
            if len(row["lines"]) != row["m"]:
                raise EngineError(f"region {row['region']}: {row['m']} variants, {len(row['lines'])} described")
            stream.write(struct.pack("<iiff", row["m"], row["k"], row["sum_pos"], row["cutoff"]))
            for part in ("values", "vectors"):
                stream.write(rows.column(part)[k].values.to_numpy(zero_copy_only=False).astype("<f4").tobytes())
            place = f"{row['chrom']} {row['region']} {row['start']} {row['end']}" + (f" {row['window']}" if gene else "")
            info += [f"{place} {s} {row['m']}" for s in row["snps"]]
            described |= dict(zip(row["snps"], row["lines"], strict=True))
            n_regions += 1
    if stream is None:
        return
    stream.close()
    title = "Chrom probeID start end windows snpInGene NumSnpInGene" if gene else "Chrom LDBLOCK start end snpInLdBlock NumSnpInLdBlock"
    files.put(f"{name}.eigen.{options['regions']}.info", [title, *info])
    files.put(f"{name}.eigen.{options['regions']}.snp.info", ["Chrom ID GenPos PhysPos A1 A2 A1Freq N", *described.values()])
    yield {"name": name, "n_regions": n_regions}


#: What writes each kind of set, and the columns of its list.
KINDS = {
    "bed": (bed_sets, "name string, n_variants int"), "besd": (besd_sets, "name string, n_genes int"),
    "ld": (ld_sets, "part int, name string, n_rows int"), "eigen": (eigen_sets, "name string, n_regions int"),
}


@dataclass
class _Written(S.WriterCommitMessage):
    sets: list[dict]


class SetsWriter(S.DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.folder, self.job = options["path"], options["job"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        task, _ = KINDS[self.options["kind"]]
        return _Written(list(task(iterator, Files(self.folder, self.job), self.options)))

    def commit(self, messages: list[_Written | None]) -> None:
        sets = [s for m in messages if m is not None for s in m.sets]
        files, names = Files(self.folder, self.job), {s["name"] for s in sets}
        files.remove([f for f in files.written() if not any(f.startswith(n + ".") for n in _starts(f, names))])
        listed = [json.dumps(s | {"name": f"{files.folder}/{s['name']}"}) for s in sets]
        files.put(f"{self.job}.written", listed) if listed else files.open(f"{self.job}.written").close()

    def abort(self, messages: list[_Written | None]) -> None:
        files = Files(self.folder, self.job)
        files.remove(files.written())


def _starts(file: str, names: set[str]) -> list[str]:
    """The names that a file's can begin with: those up to one of its dots."""
    words = file.split(".")
    return [n for k in range(1, len(words)) if (n := ".".join(words[:k])) in names]


class SetsSink(S.DataSource):
    """Options: kind (bed, besd, ld, eigen), job, and those of the kind. The list is <job>.written, a JSON row a set."""

    @classmethod
    def name(cls) -> str:
        return "locus_sets"

    def writer(self, schema, overwrite: bool) -> S.DataSourceWriter:
        return SetsWriter(self.options)


def register(spark: SparkSession) -> None:
    if not getattr(spark, "_locus_sets", False):
        ship_package(spark)
        spark.dataSource.register(SetsSink)
        spark._locus_sets = True


def save_sets(rows: DataFrame, folder: str, kind: str, **options: str) -> DataFrame:
    """Write rows as sets of a kind, and return their list."""
    spark = rows.sparkSession
    register(spark)
    job = uuid.uuid4().hex
    rows.write.format("locus_sets").mode("append").options(kind=kind, job=job, **options).save(folder)
    return spark.read.schema(KINDS[kind][1]).json(f"{folder.rstrip('/')}/{job}.written")
