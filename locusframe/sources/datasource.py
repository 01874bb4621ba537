"""Genotype sets and pair-matrix sets as Spark data sources.

    register(spark)
    spark.read.format("locus_bed").load("prefix").filter("chrom = 22 and idx < 5000")
    spark.read.format("locus_besd").load("prefix").filter("gene_id in ('g1', 'g2')")

Partitions are planned from file offsets, about PART_BYTES of the matrix each. Filters on index, chromosome and gene go into the
source: whole partitions fall away by index, and a task reads the bytes of wanted rows only. Columns leave as Arrow
arrays, so that no genotype or pair becomes a Python object.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as S

from ..errors import EngineError
from ..session import ship_package
from .binary import BED_MAGIC, besd_layout, dosage_array, file_exists, open_file

#: Bytes of a matrix that a partition takes unless option part_bytes says otherwise, and rows of one Arrow batch of pairs.
PART_BYTES, BATCH_ROWS = 16 << 20, 200_000
_CHROMOSOMES = {"X": 23, "Y": 24}


@dataclass
class Wanted:
    """What pushed filters leave of one column: a range, and a set of values where one was asked for."""

    low: float = float("-inf")
    high: float = float("inf")
    values: frozenset | None = None
    known: bool = False

    def take(self, f: S.Filter) -> bool:
        """Add a filter; False where it is of a kind that stays with Spark."""
        if isinstance(f, S.IsNotNull):
            self.known = True
        elif isinstance(f, (S.EqualTo, S.In)) and (isinstance(f, S.In) or f.value is not None):
            given = frozenset(f.value if isinstance(f, S.In) else [f.value])
            self.values = given if self.values is None else self.values & given
            self.known = True
        elif isinstance(f, (S.GreaterThan, S.GreaterThanOrEqual)) and isinstance(f.value, int):
            self.low, self.known = max(self.low, f.value + isinstance(f, S.GreaterThan)), True
        elif isinstance(f, (S.LessThan, S.LessThanOrEqual)) and isinstance(f.value, int):
            self.high, self.known = min(self.high, f.value - isinstance(f, S.LessThan)), True
        else:
            return False
        return True

    def fits(self, value) -> bool:
        if value is None:
            return not self.known
        ranged = self.low > float("-inf") or self.high < float("inf")
        return (self.values is None or value in self.values) and (not ranged or self.low <= value <= self.high)


class _Reader(S.DataSourceReader):
    """Takes filters on the columns named in wanted."""

    wanted: dict[str, Wanted]

    def pushFilters(self, filters: list[S.Filter]) -> Iterator[S.Filter]:
        for f in filters:
            column = self.wanted.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if column is None or not column.take(f):
                yield f


def _number(text: str, kind):
    try:
        return kind(text)
    except ValueError:
        return None


def _chromosome(text: str) -> int | None:
    number = _CHROMOSOMES.get(text.upper()) or _number(text, int)
    return number if number and number > 0 else None


def _runs(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ascending numbers as half-open runs."""
    ends = np.flatnonzero(np.diff(at) != 1) + 1
    for run in np.split(at, ends):
        if len(run):
            yield int(run[0]), int(run[-1]) + 1


@dataclass
class _BedPart(S.InputPartition):
    first: int
    last: int
    #: Where the first variant's line begins.
    bim_at: int


class _BedReader(_Reader):
    def __init__(self, prefix: str, keep: bytes | None = None, part_bytes: int = PART_BYTES):
        self.prefix, self.keep, self.part_bytes = prefix, keep, part_bytes
        self.wanted = {"idx": Wanted(), "chrom": Wanted(), "snp": Wanted()}
        with open_file(prefix + ".bed") as file:
            if file.read(3) != BED_MAGIC:
                raise EngineError(f"{prefix}.bed is not a variant-major genotype file")
            self.size = file.size() - 3
        self.people = sum(1 for _ in _lines(prefix + ".fam"))
        self.width = -(-self.people // 4)
        if self.width == 0 or self.size % self.width:
            raise EngineError(f"{prefix}.bed: {self.size} bytes are no whole number of variants of {self.people} people")

    def partitions(self) -> list[_BedPart]:
        """Ranges of variants. The variants' file is passed over once, for the places of a line a partition."""
        n, each = self.size // self.width, max(1, self.part_bytes // self.width)
        index, seen, at, places = self.wanted["idx"], 0, 0, {0: 0}
        with open_file(self.prefix + ".bim") as file:
            while raw := file.read(8 << 20):
                ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
                # line k begins behind the k-th line end
                for k in range(-(-(seen + 1) // each) * each, seen + len(ends) + 1, each):
                    places[k] = at + int(ends[k - seen - 1]) + 1
                seen, at = seen + len(ends), at + len(raw)
        parts = [_BedPart(k, min(n, k + each), places[k]) for k in range(0, n, each) if k in places]
        values = index.values
        return [p for p in parts if p.last > index.low and p.first <= index.high and (values is None or any(p.first <= v < p.last for v in values))]

    def read(self, part: _BedPart) -> Iterator[pa.RecordBatch]:
        rows = _first_lines(self.prefix + ".bim", part.bim_at, part.last - part.first)
        if len(rows) != part.last - part.first:
            raise EngineError(f"{self.prefix}.bim: fewer lines than variants")
        chroms = [_chromosome(r[0]) for r in rows]
        idx, chrom, snp = self.wanted["idx"], self.wanted["chrom"], self.wanted["snp"]
        fits = [idx.fits(part.first + k) and chrom.fits(c) and snp.fits(r[1]) for k, (c, r) in enumerate(zip(chroms, rows, strict=True))]
        keep = None if self.keep is None else np.flatnonzero(np.unpackbits(np.frombuffer(self.keep, np.uint8), bitorder="little")[: self.people])
        most = max(1, (4 << 20) // self.people)
        with open_file(self.prefix + ".bed") as file:
            for a, z in _runs(np.flatnonzero(fits)):
                for at in range(a, z, most):
                    end = min(z, at + most)
                    file.seek(3 + (part.first + at) * self.width)
                    dosage = dosage_array(file.read((end - at) * self.width), end - at, self.people, keep)
                    some = rows[at:end]
                    about = [
                        pa.array(range(part.first + at, part.first + end), pa.int64()), pa.array(chroms[at:end], pa.int32()), pa.array([r[1] for r in some]),
                        pa.array([_number(r[2], float) for r in some], pa.float64()), pa.array([_number(r[3], int) for r in some], pa.int32()), *[pa.array([r[k] for r in some]) for k in (4, 5)],
                    ]
                    yield pa.record_batch([*about, dosage], ["idx", "chrom", "snp", "gen_pos", "pos", "a1", "a2", "dosage"])


def _lines(path: str) -> Iterator[bytes]:
    """Lines with something in them."""
    rest = b""
    with open_file(path) as file:
        while raw := file.read(1 << 20):
            *whole, rest = (rest + raw).split(b"\n")
            yield from (x for x in whole if x.strip())
    if rest.strip():
        yield rest


def _first_lines(path: str, at: int, n: int) -> list[list[str]]:
    """n lines from a place on, in words."""
    raw = b""
    with open_file(path) as file:
        file.seek(at)
        while raw.count(b"\n") < n and (more := file.read(1 << 20)):
            raw += more
    return [x.split() for x in raw.decode().split("\n")[:n] if x.strip()]


class BedSource(S.DataSource):
    """A3: (idx, chrom, snp, gen_pos, pos, a1, a2, dosage) of a .bed/.bim/.fam set by prefix; idx is the place in the file.

    Option keep: the people to keep, a bit each (see keep_bits). Filters on idx, chrom and snp are pushed down.
    """

    @classmethod
    def name(cls) -> str:
        return "locus_bed"

    def schema(self) -> str:
        return "idx long, chrom int, snp string, gen_pos double, pos int, a1 string, a2 string, dosage array<tinyint>"

    def reader(self, schema) -> S.DataSourceReader:
        keep = self.options.get("keep")
        return _BedReader(self.options["path"], None if keep is None else base64.b64decode(keep), int(self.options.get("part_bytes", PART_BYTES)))


def keep_bits(chosen: list[int], people: int) -> str:
    """The option keep for these places of the .fam file: a bit a person, 85 kB for half a million."""
    bits = np.zeros(people, np.uint8)
    bits[chosen] = 1
    return base64.b64encode(np.packbits(bits, bitorder="little").tobytes()).decode()


@dataclass
class _Set:
    path: str
    kind: str
    start: int
    n_genes: int
    #: Entries of all columns (sparse), or rows of a column (dense).
    total: int


@dataclass
class _BesdPart(S.InputPartition):
    number: int
    of: _Set
    first: int
    #: Offsets of the genes' columns (sparse), two a gene and the end, as bytes; genes' names and chromosomes.
    offsets: bytes = b""
    genes: list[str] | None = field(default=None)
    chroms: list[int | None] | None = field(default=None)
    count: int = 0


class _BesdReader(_Reader):
    def __init__(self, prefixes: list[str], n_genes: int | None = None, missing: float = -9.0, part_bytes: int = PART_BYTES):
        self.prefixes, self.given, self.missing, self.part_bytes = prefixes, n_genes, missing, part_bytes
        self.wanted = {"set": Wanted(), "gene_idx": Wanted(), "gene_id": Wanted(), "chrom": Wanted()}

    def partitions(self) -> list[_BesdPart]:
        """Runs of wanted genes. Of each set its header and the genes' file are read, some bytes a gene."""
        parts = []
        for number, prefix in enumerate(self.prefixes):
            path = prefix if prefix.endswith(".besd") else prefix + ".besd"
            kind, start = besd_layout(path)
            names = chroms = None
            if self.given is None:
                genes = [x.decode().split() for x in _lines(path.removesuffix(".besd") + ".epi")]
                names, chroms = [g[1] for g in genes], [_chromosome(g[0]) for g in genes]
            n = len(names) if names is not None else self.given
            with open_file(path) as file:
                size = file.size()
                offsets, total = None, 0
                if kind == "sparse":
                    file.seek(start)
                    offsets = np.frombuffer(file.read(8 * (2 * n + 1)), "<u8").astype(np.int64)
                    total = int(offsets[-1]) if len(offsets) else 0
                    if len(offsets) != 2 * n + 1 or size < start + 8 * (2 * n + 1) + 8 * total:
                        raise EngineError(f"{path} is too short for {n} genes")
                elif n and (size - start) % (8 * n):
                    raise EngineError(f"{path} is no whole number of rows of {n} genes")
            of = _Set(path, kind, start, n, total if offsets is not None else (size - start) // (8 * n) if n else 0)
            if not self.wanted["set"].fits(number):
                continue
            fits = [self.wanted["gene_idx"].fits(k) and (names is None or self.wanted["gene_id"].fits(names[k]) and self.wanted["chrom"].fits(chroms[k])) for k in range(n)]
            for a, z in _runs(np.flatnonzero(fits)):
                while a < z:
                    if offsets is None:
                        end = min(z, a + max(1, self.part_bytes // (8 * max(1, of.total))))
                    else:
                        end = min(z, max(a + 1, int(np.searchsorted(offsets[::2], offsets[2 * a] + self.part_bytes // 8, "right")) - 1))
                    cut = b"" if offsets is None else offsets[2 * a : 2 * end + 1].tobytes()
                    parts.append(_BesdPart(number, of, a, cut, names and names[a:end], chroms and chroms[a:end], end - a))
                    a = end
        return parts

    def read(self, part: _BesdPart) -> Iterator[pa.RecordBatch]:
        s = part.of
        with open_file(s.path) as file:
            if s.kind == "dense":
                file.seek(s.start + part.first * 8 * s.total)
                both = np.frombuffer(file.read(8 * s.total * part.count), "<f4").reshape(part.count, 2, s.total)
                beta, se = both[:, 0].ravel(), both[:, 1].ravel()
                gene, row = np.repeat(np.arange(part.count), s.total), np.tile(np.arange(s.total), part.count)
            else:
                offsets = np.frombuffer(part.offsets, np.int64)
                lo, hi, ids = int(offsets[0]), int(offsets[-1]), s.start + 8 * (2 * s.n_genes + 1)
                file.seek(ids + 4 * lo)
                at = np.frombuffer(file.read(4 * (hi - lo)), "<u4").astype(np.int64)
                file.seek(ids + 4 * s.total + 4 * lo)
                values = np.frombuffer(file.read(4 * (hi - lo)), "<f4")
                # a gene's effects, then its errors, of the same variants
                lengths = np.diff(offsets)
                if (lengths[::2] != lengths[1::2]).any():
                    raise EngineError(f"{s.path}: a gene's effects and errors differ in number")
                first = np.repeat(np.arange(len(lengths)) % 2 == 0, lengths)
                beta, se, row = values[first], values[~first], at[first]
                gene = np.repeat(np.arange(part.count), lengths[::2])
        known = se != self.missing
        gene, row, beta, se = gene[known], row[known], beta[known], se[known]
        names = None if part.genes is None else (pa.array(part.genes, pa.string()), pa.array(part.chroms, pa.int32()))
        for k in range(0, len(gene), BATCH_ROWS):
            g = gene[k : k + BATCH_ROWS]
            about = [pa.nulls(len(g), t) for t in (pa.string(), pa.int32())] if names is None else [x.take(pa.array(g)) for x in names]
            columns = [pa.array(np.full(len(g), part.number, np.int32)), pa.array(g + part.first), *about, pa.array(row[k : k + BATCH_ROWS])]
            yield pa.record_batch([*columns, *[pa.array(x[k : k + BATCH_ROWS].astype(float)) for x in (beta, se)]], ["set", "gene_idx", "gene_id", "chrom", "row", "beta", "se"])


class BesdSource(S.DataSource):
    """(set, gene_idx, gene_id, chrom, row, beta, se) of one or several pair-matrix sets; row is the variant's place in
    the .esi file, and pairs whose se is missing are left out.

    The path is a prefix, or option prefixes a JSON list of them; set is the place in that list. Names and chromosomes come from the .epi files
    beside; with option genes, their number, none is read. Filters on set, gene_idx, gene_id and chrom are pushed down.
    """

    @classmethod
    def name(cls) -> str:
        return "locus_besd"

    def schema(self) -> str:
        return "set int, gene_idx long, gene_id string, chrom int, row long, beta double, se double"

    def reader(self, schema) -> S.DataSourceReader:
        given = self.options.get("prefixes")
        n = self.options.get("genes")
        return _BesdReader(json.loads(given) if given else [self.options["path"]], None if n is None else int(n), float(self.options.get("missing", -9.0)), int(self.options.get("part_bytes", PART_BYTES)))


def register(spark: SparkSession) -> None:
    """Make the sources known to a session, once, and let it push filters into them."""
    if getattr(spark, "_locus_sources", False):
        return
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (BedSource, BesdSource):
        spark.dataSource.register(source)
    spark._locus_sources = True


def besd_exists(prefix: str) -> bool:
    """Whether all three files of a set are there."""
    return all(file_exists(prefix + x) for x in (".besd", ".esi", ".epi"))
