"""Token ids as Arrow stream files of fixed-size lists.

A file is an Arrow IPC stream of uncompressed record batches with two columns: `ids`, fixed-size lists of
`seq_len` unsigned integers, and `mask`, fixed-size lists of booleans that are false only behind the last
token. All batches but the last of a file hold the same number of sequences, so the place of any token is
plain arithmetic, and a memory-mapped file gives sequences and masks without a copy. Beside each file lies
`<file>.index`, a stream with one row for each document: its id, its first token and its token count.

Documents stand in ascending id order, nulls first, over all files. A task writes its files under names of
its own, and only the names that its successful attempt returned are listed, so retries leave no double.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import ship_package
from .shared import fresh, materialise, shared_dir, text_key

#: Most words in each of a worker's two generations of memory; this bounds memory and changes no result.
REMEMBERED = 600_000
#: Bytes of text that one writing task takes on average, more where the tasks would be over MOST_PARTS.
PART_BYTES = 32 << 20
MOST_PARTS = 100_000
_MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long"


class _Words(dict):
    """Ids of words, as bytes; a word is encoded when it is first asked for by [].

    When the memory is full it becomes the old generation, and words that are asked for again move over, so frequent
    words are not encoded anew and rare ones make room.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        ids = self[word] = self.encode(word) if ids is None else ids
        self.age()
        return ids

    def age(self) -> None:
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()


class WordEncoder:
    """The tokenizers library behind a memory of words.

    Byte-level pre-tokenization always cuts before a space that a non-space follows, and around a single line
    break. Texts whose only white space is of that kind are put together from words, each encoded once, where the
    first word of a line takes the break before it along and a text's first word stands without a space before it.
    New words of a text go to the library together: a token that begins with a space begins a word. The library
    encodes other texts whole.
    """

    ODD = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
    ODD_ASCII = [c for c in ODD if c.isascii()]

    def __init__(self, vocabulary: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(vocabulary)
        size = self.library.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.code = "H" if size <= 1 << 16 else "I"
        # byte-level vocabularies write a space as U+0120
        self.spaced = np.array([(self.library.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.words = _Words(lambda word: self._whole(word if word[0] == "\n" else " " + word))
        self.firsts = _Words(self._whole)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode words that are not remembered, and remember them."""
        words = [w for w in dict.fromkeys(words) if w not in self.words.old and w[0] != "\n"]
        if len(words) < 2:
            return
        ids = np.array(self.library.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, self.kind)
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) != len(words):
            return
        raw, at = ids.tobytes(), (starts * self.kind.itemsize).tolist()
        at.append(len(raw))
        self.words.update(zip(words, [raw[i:j] for i, j in zip(at, at[1:], strict=False)], strict=True))
        self.words.age()

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian bytes of `kind`."""
        if "\n\n" in text or any(map(text.__contains__, self.ODD_ASCII if text.isascii() else self.ODD)):
            return self._whole(text)
        parts = text.replace("\n", " \n").split(" ")
        if "" in parts:
            return self._whole(text)
        first = self.firsts[parts.pop(0)]
        found = list(map(self.words.get, parts))
        if None in found:
            new = [k for k, ids in enumerate(found) if ids is None]
            self._learn([parts[k] for k in new])
            # what is not learnt yet is encoded by itself
            for k in new:
                found[k] = self.words[parts[k]]
        return first + b"".join(found)


_ENCODERS: dict[int, WordEncoder] = {}


def _encoder(vocabulary: bytes) -> WordEncoder:
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(vocabulary)
    return _ENCODERS[key]


def _filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    # Spark's name of the S3 scheme
    return pa.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else path)


class _FileWriter:
    """One file and its index, written as tokens come."""

    def __init__(self, path: str, kind: np.dtype, seq_len: int, batch: int, id_type: pa.DataType):
        self.fs, self.at = _filesystem(path)
        self.path, self.kind, self.seq_len, self.room = path, kind, seq_len, seq_len * batch
        ids = pa.list_(pa.from_numpy_dtype(kind), seq_len)
        self.schema = pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.out = self.fs.open_output_stream(self.at)
        self.stream = pa.ipc.new_stream(self.out, self.schema)
        self.id_type, self.docs, self.starts, self.counts = id_type, [], [], []
        self.held, self.n_tokens = bytearray(), 0

    def add(self, doc_id: object, ids: bytes) -> None:
        n = len(ids) // self.kind.itemsize
        self.docs.append(doc_id)
        self.starts.append(self.n_tokens)
        self.counts.append(n)
        self.n_tokens += n
        self.held += ids
        full = self.room * self.kind.itemsize
        while len(self.held) >= full:
            self._write(np.frombuffer(bytes(self.held[:full]), self.kind))
            del self.held[:full]

    def _write(self, ids: np.ndarray) -> None:
        pad = -len(ids) % self.seq_len
        mask = np.arange(len(ids) + pad) < len(ids)
        flat = np.concatenate([ids, np.zeros(pad, self.kind)])
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (flat, mask)]
        self.stream.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> tuple[str, int, int]:
        if self.held:
            self._write(np.frombuffer(bytes(self.held), self.kind))
        self.stream.close()
        self.out.close()
        index = pa.table({"doc": pa.array(self.docs, self.id_type), "start": pa.array(self.starts, pa.int64()), "n": pa.array(self.counts, pa.int64())})
        with self.fs.open_output_stream(self.at + ".index") as out, pa.ipc.new_stream(out, index.schema) as stream:
            stream.write_table(index)
        return self.path, len(self.docs), self.n_tokens


class SequenceFile:
    """Random access to one written file; a local file is mapped, not read."""

    def __init__(self, path: str):
        fs, at = _filesystem(path)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        source = pa.memory_map(at) if local else pa.BufferReader(fs.open_input_file(at).read_buffer())
        self.batches = list(pa.ipc.open_stream(source))
        with fs.open_input_stream(at + ".index") as file:
            self.index = pa.ipc.open_stream(file).read_all()
        self.flat = [b.column("ids").values.to_numpy(zero_copy_only=True) for b in self.batches]
        self.seq_len = self.batches[0].schema.field("ids").type.list_size if self.batches else 0
        self.room = len(self.flat[0]) if self.flat else 1

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence k of the file as a view, and its mask."""
        batch, row = divmod(k, self.room // self.seq_len)
        mask = self.batches[batch].column("mask")[row].values
        return self.flat[batch][row * self.seq_len : (row + 1) * self.seq_len], mask.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n tokens from start: a view where one batch holds them all."""
        first, last = start // self.room, (start + max(n, 1) - 1) // self.room
        parts = [self.flat[b][max(0, start - b * self.room) : start + n - b * self.room] for b in range(first, last + 1)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_sequences(
    docs: DataFrame,
    vocabulary: bytes,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    seq_len: int = 2048,
    batch: int = 256,
    file_tokens: int = 1 << 26,
) -> DataFrame:
    """Encode every text, append end_id, write the files, and return their list: (part, seq, path, n_docs, n_tokens).

    Null texts count as empty; rows equal in id are each written, ordered by their text's hash. An empty
    table writes no file. Other columns are not written.
    """
    spark = docs.sparkSession
    ship_package(spark)
    folder = f"{shared_dir(spark)}/sequences-{uuid.uuid4().hex}"
    shared = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("th", text_key(F.col("text")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // max(PART_BYTES, size // MOST_PARTS)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = _encoder(shared.value), TaskContext.get().partitionId(), 0
        writer, done = None, []
        end = np.array([end_id], encoder.kind).tobytes()
        for rows in batches:
            for doc, text in zip(rows.column("doc").to_pylist(), rows.column("text"), strict=True):
                ids = encoder.encode(text.as_py())
                if writer is None:
                    fs, at = _filesystem(folder)
                    fs.create_dir(at, recursive=True)
                    path = f"{folder}/{part:06d}-{seq:04d}-{uuid.uuid4().hex}.arrow"
                    writer = _FileWriter(path, encoder.kind, seq_len, batch, rows.schema.field("doc").type)
                writer.add(doc, ids + end)
                if writer.n_tokens >= file_tokens:
                    done.append((part, seq, *writer.close()))
                    writer, seq = None, seq + 1
        if writer is not None:
            done.append((part, seq, *writer.close()))
        names = ["part", "seq", "path", "n_docs", "n_tokens"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        if done:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    ordered = rows.repartitionByRange(parts, "doc", "th").sortWithinPartitions("doc", "th").select("doc", "text")
    return materialise(ordered.mapInArrow(write, _MANIFEST), "sequence-files")


def read_documents(files: DataFrame, id_type: T.DataType, id_name: str = "doc_id") -> DataFrame:
    """From the listed files: (id, start, n_tokens, ids_crc32); start counts the tokens of all documents before.

    Null ids come first and read as null, repeated rows once for each; a document of an empty text has its end id alone.
    Without files the result is empty.
    """
    spark = files.sparkSession
    ship_package(spark)
    earlier = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    # one row a file, not a document
    listed = files.withColumn("before", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).select("path", "before")
    out = T.StructType([T.StructField(id_name, id_type)] + [T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for path, before in zip(rows.column("path").to_pylist(), rows.column("before").to_pylist(), strict=True):
                file = SequenceFile(path)
                starts, counts = file.index.column("start").to_numpy(), file.index.column("n").to_numpy()
                sums = [zlib.crc32(file.tokens(s, n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]
                doc = file.index.column("doc").combine_chunks()
                yield pa.record_batch([doc, pa.array(starts + before), pa.array(counts), pa.array(sums, pa.int64())], [f.name for f in out])

    n = max(1, files.count())
    return listed.repartition(n, F.col("path")).mapInArrow(read, out)
