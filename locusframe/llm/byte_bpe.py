"""Byte-level BPE with a segment tree over the ranks of adjacent pairs, and its decoding.

A pre-token's bytes are its first symbols. The tree's leaf i holds the rank of the merge of symbol i with the next one, with i
behind it, or a mark above all ranks where the two do not merge; each inner node holds the least of its two. So the root is
the leftmost of the lowest-ranked merges. Doing it changes three leaves, each in logarithmic time, and it goes on until no pair
merges: a pre-token of n bytes takes n log n steps, also one of megabytes. Decoding joins the bytes of the ids.

The vocabulary file is that of the tokenizers library: byte-level pre-tokenization with its usual pattern, no prefix space, no
normalizer; added tokens' strings in a text become their ids, as in that library. Other kinds of files are an error.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..session import ship_package
from .shared import fresh

#: Fixed by the file format: how byte-level pre-tokenization cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most words in each of a worker's two generations of memory, the longest of them, and characters of texts encoded together; this
#: bounds memory and changes no result.
REMEMBERED, LONGEST, TOGETHER = 250_000, 64, 2_000_000
#: The widest tree that is a row of an array, and rows at a time.
_WIDEST, _ROWS = 64, 16_384
_NONE = 1 << 62
_PLACE = (1 << 32) - 1
#: White space other than single blanks and line breaks between words.
_ODD = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"] + ["\n\n", "  "]
_ODD_ASCII = [x for x in _ODD if x.isascii()]


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 ones for themselves, the others in
    turn from U+0100 on."""
    printable = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class _Memory:
    """What is known of words, in two generations: when the new one is full it becomes the old one, and words that are asked
    for again move over."""

    def __init__(self):
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def missing(self, words: set[str]) -> list[str]:
        if len(self.new) >= REMEMBERED:
            self.old, self.new = self.new, {}
        out = []
        for word in words.difference(self.new):
            known = self.old.get(word)
            if known is None:
                out.append(word)
            else:
                self.new[word] = known
        return out


class Codec:
    """Encoder and decoder for one vocabulary, given as the bytes of its JSON file."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not spec["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex", True)
        options = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        added = spec.get("added_tokens") or []
        if not plain or options or before.get("add_prefix_space") or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise EngineError("not a plain byte-level BPE vocabulary")
        letters = byte_letters()
        ids = model["vocab"]
        self.first = [ids[c] for c in letters]
        byte = {c: bytes([b]) for b, c in enumerate(letters)}
        names = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in added}
        #: each id's bytes; a character that stands for no byte makes the whole token stand for its own UTF-8
        self.bytes = {i: b"".join(map(byte.__getitem__, t)) if byte.keys() >= set(t) else t.encode() for i, t in names.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: rank of each pair that merges, 32 bits up, and what each rank makes; the same as arrays
        self.rank = {(ids[a] << 32) + ids[b]: r << 32 for r, (a, b) in enumerate(pairs)}
        self.keys = np.array(sorted(self.rank), np.int64)
        self.ranks = np.array([self.rank[k] for k in self.keys.tolist()], np.int64)
        self.made = [ids[a + b] for a, b in pairs]
        self.added = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if added else None
        self.pieces = regex.compile(PATTERN).findall
        self.first_ids, self.made_ids = np.array(self.first, np.int64), np.array(self.made, np.int64)
        self.known, self.words = _Memory(), _Memory()

    def merge(self, symbols: list[int]) -> list[int]:
        """Symbols after all merges: lowest rank first, leftmost first of equal ranks."""
        n, rank, made = len(symbols), self.rank.get, self.made
        width = 1 << max(0, n - 1).bit_length()
        tree = [_NONE] * (2 * width)
        tree[width : width + n - 1] = [rank((a << 32) + b, _NONE) + i for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))]
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (top := tree[1]) < _NONE:
            at = top & _PLACE
            gone, new = after[at], made[top >> 32]
            right, left = after[gone], before[at]
            symbols[at], symbols[gone], after[at] = new, -1, right
            changed = [(gone, _NONE), (at, _NONE)]
            if right < n:
                before[right] = at
                changed[1] = at, rank((new << 32) + symbols[right], _NONE) + at
            if left >= 0:
                changed.append((left, rank((symbols[left] << 32) + new, _NONE) + left))
            for place, value in changed:
                i = width + place
                while tree[i] != value:
                    tree[i] = value
                    # the least of this node and the one beside it goes up
                    other = tree[i ^ 1]
                    if other < value:
                        value = other
                    i >>= 1
                    if not i:
                        break
        return [s for s in symbols if s >= 0]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the pairs, 32 bits up; _NONE where they do not merge, as where an end is -1."""
        key = (a << 32) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0), self.ranks[at], _NONE)

    def _merge_rows(self, rows: list[bytes], width: int) -> list[list[int]]:
        """merge() of rows of at most width bytes, a power of two, one merge of every row at a time."""
        flat = np.frombuffer(b"".join([r.ljust(width, b"\0") for r in rows]), np.uint8).reshape(-1, width)
        symbols = self.first_ids[flat]
        symbols[np.arange(width) >= np.array([len(r) for r in rows])[:, None]] = -1
        tree = np.full((len(rows), 2 * width), _NONE)
        tree[:, width:-1] = self._ranks(symbols[:, :-1], symbols[:, 1:]) + np.arange(width - 1)
        k = width // 2
        while k:
            np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2], out=tree[:, k : 2 * k])
            k //= 2
        after = np.tile(np.arange(1, width + 1), (len(rows), 1))
        before = after - 2
        live = np.arange(len(rows))
        while True:
            top = tree[live, 1]
            live, top = live[top < _NONE], top[top < _NONE]
            if not len(live):
                break
            at, new = top & _PLACE, self.made_ids[top >> 32]
            gone, left = after[live, at], before[live, at]
            right = after[live, gone]
            symbols[live, at], symbols[live, gone], after[live, at] = new, -1, right
            some = right < width
            before[live[some], right[some]] = at[some]
            follows = np.where(some, symbols[live, np.minimum(right, width - 1)], -1)
            tree[live, width + gone] = _NONE
            tree[live, width + at] = self._ranks(new, follows) + at
            some = left >= 0
            tree[live[some], width + left[some]] = self._ranks(symbols[live[some], left[some]], new[some]) + left[some]
            for changed in (gone, at, np.maximum(left, 0)):
                node = (width + changed) >> 1
                while node[0]:
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
                    node >>= 1
        held = symbols >= 0
        ids, ends = symbols[held].tolist(), np.cumsum(held.sum(axis=1)).tolist()
        return [ids[a:z] for a, z in zip([0, *ends], ends, strict=False)]

    def merge_all(self, pieces: list[str]) -> list[list[int]]:
        """merge() of each pre-token's bytes."""
        out: list[list[int]] = [[] for _ in pieces]
        widths: dict[int, list[int]] = {}
        raw = [p.encode() for p in pieces]
        for k, r in enumerate(raw):
            if len(r) > _WIDEST:
                out[k] = self.merge([self.first[b] for b in r])
            else:
                widths.setdefault(1 << (max(2, len(r)) - 1).bit_length(), []).append(k)
        for width, places in widths.items():
            for at in range(0, len(places), _ROWS):
                some = places[at : at + _ROWS]
                for k, ids in zip(some, self._merge_rows([raw[k] for k in some], width), strict=True):
                    out[k] = ids
        return out

    def _shown(self, ids: list[int]) -> tuple[tuple[int, ...], bytes, bytes]:
        """Ids, the same in decimals with a comma before each, and the bytes that they decode to."""
        return tuple(ids), b"".join([b",%d" % i for i in ids]), b"".join([self.bytes[i] for i in ids])

    def _cut(self, text: str) -> list[int | tuple[list[str], list[str]]]:
        """The text as ids of special tokens, and for what lies between them (pre-tokens, words behind them).

        A blank before a word, and the first of a run of white space, always begin a pre-token. So where single blanks
        and line breaks part all words, all but the first can be words: what follows a blank, or a line break and what
        follows it. Other texts are cut into pre-tokens.
        """
        special = self.special and self.special.search(text)
        out: list = []
        for part in self.special.split(text) if special else [text]:
            if special and part in self.added:
                out.append(self.added[part])
                continue
            words = part.replace("\n", " \n").split(" ")
            if "" in words or any(map(part.__contains__, _ODD_ASCII if part.isascii() else _ODD)):
                out.append((self.pieces(part), []))
            else:
                out.append((self.pieces(words.pop(0)), words))
        return out

    def _together(self, texts: list[str]) -> Iterator[list[tuple[tuple[int, ...], bytes, bytes]]]:
        cut = [self._cut(t) for t in texts]
        spans = [x for parts in cut for x in parts if isinstance(x, tuple)]
        words = self.words.missing(set(chain.from_iterable([x[1] for x in spans])))
        found = {w: self.pieces(w if w[:1] == "\n" else " " + w) for w in words}
        pieces = self.known.missing(set(chain.from_iterable([x[0] for x in spans])).union(*found.values()))
        known, of = self.known.new, self.words.new
        for piece, ids in zip(pieces, self.merge_all(pieces), strict=True):
            known[piece] = self._shown(ids)
        for word, parts in found.items():
            some = [known[p] for p in parts]
            of[word] = some[0] if len(some) == 1 else (tuple(chain.from_iterable([p[0] for p in some])), b"".join([p[1] for p in some]), b"".join([p[2] for p in some]))
        for parts in cut:
            out = []
            for x in parts:
                if isinstance(x, tuple):
                    out.extend(map(known.__getitem__, x[0]))
                    out.extend(map(of.__getitem__, x[1]))
                else:
                    out.append(self._shown([x]))
            yield out
        for held, new in ((known, pieces), (of, words)):
            for long in [x for x in new if len(x) > LONGEST]:
                del held[long]

    def parts(self, texts: Iterable[str]) -> Iterator[list[tuple[tuple[int, ...], bytes, bytes]]]:
        """For each text its ids, decimals and bytes, part by part. Some texts are taken together, for their new words' sake."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def encode(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        for parts in self.parts(texts):
            yield list(chain.from_iterable([p[0] for p in parts]))

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special ones too; bytes that are no UTF-8 become U+FFFD."""
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def _codec(vocabulary: bytes) -> Codec:
    """One codec for each worker and vocabulary."""
    key = hash(vocabulary)
    if key not in _CODECS:
        _CODECS[key] = Codec(vocabulary)
    return _CODECS[key]


def encode_texts(docs: DataFrame, vocabulary: bytes, text_col: str = "text") -> DataFrame:
    """docs with ids (array<int>) and decoded. Null and empty texts have no ids and decode to ''.

    Every row is taken by itself, whatever its other columns hold; ids and decoded replace columns so named.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("ids array<int>, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared.value)
        for texts in batches:
            ids = list(codec.encode([t or "" for t in texts]))
            yield pd.DataFrame({"ids": ids, "decoded": [codec.decode(i) for i in ids]})

    (out,) = fresh(docs, "codec_out")
    return docs.drop("ids", "decoded").withColumn(out, run(F.col(text_col))).select("*", f"{out}.ids", f"{out}.decoded").drop(out)


def digest_texts(docs: DataFrame, vocabulary: bytes, text_col: str = "text") -> DataFrame:
    """As encode_texts, but n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 in place of ids and text."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec, sha = _codec(shared.value), hashlib.sha256
        for texts in batches:
            rows = []
            for parts in codec.parts([t or "" for t in texts]):
                decimals = b"".join([p[1] for p in parts])
                decoded = b"".join([p[2] for p in parts]).decode("utf-8", "replace")
                rows.append((decimals.count(b","), sha(decimals[1:]).hexdigest(), sha(decoded.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    (out,) = fresh(docs, "codec_out")
    return docs.drop(*names).withColumn(out, run(F.col(text_col))).select("*", *[f"{out}.{n}" for n in names]).drop(out)
