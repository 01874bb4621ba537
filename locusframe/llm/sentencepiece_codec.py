"""Exact merge-type (BPE) encoding by backtracking, with a SentencePiece model's pieces and scores.

Merging picks the adjacent pair whose union is the best-scored piece, leftmost first. A token sequence is
the outcome of that if its first token merges to itself and every adjacent pair, merged again on its own,
falls apart into the same two tokens. So the encoder takes the longest piece at each position (all matches
come from one Aho-Corasick pass), falls back to shorter pieces where a pair does not hold, and marks
positions from which nothing fits in a bitfield, so that none is tried twice. Decoding is the library's own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .shared import fresh

SPACE = "▁"
#: Most words and pairs that a worker remembers before it starts anew; this bounds memory and changes no result.
REMEMBERED = 400_000


class _Words(dict):
    """Ids of words; a word is encoded when it is first asked for."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        ids = self[word] = self.encode(word if word[0] == "\n" else SPACE + word)
        return ids


class Codec:
    """Encoder and decoder for one model, given as the bytes of its file."""

    def __init__(self, model: bytes, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.piece = {i: sp.id_to_piece(i) for i in plain}
        self.ids = {p: i for i, p in self.piece.items()}
        self.scores = {p: sp.get_score(i) for i, p in self.piece.items()}
        self.bytes = {sp.id_to_piece(i): i for i in range(size) if sp.is_byte(i)}
        self.known = {p for p in self.ids if len(p) == 1}
        #: when merging makes a piece: better scores first, single characters are there from the start
        self.order = {i: -self.scores[p] if len(p) > 1 else -1.0 for i, p in self.piece.items()}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.matches = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.matches.add_word(p, (len(p), i))
        self.matches.make_automaton()
        self.end_id = sp.eos_id()
        # where no piece continues past a space or spans a line break, texts can be cut there
        cuttable = not any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", p, re.S) for p in self.ids)
        self.chunks = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+" if cuttable else r"(?s).+")
        self.plain_text = sp.normalize("ﬁ  X ½ ") == "▁ﬁ▁▁X ½▁"
        self.cuttable = cuttable
        self.words = _Words(self._shown, remembered)
        self.pairs: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merging joins last on the way to token; None if it never gets there."""
        if token not in self.split:
            parts = list(self.piece[token])
            while len(parts) > 2:
                unions = [self.scores.get(x + y) for x, y in zip(parts, parts[1:], strict=False)]
                best = max((u for u in unions if u is not None), default=None)
                if best is None:
                    break
                at = unions.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.split[token] = (self.ids[parts[0]], self.ids[parts[1]]) if len(parts) == 2 else None
        return self.split[token]

    def holds(self, last: int, token: int) -> bool:
        """Whether token may follow last; last = -1 stands for the start of the text."""
        key = (last << 32) + token
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= self.remembered:
                self.pairs.clear()
            found = self.pairs[key] = self._compatible(last, token)
        return found

    def _compatible(self, last: int, token: int) -> bool:
        """Merges the two again: undoes the latest merge on either side of the border, one at a time, and asks
        whether the parts that then meet would have merged before it. Of equal merges, the left comes first."""
        order = self.order
        if any(i >= 0 and order[i] >= 0 and self.halves(i) is None for i in (last, token)):
            return False
        if last < 0:
            return True
        left, right, before = last, token, float("inf")
        while True:
            union = self.ids.get(self.piece[left] + self.piece[right])
            if union is not None and order[union] < before:
                return False
            if order[left] > order[right]:
                before = order[left]
                left = self.halves(left)[1]
            elif order[right] >= 0:
                before = order[right] + 0.5
                right = self.halves(right)[0]
            else:
                return True

    def next_shorter(self, token: int) -> int:
        """The longest piece that is a proper prefix of token, or -1."""
        found = self.shorter.get(token)
        if found is None:
            p = self.piece[token]
            found = self.shorter[token] = next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), -1)
        return found

    def _run(self, text: str) -> list[int]:
        """Tokens of a text all of whose characters are pieces."""
        n = len(text)
        longest = [-1] * n
        for end, (size, token) in self.matches.iter(text):
            longest[end - size + 1] = token  # of matches with one start, longer ones end later
        failed = bytearray(n + 1)
        tokens: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = tokens[-1] if tokens else -1
            while token >= 0:
                end = at + len(self.piece[token])
                if not failed[end] and self.holds(last, token):
                    break
                token = self.next_shorter(token)
            if token >= 0:
                tokens.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif tokens:
                failed[at] = 1
                last = tokens.pop()
                at -= len(self.piece[last])
                token = self.next_shorter(last)
            else:
                raise ValueError(f"no piece sequence for {text[:80]!r}")
        return tokens

    def _chunk(self, text: str) -> tuple[int, ...]:
        if self.known.issuperset(text):
            return tuple(self._run(text))
        out: list[int] = []
        known = ""
        for c in chain(text, [None]):
            if c in self.known:
                known += c
                continue
            if known:
                out += self._run(known)
                known = ""
            if c is not None:
                out += [self.bytes[f"<0x{b:02X}>"] for b in c.encode()]
        return tuple(out)

    def _shown(self, shown: str) -> tuple[int, ...]:
        """Ids of a text in which spaces are written as the model does."""
        return tuple(chain.from_iterable(map(self._chunk, self.chunks.findall(shown))))

    def word_ids(self, text: str) -> list[tuple[int, ...]]:
        """Ids of text in parts; where single spaces part all words, each word is remembered."""
        if not text:
            return []
        # the first word of a line takes the break before it along
        spaced = text.replace("\n", " \n")
        if not (self.plain_text and self.cuttable) or "  " in spaced or spaced[0] == " " or text[-1] == " " or SPACE in text:
            return [self._shown(SPACE + text.replace(" ", SPACE) if self.plain_text else self.library.normalize(text))]
        return list(map(self.words.__getitem__, spaced.split(" ")))

    def encode(self, text: str) -> list[int]:
        """Ids of text, without an end id."""
        return list(chain.from_iterable(self.word_ids(text)))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_CODECS: dict[tuple[int, int], Codec] = {}


def _codec(model: bytes, remembered: int = REMEMBERED) -> Codec:
    """One codec for each worker, model and size of memory."""
    key = hash(model), remembered
    if key not in _CODECS:
        _CODECS[key] = Codec(model, remembered)
    return _CODECS[key]


def read_model(path: str) -> bytes:
    """A public vocabulary file; it holds a fixed vocabulary, so it is of bounded size."""
    with open(path, "rb") as file:
        return file.read()


def encode_texts(docs: DataFrame, model: bytes, text_col: str = "text", end: bool = True) -> DataFrame:
    """docs with ids (array<int>) and decoded. Null texts count as empty: only an end id, decoded to ''.

    Every row is taken by itself, whatever its other columns hold; ids and decoded replace columns so named.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("ids array<int>, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared.value)
        for texts in batches:
            ids = [codec.encode(t or "") for t in texts]
            decoded = [codec.decode(i) for i in ids]
            yield pd.DataFrame({"ids": [i + [codec.end_id] * end for i in ids], "decoded": decoded})

    (out,) = fresh(docs, "codec_out")
    return docs.drop("ids", "decoded").withColumn(out, run(F.col(text_col))).select("*", f"{out}.ids", f"{out}.decoded").drop(out)


def digest_texts(docs: DataFrame, model: bytes, text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """As encode_texts with an end id, but n_tokens, ids_sha256 and decoded_sha256 in place of ids and text. remembered: words and
    pairs that a worker holds, for the sake of memory; results do not depend on it."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared.value, remembered)
        names = [str(i) for i in range(codec.library.get_piece_size())]
        sha = hashlib.sha256
        for texts in batches:
            rows = []
            for text in texts:
                ids = codec.encode(text or "")
                ids.append(codec.end_id)
                rows.append((len(ids), sha(" ".join([names[i] for i in ids]).encode()).hexdigest(), sha(codec.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    (out,) = fresh(docs, "codec_out")
    return docs.drop(*names).withColumn(out, run(F.col(text_col))).select("*", *[f"{out}.{n}" for n in names]).drop(out)
