"""Problem 6: the whole corpus as token ids of a public byte-level BPE vocabulary.

The merges are compiled into a finite-state transducer over bytes. A state is the set of live hypotheses about where the
next token began; each hypothesis keeps the last complete token, the tokens not yet emitted and a node of the vocabulary's
trie. Reading a byte advances every hypothesis, and what all hypotheses agree on is emitted, so a token comes out after a
lookahead bounded by the longest vocabulary entry. States and transitions are made the first time they are needed
(lazy determinisation) and kept. Pieces of text between which no merge can reach (the pattern's matches) are memoised in a
bounded cache in front of the transducer; the cache changes the speed, never the ids.

Defined results: a null text and an empty text both give an empty list; texts are tokenised whole; rows are never merged or
dropped (two equal rows give two equal rows); names of special tokens in a text are ordinary text; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
# The split pattern of the public vocabulary, with the white space class spelled out.
PIECES = regex.compile(rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
ASCII_PIECES = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
CACHE_ENTRIES = 400_000
DEFAULT_DIR = "/opt/tokenizers"
ROOT = 0


class BpeTransducer:
    """Lazily determinised transducer for the byte-level BPE given by `ranks` (token bytes -> id, lower merges first)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for word, number in ranks.items():
            node = ROOT
            for byte in word:
                nxt = self.children[node].get(byte)
                if nxt is None:
                    nxt = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = number
        self.fits: dict[tuple[int, int], bool] = {}
        self.number_of: dict[tuple, int] = {}
        self.hypotheses: list[tuple] = []
        self.moves: list[dict[int, tuple[tuple[int, ...], int]]] = []
        self.start = self._state(((-1, (), ROOT),))

    def _state(self, hypotheses: tuple) -> int:
        number = self.number_of.get(hypotheses)
        if number is None:
            number = self.number_of[hypotheses] = len(self.hypotheses)
            self.hypotheses.append(hypotheses)
            self.moves.append({})
        return number

    def _merge(self, word: bytes) -> list[bytes]:
        """Plain merging by rank: the definition of the encoding, used to decide which neighbours can stand together."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, left: int, right: int) -> bool:
        """Whether `right` can follow `left` in an encoding; left -1 is the beginning."""
        known = self.fits.get((left, right))
        if known is None:
            a, b = self.bytes_of.get(left, b""), self.bytes_of[right]
            known = self.fits[left, right] = self._merge(a + b) == ([a, b] if a else [b])
        return known

    def _advance(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        live, ended = [], None
        for last, pending, node in self.hypotheses[state]:
            nxt = self.children[node].get(byte)
            if nxt is None:
                continue
            token = self.token_at[nxt]
            if token >= 0 and ended is None and self._compatible(last, token):
                ended = (token, (*pending, token), ROOT)
            if self.children[nxt]:
                live.append((last, pending, nxt))
        assert ended is not None, "every single byte is a token"
        live.append(ended)
        shared = 0
        first = live[0][1]
        while all(len(p) > shared and p[shared] == first[shared] for _, p, _ in live if len(first) > shared) and len(first) > shared:
            shared += 1
        move = (first[:shared], self._state(tuple((last, p[shared:], node) for last, p, node in live)))
        self.moves[state][byte] = move
        return move

    def encode(self, word: bytes) -> tuple[int, ...]:
        out: list[int] = []
        state = self.start
        for byte in word:
            move = self.moves[state].get(byte) or self._advance(state, byte)
            if move[0]:
                out.extend(move[0])
            state = move[1]
        if word:
            out.extend(self.hypotheses[state][-1][1])
        return tuple(out)


class PieceCache(dict):
    """Ids by piece of text; emptied when full, so a worker's memory stays bounded whatever the corpus holds."""

    def __init__(self, transducer: BpeTransducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.transducer.encode(piece.encode("utf-8", "replace"))
        if len(self.transducer.hypotheses) > CACHE_ENTRIES:
            self.transducer.__init__(self.transducer.ranks)
        if len(piece) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


def pieces(text: str) -> list[str]:
    return (ASCII_PIECES if text.isascii() else PIECES).findall(text)


class Utf8Machine:
    """Incremental UTF-8: a state machine over bytes; bytes that can't continue give U+FFFD, as the standard recommends."""

    def __init__(self) -> None:
        self.need, self.code, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            if self.need:
                if self.low <= byte <= self.high:
                    self.code = self.code << 6 | byte & 0x3F
                    self.low, self.high = 0x80, 0xBF
                    self.need -= 1
                    if not self.need:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.need, self.low, self.high = 0, 0x80, 0xBF
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xDF:
                self.need, self.code = 1, byte & 0x1F
            elif 0xE0 <= byte <= 0xEF:
                self.need, self.code = 2, byte & 0x0F
                self.low, self.high = (0xA0 if byte == 0xE0 else 0x80), (0x9F if byte == 0xED else 0xBF)
            elif 0xF0 <= byte <= 0xF4:
                self.need, self.code = 3, byte & 0x07
                self.low, self.high = (0x90 if byte == 0xF0 else 0x80), (0x8F if byte == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        broken, self.need = self.need, 0
        self.low, self.high = 0x80, 0xBF
        return "�" if broken else ""


def stream_decode(ids: Iterable[int], bytes_of: dict[int, bytes]) -> Iterator[str]:
    """Text as soon as its characters are whole, token by token; unknown ids raise KeyError."""
    machine = Utf8Machine()
    for number in ids:
        if text := machine.feed(bytes_of[int(number)]):
            yield text
    if text := machine.close():
        yield text


def vocabulary_bytes(directory: str | None = None, name: str = "byte_bpe_50k") -> bytes:
    directory = directory or os.environ.get("TESSERA_TOKENIZERS", DEFAULT_DIR)
    with open(os.path.join(directory, f"{name}.tiktoken"), "rb") as file:
        return file.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


@lru_cache(maxsize=2)
def cache_for(data: bytes) -> PieceCache:
    return PieceCache(BpeTransducer(parse_ranks(data)))


def encode_batch(texts: Iterable[str | None], cache: PieceCache) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of all texts, laid end to end."""
    look, flat, ends = cache.__getitem__, [], [0]
    for text in texts:
        if text:
            flat.extend(chain.from_iterable(map(look, pieces(text))))
        ends.append(len(flat))
    return np.array(ends, dtype=np.int32), np.array(flat, dtype=np.int32)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", directory: str | None = None, name: str = "byte_bpe_50k", out: str = "ids") -> DataFrame:
    """(id_col, out): one row per row of df. A narrow map: no shuffle. The broadcast is the vocabulary file, of fixed size."""
    held = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(directory, name))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_for(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ends, flat = encode_batch(part.column(1).to_pylist(), cache)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[id_col, out])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, {out} array<int>")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", directory: str | None = None, name: str = "byte_bpe_50k") -> DataFrame:
    """(id, n_ids, same): whether streaming decoding gives each text back; a null text counts as empty."""
    held = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(directory, name))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_for(held.value)
        bytes_of = cache.transducer.bytes_of
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lists = [list(chain.from_iterable(map(cache.__getitem__, pieces(t)))) if t else [] for t in texts]
            same = ["".join(stream_decode(ids, bytes_of)) == (t or "") for ids, t in zip(lists, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in lists], pa.int32()), pa.array(same)], names=[id_col, "n_ids", "same"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, n_ids int, same boolean")
