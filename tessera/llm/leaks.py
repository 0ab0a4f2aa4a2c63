"""Problem 7: evaluation items whose passages stand in corpus documents.

Method. Texts become sequences of folded words. Every window of an item and every window of a document is embedded by a CGK random
walk: in step j the walk emits the word it stands on and moves on if a random bit of (j, word) says so, which maps a small edit
distance to a small Hamming distance. TABLES independent walks each sample SAMPLED of their STEPS positions (bit sampling); equal
samples make a candidate. A walk of STEPS steps never reads more than PASSAGE words, so two equal runs of that length collide in
every table, whatever the bits; reworded passages collide in some table at one of their many starts. Candidates are then
verified exactly: a common run of PASSAGE words, or a window of REWORDED item words of which KEPT stand in order in a document window.

The items are the stated query set: they are read in blocks of about BLOCK_BYTES of text, of which one at a time is on the driver,
and each block's index is broadcast; documents stay where they are, a block is one narrow pass over them (a million items of 500
bytes make 16). All windows of all items and whole documents take part.

Defined results: null or empty documents and items give no rows; items shorter than PASSAGE words can't leak; equal documents
each give their rows; repeated rows of a document or item give one row a pair; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

PASSAGE = 12
REWORDED, KEPT, SLACK = 20, 16, 5
STEPS, SAMPLED, TABLES = PASSAGE - 1, 6, 10
BLOCK_BYTES = 32 << 20
DRIFT = SLACK + REWORDED - KEPT  # words inserted or dropped on one side of a place that both texts share
SEED = 20_25

PAD = [0] * (REWORDED + DRIFT + 1)  # between texts, longer than any window looks
WORD = re.compile(r"[^\W_]+")
ASCII_WORD = re.compile(r"[a-z0-9]+")
COMBINING = re.compile("[̀-ͯ​-‍⁠﻿­]")
BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?:>[ \t]*)*(?=[^\W\d_])")
MARKUP = re.compile(r"\]\([^)\s]*\)|</?[A-Za-z][^<>\n]*>|<!--.*?-->", re.S)


def folded_words(text: str) -> list[str]:
    """Words without case, accents, width, punctuation, markup and line breaks."""
    if "-\n" in text or "-\r" in text or "- " in text:
        text = BROKEN.sub("", text)
    if "](" in text or "<" in text:
        text = MARKUP.sub(" ", text)
    if text.isascii():
        return ASCII_WORD.findall(text.lower())
    text = COMBINING.sub("", unicodedata.normalize("NFKD", text)).casefold()
    return WORD.findall(text)


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = where.get(y)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def holds_passage(doc: list[int], item: list[int], p: int, q: int) -> bool:
    """Whether around doc[p] ~ item[q] a passage of the item stands: exact, by its definition."""
    a, b = p, q
    while a > 0 and b > 0 and doc[a - 1] == item[b - 1] != 0:
        a, b = a - 1, b - 1
    run = 0
    while a + run < len(doc) and b + run < len(item) and doc[a + run] == item[b + run] != 0:
        run += 1
    if run >= PASSAGE:
        return True
    near_doc = doc[max(0, p - REWORDED - SLACK) : p + REWORDED + SLACK]
    near_item = item[max(0, q - REWORDED) : q + REWORDED]
    if len(near_item) < REWORDED or len(set(near_doc) & set(near_item)) < KEPT // 2:
        return False
    if lcs_length(near_item, near_doc) < KEPT:
        return False
    for start in range(max(0, q - REWORDED + 1), min(q, len(item) - REWORDED) + 1):
        window = item[start : start + REWORDED]
        at = p - (q - start)
        for shift in range(-SLACK, SLACK + 1):
            begin = at + shift
            if begin + REWORDED + SLACK <= 0:
                continue
            if lcs_length(window, doc[max(0, begin) : max(0, begin + REWORDED + SLACK)]) >= KEPT:
                return True
    return False


class ItemIndex:
    """Sampled CGK embeddings of all windows of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.word_id: dict[str, int] = {}
        self.ids: list[int] = []
        self.items: list[list[int]] = []
        for item_id, text in items:
            words = folded_words(text) if text else []
            if len(words) >= PASSAGE:
                self.ids.append(item_id)
                self.items.append([self.word_id.setdefault(w, len(self.word_id) + 1) for w in words])
        random = np.random.default_rng(SEED)
        words = len(self.word_id) + 1
        self.moves = random.integers(0, 2, size=(TABLES, STEPS, words), dtype=np.int8)
        # one random step of each of SAMPLED equal parts of the walk, so that the samples seldom stand on the same word
        edges = np.linspace(0, STEPS, SAMPLED + 1).astype(int)
        self.sampled = [np.array([random.integers(a, b) for a, b in zip(edges, edges[1:])]) for _ in range(TABLES)]
        self.mix = random.integers(1, 1 << 62, size=words, dtype=np.int64) | 1
        flat = np.array([x for item in self.items for x in [*item, *PAD]] + PAD, dtype=np.int32)
        owner = np.repeat(np.arange(len(self.items)), [len(i) + len(PAD) for i in self.items]) if self.items else np.zeros(0, int)
        offset = np.concatenate([np.arange(len(i) + len(PAD)) for i in self.items]) if self.items else np.zeros(0, int)
        starts = np.flatnonzero(flat[: len(owner)] > 0)
        self.begin = np.cumsum([0, *(len(i) + len(PAD) for i in self.items)])
        self.flat = np.concatenate([np.array(PAD), flat])
        self.tables = []
        for t in range(TABLES):
            keys, whole = self.keys(flat, starts, t)
            order = np.argsort(keys[whole], kind="stable")
            at = starts[whole][order]
            sorted_keys = keys[whole][order]
            unique, first = np.unique(sorted_keys, return_index=True)
            self.tables.append((unique, np.append(first, len(sorted_keys)), owner[at].astype(np.int32), offset[at].astype(np.int32)))

    def keys(self, flat: np.ndarray, starts: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Key of each walk, and whether all its samples are words that items have."""
        at = starts.copy()
        key = np.zeros(len(starts), dtype=np.int64)
        whole = np.ones(len(starts), dtype=bool)
        sampled = set(self.sampled[table].tolist())
        last = max(sampled)
        for j in range(last + 1):
            word = flat[at]
            if j in sampled:
                key = (key * 1_000_003) ^ self.mix[word]
                whole &= word > 0
            if j < last:
                at += self.moves[table, j][word]
        return key, whole

    def candidates(self, flat: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in flat, item, offset in item) of equal samples in any table."""
        found = []
        for t, (unique, first, owner, offset) in enumerate(self.tables):
            if not len(unique):
                continue
            keys, whole = self.keys(flat, known, t)
            keys, at = keys[whole], known[whole]
            slot = np.searchsorted(unique, keys)
            slot[slot == len(unique)] = 0
            hit = unique[slot] == keys
            slot, at = slot[hit], at[hit]
            sizes = first[slot + 1] - first[slot]
            where = np.repeat(first[slot] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            found.append(np.stack([np.repeat(at, sizes), owner[where], offset[where]]))
        if not found:
            return (np.zeros(0, int),) * 3
        return tuple(np.concatenate(found, axis=1).astype(np.int64))

    def plausible(self, flat: np.ndarray, at: np.ndarray, item: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """A necessary condition for a passage whose alignment passes through a candidate, for all at once: KEPT of REWORDED consecutive
        item words stand in the document at most DRIFT words off the diagonal, or PASSAGE of PASSAGE on it. flat begins with PAD."""
        base = self.begin[item] + offset + len(PAD)
        reach = range(-REWORDED + 1, REWORDED)
        near = np.zeros((len(reach) + 1, len(at)), dtype=np.int16)  # running sums
        exact = np.zeros_like(near)
        doc = {d: flat[at + d] for d in range(reach.start - DRIFT, reach.stop + DRIFT)}
        for k, d in enumerate(reach):
            inside = (offset + d >= 0) & (base + d < len(self.flat))
            word = np.where(inside, self.flat[np.minimum(base + d, len(self.flat) - 1)], 0)
            word[word == 0] = -1
            on = doc[d] == word
            same = on.copy()
            for shift in range(1, DRIFT + 1):
                same |= doc[d + shift] == word
                same |= doc[d - shift] == word
            near[k + 1] = near[k] + same
            exact[k + 1] = exact[k] + on
        return ((near[REWORDED:] - near[:-REWORDED]).max(axis=0) >= KEPT) | ((exact[PASSAGE:] - exact[:-PASSAGE]).max(axis=0) >= PASSAGE)


def search_texts(texts: list[str | None], index: ItemIndex) -> list[list[int]]:
    """For each text the numbers of the items of which it holds a passage."""
    get = index.word_id.get
    docs, flat, starts = [], list(PAD), [len(PAD)]
    for text in texts:
        doc = [get(w, 0) for w in folded_words(text)] if text else []
        docs.append(doc)
        flat += doc
        flat += PAD
        starts.append(len(flat))
    out: list[set[int]] = [set() for _ in texts]
    words = np.array(flat, dtype=np.int32)
    known = words > 0
    ahead = np.concatenate([np.cumsum(known), np.full(2 * PASSAGE, known.sum())])
    # a passage has at least PASSAGE words that items have among 2 * PASSAGE from its start
    first = np.flatnonzero(known & (ahead[2 * PASSAGE - 1 : 2 * PASSAGE - 1 + len(words)] - ahead[: len(words)] + 1 >= PASSAGE))
    at, item, offset = index.candidates(words, first)
    if len(at):
        # equal candidates of several tables once
        _, one = np.unique((item * len(words) + at) * (int(offset.max()) + 1) + offset, return_index=True)
        one = one[index.plausible(words, at[one], item[one], offset[one])]
        doc_no = np.searchsorted(starts, at[one], side="right") - 1
        p = at[one] - np.array(starts)[doc_no]
        for d, i, a, b in zip(doc_no.tolist(), item[one].tolist(), p.tolist(), offset[one].tolist()):
            if i not in out[d] and holds_passage(docs[d], index.items[i], a, b):
                out[d].add(i)
    return [sorted(x) for x in out]


_INDEXES: dict[str, ItemIndex] = {}


def index_of(key: str, rows: list[tuple]) -> ItemIndex:
    """The index of a block, kept by a worker process together with the last one: tasks of two blocks may take turns."""
    if key not in _INDEXES:
        while len(_INDEXES) > 1:
            _INDEXES.pop(next(iter(_INDEXES)))
        _INDEXES[key] = ItemIndex(rows)
    return _INDEXES[key]


def find_leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_col, item_id): every document and item of which it holds a passage."""
    spark = documents.sparkSession
    id_type, item_type = documents.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType
    schema = f"{id_col} {id_type}, {item_id} {item_type.simpleString()}"
    wanted = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(item_id, item_text).distinct()
    blocks = max(1, -(-(wanted.agg(F.sum(F.octet_length(item_text))).first()[0] or 0) // block_bytes))
    parts = []
    for k in range(blocks):
        rows = sorted(tuple(r) for r in wanted.where(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == k).collect())
        key = hashlib.sha256(repr(rows).encode()).hexdigest()
        parts.append(documents.select(id_col, text_col).mapInArrow(_searcher(spark.sparkContext.broadcast(rows), key, id_col, item_id, to_arrow_type(item_type)), schema))
    return reduce(DataFrame.unionByName, parts).distinct()


def _searcher(held, key: str, id_col: str, item_id: str, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(key, held.value)
        known = pa.array(index.ids, item_type)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = search_texts(part.column(1).to_pylist(), index)
                take = pa.array([k for k, items in enumerate(found) for _ in items], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), known.take(pa.array([i for items in found for i in items], pa.int32()))], names=[id_col, item_id])

    return run
