"""Problem 8: the language of each document and of each passage in another language.

Method: prediction by partial matching. Every language has a byte context tree of variable order with escape probabilities
(method C with exclusion). Counts are fitted once on a bounded sample of labelled documents and then frozen; the score of a
sentence is the exact length in bits of its words' code under each language's tree, each word coded from its leading to its
trailing space. As contexts do not reach over a word's start, a word's nine code lengths are kept in a bounded cache, and a
sentence costs one sum. Labels are often wrong, so the sample's sentences are scored under a first fit and those that contradict
their label are left out of the second one.

What counts as prose: paragraphs, quotations and list items. Code blocks, code spans, commands, log lines, diffs, addresses,
identifiers, headings, title lines and quoted terms are left out. A quotation that ends like a sentence is prose. Sentences of any
length from two words are scored (a word alone is a term); a short one needs LEAST_BITS of evidence to stand for a language.

Defined results: null, empty, blank and prose-free texts give no rows; equal texts give equal rows under each id; texts are
read whole; a label that names no language of the nine (or none at all) names none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGS = ("de", "en", "es", "fr", "ja", "nl", "pl", "pt", "ru")
ORDER = 5
SAMPLE_DOCS = 300  # labelled documents per language that the fit may use
MIN_WORDS = 4  # shorter sentences don't take part in the fit
FOREIGN = 8  # a word that another language uses so many times as often is not fitted on
MARGIN_BITS = 6.0  # a word, by which another language must beat the document's own for a sentence to count as a passage in it
LEAST_BITS = 24.0  # what a sentence must show at least, however short it is
CACHE_WORDS = 300_000

NAMES = {
    "de": "de ger deu german deutsch", "en": "en eng english", "es": "es spa spanish español castellano", "fr": "fr fre fra french français",
    "ja": "ja jp jpn japanese 日本語", "nl": "nl dut nld dutch nederlands", "pl": "pl pol polish polski", "pt": "pt por portuguese português", "ru": "ru rus russian русский",
}
CODE_OF = {name: code for code, names in NAMES.items() for name in names.split()}
# One or two sentences a language, so that each has a tree even where a table has no labelled document in it.
SEEDS = {
    "de": "Das ist ein kurzer Satz, der zeigt, wie die Sprache aussieht, und er wird nicht mit den anderen Sprachen verwechselt, wenn man ihn liest.",
    "en": "This is a short sentence that shows what the language looks like, and it will not be taken for one of the others when somebody reads it.",
    "es": "Esta es una frase corta que muestra cómo es la lengua, y no se confunde con las otras cuando alguien la lee en el archivo.",
    "fr": "Ceci est une phrase courte qui montre à quoi ressemble la langue, et elle ne sera pas confondue avec les autres quand on la lit.",
    "ja": "これは言語がどのように見えるかを示す短い文です。読むときに他の言語と間違えることはありません。",
    "nl": "Dit is een korte zin die laat zien hoe de taal eruitziet, en hij wordt niet met de andere talen verward wanneer iemand het leest.",
    "pl": "To jest krótkie zdanie, które pokazuje, jak wygląda język, i nie będzie pomylone z innymi, gdy ktoś je przeczyta w pliku.",
    "pt": "Esta é uma frase curta que mostra como é a língua, e não se confunde com as outras quando alguém a lê no ficheiro.",
    "ru": "Это короткое предложение, которое показывает, как выглядит язык, и его не спутают с другими, когда кто-нибудь его прочитает.",
}

FENCE = re.compile(r"^[ \t>]*(`{3,}|~{3,})[^\n]*\n(?:.*?\n)??[ \t>]*\1[`~]*[ \t]*$|^[ \t>]*(?:`{3,}|~{3,})[^\n]*\n.*\Z", re.S | re.M)
SPANS = re.compile(r"`[^`\n]*`|<[^<>\s]+>|\[([^\]\n]*)\]\([^)\n]*\)|\(?[\"“«„](?:[^\"“”«»„\n]*[^\"“”«»„\n.!?…。！？])?[\"”»“]\)?", re.A)
MARKED = re.compile(r"[`<\[\"“«„]")
ADDRESS = re.compile(r"https?://\S+", re.A)
ITEM = re.compile(r"(?:[-*+•·]|\d+[.)])\s+")
HEADING = re.compile(r"#{1,6}\s|=+\s|!\s|h[1-6]\.\s", re.I)
COMMANDLIKE = re.compile(r"[$%>]\s|\[|\{|\}|@@|diff |index |\+\+\+|---|\d{4}-\d\d-\d\d|[A-Z]+:\S|\||//|/\*")
ENDS = re.compile(r"(?<=[.!?;:…])[\s\"')*_]+|(?<=[。！？])")
WORDS = re.compile(r"[a-zß-öø-ÿĀ-ſа-яё]+|[ァ-ヺー]+|[一-龯々]+|[ぁ-ゖ]+|(?:(?![a-zß-öø-ÿĀ-ſа-яёァ-ヺー一-龯々ぁ-ゖ])[^\W\d_])+")
SCRIPT_JA = re.compile(r"[ぁ-ゖァ-ヺ一-龯]")
HYPHEN = re.compile(r"(?<=[^\W\d_])-\n[ \t>]*(?=[^\W\d_])")
LATIN_WORDS = re.compile(r"[a-z]+")


def label_code(label: str | None) -> str | None:
    """The two-letter code a label names, whatever its spelling; None for none, a placeholder or another language."""
    if not label:
        return None
    text = label.strip().lower()
    return CODE_OF.get(text) or CODE_OF.get(re.split(r"[-_ ]", text)[0])


def normalise(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).replace("’", "'").replace("​", "").replace("﻿", "").replace("­", "")
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def sentences(text: str) -> list[str]:
    """The sentences of a text's prose, in order."""
    text = normalise(text)
    if "```" in text or "~~~" in text:
        text = FENCE.sub("\n\n", text)
    if "-\n" in text:
        text = HYPHEN.sub("", text)
    if MARKED.search(text):
        text = SPANS.sub(r" \1 ", text)
    if "://" in text:
        text = ADDRESS.sub(" ", text)
    out: list[str] = []
    block: list[str] = []

    def close() -> None:
        whole = " ".join(block)
        block.clear()
        parts = ENDS.split(whole)
        if len(parts) == 1 and whole[-1] not in ".!?;:。！？…":
            if (len(whole) < 16) if SCRIPT_JA.search(whole) else (whole.count(" ") < 7):
                return  # a title line
        out.extend(parts)

    for line in text.split("\n"):
        line = line.strip()
        first = line[:1]
        while first == ">":
            line = line[1:].lstrip()
            first = line[:1]
        if not first:
            if block:
                close()
        elif first.isalpha() and ":" not in line[:12] and not line.startswith(("diff ", "index ")):
            block.append(line)
        else:
            if block:
                close()
            if m := ITEM.match(line):
                out.extend(ENDS.split(line[m.end() :]))
            elif not HEADING.match(line) and not COMMANDLIKE.match(line):
                block.append(line)
    if block:
        close()
    return out


def words_of(sentence: str) -> list[str]:
    sentence = sentence.lower()
    return LATIN_WORDS.findall(sentence) if sentence.isascii() else WORDS.findall(sentence)


class ContextTree:
    """Byte contexts of variable order with frozen counts."""

    def __init__(self, counts: dict[str, float]):
        tree: dict[bytes, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        for word, n in counts.items():
            data = f" {word} ".encode()
            for i in range(1, len(data)):
                for k in range(0, min(i, ORDER) + 1):
                    tree[data[i - k : i]][data[i]] += n
        self.tree = {c: (dict(t), sum(t.values())) for c, t in tree.items()}

    def bits(self, word: str) -> float:
        """Exact code length of a word with its closing space."""
        data = f" {word} ".encode()
        total = 0.0
        for i in range(1, len(data)):
            byte, excluded, p = data[i], (), 1.0
            for k in range(min(i, ORDER), -1, -1):
                node = self.tree.get(data[i - k : i])
                if node is None:
                    continue
                seen, weight = node
                if excluded:
                    weight -= sum(seen.get(x, 0) for x in excluded)
                kinds = len(seen) - sum(x in seen for x in excluded)
                if kinds <= 0:
                    continue
                if byte in seen:
                    p *= seen[byte] / (weight + kinds)
                    break
                p *= kinds / (weight + kinds)
                excluded = seen.keys()
            else:
                p /= 256
            total -= math.log2(p)
        return total


def stripped(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


class Scorer:
    """Nine code lengths a word, kept; and of sentences by adding them up."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.trees = []
        for lang in LANGS:
            own: Counter = Counter()
            for word, n in (Counter(words_of(SEEDS[lang])) + Counter(counts.get(lang, {}))).items():
                own[word] += n
                if not word.isascii() and not SCRIPT_JA.search(word) and (plain := stripped(word)) != word:
                    own[plain] += max(1, n // 4)
            self.trees.append(ContextTree(own))
        self.reset()

    def reset(self) -> None:
        self.rows: list[list[float]] = [[0.0] * len(LANGS)]
        self.row_of: dict[str, int] = {}
        self.table = np.array(self.rows)

    def row(self, word: str) -> int:
        at = self.row_of.get(word)
        if at is None:
            at = self.row_of[word] = len(self.rows)
            # letters beyond any natural word add nothing that tells languages apart, but the whole word is coded
            self.rows.append([t.bits(word) for t in self.trees])
        return at

    def score(self, lists: list[list[str]]) -> np.ndarray:
        """Bits under each language, for each list of words."""
        if len(self.row_of) > CACHE_WORDS:
            self.reset()
        flat = list(chain.from_iterable(lists))
        known = self.row_of
        for word in set(flat) - known.keys():
            self.row(word)
        if len(self.table) != len(self.rows):
            self.table = np.array(self.rows)
        index = np.fromiter(map(known.__getitem__, flat), dtype=np.int32, count=len(flat))
        starts = np.cumsum([0, *map(len, lists[:-1])])  # no list is empty
        return np.add.reduceat(self.table[index], starts, axis=0)


def own_words(counts: dict[str, Counter]) -> dict[str, dict[str, int]]:
    """Without the words that come from passages in another language under a wrong or single label."""
    size = {lang: max(1, c.total()) for lang, c in counts.items()}
    most: dict[str, float] = {}
    for lang, c in counts.items():
        for word, n in c.items():
            most[word] = max(most.get(word, 0.0), n / size[lang])
    return {lang: {w: n for w, n in c.items() if n / size[lang] * FOREIGN >= most[w]} for lang, c in counts.items()}


def fit(rows: list[tuple[str, str]]) -> dict[str, dict[str, int]]:
    """Word counts a language from (label, text) rows: first by label, then by label where the first fit agrees."""
    lists: list[list[str]] = []
    labels: list[str] = []
    owner: list[int] = []
    n_docs: Counter = Counter()
    for number, (label, text) in enumerate(rows):
        code = label_code(label)
        if code and text:
            n_docs[code] += 1
            for s in sentences(text):
                if len(w := words_of(s)) >= MIN_WORDS:
                    lists.append(w)
                    labels.append(code)
                    owner.append(number)
    keep = [True] * len(lists)
    counts: dict[str, Counter] = {}
    for step in range(3):
        counts = {lang: Counter() for lang in LANGS}
        seen: dict[str, set] = {lang: set() for lang in LANGS}
        for words, label, ok, number in zip(lists, labels, keep, owner):
            if ok:
                counts[label].update(words)
                seen[label].update((w, number) for w in words)
        for lang in LANGS:  # what only a document or two of many hold is mostly a passage in another language
            least = 3 if n_docs[lang] >= 60 else 2 if n_docs[lang] >= 20 else 1
            in_docs = Counter(w for w, _ in seen[lang])
            counts[lang] = Counter({w: n for w, n in counts[lang].items() if in_docs[w] >= least})
        if not lists or step == 2:
            break
        best = Scorer(own_words(counts)).score(lists).argmin(axis=1)
        keep = [LANGS[b] == label for b, label in zip(best, labels)]
    return own_words(counts)


def training_rows(df: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", bound: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """At most about `bound` labelled documents per language, chosen by a hash of the id."""
    labelled = df.where(F.col(label_col).isNotNull() & (F.length(F.trim(label_col)) > 0))
    n_of: Counter = Counter()
    spellings: dict[str, list[str]] = defaultdict(list)
    for r in labelled.groupBy(label_col).count().collect():  # as many rows as there are spellings of labels
        if code := label_code(r[0]):
            n_of[code] += r[1]
            spellings[code].append(r[0])
    wanted = None
    for code, n in n_of.items():
        share = F.col(label_col).isin(spellings[code]) & (F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < min(1_000_000, int(1_000_000 * bound / n)))
        wanted = share if wanted is None else wanted | share
    if wanted is None:
        return []
    # the bound holds in expectation; the limit only guards the driver against a hash that fails to spread
    return [tuple(r) for r in labelled.where(wanted & F.col(text_col).isNotNull()).select(label_col, text_col).limit(2 * bound * len(LANGS)).collect()]


def confidence(bits: np.ndarray, best: int) -> float:
    """Posterior of the best language under equal priors, from code lengths."""
    return float(1.0 / np.exp2(np.maximum(bits[best] - bits, -60.0)).sum())


def passages(lists: list[list[str]], scores: np.ndarray) -> list[list]:
    """Runs of sentences in one language: [lang index, sentences, words, bits]. A sentence that is too short, or no language of which
    is better by MARGIN_BITS a word than the text's own, goes with the text's own or the run it stands in."""
    if not lists:
        return []
    votes = np.zeros(len(LANGS))
    best = scores.argmin(axis=1)
    sizes = np.array([len(x) for x in lists])
    if (best == best[0]).all() and scores.sum(axis=0).argmin() == best[0]:
        return [[int(best[0]), len(lists), int(sizes.sum()), scores.sum(axis=0)]]
    ranked = np.partition(scores, 1, axis=1)
    needed = np.maximum(MARGIN_BITS * sizes, LEAST_BITS)
    clear = ranked[:, 1] - ranked[:, 0] >= needed
    np.add.at(votes, best, sizes * np.where(clear, 4, 1))
    main = int(votes.argmax())
    sure = sorted({main, *best[clear].tolist()})  # languages between which an unclear sentence may choose
    runs: list[list] = []
    for words, row, b, plain, least in zip(lists, scores, best, clear, needed):
        b = int(b) if plain else sure[int(row[sure].argmin())]
        if b != main and row[main] - row[b] < least:
            b = main
        if runs and runs[-1][0] == b:
            runs[-1][1] += 1
            runs[-1][2] += len(words)
            runs[-1][3] = runs[-1][3] + row
        else:
            runs.append([b, 1, len(words), row.copy()])
    return runs


_SCORERS: dict[str, Scorer] = {}


def scorer_for(key: str, counts: dict) -> Scorer:
    """One scorer a worker process, for the statistics last used."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(counts)
    return _SCORERS[key]


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", counts: dict | None = None) -> DataFrame:
    """(id, segment, lang, confidence, n_sentences, n_words, labelled): a row per passage, in order. A narrow map; the broadcast is the
    frozen statistics, bounded by the sample."""
    if counts is None:
        counts = fit(training_rows(df, text_col, label_col, id_col))
    held = df.sparkSession.sparkContext.broadcast(counts)
    key = hashlib.sha256(json.dumps(counts, sort_keys=True).encode()).hexdigest()
    id_type = df.schema[id_col].dataType.simpleString()
    names = [id_col, "segment", "lang", "confidence", "n_sentences", "n_words", "labelled"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_for(key, held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, texts, labels = (c.to_pylist() for c in part.columns)
                lists, owner = [], []
                for k, text in enumerate(texts):
                    if text:
                        for s in sentences(text):
                            if len(w := words_of(s)) > 1:  # a word alone is a term
                                lists.append(w)
                                owner.append(k)
                if not lists:
                    continue
                scores = scorer.score(lists)
                bounds = np.searchsorted(np.array(owner), np.arange(len(texts) + 1))
                out: list[list] = [[] for _ in names]
                for k in range(len(texts)):
                    a, b = bounds[k], bounds[k + 1]
                    if a == b:
                        continue
                    code = label_code(labels[k])
                    for no, (lang, n, words, bits) in enumerate(passages(lists[a:b], scores[a:b]), 1):
                        for column, value in zip(out, (ids[k], no, LANGS[lang], confidence(bits, lang), n, words, code)):
                            column.append(value)
                kinds = [part.schema.field(0).type, pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return df.select(id_col, text_col, label_col).mapInArrow(run, f"{id_col} {id_type}, segment int, lang string, confidence double, n_sentences int, n_words int, labelled string")


def unlabelled(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(id, lang): the languages that occur as a passage and that the label doesn't name. Small rows are all that is shuffled."""
    found = identify(df, id_col, text_col, label_col)
    return found.where(F.col("labelled").isNull() | (F.col("lang") != F.col("labelled"))).select(id_col, "lang").distinct()
