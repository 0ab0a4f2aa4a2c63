"""Problem 2: files that are generated, minified, vendored or data stored as code.

Method: a linear support-vector classifier on hashed features: character n-grams of the body, character n-grams of the leading
comment (hashed apart, so that a string that quotes a header isn't one), path components, parts of the file name and which ignore
hints of the repository match the path. Nothing else is a feature: what proves a class (a notice, a banner, an owned directory, a
layout) only labels the bounded sample the classifier is fitted on. Headers are masked in a second copy of every training row that
another mark still proves, so that files whose header was removed are recognised by their text, and headers are masked in
validation, which splits by repository.

The sample (SAMPLE_FILES) is the only bounded part; every file is scored. The model is a vector of fixed size. Files that hold no
program in any language (pages, notes, patches, settings, pointers) are left out afterwards by an exact check of their form.

Defined results: null, empty and blank contents are no cases; null paths give features of the content only; leading "./" is
ignored; repeated rows count once; very long files are read whole; ignore lists only add features, null and unusable entries none.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 17
SAMPLE_FILES = 4_000
GRAM = 5
EPOCHS, REGULARISATION = 8, 2e-5

COMMENT = r"(?://+|\#+|/\*+!?|\*+(?!/)|--|;+|<!--)"
NOTICE = re.compile(
    r"@generated\b|auto-?generated|code generated|generated (?:by|with|from|file)|automatically generated|automatisch erzeugt|do not (?:edit|modify|change)|machine-made|nicht bearbeiten|changes will be lost|générée? automatiquement|generado automáticamente",
    re.I,
)
BANNER = re.compile(r"copied from upstream|\bupstream:\s*\S+@\d|\bv?\d+\.\d+(?:\.\d+)?\b.*\|.*\bauthors\b|\|\s*(?:MIT|BSD|Apache|ISC|MPL)\b|see LICENSE\.\w|local patches by|\bvendored from\b", re.I)
MINIFIED_BANNER = re.compile(r"/\*!")
OWNED = {
    "vendor": "vendored", "vendored": "vendored", "node_modules": "vendored", "third_party": "vendored", "thirdparty": "vendored", "pods": "vendored", "external": "vendored", "extern": "vendored",
    "deps": "vendored", "bower_components": "vendored", "site-packages": "vendored",
    "gen": "generated", "generated": "generated", "__generated__": "generated", "autogen": "generated", "codegen": "generated",
}
BUILT = {"build/proto": "generated", "target/codegen": "generated", "gen/out": "generated", "api/autogen": "generated", "public/assets": "minified", "static": "minified", "dist": "minified", "www": "minified"}
NUMBERED = re.compile(r"\b([A-Za-z_]\w*?_?[A-Za-z]*?)_?(\d{1,4})(?=\b|_)")
NUMBER = re.compile(r"-?\b(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?)\b")
LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
BLOB = re.compile(r"(?:[A-Za-z0-9+/=]{24,}|(?:\\x[0-9a-fA-F]{2}){8,}|[0-9a-fA-F]{24,})")
NO_PROGRAM = re.compile(r"\A\s*(?:<!DOCTYPE\b|<html\b|<\?xml\b|diff --git |--- a/|version https?://\S+/spec/|\#{1,3} [A-Z][^\n]*\n\s*\n[A-Z][a-z]+ [a-z]+ [a-z]+|---\n[\w-]+:)", re.I)
SETTINGS = re.compile(r"\A\s*\{\s*\"[\w.-]+\"\s*:")


def leading_comment(text: str) -> tuple[str, int]:
    """(comment, offset after it) at the start of a file; strings elsewhere that look like headers aren't in it."""
    at, kept = 0, []
    inside = False
    while at < len(text):
        end = text.find("\n", at)
        line = text[at : end if end >= 0 else len(text)]
        bare = line.strip().lstrip("﻿")
        if inside:
            kept.append(bare)
            inside = "*/" not in bare
        elif not bare:
            pass
        elif bare.startswith("/*"):
            close = bare.find("*/")
            kept.append(bare if close < 0 else bare[: close + 2])
            inside = close < 0
            if close >= 0 and bare[close + 2 :].strip():
                return " ".join(kept), at + line.find("*/") + 2
        elif re.match(r"(?://|\#(?!\s*(?:include|define|if|ifdef|ifndef|pragma|endif)\b|\[|!\[)|--\s)", bare):
            kept.append(bare)
        else:
            break
        at += len(line) + 1
    return " ".join(kept), min(at, len(text))


def giveaway(header: str) -> bool:
    return bool(NOTICE.search(header) or BANNER.search(header) or MINIFIED_BANNER.search(header))


def layout(text: str) -> dict[str, float]:
    """What the layout measures, from the text after the leading comment."""
    lines = [x for x in LITERAL.sub('""', text).split("\n") if x.strip()]  # a long string makes no minified file
    size = max(1, len(text.strip()))
    long_ = sum(len(x) for x in lines if len(x) > 300)
    literals = [m[0] for m in LITERAL.finditer(text)]
    blobs = sum(len(m[0]) for m in BLOB.finditer(text))
    plain = LITERAL.sub("", text)
    numbers = [m[0] for m in NUMBER.finditer(plain)]
    in_numbers = sum(len(x) + 2 for x in numbers)
    in_literals = sum(len(x) + 2 for x in literals)
    runs: dict[str, set[int]] = defaultdict(set)
    for name, number in NUMBERED.findall(text):
        runs[name].add(int(number))
    longest = max((len(v) for v in runs.values() if len(v) >= 4 and max(v) - min(v) + 1 <= len(v) + 1 and min(v) <= 1), default=0)
    spaces = text.count(" ") + text.count("\n")
    dense = sum(len(x) for x in lines if len(x) > 300 and x.count(" ") < len(x) * 0.12)
    return {
        "long": long_ / size, "dense": dense / size, "numbers": in_numbers / size, "blobs": blobs / size, "literals": in_literals / size,
        "runs": min(1.0, longest / max(4, len(lines))), "run": float(longest >= 4), "space": spaces / size, "size": size,
    }


def owned_by(path: str | None) -> str | None:
    """The class that a tool's own directory or a file name's ending proves."""
    if not path:
        return None
    parts = [p for p in path.lower().split("/") if p not in ("", ".")]
    if not parts:
        return None
    folders = parts[:-1]
    if ".min." in parts[-1]:
        return "minified"
    if folders and folders[0] in OWNED:
        return OWNED[folders[0]]
    if len(folders) > 1 and folders[0] in ("src", "lib", "packages") and folders[1] in OWNED:
        return OWNED[folders[1]]
    if "node_modules" in folders or "__generated__" in folders:
        return "vendored" if "node_modules" in folders else "generated"
    return BUILT.get("/".join(folders[:2])) or (BUILT.get(folders[0]) if folders else None)


def weak_label(path: str | None, text: str) -> str | None:
    """The class a file's marks prove; None for what shows no mark (mostly written by hand)."""
    header, at = leading_comment(text)
    if NOTICE.search(header):
        return "generated"
    if BANNER.search(header):
        return "vendored"
    if found := owned_by(path):
        return found
    m = layout(text[at:])
    if m["dense"] > 0.6 or (MINIFIED_BANNER.search(header) and m["long"] > 0.5):
        return "minified"
    if m["size"] > 300 and (m["numbers"] > 0.75 or (m["blobs"] > 0.7 and m["literals"] > 0.75) or m["numbers"] + m["literals"] > 0.93 and m["run"] == 0):
        return "data"
    if m["run"] and m["runs"] > 0.35:
        return "generated"
    return None


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) & ((1 << BITS) - 1)


def hints_of(rows: list[tuple]) -> dict[str, list[tuple[str, re.Pattern]]]:
    """Usable ignore entries by repository, each with a pattern for paths."""
    found: dict[str, dict[str, re.Pattern]] = defaultdict(dict)
    for repo, entries in rows:
        for entry in entries or ():
            entry = (entry or "").strip().strip("/")
            if entry and repo is not None:
                body = re.escape(entry.removeprefix("**/").removesuffix("/**")).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
                found[repo].setdefault(entry, re.compile(rf"(?:^|.*/){body}(?:/.*)?$"))
    return {k: sorted(v.items()) for k, v in found.items()}


DIGITS = str.maketrans("123456789", "000000000")


def hashed_grams(text: str, salt: int, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a text's character n-grams: digits alike, white space collapsed, random strings as runs of one sign."""
    text = BLOB.sub(lambda m: "\x01" * (len(m[0]) // 8), text).translate(DIGITS)
    codes = np.frombuffer(re.sub(r"[ \t]+", " ", re.sub(r"[ \t]*\n\s*", "\n", text)).encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint64)
    if len(codes) < GRAM:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    rolled = np.full(len(codes) - GRAM + 1, salt, dtype=np.uint64)
    for k in range(GRAM):
        rolled = rolled * np.uint64(0x100000001B3) + codes[k : len(codes) - GRAM + 1 + k] + np.uint64(1)
    grams, counts = np.unique((rolled ^ (rolled >> np.uint64(29))) & np.uint64((1 << BITS) - 1), return_counts=True)
    values = np.log1p(counts)
    return grams.astype(np.int64), weight * values / np.sqrt((values**2).sum())


def features(repo: str | None, path: str | None, text: str, hints: dict, masked: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a file. masked: without a giveaway header."""
    header, at = leading_comment(text)
    names: list[tuple[str, float]] = [("bias", 1.0)]
    clean = (path or "").removeprefix("./").lower()
    if clean:
        parts = clean.split("/")
        for depth, part in enumerate(parts[:-1]):
            names += [(f"dir{min(depth, 2)}:{part}", 0.7), (f"pair:{'/'.join(parts[max(0, depth - 1) : depth + 1])}", 0.5)]
        names += [(f"part:{x}", 0.5) for x in set(re.split(r"[._-]", parts[-1])) if x]
        names += [(f"hint:{entry}", 0.3) for entry, pattern in hints.get(repo, ()) if pattern.match(clean)]
    zones = [(np.array([slot(n) for n, _ in names], dtype=np.int64), np.array([v for _, v in names])), hashed_grams(text[at:] if text[at:].strip() else text, 0, 1.5)]
    if header and not (masked and giveaway(header)):
        zones.append(hashed_grams(header, 77, 1.5))
    slots, values = (np.concatenate(x) for x in zip(*zones))
    slots, where = np.unique(slots, return_inverse=True)
    return slots, np.bincount(where, weights=values)


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> np.ndarray:
    """Linear SVM (hinge loss, L2) by averaged stochastic subgradient steps; classes weighted to balance."""
    weight = np.zeros(1 << BITS)
    total = np.zeros(1 << BITS)
    if not rows:
        return weight
    positive = sum(y > 0 for *_, y in rows)
    share = {1: len(rows) / (2 * max(1, positive)), -1: len(rows) / (2 * max(1, len(rows) - positive))}
    random = np.random.default_rng(seed)
    steps = 0
    for epoch in range(EPOCHS):
        rate = 0.5 / (1 + epoch)
        for k in random.permutation(len(rows)):
            slots, values, y = rows[k]
            if y * float(weight[slots] @ values) < 1:
                weight[slots] += rate * share[y] * y * values
            steps += 1
        weight *= 1 - REGULARISATION * len(rows) * rate
        if epoch >= EPOCHS // 2:
            total += weight
    return total / (EPOCHS - EPOCHS // 2)


def sample_rows(files: DataFrame, bound: int = SAMPLE_FILES) -> list[tuple]:
    """About `bound` files, chosen by a hash of the id: (repo, path, content)."""
    held = files.where(F.col("content").isNotNull())
    n = max(1, files.count())  # from the files' footers, without reading contents
    return [tuple(r) for r in held.where(F.pmod(F.xxhash64("file_id"), F.lit(1_000_000)) < min(1_000_000, int(1_000_000 * bound / n) + 1)).select("repo", "path", "content").limit(2 * bound).collect()]


def training_set(rows: list[tuple], hints: dict) -> list[tuple[np.ndarray, np.ndarray, int]]:
    made = []
    for repo, path, text in rows:
        if not text or not text.strip() or no_program(text):
            continue
        text = normal(text)
        label = 1 if weak_label(path, text) else -1
        made.append((*features(repo, path, text, hints), label))
        header, at = leading_comment(text)
        if label > 0 and giveaway(header) and weak_label(path, text[at:]):
            made.append((*features(repo, path, text, hints, masked=True), label))
    return made


def normal(text: str) -> str:
    return text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")


def no_program(text: str) -> bool:
    return bool(NO_PROGRAM.match(text) or SETTINGS.match(text))


def profile_hints(profiles: DataFrame | None) -> dict:
    """The ignore lists, gathered by repository; a table of fixed size (its entries are distinct before they come to the driver)."""
    if profiles is None:
        return {}
    rows = profiles.select("repo", F.concat(F.coalesce("extra_ignore", F.array().cast("array<string>")), F.coalesce("tree_ignore", F.array().cast("array<string>"))).alias("e")).distinct().collect()
    return hints_of([tuple(r) for r in rows])


def score_files(files: DataFrame, profiles: DataFrame | None = None, weights: np.ndarray | None = None) -> DataFrame:
    """(file_id, repo, score): above 0 not written by hand. A narrow map over all rows."""
    hints = profile_hints(profiles)
    if weights is None:
        weights = fit_svm(training_set(sample_rows(files), hints))
    held = files.sparkSession.sparkContext.broadcast((weights.astype(np.float32), hints))
    id_type = files.schema["file_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, known = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                scores = []
                for repo, path, text in zip(*(part.column(k).to_pylist() for k in (1, 2, 3))):
                    if not text or not text.strip() or no_program(text):
                        scores.append(None)
                        continue
                    slots, values = features(repo, path, normal(text), known)
                    scores.append(float(w[slots] @ values))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64())], names=["file_id", "repo", "score"])

    return files.select("file_id", "repo", "path", "content").mapInArrow(run, f"file_id {id_type}, repo string, score double")


def not_handwritten(files: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """(file_id): files that are generated, minified, vendored or data."""
    return score_files(files, profiles).where("score > 0").select("file_id").distinct()


def validate(rows: list[tuple], hints: dict, folds: int = 4, masked: bool = True) -> list[dict]:
    """Held-out figures: repositories are split into folds; headers are masked in what is scored if asked."""
    fold_of = lambda repo: int(hashlib.md5((repo or "").encode()).hexdigest(), 16) % folds
    out = []
    for fold in range(folds):
        weights = fit_svm(training_set([r for r in rows if fold_of(r[0]) != fold], hints))
        figures = {"fold": fold, "tp": 0, "fp": 0, "fn": 0, "tn": 0}
        for repo, path, text in rows:
            if fold_of(repo) == fold and text and text.strip() and not no_program(text):
                slots, values = features(repo, path, normal(text), hints, masked=masked)
                got, want = float(weights[slots] @ values) > 0, weak_label(path, normal(text)) is not None
                figures["tp" if got and want else "fp" if got else "fn" if want else "tn"] += 1
        out.append(figures)
    return out


def validation(files: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Held-out figures of the bounded sample as a table, a row a fold of repositories, headers masked."""
    return files.sparkSession.createDataFrame([tuple(f.values()) for f in validate(sample_rows(files), profile_hints(profiles))], "fold int, tp long, fp long, fn long, tn long")
