"""Column functions on text. All are built-in expressions, so they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as ECMAScript's \s has it, in a form that Java and RE2 both read.
SPACES = r"\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
TOKEN = f"[^{SPACES}]+"
# Replacements of typographic marks by plain ones.
PUNCTUATION = [("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "--"), ("…", "..."), (" ", " ")]
# Language keys by file extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala",
}
TEST_PATH = r"(?i)(^|/)(__tests__|tests?|specs?)(/|$)|\.(test|spec)\."


def token_count(text: Column) -> Column:
    """Number of runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def estimate_tokens(text: Column) -> Column:
    """A word of up to 7 letters is 1, of up to 10 is 2, a longer one its length over 5 rounded up; at least 1."""
    cost = lambda w: F.when(F.length(w) <= 7, 1).when(F.length(w) <= 10, 2).otherwise(F.ceil(F.length(w) / 5)).cast("int")
    return F.greatest(F.lit(1), F.aggregate(F.transform(tokens(text), cost), F.lit(0), lambda a, x: a + x))


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")


def short_hash(text: Column, length: int = 4) -> Column:
    """Prefix of the SHA-256 of the trimmed text with line feeds."""
    return F.substring(F.sha2(trim_all(F.replace(text, F.lit("\r\n"), F.lit("\n"))), 256), 1, length)


def line_hash(number: Column, line: Column, length: int = 4) -> Column:
    return short_hash(F.concat(number.cast("string"), F.lit(":"), line), length)


def strip_trailing(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)[ \t]+$", "")


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def unwrap_lines(text: Column) -> Column:
    """A single line break becomes a space; runs of them stay."""
    return F.regexp_replace(text, "(?<!\n)\n(?!\n)", " ")


def plain_punctuation(text: Column) -> Column:
    for mark, plain in PUNCTUATION:
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def word_pattern(term: str) -> str:
    """A whole word in ASCII boundaries; the word is looked for before what is around it."""
    return rf"{term.lower()}(?<![A-Za-z0-9_]{term.lower()})(?![A-Za-z0-9_])"


def word_occurrences(text: Column, term: str, lowered: bool = False) -> Column:
    """Whole-word occurrences whatever the case; the plain test in front spares most texts the pattern. lowered: text is in lower case."""
    low = text if lowered else F.lower(text)
    return F.when(low.contains(term.lower()), F.regexp_count(low, F.lit(word_pattern(term)))).otherwise(0)


def has_word(low: Column, term: str) -> Column:
    """Whether a text in lower case has the word."""
    return low.contains(term.lower()) & low.rlike(word_pattern(term))


def split_camel(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"))


def query_terms(text: Column) -> Column:
    """Distinct lower-case terms: by white space, then camel humps, then underscores."""
    humps = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    return F.array_distinct(F.transform(F.filter(F.split(F.regexp_replace(humps, f"[{SPACES}_]+", " "), " "), lambda x: x != ""), F.lower))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language_of(path: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(pairs, extension(path))


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def quote_csv(value: Column, delimiter: str = ",") -> Column:
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.contains(delimiter) | value.contains("\n") | value.contains('"'), quoted).otherwise(value)


def truncate_text(text: Column, most: int) -> Column:
    if most <= 0:
        return F.lit("...")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, most), f"[{SPACES}]+$", ""), F.lit(" ...")))


def normalize_log_line(text: Column) -> Column:
    """Numbers, hex runs and addresses made equal, for comparing lines."""
    text = F.regexp_replace(text, r"(?<![A-Za-z0-9_])[0-9]+(?![A-Za-z0-9_])", "#")
    text = F.regexp_replace(text, r"[A-Fa-f0-9]{7,40}", "<hash>")
    return F.trim(F.regexp_replace(text, r"0[xX][0-9a-fA-F]+", "0x#"))
