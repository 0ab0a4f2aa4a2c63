"""Queries of the training-data problems 1-4 and 6-8 (problem 5 is in the core)."""

from __future__ import annotations

from tessera.llm import chunks, languages, leaks, markup, provenance, syntax, tokenizer
from tessera.sources.tables import table


def p1_found(spark, sf_dir):
    return syntax.unparsable(table(spark, sf_dir, "source_files"))


def p1_rates(spark, sf_dir):
    return syntax.failure_rates(table(spark, sf_dir, "source_files"))


def p2_found(spark, sf_dir):
    return provenance.not_handwritten(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "ignore_profiles"))


def p2_validation(spark, sf_dir):
    return provenance.validation(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "ignore_profiles"))


def p3_found(spark, sf_dir):
    return markup.extract_elements(table(spark, sf_dir, "md_docs"))


def p4_found(spark, sf_dir):
    return chunks.oversized(*(table(spark, sf_dir, t) for t in ("read_requests", "md_docs", "heading_ranges")))


def p4_pieces(spark, sf_dir):
    return chunks.split_requests(*(table(spark, sf_dir, t) for t in ("read_requests", "md_docs", "heading_ranges")))


def p6_ids(spark, sf_dir):
    return tokenizer.encode_corpus(table(spark, sf_dir, "documents"))


def p6_roundtrip(spark, sf_dir):
    return tokenizer.round_trip(table(spark, sf_dir, "documents"))


def p7_found(spark, sf_dir):
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p8_found(spark, sf_dir):
    return languages.unlabelled(table(spark, sf_dir, "documents"))


def p8_segments(spark, sf_dir):
    return languages.identify(table(spark, sf_dir, "documents")).drop("labelled")


QUERIES = {
    "p1_found": p1_found,
    "p1_rates": p1_rates,
    "p2_found": p2_found,
    "p2_validation": p2_validation,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_segments": p8_segments,
    "p6_ids": p6_ids,
    "p6_roundtrip": p6_roundtrip,
}
ORACLES = {}
