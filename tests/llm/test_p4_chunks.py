"""Pieces: within the limit, whole, overlapping, stable under edits."""

from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chunks as C


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["word", "end.", "\n", "\n\n", "# head", "  ", "é😀", "```"]), max_size=200), st.integers(1, 40), st.integers(0, 50))
def test_pieces(parts, limit, overlap):
    text = " ".join(parts)
    starts, ends, kind = C.boundaries(text)
    assert len(starts) == len(text.split())
    if len(starts) <= limit:
        assert C.split_text(text, limit, overlap) == [text]
        return
    found = C.cuts(kind, C.token_hashes(text, starts, ends), limit, overlap)
    shared = max(0, min(overlap, limit - 1))
    assert found[0][0] == 0 and found[-1][1] == len(starts)
    for i, (a, b, _) in enumerate(found):
        assert 0 < b - a <= limit
        if i:
            assert found[i - 1][1] - a == min(shared, found[i - 1][1])
    assert all(len(p.split()) <= limit for p in C.split_text(text, limit, overlap))
    if not shared:
        assert "".join(C.split_text(text, limit, 0)) == text


def test_an_edit_changes_few_pieces():
    words = [f"w{i * 7919 % 1000}" + ("." if i % 9 == 0 else "") + ("\n\n" if i % 41 == 0 else "") for i in range(6000)]
    before = C.split_text(" ".join(words), 150)
    after = C.split_text(" ".join(words[:3000] + ["a", "new", "part"] + words[3000:]), 150)
    assert len(set(before) - set(after)) <= 6


def test_requests(spark):
    docs = spark.createDataFrame([(1, "a b c d e f\n\n# g h i j", 5), (1, "a b c d e f\n\n# g h i j", 5), (2, None, 1), (3, "", 1), (4, "one", 1)], "md_id long, content string, tokens long")
    when = datetime(2025, 1, 1)
    asked = [(1, 1, 4, 1), (1, 1, 4, 1), (2, 1, 100, 0), (3, 1, None, 1), (4, 1, 0, 1), (5, 2, 4, 0), (6, 9, 4, 0), (7, 1, 4, None), (8, 1, 4, 99), (9, None, 4, 1), (10, 1, -3, 0)]
    requests = spark.createDataFrame([(*r, when, "x") for r in asked], "request_id long, md_id long, max_tokens int, overlap_tokens int, received_at timestamp_ntz, specs string")
    ranges = spark.createDataFrame([(1, 3, "g h i j"), (1, 1, "stale"), (1, None, None)], "md_id long, start_line int, heading_text string")
    assert sorted(r.request_id for r in C.oversized(requests, docs, ranges).collect()) == [1, 7, 8]
    pieces = C.split_requests(requests, docs, ranges).collect()
    assert {r.request_id for r in pieces} == {1, 7, 8} and all(len(r.text.split()) <= 4 for r in pieces)
    assert "".join(r.text for r in sorted((r for r in pieces if r.request_id == 7), key=lambda r: r.piece_no)) == "a b c d e f\n\n# g h i j"
    assert C.oversized(requests.limit(0), docs.limit(0), ranges.limit(0)).count() == 0
