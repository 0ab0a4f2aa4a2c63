"""Ids against the public library's, round trips and the streaming decoder."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import tokenizer as K

pytestmark = pytest.mark.skipif(not os.path.isdir(K.DEFAULT_DIR), reason="needs the public vocabularies")


@pytest.fixture(scope="module")
def both():
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(os.path.join(K.DEFAULT_DIR, "byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    return reference, K.cache_for(K.vocabulary_bytes())


def ids_of(cache, text):
    ends, flat = K.encode_batch([text], cache)
    return flat.tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_same_ids_and_round_trip(both, text):
    reference, cache = both
    assert ids_of(cache, text) == reference.encode(text, add_special_tokens=False).ids
    assert "".join(K.stream_decode(ids_of(cache, text), cache.transducer.bytes_of)) == text


@pytest.mark.parametrize("text", ["<|endoftext|>", " \x85 x", "a" * 5000, "don't WE'LL 's", "  \n\n x\r\n", "日本語テキスト 😀👩‍👩‍👧 ½ⅷ２", "\x1c\x1d", "x" + "\u0301" * 40])
def test_corner_cases(both, text):
    test_same_ids_and_round_trip.hypothesis.inner_test(both, text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40))
def test_broken_bytes_as_the_codec(data):
    machine = K.Utf8Machine()
    assert "".join(machine.feed(data[i : i + 1]) for i in range(len(data))) + machine.close() == data.decode("utf-8", "replace")


def test_lookahead_is_bounded(both):
    transducer = both[1].transducer
    longest = max(map(len, transducer.ranks))
    assert all(len(pending) <= longest for state in transducer.hypotheses for _, pending, _ in state)


def test_table(spark):
    df = spark.createDataFrame([(1, "hello world", [1]), (2, None, None), (3, "", None), (1, "hello world", [2])], "doc_id long, text string, ids array<int>")
    got = sorted((r.doc_id, list(r.ids)) for r in K.encode_corpus(df).collect())
    assert got == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    assert all(r.same for r in K.round_trip(df).collect())
    assert K.encode_corpus(df.limit(0)).count() == 0
