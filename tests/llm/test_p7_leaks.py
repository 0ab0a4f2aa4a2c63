"""Passages against brute force."""

import random

from tessera.llm import leaks as L

VOCABULARY = [f"w{i}" for i in range(60)]


def made(seed):
    random.seed(seed)
    items = [(k, " ".join(random.choices(VOCABULARY, k=random.randint(20, 70)))) for k in range(30)]
    docs = []
    for k in range(120):
        words = random.choices(VOCABULARY + ["the", "of"], k=random.randint(0, 80))
        if k % 3 == 0:
            source = items[k % 30][1].split()
            n = random.choice([8, 11, 12, 20, 30])
            at = random.randrange(max(1, len(source) - n))
            part = source[at : at + n]
            if k % 2 and n >= 20:
                for _ in range(len(part) // 10):
                    part[random.randrange(len(part))] = "other"
            words[len(words) // 2 : len(words) // 2] = part
        docs.append(" ".join(words))
    return items, docs


def brute(items, docs, index):
    out = []
    for doc in docs:
        d = [index.word_id.get(w, 0) for w in L.folded_words(doc)]
        out.append([k for k, item in enumerate(index.items) if any(d[p] == item[q] != 0 and L.holds_passage(d, item, p, q) for p in range(len(d)) for q in range(len(item)))])
    return out


def test_against_brute_force():
    found = wanted = 0
    for seed in range(3):
        items, docs = made(seed)
        index = L.ItemIndex(items)
        got, want = L.search_texts(docs, index), brute(items, docs, index)
        assert all(set(a) <= set(b) for a, b in zip(got, want))
        found += sum(map(len, got))
        wanted += sum(map(len, want))
    assert wanted > 30 and found / wanted >= 0.98


def test_exact_runs_are_always_found():
    random.seed(5)
    item = [f"u{i}" for i in range(40)]
    index = L.ItemIndex([(7, " ".join(item))])
    for at in range(0, 28):
        text = "x y " + " ".join(item[at : at + 12]) + " z"
        assert L.search_texts([text], index) == [[0]]
        assert L.search_texts(["x y " + " ".join(item[at : at + 11]) + " z"], index) == [[]]


def test_surface_forms():
    index = L.ItemIndex([(1, "Él midió doce cajas de té verde, 45 sobres y nueve latas viejas hoy aquí.")])
    for text in ("EL MIDIO DOCE CAJAS DE TE VERDE 45 SOBRES Y NUEVE LATAS VIEJAS HOY AQUI", "> Él midió **doce** ca-\n> jas de [té](http://x) verde, ４５ sobres\n> y nueve <b>latas</b> viejas hoy aquí"):
        assert L.search_texts([text], index) == [[0]]


def test_tables(spark):
    text = " ".join(f"v{i}" for i in range(30))
    items = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, None, None), (3, "", None), (4, "too short", None)], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([(10, "a " + text, 1), (10, "a " + text, 1), (11, None, 1), (12, "", 1), (13, "nothing " * 50_000, 1)], "doc_id long, text string, item_id int")
    assert [tuple(r) for r in L.find_leaks(docs, items).collect()] == [(10, 1)]
    assert [tuple(r) for r in L.find_leaks(docs, items, block_bytes=1).collect()] == [(10, 1)]
    named = items.selectExpr("concat('item', item_id) AS item_id", "text")
    assert [tuple(r) for r in L.find_leaks(docs, named).collect()] == [(10, "item1")]
    assert L.find_leaks(docs, items.limit(0)).count() == 0 == L.find_leaks(docs.limit(0), items).count()


def test_long_item_keeps_every_offset():
    """Behind word 4,096 of an item, chance hits at one place of a document don't hide the passage."""
    filler = iter(range(10**6))
    passage = [f"p{k}" for k in range(L.PASSAGE)]
    decoys = [x for cut in [L.PASSAGE - 1] * 40 for x in [*passage[:cut], *[f"d{next(filler)}" for _ in range(30)]]]
    item = " ".join([*[f"f{next(filler)}" for _ in range(5_000)], *decoys, *passage, *[f"f{next(filler)}" for _ in range(30)]])
    document = " ".join(["before"] * 5 + passage + ["after"] * 5)
    assert L.search_texts([document], L.ItemIndex([(7, item)])) == [[0]]
