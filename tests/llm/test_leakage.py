import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from codestrata.llm import leakage as L
from codestrata.llm.normal import words_of, words_with_offsets

WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu".split() for b in "na te si ro lu".split()]
ITEM = " ".join(random.Random(0).choices(WORDS, k=60))


def brute(item, text, stretch=20, one_in=5):
    """Every stretch of the item against every place of the text, by edit distance."""
    for a in range(len(item) - stretch + 1):
        row = [0] * (len(text) + 1)
        for b in range(a, len(item)):
            old, row = row, [row[0] + 1] + [0] * len(text)
            for j, w in enumerate(text, 1):
                row[j] = min(old[j - 1] + (item[b] != w), old[j] + 1, row[j - 1] + 1)
            size = b - a + 1
            if size >= stretch and min(row) * one_in <= size:
                return True
    return False


def damage(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.choice("rad")
        if kind == "r":
            words[at] = "zz"
        elif kind == "a":
            words.insert(at, "zz")
        elif len(words) > 1:
            del words[at]
    return words


def test_alignment_equals_brute_force():
    rng = random.Random(2)
    item = ITEM.split()[:34]
    number = {w: i for i, w in enumerate(dict.fromkeys(item))}
    for _ in range(120):
        a = rng.randrange(0, 14)
        text = rng.choices(WORDS, k=5) + damage(item[a : a + rng.randrange(12, 30)], rng, rng.randrange(0, 8)) + rng.choices(WORDS, k=5)
        coded = np.array([number.get(w, -1) for w in text], dtype=np.int32)
        assert L.leaks([number[w] for w in item], coded) == brute(item, text)


def test_scan_loses_nothing_that_brute_force_finds():
    rng = random.Random(7)
    passages = L.Passages([(1, ITEM)])
    item = ITEM.split()
    hits = 0
    for _ in range(150):
        a = rng.randrange(0, 35)
        size = rng.randrange(16, 26)
        text = rng.choices(WORDS, k=8) + damage(item[a : a + size], rng, rng.randrange(0, 7)) + rng.choices(WORDS, k=8)
        want = brute(item, text)
        hits += want
        assert bool(passages.scan(" ".join(text))) == want
    assert 30 < hits < 140


def test_disguises():
    item = "The quick parser reads every single branch before that shared cache sends one signal towards our broken loader (see fooBar) in `a/b.ts` again, and then stops."
    passages = L.Passages([(5, item)])
    shapes = [
        item.upper(), item.replace(" ", "\n> "), item.replace("parser", "par­ser").replace("branch", "bran​ch"), item.replace("o", "о").replace("a", "а"),
        "<p>" + item.replace(" single", "&nbsp;<b>single</b>") + "</p>", item.replace(" and", "\\nand"), item.replace("loader", "[loader](http://x.y/z)"), item.replace("signal", "sig-\nnal"),
        item.replace("every", "**every**").replace("cache", "_cache_"), "| " + item.replace(" before", " | before") + " |", item.replace("quick", "qu\\u0069ck"),
    ]
    for text in shapes:
        assert passages.scan("Some words first. " + text + " And some after."), text
    assert not passages.scan(" ".join(item.split()[:12]))
    assert not passages.scan("")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aZ1 é­а&lt;<b>/\\n*_-.\n​[](x)😀", max_size=60))
def test_offsets_belong_to_the_same_words(text):
    words, spans = words_with_offsets(text)
    assert words == words_of(text)
    assert all(0 <= a < b <= len(text) for a, b in spans)
    assert [a for a, _ in spans] == sorted(a for a, _ in spans)


def test_escaped_dashes_part_words_of_ascii_texts():
    for dash in ("&mdash;", "\\u2014", "&hellip;", "\\u2026"):
        text = f"one{dash}two"
        assert words_of(text) == words_with_offsets(text)[0] == ["one", "two"], text
    assert words_of("o&shy;ne") == words_with_offsets("o&shy;ne")[0] == ["one"]


def test_tables(spark):
    rows = [(1, "Before. " + ITEM + ". After.", 9), (2, None, 9), (3, "", 9), (4, "nothing here", 9), (1, "Before. " + ITEM + ". After.", 9), (None, ITEM, 9), (5, "word " * 300_000 + ITEM, 9)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(10, "s", ITEM, "q"), (11, "s", None, "q"), (12, "s", "too short", "q"), (13, "s", ITEM, None), (None, "s", ITEM, "q")], "item_id long, suite string, text string, question string")
    assert sorted(map(tuple, L.leaked_items(documents, items).collect())) == [(1, 10), (1, 13), (5, 10), (5, 13)]
    span = L.leaked_spans(documents.where("doc_id = 1"), items).first()
    assert rows[0][1][span.start : span.stop] in ITEM and span.stop - span.start > 200
    assert {r.item_id: r.n_docs for r in L.leaks_per_item(documents, items.where("item_id is not null")).collect()} == {10: 2, 11: 0, 12: 0, 13: 2}
    assert L.leaked_items(documents.limit(0), items).collect() == L.leaked_items(documents, items.limit(0)).collect() == []
    one_by_one = L.leaked_spans(documents, items, block_chars=1).select("doc_id", "item_id").distinct()
    assert one_by_one.count() == 4  # blocks of items change nothing
