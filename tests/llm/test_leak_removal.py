"""Removal of leaks: original letters, short items, several broadcasts."""

import random

from skeinlake.llm import leaks
from skeinlake.llm.lookalikes import unified

ITEM = " ".join(f"w{i}" for i in range(12))
OTHER = " ".join(f"v{i}" for i in range(12))


def removed(spark, texts, items, **limits):
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = leaks.remove_spans(documents, spark.createDataFrame(items, "item_id bigint, text string"), "doc_id", "text", "item_id", "text", **limits).collect()
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_kept_words_are_the_originals(spark):
    cyrillic, combining = "\u041f\u0440\u0438\u0432\u0435\u0442 \u0441\u043e\u0441\u0435\u0434", "re\u0301sume\u0301"
    got = removed(spark, [f"{cyrillic}, {ITEM} {combining}!", f"{cyrillic} {ITEM.replace('w0', 'w\u200b0')}"], [(1, ITEM)])
    assert got == [(f"{cyrillic} {combining}!", 12), (cyrillic, 12)]


def test_short_items_by_coverage(spark):
    texts = ["before a short item after", "a short thing"]
    assert removed(spark, texts, [(1, "a short item")]) == [(t, 0) for t in texts]
    assert removed(spark, texts, [(1, "a short item"), (2, ITEM)], min_coverage=1.0) == [("before after", 3), ("a short thing", 0)]


def test_several_broadcasts_equal_one(spark):
    texts = [f"x {ITEM} y {OTHER} z", f"x {ITEM} y {OTHER} z", ITEM, "", None, f"{OTHER} a short item \u0434", "none"]
    items = [(1, ITEM), (2, OTHER), (3, "a short item")]
    want = removed(spark, texts, items, min_coverage=1.0)
    assert want[:5] == [("x y z", 24), ("x y z", 24), ("", 12), ("", 0), (None, 0)] and want[5] == (" \u0434", 15) and want[6] == ("none", 0)
    assert removed(spark, texts, items, min_coverage=1.0, words_per_automaton=5) == want


def test_origins_follow_the_unified_form():
    r = random.Random(3)
    some = "aZ1 .\u0301\u0323\u200b\u0130\u03a3\u0435\u0439\u0451\u00e9\uff57\u1100\u1161\u11a8\u0915\u093c\u09c7\u09be\ufb01\u0344\u212b\u00bd"
    for _ in range(3000):
        text = "".join(r.choice(some) for _ in range(r.randrange(12)))
        form = unified(text).lower()
        starts, ends = leaks._origins(text)
        assert len(starts) == len(ends) == len(form)
        assert all(unified(text[a:b]).lower().count(c) for a, b, c in zip(starts, ends, form) if c not in "\u03c2\u03c3")
