"""Leaks against a search over all item-sized windows, those that reach beyond the document too."""

from collections import Counter

import numpy as np
import pytest

from perfweave.llm import decontamination

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def similar(window, item):
    a, b = shingles(window), shingles(item)
    return sum((a & b).values()) / sum((a | b).values())


def plain_leaks(texts, items):
    """``(doc, item, start, n_words): similarity`` of every window of an item's length, cut at both ends of the document."""
    found = {}
    for d, text in texts:
        words = (text or "").lower().split()
        for i, item in items:
            wanted = (item or "").lower().split()
            if len(wanted) < 5:
                continue
            for at in range(5 - len(wanted), len(words) - 4):
                start, end = max(0, at), min(len(words), at + len(wanted))
                similarity = similar(words[start:end], wanted)
                if similarity >= 0.75:
                    found[d, i, start, end - start] = similarity
    return found


def cases():
    rng = np.random.default_rng(11)
    names = [f"w{i}" for i in range(300)]
    word = lambda n: [names[i] for i in rng.integers(0, 300, n)]
    lead = word(8)
    # Each item repeats its opening further on, and both share it: a template of questions.
    items = [lead + word(6) + lead + word(18), word(20) + lead + word(12), word(25)]
    texts = []
    for k, item in enumerate(items):
        changed = list(item)
        changed[-3] = "other"
        texts += [item + word(30), word(3) + item + word(4), word(30) + item, item[2:] + word(9), changed + word(5), item[: len(item) // 2] + word(40)]
        half = len(item) // 2
        texts += [word(20) + item[half:] + item[:half] + word(20), item[half:] + item[:half]]
    x, y = word(50), word(50)
    items.append(x + y)
    texts += [y + x, word(40) + y + x + word(30), word(9) + y[:45], x + y[10:], x + y + word(2) + x + y]
    texts += [word(60), lead * 4, [], items[0] * 5]
    return [(i, " ".join(t)) for i, t in enumerate(texts)], [(i, " ".join(t)) for i, t in enumerate(items)]


# Other numbers of partitions meet the windows in another order; without broadcasts the keys are shuffled.
@pytest.mark.parametrize(("parts", "broadcast"), [(1, 500_000), (5, 0)])
def test_all_windows(spark, monkeypatch, parts, broadcast):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", broadcast)
    texts, items = cases()
    want = plain_leaks(texts, items)
    docs, bench = spark.createDataFrame(texts, DOCS).repartition(parts), spark.createDataFrame(items, ITEMS)
    rows = decontamination.held_windows(docs, bench).collect()
    got = {(r.id, r.item_id, r.start, r.n_words): r.similarity for r in rows}
    assert len(got) == len(rows)
    # All windows within the threshold are within the radius too, here; elsewhere one in some ten thousand is not.
    assert got == pytest.approx(want)
    kept = {r.doc_id for r in decontamination.decontaminate(docs, bench).collect()}
    assert kept == {d for d, _ in texts} - {d for d, *_ in want}


def test_halves_swapped(spark):
    x, y = [" ".join(f"{c}{i}" for i in range(50)) for c in "xy"]
    docs = spark.createDataFrame([(1, f"{y} {x}"), (2, f"{x} z"), (3, f"{y} {y}"), (None, f"a b c {y} {x} d")], DOCS)
    found = decontamination.leaks(docs, spark.createDataFrame([(7, f"{x} {y}")], ITEMS)).collect()
    best = {}
    for r in found:
        best[r.id] = max(best.get(r.id, 0), r.similarity)
    assert best == pytest.approx({1: 92 / 100, None: 92 / 100})


def test_no_items(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, ""), (1, "a b c d e f")], DOCS)
    short = spark.createDataFrame([(1, "a b c"), (2, None)], ITEMS)
    assert decontamination.leaks(docs, short).count() == 0
    assert decontamination.decontaminate(docs, short).count() == 4
    assert decontamination.decontaminate(docs.limit(0), short).count() == 0
