"""Passages that stand in several texts of one class do not drown the words that tell the classes apart."""

import zlib

import numpy as np

from perfweave.llm import toxicity


def test_copied_passages_do_not_hide_expressions(spark):
    rng = np.random.default_rng(3)
    names = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(4000)]

    def some(n):
        return [names[i] for i in np.minimum(rng.zipf(1.3, n), 4000) - 1]

    passages = [some(30) for _ in range(40)]
    rows = []
    for i in range(1500):
        toxic = i % 8 == 0
        words = some(60) + (passages[i % 40] * 2 if i % 3 == 0 else []) + some(60)
        for rude in ("rude", "fool", "scum") * toxic:
            words.insert(int(rng.integers(len(words))), rude)
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).withColumnRenamed("id", "doc_id").collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    caught = [got[i].predicted for i, _, toxic in held if toxic]
    left = [1 - got[i].predicted for i, _, toxic in held if not toxic]
    print("caught", np.mean(caught), "left alone", np.mean(left))
    assert np.mean(caught) > 0.9 and np.mean(left) > 0.98
