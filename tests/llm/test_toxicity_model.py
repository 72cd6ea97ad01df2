"""The toxicity models against plain ones made of dictionaries, and the scores against held-out labels."""

import os
from collections import Counter

import numpy as np
import pytest

from perfweave.llm import toxicity

D = toxicity.DISCOUNT


def plain_evidence(texts, corpus, text):
    """Evidence of ``text`` by dictionaries of words; ``texts`` has those of each class, toxic first."""
    docs = Counter(w for t in corpus for w in set(toxicity.words(t)))
    total = sum(docs.values())
    pairs = [
        Counter((b, w) for t in of_class for b, w in zip([None, *toxicity.words(t)], toxicity.words(t), strict=False))
        for of_class in texts
    ]
    kinds = [Counter(w for _, w in p) for p in pairs]
    tops = [sum(max(k - D, 0) for k in c.values()) for c in kinds]
    below = max(1 - t / len(p) for t, p in zip(tops, pairs, strict=True))

    def lower(i, w):
        return (1 - below) * max(kinds[i][w] - D, 0) / max(tops[i], 1) + below * (docs[w] + 0.5) / (total + 0.5 * (len(docs) + 1))

    def p(i, b, w):
        sums = [sum(n for (x, _), n in c.items() if x == b) for c in pairs]
        rest = [sum(max(n - D, 0) for (x, _), n in c.items() if x == b) for c in pairs]
        if b is None or not rest[i] or min(sums) and not min(rest):
            return lower(i, w)
        weight = min(r / s for r, s in zip(rest, sums, strict=True)) if min(sums) else rest[i] / sums[i]
        return weight * max(pairs[i][b, w] - D, 0) / rest[i] + (1 - weight) * lower(i, w)

    tokens = toxicity.words(text)
    ratios = [p(0, b, w) / p(1, b, w) for b, w in zip([None, *tokens], tokens, strict=False)]
    return np.log(np.mean(np.power(ratios, toxicity.POWER))) / toxicity.POWER


def test_evidence(spark):
    rng = np.random.default_rng(5)
    names = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(30)]
    # Neighbours often repeat, so pairs pass the discount in both classes.
    texts = [" ".join(names[(i * 7 + s) % 30] for s in rng.integers(0, 30, 14) for i in (0, 1, 2)) + f" {names[n % 30]} rude fool" * (n % 2) for n in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "id long, toxic int")
    used = [int(r.id) for r in docs.withColumn("fold", toxicity.fold(docs["id"])).filter("fold > 1").collect()]
    classes = [[texts[i] for i in used if i % 2 == toxic] for toxic in (1, 0)]
    model = toxicity.fit(docs, labels)
    assert len(model.pair) and (model.weight > 0).any()
    for text in (*texts[:8], "unknown " + texts[3] + " other", "rude", "rude fool", "fool", "unknown"):
        assert model.evidence(text) == pytest.approx(plain_evidence(classes, texts, text), abs=1e-12)
    assert model.evidence("unknown") == 0.0 and model.evidence("rude") > 1


def area(scores, labels):
    ranks = np.empty(len(scores))
    _, back, n = np.unique(scores, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(n) - (n - 1) / 2)[back]
    pos = labels.sum()
    return (ranks[labels == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(labels) - pos))


def test_held_out_area(spark):
    """Most words of these tables occur in one document, and the toxic ones are few."""
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    got = toxicity.op4_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("toxic IS NOT NULL").toPandas()
    labels = got["toxic"].to_numpy()
    right = (got["predicted"].to_numpy() == labels).mean()
    print("held-out area", area(got["score"].to_numpy(), labels), "accuracy", right, "toxic found", got.loc[labels == 1, "predicted"].mean())
    assert area(got["score"].to_numpy(), labels) > 0.95
    assert right > 1 - labels.mean() + 0.04
