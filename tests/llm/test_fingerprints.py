"""Fingerprints against plain sets of paragraphs."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import types as T

from perfweave.llm import fingerprints as fp


def sets(texts):
    """Digests of every text by itself, cut one character at a time."""
    out = []
    for text in texts:
        pieces, start = [], 0
        for i in range(len(text)):
            window = text[max(0, i - fp.WINDOW + 1):i + 1]
            ends = text[i] == "\n" or i + 1 == len(text) or (i + 1) % fp.SLAB == 0
            slab = i % fp.SLAB
            if not ends and slab >= fp.WINDOW - 1:
                h = 0
                for k, c in enumerate(reversed(window)):
                    h += int(fp.mixed(np.array([ord(c)], np.uint64))[0]) * pow(int(fp._ODD[1]), k, 1 << 64)
                ends = int(fp.mixed(np.array([h % (1 << 64)], np.uint64))[0]) % fp.MEAN_CHARS == 0
            if ends:
                pieces.append(text[start:i + 1])
                start = i + 1
        out.append(set(pieces))
    return out


def near(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def expected(rows):
    """By definition, for (doc_id, text) with different ids."""
    rows = sorted(rows, key=lambda r: -r[0])
    texts = [t or "" for _, t in rows]
    following = texts[1:] + texts[:1]
    edited = [t[:len(t) - len(t) // 2] + f[:len(t) // 2] for t, f in zip(texts, following)]
    cut = dict(zip(texts + edited, sets(texts + edited)))
    return {
        i: (len(t), hashlib.sha256(e.encode()).hexdigest(), near(cut[t], cut[e]), near(cut[t], cut[f]), len(cut[t] ^ cut[e]))
        for (i, _), t, f, e in zip(rows, texts, following, edited)
    }


def held(got, rows):
    want = expected(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"], r["n_differing"]) == pytest.approx(want[r["doc_id"]])


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    short = [(i, t[:300]) for i, t in rows]
    got = fp.fingerprinted(spark.createDataFrame(short, "doc_id long, text string").repartition(5)).collect()
    held(got, short)
    marks = {}
    for r in got:
        marks.setdefault(dict(short)[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(m) == 1 for m in marks.values()) and len({*map(min, marks.values())}) == len(marks)


def test_query(spark):
    got = fp.op13_fingerprints(spark, "/root/testdata/sf0.001").collect()
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id", ascending=False).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(by_id) == len(got) == len(rows)
    for r, f in zip(rows, rows[1:] + rows[:1]):
        half = len(r["text"]) // 2
        edited = r["text"][:len(r["text"]) - half] + f["text"][:half]
        assert by_id[r["doc_id"]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    more = [r for r in got if r["n_chars"] > 200]
    assert np.mean([r["near_edited"] > r["near_next"] for r in more]) > 0.95


def test_odd_rows(spark):
    texts = [None, "", "a", "ab", "\n\n\n", "one\ntwo\none\ntwo\n", "é\U0001f600" * 40, "x" * 500, "one\ntwo\none\ntwo\n", "word " * 300]
    rows = list(enumerate(texts))
    schema = T.StructType.fromDDL("id long, text string, doc_id string, edge string, part long")
    docs = spark.createDataFrame([(i, t, "c", "d", 1) for i, t in rows], schema)
    got = fp.fingerprinted(docs, "id")
    assert got.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held(got.collect(), rows)
    alone = fp.fingerprinted(docs.filter("id = 5"), "id").collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    assert fp.fingerprinted(docs.limit(0), "id").collect() == []


def test_repeated_and_null_ids(spark):
    rows = [("k", "same text")] * 4 + [(None, "a"), (None, None), ("j", "last one")]
    got = fp.fingerprinted(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["None", "None", "j", "k", "k", "k", "k"]
    assert sum(r["near_next"] == 1.0 for r in got if r["doc_id"] == "k") == 3
    again = fp.fingerprinted(spark.createDataFrame(rows[::-1], "doc_id string, text string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_slabs(monkeypatch):
    texts = ["ab\ncd ef gh ij kl mn op" * 9, "", "x" * 70, "ab\ncd"]
    monkeypatch.setattr(fp, "SLAB", 16)
    bounds, values = fp.digests(texts)
    assert np.diff(bounds).tolist() == [len(s) for s in sets(texts)]


@pytest.mark.parametrize("shared, left, right", [(0, 0, 0), (9, 0, 0), (50, 1, 2), (1000, 3, 0), (0, 400, 500), (3000, 700, 1)])
def test_peeling(shared, left, right):
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 1 << 63, shared + left + right, dtype=np.uint64)
    a, b = np.sort(keys[:shared + left]), np.sort(np.append(keys[:shared], keys[shared + left:]))
    bounds, values = np.array([0, len(a), len(a) + len(b)]), np.append(a, b)
    pair, found, signs = fp.differences(bounds, values, np.array([0, 1, 0]), np.array([1, 0, 0]))
    only = {1: {*keys[shared:shared + left].tolist()}, -1: {*keys[shared + left:].tolist()}}
    for p, turn in ((0, 1), (1, -1)):
        for s in (1, -1):
            assert {*found[(pair == p) & (signs == s)].tolist()} == only[s * turn]
    assert not (pair == 2).any()
    marks = fp.fingerprints(bounds, values)
    told = fp.compared(*marks)
    assert told is None and left + right > 4 or {*told[0]} == only[1] and {*told[1]} == only[-1]
