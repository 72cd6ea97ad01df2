"""Each text operator against a plain version on small tables with odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from perfweave.llm import decontamination, exact_dedup, html, mixing, near_dedup, quality, sharding, substrings, suffixes, toxicity

SCHEMA = "doc_id long, text string, source string, `key` string, label string"
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(VOCABULARY[i] for i in rng.integers(0, len(VOCABULARY), n))


def odd_rows():
    passage = prose(99, 60)
    texts = {
        1: prose(1, 80), 2: prose(1, 80), 3: prose(1, 80).replace(" ", "\t\n"), 4: None, 5: "", 6: " \n ", 7: "one two", 8: "One\x0btwo",
        9: prose(2, 30) + " " + passage + " " + prose(3, 50), 10: prose(4, 40) + " " + passage, 11: "la " * 90, 12: "é" * 150,
        13: prose(5, 3000), 14: prose(1, 78) + " other end", 15: "x" * 99, 16: "x" * 260,
    }
    return [(i, t, None if i % 5 == 0 else f"s{i % 3}", "k", "l") for i, t in texts.items()]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def repeats(spark):
    """Repeated rows, repeated ids with different texts, and null ids."""
    rows = odd_rows()
    return spark.createDataFrame(rows + rows[:3] + [(None, prose(1, 80), "s0", None, None), (9, prose(8, 50), None, "k", "l")], SCHEMA).cache()


def rows_of(df, key="id"):
    return {r[key]: r for r in df.collect()}


def test_exact(docs, repeats, empty):
    got = rows_of(exact_dedup.exact_groups(docs))
    groups = defaultdict(list)
    for i, t, *_ in odd_rows():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    for text, ids in groups.items():
        for i in ids:
            want = (min(ids), len(ids), i == min(ids), hashlib.sha256(text.encode()).hexdigest())
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].digest) == want
    assert exact_dedup.exact_groups(repeats).count() == repeats.count()
    dropped = exact_dedup.drop_copies(repeats)
    assert dropped.columns == repeats.columns
    assert dropped.count() == len(groups) + 1
    assert exact_dedup.exact_groups(empty).count() == 0


def plain_words(texts, window):
    split = {i: (t or "").encode().split() for i, t in texts.items()}
    seen = Counter(tuple(w[p : p + window]) for w in split.values() for p in range(len(w) - window + 1))
    for i, w in split.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone.update(range(p, p + window))
        yield i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()


@pytest.mark.parametrize("window", [35, 20])
def test_repeated_words(docs, empty, window):
    got = rows_of(substrings.remove_repeats(docs, window=window))
    for i, n, gone, kept in plain_words({i: t for i, t, *_ in odd_rows()}, window):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (n, gone, kept), i
    assert substrings.remove_repeats(empty).count() == 0


def test_pieces_of_long_texts():
    text = prose(7, 900)
    whole = {(int(k), int(w)) for k, w, *_ in zip(*substrings.anchors(substrings.hashed_words(text), np.array([0]), 35), strict=True)}
    parts = set()
    for h, first, _, _ in substrings.pieces([text], 35, most=200):
        parts |= {int(k) for k in substrings.anchors(h, first, 35)[0]}
    assert {k for k, _ in whole} <= parts


def plain_bytes(texts, window):
    seen = set()
    for i in sorted(texts):
        data, gone = (texts[i] or "").encode(), set()
        for p in range(len(data) - window + 1):
            piece = data[p : p + window]
            if piece in seen:
                gone.update(range(p, p + window))
            seen.add(piece)
        spans = sum(1 for k in gone if k - 1 not in gone)
        yield i, len(data), len(gone), spans, bytes(b for k, b in enumerate(data) if k not in gone)


@pytest.mark.parametrize("most", [suffixes.MOST_SURROUNDINGS, 0])
def test_earlier_bytes(docs, empty, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST_SURROUNDINGS", most)
    got = rows_of(suffixes.remove_earlier(docs))
    for i, n, gone, spans, kept in plain_bytes({i: t for i, t, *_ in odd_rows()}, 100):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (n, gone, spans, kept), i
    assert suffixes.remove_earlier(empty).count() == 0


def test_odd_ids_of_bytes(repeats):
    assert suffixes.remove_earlier(repeats).count() == repeats.count()


def test_transform_finds_all_repeats():
    rng = np.random.default_rng(3)
    parts = [bytes(rng.choice(list(b"abc"), int(rng.integers(5, 60))).tolist()) for _ in range(60)]
    segment, offset, label = suffixes.repeat_classes(parts, 6)
    want = defaultdict(set)
    for s, part in enumerate(parts):
        for p in range(len(part) - 5):
            want[part[p : p + 6]].add((s, p))
    got = defaultdict(set)
    for s, p, c in zip(segment.tolist(), offset.tolist(), label.tolist(), strict=True):
        got[c].add((s, p))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_near(docs, repeats, empty):
    sets = {}
    for i, t, *_ in odd_rows():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = rows_of(near_dedup.near_groups(docs))
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), comp[i], comp[i] == i), i
    kept = near_dedup.keep_one(repeats)
    assert kept.columns == repeats.columns
    assert kept.count() == len(set(comp.values())) + 1
    assert near_dedup.near_groups(empty).count() == 0


def test_circulant_signature_estimates():
    a = near_dedup.shingle_set(prose(1, 2000))
    b = np.unique(np.concatenate([a[:1500], near_dedup.shingle_set(prose(2, 400))]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((near_dedup.signature(a) == near_dedup.signature(b)).mean() - true) < 0.15


def test_shards(spark, docs, repeats, empty):
    for table in (docs, repeats):
        rows = sharding.shard(table, sharding.copy_links(table), shards=4).collect()
        assert len(rows) == table.count()
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert max(map(len, slots.values())) - min(len(slots[s]) for s in range(4)) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    row = {r.id: r for r in sharding.shard(docs, sharding.copy_links(docs), shards=4).collect()}
    assert (row[4].size, row[4].text_crc32) == (8, 0)
    assert (row[12].size, row[12].text_crc32) == (308, zlib.crc32(("é" * 150).encode()))
    assert sharding.shard_documents(empty).count() == 0
    pairs = spark.createDataFrame([(i, f"text {i // 2}", "s", "", "") for i in range(400)], SCHEMA)
    placed = sharding.shard(pairs, sharding.copy_links(pairs), shards=4)
    together = placed.groupBy("text_crc32").agg(F.count_distinct("shard").alias("n")).filter("n = 1").count()
    assert together > 150


def test_mix(docs, repeats, empty):
    for table in (docs, repeats):
        rows = mixing.mix_plan(table).collect()
        assert len(rows) == table.count()
        taken, target = Counter(), {}
        for r in rows:
            assert 0 <= r.taken <= 3 * r.size
            taken[r.source] += r.taken
            target[r.source] = (r.target, r.source_size)
        for source, (goal, size) in target.items():
            assert goal <= 3 * size + 1e-9 and abs(taken[source] - goal) < 1
        assert sum(g for g, _ in target.values()) == pytest.approx(sum(s for _, s in target.values()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.collect():
        got[r.source] += len(r.text.encode().split())
    plan = Counter()
    for r in mixing.mix_plan(docs).collect():
        plan[r.source] += r.taken
    assert got == +plan
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_leaks(spark, docs, empty):
    items = spark.createDataFrame([(1, prose(99, 40)), (2, "too short item"), (3, None), (4, prose(77, 30)), (5, "")], "item_id long, text string")
    found = {(r.id, r.item_id): r.similarity for r in decontamination.leaks(docs, items).collect()}
    assert found == {(9, 1): 1.0, (10, 1): 1.0}
    words = prose(99, 40).split()
    words[20] = "changed"
    near = spark.createDataFrame([(1, prose(50, 20) + " " + " ".join(words) + " " + prose(51, 9), "s", "", ""), (2, prose(52, 90), "s", "", "")], SCHEMA)
    assert [r.doc_id for r in decontamination.decontaminate(near, items).collect()] == [2]
    got = decontamination.leaks(near, items).first()
    assert (got.id, got.start, got.n_words) == (1, 20, 40)
    assert got.similarity == pytest.approx(31 / 41)
    assert decontamination.leaks(empty, items).count() == 0
    assert decontamination.decontaminate(docs, items.limit(0)).count() == docs.count()


def test_page_text(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>top</header><nav><a href='/'>home</a></nav>"
        "<div class='cookie-notice'>we use</div><article><h1>Head</h1><p>One &amp; two<br>three<p>four  <b>bold</b>"
        "<script>var a='</p>';</script><aside>side</aside><!-- no --><div id=comments><p>first!</p></div></article><footer>f</footer>")
    assert html.main_text(page) == "Head One & two three four bold"
    assert html.main_text(None) == html.main_text("") == ""
    assert html.main_text("<p>a<div>b</div> < c &lt;d") == "a b < c <d"
    assert html.main_text("<div>" * 5000 + "deep") == "deep"
    box = "<div class=x><p>Subscribe to us today</p></div>"
    rows = [(i, f"http://h.example/{i}", f"<article><p>page {i} text</p>{box}</article>") for i in range(12)]
    rows += [(100, "http://other.example/", f"<article>{box}</article>"), (101, None, None), (102, "no url", "<p>x</p>")]
    got = rows_of(html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert all(got[i].text == f"page {i} text" for i in range(12))
    assert (got[100].text, got[101].text, got[102].text) == ("Subscribe to us today", "", "x")


def labelled(spark, n=600):
    rows, marks = [], []
    for i in range(n):
        toxic = i % 4 == 0
        rows.append((i, prose(i, 40) + (" vile rotten scumlike" if toxic else "") + " " + prose(i + n, 10), "s", "", ""))
        marks.append((i, int(toxic)))
    rows += [(n, None, None, None, None), (n + 1, "", "s", "", ""), (None, "vile rotten scumlike", "s", "", "")]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*marks, (None, 1), (3, None)], "doc_id long, toxic int")


def test_toxicity(spark, empty):
    docs, labels = labelled(spark)
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == 603 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.id is not None and r.id < 600 and r.held_out]
    assert {r.id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == (r.id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert toxicity.score_toxicity(docs, labels.limit(0)).count() == 603


def junk(i):
    words = prose(i, 60).split()
    return [" ".join(w + "###" for w in words), " ".join(w.upper() + "!!" for w in words), " | ".join(words), (words[0] + " ") * 60][i % 4]


def clean(i):
    return " ".join(s.capitalize() + "." for s in (prose(i * 7 + k, 9) for k in range(6)))


def test_quality(spark, empty):
    rows = [(i, junk(i) if i % 5 == 0 else clean(i), "s", "", "") for i in range(400)] + [(400, None, None, None, None), (401, " ", "s", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = rows_of(quality.score_quality(docs))
    right = sum(got[i].kept == (i % 5 != 0) for i in range(400))
    assert right >= 392
    assert (got[400].score, got[400].kept, got[401].kept) == (0.0, False, False)
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.score_quality(empty).count() == 0


def test_pipeline(spark, tmp_path):
    rows = [(i, junk(i) if i % 10 == 0 else clean(i), f"s{i % 3}", "en", 1) for i in range(200)]
    rows += [(1000 + i, clean(i + 1), "s0", "en", 1) for i in range(5)] + [(2000, clean(1) + " " + prose(99, 50), "s1", "en", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, prose(99, 50))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    placed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in placed}
    assert 2000 not in ids and not ids & {i for i in range(0, 200, 10)} and not ids & set(range(1000, 1005))
    counts = Counter(r.shard for r in placed)
    assert max(counts.values()) - min(counts[s] for s in range(24)) <= 1
