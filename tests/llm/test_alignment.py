"""Token alignment against whole texts encoded in one go and plain loops over tokens."""

import hashlib
from bisect import bisect_left
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfweave.llm import alignment

NAMES = [f"{alignment.TOKENIZERS}/{n}" for n in (alignment.BYTE_BPE, alignment.PIECE_BPE)]
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  ", "\n", "a\n b", "a \n b", "x\t y  z   w", "Hello, world!  It's 3.14 o'clock.",
    "<|endoftext|> and <s> </s> <unk> <0x41>", "café naïve 日本語 \U0001f600 क्ष", " b  c 　 d",
    "▁x ▁ y", "a\x1c b", "a᠎ b", "a​ b", "\x00 b", "é ﬁ Å", "a" * 3000, "☃" * 500, "ab " * 800,
    "the same words and the same words", "the same words and the same words", "\r\n\r\n  indented\r\n", "12345 67890 1 22 333", "...---...   !!! ???",
]


def plain(texts):
    """Figures of every text, by the definitions."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(NAMES[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=NAMES[1])
    letters = alignment.byte_letters()
    of_id = {i: e for e, i in first.get_vocab().items()}

    def bytes_b(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    out = []
    for text in texts:
        a, b, want = [], [], (" " + (text or "")).encode()
        if text:
            a = [(i, bytes(letters[c] for c in of_id[i])) for i in first.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes_b(i)) for i in second.encode(text)]
            if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
                a, b = [], []
        ends = []
        for tokens in (a, b):
            at, here = 0, []
            for _, x in tokens:
                at += len(x)
                here.append(at)
            ends.append(here)
        common = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in common]
        for side, (tokens, here) in enumerate(zip((a, b), ends)):
            for (i, _), end in zip(tokens, here):
                groups[bisect_left(common, end)][side].append(i)
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        line = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((len(a), len(b), len(groups), links, hashlib.sha256(line.encode()).hexdigest() if a else ""))
    held = Counter(k for row in out for k in row[3])
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    return [
        (
            n_a, n_b, n_groups, sum(links.values()),
            sum(n for k, n in links.items() if held[k] == best[k[0]]), sum(n * held[k] for k, n in links.items()), sha,
        )
        for n_a, n_b, n_groups, links, sha in out
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("frequent", [1 << 18, 5, 1])
def test_odd_texts(spark, frequent):
    docs = frame(spark, ODD).repartition(3)
    found = alignment.aligned(docs)
    scores = alignment.link_scores(found, frequent)
    got = found.join(scores, "row_key", "left").na.fill(0, ["n_best", "count_sum"]).orderBy("doc_id").select(*COLUMNS).collect()
    assert [tuple(r) for r in got] == plain(ODD)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    got = alignment.op11_token_alignment(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", *COLUMNS[:6], "groups_sha256"]
    assert [tuple(r) for r in got.orderBy("doc_id").select(*COLUMNS).collect()] == plain([r["text"] for r in rows])


def test_small_batches_and_short_memory(spark, monkeypatch):
    import pyarrow as pa
    import pyarrow.compute

    whole = alignment.Pair(*[open(n, "rb").read() for n in NAMES])
    texts = [t or "" for t in ODD]
    at_once, links = alignment.align(pa.array(texts), whole)
    monkeypatch.setattr(alignment, "KEPT_PIECES", 3)
    forgetful = alignment.Pair(*[open(n, "rb").read() for n in NAMES])
    one_by_one = [alignment.align(pa.array([t]), forgetful) for t in texts]
    for c in at_once:
        assert list(at_once[c]) == [s[c][0] for s, _ in one_by_one]
    parts = [alignment.align_parts(t, forgetful, 3) for t in texts]
    for c in at_once:
        assert list(at_once[c]) == [s[c][0] for s, _ in parts]
    order = [("doc", "ascending"), ("a", "ascending"), ("b", "ascending")]
    for (_, met), i in zip(parts, range(len(texts))):
        want = links.filter(pa.compute.equal(links["doc"], i)).sort_by(order)
        assert met.sort_by(order).drop_columns("doc").to_pylist() == want.drop_columns("doc").to_pylist()
    assert len(links) == sum(len(x) for _, x in one_by_one)


def test_rows_nulls_and_clashing_columns(spark):
    schema = T.StructType.fromDDL("id string, a string, text string, row_key long, times string, body string")
    docs = spark.createDataFrame([("x", "1", "t", 7, "u", "one two"), ("x", "1", "t", 7, "u", "one two"), (None, None, None, None, None, None)], schema)
    got = alignment.token_links(docs, id_col="id", text_col="body").orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [r["doc_id"] for r in got] == [None, "x", "x"]
    assert tuple(got[0])[1:] == (0, 0, 0, 0, 0, 0, "") and got[1] == got[2] and got[1]["count_sum"] == 2 * got[1]["n_links"]


def test_empty_table(spark):
    assert alignment.token_links(spark.createDataFrame([], "doc_id long, text string")).collect() == []
