"""Two tokenizers compared on the same text: where their tokens end together, and which ids meet.

A batch of texts stays in Arrow from the token lists on. Lists are flattened beside their parent
indices, byte lengths are summed up within each document, and a hash join on (document, end) finds
the places where a token of either side ends; they cut a document into groups. Ids that share a group
are linked. ``Table.group_by`` counts links per batch and Spark merges the partial counts.

No token of either vocabulary reaches over a space that follows another character than white space, so
texts are cut there and every different piece of a batch is encoded once (``pieces_of``).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfweave.llm.common import stage, table

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
# Text bytes that are aligned at a time; a longer text is aligned in parts.
BATCH_BYTES = 1 << 20
# Id pairs that are looked up in a broadcast table; 17 bytes each.
FREQUENT_PAIRS = 1 << 18
# Encoded pieces that a task remembers.
KEPT_PIECES = 1 << 18
# Different pairs that a task counts before it hands them on.
COUNTED_PAIRS = 1 << 21

# White space at which no cut is made: wider than what either tokenizer takes for white space.
_NO_CUT = r"(^|[\x09-\x0d\x1c-\x20\x{85}\x{180e}\x{200b}\p{Z}])$"

_CUT = re.compile("(?<=[^\\s\x1c-\x1f\x85\u180e\u200b]) (?=.)", re.DOTALL)

ALIGNED = (
    "row_key long, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "a array<int>, b array<int>, times array<long>"
)


def _listed(ids: list[list[int]]) -> pa.ListArray:
    bounds = np.append(0, np.cumsum(np.fromiter(map(len, ids), np.int32, len(ids)), dtype=np.int32))
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(bounds[-1]))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, made from the contents of their files, with the bytes of every id."""

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_bpe.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        letters = byte_letters()
        vocabulary = json.loads(byte_bpe)["model"]["vocab"]
        entries = [b"?"] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            entries[i] = bytes(letters[c] for c in entry) if set(entry) <= letters.keys() else entry.encode()
        self.bytes_a = pa.array(entries, pa.binary())
        self.size_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = pa.array(
            [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)],
            pa.binary(),
        )
        # A vocabulary with pieces over a space gets whole texts.
        self.cut = not any("▁" in p.lstrip("▁") for p in pieces)
        self.names = pa.array([str(i) for i in range(max(len(entries), self.size_b))])
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.ids = [pa.array([], pa.list_(pa.int32()))] * 2

    def encode(self, texts: list[str]) -> tuple[pa.Array, pa.ListArray, pa.ListArray]:
        """(row of every text, ids by row): of space + text by the first tokenizer, of text by the second.

        The second one adds the space itself. Rows of earlier batches stay, up to ``KEPT_PIECES``.
        """
        if len(self.seen) > KEPT_PIECES:
            self._forget()
        new = [t for t in texts if t not in self.seen]
        self.seen.update(zip(new, range(len(self.seen), len(self.seen) + len(new))))
        first = [e.ids for e in self.a.encode_batch_fast([" " + t for t in new], add_special_tokens=False)]
        for i, ids in enumerate((first, self.b.encode(new, num_threads=1))):
            self.ids[i] = pa.concat_arrays([self.ids[i], _listed(ids)])
        return pa.array([self.seen[t] for t in texts], pa.int64()), *self.ids


def pieces_of(spaced: pa.StringArray, cut: bool = True) -> tuple[pa.StringArray, np.ndarray]:
    """(pieces without their first space, offsets per text) of texts that begin with a space.

    A cut is made before a space that follows another character than white space, but not before the
    last character of a text. A space plus a piece, piece after piece, gives the text back.
    """
    whole = pc.utf8_slice_codeunits(spaced, 1)
    if not cut:
        return whole, np.arange(len(spaced) + 1)
    split = pc.split_pattern(spaced, " ")
    bounds = split.offsets.to_numpy()
    kept = np.ones(len(split.values), bool)
    kept[bounds[:-1]] = False  # nothing stands before the first space
    parts = split.values.filter(pa.array(kept))
    bounds = bounds - np.arange(len(bounds))
    open_end = pc.match_substring_regex(parts, _NO_CUT).to_numpy(zero_copy_only=False)
    glued = np.append(False, open_end[:-1])
    last = bounds[1:] - 1
    glued[last] |= pc.equal(parts.take(pa.array(last)), "").to_numpy(zero_copy_only=False)
    glued[bounds[:-1]] = False
    starts = np.flatnonzero(~glued)
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(parts)), pa.int32()), parts)
    return pc.binary_join(lists, " "), np.searchsorted(starts, bounds)


def _tokens(per_piece: pa.ListArray, codes: pa.Array, bounds: np.ndarray) -> pa.ListArray:
    """Token ids per text from those of its pieces."""
    lists = per_piece.take(codes)
    return pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy()[bounds], pa.int32()), lists.values)


def _spells(tokens: pa.ListArray, entries: pa.Array, spaced: pa.StringArray) -> np.ndarray:
    """Whether the bytes of a text's tokens, joined, are the text."""
    joined = entries.take(tokens.values)
    at = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1)[tokens.offsets.to_numpy()]
    want = np.frombuffer(spaced.buffers()[1], np.int32, len(spaced) + 1 + spaced.offset)[spaced.offset:]
    got_bytes, want_bytes = joined.buffers()[2], spaced.buffers()[2]
    if len(joined) == 0 or want_bytes is None:
        return np.zeros(len(spaced), bool)
    got, asked = memoryview(got_bytes), memoryview(want_bytes)
    return np.fromiter(
        (got[at[i]:at[i + 1]] == asked[want[i]:want[i + 1]] for i in range(len(spaced))), bool, len(spaced)
    )


def _ends(tokens: pa.ListArray, entries: pa.Array, good: np.ndarray) -> pa.Table:
    """Tokens of the good texts: document, id, and the byte at which the token ends in it."""
    parents = pc.list_parent_indices(tokens).to_numpy()
    lengths = pc.binary_length(entries).take(tokens.values).to_numpy().astype(np.int64)
    total = np.append(0, np.cumsum(lengths))
    ends = total[1:] - total[tokens.offsets.to_numpy()[parents]]
    kept = good[parents]
    key = (parents.astype(np.int64) << 40) + ends
    return pa.table({"doc": parents[kept], "doc_end": key[kept], "id": tokens.values.filter(pa.array(kept))})


def _numbered(t: pa.Table, name: str) -> pa.Table:
    return pa.table({"doc_end": t["doc_end"], name: np.arange(len(t))})


def _met(a: pa.ListArray, b: pa.ListArray) -> pa.Table:
    """Id pairs of every group: ``group, a, b, times``.

    Where a side is one token, it meets all of the other. Elsewhere ids are counted within the group before
    the sides are joined, so a group makes a row per pair of different ids.
    """
    bounds = [x.offsets.to_numpy() for x in (a, b)]
    sizes = [np.diff(x) for x in bounds]
    flat = [x.values.to_numpy() for x in (a, b)]
    parents = [pc.list_parent_indices(x).to_numpy() for x in (a, b)]
    one_a = (sizes[0] == 1)[parents[1]]
    one_b = ((sizes[1] == 1) & (sizes[0] > 1))[parents[0]]
    group = np.append(parents[1][one_a], parents[0][one_b])
    first = np.append(flat[0][bounds[0][parents[1][one_a]]], flat[0][one_b])
    second = np.append(flat[1][one_a], flat[1][bounds[1][parents[0][one_b]]])
    single = pa.table({"group": group, "a": first, "b": second, "times": np.ones(len(group), np.int64)})
    many = (sizes[0] > 1) & (sizes[1] > 1)
    sides = []
    for i, name in enumerate(("a", "b")):
        t = pa.table({"group": parents[i], name: flat[i]}).filter(pa.array(many[parents[i]]))
        counted = t.group_by(["group", name], use_threads=False).aggregate([([], "count_all")])
        sides.append(counted.rename_columns(["group", name, f"n_{name}"]))
    joined = sides[0].join(sides[1], "group", join_type="inner", use_threads=False)
    times = pc.multiply(joined["n_a"], joined["n_b"])
    return pa.concat_tables([single, joined.select(["group", "a", "b"]).append_column("times", times)])


def align(texts: pa.StringArray, pair: Pair) -> tuple[dict[str, np.ndarray | list], pa.Table]:
    """(per text: n_a, n_b, n_groups, lines, spelt; links: doc, a, b, times) of a batch without nulls.

    ``lines`` writes a text's groups out; ``spelt`` tells whether it has tokens at all.
    """
    n = len(texts)
    spaced = pc.binary_join_element_wise(pa.scalar(""), texts, " ")
    pieces, bounds = pieces_of(spaced, pair.cut)
    coded = pieces.dictionary_encode()
    rows, *per_piece = pair.encode(coded.dictionary.to_pylist())
    tokens = [_tokens(p, rows.take(coded.indices), bounds) for p in per_piece]
    entries = (pair.bytes_a, pair.bytes_b)
    good = _spells(tokens[0], entries[0], spaced) & _spells(tokens[1], entries[1], spaced)
    good &= pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
    a, b = (_ends(t, e, good) for t, e in zip(tokens, entries))

    both = _numbered(a, "at_a").join(_numbered(b, "at_b"), "doc_end", join_type="inner", use_threads=False)
    both = both.sort_by("at_a")
    # A document's last tokens end together, so groups follow each other without gaps.
    cuts = [pa.array(np.append(0, both[c].to_numpy() + 1), pa.int32()) for c in ("at_a", "at_b")]
    ids = [t["id"].combine_chunks() for t in (a, b)]
    groups = [pa.ListArray.from_arrays(c, i) for c, i in zip(cuts, ids)]
    doc_of_group = both["doc_end"].to_numpy() >> 40
    group_bounds = np.searchsorted(doc_of_group, np.arange(n + 1))

    written = [
        pc.binary_join(pa.ListArray.from_arrays(c, pair.names.take(i)), ",") for c, i in zip(cuts, ids)
    ]
    lines = pc.binary_join(
        pa.ListArray.from_arrays(pa.array(group_bounds, pa.int32()), pc.binary_join_element_wise(*written, "|")), ";"
    )
    sums = {
        "n_a": np.bincount(a["doc"].to_numpy(), minlength=n),
        "n_b": np.bincount(b["doc"].to_numpy(), minlength=n),
        "n_groups": np.diff(group_bounds),
        "lines": lines,
        "spelt": good,
    }

    met = _met(*groups)
    met = met.append_column("doc", pa.array(doc_of_group[met["group"].to_numpy()]))
    links = met.group_by(["doc", "a", "b"], use_threads=False).aggregate([("times", "sum")])
    return sums, links.rename_columns(["doc", "a", "b", "times"])


def align_parts(text: str, pair: Pair, most: int) -> tuple[dict[str, np.ndarray | list], pa.Table]:
    """``align`` of one long text, in parts of some ``most`` characters: both sides' tokens end at a cut."""
    parts, start = [], 0
    while (cut := _CUT.search(text, start + most)) is not None:
        parts.append(text[start:cut.start()])
        start = cut.end()
    parts.append(text[start:])
    sums, lines, links = np.zeros(3, np.int64), [], []
    for part in parts:
        one, met = align(pa.array([part]), pair)
        if not one["spelt"][0]:
            return align(pa.array([""]), pair)
        sums += [one[c][0] for c in ("n_a", "n_b", "n_groups")]
        lines.append(one["lines"][0].as_py())
        links.append(met)
    found = pa.concat_tables(links).group_by(["doc", "a", "b"], use_threads=False).aggregate([("times", "sum")])
    whole = {c: sums[i:i + 1] for i, c in enumerate(("n_a", "n_b", "n_groups"))}
    return whole | {"lines": pa.array([";".join(lines)]), "spelt": np.ones(1, bool)}, found.rename_columns(["doc", "a", "b", "times"])


def _slices(texts: pa.StringArray, most: int) -> Iterator[tuple[int, int]]:
    sizes = pc.binary_length(texts).to_numpy()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def aligned(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    byte_bpe: str = f"{TOKENIZERS}/{BYTE_BPE}", piece_bpe: str = f"{TOKENIZERS}/{PIECE_BPE}",
) -> DataFrame:
    """Every row's tokens, groups and links: the columns of ``ALIGNED``, staged.

    ``a``, ``b`` and ``times`` list the different id pairs of a row and how often each is linked. Null and
    empty texts, and texts that a tokenizer does not spell out byte by byte, have no tokens. Equal rows are
    rows of their own (``row_key``); ids may be of any type, repeated or null.

    The driver reads the tokenizer files; their contents (some 2 MB) go to the executors with the task.
    """
    with open(byte_bpe, "rb") as f, open(piece_bpe, "rb") as g:
        files = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, key = Pair(*files.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch["text"].cast(pa.string()).fill_null("")
            for lo, hi in _slices(texts, BATCH_BYTES):
                if pair.cut and hi - lo == 1 and len(text := texts[lo].as_py()) > BATCH_BYTES:
                    sums, links = align_parts(text, pair, BATCH_BYTES)
                else:
                    sums, links = align(texts.slice(lo, hi - lo), pair)
                digests = [hashlib.sha256(x.as_buffer()).hexdigest() if ok else "" for x, ok in zip(sums["lines"], sums["spelt"])]
                links = links.sort_by([("doc", "ascending"), ("a", "ascending"), ("b", "ascending")]).combine_chunks()
                at = pa.array(np.searchsorted(links["doc"].to_numpy(), np.arange(hi - lo + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, links[c].combine_chunks()) for c in ("a", "b", "times")]
                total = np.append(0, np.cumsum(links["times"].to_numpy()))[at.to_numpy()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(key, key + hi - lo)), batch["doc_id"].slice(lo, hi - lo),
                        *[pa.array(sums[c], pa.int64()) for c in ("n_a", "n_b", "n_groups")],
                        pa.array(np.diff(total), pa.int64()), pa.array(digests, pa.string()), *lists,
                    ],
                    names=["row_key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times"],
                )
                key += hi - lo
                pa.default_memory_pool().release_unused()

    return stage(rows.mapInArrow(run, ALIGNED.format(id=rows.schema["doc_id"].dataType.simpleString())))


def pair_counts(alignments: DataFrame) -> DataFrame:
    """``a, b, docs``: how many rows hold an id pair linked. Tasks count what they read before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({"a": pa.array([], pa.int32()), "b": pa.array([], pa.int32()), "docs": pa.array([], pa.int64())})
        for batch in batches:
            ids = [batch[c].flatten() for c in ("a", "b")]
            one = pa.table({"a": ids[0], "b": ids[1], "docs": pa.array(np.ones(len(ids[0]), np.int64))})
            held = pa.concat_tables([held, one]).group_by(["a", "b"], use_threads=False).aggregate([("docs", "sum")])
            held = held.rename_columns(["a", "b", "docs"])
            if len(held) >= COUNTED_PAIRS:
                yield from held.to_batches()
                held = held.slice(0, 0)
        yield from held.to_batches()

    partial = alignments.select("a", "b").mapInArrow(run, "a int, b int, docs long")
    return partial.groupBy("a", "b").agg(F.sum("docs").alias("docs"))


def link_scores(alignments: DataFrame, frequent_pairs: int = FREQUENT_PAIRS) -> DataFrame:
    """``row_key, n_best, count_sum`` of the rows with links.

    ``count_sum`` adds up the pairs' counts over all links; ``n_best`` counts the links whose pair is the
    most frequent of its ``a`` id, ties included. The ``frequent_pairs`` most frequent pairs are looked up
    where the rows are read; any other one stands in at most a ``frequent_pairs``-th of all pairs listed, and
    goes through a join. The best count per ``a`` id is one row for each id of the vocabulary.
    """
    spark = alignments.sparkSession
    counts = stage(pair_counts(alignments))
    best = counts.groupBy("a").agg(F.max("docs").alias("most"))
    judged = counts.join(F.broadcast(best), "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("is_best"))
    top = judged.orderBy(F.desc("docs"), "a", "b").limit(frequent_pairs).toArrow()
    key = pc.add(pc.shift_left(top["a"].cast(pa.int64()), 32), top["b"].cast(pa.int64())).combine_chunks()
    known = spark.sparkContext.broadcast((key, top["docs"].to_numpy(), top["is_best"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, is_best = known.value
        for batch in batches:
            a, b, times = (batch[c].flatten() for c in ("a", "b", "times"))
            row = batch["row_key"].to_numpy()
            of_row = pc.list_parent_indices(batch["a"]).to_numpy()
            asked = pc.add(pc.shift_left(a.cast(pa.int64()), 32), b.cast(pa.int64()))
            found = pc.index_in(asked, value_set=keys)
            hit = found.is_valid().to_numpy(zero_copy_only=False)
            at, n = found.drop_null().to_numpy(), times.to_numpy()[hit]
            sums = [np.zeros(len(row), np.int64) for _ in range(2)]
            if len(at):
                np.add.at(sums[0], of_row[hit], n * is_best[at])
                np.add.at(sums[1], of_row[hit], n * docs[at])
            none = pa.nulls(len(row), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), none, none, pa.nulls(len(row), pa.int64()), pa.array(sums[0]), pa.array(sums[1])], names=names
            )
            rest = pa.array(~hit)
            zero = pa.array(np.zeros(int((~hit).sum()), np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[of_row[~hit]]), a.filter(rest), b.filter(rest), times.filter(rest), zero, zero], names=names
            )

    names = ["row_key", "a", "b", "times", "n_best", "count_sum"]
    found = stage(
        alignments.filter("n_links > 0").select("row_key", "a", "b", "times")
        .mapInArrow(run, "row_key long, a int, b int, times long, n_best long, count_sum long")
    )
    joined = found.filter("a IS NOT NULL").join(judged, ["a", "b"]).select(
        "row_key", F.when(F.col("is_best"), F.col("times")).otherwise(0).alias("n_best"),
        (F.col("times") * F.col("docs")).alias("count_sum"),
    )
    parts = found.filter("a IS NULL").select("row_key", "n_best", "count_sum").unionByName(joined)
    return parts.groupBy("row_key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def token_links(docs: DataFrame, **options) -> DataFrame:
    """Alignment figures of every row of ``docs``; ``options`` are those of ``aligned``."""
    found = aligned(docs, **options)
    scores = link_scores(found)
    none = F.lit(0).cast("long")
    return found.drop("a", "b", "times").join(scores, "row_key", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256",
    )


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    return token_links(table(spark, sf_dir, "documents"))
