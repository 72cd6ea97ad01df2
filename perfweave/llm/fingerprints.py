"""Document fingerprints from which the difference of two versions can be read back.

A text falls into paragraphs: its lines, and long lines are cut further where their content says so, so an
edit changes the paragraphs around it only. The digests of the different paragraphs go into an invertible
Bloom lookup table: three cells each, which hold a count, a sum of digests and a sum of checks. The cells of
two versions subtract; what both have cancels out. A cell left with one digest names it, is taken out of its
other cells, and so on (peeling) until all cells are empty. If that fails the tables were too small for the
difference, and both are built again, larger.

All texts of a batch are cut, hashed and peeled together in numpy arrays; Spark brings each document beside
the next one by a range sort.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfweave.llm.common import stage, table

# A paragraph ends after a line feed, and where the last WINDOW characters hash to one value in MEAN_CHARS.
WINDOW = 8
MEAN_CHARS = 32
# Characters that are cut at a time; a longer text has a paragraph's end after each so many.
SLAB = 1 << 20
# A digest has a cell in each of three rows of so many cells, in fingerprints as they are given out.
ROW_CELLS = 4
# Tables of one size that fail go on, larger and hashed anew; the chance to fail falls with each.
MOST_TRIES = 60

_U = np.uint64
_ODD = tuple(_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit values."""
    with np.errstate(over="ignore"):
        z = x + _ODD[0] * _U(seed + 1)
        z = (z ^ (z >> _U(30))) * _ODD[1]
        z = (z ^ (z >> _U(27))) * _ODD[2]
        return z ^ (z >> _U(31))


def _slab_digests(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(part, digest) of every paragraph of ``parts``."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(chars):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.cumsum(sizes)
    values = mixed(chars)
    window = values.copy()
    with np.errstate(over="ignore"):
        for k in range(1, WINDOW):
            window[k:] += values[:-k] * _ODD[1] ** _U(k)
    cut = (mixed(window) % _U(MEAN_CHARS)) == 0
    whole = np.arange(len(chars)) - np.repeat(ends - sizes, sizes) >= WINDOW - 1
    cut = cut & whole | (chars == 10)
    cut[ends[sizes > 0] - 1] = True
    last = np.flatnonzero(cut)
    first = np.append(0, last[:-1] + 1)
    lengths = last - first + 1
    # Characters weighed by powers of their place in the paragraph, added up modulo 2^64.
    powers = np.multiply.accumulate(np.append(_U(1), np.full(int(lengths.max()) - 1, _ODD[2])))
    place = np.arange(len(chars)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(values * powers[place], first)
        return np.searchsorted(ends, first, side="right"), mixed(sums + lengths.astype(np.uint64), 7)


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, digests): of text i the different paragraphs' digests, sorted, between bounds i and i + 1."""
    owners, found = [], []
    parts, held, owner = [], 0, []

    def settle() -> None:
        nonlocal parts, held, owner
        at, values = _slab_digests(parts)
        owners.append(np.array(owner, np.int64)[at])
        found.append(values)
        parts, held, owner = [], 0, []

    for i, text in enumerate(texts):
        for lo in range(0, len(text), SLAB):
            parts.append(text[lo:lo + SLAB])
            owner.append(i)
            held += len(parts[-1])
            if held >= SLAB:
                settle()
    if parts:
        settle()
    of, values = (np.concatenate([np.zeros(0, t), *x]) for t, x in ((np.int64, owners), (np.uint64, found)))
    order = np.lexsort((values, of))
    of, values = of[order], values[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (values[1:] != values[:-1])
    return np.searchsorted(of[new], np.arange(len(texts) + 1)), values[new]


class Tables:
    """Invertible Bloom lookup tables side by side: table i has three rows of ``rows[i]`` cells."""

    def __init__(self, rows: np.ndarray, salt: int = 0):
        self.rows, self.salt = rows.astype(np.int64), salt
        self.starts = np.append(0, np.cumsum(3 * self.rows))
        self.owner = np.repeat(np.arange(len(rows)), 3 * self.rows)
        n = int(self.starts[-1])
        self.counts, self.keys, self.checks = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)

    def _check(self, keys: np.ndarray) -> np.ndarray:
        return mixed(keys, 1000 + self.salt) >> _U(32)

    def add(self, of: np.ndarray, keys: np.ndarray, signs: np.ndarray) -> None:
        """Puts ``keys`` into tables ``of``; a sign of -1 takes them out."""
        by = signs.astype(np.uint64)  # -1 is 2^64 - 1, so products are taken modulo 2^64
        with np.errstate(over="ignore"):
            weighed, checks = keys * by, self._check(keys) * by
            for j in range(3):
                cell = (mixed(keys, 3 * self.salt + j) % self.rows[of].astype(np.uint64)).astype(np.int64)
                cell += self.starts[of] + j * self.rows[of]
                np.add.at(self.counts, cell, signs)
                np.add.at(self.keys, cell, weighed)
                np.add.at(self.checks, cell, checks)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(table, digest, sign) of what can be told apart, and whether each table has been emptied."""
        out = []
        while True:
            single = np.flatnonzero(np.abs(self.counts) == 1)
            signs = self.counts[single]
            with np.errstate(over="ignore"):
                keys = self.keys[single] * signs.astype(np.uint64)
                checks = self.checks[single] * signs.astype(np.uint64)
            # A digest that lies in another cell than its own would be a chance hit of the check.
            pure = checks == self._check(keys)
            of, keys, signs = self.owner[single[pure]], keys[pure], signs[pure]
            order = np.lexsort((keys, of))
            of, keys, signs = of[order], keys[order], signs[order]
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])
            of, keys, signs = of[new], keys[new], signs[new]
            if not len(of) or len(out) >= MOST_TRIES:
                break
            self.add(of, keys, -signs)
            out.append((of, keys, signs))
        left = np.zeros(len(self.rows), bool)
        left[self.owner[(self.counts != 0) | (self.keys != 0) | (self.checks != 0)]] = True
        of, keys, signs = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.int64, np.uint64, np.int64), list(zip(*out)) or ((), (), ())))
        return of, keys, signs, ~left


def _taken(bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``which``, place in the flat array) of all entries of the lists ``which``."""
    sizes = bounds[which + 1] - bounds[which]
    of = np.repeat(np.arange(len(which)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + bounds[which][of]


def differences(
    bounds: np.ndarray, values: np.ndarray, left: np.ndarray, right: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, sign) of what the texts of each pair do not share: 1 for the left one's, -1 for the right one's.

    The first tables are those of the fingerprints. Pairs that fail get tables for a difference of all their
    paragraphs, and after that twice as many cells each time.
    """
    todo, rows = np.arange(len(left)), np.full(len(left), ROW_CELLS)
    sizes = np.diff(bounds)
    out = []
    for salt in range(MOST_TRIES):
        tables = Tables(rows, salt)
        for side, sign in ((left, 1), (right, -1)):
            of, at = _taken(bounds, side[todo])
            tables.add(of, values[at], np.full(len(of), sign))
        of, keys, signs, done = tables.peel()
        good = done[of]
        out.append((todo[of[good]], keys[good], signs[good]))
        if done.all():
            return tuple(np.concatenate(x) for x in zip(*out))
        todo, rows = todo[~done], rows[~done]
        enough = (sizes[left[todo]] + sizes[right[todo]]) // 2 + ROW_CELLS
        rows = np.maximum(2 * rows, enough)
    raise RuntimeError("tables of all sizes failed")  # a chance of less than 2^-60 for each pair


def likeness(bounds: np.ndarray, values: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share of common paragraphs among all of a pair, number of differing ones); two empty texts are alike."""
    pair, _, signs = differences(bounds, values, left, right)
    only = [np.bincount(pair[signs == s], minlength=len(left)) for s in (1, -1)]
    sizes = np.diff(bounds)
    common = sizes[left] - only[0]
    union = common + only[0] + only[1]
    return np.where(union == 0, 1.0, common / np.maximum(union, 1)), only[0] + only[1]


def fingerprints(bounds: np.ndarray, values: np.ndarray) -> list[str]:
    """``number of paragraphs:cells`` of every text, cells as base64 of counts, digest sums and checks."""
    n = len(bounds) - 1
    tables = Tables(np.full(n, ROW_CELLS))
    of, at = _taken(bounds, np.arange(n))
    tables.add(of, values[at], np.ones(len(of), np.int64))
    cells = 3 * ROW_CELLS
    packed = np.zeros((n, cells), np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u8")]))
    for field, column in (("count", tables.counts), ("key", tables.keys), ("check", tables.checks)):
        packed[field] = column.reshape(n, cells)
    return [f"{k}:{base64.b64encode(row.tobytes()).decode()}" for k, row in zip(np.diff(bounds), packed)]


def compared(one: str, other: str) -> tuple[list[int], list[int]] | None:
    """Digests that only the one and only the other of two fingerprints holds; None if they differ by too much."""
    tables = Tables(np.array([ROW_CELLS]))
    for text, sign in ((one, 1), (other, -1)):
        cells = np.frombuffer(base64.b64decode(text.partition(":")[2]), np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u8")]))
        with np.errstate(over="ignore"):
            tables.counts += sign * cells["count"]
            tables.keys += cells["key"] * np.int64(sign).astype(np.uint64)
            tables.checks += cells["check"] * np.int64(sign).astype(np.uint64)
    _, keys, signs, done = tables.peel()
    return tuple(sorted(keys[signs == s].tolist()) for s in (1, -1)) if done[0] else None


def edited_text(text: str, other: str) -> str:
    """``text`` with its second half replaced by as much of the beginning of ``other``."""
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


def _described(ids: list, texts: list[str], following: list[str]) -> dict[str, list]:
    """Results of the documents ``texts``, each followed by that of the same place in ``following``."""
    n = len(texts)
    edited = [edited_text(t, f) for t, f in zip(texts, following)]
    # What follows a text is mostly the next one of the list: it is cut once.
    places = {id(t): i for i, t in enumerate(texts)}
    extra = [f for f in following if id(f) not in places]
    places |= {id(f): 2 * n + i for i, f in enumerate(extra)}
    bounds, values = digests(texts + edited + extra)
    marks = fingerprints(bounds[:2 * n + 1], values)
    here = np.arange(n)
    near_edited, differing = likeness(bounds, values, here, here + n)
    near_next, _ = likeness(bounds, values, here, np.array([places[id(f)] for f in following], np.int64))
    return {
        "doc_id": ids, "n_chars": list(map(len, texts)),
        "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
        "fingerprint": marks[:n], "edited_fingerprint": marks[n:],
        "near_edited": near_edited.tolist(), "near_next": near_next.tolist(), "n_differing": differing.tolist(),
    }


RESULT = (
    "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_differing long"
)


def _texts(column: pa.Array) -> list[str]:
    return [(b or b"").decode("utf-8", "replace") for b in column.to_pylist()]


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, a row for each row of ``docs``.

    The edited text is that of ``edited_text`` with the next document: rows are ordered by falling id, of
    equal ids by falling hash of the text, null ids last; the first row follows the last. Null text counts
    as empty, an only row is its own next one, and the likeness of two empty texts is 1. Ids may be of any
    type that sorts. ``n_differing`` counts the paragraph digests in which text and edited text differ.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The last key orders only rows that are equal, so that many copies of one need not be in one task.
    ordered = rows.withColumn("digest", F.xxhash64("text")).withColumn("copy", F.monotonically_increasing_id())
    by = [F.desc_nulls_last("doc_id"), F.desc("digest"), "copy"]
    ordered = ordered.repartitionByRange(*by).sortWithinPartitions(*by)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["part", "edge", "text", *[c.split()[0] for c in RESULT.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, first, schema = TaskContext.get().partitionId(), [], 0, None, None

        def edge(name: str, row: tuple) -> pa.RecordBatch:
            given = {"part": part, "edge": name, "text": row[1], "doc_id": row[0]}
            return pa.RecordBatch.from_pylist([{c: given.get(c) for c in names}], schema)

        def settled() -> pa.RecordBatch:
            ids, texts = map(list, zip(*held))
            found = _described(ids[:-1], texts[:-1], texts[1:])
            n = len(ids) - 1
            return pa.RecordBatch.from_pydict({"part": [part] * n, "edge": [None] * n, "text": [None] * n, **found}, schema)

        for batch in batches:
            if schema is None:
                types = [pa.int32(), pa.string(), pa.string(), batch.schema.field("doc_id").type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64()]
                schema = pa.schema(list(zip(names, types)))
            for row in zip(batch["doc_id"].to_pylist(), _texts(batch["text"])):
                first = first or row
                held.append(row)
                size += len(row[1])
                if size >= SLAB and len(held) > 1:
                    yield settled()
                    held = held[-1:]
                    size = len(row[1])
        if held:
            if len(held) > 1:
                yield settled()
            yield edge("first", first)
            yield edge("last", held[-1])

    found = stage(
        ordered.select("doc_id", F.col("text").cast("binary").alias("text"))
        .mapInArrow(run, f"part int, edge string, text string, {RESULT.format(id=kind)}")
    )
    # One number per task that had rows: after the last row of one comes the first row of the next.
    parts = sorted(r["part"] for r in found.filter("edge = 'first'").select("part").collect())
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    firsts = found.filter("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    lasts = found.filter("edge = 'last'").select("part", "doc_id", "text").join(after, "part").join(firsts, "next_part")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                result = _described([0], _texts(one["text"]), _texts(one["following"]))
                columns = [one["doc_id"], *[pa.array(result[c]) for c in names[4:]]]
                yield pa.RecordBatch.from_arrays(columns, names=names[3:])

    edges = lasts.select("doc_id", *[F.col(c).cast("binary").alias(c) for c in ("text", "following")]).mapInArrow(rest, RESULT.format(id=kind))
    return found.filter("edge IS NULL").select(*names[3:]).unionByName(edges)


def op13_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))
