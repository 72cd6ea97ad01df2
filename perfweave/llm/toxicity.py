"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary labelled text, back off to the same lowest level: in
how many documents of the whole corpus a word occurs. Both give their lower levels the same weight, that of
the model which needs it more, so an expression that neither class has often is as likely in both and
says nothing; else the smaller class would find every rare word likelier. Of a count up to ``DISCOUNT`` is
taken off, so what was seen that rarely counts through the level below only, which also keeps the models
small without leaving anything out.

A text's evidence is its likelihood ratio normalised by length: the power mean of order ``POWER`` of the
ratios of its words, in logarithms, so a few words that are much likelier in toxic text are not drowned
by many that say little. There is one of the whole models and one of their lower level, words without the
word before. A rare pair that one class has a few times more often, as copied passages do, has a ratio as
high as an expression that tells the classes apart, and only texts that the models have not seen show which
it is: a logistic curve, fitted on such labelled rows, weighs both and turns them into a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfweave.llm.common import stage, table

# Bounds of the labelled sample: documents and characters of a class.
TRAIN_DOCS = 4096
TRAIN_CHARS = 20_000_000
DISCOUNT = 3
POWER = 2
FOLDS = 5

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens)).view(np.int64)


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One number for two words' hashes, modulo 2 ** 64; their order counts."""
    return before * np.int64(0x1E3779B97F4A7C15) + word


class _Places(dict):
    """Places of words among a model's, -1 for all others; filled as words are met, and emptied when too full."""

    def __init__(self, word: np.ndarray):
        super().__init__()
        self.word = word

    def __missing__(self, token: str) -> int:
        h = _hashes([token])[0]
        at = int(np.searchsorted(self.word, h))
        if len(self) >= 500_000:
            self.clear()
        self[token] = at if at < len(self.word) and self.word[at] == h else -1
        return self[token]


@dataclass
class Model:
    """Arrays by a word's place in ``word`` (sorted hashes); column 0 is the toxic class, 1 the ordinary one."""

    word: np.ndarray
    # P(w) of each class, and of the words that follow w: their counts' sum in each class after discounts, and
    # the weight given to it. Classes that both have the word give the same weight.
    p_word: np.ndarray
    follow: np.ndarray
    weight: np.ndarray
    # Hashes of neighbouring words (``pair_hash``), sorted, and their discounted counts.
    pair: np.ndarray
    pair_count: np.ndarray
    # Weights of the evidence of the whole models and of words alone, and the curve's constant.
    curve: tuple[float, float, float] = (2.0, 0.0, -2.0)
    places: _Places | None = None

    def ratios(self, text: str | None) -> np.ndarray:
        """Log-likelihood ratios of every word, behind the word before it (row 0) and alone (row 1).

        They are 0 for a word that the models know from below only.
        """
        tokens = words(text)
        if not tokens or not len(self.word):
            return np.zeros((2, len(tokens)))
        if self.places is None:
            self.places = _Places(self.word)
        at = np.fromiter(map(self.places.__getitem__, tokens), np.int64, len(tokens))
        known = at >= 0
        alone = self.p_word[at]
        p = alone.copy()
        both = np.flatnonzero(known[1:] & known[:-1])
        both = both[self.weight[at[both]].any(1)]
        if len(both):
            before, word = at[both], at[both + 1]
            key = pair_hash(self.word[before], self.word[word])
            k = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            count = np.where((self.pair[k] == key)[:, None], self.pair_count[k], 0)
            w = self.weight[before]
            p[both + 1] = w * count / self.follow[before] + (1 - w) * p[both + 1]
        ratio = np.zeros((2, len(at)))
        for row, q in zip(ratio, (p[known], alone[known]), strict=True):
            row[known] = np.log(q[:, 0]) - np.log(q[:, 1])
        return ratio

    def evidences(self, text: str | None) -> np.ndarray:
        """Logarithms of the power means of the words' likelihood ratios, as in ``ratios``; 0 without words."""
        ratio = POWER * self.ratios(text)
        if not ratio.shape[1]:
            return np.zeros(2)
        top = ratio.max(1)
        return (top + np.log(np.exp(ratio - top[:, None]).mean(1))) / POWER

    def evidence(self, text: str | None) -> float:
        """That of the whole models."""
        return float(self.evidences(text)[0])

    def score(self, text: str | None) -> float:
        *weights, constant = self.curve
        return float(1 / (1 + np.exp(-np.clip(self.evidences(text) @ weights + constant, -30, 30))))


def fold(doc_id: Column) -> Column:
    """Remainder that parts held-out rows (0) from the others; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _document_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many documents of a task each word occurs, by the word's hash."""
    def counted(seen: Counter[str]) -> pd.DataFrame:
        return pd.DataFrame({"word": _hashes(list(seen)), "docs": np.fromiter(seen.values(), np.int64, len(seen))})

    seen: Counter[str] = Counter()
    for batch in batches:
        for text in batch["text"]:
            seen.update(set(words(text)))
            if len(seen) > 200_000:
                yield counted(seen)
                seen.clear()
    yield counted(seen)


def _class_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of neighbouring words of each class; a text's first word follows the key 0."""
    for batch in batches:
        for toxic, part in batch.groupby("toxic"):
            seen: Counter[tuple[int, int]] = Counter()
            for text in part["text"]:
                h = _hashes(words(text)).tolist()
                seen.update(zip([0, *h], h, strict=False))
            keys = np.array(list(seen), dtype=np.int64).reshape(-1, 2)
            yield pd.DataFrame({"toxic": int(toxic), "before": keys[:, 0], "word": keys[:, 1], "n": np.fromiter(seen.values(), np.int64, len(seen))})


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``toxic, curve, text`` of a sample of the labelled rows; ``curve`` marks fold 1, fold 0 has none.

    Of each class and mark it has up to ``most`` rows and ``TRAIN_CHARS`` characters, those with the
    smallest hashes of their ids. Up to twice as many labels are looked up, which bounds what is broadcast.
    A text of more than ``TRAIN_CHARS`` characters is left out and takes no other's place.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & (fold(F.col("id")) > 0)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("curve", fold(F.col("id")) == 1).withColumn("rank", F.xxhash64("id", F.lit("sample")))
    sizes = known.groupBy("toxic", "curve").agg(F.count(F.lit(1)).alias("n")).collect()
    # A hash below the mark leaves some twice the rows asked for, before they are ranked.
    low = F.lit(False)
    for r in sizes:
        mark = (min(1.0, (2 * most + 100) / r["n"]) * 2 - 1) * (1 << 63)
        low |= (F.col("toxic") == r["toxic"]) & (F.col("curve") == r["curve"]) & (F.col("rank") <= min((1 << 63) - 1, int(mark)))
    by = Window.partitionBy("toxic", "curve").orderBy("rank", "id")
    near = known.filter(low).withColumn("place", F.row_number().over(by)).filter(F.col("place") <= 2 * most).drop("place")
    texts = stage(docs.join(F.broadcast(near), "id").select("id", "toxic", "curve", "rank", "text"))
    placed = texts.select("id", "toxic", "curve", "rank", F.coalesce(F.length("text"), F.lit(0)).alias("length")).filter(
        F.col("length") <= TRAIN_CHARS).withColumn("place", F.row_number().over(by)).withColumn("chars", F.sum("length").over(by))
    chosen = placed.filter((F.col("place") <= most) & (F.col("chars") <= TRAIN_CHARS)).select("id").distinct()
    return texts.filter(F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_CHARS).join(chosen, "id", "left_semi").select("toxic", "curve", "text")


def _collected(rows: DataFrame, turn: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """``width`` whole numbers a row on the driver, eight bytes each: the tasks turn and pack the rows."""
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"data": [turn(batch.to_numpy(np.int64)).tobytes()]})

    parts = [r["data"] for r in rows.mapInPandas(packed, "data binary").collect()]
    return np.frombuffer(b"".join(parts), np.int64).reshape(-1, width)


def _discounted(column: str) -> Column:
    return F.greatest(F.col(column) - DISCOUNT, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Models from folds 2 and up, the curve from fold 1; fold 0 is never read with its labels.

    ``docs`` has ``id, text``, ``labels`` has ``id, toxic``. Word counts of the shared level come from all
    rows; labelled rows are a sample of at most ``train_docs`` of a class. The driver gets the words and pairs
    of the sample with a count above the discount; of the others nothing but their sums enters a score.
    """
    sample = stage(_labelled(docs, labels, train_docs))
    pairs = stage(sample.filter("NOT curve").select("toxic", "text").mapInPandas(
        _class_pairs, "toxic int, before long, word long, n long").groupBy("toxic", "before", "word").agg(F.sum("n").alias("n")))
    corpus = stage(docs.select("text").mapInPandas(_document_counts, "word long, docs long").groupBy("word").agg(F.sum("docs").alias("docs")))
    sums = corpus.agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum("docs"), F.lit(0)).alias("docs")).first()

    def by_class(rows: DataFrame, keys: list[str], *columns: str) -> DataFrame:
        """Columns of the toxic class (0) and of the ordinary one (1) side by side; 0 where a class has no row."""
        each = [F.max(F.when(F.col("toxic") == 1 - i, F.col(c))).alias(f"{c}{i}") for c in columns for i in (0, 1)]
        return rows.groupBy(*keys).agg(*each).fillna(0)

    # A word counts by how many different words it follows; a text's first word follows the key 0.
    kinds = pairs.groupBy("toxic", "word").agg(F.count(F.lit(1)).alias("n")).withColumn("top", _discounted("n"))
    whole = {r["toxic"]: r for r in kinds.groupBy("toxic").agg(F.sum("n").alias("n"), F.sum("top").alias("top")).collect()}
    inner = pairs.filter("before <> 0").withColumn("top", _discounted("n"))
    follow = by_class(
        inner.groupBy("toxic", "before").agg(F.sum("n").alias("n"), F.sum("top").alias("top")), ["before"], "n", "top"
    ).filter("least(top0, top1) > 0 OR n0 = 0 AND top1 > 0 OR n1 = 0 AND top0 > 0")
    kept = by_class(inner.filter("top > 0"), ["before", "word"], "top").join(follow.select("before"), "before", "left_semi")
    ends = kept.select("word").unionByName(kept.select(F.col("before").alias("word"))).distinct().withColumn("paired", F.lit(1))
    tops = by_class(kinds.filter("top > 0"), ["word"], "top")
    vocabulary = ends.join(tops, "word", "full").join(corpus, "word", "left").fillna(0)
    known = _collected(vocabulary.select("word", "top0", "top1", "docs"), lambda rows: rows, 4)
    after = _collected(follow.select("before", "n0", "n1", "top0", "top1"), lambda rows: rows, 5)
    seen = _collected(kept.select("before", "word", "top0", "top1"), lambda rows: np.stack([pair_hash(rows[:, 0], rows[:, 1]), rows[:, 2], rows[:, 3]], 1), 3)
    if len(whole) < 2:
        return Model(*[np.zeros(0)] * 6, curve=(0.0, 0.0, -2.0))
    known, seen = known[np.argsort(known[:, 0])], seen[np.argsort(seen[:, 0])]
    word = np.ascontiguousarray(known[:, 0])
    shared = (known[:, 3] + 0.5) / (sums["docs"] + 0.5 * (sums["words"] + 1))
    below = max(1 - r["top"] / r["n"] for r in whole.values())
    p = np.stack([(1 - below) * known[:, 1 + i] / max(whole[1 - i]["top"], 1) + below * shared for i in (0, 1)], 1)
    weight, rest = np.zeros((len(word), 2)), np.ones((len(word), 2))
    at = np.searchsorted(word, after[:, 0])
    own = after[:, 3:5] / np.maximum(after[:, 1:3], 1)
    weight[at] = np.where(after[:, 1:3].min(1, keepdims=True) > 0, own.min(1, keepdims=True), own)
    rest[at] = np.maximum(after[:, 3:5], 1)
    model = Model(word, p, rest, weight, np.ascontiguousarray(seen[:, 0]), seen[:, 1:3].astype(float))
    model.curve = _fit_curve(sample.filter("curve").select("toxic", "text"), model)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the columns of ``x`` and the constant, by Newton's method."""
    x = np.column_stack([x, np.ones(len(y))])
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    x, w = x / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag([1e-3] * len(w)), x.T @ (p - y) + 1e-3 * w
        )
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w / scale


def _fit_curve(sample: DataFrame, model: Model) -> tuple[float, float, float]:
    """Logistic regression on both evidences; one that would count against toxicity is left out."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = np.array([shared.value.evidences(t) for t in batch["text"]]).reshape(-1, 2)
            yield pd.DataFrame({"toxic": batch["toxic"].to_numpy(), "pairs": seen[:, 0], "words": seen[:, 1]})

    seen = sample.mapInPandas(measure, "toxic int, pairs double, words double").toPandas()
    shared.unpersist()
    y = seen["toxic"].to_numpy(float)
    if len(y) < 8 or y.min() == y.max():
        return model.curve
    x = seen[["pairs", "words"]].to_numpy()
    used = np.array([True, True])
    weights = _logistic(x, y)
    while (weights[:-1] < 0).any() and used.sum() > 1:
        used[np.flatnonzero(used)[weights[:-1].argmin()]] = False
        weights = _logistic(x[:, used], y)
    curve = np.zeros(3)
    curve[[*np.flatnonzero(used), 2]] = weights
    return tuple(curve.tolist())


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_id_col: str = "doc_id", label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``id, held_out, score, predicted`` of every row of ``docs``.

    Null, empty and wordless texts have no evidence and get the curve's score of none. Labels that are
    null or neither 0 nor 1 are not used; of several labels of an id the highest counts. Repeated rows
    are scored alike. Without labels of both classes every row has the same low score.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    given = labels.select(F.col(label_id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, given, train_docs))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(model.value.score).astype("float64")

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    scored = rows.select("id", (fold(F.col("id")) == 0).alias("held_out"), F.pandas_udf(score, "double")("text").alias("score"))
    return scored.select("id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumnRenamed("id", "doc_id")
