"""Quality by a weak-label model.

Heuristic labellers vote on every document. Expectation-maximisation over the counts of vote patterns
(at most 3 to the number of labellers, whatever the table) estimates how each labeller votes on good
and on poor text. The posterior of a pattern is the soft label from which a linear scorer over hashed
features learns; the scorer then judges every document by its own words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfweave.llm.common import stage, table

# Bound of the scorer's training sample, in documents; all else covers every row.
TRAIN_DOCS = 8192
FEATURES = 1024
KEEP_FROM = 0.5

# Kind of each byte: capitals, small letters (with all of UTF-8's upper half), symbols, and three marks.
_CAPITAL, _SMALL, _SYMBOL, _SHOUT, _BAR, _END = range(1, 7)
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[ord("A") : ord("Z") + 1] = _CAPITAL
_KINDS[ord("a") : ord("z") + 1] = _SMALL
_KINDS[128:] = _SMALL
_KINDS[[ord(c) for c in "#$%&*^~=<>{}\\@_+"]] = _SYMBOL
_KINDS[[ord(c) for c in "!"]] = _SHOUT
_KINDS[[ord(c) for c in "|"]] = _BAR
_KINDS[[ord(c) for c in ".?"]] = _END


def _vote(value: float, good_below: float, poor_above: float) -> int:
    """2 for poor, 1 for good, 0 for no opinion."""
    return 2 if value > poor_above else 1 if value < good_below else 0


LABELLERS = 10


def votes(text: str) -> tuple[int, ...]:
    """One vote of each labeller on a text. Each defect is seen by two labellers or more."""
    words = text.split()
    n = max(1, len(words))
    kinds = np.bincount(_KINDS[np.frombuffer(text.encode(errors="replace"), dtype=np.uint8)], minlength=7).tolist()
    letters = max(1, kinds[_CAPITAL] + kinds[_SMALL])
    same = sum(map(str.__eq__, words, words[1:]))
    counts = Counter(words)
    few = n < 20
    # Bare words: those that end in a letter, a digit or a mark of prose.
    odd_ends = sum(times for word, times in counts.items() if not (word[-1].isalnum() or word[-1] in ".,;:?)'\"-…»’”"))
    return (
        _vote(kinds[_SYMBOL] / n, 0.2, 0.6),
        _vote(odd_ends / n, 0.08, 0.25),
        _vote(kinds[_SHOUT] / n, 0.1, 0.4),
        _vote(kinds[_CAPITAL] / letters, 0.15, 0.4),
        _vote(kinds[_BAR] / n, 0.02, 0.15),
        _vote(counts["|"] / n, 0.02, 0.12),
        _vote(same / n, 0.05, 0.2),
        0 if few else _vote(counts.most_common(1)[0][1] / n, 0.12, 0.3),
        0 if few else _vote(1 - len(counts) / n, 0.6, 0.75),
        0 if few else _vote(n / max(1, kinds[_END]), 40, 120),
    )


def pattern_of(texts: pd.Series) -> pd.Series:
    """Votes as one number in base 3; -1 for texts without words."""
    def code(text: str | None) -> int:
        if text is None or not text.strip():
            return -1
        out = 0
        for v in votes(text):
            out = out * 3 + v
        return out
    return texts.map(code).astype("int32")


def fit_votes(counts: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """Posterior of good quality for each pattern, by expectation-maximisation.

    Votes are taken as independent given the quality. The start is a majority of a kind: a pattern with
    any poor vote is likelier poor. No opinion says nothing.
    """
    codes = np.array(sorted(counts), dtype=np.int64)
    if not len(codes):
        return {}
    weight = np.array([counts[c] for c in codes.tolist()], dtype=float)
    cast = np.stack([codes // 3 ** (LABELLERS - 1 - j) % 3 for j in range(LABELLERS)], 1)
    good = np.where((cast == 2).any(1), 0.1, 0.95)
    for _ in range(rounds):
        log_odds = np.log((good @ weight + 1) / ((1 - good) @ weight + 1)) * np.ones(len(codes))
        for j in range(LABELLERS):
            cast_any = weight * (cast[:, j] > 0)
            for v in (1, 2):
                hit = cast[:, j] == v
                in_good = (good[hit] @ weight[hit] + 1) / (good @ cast_any + 2)
                in_poor = ((1 - good)[hit] @ weight[hit] + 1) / ((1 - good) @ cast_any + 2)
                log_odds[hit] += np.log(in_good / in_poor)
        new = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        if np.abs(new - good).max() < 1e-6:
            break
        good = new
    return dict(zip(codes.tolist(), new.tolist(), strict=True))


def _place(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature) % FEATURES


def _word_places(word: str) -> tuple[int, int]:
    """Places of a word and of its look: case, and what it ends in if not a letter or digit."""
    case = "A" if word.isupper() else "Aa" if word[0].isupper() else "a"
    tail = "" if word[-1].isalnum() else word[-2:].lstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return _place("w " + word.lower()), _place(f"s {case}{tail}")


def hashed_features(texts: list[str | None]) -> np.ndarray:
    """A row of ``FEATURES`` shares for each text: words, their looks, repeats and length."""
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    known: dict[str, tuple[int, int]] = {}
    repeat, variety, size = _place("repeated word"), _place("variety"), _place("words")
    for i, text in enumerate(texts):
        words = (text or "").split()
        if not words:
            continue
        n, counts = len(words), Counter(words)
        places = np.array([known.get(word) or known.setdefault(word, _word_places(word)) for word in counts], dtype=np.int64)
        times = np.fromiter(counts.values(), np.float64, len(counts)) / n
        row = np.bincount(places[:, 0], times, FEATURES) + np.bincount(places[:, 1], 4 * times, FEATURES)
        row[repeat] += 4 * sum(map(str.__eq__, words, words[1:])) / n
        row[variety] += len(counts) / n
        row[size] += min(1.0, n / 1000)
        out[i] = row
        if len(known) > 200_000:
            known.clear()
    return out


def fit_scorer(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 12) -> np.ndarray:
    """Weights (the last is the constant) of a logistic model on soft labels, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64)
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + pull * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def quality_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> np.ndarray:
    """Weights of the scorer. The votes of all rows are counted; ``train_docs`` rows, those with the
    smallest hashes of id and text, train the scorer, so the driver's arrays have a fixed bound."""
    pattern = F.pandas_udf(pattern_of, "int")
    text = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("rank"))
    cast = stage(text.select("rank", pattern("text").alias("pattern")))
    counts = {r["pattern"]: r["n"] for r in cast.filter("pattern >= 0").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    posterior = fit_votes(counts)
    if not posterior:
        return np.zeros(FEATURES + 1)
    bound = cast.filter("pattern >= 0").orderBy("rank").limit(train_docs).agg(F.max("rank")).first()[0]

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                rows = hashed_features(part["text"].tolist()).astype(np.float16)
                yield pd.DataFrame({"rank": part["rank"], "pattern": pattern_of(part["text"]), "x": [r.tobytes() for r in rows]})

    # Ties of the hash could exceed the bound, hence the limit.
    got = text.filter(F.col("rank") <= bound).mapInPandas(features, "rank long, pattern int, x binary").filter(
        "pattern >= 0").orderBy("rank").limit(train_docs).collect()
    x = np.stack([np.frombuffer(r["x"], dtype=np.float16) for r in got]).astype(np.float32)
    return fit_scorer(x, np.array([posterior[r["pattern"]] for r in got]))


def scorer(weights: np.ndarray):
    """Column function: quality of a text, 0 to 1. Null, empty and blank texts have 0."""
    w, constant = weights[:-1].astype(np.float64), float(weights[-1])

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.zeros(len(texts))
            values = texts.tolist()
            for at in range(0, len(values), 1000):
                part = values[at : at + 1000]
                z = hashed_features(part).astype(np.float64) @ w + constant
                has_words = np.array([bool(t and t.strip()) for t in part])
                out[at : at + 1000] = np.where(has_words, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
            yield pd.Series(out)

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``id, score, kept`` of every row; rows that repeat, or have null ids, are scored like any other."""
    score = scorer(quality_model(docs, id_col, text_col, train_docs))
    scored = docs.select(F.col(id_col).alias("id"), score(F.col(text_col)).alias("score"))
    return scored.select("id", "score", (F.col("score") >= KEEP_FROM).alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of ``docs`` that the scorer accepts, whole."""
    score = scorer(quality_model(docs, id_col, text_col, train_docs))
    return docs.filter(score(F.col(text_col)) >= KEEP_FROM)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
