"""Reading level of texts: a linear pairwise ranker, calibrated into levels by isotonic regression.

Features of syntax (sentence and clause lengths, subordination, passives) and of vocabulary (word
lengths, syllables, derived nouns and verbs, and a lexicon of word grades learned from the labelled
texts). The ranker learns from pairs of differently graded texts; pooling adjacent violators turns
its scores into levels. The steps are fitted on scores of texts the ranker has not seen. The model
holds a number for each distinct word of the labelled texts and is sent to the executors.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.words import words

MAX_LABELLED = 6_000  # labelled texts the model is fitted on: those with the smallest hash of their id
FOLDS = 5
RIDGE = 1e-3  # weight of the squared weights against the mean loss of a pair
PAIR_ROWS = 512  # texts paired with all others in one step of the exact sums

_SENTENCE = re.compile(r"[.?!;:](?=\s|$)|\n\s*\n")
# Endings of derived nouns and verbs; words that open clauses.
LONG_ENDINGS = (b"ation", b"ations", b"ity", b"ities", b"ise", b"ises", b"ised", b"ising", b"ence", b"ance", b"ency", b"ancy", b"ment", b"ness", b"isation", b"ibility")
CLAUSE = {b"which", b"that", b"whose", b"although", b"because", b"since", b"whereas", b"while", b"whenever", b"insofar", b"inasmuch", b"lest", b"thereby", b"unless", b"until", b"if", b"when", b"provided", b"than", b"though", b"whom", b"wherein"}
BE = {b"is", b"are", b"be", b"been", b"was", b"were", b"being"}

FEATURES = ("sentence", "comma", "length", "long7", "long10", "long13", "ending", "clause", "passive", "lexicon", "variety")


class WordTable:
    """Numbers of each distinct word, worked out once: texts become rows of indexes into them."""

    MOST = 1_000_000  # words kept before the table starts anew

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {}
        self.rows = np.zeros((1024, 8))

    def ids(self, w: list[bytes]) -> np.ndarray:
        if len(self.index) > self.MOST:
            self.__init__()
        index = self.index
        try:
            return np.array([index[x] for x in w], dtype=np.int64)
        except KeyError:
            for x in w:
                if x not in index:
                    self._add(x)
            return np.array([index[x] for x in w], dtype=np.int64)

    def _add(self, x: bytes) -> None:
        n = self.index[x] = len(self.index)
        if n >= len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        k = len(x)
        self.rows[n] = (k, k >= 7, k >= 10, k >= 13, x.endswith(LONG_ENDINGS), x in CLAUSE, x in BE, x.endswith(b"ed"))


def surface(text: str, table: WordTable) -> tuple[list[bytes], list[float]]:
    """Words and the features that need no lexicon; rates are per word, so length itself does not count."""
    w = words(text)
    if not w:
        return w, [0.0] * len(FEATURES)
    n = len(w)
    ids = table.ids(w)
    at = table.rows[ids]
    mean = at.mean(axis=0)
    passive = float((at[:-1, 6] * at[1:, 7]).sum()) / n
    sentences = max(1, len(_SENTENCE.findall(text)))
    variety = len(set(w)) / math.sqrt(n)
    return w, [math.log1p(n / sentences), text.count(",") / n, *mean[:6].tolist(), passive, 0.0, variety]


_tables: dict[str, WordTable] = {}  # one a worker process


@dataclass
class Model:
    """A fitted ranker: word grades, feature scaling, weights and the steps from scores to levels."""

    lexicon: dict[bytes, float]
    middle: float
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, text: str, table: WordTable) -> list[float]:
        w, x = surface(text, table)
        x[9] = grade(w, self.lexicon, self.middle)
        return x

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        return ((np.array(rows) - self.mean) / self.scale) @ self.weights

    def level(self, texts: list[str]) -> np.ndarray:
        """Levels from 1 to 5 as fractions."""
        if not texts:
            return np.zeros(0)
        table = _tables.setdefault("words", WordTable())
        return np.interp(self.scores([self.features(t, table) for t in texts]), self.knots, self.levels)


def grade(w: list[bytes], lexicon: dict[bytes, float], middle: float) -> float:
    known = [g for g in map(lexicon.get, w) if g is not None]
    return sum(known) / len(known) if known else middle


def fit_lexicon(bags: list[set[bytes]], y: np.ndarray, weight: float = 2.0) -> tuple[dict[bytes, float], float]:
    """Each word's mean level over the labelled texts that hold it, drawn to the middle where few do."""
    total: dict[bytes, list[float]] = {}
    middle = float(y.mean())
    for bag, level in zip(bags, y):
        for x in bag:
            t = total.setdefault(x, [0.0, 0.0])
            t[0] += level
            t[1] += 1
    return {x: (s + weight * middle) / (n + weight) for x, (s, n) in total.items()}, middle


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: rising steps of (mean score, mean level)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of x, sum of y, number
    for a, b in zip(x[order], y[order]):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def pair_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, gradient and curvature of the logistic loss over all pairs with different grades.

    A pair's difference is never formed: with p the matrix of the pairs' chances, the gradient is the
    rows' sums of 1 - p on the higher texts less those on the lower ones, and the curvature needs the
    sums of p (1 - p) and one product with it. A block of rows of one grade is in memory at a time.
    """
    order = np.argsort(y, kind="stable")
    z, y = z[order].astype(np.float32), y[order]
    grown = np.exp(np.clip(z @ w.astype(np.float32), -40, 40))
    n, k = 0, z.shape[1]
    up, down = np.zeros(len(y)), np.zeros(len(y))  # sums of the misses of each text as the higher and the lower one
    turn, cross = np.zeros(len(y)), np.zeros((k, k))
    starts = np.searchsorted(y, y)  # the texts before it have lower grades
    at = 0
    while at < len(y):
        lower = starts[at]
        end = min(at + PAIR_ROWS, int(np.searchsorted(y, y[at], "right")))
        if lower:
            miss = 1 / (1 + grown[at:end, None] / grown[None, :lower])
            up[at:end] += miss.sum(axis=1)
            down[:lower] += miss.sum(axis=0)
            miss -= miss * miss
            turn[at:end] += miss.sum(axis=1)
            turn[:lower] += miss.sum(axis=0)
            cross += z[at:end].T @ (miss @ z[:lower])
            n += (end - at) * int(lower)
        at = end
    return n, z.T @ (up - down), (z * turn[:, None]).T @ z - cross - cross.T


def fit_ranker(z: np.ndarray, y: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression on the feature differences of all pairs with different grades, by Newton steps."""
    w = np.zeros(z.shape[1]) if start is None else start
    for _ in range(30):
        n, gradient, curve = pair_sums(z, y, w)
        if not n:
            return w
        step = np.linalg.solve(curve / n + RIDGE * np.eye(len(w)), gradient / n - RIDGE * w)
        w = w + step / max(1.0, float(np.abs(step).max()))  # no step is longer than one in any weight
        if np.abs(step).max() < 1e-3:
            break
    return w


def fit(texts: list[str], y: list[float]) -> Model:
    """The model of labelled texts.

    The lexicon feature of a text comes from the other folds' labels, and so does the ranker whose scores
    the isotonic steps are fitted on.
    """
    y = np.array(y, dtype=float)
    table = WordTable()
    parsed = [surface(t, table) for t in texts]
    bags = [set(w) for w, _ in parsed]
    x = np.array([f for _, f in parsed])
    fold = np.arange(len(y)) % FOLDS
    folds = [k for k in range(FOLDS) if (fold == k).any() and (fold != k).any()]
    for k in folds:
        lexicon, middle = fit_lexicon([b for b, f in zip(bags, fold) if f != k], y[fold != k])
        for i in np.flatnonzero(fold == k):
            x[i, 9] = grade(parsed[i][0], lexicon, middle)
    lexicon, middle = fit_lexicon(bags, y)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = (x - mean) / scale
    weights, unseen = fit_ranker(z, y), np.zeros(len(y))
    for k in folds:
        unseen[fold == k] = z[fold == k] @ fit_ranker(z[fold != k], y[fold != k], weights)
    model = Model(lexicon, middle, mean, scale, weights, np.zeros(1), np.zeros(1))
    model.knots, model.levels = isotonic(unseen, y)
    return model


def cross_validated(texts: list[str], y: list[float], folds: int = 5) -> np.ndarray:
    """Levels of labelled texts, each by a model that has not seen the text or its label."""
    out, fold = np.zeros(len(y)), np.arange(len(y)) % folds
    for k in range(folds):
        model = fit([t for t, f in zip(texts, fold) if f != k], [v for v, f in zip(y, fold) if f != k])
        out[fold == k] = model.level([t for t, f in zip(texts, fold) if f == k])
    return out


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, level: the mean over raters of each labelled document, at most ``MAX_LABELLED`` of them.

    Null levels are left out and a rater counts once a document (the greater level of repeated ones).
    """
    rated = labels.where("level is not null and doc_id is not null").groupBy("doc_id", "rater").agg(F.max("level").alias("level"))
    rated = rated.groupBy("doc_id").agg(F.avg("level").alias("level"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    return chosen.join(docs.where("text is not null").select("doc_id", "text"), "doc_id").select("doc_id", "text", "level")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most ``MAX_LABELLED`` labelled texts, which the driver receives one partition at a time."""
    rows = sorted((r.doc_id, r.text, r.level) for r in labelled_texts(docs, labels).toLocalIterator())
    if not rows:
        raise ValueError("no labelled texts to learn from")
    return fit([t for _, t, _ in rows], [y for _, _, y in rows])


def levels(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, level (1 to 5, a fraction) of documents (doc_id, text). Null and blank texts have no level and no row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the words of MAX_LABELLED texts

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = shared.value.level(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "level"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text rlike '\\\\S'")
    return texts.mapInArrow(score, "doc_id long, level double")
