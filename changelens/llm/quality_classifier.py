"""Quality score by compression: how much smaller a text gets with a dictionary of good texts than with one of bad.

Two zstandard dictionaries are trained on labelled good and bad texts. A text is cut into pieces of about a
kilobyte, each is compressed with either dictionary and without any, and the normalised difference of the sizes
(over the whole text, and of the piece that speaks most against it) together with the plain ratio goes through a
logistic curve, fitted on labelled texts that the dictionaries have not seen.
"""

from __future__ import annotations

import functools
import random
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold

#: Bounds of the fit: labelled documents of each class, and bytes used of each.
SAMPLE = 4_000
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 112 * 1024
PIECES = 8_000
PIECE = 1_000
LEVEL = 3
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """What scoring needs; ``dictionaries`` (bad, good) is empty if there was nothing to learn from."""

    dictionaries: tuple[bytes, ...] = ()
    low: tuple[float, ...] = ()
    high: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    #: The score where nothing is known: the share of good among the labels.
    prior: float = 0.5


@functools.lru_cache(maxsize=4)
def _compressors(dictionaries: tuple[bytes, ...]) -> list[zstandard.ZstdCompressor]:
    """With the bad dictionary, the good one, and none."""
    made = []
    for data in dictionaries:
        known = zstandard.ZstdCompressionDict(data)
        known.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False))
    return [*made, zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)]


def features(text: str, dictionaries: tuple[bytes, ...]) -> tuple[float, float, float]:
    """Difference over the whole text, least difference of a piece, size without a dictionary; of a text not empty."""
    bad, good, plain = _compressors(dictionaries)
    data = text.encode()
    step = -(-len(data) // max(1, round(len(data) / PIECE)))
    whole = both = alone = 0
    least = 1.0
    for at in range(0, len(data), step):
        piece = data[at : at + step]
        x, y = len(bad.compress(piece)), len(good.compress(piece))
        whole, both, alone = whole + x - y, both + x + y, alone + len(plain.compress(piece))
        least = min(least, (x - y) / (x + y))
    return whole / both, least, min(1.0, alone / len(data))


def score(text: str | None, model: Model) -> float:
    """0 to 1, higher for better texts; NULL and empty texts have 0."""
    if not text:
        return 0.0
    if not model.dictionaries:
        return model.prior
    *weights, bias = model.weights
    found = zip(features(text, model.dictionaries), model.low, model.high, weights)
    z = bias + sum(w * (min(max(x, low), high) - low) / (high - low) for x, low, high, w in found)
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and bias of a logistic curve, by Newton's method."""
    a, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    penalty = ridge * np.eye(len(w))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[tuple[str, int]], seed: int = 0) -> Model:
    """A model from (text, label) pairs: one half makes the dictionaries, the other the curve."""
    rng = random.Random(seed)
    texts = sorted((t, q) for t, q in texts if t)
    rng.shuffle(texts)
    prior = sum(q for _, q in texts) / len(texts) if texts else 0.5
    half, made = len(texts) // 2, []
    for label in (0, 1):
        own = [t.encode() for t, q in texts[:half] if q == label]
        pieces = [t[i : i + PIECE] for t in own for i in range(0, len(t), PIECE)]
        rng.shuffle(pieces)
        pieces = pieces[:PIECES]
        try:
            # A dictionary may take up a third of what it is made from.
            size = min(DICTIONARY_BYTES, sum(map(len, pieces)) // 3)
            made.append(zstandard.train_dictionary(size, pieces).as_bytes())
        except (zstandard.ZstdError, ValueError):  # too few texts of this class
            return Model(prior=prior)
    dictionaries = tuple(made)
    x = np.array([features(t, dictionaries) for t, _ in texts[half:]])
    y = np.array([q for _, q in texts[half:]])
    # Values beyond those of nearly all labelled texts say no more than the border does.
    low, high = np.quantile(x, [0.005, 0.995], axis=0)
    high = np.maximum(high, low + 1e-6)
    weights = _logistic((x.clip(low, high) - low) / (high - low), y)
    return Model(dictionaries, tuple(low.tolist()), tuple(high.tolist()), tuple(weights.tolist()), prior)


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents per class outside fold 0, chosen by a hash of their id.

    A document with several labels counts by its lowest, and of rows that share an id the least text. Only labels are read
    whole; of the documents, one row of each chosen id comes to the driver, ``SAMPLE_BYTES`` bytes of it at most.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("label"))
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("label") == q).orderBy(order, "doc_id").limit(sample) for q in (0, 1)]
    chosen = chosen[0].union(chosen[1]).select(F.col("doc_id").alias("known_id"), "label")
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("known_id"))  # 2 * sample rows at most
    rows = rows.select("known_id", F.substring(F.col("text"), 1, SAMPLE_BYTES).alias("text"), "label").where("text <> ''")
    rows = rows.groupBy("known_id", "label").agg(F.min("text").alias("text"))
    return fit([(r["text"], r["label"]) for r in rows.collect()])


def scored(text: Column, model: Model) -> Column:
    """double: the score of a text column."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([score(t, model) for t in texts], dtype="float64")

    return of(text)


def classified(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Only the id and the text are read, so other columns may have any name. A NULL id is in no fold (held_out is
    false); repeated rows get equal scores; an empty table gives no rows. Without labels of both classes every text
    that is not empty has the share of good labels as its score.
    """
    rows = docs.select("doc_id", scored(F.col("text"), model).alias("score"))
    return rows.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text the classifier does not reject, with their columns."""
    return docs.where(scored(docs["text"], model) >= THRESHOLD)
