"""Quality classifier by compression: zstandard dictionaries from good and from bad texts.

A text is cut into pieces and every piece is compressed twice, once with a dictionary of
good labelled text and once with one of bad. With ``g`` and ``b`` the summed sizes, the
feature is ``(b - g) / (b + g)``: positive if good text explains it better. A logistic
curve fitted on labelled rows that the dictionaries have not seen makes it a score.

The fit uses a bounded sample of labelled rows: ``DICTIONARY_ROWS`` rows and
``DICTIONARY_PIECES`` pieces of ``PIECE`` bytes per class for the dictionaries, and
``CURVE_ROWS`` rows per class for the curve, chosen by hash. Scoring is row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 512
DICTIONARY_BYTES = 65_536
DICTIONARY_ROWS = 5_000
DICTIONARY_PIECES = 20_000
CURVE_ROWS = 5_000
LEVEL = 3
THRESHOLD = 0.3  # of the score, for label 1


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def pieces(text: str | None) -> Iterator[bytes]:
    data = (text or "").encode("utf-8", "replace")
    return (data[i : i + PIECE] for i in range(0, len(data), PIECE))


def trained(samples: list[bytes]) -> bytes:
    """A dictionary, or the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


@dataclass
class Dictionaries:
    bad: bytes
    good: bytes

    def features(self, texts: pd.Series) -> np.ndarray:
        packers = []
        for data in (self.bad, self.good):
            own = None
            if data:
                own = zstandard.ZstdCompressionDict(data)
                own.precompute_compress(level=LEVEL)
            packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own))
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            b = g = 0
            for piece in pieces(text):
                b += len(packers[0].compress(piece))
                g += len(packers[1].compress(piece))
            out[i] = (b - g) / (b + g) if b + g else 0.0
        return out


@dataclass
class Model:
    dictionaries: Dictionaries
    slope: float
    intercept: float


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a little ridge. With one class only, or
    none, the slope is 0 and the score is the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return 0.0, float(np.log(share / (1 - share)))
    scale = x.std() or 1.0
    design = np.column_stack([x / scale, np.ones(len(x))])
    ridge, w = np.diag([0.1, 1e-6]), np.array([0.0, np.log(share / (1 - share))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + ridge @ w
        step = np.linalg.solve((design.T * (p * (1 - p) + 1e-9)) @ design + ridge, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from documents (``doc_id``, ``text``) labelled in ``labels`` (``doc_id``,
    ``quality``), apart from those ``held_out``. Labels other than 0 and 1 are ignored."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    for_curve = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 4
    texts = docs.select("doc_id", "text")

    def some(rows: DataFrame, n: int) -> DataFrame:
        """At most ``n`` labelled rows of each class, with their texts."""
        order = [F.xxhash64("doc_id"), "doc_id"]
        ids = rows.where("quality = 0").orderBy(*order).limit(n).union(rows.where("quality = 1").orderBy(*order).limit(n))
        return texts.join(F.broadcast(ids), "doc_id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(q, p) for q, t in zip(batch.quality, batch.text, strict=True) for p in pieces(t)]
            yield pd.DataFrame(rows, columns=["quality", "piece"])

    samples = some(known.where(~for_curve), DICTIONARY_ROWS).select("quality", "text").mapInPandas(cut, "quality int, piece binary")
    dictionaries = {}
    for quality in (0, 1):
        own = samples.where(F.col("quality") == quality).orderBy(F.xxhash64("piece"), "piece").limit(DICTIONARY_PIECES)
        dictionaries[quality] = trained([bytes(p) for p in own.toPandas().piece])
    both = Dictionaries(dictionaries[0], dictionaries[1])
    held = docs.sparkSession.sparkContext.broadcast(both)
    feature = F.pandas_udf(lambda texts: pd.Series(held.value.features(texts)), "double")
    curve = some(known.where(for_curve), CURVE_ROWS).select("quality", feature("text").alias("x")).toPandas().sort_values(["x", "quality"])
    slope, intercept = logistic(curve.x.to_numpy(float), curve.quality.to_numpy(float))
    return Model(both, slope, intercept)


def score(docs: DataFrame, model: Model) -> Column:
    """Score of the text column ``text``, from 0 to 1, higher where label 1 is likelier.

    Null and empty texts have the feature 0 and get the curve's value there. Repeated rows
    get equal scores; nothing but the text enters. Without labels every score is a half.
    """
    held = docs.sparkSession.sparkContext.broadcast(model.dictionaries)
    feature = F.pandas_udf(lambda texts: pd.Series(held.value.features(texts)), "double")
    return 1 / (1 + F.exp(-(F.lit(model.slope) * feature("text") + F.lit(model.intercept))))
