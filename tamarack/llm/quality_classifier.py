"""Quality classifier (operator 6): naive Bayes support vectors.

Features are indicators of hashed n-grams: byte 4-grams, 4-grams of character
kinds (upper, lower, digit, letter beyond ASCII, white space, each other mark by
itself), and steps of the share of words that repeat the word before, so that
form and repetition count beside wording.  Each indicator is scaled by its class
log-count ratio, and a linear hinge-loss model is fitted by dual coordinate
descent.  A logistic curve over margins of a held-back fifth of the sample turns
margins into probabilities.

Training runs on the driver over a bounded sample: ``per_class`` rows a label.
Prediction folds ratios and weights into one number a bucket.

Edge cases: null and empty texts have no features and get the score of the bias;
labels other than 0 and 1 and null labels are not learned; without both labels,
as in an empty table, every score is the share of label 1 (0.5 without rows);
null ids (``held_out`` is null for them in the query) and repeated rows are kept; of
equal scores each is judged alike; columns other than id, text and, for training, the
label are not read; long texts are read whole, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._sample import sample_by_class

BUCKETS, BLOCK, STEPS = 1 << 17, 1 << 20, 8


def _kinds() -> np.ndarray:
    kind = np.arange(256, dtype=np.uint32)
    kind[ord("A") : ord("Z") + 1], kind[ord("a") : ord("z") + 1] = ord("A"), ord("a")
    kind[ord("0") : ord("9") + 1], kind[128:] = ord("0"), ord("a")
    kind[[9, 11, 12, 13]] = 32
    return kind


_KIND = _kinds()


def _hashed(b: np.ndarray, salt: int) -> Iterator[np.ndarray]:
    for at in range(0, max(0, len(b) - 3), BLOCK):
        part = b[at : at + BLOCK + 3].astype(np.uint32)
        h = part[:-3] + np.uint32(salt)
        for k in (1, 2, 3):
            h = h * np.uint32(0x01000193) + part[k : len(part) - 3 + k]
        yield (h * np.uint32(0x9E3779B1)) >> np.uint32(15)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the text's n-grams."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    raw = text.encode()
    b = np.frombuffer(raw, dtype=np.uint8)
    seen = np.zeros(BUCKETS, dtype=bool)
    for idx in _hashed(b, 1):
        seen[idx] = True
    for idx in _hashed(_KIND[b], 2):
        seen[idx] = True
    words = raw.lower().split()
    if len(words) > 1:
        same = sum(map(eq, words, words[1:])) / (len(words) - 1)
        seen[: 1 + int(same * (STEPS - 1))] = True
    return np.flatnonzero(seen)


@dataclass
class QualityModel:
    weights: np.ndarray  # one a bucket
    bias: float
    slope: float
    offset: float

    def score(self, text: str | None) -> float:
        idx = features(text)
        margin = float(self.weights[idx].sum()) / max(len(idx), 1) ** 0.5 + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -35, 35))))


def _dual_descent(x: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Hinge loss, L2, one constant feature; each row scaled to its length."""
    rng, alpha, w, bias = np.random.default_rng(seed), np.zeros(len(x)), np.zeros(BUCKETS), 0.0
    values = [ratio[i] / max(len(i), 1) ** 0.5 for i in x]
    square = np.array([v @ v + 1.0 for v in values])
    for _ in range(epochs):
        moved = 0.0
        for k in rng.permutation(len(x)):
            slack = y[k] * (w[x[k]] @ values[k] + bias) - 1
            new = min(max(alpha[k] - slack / square[k], 0.0), c)
            if step := new - alpha[k]:
                w[x[k]] += step * y[k] * values[k]
                bias += step * y[k]
                alpha[k] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def _logistic(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Newton steps for P(good) = 1 / (1 + exp(-(slope * margin + offset)))."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, at = np.stack([margin, np.ones_like(margin)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -35, 35)))
        hess = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - target) + 1e-3 * (at - [1.0, 0.0]))
        at = at - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(at[0], 1e-3)), float(at[1])


def fit(texts: list[str | None], labels: list[int], c: float = 1.0, epochs: int = 30, seed: int = 1) -> QualityModel:
    """Train on the driver.  Deterministic: rows are sorted and the seed is fixed."""
    rows = sorted((y, t or "") for t, y in zip(texts, labels, strict=True) if y in (0, 1))
    y = np.array([1.0 if r[0] else -1.0 for r in rows])
    if len({*y}) < 2:
        share = (float((y > 0).mean()) if len(y) else 0.5) * 0.98 + 0.01
        return QualityModel(np.zeros(BUCKETS), 0.0, 1.0, float(np.log(share / (1 - share))))
    x = [features(t) for _, t in rows]
    held = np.arange(len(x)) % 5 == 4
    learn = np.flatnonzero(~held)
    count = {s: np.bincount(np.concatenate([x[k] for k in learn if y[k] == s] or [np.zeros(0, np.int64)]), minlength=BUCKETS) + 1.0 for s in (1.0, -1.0)}
    ratio = np.log((count[1.0] / count[1.0].sum()) / (count[-1.0] / count[-1.0].sum()))
    w, bias = _dual_descent([x[k] for k in learn], y[learn], ratio, c, epochs, seed)
    folded = w * ratio
    check = np.flatnonzero(held) if len({*y[held]}) == 2 else np.arange(len(x))
    margin = np.array([folded[x[k]].sum() / max(len(x[k]), 1) ** 0.5 + bias for k in check])
    slope, offset = _logistic(margin, y[check] > 0)
    return QualityModel(folded, bias, slope, offset)


def train(
    docs: DataFrame, labels: DataFrame, per_class: int = 1500, max_chars: int = 200_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> QualityModel:
    """``fit`` over the texts of at most ``per_class`` rows of ``labels`` a class, of which
    at most ``max_chars`` characters are learned.  Scoring reads whole texts."""
    known = labels.select(F.col(id_col).alias("_i"), F.col(label_col).alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_i").isNotNull())
    # 2 * per_class rows of two numbers at most, whatever the input's size.
    chosen = F.broadcast(sample_by_class(known, "_i", "_y", per_class))
    texts = docs.select(F.col(id_col).alias("_id"), F.left(text_col, F.lit(max_chars)).alias("_t")).join(chosen, F.col("_id") == F.col("_i"))
    # Rows of one id are as many texts: the limit holds for what they join to as well.
    got = sample_by_class(texts.select("_id", "_t", "_y"), "_id", "_y", per_class).select("_t", "_y").collect()
    return fit([r._t for r in got], [r._y for r in got])


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for every row; only id and text are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.array([model.score(t) for t in b.column("_text").to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    made = rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, score double, predicted int")
    return made.withColumnRenamed("_id", id_col)
