"""Language identification (operator 4): averaged hashed subword embeddings with
a linear softmax, trained by stochastic gradient descent in numpy.

Subwords are the UTF-8 byte n-grams (3 and 4 bytes) of the lower-cased text,
hashed to ``BUCKETS`` rows of an embedding table.  A text's vector is the mean of
its rows.  Training runs on the driver over a bounded sample (``per_language``
texts a language, and short excerpts of them, so that short texts are learned,
too); a fifth of the sample calibrates: a temperature makes the probabilities
honest, and texts whose probability is under the lowest threshold with
``precision`` on accepted texts are marked as not accepted.

For prediction embeddings and softmax fold into one score a bucket and language,
so a text costs one gather.

Edge cases: a null text or one without a letter is ``und`` with score 0; a text
too short for an n-gram gets the bias alone; null ids and repeated rows are kept,
each with its row (a null id is never held out by the query's rule: ``held_out`` is
null); of equal probabilities the language first in sorted order is taken; columns
other than id, text and, for training, the label are not read; without labelled rows, as in an empty table, all is ``und``;
long texts are read whole, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._sample import sample_by_class

BUCKETS, WIDTH, GRAMS, BLOCK = 1 << 16, 16, (3, 4), 1 << 20
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def subwords(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the text's byte n-grams, block by block."""
    b = np.frombuffer(f" {text.lower()} ".encode(), dtype=np.uint8)
    for n in GRAMS:
        for at in range(0, max(0, len(b) - n + 1), BLOCK):
            part = b[at : at + BLOCK + n - 1].astype(np.uint32)
            h = part[: len(part) - n + 1] + np.uint32(n)
            for k in range(1, n):
                h = h * np.uint32(0x01000193) + part[k : len(part) - n + 1 + k]
            yield (h * np.uint32(0x9E3779B1)) >> np.uint32(16)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # a row for each bucket, a column for each language
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for idx in subwords(text):
            total += self.scores.take(idx, axis=0).sum(axis=0, dtype=np.float64)
            n += len(idx)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0, False
        p = _softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] >= self.threshold)


def fit(texts: list[str], labels: list[str], epochs: int = 6, rate: float = 0.5, precision: float = 0.98, seed: int = 1) -> LanguageModel:
    """Train on the driver.  Deterministic: rows are sorted and the seed is fixed."""
    rows = sorted((y, t) for t, y in zip(texts, labels, strict=True) if t and _LETTER.search(t))
    languages = sorted({y for y, _ in rows})
    if not languages:
        return LanguageModel([], np.zeros((1, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    data: list[tuple[int, np.ndarray, np.ndarray, bool]] = []
    for k, (y, t) in enumerate(rows):
        excerpts = [t]
        for length in (20, 60, 200):
            at = int(rng.integers(0, max(1, len(t) - length)))
            excerpts.append(t[at : at + length])
        for e in excerpts:
            found = [*subwords(e)]
            idx, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0))
            if len(idx):
                data.append((languages.index(y), idx, (n / n.sum()).astype(np.float32), k % 5 == 4))
    embed = (rng.random((BUCKETS, WIDTH), dtype=np.float32) - 0.5) / WIDTH
    soft, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    learn = [d for d in data if not d[3]] or data
    steps, step = epochs * len(learn), 0
    for _ in range(epochs):
        for k in rng.permutation(len(learn)):
            y, idx, share, _ = learn[k]
            x = share @ embed[idx]
            g = _softmax(x @ soft + bias)
            g[y] -= 1
            eta = rate * (1 - step / steps)
            back = soft @ g
            soft -= eta * np.outer(x, g)
            bias -= 0.1 * eta * g
            embed[idx] -= (eta * len(idx) ** 0.5) * np.outer(share, back)
            step += 1
    scores = embed @ soft
    held = [d for d in data if d[3]] or data
    z = np.stack([share @ scores[idx] for _, idx, share, _ in held]) + bias
    y = np.array([d[0] for d in held])
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.02, 10, 60), key=loss))
    p = _softmax(z / temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-top)
    good = np.flatnonzero(np.cumsum(right[order]) >= precision * np.arange(1, len(y) + 1))
    threshold = float(top[order][good[-1]]) if len(good) else 1.0
    return LanguageModel(languages, scores.astype(np.float32), bias.astype(np.float64), temperature, threshold)


def train(
    labelled: DataFrame, per_language: int = 400, max_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> LanguageModel:
    """``fit`` over a sample of ``labelled``: at most ``per_language`` texts a language,
    of which at most ``max_chars`` characters are learned.  Prediction reads whole texts."""
    rows = labelled.select(F.col(id_col).alias("i"), F.left(text_col, F.lit(max_chars)).alias("t"), F.col(lang_col).alias("y"))
    got = sample_by_class(rows, "i", "y", per_language).select("t", "y").collect()
    return fit([r.t for r in got], [r.y for r in got])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted) for every row; only id and text are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.predict(t) for t in b.column("_text").to_pylist()]
            lang, score, accepted = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], ["_id", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    made = rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, lang_pred string, score double, accepted boolean")
    return made.withColumnRenamed("_id", id_col)
