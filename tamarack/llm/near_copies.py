"""Near copies by five-word shingles: Jaccard similarity of at least ``least``.

Words are those of the fingerprint (ASCII white space, A-Z lowered); a text with
fewer words than a shingle is one shingle, a blank one has none and no near copy.
Rows whose texts have the same set of shingles are one node.  Candidates come from
MinHash: ``BANDS`` bands of ``ROWS`` minima each, so a pair at 0.8 shares no band
with a probability of 0.00015, one at 0.85 with 0.0000002.  Texts that a band links,
directly or over others, form a group; every pair inside a group is compared by its
exact sets of 64-bit shingle hashes.  Groups are cut into blocks of ``CHUNK`` texts
and every two blocks meet in a task of their own, so no size of group is left out
and none has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import written
from ._components import components

BANDS, ROWS, CHUNK, _PIECE = 48, 8, 250, 512
_RNG = np.random.default_rng(5)
_XOR, _ODD = _RNG.integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
_ODD |= np.uint64(1)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 5) for g in grams), dtype=np.uint64))


def bands(shingles: np.ndarray) -> list[int]:
    """A signed hash for each band of minima."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), _PIECE):
        np.minimum(low, ((shingles[at : at + _PIECE, None] ^ _XOR) * _ODD).min(axis=0), out=low)
    each = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(low.reshape(BANDS, ROWS))]
    return np.array(each, dtype=np.uint64).view(np.int64).tolist()


def sketch(batch: pa.RecordBatch, shingle: int = 5) -> dict[str, pa.Array]:
    """h, key and bands of each ``_text``: hash of the text, of its set (null: no words) and of each band."""
    keys, made = [], []
    for text in batch.column("_text").to_pylist():
        s = shingle_set(text, shingle)
        keys.append(int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else None)
        made.append(bands(s) if len(s) else [])
    return {"h": batch.column("h"), "key": pa.array(keys, pa.int64()), "bands": pa.array(made, pa.list_(pa.int64()))}


def similar(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs of numbers that join the same sets as all pairs at ``least`` or more would."""
    size = np.array([len(s) for s in sets])
    flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    _, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
    start, holders, at = np.cumsum(times) - times, who[order], np.cumsum(size) - size
    root, found = list(range(len(sets))), []

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for a in range(len(sets)):
        ids = inverse[at[a] : at[a] + size[a]]
        ids = ids[times[ids] > 1]
        n = times[ids]
        near = holders[np.repeat(start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        common = np.bincount(near, minlength=len(sets))
        for b in np.flatnonzero(common >= least * (size + size[a] - common) - 1e-9):
            if b > a and top(a) != top(int(b)):
                root[top(a)] = top(int(b))
                found.append((a, int(b)))
    return found


def links(docs: DataFrame, sketched: DataFrame, least: float = 0.8, shingle: int = 5, text_col: str = "text") -> DataFrame:
    """(u, v): keys of ``sketched`` whose sets are near copies, enough to join all that are."""
    classes = sketched.where("key is not null").groupBy("key").agg(F.min("h").alias("h"), F.first("bands").alias("bands"))
    before = Window.partitionBy("band").orderBy("key")
    met = classes.select("key", F.explode("bands").alias("band")).withColumn("u", F.lag("key").over(before))
    grouped = components(written(met.where("u is not null").select("u", F.col("key").alias("v")).distinct(), "copies-met"))

    # Blocks of each group, and the pairs of blocks that a text takes part in.
    number = F.row_number().over(Window.partitionBy("component").orderBy("node")) - 1
    placed = written(grouped.distinct().select(F.col("node").alias("key"), "component", F.floor(number / CHUNK).cast("int").alias("x")), "copies-placed")
    count = placed.groupBy(F.col("component").alias("c")).agg((F.max("x") + 1).alias("blocks"))
    placed = placed.join(count, F.col("component") == F.col("c")).drop("component")
    one_text = sketched.where("key is not null").groupBy("key").agg(F.min("h").alias("h"))
    placed = written(placed.join(one_text, "key"), "copies-blocks")
    texts = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("_text")).join(placed.select("h"), "h", "left_semi")
    texts = texts.groupBy("h").agg(F.first("_text").alias("_text")).join(placed, "h")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: y != F.col("x"))))
    texts = texts.select("key", "_text", "c", "x", other.alias("y"))
    texts = texts.select("key", "_text", "c", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))

    def verify(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_numpy()
        sets = [shingle_set(t, shingle) for t in group.column("_text").to_pylist()]
        found = np.array(similar(sets, least), dtype=np.int64).reshape(-1, 2)
        return pa.table({"u": keys[found[:, 0]], "v": keys[found[:, 1]]})

    return written(texts.groupBy("c", "i", "j").applyInArrow(verify, "u long, v long"), "copies-links")
