"""Packing along a space-filling curve (operator 1).

Every document is tokenised once.  Its hashed token counts make a unit vector,
which a fixed random projection takes to three dimensions; the Hilbert key of
that point places the document on a curve on which neighbours have like words.
Documents are range-sorted by (key, row), the running token count along the
curve gives each its place in one endless stream of ids, and the stream is cut
every ``capacity`` ids.  So all sequences but the last are full.

Only (row, key, count) is sorted; the ids are written once beside it, and meet
their places in one shuffle on the row number, which no group of copies and no
hot source can skew.

Edge cases: a null or empty text is its end id alone; null ids are kept, each with its
own pieces; repeated rows and ties on
the curve are ordered by row; long texts span as many sequences as they need; an
empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import written
from ._tokenizer import load_encoder

DIMS, BUCKETS, BITS, SEED = 3, 256, 16, 42


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each integer point (rows; coordinates under 2**bits) on the curve.

    The usual in-place construction: undo the rotations and reflections of each
    level from the top bit down, Gray-decode across coordinates, then read the
    bits of all coordinates level by level.
    """
    x = np.array(points, dtype=np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where((x[n - 1] >> level) & 1, flip ^ ((1 << level) - 1), flip)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each token id, and the projection of the buckets."""
    ids = np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (ids >> np.uint64(56)).astype(np.int64) % BUCKETS, np.random.default_rng(SEED).standard_normal((BUCKETS, DIMS))


def _tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(tokenizer_path)
        size = max(encoder.size, end_id + 1)
        bucket, project = _tables(size)
        width = "<u2" if size <= 1 << 16 else "<u4"
        for b in batches:
            out, at = ([], [], []), []
            for doc_id, text in zip(b.column("_id").to_pylist(), b.column("_text").to_pylist(), strict=True):
                ids = np.append(encoder.ids(text), np.uint32(end_id))
                v = np.log1p(np.bincount(bucket[ids], minlength=BUCKETS))
                at.append(v @ project / np.linalg.norm(v))
                for k, x in enumerate((doc_id, len(ids), ids.astype(width).tobytes())):
                    out[k].append(x)
            p = np.array(at, dtype=np.float32).reshape(-1, DIMS)
            columns = [pa.array(out[0], b.schema.field("_id").type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(p[:, k]) for k in range(DIMS)], ["_id", "n", "ids", *(f"p{k}" for k in range(DIMS))])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"_id {kind}, n long, ids binary, " + ", ".join(f"p{k} float" for k in range(DIMS)))
    return made.withColumn("uid", F.monotonically_increasing_id())


def _keyed(small: DataFrame) -> DataFrame:
    """(uid, n, key): coordinates scaled by the bounds over all documents."""
    low_high = [f for k in range(DIMS) for f in (F.min(f"p{k}"), F.max(f"p{k}"))]
    bounds = [0.0 if v is None else float(v) for v in small.agg(*low_high).first()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grid = []
            for k in range(DIMS):
                low, high = bounds[2 * k], bounds[2 * k + 1]
                x = (b.column(f"p{k}").to_numpy(zero_copy_only=False).astype(np.float64) - low) / (high - low or 1.0)
                grid.append(np.clip(x * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("n"), pa.array(hilbert_key(np.stack(grid, axis=1)))], ["uid", "n", "key"])

    return small.mapInArrow(run, "uid long, n long, key long")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 1,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    ``with_ids``, the piece's ids.  ``end_id`` closes each document."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = written(_tokenised(docs, tokenizer_path, end_id, id_col, text_col), "packing-tokens", "zstd")
    keyed = written(_keyed(tokens.select("uid", "n", *(f"p{k}" for k in range(DIMS)))), "packing-keys")
    curve = keyed.repartitionByRange(parts, "key", "uid").select("uid", "n", "key", F.spark_partition_id().alias("part"))
    curve = written(curve, "packing-curve")

    # One row for each range partition, so as many as there are partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = curve.groupBy("part").agg(F.sum("n").alias("m")).select("part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    along = Window.partitionBy("part").orderBy("key", "uid").rowsBetween(Window.unboundedPreceding, 0)
    places = curve.withColumn("end", F.sum("n").over(along)).join(F.broadcast(ranges), "part")
    places = places.select("uid", (F.col("base") + F.col("end") - F.col("n")).alias("place"))

    kind = tokens.schema["_id"].dataType.simpleString()
    columns = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    width = "<u2" if max(load_encoder(tokenizer_path).size, end_id + 1) <= 1 << 16 else "<u4"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in columns]
            for doc_id, n, raw, place in zip(*(b.column(c).to_pylist() for c in ("_id", "n", "ids", "place")), strict=True):
                ids = np.frombuffer(raw, dtype=width).astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(place + start, capacity)
                    length = min(n - start, capacity - offset)
                    piece = ids[start : start + length]
                    row = (doc_id, start, length, zlib.crc32(piece.tobytes()), n, sequence, offset, piece.astype(np.int32))
                    for k, x in enumerate(row[: len(columns)]):
                        out[k].append(x)
                    start += length
            kinds = [b.schema.field("_id").type, *[pa.int64()] * 6, pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], columns)

    schema = f"_id {kind}, " + ", ".join(f"`{c}` long" for c in columns[1:7]) + ", ids array<int>" * with_ids
    joined = tokens.select("uid", "_id", "n", "ids").join(places.hint("shuffle_hash"), "uid")
    return joined.drop("uid").mapInArrow(cut, schema).withColumnRenamed("_id", id_col)
