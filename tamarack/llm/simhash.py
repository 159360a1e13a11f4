"""SimHash near-dedup by meet-in-the-middle ball hashing (operator 7).

A 64-bit fingerprint has a bit set where more than half of the document's
shingle hashes have it.  Two fingerprints at most r bits apart have a common
variant within r/2 bits of both.  So every distinct fingerprint emits its ball
of radius r/2 (65 variants at r = 2), variants are shuffled, and fingerprints
that meet in a variant are verified and linked.  At r = 2 a variant can meet
65 distinct fingerprints at most, and any two that do are within r bits of each
other, so links between neighbours in sorted order join the same components as
all pairs would.  Copies share a fingerprint and count once here, however many.

Edge cases: null, empty and blank texts have fingerprint zero and are linked
like any other; a text with fewer words than a shingle is one shingle; null ids
are kept and never name a component unless all its ids are null; repeated rows
each give a row; an empty table gives no rows; other columns are not read
(``keep_one`` carries them).  Long texts are hashed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import near_copies
from ._common import written
from ._components import components

BLOCK = 50_000


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint: XXH64 of space-joined word shingles, A-Z lowered."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    total, set_in = max(1, len(words) - shingle + 1), np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, BLOCK):
        part = words[at : at + BLOCK + shingle - 1] if total > 1 else words
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        h = np.fromiter((digest(g, seed) for g in grams), dtype="<u8")
        set_in += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", sketched: bool = False) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long; sketched: and h, key and bands of ``near_copies``."""
    kinds = ", h long, key long, bands array<long>" if sketched else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column("_text").to_pylist()], dtype=np.uint64)
            more = near_copies.sketch(b) if sketched else {}
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(fp.view(np.int64)), *more.values()], ["_id", "fp", *more])

    h = [F.xxhash64(text_col).alias("h")] if sketched else []
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *h)
    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, fp long{kinds}")


def ball_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links (u, v) among distinct fingerprints ``fp`` at most ``radius`` (0 to 2) bits apart."""
    if not 0 <= radius <= 2:
        raise ValueError("radius: 0 to 2; half of a larger one has thousands of variants a fingerprint")
    masks = [0, *(1 << k for k in range(64))] if radius else [0]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    balls = distinct.select("fp", F.explode(F.array(*(F.lit(m).cast("long") for m in signed))).alias("mask"))
    balls = balls.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    if radius == 2:
        before = Window.partitionBy("variant").orderBy("fp")
        met = balls.withColumn("u", F.lag("fp").over(before)).where("u is not null").select("u", F.col("fp").alias("v"))
    else:  # two of a variant may be further apart: look at each pair, 65 * 64 / 2 at most
        other = balls.select(F.col("fp").alias("u"), "variant")
        met = other.join(balls.withColumnRenamed("fp", "v"), "variant").where("u < v").select("u", "v")
    return met.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", least: float | None = None) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) for every row.

    With ``least``, texts whose five-word shingles have at least this Jaccard
    similarity are linked, too (see ``near_copies``)."""
    made = fingerprints(docs, shingle, id_col, text_col, least is not None)
    rows = written(made, "simhash-rows")
    classes = written(rows.groupBy("fp").agg(F.min("_id").alias("low")), "simhash-classes")
    links = ball_links(classes.select("fp"), radius)
    if least is not None:
        named = written(rows.where("key is not null").groupBy("key").agg(F.min("fp").alias("first")), "simhash-keys")
        same = rows.select("fp", "key").distinct().join(named, "key").where("fp != first").select(F.col("first").alias("u"), F.col("fp").alias("v"))
        near = near_copies.links(docs, rows, least, text_col=text_col)
        near = near.join(named.select(F.col("key").alias("u"), F.col("first").alias("a")), "u").join(named.select(F.col("key").alias("v"), F.col("first").alias("b")), "v")
        links = links.union(same).union(near.where("a != b").select("a", "b"))
    found = components(written(links, "simhash-links"))

    joined = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    joined = written(joined, "simhash-joined")
    lowest = written(joined.groupBy("component").agg(F.min("low").alias("component_id")), "simhash-lowest")
    named = written(joined.join(lowest, "component").select("fp", "component_id"), "simhash-named")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, "fp").select(F.col("_id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the smallest id's row.

    Ids are taken to be keys: of rows that share the id, all stay or go together.
    Rows with a null id stay only if no id of their component is set.
    """
    id_col = options.get("id_col", "doc_id")
    found = near_duplicates(docs, **options).select(F.col(id_col).alias("_k"), F.col("component_id").alias("_c")).distinct()
    stay = written(found.where(F.col("_k").eqNullSafe(F.col("_c"))).select("_k"), "simhash-stay")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("_i"))
    return rows.join(stay.hint("shuffle_hash"), F.col("_i").eqNullSafe(F.col("_k")), "left_semi").select("row.*")
