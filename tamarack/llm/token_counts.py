"""Token counts through a digest cache (operator 9).

Content digests are joined to stored counts of the same tokenizer version; only
distinct misses are encoded, each once however many rows have it, and their counts
are appended to the cache.

Edge cases: null and empty texts have 0 tokens; a null id is kept; repeated rows
each give a row; an empty table gives an empty result; other columns of the
input are not read.  Very long texts are encoded whole, one text at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._ledger import through_ledger
from ._tokenizer import load_encoder


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file: another file is another version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``."""

    def encode(chosen: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = load_encoder(tokenizer_path)
            for b in batches:
                n = [encoder.count(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

        return chosen.mapInArrow(run, "digest binary, n_tokens long")

    version = tokenizer_version(tokenizer_path)
    payload = [T.StructField("n_tokens", T.LongType())]
    rows, entries = through_ledger(docs, cache_path, version, encode, payload, id_col, text_col)
    return rows.join(entries, "digest").select(
        F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
