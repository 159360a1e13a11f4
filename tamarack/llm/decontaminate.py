"""Benchmark decontamination by prefix-filtered set join (operator 2), in
DataFrame functions only.

A benchmark item gives its windows of ``size`` consecutive words (fewer words:
one window).  A document is hit by a window only if it contains all of it, so
one token is a sufficient prefix: the window's rarest word, by its count over
all documents.  Each document word is joined to the windows whose prefix it is;
the prefix's place in the window fixes where the window would start, which must
lie in the document with its whole length (positional and length bounds); then
the words are compared.  Documents are read twice: for the counts, and for the
join, which emits verified windows and one row for each document.

Small benchmarks are broadcast, in blocks of at most ``block`` windows and
``block_bytes`` bytes, one pass over the documents for each block.  A benchmark of
more than ``passes`` blocks is joined by shuffle instead: documents send each word
that may be a prefix with the words around it, as many as a window can reach, and
adaptive execution splits words that many documents have.  Either way a passage that
many documents share costs its occurrences, and the rows of one document are as many
as its hits.

A row is known by two 64-bit hashes of its carried columns and its text, so hits
find their row again however often and in whatever order the input is computed, by
another block or by a task that runs again.  Equal rows share the work and are
counted, and come out as many times as they went in.

Edge cases: null and empty texts have no words; very long texts are read whole;
items without words have no windows; an item with a null id counts as the id "null";
repeated items and repeated windows count once; repeated rows each give a row; null
ids are kept; empty tables give no rows, or no hits; other columns are carried in
one struct, so their names cannot clash (columns of a map type cannot be hashed:
carry them as JSON).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, written

#: Words of the lower-cased text, as they are before it is lower-cased.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def raw_words(text: Column) -> Column:
    """Words with their capitals; lower-casing the few that are needed is far
    cheaper than lower-casing whole texts."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lowered(s: Column) -> Column:
    """A-Z lowered; ``lower`` does just that to a string of ASCII alone."""
    return F.when(F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(ascii_lower(s))


def _windows(benchmark: DataFrame, size: int, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(window, words) of each distinct window, and (window, item)."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), raw_words(lowered(F.col(text_col))).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))))
    cut = items.select("item", F.slice("w", F.col("at"), size).alias("words"))
    cut = written(cut.select("item", F.sha1(F.array_join("words", " ")).alias("window"), "words"), "bench-windows")
    return cut.select("window", "words").dropDuplicates(["window"]), cut.select("window", "item").distinct()


def _number_of_blocks(df: DataFrame, text: Column, rows: int, size: int) -> int:
    """Blocks of at most ``rows`` rows and about ``size`` bytes of ``text``."""
    n, total = df.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    return max(1, -(-n // rows), -(-(total or 0) // size))


def _block(df: DataFrame, key: str, k: int, n: int) -> DataFrame:
    return df.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) if n > 1 else df


def _all(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.union, parts)


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    block: int = 100_000,
    block_bytes: int = 32 << 20,
    passes: int = 4,
    carry: list[str] | None = None,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``row`` (a struct of the ``carry`` columns; None: all) of each row, _n_words, _spans (start,
    length of each window found, in words), _n_hit, _items (sorted ids)."""
    carry = docs.columns if carry is None else carry
    windows, window_items = _windows(benchmark, size, item_col, item_text_col)
    windows = written(windows, "bench-distinct")
    vocabulary = written(windows.select(F.explode("words").alias("word")).distinct(), "bench-words")

    words = raw_words(F.col(text_col))
    n = _number_of_blocks(vocabulary, F.col("word"), block, block_bytes)
    found = docs.select(F.explode(words).alias("word")).select(lowered(F.col("word")).alias("word"))
    if n <= passes:
        count = _all([found.join(F.broadcast(_block(vocabulary, "word", k, n)), "word", "left_semi").groupBy("word").count() for k in range(n)])
    else:  # counted where they are read, then cut down to the vocabulary
        count = found.groupBy("word").count().join(vocabulary, "word", "left_semi")
    count = written(count.withColumnRenamed("count", "times"), "bench-counts")

    placed = windows.select("window", "words", F.posexplode("words").alias("off", "word")).join(count, "word", "left")
    rarest = F.struct(F.coalesce("times", F.lit(0)).alias("times"), "word", "off")
    keyed = placed.groupBy("window").agg(F.min(rarest).alias("p"), F.first("words").alias("words"))
    keyed = keyed.select("window", F.array_join("words", " ").alias("wtext"), F.col("p.word").alias("key"), F.col("p.off").alias("off"), F.size("words").alias("len"), F.lit(True).alias("there"))
    keyed = written(keyed, "bench-prefixes")

    key = [*(docs[f"`{c}`"] for c in carry), F.col(text_col)]
    uid = F.struct(F.xxhash64(F.lit(1), *key).alias("a"), F.xxhash64(F.lit(2), *key).alias("b"))
    base = docs.select(uid.alias("uid"), F.struct(*carry).alias("row"), words.alias("w")).withColumn("n", F.size("w"))
    start = F.col("pos") - F.col("off")
    inside = (start >= 0) & (start + F.col("len") <= F.col("n"))
    hit = F.col("there").isNotNull()
    span = F.when(hit, F.struct(start.alias("s"), F.col("len").alias("n"))).alias("span")
    n = _number_of_blocks(keyed, F.col("wtext"), block, block_bytes)
    if n <= passes:
        each = base.select("uid", "row", "w", "n", F.posexplode_outer("w").alias("pos", "word")).withColumn("word", lowered(F.col("word")))
        same = lowered(F.array_join(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("len")), " ")) == F.col("wtext")
        parts = []
        for k in range(n):
            met = each.join(F.broadcast(_block(keyed, "window", k, n)), (F.col("word") == F.col("key")) & inside & same, "left")
            # One row for each document comes along, in the first block.
            first = (F.coalesce("pos", F.lit(0)) == 0) if k == 0 else F.lit(False)
            parts.append(met.where(hit | first).select("uid", "n", F.when(first, F.col("row")).alias("row"), span, "window"))
        passed = _all(parts)
    else:
        low = F.greatest(F.col("pos") - (size - 1), F.lit(0))
        around = base.select("uid", "w", "n", F.posexplode("w").alias("pos", "word")).withColumn("word", lowered(F.col("word")))
        around = around.select("uid", "n", "pos", "word", low.alias("low"), F.slice("w", low + 1, 2 * size - 1).alias("near"))
        same = lowered(F.array_join(F.slice("near", F.greatest(start - F.col("low"), F.lit(0)) + 1, F.col("len")), " ")) == F.col("wtext")
        met = around.join(keyed.hint("merge"), (F.col("word") == F.col("key")) & inside & same)
        none = base.select("uid", "n", "row", F.lit(None).cast("struct<s:int,n:int>").alias("span"), F.lit(None).cast("string").alias("window"))
        passed = none.union(met.select("uid", "n", F.lit(None).cast(docs.select(F.struct(*carry)).schema[0].dataType).alias("row"), span, "window"))
    # The one row that is set, by collect_set: first() would copy it at each of the document's hits.
    # A copy's row comes once for each window found at its first word, and once without any.
    at_first = F.greatest(F.size(F.collect_set(F.when(F.col("row").isNotNull(), F.col("window")))), F.lit(1))
    hits = passed.groupBy("uid").agg(
        F.max("n").alias("_n_words"),
        F.get(F.collect_set("row"), F.lit(0)).alias("row"),
        F.collect_set("span").alias("_spans"),
        F.collect_set("window").alias("wins"),
        (F.count("row") / at_first).cast("int").alias("copies"),
    )
    hits = written(hits.withColumn("_spans", F.array_sort("_spans")), "bench-hits", "zstd")

    named = hits.select("uid", F.explode("wins").alias("window")).join(window_items, "window")
    named = written(named.groupBy("uid").agg(F.array_sort(F.collect_set("item")).alias("found")), "bench-items")
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    stop = lambda x: x["s"] + x["n"]
    step = lambda a, x: F.struct(F.greatest(a["end"], stop(x)).alias("end"), (a["n"] + F.greatest(F.lit(0), stop(x) - F.greatest(a["end"], x["s"]))).alias("n"))
    n_hit = F.aggregate("_spans", begin, step, lambda a: a["n"])
    out = hits.join(named.hint("shuffle_hash"), "uid", "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select("row", F.col("_n_words").cast("long").alias("_n_words"), "_spans", n_hit.cast("long").alias("_n_hit"), F.coalesce("found", F.array().cast("array<string>")).alias("_items"))
