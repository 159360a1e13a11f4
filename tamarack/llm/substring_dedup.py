"""Substring dedup over sliding sentence spans (operator 3).

A text is cut into sentences (ends: ``. ! ?`` before white space, and line
breaks); a sentence of more than ``long_words`` words counts as several, so a
passage with few full stops has several, too.  It is cut after words whose hash
is the least of those near them, so a passage is cut alike wherever it stands, and
``long_words`` words after a cut if no such word comes before.
A run of sentences is long enough with ``run`` sentences and ``min_words`` words, or
with ``several`` sentences and ``few_words`` words.  From each sentence starts one
span, and at each ends one: the shortest run that is long enough.  That does what
hashing every run would: each sentence of a repeated run that is long enough lies in
a span inside the run (in the one that starts with it or, if that would reach beyond
the run, in the one that ends where the run does).  A span's digest (128 bits of the
lower-cased words) joins the same span in all documents.  Its first occurrence is the
one with the smallest (id, text hash, position); sentences that any other occurrence
covers are removed.

Spans of one digest are pre-aggregated before the shuffle, and the join back is
one that adaptive execution can split, so a passage that a third of all rows
share does not meet in one task.

Texts are cut once: where the sentences are travels beside the spans.

Edge cases: null texts stay null; empty and blank texts are as they were;
repeated rows (one id, one text) are one place and stay alike; null ids come last;
a text shorter than a span has none; very long texts are cut whole, with spans that
grow with their sentences; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written

_ENDS = re.compile(r"\n+|(?<=[.!?])[^\S\n]+")
_WORD = re.compile(r"\S+")
#: Words on each side that a cut inside a long sentence depends on (one more before).
_NEAR = 4


def _cuts(words: list[str], long_words: int) -> list[int]:
    """Where the pieces of a long sentence start, and the number of its words."""
    n = len(words)
    low = " ".join(words).lower().encode().split(b" ")
    pairs = [b" " + low[0], *map(b"%b %b".__mod__, zip(low, low[1:]))]
    h = np.fromiter(map(zlib.crc32, pairs), dtype=np.int64, count=n)
    least: list[int] = []
    if n > 2 * _NEAR:
        around = np.minimum.reduce([h[_NEAR + k : n - _NEAR + k] for k in range(-_NEAR, _NEAR + 1) if k])
        least = (np.flatnonzero(h[_NEAR : n - _NEAR] < around) + _NEAR + 1).tolist()
    found = [0]
    for stop in [*least, n]:
        found += range(found[-1] + long_words, stop, long_words)
        found.append(stop)
    return found


def sentences(text: str | None, long_words: int) -> list[tuple[int, int]]:
    """(start, end) in ``text`` of each sentence, white space around it left out."""
    if not text:
        return []
    found, at = [], 0
    ends = [(m.start(), m.end()) for m in _ENDS.finditer(text)] + [(len(text), len(text))]
    for stop, after in ends:
        piece = text[at:stop]
        if stop - at <= 2 * long_words or len(piece.split()) <= long_words:
            if body := piece.strip():
                lead = at + len(piece) - len(piece.lstrip())
                found.append((lead, lead + len(body)))
        else:
            words = [m.span() for m in _WORD.finditer(text, at, stop)]
            at_word = _cuts(piece.split(), long_words)
            found += [(words[a][0], words[b - 1][1]) for a, b in zip(at_word, at_word[1:])]
        at = after
    return found


def spans(
    text: str | None, run: int, min_words: int, long_words: int, several: int = 0, few_words: int = 0
) -> tuple[list[tuple[int, int]], list[tuple[int, int, bytes]]]:
    """Sentences, and (first sentence, sentences, digest) of each span; ``several`` 0: no runs of the second kind."""
    cut = sentences(text, long_words)
    flat = [" ".join(text[a:b].lower().split()) for a, b in cut]
    n = len(cut)
    upto = [0]
    for f in flat:
        upto.append(upto[-1] + f.count(" ") + 1)

    # The end of the shortest run from each sentence: of either kind, whichever is sooner.
    ends, one, two = [], 0, 0
    for k in range(n):
        one, wanted = max(one, k + run), upto[k] + min_words
        while one <= n and upto[one] < wanted:
            one += 1
        end = one
        if several:
            two, wanted = max(two, k + several), upto[k] + few_words
            while two <= n and upto[two] < wanted:
                two += 1
            end = min(one, two)
        if end > n:
            break
        ends.append(end)
    places = list(enumerate(ends))
    # Runs from k end at ends[k], which never falls: so the shortest run that ends at ``end``
    # starts with the last k whose own end is not beyond it.  Where that is its own end, the
    # run is there already.
    if ends:
        k = 0
        for end in range(ends[0], n + 1):
            while k + 1 < len(ends) and ends[k + 1] <= end:
                k += 1
            if ends[k] < end:
                places.append((k, end))
    return cut, [(a, b - a, hashlib.blake2b(" ".join(flat[a:b]).encode(), digest_size=16).digest()) for a, b in places]


def remove_repeats(
    docs: DataFrame,
    run: int = 2,
    min_words: int = 25,
    long_words: int = 20,
    several: int = 3,
    few_words: int = 12,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, text, n_sentences, n_removed, removed): ``text`` without removed
    sentences, ``removed`` their character spans in the old text, as start:end."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text, key in zip(*(b.column(c).to_pylist() for c in ("_id", "_text", "_key")), strict=True):
                cut, found = spans(text, run, min_words, long_words, several, few_words)
                # Without a span: where the text's sentences start and end.
                places = np.array(cut, dtype="<i4").tobytes()
                first, n, digest = zip((0, 0, places), *found)
                for column, x in zip(out, ([doc_id] * len(n), [key] * len(n), first, n, digest), strict=True):
                    column.extend(x)
                if len(out[0]) >= 50_000:
                    yield batch(out, b.schema.field("_id").type)
                    out = [[], [], [], [], []]
            yield batch(out, b.schema.field("_id").type)

    def batch(out: list[list], id_type: pa.DataType) -> pa.RecordBatch:
        kinds = [id_type, pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["_id", "_key", "first", "n", "digest"])

    # The content key tells rows of one id apart that have different texts.
    keyed = rows.withColumn("_key", F.xxhash64("_text"))
    made = written(keyed.mapInArrow(cut, f"_id {kind}, _key long, first int, n int, digest binary"), "spans")
    place = F.struct(F.col("_id").isNull().alias("x"), F.col("_id").alias("a"), F.col("_key").alias("b"), F.col("first").alias("c"))
    is_span = F.col("n") > 0
    found = made.where(is_span)
    repeated = found.groupBy("digest").agg(F.count("*").alias("times"), F.min(place).alias("p")).where("times > 1")
    repeated = written(repeated.select("digest", F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.col("p.c").alias("c")), "spans-repeated")
    same = F.col("_id").eqNullSafe(F.col("a")) & (F.col("_key") == F.col("b")) & (F.col("first") == F.col("c"))
    later = written(found.join(repeated, "digest").where(~same).select("_id", "_key", "first", "n"), "spans-later")
    every = later.withColumn("digest", F.lit(None).cast("binary")).union(made.where(~is_span).select("_id", "_key", "first", "n", "digest"))
    gone = every.groupBy(F.col("_id").alias("_gid"), F.col("_key").alias("_gkey")).agg(
        F.max("digest").alias("cut"), F.collect_set(F.when(is_span, F.struct("first", "n"))).alias("spans")
    )

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text, places, found in zip(*(b.column(c).to_pylist() for c in ("_id", "_text", "cut", "spans")), strict=True):
                row = (doc_id, *without(text, found, long_words, places)) if found else (doc_id, text, len(places) // 8, 0, "")
                for k, x in enumerate(row):
                    out[k].append(x)
            kinds = [b.schema.field("_id").type, pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["_id", "text", "n_sentences", "n_removed", "removed"])

    on = F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_key") == F.col("_gkey"))
    joined = keyed.join(gone.hint("shuffle_hash"), on, "left").select("_id", "_text", "cut", "spans")
    result = joined.mapInArrow(drop, f"_id {kind}, text string, n_sentences long, n_removed long, removed string")
    return result.withColumnRenamed("_id", id_col)


def without(text: str | None, found: list[dict], long_words: int, places: bytes | None = None) -> tuple[str | None, int, int, str]:
    """``text`` less the sentences in ``found``, their number and their places.
    ``places``: where its sentences start and end, if that is known.

    White space between sentences goes with the sentence before it.
    """
    cut = sentences(text, long_words) if places is None else np.frombuffer(places, dtype="<i4").reshape(-1, 2).tolist()
    gone = sorted({k for s in found for k in range(s["first"], s["first"] + s["n"])})
    if not gone:
        return text, len(cut), 0, ""
    kept, at = [], 0
    for k in gone:
        kept.append(text[at : cut[k][0]])
        at = cut[k + 1][0] if k + 1 < len(cut) else len(text)
    places = ",".join(f"{cut[k][0]}:{cut[k][1]}" for k in gone)
    return ("".join(kept) + text[at:]).strip(), len(cut), len(gone), places
