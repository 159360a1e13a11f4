"""Spans of regular expressions in DataFrame functions.

Spark gives the matches of a pattern and the gaps between them; the running sum
of their lengths places them.  Places are code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,v:string>>"
_BLOCK = 128
_PIECE = 512
_WIDE = 8192


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` (never empty) in ``text``, as
    (s, e, v).  Sums run over blocks of matches, so a text with very many costs
    little more than their number."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def block_spans(block: Column, base: Column) -> Column:
        start = F.struct(base.alias("at"), F.array().cast(SPAN).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + F.length(x["g"])
            e = s + F.coalesce(F.length(x["m"]), F.lit(0))
            one = F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("v"))).cast(SPAN)
            return F.struct(e.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

        return F.aggregate(block, start, step, lambda a: a["out"])

    def length(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda a, x: a + F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0)))

    def placed(zipped: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(zipped) - 1) / _BLOCK).cast("int")), lambda b: F.slice(zipped, b * _BLOCK + 1, _BLOCK))

        def joined(bs: Column) -> Column:
            sums = F.transform(bs, length)
            return F.flatten(let(sums, lambda n: F.transform(bs, lambda b, i: block_spans(b, F.aggregate(F.slice(n, F.lit(1), i), F.lit(0), lambda a, x: a + x)))))

        return let(blocks, joined)

    return let(parts, placed)


def pieces(text: Column, size: int = _PIECE) -> Column:
    """``text`` in parts of ``size`` characters; those of ``_PIECE`` serve ``cut_from``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def cut_from(parts: Column, start: Column, n: Column) -> Column:
    """``n`` (at most ``_PIECE``) characters from ``start`` on, of a text given by its
    ``pieces``; the cost does not grow with the text, as that of ``substring`` does."""
    k = (start / _PIECE).cast("int")
    both = F.concat(F.coalesce(F.get(parts, k), F.lit("")), F.coalesce(F.get(parts, k + 1), F.lit("")))
    return F.substring(both, start % _PIECE + 1, n)


def filter_near(spans: Column, others: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """The ``spans`` x (with s, e) for which ``keep(x, near)`` holds, ``near`` having all
    ``others`` that overlap x.  ``others`` is searched once for every block of spans."""

    def block_kept(block: Column) -> Column:
        low, high = F.array_min(F.transform(block, lambda x: x["s"])), F.array_max(F.transform(block, lambda x: x["e"]))
        near = let(F.struct(low.alias("s"), high.alias("e")), lambda r: F.filter(others, lambda y: (y["s"] < r["e"]) & (r["s"] < y["e"])))
        return let(near, lambda near: F.filter(block, lambda x: keep(x, near)))

    starts = F.sequence(F.lit(0), ((F.size(spans) - 1) / _BLOCK).cast("int"))
    return F.flatten(F.transform(starts, lambda b: let(F.slice(spans, b * _BLOCK + 1, _BLOCK), block_kept)))


def number_of(spans: str, k: int) -> Column:
    """How many (k, ...) structs in the column ``spans`` are of kind number ``k``."""
    return F.size(F.filter(spans, lambda x: x["k"] == k)).cast("long")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of (order, s, e, kind) structs, comma-joined as they stand."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def masked(text: Column, found: Column, mark: str) -> Column:
    """``text`` with every span of ``found`` (sorted by s; touching ones as one) replaced by
    ``mark``.  Long texts are masked piece by piece; a span's mark stands where it starts."""

    def piece(part: Column, i: Column) -> Column:
        low = i * _WIDE
        near = F.filter(found, lambda x: (x["s"] < low + _WIDE) & (x["e"] >= low))
        start = F.struct(low.alias("at"), F.lit("").alias("out"), F.lit(False).alias("open"))

        def step(a: Column, x: Column) -> Column:
            gap = F.substring(part, a["at"] - low + 1, F.greatest(x["s"] - a["at"], F.lit(0)))
            new = (x["s"] > a["at"]) | (~a["open"] & (x["s"] >= low))
            return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.concat(a["out"], gap, F.when(new, mark).otherwise("")).alias("out"), F.lit(True).alias("open"))

        return F.aggregate(near, start, step, lambda a: F.concat(a["out"], F.substring(part, a["at"] - low + 1, F.lit(_WIDE))))

    return F.array_join(F.transform(pieces(text, _WIDE), piece), "")
