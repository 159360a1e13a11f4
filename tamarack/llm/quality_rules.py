"""Quality rules as weak supervision (operator 5), in DataFrame functions only.

Each rule votes good, bad or abstains on a document.  The votes are counted by
pattern (3**12 at most, whatever the input's size); expectation-maximisation over
those counts estimates, for each rule, how often it votes bad on good and on bad
documents, and the share of good ones.  The posterior probability that a document
is good replaces all-must-pass filtering: a document stays if it does not fail the
base rules and its posterior is at least ``keep_at``.  Every kind of fault has
several rules (symbols: four, repetition: two, form of lines: two, characters:
three), so that they can confirm or contradict each other; a bad vote that no other
rule bears out does not by itself reject a document.

Features are computed once, beside the carried columns, and written; counts and
verdicts read that table.

Edge cases: a null text has no words, as an empty one; both fail the base (under
50 words); repeated rows each give a row; null ids are kept; an empty table gives
no rows; other columns are carried
in one struct, so their names cannot clash.  Very long texts take n log n
steps: repeated windows are found by sorting window hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_CLASS, space_words, written
from ._spans import let

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_kinds", "n_wordless", "n_letterless", "n_upper", "n_marks", "n_digits", "n_lines", "n_ended", "n_short"]
RULES = ["symbols", "symbol_kinds", "wordless", "lettered", "marks", "word_length", "repetition", "dup_lines", "capitals", "digits", "ended", "short_lines"]
SYMBOLS, ENDS = "#*$%&|<>", ".!?\u2026\"'\u201d\u00bb)"


def _repeat_words(w: Column, n: Column) -> Column:
    """Words that stand in a 3-word window found twice or more in ``w``."""
    h = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))

    def covered(hashes: Column) -> Column:
        s = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def places(s: Column) -> Column:
            twin = lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"])
            return F.array_sort(F.transform(F.filter(s, twin), lambda x: x["p"]))

        p = let(s, places)
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, x: F.struct((x + 3).alias("end"), (a["n"] + 3 - F.greatest(F.lit(0), a["end"] - x)).alias("n"))
        return F.aggregate(p, start, step, lambda a: a["n"])

    some = lambda x: F.when(F.size(F.array_distinct(x)) < F.size(x), covered(x)).otherwise(0)
    return F.when(n < 3, 0).otherwise(let(h, some))


def with_features(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """``row``, a struct of the ``carry`` columns, and ``_`` + each of BASE and EXTRA (long)."""
    out = docs.select(F.struct(*carry).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    only = lambda kept: F.length(F.regexp_replace("_t", f"[^{kept}]+", ""))
    # Words without are far fewer than words with.
    words_without = lambda kinds: F.size(F.regexp_extract_all("_t", F.lit(rf"(?<![^{SPACE_CLASS}])[^{SPACE_CLASS}{kinds}]++(?![^{SPACE_CLASS}])"), F.lit(0)))
    last = lambda line: F.right(F.rtrim(line, F.lit(" \t\r\x0b\x0c")), F.lit(1))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    out = out.withColumns({"_w": space_words(F.col("_t")), "_lines": lines})
    out = out.withColumns({
        "_n_words": F.size("_w"),
        "_word_chars": F.length(F.regexp_replace("_t", f"[{SPACE_CLASS}]+", "")),
        "_n_symbols": only(SYMBOLS),
        "_n_kinds": sum((F.col("_t").contains(c).cast("int") for c in SYMBOLS), F.lit(0)),
        "_n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "_n_upper": only("A-Z"),
        "_n_marks": only("!?"),
        "_n_digits": only("0-9"),
        "_n_letterless": words_without(r"\p{L}"),
        "_n_wordless": words_without(r"\p{L}\p{N}"),
        "_n_lines": F.size("_lines"),
        "_n_ended": F.size(F.filter("_lines", lambda x: last(x).isin(*ENDS))),
        "_n_short": F.size(F.filter("_lines", lambda x: F.length(x) < 30)),
    })
    out = out.withColumn("_n_repeat_words", _repeat_words(F.col("_w"), F.col("_n_words")))
    return out.select("row", *(F.col(f"_{c}").cast("long").alias(f"_{c}") for c in BASE + EXTRA))


def base_failed() -> Column:
    return (F.col("_n_words") < 50) | (100 * F.col("_n_repeat_words") > 50 * F.col("_n_words"))


#: Limits of published heuristics for web text: those of the MassiveText filters (symbols
#: 0.1 a word, words with a letter 0.8, mean word of 3 to 10 characters, repeated lines 0.3)
#: and of FineWeb (ended lines 0.12, lines under 30 characters 0.67).  Marks and words
#: without letter or digit take the limit of symbols, repeated windows that of repeated
#: lines; capitals, digits and kinds of symbols a half, a fifth and a half of what there can
#: be.  A rule votes bad beyond its limit, good where a document is twice as far on the
#: right side of it, and abstains in between; none of this is fitted to labels.
LIMITS = {"symbols": 0.1, "symbol_kinds": 0.5 * len(SYMBOLS), "wordless": 0.1, "marks": 0.1, "repetition": 0.3, "dup_lines": 0.3, "capitals": 0.5, "digits": 0.2, "short_lines": 0.67}
LETTERED, ENDED, WORD_LENGTH = 0.8, 0.12, (3, 10)


def votes() -> list[Column]:
    """One column for each of RULES: 1 good, -1 bad, 0 abstains."""
    share = lambda a, b: F.col(f"_{a}") / F.greatest(F.col(f"_{b}"), F.lit(1))
    several = F.col("_n_lines") > 1

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    def at_most(rule: str, value: Column) -> Column:
        return vote(value <= LIMITS[rule] / 2, value > LIMITS[rule])

    length, lettered = share("word_chars", "n_words"), 1 - share("n_letterless", "n_words")
    low, high = WORD_LENGTH
    ended = share("n_ended", "n_lines")
    made = {
        "symbols": at_most("symbols", share("n_symbols", "n_words")),
        "symbol_kinds": at_most("symbol_kinds", F.col("_n_kinds")),
        "wordless": at_most("wordless", share("n_wordless", "n_words")),
        "lettered": vote(lettered >= (1 + LETTERED) / 2, lettered < LETTERED),
        "marks": at_most("marks", share("n_marks", "n_words")),
        "word_length": vote(length.between(low + (high - low) / 8, high - (high - low) / 8), (length < low) | (length > high)),
        "repetition": at_most("repetition", share("n_repeat_words", "n_words")),
        "dup_lines": F.when(several, at_most("dup_lines", share("n_dup_lines", "n_lines"))).otherwise(0),
        "capitals": at_most("capitals", share("n_upper", "word_chars")),
        "digits": at_most("digits", share("n_digits", "word_chars")),
        "ended": vote(ended >= 2 * ENDED, ended < ENDED),
        "short_lines": F.when(several, at_most("short_lines", share("n_short", "n_lines"))).otherwise(0),
    }
    return [made[r].cast("int") for r in RULES]


def fit(patterns: dict[tuple[int, ...], int], rounds: int = 500, prior: float = 4.0) -> tuple[float, list[tuple[float, float]]]:
    """Expectation-maximisation over counted vote patterns.

    Returns the log-odds of a good document before any vote, and for each rule the
    log-odds that its good and its bad vote add; an abstention adds nothing.  The
    model: a document is good or bad, and then rules vote independently, each with
    a rate of bad votes of its own in either class, all estimated from how votes
    agree.  Starts from the share of good votes in each pattern.  Every rate and the
    share of good documents have a prior worth ``prior`` documents (a rule is wrong
    on one good document in ten and right on every other bad one; nine in ten
    documents are good), so that nothing is a certainty; the data outweighs it
    everywhere but in tiny corpora.  A rule that fires on documents that the others
    find good loses its weight, and may gain one of the other sign.  The class that
    has the smaller share of bad votes is called good.
    """
    n_rules = len(next(iter(patterns), RULES))
    if not patterns:
        return 0.0, [(0.0, 0.0)] * n_rules
    votes, n = np.array([*patterns], dtype=np.int8), np.array([*patterns.values()], dtype=np.float64)
    order = np.lexsort(votes.T)  # sums do not depend on the order of the patterns
    votes, n = votes[order], n[order]
    good, bad = (votes == 1).astype(np.float64), (votes == -1).astype(np.float64)
    p = (good.sum(1) + 1) / (good.sum(1) + bad.sum(1) + 2)
    for _ in range(rounds):
        rate = []
        for weight, expected in ((n * p, 0.1), (n * (1 - p), 0.5)):
            rate.append((weight @ bad + prior * expected) / (weight @ bad + weight @ good + prior))
        share = ((n * p).sum() + 0.9 * prior) / (n.sum() + prior)
        odds = float(np.log(share / (1 - share)))
        up, down = np.log((1 - rate[0]) / (1 - rate[1])), np.log(rate[0] / rate[1])
        new = 1 / (1 + np.exp(-np.clip(odds + good @ up + bad @ down, -500, 500)))
        moved, p = float(np.abs(new - p).max()), new
        if moved < 1e-9:
            break
    if (n * p) @ bad.sum(1) / max((n * p).sum(), 1e-9) > (n * (1 - p)) @ bad.sum(1) / max((n * (1 - p)).sum(), 1e-9):
        odds, up, down = -odds, -up, -down
    return odds, [(float(a), float(b)) for a, b in zip(up, down, strict=True)]


def judge(docs: DataFrame, keep_at: float = 0.5, carry: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``row`` (a struct of the ``carry`` columns; None: all) of each row, the
    _-prefixed features, ``_base_failed``, ``_posterior`` and ``_kept``."""
    made = with_features(docs, docs.columns if carry is None else carry, text_col)
    made = written(made, "quality-features", "zstd")
    # One number a pattern: 3**12 of them at most, whatever the input's size.  Documents that
    # fail the base are out anyway, and have no part in what is learned.
    code = sum(((v + 1) * 3**k for k, v in enumerate(votes())), F.lit(0))
    counted = made.where(~base_failed()).groupBy(code.alias("code")).count().collect()
    odds, weights = fit({tuple(r["code"] // 3**k % 3 - 1 for k in range(len(RULES))): r["count"] for r in counted})
    z = F.lit(odds)
    for vote, (good, bad) in zip(votes(), weights, strict=True):
        z = z + F.when(vote == 1, good).when(vote == -1, bad).otherwise(0.0)
    made = made.withColumn("_posterior", 1 / (1 + F.exp(-z))).withColumn("_base_failed", base_failed())
    return made.withColumn("_kept", ~F.col("_base_failed") & (F.col("_posterior") >= keep_at))
