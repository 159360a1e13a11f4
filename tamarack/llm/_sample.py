"""Bounded training samples: the only place where rows reach the driver.

Exact counts by class set a share; rows whose hash falls below it are drawn, and of
those the ``per_class`` with the smallest hashes stay, so the limit holds whatever
the rows are.  The hash is of all columns of the row: rows that share an id, or have
none, are drawn apart, and equal rows count as often as they are drawn.  Texts are
cut to ``max_chars`` for training alone.  All three are documented parameters of the
trainers; none grows with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sample_by_class(rows: DataFrame, id_col: str, class_col: str, per_class: int, max_rows: int | None = None, seed: int = 7) -> DataFrame:
    """At most ``per_class`` rows of each class (null: none); all rows of smaller classes.

    With more than ``max_rows / per_class`` classes each has a smaller share, so that
    at most ``max_rows`` (64 times ``per_class`` if unset) are taken, or one a class.
    """
    known = rows.where(F.col(class_col).isNotNull())
    counts = known.groupBy(F.col(class_col).alias("_class")).agg(F.count("*").alias("_n"))
    n_classes = counts.count()
    most = max(1, min(per_class, int((max_rows or 64 * per_class) / max(1, n_classes))))
    counts = F.broadcast(counts) if n_classes <= 10_000 else counts  # one row a class
    # xxhash64 is even over the longs: compare its top 31 bits to a share of 2**31.  A share
    # of 1.5 times and 50 rows more leaves the ordered limit something to cut nearly always.
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), *rows.columns), 33)
    share = (F.least(F.lit(1.0), F.lit(1.5 * most + 50) / F.col("_n")) * 2**31).cast("long")
    met = known.join(counts, F.col(class_col) == F.col("_class")).withColumn("_draw", draw).where(F.col("_draw") < share)
    # row_number under a limit keeps ``most`` rows a class in each task before the shuffle.
    first = Window.partitionBy(class_col).orderBy("_draw", id_col)
    return met.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= most).select(*rows.columns)
