"""Shared plumbing: work tables in the shared folder, and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import path_exists, release, scratch, shared_dir, work_path, written

__all__ = ["SPACE_CLASS", "ascii_lower", "path_exists", "release", "scratch", "shared_dir", "space_words", "table", "work_path", "written"]

#: ASCII white space: x20 and x09-x0D.
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z alone; other letters stay."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text: Column) -> Column:
    """Maximal runs of other characters than ASCII white space; null: none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^{SPACE_CLASS}]+"), F.lit(0))
