"""Secret scans with an incremental blob ledger (operator 10), in DataFrame
functions only.

Every version of a document is addressed by the SHA-256 of its content.  The
ledger holds the findings of each (blob, rule version); only pairs that it does
not hold are scanned, each blob once, and findings are joined back to all rows
(paths) that have the blob.  The rule version is the digest of the rules, so a
changed rule scans all blobs again and old findings stay as they were.

Edge cases: null and empty texts have no findings; repeated rows each give a
row; null ids are kept; an empty table gives no rows; other columns are not
read.  Long texts are scanned whole.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._ledger import digest_of, through_ledger
from ._spans import listed, masked, matches, number_of

#: Base rules, in the order that breaks ties: kind, pattern, sign that a text may have one, check of a match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = [
    ("assign", ASSIGN, r"(?i)password|passwd|secret|token|api_?key", "group2>=12"),
    ("access", r"AKIA[A-Z0-9]{14,}", "AKIA", ""),
    ("hex", r"[0-9a-f]{16,}", r"[0-9a-f]{16}", ""),
]
#: A private key with its body: up to the END line, or else over lines of base64
#: (the last may be shorter) after headers such as Proc-Type.
_EDGE = "[A-Z ]{0,24}PRIVATE KEY-----"
_BREAK = r"(?:\s|\\[nr])"
PRIVATE_KEY = (
    rf"-----BEGIN {_EDGE}(?:[^-]*+(?:-(?!----)[^-]*+){{0,64}}+-----END {_EDGE}"
    rf"|(?:\s++[A-Za-z][A-Za-z-]{{1,30}}:\x20[^\n]{{1,200}}(?=\n)){{0,8}}(?:{_BREAK}++[A-Za-z0-9+/]{{16,}}+={{0,2}}+){{1,1000}}+(?:{_BREAK}++[A-Za-z0-9+/]{{1,15}}+={{0,2}}+(?=\s*(?:\n|$)))?+)?+"
)
#: Further formats that carry their own marks.
MORE_RULES = [
    ("private_key", PRIVATE_KEY, "-----BEGIN", ""),
    ("forge_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_", ""),
    ("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-", ""),
    ("cloud_key", r"\bAIza[0-9A-Za-z_-]{35}", "AIza", ""),
    ("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ", ""),
    ("url_login", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@", "://", ""),
]
RULES = BASE_RULES + MORE_RULES
FOUND = "array<struct<s:int,k:int,e:int,kind:string>>"


def rule_version() -> str:
    return hashlib.sha256(repr(RULES).encode()).hexdigest()


def _found(text: Column, k: int) -> Column:
    kind, pattern, sign, check = RULES[k]
    spans = matches(text, pattern)
    if check:
        spans = F.filter(spans, lambda x: F.length(F.regexp_extract(x["v"], pattern, 2)) >= 12)
    named = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))
    plain = sign.replace("-", "").replace(":", "").replace("/", "").isalnum()
    there = text.contains(sign) if plain else text.rlike(sign)
    return F.when(there, named).otherwise(F.array().cast(FOUND)).cast(FOUND)


def scan(blobs: DataFrame) -> DataFrame:
    """(digest, found): all spans of each blob, by start and then rule order."""
    each = blobs.select("digest", *(_found(F.col("text"), k).alias(f"f{k}") for k in range(len(RULES))))
    return each.select("digest", F.array_sort(F.concat(*(f"f{k}" for k in range(len(RULES))))).alias("found"))


def _ledger_run(docs: DataFrame, ledger_path: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    kind = T._parse_datatype_string(FOUND)
    return through_ledger(docs, ledger_path, rule_version(), scan, [T.StructField("found", kind)], id_col, text_col)


def find_secrets(docs: DataFrame, ledger_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found) for every row; ``found`` as ``scan`` gives it."""
    rows, entries = _ledger_run(docs, ledger_path, id_col, text_col)
    return rows.join(entries, "digest").select(F.col("_id").alias(id_col), "found")


def digests(found: DataFrame) -> DataFrame:
    """``find_secrets`` rows as counts, base digest and span list."""
    base = F.filter("found", lambda x: x["k"] < len(BASE_RULES))
    n = [number_of("found", k).alias(f"n_{r[0]}") for k, r in enumerate(BASE_RULES)]
    return found.select("*", *n, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans")).drop("found")


def mask_secrets(docs: DataFrame, ledger_path: str, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with findings masked, and ``length_col`` set anew where that changed a text."""
    _, entries = _ledger_run(docs, ledger_path, id_col, text_col)
    dirty = entries.where(F.size("found") > 0).select(F.col("digest").alias("_d"), "found")
    # The text travels once, in the row.
    rows = docs.select(F.struct(*docs.columns).alias("row"), digest_of(F.col(text_col)).alias("_digest"))
    rows = rows.join(dirty, F.col("_digest") == F.col("_d"), "left")
    out = {c: F.col("row").getField(c) for c in docs.columns}
    mask = F.when(F.col("found").isNotNull(), masked(out[text_col], F.col("found"), "[SECRET]")).otherwise(out[text_col])
    rows = rows.withColumn("_t", mask)
    out[text_col] = F.col("_t")
    if length_col in docs.columns:
        changed = F.length("_t").cast(docs.schema[length_col].dataType)
        out[length_col] = F.when(F.col("found").isNotNull(), changed).otherwise(out[length_col])
    return rows.select(*(x.alias(c) for c, x in out.items()))
