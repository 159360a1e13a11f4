"""The 14 features of a payload as Columns, in 32-bit arithmetic.

A number is multiplied by the 32-bit reciprocal of its limit and clamped to
0..1.  Missing fields give the defaults 0, but -1 for the two features of an
absent last transaction, 1 for an unknown merchant and 0.5 for an unknown
category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits, and risk of a merchant category.
LIMITS = {"amount": 10000, "installments": 12, "amount_vs_avg": 10, "minutes": 1440, "km": 1000, "tx_count_24h": 20, "merchant_avg": 10000}
RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
DEFAULT_RISK = 0.5
DIM = 14


def f32(c: Column) -> Column:
    return c.cast("float")


def inverse(limit: float) -> Column:
    return F.lit(1.0 / limit).cast("float")


def clamp01(c: Column) -> Column:
    return F.when(c > 1, F.lit(1.0).cast("float")).when(c < 0, F.lit(0.0).cast("float")).otherwise(c)


def scaled(c: Column, limit: float) -> Column:
    return F.coalesce(clamp01(f32(c) * inverse(limit)), F.lit(0.0).cast("float"))


def amount_vs_average(amount: Column, average: Column) -> Column:
    ratio = f32(f32(amount) / f32(F.when(f32(average) > 0, average)))
    return F.coalesce(clamp01(ratio * inverse(LIMITS["amount_vs_avg"])), F.lit(0.0).cast("float"))


def wall_clock(text: Column) -> Column:
    """The time as the text's own digits say it: no time zone, neither the text's
    nor the session's, has a part in it.  Null if the text is no time."""
    return text.try_cast("timestamp_ntz")


def seconds_of(clock: Column) -> Column:
    """Seconds from 1970 to a ``timestamp_ntz``, whatever the session's time zone."""
    day = F.datediff(F.to_date(clock), F.lit("1970-01-01").cast("date")).cast("long")
    return day * 86400 + F.hour(clock) * 3600 + F.minute(clock) * 60 + F.second(clock)


def hour_of_day(text: Column) -> Column:
    return F.coalesce(f32(F.hour(wall_clock(text))) * inverse(23), F.lit(0.0).cast("float"))


def day_of_week(text: Column) -> Column:
    """Monday 0 to Sunday 1."""
    return F.coalesce(f32(F.weekday(wall_clock(text))) * inverse(6), F.lit(0.0).cast("float"))


def minutes_since(now: Column, last: Column) -> Column:
    # One element: each text is then parsed once.
    pair = F.array(F.struct(wall_clock(now).alias("a"), wall_clock(last).alias("b")))
    seconds = F.element_at(F.transform(pair, lambda p: seconds_of(p["a"]) - seconds_of(p["b"])), 1)
    return clamp01(f32(f32(seconds) / F.lit(60.0).cast("float")) * inverse(LIMITS["minutes"]))


def unknown_merchant(merchant: Column, known: Column) -> Column:
    met = F.array_contains(known, merchant) & (merchant != "")
    return F.when(met, F.lit(0.0)).otherwise(F.lit(1.0)).cast("float")


def category_risk(mcc: Column, risk: dict[str, float] = RISK, default: float = DEFAULT_RISK) -> Column:
    table = F.create_map(*(F.lit(x) for kv in risk.items() for x in kv))
    known = F.when(F.length(mcc) == 4, mcc)
    return F.coalesce(F.try_element_at(table, known), F.lit(default)).cast("float")


def flag(c: Column) -> Column:
    return F.coalesce(c.cast("float"), F.lit(0.0).cast("float"))


def feature_columns(limits: dict[str, float] = LIMITS, risk: dict[str, float] = RISK) -> list[Column]:
    """The features in order, over the columns of a payload."""
    c = F.col
    missing = F.lit(-1.0).cast("float")
    last = c("last_transaction")
    return [
        scaled(c("transaction.amount"), limits["amount"]),
        scaled(c("transaction.installments"), limits["installments"]),
        amount_vs_average(c("transaction.amount"), c("customer.avg_amount")),
        hour_of_day(c("transaction.requested_at")),
        day_of_week(c("transaction.requested_at")),
        F.coalesce(F.when(last.isNotNull(), minutes_since(c("transaction.requested_at"), last["timestamp"])), missing),
        F.when(last.isNull(), missing).otherwise(scaled(last["km_from_current"], limits["km"])),
        scaled(c("terminal.km_from_home"), limits["km"]),
        scaled(c("customer.tx_count_24h"), limits["tx_count_24h"]),
        flag(c("terminal.is_online")),
        flag(c("terminal.card_present")),
        unknown_merchant(c("merchant.id"), c("customer.known_merchants")),
        category_risk(c("merchant.mcc"), risk),
        scaled(c("merchant.avg_amount"), limits["merchant_avg"]),
    ]


def vectorize(payloads: DataFrame, out: str = "vector", limits: dict[str, float] = LIMITS, risk: dict[str, float] = RISK) -> DataFrame:
    """``payloads`` with the feature vector as array<float>; ``limits`` and ``risk``
    may come from files (``read_lookup``)."""
    return payloads.withColumn(out, F.array(*feature_columns(limits, risk)))
