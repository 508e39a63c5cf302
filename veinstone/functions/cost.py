"""Prices of model calls, in dollars and micro-dollars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dollars a million tokens (fixed values): in, out, cache write, cache read.
PRICES = {"model-1": (1, 5, 1.25, 0.1), "model-2": (0.1, 0.5, 0.125, 0.01)}
#: model-2 beyond 100,000 prompt tokens.
LONG_PROMPT, LONG_PRICES = 100_000, (0.5, 2.5, 0.625, 0.05)


def usd(model: Column, tin: Column, tout: Column, write: Column, read: Column, batch: Column) -> Column:
    """Dollars of a call; null for a model without a price. A dated name (-YYYYMMDD) is the model's; a batch halves."""
    name = F.regexp_replace(model, r"-[0-9]{8}$", "")
    long = (name == "model-2") & (tin + write + read > LONG_PROMPT)

    def rate(i: int) -> Column:
        out = F.lit(None).cast("double")
        for m, p in PRICES.items():
            out = F.when(name == m, F.lit(float(p[i]))).otherwise(out)
        return F.when(long, F.lit(float(LONG_PRICES[i]))).otherwise(out)

    total = tin * rate(0) + tout * rate(1) + write * rate(2) + read * rate(3)
    return total / 1e6 * F.when(batch, 0.5).otherwise(1.0)


def micros(dollars: Column) -> Column:
    return F.ceil(dollars * 1e6 - 1e-6).cast("long")


def cap(estimate: Column, remaining: Column) -> Column:
    """1.5 times the estimate, at most what remains; null where nothing does."""
    return F.when(remaining > 0, F.least(F.ceil(estimate * 1.5), remaining))


def reserve_micros(model: Column, tin: Column, most: Column, batch: Column) -> Column:
    """What to set aside for a call: its input at the dearer of the plain and the cache-writing rate, and a quarter of the longest output."""
    zero = F.lit(0).cast("long")
    out = 0.25 * most
    return micros(F.greatest(usd(model, tin, out, zero, zero, batch), usd(model, zero, out, tin, zero, batch)))
