"""Exact quantiles at scale and per-feature summary aggregates.

``exact_quantiles`` matches linear interpolation between closest ranks
(pandas ``quantile`` / SQL ``quantile_cont``): h = (n−1)·q, value =
v[⌊h⌋] + (h−⌊h⌋)·(v[⌈h⌉] − v[⌊h⌋]). Equal values are first grouped into one
row with their count (a partial aggregate, so a value that most rows hold costs
one row); running counts over the distinct values (``cumulative_sums``) then
give each value the span of ranks it fills. No task holds a group's values.
``approx=True`` swaps in ``percentile_approx`` (one pass, mergeable sketches)
for cases where rank error is acceptable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unpivot
from .sequence import cumulative_sums


def qname(q: float) -> str:
    return "q" + f"{q:.4f}".rstrip("0").rstrip(".").replace("0.", "", 1).replace(".", "_")


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    by: Sequence[str] = (), approx: bool = False,
                    accuracy: int = 100000) -> DataFrame:
    """Long table ``(by..., feature, q..)`` with one column per prob (see ``qname``).
    Null values are left out; a feature without values has no row. A null ``by``
    key is a group of its own."""
    keys = [*by, "feature"]
    long = unpivot(df.select(*by, *cols), by, cols).where(F.col("value").isNotNull())
    if approx:
        return long.groupBy(*keys).agg(*[
            F.percentile_approx("value", q, accuracy).alias(qname(q)) for q in probs])
    cum = cumulative_sums(long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n")),
                          keys, ["value"], ["n"])
    total = cum.groupBy(*[F.col(c).alias(f"_g_{c}") for c in keys]).agg(
        F.max("cum_n").alias("_total"))
    ranked = cum.join(total, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in keys])

    def rank(q: float):
        return (F.col("_total") - 1).cast("double") * F.lit(float(q))

    def fills(position):
        return (position >= F.col("cum_n") - F.col("n")) & (position < F.col("cum_n"))
    wanted, found = F.lit(False), []
    for q in probs:
        low, high = fills(F.floor(rank(q))), fills(F.ceil(rank(q)))
        wanted = wanted | low | high
        lo, hi = F.max(F.when(low, F.col("value"))), F.max(F.when(high, F.col("value")))
        part = F.max(rank(q) - F.floor(rank(q)))
        found.append((lo + (hi - lo) * part).alias(qname(q)))
    return ranked.where(wanted).groupBy(*keys).agg(*found)


def quantiles_wide(df: DataFrame, cols: Sequence[str], q: float) -> DataFrame:
    """One-row table with the q-quantile of each column, named like the column."""
    long = exact_quantiles(df, cols, [q])
    return long.groupBy().pivot("feature", list(cols)).agg(F.first(qname(q)))
