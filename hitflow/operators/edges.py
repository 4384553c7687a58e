"""Period and missed pulses of an edge stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import SLICE_NS, bin_of, clip, exact_quantile, saved, with_previous

LONGEST = 100.0


def gaps(edges: DataFrame, time: str = "time_ns", slice_ns: float = SLICE_NS) -> DataFrame:
    """(time_ns, gap) for every edge but the first, in time order."""
    rows = with_previous(edges.where(F.col(time).isNotNull()).select(F.col(time).alias("time_ns")), "time_ns", slice_ns)
    return rows.select("time_ns", (F.col("time_ns") - F.col("prev_time")).alias("gap")).where("gap is not null")


def gap_counts(edges: DataFrame, time: str = "time_ns", slice_ns: float = SLICE_NS) -> DataFrame:
    """(gap, n) of every gap that occurs, computed once and kept: the period and the report come from it."""
    return saved(gaps(edges, time, slice_ns).groupBy("gap").agg(F.count("*").alias("n")))


def measure_period(edges: DataFrame, override: float | None = None, time: str = "time_ns", counts: DataFrame | None = None) -> float:
    """The exact median gap, or the override. ValueError with fewer than two edges."""
    if override is not None:
        return float(override)
    period = exact_quantile(gap_counts(edges, time) if counts is None else counts, "gap", weight="n")
    if period is None:
        raise ValueError("a period needs at least two edges")
    return period


def edge_report(edges: DataFrame, period: float, threshold: float = 1.5, time: str = "time_ns", counts: DataFrame | None = None) -> DataFrame:
    """One row: spread, missed gaps, estimated missing edges, share affected and the span check."""
    multiple, n = F.col("gap") / F.lit(period), F.col("n")
    missed = (multiple >= threshold) & (multiple < LONGEST)
    off = F.col("gap") - F.lit(period)  # sums of small numbers keep their digits
    own = (gap_counts(edges, time) if counts is None else counts).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n_gaps"),
        F.sqrt(F.greatest(F.sum(off * off * n) / F.sum(n) - F.pow(F.sum(off * n) / F.sum(n), 2), F.lit(0.0))).alias("period_std_ns"),
        F.coalesce(F.sum(F.when(missed, n)), F.lit(0)).alias("n_missed_gaps"),
        F.coalesce(F.sum(F.when(missed, F.bround(multiple - 1, 0) * n)), F.lit(0.0)).cast("long").alias("n_missing"),
        F.sum(F.col("gap") * n).alias("span_ns"),
    )
    expected = F.greatest(F.col("span_ns") / F.lit(period) + 1, F.lit(1.0))
    return own.select(
        F.lit(period).alias("period_ns"), F.round("period_std_ns", 6).alias("period_std_ns"), (F.col("n_gaps") + 1).alias("n_edges"), "n_missed_gaps", "n_missing",
        F.round(F.col("n_missing") / expected, 6).alias("fraction_affected"), "span_ns",
        (F.col("n_gaps") * F.lit(period)).alias("expected_span_ns"), F.abs(F.col("span_ns") - F.col("n_gaps") * F.lit(period)).alias("span_difference_ns"),
    )


def gap_histogram(edges: DataFrame, low: float, high: float, bins: int = 200) -> DataFrame:
    return gaps(edges).select(bin_of(F.col("gap"), low, high, bins).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def gap_sequence(edges: DataFrame, period: float) -> DataFrame:
    return gaps(edges).select("time_ns", clip(F.col("gap"), 0.0, 5 * period).alias("gap"))
