"""Data-quality measures of an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def monotone_fraction(df: DataFrame, time: str, arrival: str, slices: int = 1_000_000) -> DataFrame:
    """(n_pairs, monotone_fraction): share of rows not earlier than the row that arrived before.

    `arrival` is an integer index; windows run over blocks of it, and each block's first row meets
    the last row of the block before. Null fraction with fewer than two rows.
    """
    rows = df.where(F.col(time).isNotNull() & F.col(arrival).isNotNull()).select(F.col(time).alias("t"), F.col(arrival).alias("a"), F.floor(F.col(arrival) / slices).alias("b"))
    last = rows.groupBy("b").agg(F.max_by("t", "a").alias("last"))
    carried = last.select("b", F.lag("last").over(Window.orderBy("b")).alias("before"))
    prev = F.coalesce(F.lag("t").over(Window.partitionBy("b").orderBy("a")), F.col("before"))
    return rows.join(carried, "b").select((F.col("t") >= prev).alias("ok")).agg(F.count("ok").alias("n_pairs"), F.avg(F.col("ok").cast("int")).alias("monotone_fraction"))


def span(df: DataFrame, time: str, low_s: float = 1e-6, high_s: float = 3600.0) -> DataFrame:
    """(span_s, plausible) of all times."""
    s = ((F.max(time) - F.min(time)) / 1e9).alias("span_s")
    return df.agg(s).withColumn("plausible", F.col("span_s").between(low_s, high_s))


def warnings(df: DataFrame, time: str, arrival: str) -> list[str]:
    """What the measures warn of; they never fail a run."""
    out = []
    m, s = monotone_fraction(df, time, arrival).first(), span(df, time).first()
    if m["monotone_fraction"] is not None and m["monotone_fraction"] < 0.99:
        out.append(f"only {m['monotone_fraction']:.3f} of the rows are in time order")
    if s["span_s"] is not None and not s["plausible"]:
        out.append(f"the span of {s['span_s']} s is not plausible")
    return out
