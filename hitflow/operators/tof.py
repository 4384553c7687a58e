"""Time of flight: backward as-of join with the pulses, and folding by the period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import SLICE_NS, histogram, histogram2d, require

TIMES = ("t_min", "t_argmax_tot")


def asof_backward(left: DataFrame, right: DataFrame, left_time: str, right_time: str, name: str = "edge_ns", slice_ns: float = SLICE_NS) -> DataFrame:
    """All rows of left with the latest time of right that is not after theirs (null where there is none or theirs is null).

    Both sides are tagged and united, and the last edge runs along within slices of time. What a
    slice inherits comes from a table of one row per slice. Each side is shuffled once.
    """
    probe = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(left.columns)))
    a = left.select(F.col(left_time).cast("double").alias("t"), F.lit(1).alias("side"), F.lit(None).cast("double").alias("edge"), probe.alias("row"))
    b = right.where(F.col(right_time).isNotNull()).select(F.col(right_time).cast("double").alias("t"), F.lit(0).alias("side"), F.col(right_time).cast("double").alias("edge"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("slice", F.floor(F.col("t") / F.lit(slice_ns)))
    last = both.groupBy("slice").agg(F.max("edge").alias("last"))
    carried = last.select("slice", F.max("last").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    own = F.last("edge", ignorenulls=True).over(Window.partitionBy("slice").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = both.withColumn("own", own).where("side = 1").join(carried, "slice", "left")
    found = F.when(F.col("t").isNotNull(), F.coalesce("own", "before"))
    return met.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(left.columns)), found.alias(name))


def attach_tof(clusters: DataFrame, edges: DataFrame, period: float, cluster_time: str = "t_min", slice_ns: float = SLICE_NS) -> DataFrame:
    """Adds cluster_time_ns, raw_tof_ns, folded_tof_ns and tof_valid; null before the first edge."""
    if cluster_time not in TIMES:
        raise ValueError(f"cluster time is one of {TIMES}, not {cluster_time!r}")
    require(clusters, {cluster_time}, "time of flight")
    own = clusters.drop("cluster_time_ns", "raw_tof_ns", "folded_tof_ns", "tof_valid").withColumn("cluster_time_ns", F.col(cluster_time))
    met = asof_backward(own, edges, "cluster_time_ns", "time_ns", "edge_ns", slice_ns)
    met = met.withColumn("raw_tof_ns", F.col("cluster_time_ns") - F.col("edge_ns")).drop("edge_ns")
    return met.withColumns({"folded_tof_ns": F.pmod("raw_tof_ns", F.lit(period)), "tof_valid": F.col("raw_tof_ns").isNotNull()})


def wrap_report(tof: DataFrame) -> DataFrame:
    wrapped = F.count_if(F.abs(F.col("raw_tof_ns") - F.col("folded_tof_ns")) > 0.5)
    return tof.agg(F.count_if("tof_valid").alias("n_valid"), wrapped.alias("n_wrapped")).withColumn("wrapped_percent", F.round(F.col("n_wrapped") * 100.0 / F.greatest("n_valid", F.lit(1)), 6))


def spectrum(tof: DataFrame, period: float, bins: int = 199) -> DataFrame:
    return histogram(tof, F.col("folded_tof_ns"), 0.0, period, bins)


def charge_map(tof: DataFrame, period: float, top: float, bins: tuple[int, int] = (149, 99)) -> DataFrame:
    return histogram2d(tof, F.col("folded_tof_ns"), (0.0, period, bins[0]), F.log1p("tot_sum"), (0.0, top, bins[1]))


def compare_modes(clusters: DataFrame, edges: DataFrame, period: float) -> DataFrame:
    """(n, mean_difference, max_difference) of the folded times of the two cluster times."""
    keep = clusters.select("cluster_id", *TIMES)
    first, second = (attach_tof(keep, edges, period, t).select("cluster_id", F.col("folded_tof_ns").alias(t)) for t in TIMES)
    gap = F.abs(F.col(TIMES[0]) - F.col(TIMES[1]))
    return first.join(second, "cluster_id").agg(F.count(gap).alias("n"), F.round(F.avg(gap), 6).alias("mean_difference"), F.max(gap).alias("max_difference"))
