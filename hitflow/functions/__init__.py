"""Column expressions and small frame helpers that the operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a time slice in ns. Windows over time run within slices, with one carried row per slice.
SLICE_NS = 1e7


def require(df: DataFrame, columns: set[str], what: str) -> DataFrame:
    """Raise ValueError, before anything runs, if a column is missing."""
    if missing := sorted(columns - set(df.columns)):
        raise ValueError(f"{what}: missing columns {missing}; there are {df.columns}")
    return df


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def bin_of(x: Column, low: float, high: float, bins: int) -> Column:
    """Number from 0 of the equal bin that holds x; the last bin has its right edge; null outside."""
    width = (high - low) / bins
    return F.when((x >= low) & (x <= high), F.least(F.floor((x - F.lit(low)) / F.lit(width)).cast("int"), F.lit(bins - 1)))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int, *by: str) -> DataFrame:
    """(by..., bin, n) of the bins that are not empty."""
    return df.select(*by, bin_of(value, low, high, bins).alias("bin")).where("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"))


def histogram2d(df: DataFrame, x: Column, xs: tuple[float, float, int], y: Column, ys: tuple[float, float, int]) -> DataFrame:
    both = df.select(bin_of(x, *xs).alias("bin_x"), bin_of(y, *ys).alias("bin_y")).where("bin_x is not null and bin_y is not null")
    return both.groupBy("bin_x", "bin_y").agg(F.count("*").alias("n"))


def normal_pdf(x: Column, mean: float, std: float) -> Column:
    z = (x - F.lit(mean)) / F.lit(std)
    return F.exp(z * z * -0.5) / F.lit(std * 2.5066282746310002)


def saved(df: DataFrame) -> DataFrame:
    """Compute once, write to the checkpoint folder, and go on from there.

    The cluster names a shared folder in spark.checkpoint.dir; one of our own is used where that is unset on one machine.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def sliced(df: DataFrame, time: str, slice_ns: float = SLICE_NS) -> DataFrame:
    return df.withColumn("slice", F.floor(F.col(time) / F.lit(slice_ns)))


def with_previous(df: DataFrame, time: str, slice_ns: float = SLICE_NS, *by: str) -> DataFrame:
    """Adds prev_time, the time of the row before in time order (of equal `by`), and slice.

    The window runs per slice; the last time of each slice is carried to the next slice that has
    rows through a table of one row per slice, so no task sees all rows.
    """
    rows = sliced(df, time, slice_ns)
    last = rows.groupBy(*by, "slice").agg(F.max(time).alias("last"))
    carried = last.select(*by, "slice", F.lag("last").over(Window.partitionBy(*by).orderBy("slice")).alias("before"))
    own = F.lag(time).over(Window.partitionBy(*by, "slice").orderBy(time))
    return rows.join(carried, [*by, "slice"]).withColumn("prev_time", F.coalesce(own, "before")).drop("before")


def runs(df: DataFrame, time: str, gap: float, name: str, slice_ns: float = SLICE_NS, *by: str) -> DataFrame:
    """Adds `name`: the time of the first row of the row's run, where a gap above `gap` in time order (of equal `by`) ends a run."""
    rows = with_previous(df, time, slice_ns, *by)
    rows = rows.withColumn("cut", F.when(F.col("prev_time").isNull() | (F.col(time) - F.col("prev_time") > gap), F.col(time)))
    cuts = rows.groupBy(*by, "slice").agg(F.max("cut").alias("last_cut"))
    before = cuts.select(*by, "slice", F.max("last_cut").over(Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    own = F.max("cut").over(Window.partitionBy(*by, "slice").orderBy(time).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.join(before, [*by, "slice"]).withColumn(name, F.coalesce(own, "carried")).drop("cut", "carried", "prev_time", "slice")


def numbered(df: DataFrame, part: str, *order, name: str = "row") -> DataFrame:
    """Adds the number from 0 of each row in the order of (part, order), gapless over all parts.

    Rows are ranked within a part; the counts of the parts before come from a table of one row per part.
    """
    sizes = df.groupBy(part).agg(F.count("*").alias("size"))
    before = sizes.select(part, (F.sum("size").over(Window.orderBy(part)) - F.col("size")).alias("before"))
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return df.join(before, part).withColumn(name, (F.col("before") + own - 1).cast("long")).drop("before")


def exact_quantile(df: DataFrame, column: str, share: float = 0.5, most: int = 10_000, bins: int = 1024, weight: str | None = None) -> float | None:
    """The interpolated quantile (as numpy and pandas define it), by narrowing a histogram.

    Each pass is one aggregate with at most `bins` rows for the driver; it ends when the bin that
    holds the rank has at most `most` rows or one distinct value. Nulls are left out. With a
    `weight` column, a row stands for so many equal values.
    """
    x = df.select(F.col(column).cast("double").alias("x"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w")).where("x is not null")
    n, low, high, rows = x.agg(F.sum("w"), F.min("x"), F.max("x"), F.count("*")).first()
    if not n:
        return None
    at = share * (n - 1)
    ranks = sorted({int(at), min(n - 1, int(at) + 1)})
    found: dict[int, float] = {}
    for rank in ranks:
        lo, hi, skipped, inside = low, high, 0, rows
        while rank not in found:
            if lo == hi:
                found[rank] = lo
            elif inside <= most or (hi - lo) / bins <= 0 or lo + (hi - lo) / bins <= lo:
                below = skipped
                for v in sorted(x.where((F.col("x") >= lo) & (F.col("x") <= hi)).groupBy("x").agg(F.sum("w").alias("w")).collect()):
                    found |= {r: v["x"] for r in ranks if below <= r < below + v["w"]}
                    below += v["w"]
            else:
                key = F.least(F.floor((F.col("x") - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
                counted = x.where((F.col("x") >= lo) & (F.col("x") <= hi)).groupBy(key.alias("k")).agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
                for r in sorted(counted.collect(), key=lambda r: r["k"]):
                    if skipped + r["w"] > rank:
                        lo, hi, inside = r["lo"], r["hi"], r["n"]
                        break
                    skipped += r["w"]
    a, b = found[ranks[0]], found[ranks[-1]]
    return a + (b - a) * (at - int(at))


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node that it reaches.

    Large-star and small-star steps in turn until no edge changes: a number of rounds logarithmic in the longest path, each
    written before the next. Loops count as an edge of their own node; nulls are ignored.
    """
    edges = saved(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null").distinct())
    now, state = edges.where("u <> v"), None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state or not mark[0]:
            break
        state = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(both.groupBy("u").agg(F.min("v").alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = saved(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    reached = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    return nodes.join(reached, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
