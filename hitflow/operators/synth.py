"""Generated pulses and hits with ground truth; all draws come from hashes of ids, so any number of
tasks gives the same rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Species:
    name: str
    rate: float  # clusters per pulse
    tof_mean: float
    tof_std: float
    shape: str  # dot, curl or blob
    pixels: tuple[int, int]
    tot: tuple[float, float]


#: The default species.
SPECIES = (
    Species("gamma", 0.05, 175.0, 10.0, "dot", (1, 3), (80.0, 15.0)),
    Species("neutron", 0.03, 250.0, 15.0, "blob", (4, 12), (500.0, 100.0)),
    Species("slow", 0.01, 2100.0, 100.0, "curl", (5, 15), (120.0, 30.0)),
)
PERIOD, JITTER, SPREAD, WALK, WALK_TOT, HORIZON = 1785.0, 0.5, 50.0, 80.0, 100.0, 200_000.0


def uniform(seed: int, *keys: Column | str) -> Column:
    """In (0, 1), from the hash of the keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, *keys: Column | str) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(uniform(seed + 1, *keys) * 6.283185307179586)


def synth_edges(spark: SparkSession, duration_ns: float, missed: float = 0.02, seed: int = 42, block: int = 100_000) -> DataFrame:
    """(pulse, time_ns): gaps are normal with a floor of half a period; a share of the pulses is missing."""
    n = int(duration_ns / PERIOD) + 1
    rows = spark.range(n).withColumn("gap", F.when(F.col("id") == 0, 0.0).otherwise(F.greatest(F.lit(PERIOD / 2), PERIOD + JITTER * normal(seed, "id"))))
    rows = rows.withColumn("block", F.floor(F.col("id") / block))
    sums = rows.groupBy("block").agg(F.sum("gap").alias("s"))
    before = sums.select("block", (F.sum("s").over(Window.orderBy("block")) - F.col("s")).alias("before"))
    own = F.sum("gap").over(Window.partitionBy("block").orderBy("id"))
    rows = rows.withColumn("own", own).join(before, "block")
    return rows.where(uniform(seed + 2, "id") >= missed).select(F.col("id").alias("pulse"), (F.col("before") + F.col("own")).alias("time_ns"))


def _offsets(seed: int) -> Column:
    """Cell offsets of a cluster: array of (dx, dy), by shape."""
    n, cells = F.col("n"), "struct<dx:int,dy:int>"
    ordered = lambda side: F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.struct(uniform(seed, "id", i).alias("u"), i.alias("i"))))
    place = lambda side: lambda e: F.struct((e["i"] % side - side // 2).cast("int").alias("dx"), (F.floor(e["i"] / side) - side // 2).cast("int").alias("dy"))
    dot = F.slice(F.transform(ordered(3), place(3)), 1, F.least(n, F.lit(9)))
    disc = F.filter(F.transform(ordered(7), place(7)), lambda c: c["dx"] * c["dx"] + c["dy"] * c["dy"] <= F.greatest(F.lit(2), F.col("n") / 2))
    walk = F.aggregate(
        F.sequence(F.lit(1), n - 1), F.array(F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy"))).cast(f"array<{cells}>"),
        lambda m, i: F.concat(m, F.array(F.struct(
            (F.element_at(m, -1)["dx"] + F.floor(uniform(seed, "id", i) * 3).cast("int") - 1).alias("dx"),
            (F.element_at(m, -1)["dy"] + F.floor(uniform(seed + 5, "id", i) * 3).cast("int") - 1).alias("dy"),
        ))),
    )
    one = F.array(F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy"))).cast(f"array<{cells}>")
    return F.when(n <= 1, one).when(F.col("shape") == "dot", dot).when(F.col("shape") == "blob", F.slice(disc, 1, n)).otherwise(walk)


def synth_hits(spark: SparkSession, duration_ns: float, seed: int = 42, species: tuple[Species, ...] = SPECIES) -> tuple[DataFrame, DataFrame]:
    """(hits, truth): hits have x_pix, y_pix, time_ns, tot, given_id and arrival; truth has a row per
    cluster. RuntimeError if no cluster falls into the duration. Hits arrive shuffled within a horizon."""
    import numpy as np

    pulses, rng, parts, first = int(duration_ns / PERIOD), np.random.default_rng(seed), None, 0
    for i, s in enumerate(species):
        count = int(rng.poisson(s.rate * pulses))
        own = spark.range(first, first + count).select(
            "id", F.lit(s.name).alias("species"), F.lit(s.shape).alias("shape"), F.lit(s.tot[0]).alias("tot_mean"), F.lit(s.tot[1]).alias("tot_std"),
            F.floor(uniform(seed + 10 + i, "id") * pulses).cast("long").alias("pulse"),
            F.greatest(F.lit(0.0), s.tof_mean + s.tof_std * normal(seed + 20 + i, "id")).alias("tof"),
            (s.pixels[0] + F.floor(uniform(seed + 30 + i, "id") * (s.pixels[1] - s.pixels[0] + 1))).cast("int").alias("n"),
        )
        first += count
        parts = own if parts is None else parts.unionByName(own)
    if not first:
        raise RuntimeError("no cluster falls into the duration")
    parts = parts.withColumn("start", F.col("pulse") * PERIOD + F.col("tof")).where(F.col("start") <= duration_ns)
    parts = parts.withColumns({"x": (5 + F.floor(uniform(seed + 40, "id") * 246)).cast("int"), "y": (5 + F.floor(uniform(seed + 41, "id") * 246)).cast("int")})
    truth = parts.select(F.col("id").alias("cluster_id"), "species", F.col("tof").alias("true_tof_ns"), F.floor(F.col("tof") / PERIOD).cast("int").alias("wrap_count"), (F.col("pulse") * PERIOD).alias("pulse_time_ns"))
    cells = parts.select("id", "shape", "n", "tot_mean", "tot_std", "start", "x", "y", F.posexplode(_offsets(seed + 50)).alias("k", "c"))
    far = F.when(F.col("shape") == "blob", 1 - 0.6 * F.least(F.lit(1.0), (F.col("c.dx") * F.col("c.dx") + F.col("c.dy") * F.col("c.dy")) / F.greatest(F.lit(2), F.col("n") / 2))).otherwise(1.0)
    tot = F.greatest(F.lit(1), ((F.col("tot_mean") + F.col("tot_std") * normal(seed + 60, "id", "k")) * far).cast("int"))
    cells = cells.withColumn("tot", tot)
    late = -F.log(uniform(seed + 70, "id", "k")) * (SPREAD / F.col("n")) + F.when(F.col("tot") < WALK_TOT, WALK * (1 - F.col("tot") / WALK_TOT)).otherwise(0.0)
    hits = cells.select(
        F.least(F.greatest(F.col("x") + F.col("c.dx"), F.lit(0)), F.lit(255)).cast("int").alias("x_pix"), F.least(F.greatest(F.col("y") + F.col("c.dy"), F.lit(0)), F.lit(255)).cast("int").alias("y_pix"),
        (F.col("start") + late).alias("time_ns"), "tot", F.col("id").alias("given_id"), "k",
    )
    # Rows swap places only within a bucket of the horizon: the model of late data.
    arrival = F.floor(F.col("time_ns") / HORIZON) * (1 << 22) + F.pmod(F.xxhash64(F.lit(seed), "given_id", "k"), F.lit(1 << 22))
    return hits.withColumn("arrival", arrival.cast("long")).drop("k"), truth
