"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores. Each query runs
once to warm up and once for its time; results are counted by Spark's noop sink. The clustering_*
entries generate hits as the published time budgets describe them (100k below 5 s, 500k below 25 s; 1M has none).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitflow.operators import clustering
from hitflow.operators.synth import uniform
from hitflow.plans.queries import QUERIES

HEADLINE = ["a_report", "b_clusters", "b_cluster_pixels", "c_all", "d_fold", "d_spectrum", "f_em_5iter", "h_split", "g_class_fraction", "i_patch_sparse", "n_hitmap"]
GENERATED = {"clustering_100k": 100_000, "clustering_500k": 500_000, "clustering_1M": 1_000_000}


def generated_hits(spark: SparkSession, n: int) -> DataFrame:
    """n / 5 clusters of 2 to 8 pixels, uniform over a second."""
    clusters = spark.range(n // 5).select("id", (uniform(1, "id") * 1e9).alias("t"), (2 + F.floor(uniform(2, "id") * 252)).cast("int").alias("x"), (2 + F.floor(uniform(3, "id") * 252)).cast("int").alias("y"), F.explode(F.sequence(F.lit(1), (2 + F.floor(uniform(4, "id") * 7)).cast("int"))).alias("k"))
    near = lambda s: (F.floor(uniform(s, "id", "k") * 3) - 1).cast("int")
    return clusters.select((F.col("x") + near(5)).alias("x_pix"), (F.col("y") + near(6)).alias("y_pix"), (F.col("t") - 200 * F.log(uniform(7, "id", "k"))).alias("time_ns"), (50 + F.floor(uniform(8, "id", "k") * 550)).cast("int").alias("tot"))


def timed(make) -> float:
    for again in (False, True):
        start = time.time()
        make().write.format("noop").mode("overwrite").save()
        if again:
            return round(time.time() - start, 3)
    return 0.0


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {q: timed(lambda q=q: QUERIES[q](spark, sf)) for q in HEADLINE}
    for name, n in GENERATED.items():
        hits = generated_hits(spark, n).persist()
        hits.count()
        took[name] = timed(lambda h=hits: clustering.summary(clustering.cluster_hits(h)))
        hits.unpersist()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
