"""Shape, charge and timing features of clusters, in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clip, histogram, require

#: The inputs of the classifier, and the scalars beside a patch.
MODEL_FEATURES = ["n_pixels", "tot_sum", "tot_max", "tot_mean", "cx_w", "cy_w", "bbox_w", "bbox_h", "eccentricity", "linearity", "compactness", "dt_min_vs_argmax"]
PATCH_SCALARS = ["n_pixels", "tot_sum", "tot_max", "eccentricity"]


def _moment(s: str, a: str, b: str, ab: str) -> Column:
    """Weighted covariance from integer sums: exact until the division."""
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    top = (F.col(s).cast("decimal(19,0)") * F.col(ab).cast("decimal(19,0)") - F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")).cast("double")
    return F.when(F.col(s) > 0, top / (whole(s).cast("double") * whole(s).cast("double"))).otherwise(0.0)


def cluster_features(clustered: DataFrame, id_col: str = "cluster_id") -> DataFrame:
    """One row per cluster. Null charges count as 0; ties for the largest charge go to the earliest hit."""
    require(clustered, {id_col, "x_pix", "y_pix", "time_ns", "tot"}, "features")
    w, x, y = F.coalesce("tot", F.lit(0)).cast("long"), F.col("x_pix").cast("long"), F.col("y_pix").cast("long")
    sums = clustered.groupBy(id_col).agg(
        F.count("*").alias("n_pixels"), F.min("time_ns").alias("t_min"), F.max("time_ns").alias("t_max"),
        F.sum(w).alias("s"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), F.sum(w * y * y).alias("syy"),
        F.max(w).alias("tot_max"), (F.max(x) - F.min(x) + 1).alias("bbox_w"), (F.max(y) - F.min(y) + 1).alias("bbox_h"),
        F.max(F.struct(w.alias("w"), (-F.col("time_ns")).alias("back"))).alias("peak"),
    )
    sums = sums.withColumns({"vx": _moment("s", "sx", "sx", "sxx"), "vxy": _moment("s", "sx", "sy", "sxy"), "vy": _moment("s", "sy", "sy", "syy")})
    half, both = (F.col("vx") - F.col("vy")) / 2, F.col("vx") + F.col("vy")
    spread = F.sqrt(half * half + F.col("vxy") * F.col("vxy"))
    shaped, large = (F.col("n_pixels") >= 2) & (both > 1e-12), both / 2 + spread
    d = lambda c: F.col(c).cast("double")
    return sums.select(
        id_col, "n_pixels", d("s").alias("tot_sum"), d("tot_max").alias("tot_max"), (F.col("s") / F.col("n_pixels")).alias("tot_mean"),
        (F.col("sx") / F.greatest(d("s"), F.lit(1e-9))).alias("cx_w"), (F.col("sy") / F.greatest(d("s"), F.lit(1e-9))).alias("cy_w"),
        d("bbox_w").alias("bbox_w"), d("bbox_h").alias("bbox_h"),
        F.when(shaped, F.sqrt(F.greatest(F.lit(0.0), 1 - (both / 2 - spread) / F.greatest(large, F.lit(1e-12))))).otherwise(0.0).alias("eccentricity"),
        F.when(shaped, large / both).otherwise(0.0).alias("linearity"),
        (F.col("n_pixels") / (F.col("bbox_w") * F.col("bbox_h"))).alias("compactness"),
        "t_min", "t_max", (-F.col("peak.back")).alias("t_argmax_tot"), (-F.col("peak.back") - F.col("t_min")).alias("dt_min_vs_argmax"),
    )


def merge_features(clusters: DataFrame, features: DataFrame, id_col: str = "cluster_id") -> DataFrame:
    """Features replace columns of the same name; clusters without features keep nulls."""
    return clusters.drop(*(c for c in features.columns if c != id_col)).join(features, id_col, "left")


def timewalk_histogram(features: DataFrame) -> DataFrame:
    return histogram(features, clip(F.col("dt_min_vs_argmax"), -200.0, 2000.0), -200.0, 2000.0, 100)


def timewalk_points(features: DataFrame) -> DataFrame:
    """(cluster_id, n_pixels, dt_clipped, tot_mean) of each cluster: the scatter beside the histogram, coloured by tot_mean."""
    return features.select("cluster_id", "n_pixels", clip(F.col("dt_min_vs_argmax"), -200.0, 2000.0).alias("dt_clipped"), "tot_mean")
