"""Figures of a run: their data as small tables, and drawings of these as SVG text.

Every figure's data counts all rows: points are given as cells of a grid with their number and mean, never as a sample.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bin_of, clip, histogram2d
from ..operators import contamination, edges, features, mixture, tof

WIDTH, HEIGHT, LEFT, BOTTOM = 640, 400, 70, 50


def _ticks(low: float, high: float, n: int = 5) -> list[float]:
    return [low + (high - low) * i / n for i in range(n + 1)] if high > low else [low]


class Drawing:
    """One pair of axes with bars, lines or cells."""

    def __init__(self, title: str, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float]):
        self.parts: list[str] = []
        (self.x0, self.x1), (self.y0, self.y1) = x_range, y_range
        self.x1, self.y1 = (self.x1 if self.x1 > self.x0 else self.x0 + 1), (self.y1 if self.y1 > self.y0 else self.y0 + 1)
        self.text(WIDTH / 2, 20, title, size=15)
        self.text(LEFT + (WIDTH - LEFT) / 2, HEIGHT - 8, x)
        self.parts.append(f'<text x="14" y="{(HEIGHT - BOTTOM) / 2:.0f}" font-size="12" text-anchor="middle" transform="rotate(-90 14 {(HEIGHT - BOTTOM) / 2:.0f})">{escape(y)}</text>')
        for v in _ticks(self.x0, self.x1):
            self.text(self.px(v), HEIGHT - BOTTOM + 16, f"{v:.4g}", size=10)
        for v in _ticks(self.y0, self.y1):
            self.text(LEFT - 6, self.py(v) + 4, f"{v:.4g}", size=10, anchor="end")
        self.parts.append(f'<rect x="{LEFT}" y="30" width="{WIDTH - LEFT - 20}" height="{HEIGHT - BOTTOM - 30}" fill="none" stroke="#888"/>')

    def px(self, v: float) -> float:
        return LEFT + (v - self.x0) / (self.x1 - self.x0) * (WIDTH - LEFT - 20)

    def py(self, v: float) -> float:
        return HEIGHT - BOTTOM - (v - self.y0) / (self.y1 - self.y0) * (HEIGHT - BOTTOM - 30)

    def text(self, x: float, y: float, said: str, size: int = 12, anchor: str = "middle") -> None:
        self.parts.append(f'<text x="{x:.1f}" y="{y:.1f}" font-size="{size}" text-anchor="{anchor}">{escape(said)}</text>')

    def box(self, x0: float, x1: float, y0: float, y1: float, fill: str = "#4682b4", opacity: float = 1.0) -> None:
        a, b, c, d = self.px(x0), self.px(x1), self.py(y1), self.py(y0)
        self.parts.append(f'<rect x="{a:.1f}" y="{c:.1f}" width="{max(0.5, b - a):.1f}" height="{max(0.0, d - c):.1f}" fill="{fill}" fill-opacity="{opacity:.3f}"/>')

    def line(self, points: list[tuple[float, float]], colour: str = "#c0392b") -> None:
        at = " ".join(f"{self.px(x):.1f},{self.py(min(y, self.y1)):.1f}" for x, y in points)
        self.parts.append(f'<polyline points="{at}" fill="none" stroke="{colour}" stroke-width="1.5"/>')

    def svg(self) -> str:
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif"><rect width="100%" height="100%" fill="white"/>{"".join(self.parts)}</svg>'


def shade(share: float) -> str:
    """From pale to dark blue."""
    share = min(1.0, max(0.0, share))
    return f"#{round(240 - 210 * share):02x}{round(245 - 190 * share):02x}{round(250 - 110 * share):02x}"


def bars(rows: list, title: str, x: str, low: float, high: float, n: int, curve: list[tuple[float, float]] = ()) -> str:
    """A histogram of rows (bin, n), with a curve over it."""
    d = Drawing(title, x, "count", (low, high), (0, max([r["n"] for r in rows] + [y for _, y in curve] + [1])))
    width = (high - low) / n
    for r in rows:
        d.box(low + r["bin"] * width, low + (r["bin"] + 1) * width, 0, r["n"])
    if curve:
        d.line(sorted(curve))
    return d.svg()


def grid(rows: list, title: str, x: str, y: str, xs: tuple[float, float, int], ys: tuple[float, float, int], value: str = "n", log: bool = True) -> str:
    """Cells (bin_x, bin_y, value), shaded by their value or its logarithm."""
    scale = (lambda v: math.log1p(max(0.0, v))) if log else float
    d = Drawing(title, x, y, xs[:2], ys[:2])
    high, (wx, wy) = max([scale(r[value]) for r in rows] + [1e-12]), ((xs[1] - xs[0]) / xs[2], (ys[1] - ys[0]) / ys[2])
    for r in rows:
        d.box(xs[0] + r["bin_x"] * wx, xs[0] + (r["bin_x"] + 1) * wx, ys[0] + r["bin_y"] * wy, ys[0] + (r["bin_y"] + 1) * wy, shade(scale(r[value]) / high))
    return d.svg()


def named_bars(rows: list[tuple[str, float]], title: str, x: str) -> str:
    """Horizontal bars with a name each, the first on top."""
    d = Drawing(title, x, "", (0, max([v for _, v in rows] + [1e-12])), (0, max(1, len(rows))))
    for i, (name, v) in enumerate(rows):
        at = len(rows) - i - 1
        d.box(0, v, at + 0.15, at + 0.85)
        d.text(d.px(0) + 6, d.py(at + 0.4), name, size=10, anchor="start")
    return d.svg()


def matrix(rows: list, title: str) -> str:
    """Counts of (label, prediction), with their numbers."""
    classes = sorted({r["label"] for r in rows} | {r["prediction"] for r in rows})
    n = max(1, len(classes))
    d, most = Drawing(title, "prediction", "label", (0, n), (0, n)), max([r["n"] for r in rows] + [1])
    for r in rows:
        i, j = classes.index(r["prediction"]), n - 1 - classes.index(r["label"])
        d.box(i, i + 1, j, j + 1, shade(r["n"] / most))
        d.text(d.px(i + 0.5), d.py(j + 0.5), f"{r['label']} as {r['prediction']}: {r['n']}", size=11)
    return d.svg()


def lines(rows: list, title: str, x: str, y: str, by: str, at: str, value: str) -> str:
    """One line for each value of `by`, and points on it."""
    series: dict = {}
    for r in rows:
        series.setdefault(r[by], []).append((float(r[at]), float(r[value] or 0.0)))
    xs, ys = [p[0] for s in series.values() for p in s] or [0.0], [p[1] for s in series.values() for p in s] or [0.0]
    d = Drawing(title, x, y, (min(xs), max(xs)), (min(0.0, *ys), max(ys)))
    for i, (name, points) in enumerate(sorted(series.items())):
        d.line(sorted(points), ("#4682b4", "#c0392b", "#27ae60", "#8e44ad", "#e67e22")[i % 5])
        d.text(d.px(max(points)[0]) - 4, d.py(max(points)[1]) - 4, f"{by} {name}", size=10, anchor="end")
    return d.svg()


def timewalk_cells(clusters: DataFrame, bins: tuple[int, int] = (60, 80), most: float = 60.0) -> DataFrame:
    """(bin_x, bin_y, n, mean_tot): the time-walk scatter (pixels against the clipped delay, coloured by the mean charge) by cells."""
    rows = features.timewalk_points(clusters)
    cells = rows.select(bin_of(clip(F.col("n_pixels").cast("double"), 0.0, most), 0.0, most, bins[0]).alias("bin_x"), bin_of(F.col("dt_clipped"), -200.0, 2000.0, bins[1]).alias("bin_y"), "tot_mean")
    return cells.where("bin_x is not null and bin_y is not null").groupBy("bin_x", "bin_y").agg(F.count("*").alias("n"), F.round(F.avg("tot_mean"), 6).alias("mean_tot"))


def gap_cells(pulses: DataFrame, period: float, bins: tuple[int, int] = (100, 100)) -> tuple[DataFrame, tuple[float, float]]:
    """Gaps by time, by cells, and the times' range."""
    rows = edges.gap_sequence(pulses, period)
    low, high = rows.agg(F.min("time_ns"), F.max("time_ns")).first()
    low, high = low or 0.0, high or 1.0
    return histogram2d(rows, F.col("time_ns"), (low, max(high, low + 1), bins[0]), F.col("gap"), (0.0, 5 * period, bins[1])), (low, max(high, low + 1))


def draw(name: str, data: DataFrame, render: Callable[[list], str], folder: str, most: int = 50_000) -> DataFrame:
    """Writes a figure's data as JSON and its drawing as <folder>/figures/<name>.svg; data are small tables of bins or classes."""
    spark = data.sparkSession
    path = f"{folder}/figures/{name}.json"
    data.coalesce(1).write.mode("overwrite").json(path)
    kept = spark.read.schema(data.schema).json(path)
    rows = kept.limit(most).collect()
    write_text(spark, render(rows), f"{folder}/figures/{name}.svg")
    return kept


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file, wherever Spark's paths lead."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def all_figures(folder: str, period: float, pulses: DataFrame, clusters: DataFrame, model: mixture.Mixture, sweep: DataFrame | None = None, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every figure for which there is something to draw. `tables` may have counts, importances, confusion, network_confusion, reliability, saliency."""
    out, has = {}, tables.get

    def add(name: str, data: DataFrame, render: Callable[[list], str]) -> None:
        out[name] = draw(name, data, render, folder)

    add("edge_gaps", edges.gap_histogram(pulses, 0.0, 5 * period, 200), lambda r: bars(r, "Gaps between pulses", "gap (ns)", 0, 5 * period, 200))
    cells, (low, high) = gap_cells(pulses, period)
    add("edge_gaps_over_time", cells, lambda r: grid(r, "Gaps over time", "time (ns)", "gap (ns)", (low, high, 100), (0, 5 * period, 100)))
    if sweep is not None:
        add("clustering_sweep", sweep, lambda r: lines(r, "Clusters by settings", "dt (ns)", "clusters", "max_gap", "dt_ns", "n_clusters"))
    add("timewalk", features.timewalk_histogram(clusters), lambda r: bars(r, "Delay of the largest charge", "delay (ns)", -200, 2000, 100))
    add("timewalk_size", timewalk_cells(clusters), lambda r: grid(r, "Delay by size, shaded by mean charge", "pixels", "delay (ns)", (0, 60, 60), (-200, 2000, 80), "mean_tot", False))
    add("tof_spectrum", tof.spectrum(clusters, period), lambda r: bars(r, "Folded time of flight", "time (ns)", 0, period, 199))
    top = math.log1p(clusters.agg(F.max("tot_sum")).first()[0] or 1.0)
    add("tof_charge", tof.charge_map(clusters, period, top), lambda r: grid(r, "Time of flight and charge", "time (ns)", "log(1 + charge)", (0, period, 149), (0, top, 99)))
    hist, curve = mixture.fit_curve(clusters, model)
    points = [(p["x"], p["expected"]) for p in curve.collect()]  # a thousand points of the model
    add("labels_fit", hist, lambda r: bars(r, "Folded time and the fitted mixture", "time (ns)", 0, period, 199, points))
    add("labels_confidence", mixture.confidence_histogram(clusters), lambda r: bars(r, "Confidence of labels", "largest posterior", 0, 1, 50))
    for f in contamination.MORPHOLOGY:
        top_f = float(clusters.where("hard_label >= 0").agg(F.max(f)).first()[0] or 1.0)
        own = contamination.morphology_histograms(clusters, f, 0.0, top_f, 50)
        add(f"morphology_{f}", own, lambda r, f=f, t=top_f: lines([{"c": x["hard_label"], "at": (x["bin"] + 0.5) * t / 50, "n": x["n"]} for x in r], f"{f} by class", f, "count", "c", "at", "n"))
    if (t := has("importances")) is not None:
        value = "splits" if "splits" in t.columns else "importance"
        add("tree_importances", t, lambda r: named_bars([(x["feature"], float(x[value])) for x in sorted(r, key=lambda x: -x[value])], "Features of the trees", value))
    for name in ("confusion", "network_confusion"):
        if (t := has(name)) is not None:
            add(f"{name}_matrix", t, lambda r, n=name: matrix(r, "Labels and predictions" + (" of the network" if n != "confusion" else "")))
    if (t := has("reliability")) is not None:
        add("network_reliability", t, lambda r: lines([{"s": "network", "at": x["mean_confidence"], "v": x["accuracy"]} for x in r] + [{"s": "exact", "at": v, "v": v} for v in (0.0, 1.0)], "Accuracy by confidence", "confidence", "accuracy", "s", "at", "v"))
    if (t := has("saliency")) is not None:
        for c in [r[0] for r in t.select("class").distinct().orderBy("class").collect()]:  # a row for each class
            own = t.where(F.col("class") == c)
            size = math.isqrt(own.count())
            add(f"network_saliency_{c}", own.select((F.col("cell") % size).alias("bin_x"), F.floor(F.col("cell") / size).cast("int").alias("bin_y"), "ch0"), lambda r, c=c, n=size: grid(r, f"Saliency of class {c}", "x", "y", (0, n, n), (0, n, n), "ch0", False))
    return out

