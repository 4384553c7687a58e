"""Clusters of a live stream of hits.

A hit's time in ns becomes a timestamp of as many microseconds (and a second more), so no resolution of whole ns is lost. Each tile (a detector, a
chip, or a field of pixels) has state of its own: hits that the watermark has not passed, and the open footprints: the pixels, first
and last time, count and charge of each open cluster. Hits below the watermark are final; they are folded in time order, clusters that no later
hit can join are given out, and a timer wakes the tile when the watermark reaches its next hit or closing time. So the state is bounded by
the flux within the allowed lateness and by the pixels of a tile, however long a cluster lives.

Where clusters cross from tile to tile, `stream_fragments` gives each tile's clusters as fragments, with the first time of each of
their pixels, and `join_fragments` joins those of a sensor. That is exact: a fragment lies within one cluster (what a tile
joins, the sensor joins), it is alive from its first to its last time plus the reach, and what ties two fragments is a first touch of one of them
beside a pixel of the other's cluster while that is alive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import SLICE_NS, require, runs
from ..operators.clustering import _labels, clusters

HORIZON_NS = 200_000
#: Setting that keyed state with timers needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_MS = 1000  # units of time (ns, as microseconds) in a millisecond of the watermark
_ZERO = 1_000_000  # a stream's watermark begins at timestamp 0, and a hit at time 0 must lie above it


class OpenFootprints(StatefulProcessor):
    """The state of one tile."""

    def __init__(self, dt: float, d: int, chain: bool, fragments: bool):
        self.dt, self.d, self.chain, self.fragments = dt, d, chain, fragments

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "t double, x int, y int, tot long")
        self.clusters = handle.getListState("clusters", "edge double, t_min double, x0 int, y0 int, t_max double, n long, tot long")
        self.pixels = handle.getListState("pixels", "x int, y int, c int")
        self.touches = handle.getListState("touches", "c int, t double, x int, y int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            new = list(zip(part["time_ns"].astype(float).tolist(), part["x_pix"].astype(int).tolist(), part["y_pix"].astype(int).tolist(), part["tot"].fillna(0).astype(int).tolist(), strict=True))
            if new:
                self.pending.appendList(new)
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * _MS - _ZERO)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * _MS - _ZERO)

    def _advance(self, key, now: float) -> Iterator[pd.DataFrame]:
        """Fold all hits before `now`, give out what is closed, keep the rest."""
        hits = [tuple(h) for h in self.pending.get()] if self.pending.exists() else []
        final, later = sorted((h for h in hits if h[0] < now), key=lambda h: h[:3]), [h for h in hits if h[0] >= now]
        open_ = [tuple(c) for c in self.clusters.get()] if self.clusters.exists() else []
        pixels = [tuple(p) for p in self.pixels.get()] if self.pixels.exists() else []
        touched = [tuple(p) for p in self.touches.get()] if self.touches.exists() else []
        t, x, y = (np.array([h[i] for h in final], kind) for i, kind in ((0, np.float64), (1, np.int64), (2, np.int64)))
        carried = ([c[0] for c in open_], *([p[i] for p in pixels] for i in range(3)))
        roots, left = _labels(x, y, t, self.dt, self.d, self.chain, carried)
        every, first = {}, {}
        for r, (edge, *own) in zip(roots.tolist(), [*open_, *((h[0], h[0], h[1], h[2], h[0], 1, h[3]) for h in final)], strict=True):
            e = every.get(r)
            if e is None:
                every[r] = [edge, *own]
            else:
                e[0] = max(e[0], edge) if self.chain else min(e[0], edge)
                e[1], e[2], e[3] = min(tuple(e[1:4]), tuple(own[:3]))
                e[4], e[5], e[6] = max(e[4], own[3]), e[5] + own[4], e[6] + own[5]
        if self.fragments:
            for c, *touch in touched:
                first.setdefault(int(roots[c]), {}).setdefault((touch[1], touch[2]), touch[0])
            for r, h in zip(roots[len(open_) :].tolist(), final, strict=True):
                first.setdefault(r, {}).setdefault((h[1], h[2]), h[0])
        # No hit to come is before `now`, so none can join a cluster whose edge is further back than the reach.
        kept = {r: i for i, r in enumerate(r for r, e in every.items() if now - e[0] <= self.dt)}
        self._keep(self.pending, later)
        self._keep(self.clusters, [tuple(every[r]) for r in kept])
        self._keep(self.pixels, [(px, py, kept[r]) for (px, py), (r, _) in left.items() if r in kept])
        self._keep(self.touches, [(i, at, px, py) for r, i in kept.items() for (px, py), at in first.get(r, {}).items()])
        wake = [h[0] for h in later] + [every[r][0] + self.dt for r in kept]
        if wake:
            self.handle.registerTimer(int((min(wake) + _ZERO) // _MS) + 1)
        done = [(r, e) for r, e in every.items() if r not in kept]
        if done:
            out = {k: [v] * len(done) for k, v in zip(self.names, key, strict=True)}
            out |= {"t_min": [e[1] for _, e in done], "x0": [e[2] for _, e in done], "y0": [e[3] for _, e in done], "t_max": [e[4] for _, e in done], "n_pixels": [e[5] for _, e in done], "tot_sum": [e[6] for _, e in done]}
            if self.fragments:
                out["touches"] = [[{"t": at, "x": px, "y": py} for (px, py), at in first[r].items()] for r, _ in done]
            yield pd.DataFrame(out)

    def _keep(self, state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


CLUSTER = "t_min double, x0 int, y0 int, t_max double, n_pixels long, tot_sum long"


def _stream(hits: DataFrame, keys: list[str], dt_ns: float, max_gap: int, chain: bool, late_ns: int, fragments: bool) -> DataFrame:
    rows = hits.where("time_ns is not null and x_pix is not null and y_pix is not null")
    if not keys:
        rows, keys = rows.withColumn("tile", F.lit(0)), ["tile"]
    rows = rows.withColumn("ts", F.timestamp_micros(F.floor("time_ns").cast("long") + _ZERO)).withWatermark("ts", f"{late_ns} microseconds")
    state = OpenFootprints(float(dt_ns), max_gap + 1, chain, fragments)
    state.names = keys
    shape = ", ".join([f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys] + [CLUSTER] + ["touches array<struct<t:double,x:int,y:int>>"] * fragments)
    return rows.select(*keys, "time_ns", "x_pix", "y_pix", "tot", "ts").groupBy(*keys).transformWithStateInPandas(state, outputStructType=shape, outputMode="Append", timeMode="EventTime")


def stream_clusters(hits: DataFrame, dt_ns: float = 2000, max_gap: int = 0, time_criterion: str = "chain", late_ns: int = HORIZON_NS, tile: str | None = None) -> DataFrame:
    """([tile,] t_min, x0, y0, t_max, n_pixels, tot_sum) of each cluster, in append mode, once the watermark has passed its reach.

    Hits that come more than late_ns late are dropped by the watermark. `tile` names the column of a detector (or chip) that no
    cluster crosses; it splits the state over tasks. Without one a stream is one tile. Of equal first times, the
    smallest place is (x0, y0); null charges count as 0. A bounded input gives the same rows by the way of `clustering.clusters`. Streams need STATE_STORE.
    """
    keys = [tile] if tile else []
    if hits.isStreaming:
        out = _stream(hits, keys, dt_ns, max_gap, time_criterion == "chain", late_ns, False)
        return out if tile else out.drop("tile")
    rows = hits.where("time_ns is not null and x_pix is not null and y_pix is not null")
    if tile:  # tiles of a bounded input side by side, too far apart to touch; a table of one row per detector
        number = F.broadcast(rows.select(tile).distinct().select(F.col(tile).alias("_tile"), (F.row_number().over(_by(tile)) - 1).alias("_n")))
        rows = rows.join(number, F.col(tile).eqNullSafe(F.col("_tile"))).withColumn("x_pix", F.col("x_pix").cast("int") + F.col("_n") * _APART)
    out = clusters(rows, float(dt_ns), max_gap, time_criterion, 0.0).select("t_min", "x0", "y0", "t_max", "n_pixels", "tot_sum")
    if tile:
        at = F.floor(F.col("x0") / _APART).cast("int")
        out = out.withColumn("_at", at).join(number, F.col("_at") == F.col("_n")).select(F.col("_tile").alias(tile), "t_min", (F.col("x0") - F.col("_n") * _APART).alias("x0"), "y0", "t_max", "n_pixels", "tot_sum")
    return out


_APART = 1 << 16


def _by(tile: str):
    from pyspark.sql import Window

    return Window.orderBy(tile)


def stream_fragments(hits: DataFrame, field: int = 64, dt_ns: float = 2000, max_gap: int = 0, late_ns: int = HORIZON_NS, detector: str | None = None) -> DataFrame:
    """The clusters of each field of `field` by `field` pixels of a sensor, as fragments for `join_fragments`: its rows in append mode.

    Fields spread one sensor's stream over tasks. Only time_criterion "chain" can be joined afterwards.
    """
    rows = hits.withColumns({"field_x": F.floor(F.col("x_pix") / field).cast("int"), "field_y": F.floor(F.col("y_pix") / field).cast("int")})
    return _stream(rows, [*([detector] if detector else []), "field_x", "field_y"], dt_ns, max_gap, True, late_ns, True)


def _join(table: pa.Table, dt: float, d: int) -> pa.Table:
    """Clusters of one run of fragments: their first touches in time order, each fragment a node from the start."""
    t_min, x0, y0, t_max, n, tot = (table[c].to_pylist() for c in ("t_min", "x0", "y0", "t_max", "n_pixels", "tot_sum"))
    events = sorted((p["t"], p["x"], p["y"], f) for f, touches in enumerate(table["touches"].to_pylist()) for p in touches)
    parent, last = list(range(len(n))), list(t_max)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    cells: dict[tuple[int, int], dict[tuple[int, int], int]] = {}
    for t, x, y, f in events:
        for u in (x // d - 1, x // d, x // d + 1):
            for v in (y // d - 1, y // d, y // d + 1):
                cell = cells.get((u, v))
                for (px, py), j in list(cell.items()) if cell else ():
                    r = root(j)
                    if t - last[r] > dt:
                        del cell[px, py]
                    elif abs(px - x) <= d and abs(py - y) <= d and r != (own := root(f)):
                        parent[r] = own
                        last[own] = max(last[own], last[r])
        cells.setdefault((x // d, y // d), {})[x, y] = f
    out: dict[int, list] = {}
    for i in range(len(n)):
        e = out.setdefault(root(i), [(t_min[i], x0[i], y0[i]), t_max[i], 0, 0])
        e[0], e[1], e[2], e[3] = min(e[0], (t_min[i], x0[i], y0[i])), max(e[1], t_max[i]), e[2] + n[i], e[3] + tot[i]
    rows = [(*e[0], *e[1:]) for e in out.values()]
    kinds = (pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["t_min", "x0", "y0", "t_max", "n_pixels", "tot_sum"])


def join_fragments(fragments: DataFrame, dt_ns: float = 2000, max_gap: int = 0, detector: str | None = None, slice_ns: float = SLICE_NS) -> DataFrame:
    """([detector,] t_min, x0, y0, t_max, n_pixels, tot_sum) of each cluster of the whole sensor, from a bounded table of closed fragments.

    Fragments whose lives are further apart than the reach are in no common cluster; each run of lives that are not is a group.
    """
    keys = [detector] if detector else []
    rows = require(fragments, {"t_min", "t_max", "touches", *keys}, "fragments")
    # A life is its first and last times and, where these are far apart, times in between: one for each reach.
    inner = F.transform(F.sequence(F.lit(0), F.floor((F.col("t_max") - F.col("t_min")) / F.lit(float(dt_ns))).cast("int")), lambda i: F.col("t_min") + i * F.lit(float(dt_ns)))
    rows = rows.withColumn("id", F.struct("t_min", "x0", "y0"))
    lives = rows.select(*keys, "id", F.explode(F.array_append(inner, F.col("t_max"))).alias("at")).distinct()
    begins = runs(lives, "at", float(dt_ns), "begin", slice_ns, *keys).groupBy(*keys, "id").agg(F.min("begin").alias("begin"))
    shape = ", ".join([f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys] + [CLUSTER])

    def one(key: tuple, table: pa.Table) -> pa.Table:
        out = _join(table, float(dt_ns), max_gap + 1)
        for k, value in zip(keys, key, strict=False):
            out = out.add_column(0, k, pa.array([value.as_py()] * len(out), value.type))
        return out

    return rows.join(begins, [*keys, "id"]).groupBy(*keys, "begin").applyInArrow(one, shape)
