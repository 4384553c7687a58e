"""Spatio-temporal clustering of hits.

A hit joins every cluster that has a pixel within `max_gap + 1` (Chebyshev) and is eligible in
time: `chain` counts from the cluster's last hit, `min` from its first. Clusters that a hit joins
merge. Eligibility belongs to clusters, not to pairs of hits, so components of a pair graph would be
wrong. A gap above the reach between consecutive hits (of any pixel) cuts the time line into
epochs that no cluster crosses. Hits are shuffled once, by blocks of time (slices, put together where they are sparse and divided where
they are dense). A vectorised pass settles the epochs inside a block (`_settled`); only those at its ends go further, dealt by the slice in
which they begin. An epoch with more than `LARGE` hits is split further, in turn by
the connected components of its pixels (whatever their times) and by gaps above the reach within a
component, until its parts are small or nothing changes: no cluster crosses either cut. What stays connected is dealt strip by strip
of time, and strips hand on their open clusters (`_over_strips`).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import SLICE_NS, components, require, runs, saved

LARGE = 200_000
ROUNDS = 8


def _placed(hits: DataFrame) -> DataFrame:
    return require(hits, {"x_pix", "y_pix", "time_ns"}, "clustering").where("time_ns is not null and x_pix is not null and y_pix is not null")


def epochs(hits: DataFrame, dt_ns: float, slice_ns: float = SLICE_NS) -> DataFrame:
    """Adds epoch: the time of the first hit of the row's epoch. Hits without a time or place go."""
    return runs(_placed(hits), "time_ns", dt_ns, "epoch", slice_ns)


def _labels(x: np.ndarray, y: np.ndarray, t: np.ndarray, dt: float, d: int, chain: bool, carried: tuple | None = None) -> tuple[np.ndarray, dict]:
    """A cluster label for each time-ordered hit, and the pixels of open footprints with their labels.

    `carried` has clusters that were open before: (edge of each, x, y and number of each pixel), where the edge is the last time for
    `chain` and the first for `min`. They are the labels 0, 1, ...; the hits follow. The open footprints are kept per cell of a coarse grid.
    """
    edge0, px0, py0, c0 = carried or ((), (), (), ())
    k, n = len(edge0), len(edge0) + len(t)
    parent, edge = list(range(n)), [*edge0, *t.tolist()]
    xs, ys = x.tolist(), y.tolist()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    cells: dict[tuple[int, int], dict[tuple[int, int], int]] = {}
    for px, py, c in zip(px0, py0, c0, strict=True):
        cells.setdefault((px // d, py // d), {})[px, py] = c
    for i in range(k, n):
        hx, hy, now = xs[i - k], ys[i - k], edge[i]
        cx, cy, joined = hx // d, hy // d, set()
        for u in (cx - 1, cx, cx + 1):
            for v in (cy - 1, cy, cy + 1):
                cell = cells.get((u, v))
                for (px, py), j in list(cell.items()) if cell else ():
                    r = root(j)
                    if now - edge[r] > dt:
                        del cell[px, py]  # it closed for good
                    elif abs(px - hx) <= d and abs(py - hy) <= d:
                        joined.add(r)
        for r in joined:
            parent[r] = i
            if not chain:
                edge[i] = min(edge[i], edge[r])
        cells.setdefault((cx, cy), {})[hx, hy] = i
    roots = np.array([root(i) for i in range(n)], np.int64)
    return roots, {p: (int(roots[j]), edge[roots[j]]) for cell in cells.values() for p, j in cell.items()}


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches by the links a - b."""
    low = np.arange(n)
    while True:
        x, y = low[a], low[b]
        if (open_ := x != y).sum() == 0:
            return low
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (further := low[low]).tobytes() != low.tobytes():
            low = further


def _heads(x: np.ndarray, y: np.ndarray, t: np.ndarray, reach: float, d: int, chain: bool) -> np.ndarray:
    """The place of the first hit of the cluster of each hit; hits come in the order of time, then place.

    Rounds of cuts, over arrays: hits are cut at gaps above the reach, and these runs into islands of touching pixels, whose hits are
    the runs of the next round. A run that is one island is one cluster if it lasts no longer than the reach, or (`chain`) if each of its
    pixels is first hit beside one hit before. What is neither goes through `_labels` hit by hit.
    """
    head, todo, part, rest = np.arange(len(t)), np.arange(len(t)), np.zeros(len(t), np.int64), []
    low_x, low_y = (int(c.min()) if len(t) else 0 for c in (x, y))
    high, wide = (int(c.max()) - low + 1 + d if len(t) else 1 for c, low in ((y, low_y), (x, low_x)))  # d empty pixels part columns and runs
    place = (x.astype(np.int64) - low_x) * high + (y.astype(np.int64) - low_y)
    for _ in range(ROUNDS if high * wide * (len(t) + 1) < 1 << 62 else 0):
        if not len(todo):
            break
        order = np.argsort(part, kind="stable")
        todo, part = todo[order], part[order]
        at = t[todo]
        begins = np.r_[True, (part[1:] != part[:-1]) | (at[1:] - at[:-1] > reach)]
        run, first = np.cumsum(begins) - 1, np.flatnonzero(begins)
        pixels, seen, own = np.unique(run * (high * wide) + place[todo], return_index=True, return_inverse=True)
        near = np.flatnonzero(pixels[1:] - pixels[:-1] <= d)
        a, b = [near], [near + 1]
        for column in range(1, d + 1):  # of the pixels within reach in a column, all are linked to the lowest or the highest
            low, top = np.searchsorted(pixels, pixels + (column * high - d)), np.searchsorted(pixels, pixels + (column * high + d), "right") - 1
            one, two = np.flatnonzero(low <= top), np.flatnonzero(low < top)
            a, b = [*a, one, two], [*b, low[one], top[two]]
        a, b = np.concatenate(a), np.concatenate(b)
        island, of = _joined(len(pixels), a, b), run[seen]
        alone = np.bincount(of[island == np.arange(len(pixels))], minlength=len(first)) == 1
        whole = at[np.r_[first[1:], len(at)] - 1] - at[first] <= reach
        if chain:
            before = seen.copy()
            np.minimum.at(before, a, seen[b])
            np.minimum.at(before, b, seen[a])
            whole |= np.bincount(of, (before == seen) & (seen != first[of]), len(first)) == 0
        done = (alone & whole)[run]
        head[todo[done]] = todo[first[run[done]]]
        rest.append(todo[(alone & ~whole)[run]])
        left = ~alone[run]
        todo, part = todo[left], island[own[left]]
    rest = np.sort(np.concatenate([*rest, todo]))
    if len(rest):
        _, first, own = np.unique(_labels(x[rest], y[rest], t[rest], reach, d, chain)[0], return_index=True, return_inverse=True)
        head[rest] = rest[first[own]]
    return head


def _islands(table: pa.Table, d: int) -> pa.Table:
    """Connected components of one part's distinct pixels (no more than the sensor has)."""
    x, y = np.asarray(table["x"]), np.asarray(table["y"])
    number = {p: i for i, p in enumerate(zip(x.tolist(), y.tolist(), strict=True))}
    island = np.full(len(x), -1)
    for first in range(len(x)):
        if island[first] >= 0:
            continue
        island[first], todo = first, [first]
        while todo:
            i = todo.pop()
            for u in range(x[i] - d, x[i] + d + 1):
                for v in range(y[i] - d, y[i] + d + 1):
                    j = number.get((u, v))
                    if j is not None and island[j] < 0:
                        island[j] = first
                        todo.append(j)
    return pa.table({"part": table["part"], "x": table["x"], "y": table["y"], "island": island.astype(np.int32)})


def _split(rows: DataFrame, reach: float, d: int, slice_ns: float) -> DataFrame:
    """Rows (epoch, t, x, y, ...) of large epochs with a column part, within which all their clusters lie."""
    rows = rows.withColumn("part", F.xxhash64("epoch"))
    before = None
    for _ in range(ROUNDS):
        islands = rows.select("part", "x", "y").distinct().groupBy("part").applyInArrow(lambda t: _islands(t, d), "part long, x int, y int, island int")
        rows = rows.join(islands, ["part", "x", "y"]).withColumn("part", F.xxhash64("part", "island")).drop("island")
        rows = runs(rows, "t", reach, "begin", slice_ns, "part").withColumn("part", F.xxhash64("part", "begin")).drop("begin")
        rows = saved(rows)
        now = rows.groupBy("part").count().agg(F.count("*"), F.max("count")).first()
        if now == before or now[1] <= LARGE:
            break
        before = now
    return rows


def _cluster(table: pa.Table, reach: float, d: int, chain: bool) -> pa.Table:
    """The hits of one group with the first hit (in time, then place) of each one's cluster."""
    table = table.sort_by([("t", "ascending"), ("x", "ascending"), ("y", "ascending")])
    x, y, t = (np.asarray(table[c]) for c in "xyt")
    head = _heads(x, y, t, reach, d, chain)
    return pa.table({**{c: table[c] for c in ("t", "x", "y", "tot", "key")}, "t0": t[head], "x0": x[head], "y0": y[head], "head": head == np.arange(len(t))})


def _strips(rows: DataFrame) -> DataFrame:
    """Adds strip: numbers of consecutive spans of a part's time with about LARGE hits each (hits of 1/8 of that stay together)."""
    span = rows.groupBy("part").agg(F.min("t").alias("low"), F.max("t").alias("high"), (F.ceil(F.count("*") / LARGE) * 8).alias("bins"))
    width = F.greatest((F.col("high") - F.col("low")) / F.col("bins"), F.lit(1e-9))
    rows = rows.join(span, "part").withColumn("bin", F.floor((F.col("t") - F.col("low")) / width).cast("long")).drop("low", "high", "bins")
    by_bin = Window.partitionBy("part").orderBy("bin")  # over bins: 8 for each LARGE hits of a part
    before = rows.groupBy("part", "bin").agg(F.count("*").alias("n")).withColumn("full", F.floor((F.sum("n").over(by_bin) - F.col("n")) / LARGE))
    before = before.select("part", "bin", (F.dense_rank().over(Window.partitionBy("part").orderBy("full")) - 1).cast("int").alias("strip"))
    return rows.join(before, ["part", "bin"]).drop("bin")


OPEN = "part long, strip int, cx int, cy int, x int, y int, edge double"


def _strip_pass(left: pa.Table, right: pa.Table, reach: float, d: int, chain: bool) -> tuple[pa.Table, np.ndarray, dict, list, int]:
    """Labels of a strip's hits, given the clusters that the strip before left open (named by their smallest pixel)."""
    left = left.sort_by([("t", "ascending"), ("x", "ascending"), ("y", "ascending")])
    x, y, t = (np.asarray(left[c]) for c in "xyt")
    rows = list(zip(*(right[c].to_pylist() for c in ("cx", "cy", "x", "y", "edge")), strict=True))
    names = sorted({r[:2] for r in rows})
    number, edge = {name: i for i, name in enumerate(names)}, [0.0] * len(names)
    for r in rows:
        edge[number[r[:2]]] = r[4]
    carried = (edge, [r[2] for r in rows], [r[3] for r in rows], [number[r[:2]] for r in rows])
    roots, open_ = _labels(x, y, t, reach, d, chain, carried)
    end = t[-1] if len(t) else -np.inf
    return left, roots, {p: v for p, v in open_.items() if end - v[1] <= reach}, names, len(names)


def _open_rows(open_: dict) -> tuple[dict, list[tuple]]:
    """The name (smallest pixel) of each open cluster, and (cx, cy, x, y, edge) of each pixel."""
    name: dict[int, tuple[int, int]] = {}
    for p, (r, _) in open_.items():
        name[r] = min(name.get(r, p), p)
    return name, [(*name[r], *p, e) for p, (r, e) in open_.items()]


def _over_strips(rows: DataFrame, reach: float, d: int, chain: bool) -> DataFrame:
    """`_cluster`'s columns for connected parts (rows with part, t, x, y, tot, key) that are dealt to tasks strip by strip.

    A strip's result depends on the clusters that the strip before leaves open. Every strip runs at once without any; then those whose
    inherited clusters turned out otherwise run again, until nothing changes. Clusters are short beside strips, so two or three rounds do. If one
    outlasts `ROUNDS` strips, neighbouring strips are put together and the rounds begin anew: at most ROUNDS passes for each
    doubling. At the end the clusters on both sides of a border become one.
    """
    rows = saved(_strips(rows))
    while True:
        strips = saved(rows.groupBy("part", "strip").agg(F.count("*").alias("hits")))  # a row for each LARGE hits

        def left_open(at: DataFrame, inherited: DataFrame) -> DataFrame:
            def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
                if not left.num_rows:
                    return pa.table({c: pa.array([], k) for c, k in zip(("part", "strip", "cx", "cy", "x", "y", "edge"), (pa.int64(), *[pa.int32()] * 5, pa.float64()), strict=True)})
                _, own = _open_rows(_strip_pass(left, right, reach, d, chain)[2])
                n, column = len(own), lambda i, k: pa.array([r[i] for r in own], k)
                return pa.table({"part": pa.array([key[0].as_py()] * n, pa.int64()), "strip": pa.array([key[1].as_py()] * n, pa.int32()), **{c: column(i, pa.int32()) for i, c in enumerate(("cx", "cy", "x", "y"))}, "edge": column(4, pa.float64())})

            return at.groupBy("part", "strip").cogroup(inherited.groupBy("part", "strip")).applyInArrow(run, OPEN)

        none = rows.sparkSession.createDataFrame([], OPEN)
        now, marks, settled = saved(left_open(rows, none)), None, False
        for _ in range(ROUNDS):
            inherited = now.withColumn("strip", F.col("strip") + 1)
            mark = inherited.groupBy("part", "strip").agg(F.sum(F.xxhash64("cx", "cy", "x", "y", "edge").cast("decimal(38,0)")).alias("mark"))
            mark = saved(strips.join(mark, ["part", "strip"], "left").select("part", "strip", F.coalesce("mark", F.lit(0).cast("decimal(38,0)")).alias("mark")))
            changed = mark.where("mark <> 0") if marks is None else mark.join(marks.withColumnRenamed("mark", "was"), ["part", "strip"]).where("mark <> was")
            changed, marks = saved(changed.select("part", "strip")), mark
            if not changed.take(1):
                settled = True
                break
            again = left_open(rows.join(changed, ["part", "strip"], "left_semi"), inherited.join(changed, ["part", "strip"], "left_semi"))
            now = saved(now.join(changed, ["part", "strip"], "left_anti").unionByName(again))
        if settled:
            break
        rows = saved(rows.withColumn("strip", F.floor(F.col("strip") / 2).cast("int")))
    inherited = now.withColumn("strip", F.col("strip") + 1)

    def label(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        part, strip = key[0].as_py(), key[1].as_py()
        hits, roots, open_, names, k = _strip_pass(left, right, reach, d, chain)
        name, _ = _open_rows(open_)
        own, (x, y, t) = roots[k:], (np.asarray(hits[c]) for c in "xyt")
        _, first, at = np.unique(own, return_index=True, return_inverse=True)
        head, n = first[at], len(own)
        first_of = {int(own[f]): f for f in first}
        border = {int(roots[i]): f"{part}|{strip - 1}|{c}" for i, c in enumerate(names)}
        # A link ties a cluster of this strip to a border it crosses, or two borders where a cluster had no hit between.
        links = [(int(roots[i]), f"{part}|{strip - 1}|{c}") for i, c in enumerate(names)] + [(r, f"{part}|{strip}|{c}") for r, c in name.items()]
        links = [(first_of.get(r), border.get(r, b), b) for r, b in links]
        cells = lambda values, more, kind: pa.array([*values, *more], kind)
        m = len(links)
        heads = [(None, None, None) if f is None else (float(t[f]), int(x[f]), int(y[f])) for f, _, _ in links]
        return pa.table({
            **{c: pa.concat_arrays([hits[c].combine_chunks() if isinstance(hits[c], pa.ChunkedArray) else hits[c], pa.nulls(m, hits[c].type)]) for c in ("t", "x", "y", "tot", "key")},
            "t0": cells(t[head].tolist(), [h[0] for h in heads], pa.float64()), "x0": cells(x[head].tolist(), [h[1] for h in heads], pa.int32()), "y0": cells(y[head].tolist(), [h[2] for h in heads], pa.int32()),
            "head": cells((head == np.arange(n)).tolist(), [False] * m, pa.bool_()), "part": pa.array([part] * (n + m), pa.int64()), "strip": pa.array([strip] * (n + m), pa.int32()),
            "a": cells([None] * n, [f"{part}/{strip}/{h}" if h[0] is not None else a for (_, a, _), h in zip(links, heads, strict=True)], pa.string()), "b": cells([None] * n, [b for _, _, b in links], pa.string()),
        })

    columns = "t double, x int, y int, tot int, key string, t0 double, x0 int, y0 int, head boolean, part long, strip int, a string, b string"
    found = saved(rows.groupBy("part", "strip").cogroup(inherited.join(strips, ["part", "strip"], "left_semi").groupBy("part", "strip")).applyInArrow(label, columns))
    links, hits = found.where("b is not null"), found.where("b is null").drop("a", "b")
    whole = components(links, "a", "b")
    at = ["part", "strip", "t0", "x0", "y0"]
    crossing = links.where("t0 is not null").select(*at, "a").distinct().join(whole.withColumnRenamed("node", "a"), "a")
    first = crossing.groupBy("component").agg(F.min(F.struct("t0", "x0", "y0")).alias("first"))
    moved = crossing.join(first, "component").select(*at, "first")
    hits = hits.join(moved, at, "left")
    own = F.col("first").isNull() | ((F.col("first.t0") == F.col("t0")) & (F.col("first.x0") == F.col("x0")) & (F.col("first.y0") == F.col("y0")))
    return hits.select("t", "x", "y", "tot", "key", *(F.coalesce(F.col(f"first.{c}"), F.col(c)).alias(c) for c in ("t0", "x0", "y0")), (F.col("head") & own).alias("head"))


COLUMNS = ["t", "x", "y", "tot", "key"]


def _rows(hits: DataFrame) -> DataFrame:
    key = F.col("given_id").cast("string") if "given_id" in hits.columns else F.lit(None).cast("string")
    tot = F.col("tot").cast("int") if "tot" in hits.columns else F.lit(None).cast("int")
    return _placed(hits).select(F.col("time_ns").cast("double").alias("t"), F.col("x_pix").cast("int").alias("x"), F.col("y_pix").cast("int").alias("y"), tot.alias("tot"), key.alias("key"))


def _deal(rows: DataFrame, reach: float, d: int, slice_ns: float) -> tuple[DataFrame, DataFrame | None]:
    """Hits (t, x, y, tot, key) in groups (g, h) that no cluster of this reach and distance or less crosses, and
    the hits of connected parts above LARGE, if any, with their part."""
    if rows.count() <= LARGE:
        return rows.select(F.lit(0).cast("long").alias("g"), F.lit(0).alias("h"), *COLUMNS), None
    rows = saved(runs(rows, "t", reach, "epoch", slice_ns))
    begins = F.floor(F.col("epoch") / F.lit(slice_ns)).cast("long")
    sizes = rows.groupBy("epoch").count()
    large = sizes.where(F.col("count") > LARGE).select("epoch")
    n_large = large.count()
    large = F.broadcast(large) if n_large < 100_000 else large
    slices = sizes.groupBy(begins.alias("g")).agg(F.ceil(F.sum("count") / LARGE).cast("int").alias("parts"))
    dealt = rows.join(large, "epoch", "left_anti").withColumn("g", begins).join(slices, "g").select("g", F.pmod(F.xxhash64("epoch"), F.col("parts")).cast("int").alias("h"), *COLUMNS)
    if not n_large:
        return dealt, None
    split = _split(rows.join(large, "epoch"), reach, d, slice_ns).select("part", *COLUMNS)
    connected = saved(split.groupBy("part").count().where(F.col("count") > LARGE).select("part"))
    small = split.join(connected, "part", "left_anti").select(F.col("part").alias("g"), F.lit(-1).alias("h"), *COLUMNS)
    return dealt.unionByName(small), split.join(connected, "part", "left_semi") if connected.take(1) else None


def _blocks(rows: DataFrame, reach: float, slice_ns: float) -> tuple[Callable[[DataFrame, str], DataFrame], DataFrame | None, DataFrame]:
    """A function that adds the block (g, h) of a time to a table, in the order of time; the rows with blocks of at most LARGE hits, if
    the table is larger than one; and the other rows. Blocks are of about LARGE / 4 hits, or of a slice where there are few."""
    at = lambda c: F.floor(F.col(c) / F.lit(slice_ns)).cast("long")
    sizes = saved(rows.groupBy(at("t").alias("g")).agg(F.count("*").alias("n")))  # a row for each slice
    n, slices, most = sizes.agg(F.sum("n"), F.count("*"), F.max("n")).first()
    together = max(1, min(slices * LARGE // (4 * (n or 1)), slices // (4 * rows.sparkSession.sparkContext.defaultParallelism)))
    if (n or 0) <= LARGE or reach < 0 or most * together <= LARGE:

        def plain(df: DataFrame, c: str) -> DataFrame:
            return df.withColumns({"g": F.floor(at(c) / together).cast("long"), "h": F.lit(0)})

        return (plain, None, rows) if (n or 0) <= LARGE or reach < 0 else (plain, plain(rows, "t"), rows.where("false"))
    parts = sizes.where(F.col("n") > LARGE // 4).select("g", F.ceil(F.col("n") * 4 / LARGE).alias("parts"))

    def divided(df: DataFrame, c: str) -> DataFrame:
        df = df.withColumn("g", at(c)).join(parts, "g", "left")
        within = F.floor((F.col(c) / F.lit(slice_ns) - F.col("g")) * F.coalesce("parts", F.lit(1)))
        return df.withColumn("h", within.cast("int")).drop("parts")

    dealt = divided(rows, "t")
    bursts = saved(dealt.groupBy("g", "h").count().where(F.col("count") > LARGE).select("g", "h"))
    return divided, dealt.join(bursts, ["g", "h"], "left_anti"), dealt.join(bursts, ["g", "h"], "left_semi").select(*COLUMNS)


def _settled(table: pa.Table, reach: float) -> tuple[pa.Table, pa.Table]:
    """The hits of a block in order: those of epochs that lie inside it, and those before its first and after its last gap."""
    table = table.sort_by([("t", "ascending"), ("x", "ascending"), ("y", "ascending")])
    cuts = np.flatnonzero(np.diff(np.asarray(table["t"])) > reach) + 1
    low, high = (int(cuts[0]), int(cuts[-1])) if len(cuts) > 1 else (0, 0)
    return table.slice(low, high - low), pa.concat_tables([table.slice(0, low), table.slice(high)])


def _shaped(own: dict, border: pa.Table, kinds: dict[str, pa.DataType], key: tuple) -> pa.Table:
    """Columns of what a block has settled, and below them its other hits, with nulls where one of them has no such column."""
    n, m = len(next(iter(own.values()))), border.num_rows
    names = {"g": key[0].as_py(), "h": key[1].as_py()}
    out = {}
    for c, kind in kinds.items():
        if c in names:
            out[c] = pa.array(np.full(n + m, names[c]), kind)
            continue
        above = own[c].cast(kind) if isinstance(own.get(c), pa.ChunkedArray) else pa.chunked_array([pa.array(own[c], kind) if c in own else pa.nulls(n, kind)])
        below = border[c].cast(kind) if c in border.column_names else pa.chunked_array([pa.nulls(m, kind)])
        out[c] = pa.chunked_array([*above.chunks, *below.chunks], kind)
    return pa.table(out)


_HIT = {"g": pa.int64(), "h": pa.int32(), "own": pa.int64(), "t": pa.float64(), "x": pa.int32(), "y": pa.int32(), "tot": pa.int64(), "key": pa.string()}
_CLUSTER = {k: v for k, v in _HIT.items()} | {"n": pa.int64(), "t_max": pa.float64()}
_SIZE = {k: v for k, v in _HIT.items() if k != "own"} | {"dt_ns": pa.float64(), "max_gap": pa.int32(), "n": pa.int64(), "w": pa.int64()}
_DDL = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.string(): "string"}


def _ddl(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{c} {_DDL[k]}" for c, k in kinds.items())


def _found(hits: DataFrame, reach: float, d: int, chain: bool, slice_ns: float, summed: bool) -> DataFrame:
    """cluster_id, t, x, y, tot, key of each hit; or `summed`, of each cluster, with its first hit's time and place, the sum of tot, n and t_max."""
    rows = _rows(hits)
    add, dealt, left = _blocks(rows, reach, slice_ns)
    inner = None
    if dealt is not None:

        def run(key: tuple, table: pa.Table) -> pa.Table:
            table, border = _settled(table, reach)
            x, y, t = (np.asarray(table[c]) for c in "xyt")
            head = _heads(x, y, t, reach, d, chain)
            first = head == np.arange(len(t))
            own = (np.cumsum(first) - 1)[head] if len(t) else head
            if not summed:
                return _shaped({"own": own, **{c: table[c] for c in COLUMNS}}, border, _HIT, key)
            heads, n, last = np.flatnonzero(first), np.bincount(own), np.full(int(first.sum()), -np.inf)
            np.maximum.at(last, own, t)
            tot = np.zeros(len(heads), np.int64)
            np.add.at(tot, own, np.asarray(table["tot"].cast(pa.int64()).fill_null(0)))
            return _shaped({"own": np.arange(len(heads)), "t": t[heads], "x": x[heads], "y": y[heads], "tot": tot, "n": n, "t_max": last}, border, _CLUSTER, key)

        done = saved(dealt.groupBy("g", "h").applyInArrow(run, _ddl(_CLUSTER if summed else _HIT)))
        inner = done.where("own is not null")
        left = left.unionByName(done.where("own is null").select("t", "x", "y", F.col("tot").cast("int").alias("tot"), "key"))
    groups, connected = _deal(left, reach, d, slice_ns)
    found = groups.groupBy("g", "h").applyInArrow(lambda t: _cluster(t, reach, d, chain), "t double, x int, y int, tot int, key string, t0 double, x0 int, y0 int, head boolean")
    if connected is not None:
        found = found.unionByName(_over_strips(connected, reach, d, chain))
    if summed:
        found = found.groupBy("t0", "x0", "y0").agg(F.sum(F.coalesce("tot", F.lit(0)).cast("long")).alias("tot"), F.count("*").alias("n"), F.max("t").alias("t_max"))
        found = found.select(F.lit(True).alias("head"), F.col("t0").alias("t"), F.col("x0").alias("x"), F.col("y0").alias("y"), "tot", F.lit(None).cast("string").alias("key"), "n", "t_max", "t0", "x0", "y0")
    found, at = add(found, "t0"), ["g", "h", "side"]
    if inner is not None:  # a block's clusters lie between those that begin before its first and after its last gap
        inside = inner.groupBy("g", "h").agg((F.max("own") + 1).alias("k"), F.min("t").alias("low"))
        found = found.join(inside.select("g", "h", "low"), ["g", "h"], "left").withColumn("side", F.when(F.col("t0") > F.col("low"), 2).otherwise(0)).drop("low")
        found = saved(found)
        sizes = found.where("head").groupBy(*at).agg(F.count("*").alias("k")).unionByName(inside.select("g", "h", F.lit(1).alias("side"), "k"))
    else:
        found = saved(found.withColumn("side", F.lit(0)))
        sizes = found.where("head").groupBy(*at).agg(F.count("*").alias("k"))
    before = saved(sizes.select(*at, (F.sum("k").over(Window.orderBy(*at)) - F.col("k")).alias("before")))  # three rows for each block at most
    own = F.dense_rank().over(Window.partitionBy(*at).orderBy("t0", "x0", "y0")) - 1
    columns = [(F.col("before") + F.col("own")).cast("long").alias("cluster_id"), *COLUMNS, *(["n", "t_max"] if summed else [])]
    out = found.withColumn("own", own).join(before, at).select(*columns)
    return out if inner is None else inner.join(F.broadcast(before.where("side = 1")), ["g", "h"]).select(*columns).unionByName(out)


def cluster_hits(hits: DataFrame, dt_ns: float = 2000.0, max_gap: int = 0, time_criterion: str = "chain", safety_margin_ns: float = 200.0, slice_ns: float = SLICE_NS) -> DataFrame:
    """(cluster_id, time_ns, x_pix, y_pix, tot, key) of every hit with a time and a place.

    Ids count from 0 in the order of the clusters' first time and, among equal times, first pixel.
    A margin below 0 shortens the reach; at 0 and above it has no effect. Any time_criterion other
    than "chain" counts from the first hit. `key` carries a column `given_id` of the hits as text
    (null without one). An empty table gives no rows.
    """
    reach, d, chain = dt_ns + min(0.0, safety_margin_ns), max_gap + 1, time_criterion == "chain"
    out = _found(hits, reach, d, chain, slice_ns, False)
    return out.select("cluster_id", F.col("t").alias("time_ns"), F.col("x").alias("x_pix"), F.col("y").alias("y_pix"), F.col("tot").cast("int").alias("tot"), "key")


def clusters(hits: DataFrame, dt_ns: float = 2000.0, max_gap: int = 0, time_criterion: str = "chain", safety_margin_ns: float = 200.0, slice_ns: float = SLICE_NS) -> DataFrame:
    """(cluster_id, n_pixels, t_min, t_max, x0, y0, tot_sum) of every cluster of `cluster_hits`, without a row for each hit. Null charges count as 0; of
    equal first times, the smallest place is (x0, y0)."""
    found = _found(hits.drop("given_id"), dt_ns + min(0.0, safety_margin_ns), max_gap + 1, time_criterion == "chain", slice_ns, True)
    return found.select("cluster_id", F.col("n").alias("n_pixels"), F.col("t").alias("t_min"), "t_max", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("tot").alias("tot_sum"))


def summary(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster_id").agg(F.count("*").alias("n_pixels"), F.min("time_ns").alias("t_min"), F.max("time_ns").alias("t_max"))


def sweep(hits: DataFrame, dt_values: list[float], gap_values: list[int], slice_ns: float = SLICE_NS) -> DataFrame:
    """(dt_ns, max_gap, n_clusters, mean_size, median_size, p95_size) for every pair of parameters, in one pass over the hits.

    Smaller parameters only divide clusters further, so the groups of the largest reach and gap serve all pairs: a task sorts
    its group once and folds it for each pair. Only connected parts above LARGE are folded pair by pair, over strips.
    """
    pairs = [(float(dt), int(gap)) for dt in dt_values for gap in gap_values]
    reach, d = max(dt for dt, _ in pairs), max(gap for _, gap in pairs) + 1

    def sizes(table: pa.Table) -> dict:
        x, y, t = (np.asarray(table[c]) for c in "xyt")
        out = []
        for dt, gap in pairs:
            n = np.bincount(_heads(x, y, t, dt, gap + 1, True))
            out += [(dt, gap, int(a), int(b)) for a, b in zip(*np.unique(n[n > 0], return_counts=True), strict=True)]
        return {c: [r[i] for r in out] for i, c in enumerate(("dt_ns", "max_gap", "n", "w"))}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table, border = _settled(table, reach)
        return _shaped(sizes(table), border, _SIZE, key)

    def rest(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("t", "ascending"), ("x", "ascending"), ("y", "ascending")])
        return _shaped(sizes(table), table.slice(0, 0), _SIZE, key)

    _, dealt, left = _blocks(_rows(hits.drop("given_id", "tot")), reach, slice_ns)
    done = None
    if dealt is not None:
        done = saved(dealt.groupBy("g", "h").applyInArrow(run, _ddl(_SIZE)))
        left = left.unionByName(done.where("w is null").select("t", "x", "y", F.col("tot").cast("int").alias("tot"), "key"))
    groups, connected = _deal(left, reach, d, slice_ns)
    columns = ["dt_ns", "max_gap", "n", "w"]
    counted = groups.groupBy("g", "h").applyInArrow(rest, _ddl(_SIZE)).select(*columns)  # a row for each size in each group
    if done is not None:
        counted = counted.unionByName(done.where("w is not null").select(*columns))
    for dt, gap in pairs if connected is not None else ():
        own = _over_strips(connected, dt, gap + 1, True).groupBy("t0", "x0", "y0").agg(F.count("*").alias("n"))
        counted = counted.unionByName(own.select(F.lit(dt).alias("dt_ns"), F.lit(gap).alias("max_gap"), "n", F.lit(1).cast("long").alias("w")))
    counted = counted.groupBy("dt_ns", "max_gap", "n").agg(F.sum("w").alias("w"))
    return counted.groupBy("dt_ns", "max_gap").agg(
        F.sum("w").alias("n_clusters"), F.round(F.sum(F.col("n") * F.col("w")) / F.sum("w"), 6).alias("mean_size"),
        F.expr("percentile(n, 0.5, w)").alias("median_size"), F.round(F.expr("percentile(n, 0.95, w)"), 6).alias("p95_size"),
    )
