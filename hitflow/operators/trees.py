"""Boosted multiclass trees, grown leaf by leaf on Spark.

Each round fits one tree for each class to the gradients of the softmax loss. Features are cut into at most `BINS` bins at quantiles
of the train block. A task adds up gradients, second derivatives and rows by class, node, feature and bin for its rows; Spark adds the tasks'
histograms and finds each node's best split by feature; the driver sees a row for each class and node, whatever the input. Of two children, only the
smaller's histogram is made; the other's is what is left of their parent's, which the driver keeps until then (`HELD` bytes at most, or both are made).

Growth is leaf-wise: of all leaves the one with the largest gain is split next, up to `leaves` leaves. One job makes the histograms
of the children of every leaf that could be next, for all classes, so a round takes about as many jobs as its trees are deep and gives the very
trees of one split at a time. Rows are packed: a row of the written table is a block of some thousand rows as plain numpy bytes (bins in one byte each), so a job
reads some tens of bytes a row and makes no object for any; val rows lie beside the others and are read once a round. Scores go with them and are written every `KEEP` rounds. The val block ends the boosting after `stop` rounds without a lower
loss, and the best round's trees are kept.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import saved
from .learning import class_weights

BINS, KEEP, BLOCK, HELD = 255, 1, 100_000, 1 << 28
#: A leaf has at least so many rows and so much second derivative.
LEAST_ROWS, LEAST_H = 20, 1e-3


@dataclass
class Tree:
    """Nodes by number: feature (-1 for a leaf), bin, children, and value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int) -> tuple[int, int]:
        n = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, at, n, n + 1
        for column, empty in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0)):
            column += [empty, empty]
        return n, n + 1

    def nodes_of(self, bins: np.ndarray, wanted: list[int] | None = None) -> np.ndarray:
        """The node without children that each row (of bins by feature) falls into; with `wanted`, rows stop where none of these can follow."""
        feature, at, left, right = (np.array(c, np.intp) for c in (self.feature, self.bin, self.left, self.right))
        inner = feature >= 0
        if wanted is not None:
            leads = np.zeros(len(feature), bool)
            leads[wanted] = True
            for i in reversed(range(len(feature))):  # children come after their parent
                leads[i] |= inner[i] and (leads[left[i]] or leads[right[i]])
            inner &= leads
        if not inner[0]:
            return np.zeros(len(bins), np.intp)
        flat, children = np.ascontiguousarray(bins).ravel(), np.stack([left, right], axis=1).ravel()
        at = at.astype(flat.dtype)
        node, rows = np.zeros(len(bins), np.intp), None  # rows: those still on their way, all at first
        first, own = np.arange(len(bins)) * bins.shape[1], node
        while len(own):
            beyond = flat.take(feature.take(own) + first) > at.take(own)
            own = children.take(2 * own + beyond)
            on = np.flatnonzero(inner.take(own))
            if len(on) == len(own):
                continue
            if rows is None:
                node, rows = own, on
            else:
                node[rows] = own
                rows = rows.take(on)
            own, first = own.take(on), first.take(on)
        return node


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int, int]:
    """Gain, feature and bin (rows up to it go left) of the best split of one node by its histograms (features, bins); gain 0 without one."""
    gl, hl, nl = (np.cumsum(x, axis=1) for x in (g, h, n))
    whole = [x[:, -1:] for x in (gl, hl, nl)]
    gr, hr, nr = (w - x for w, x in zip(whole, (gl, hl, nl), strict=True))
    ok = (nl >= LEAST_ROWS) & (nr >= LEAST_ROWS) & (hl >= LEAST_H) & (hr >= LEAST_H)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, gl**2 / hl + gr**2 / hr - whole[0] ** 2 / whole[1], 0.0)
    gain = gain.round(9)  # equal gains stay equal in whatever order tasks' sums are added; ties go to the lowest feature, bin and leaf
    feature, at = np.unravel_index(int(gain.argmax()), gain.shape)
    return (float(gain[feature, at]), int(feature), int(at)) if gain[feature, at] > 0 else (0.0, 0, 0)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - functools.reduce(np.maximum, scores.T)[:, None])  # few classes: a class at a time
    e /= functools.reduce(np.add, e.T)[:, None]
    return e


@dataclass
class Boosted:
    """A fitted model: edges of each feature's bins, the classes' first scores, trees by round and class, the val loss of each round."""

    features: list[str]
    edges: list[list[float]]
    start: list[float]
    trees: list[list[Tree]]
    losses: list[float] = field(default_factory=list)

    def bins(self, batch: pa.RecordBatch) -> np.ndarray:
        """Missing values count as 0; a bin holds values up to its edge."""
        columns = [np.nan_to_num(np.asarray(batch.column(f).cast(pa.float64()).fill_null(0.0), np.float64)) for f in self.features]
        return np.stack([np.searchsorted(e, x, "left") for e, x in zip(self.edges, columns, strict=True)], axis=1) if columns else np.zeros((batch.num_rows, 0), np.int64)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds probability (array) and prediction."""
        fields = [f for f in df.columns if f not in ("probability", "prediction")]
        shape = df.select(*fields).withColumns({"probability": F.lit(None).cast("array<double>"), "prediction": F.lit(None).cast("int")}).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    p = softmax(_scores(self.bins(batch), np.tile(self.start, (batch.num_rows, 1)), self.trees))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64())), pa.array(p.argmax(axis=1).astype(np.int32))], names=[*fields, "probability", "prediction"])

        return df.select(*fields).mapInArrow(run, shape)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """(round, class, node, feature, threshold, gain, left, right, value): every node of every tree; feature is null for leaves."""
        rows = []
        for r, trees in enumerate(self.trees):
            for c, t in enumerate(trees):
                for i, f in enumerate(t.feature):
                    inner = f >= 0
                    rows.append((r, c, i, self.features[f] if inner else None, float(self.edges[f][t.bin[i]]) if inner else None, t.gain[i] if inner else None, t.left[i] if inner else None, t.right[i] if inner else None, None if inner else t.value[i]))
        return spark.createDataFrame(rows, "round int, class int, node int, feature string, threshold double, gain double, left int, right int, value double")

    def split_counts(self, spark: SparkSession) -> DataFrame:
        """(feature, splits, gain): how many nodes split by each feature, and their whole gain; 0 for a feature without any."""
        every = spark.createDataFrame([(f,) for f in self.features], "feature string")
        own = self.nodes(spark).where("feature is not null").groupBy("feature").agg(F.count("*").alias("splits"), F.sum("gain").alias("gain"))
        return every.join(own, "feature", "left").na.fill({"splits": 0, "gain": 0.0}).orderBy(F.desc("splits"), "feature")

    def save(self, spark: SparkSession, path: str) -> str:
        settings = json.dumps({"features": self.features, "edges": self.edges, "start": self.start, "losses": self.losses, "trees": [[t.__dict__ for t in r] for r in self.trees]})
        spark.createDataFrame([(settings,)], "settings string").coalesce(1).write.mode("overwrite").parquet(path)
        return path


def load(spark: SparkSession, path: str) -> Boosted:
    s = json.loads(spark.read.parquet(path).first()["settings"])
    return Boosted(s["features"], s["edges"], s["start"], [[Tree(**t) for t in r] for r in s["trees"]], s["losses"])


def _scores(bins: np.ndarray, scores: np.ndarray, trees: list[list[Tree]]) -> np.ndarray:
    scores = scores.copy()
    for by_class in trees:
        for c, t in enumerate(by_class):
            scores[:, c] += np.array(t.value)[t.nodes_of(bins)]
    return scores


KINDS = {"y": np.int32, "bins": np.uint8, "scores": np.float64}
PACKED = ", ".join(f"{of}{c} binary" for of in ("", "val_") for c in KINDS)


def _packed(train: tuple[np.ndarray, ...], val: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """One block of rows: y, bins and scores, and those of its val rows."""
    columns = [c.astype(kind) for rows in (train, val) for c, kind in zip(rows, KINDS.values(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=[f"{of}{c}" for of in ("", "val_") for c in KINDS])


def _unpacked(batches: Iterator[pa.RecordBatch], n_features: int, k: int) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """y, bins and scores of about BLOCK rows at a time, and those of the val rows with them where these are read too."""
    blocks, rows = [], 0
    whole = lambda: [tuple(np.concatenate(c) for c in zip(*own, strict=True)) for own in zip(*blocks, strict=True)]
    for batch in batches:
        for i in range(batch.num_rows):
            blocks.append([])
            for of in ("", "val_") if "val_y" in batch.schema.names else ("",):
                y, bins, scores = (np.frombuffer(batch.column(f"{of}{c}")[i].as_buffer(), kind) for c, kind in KINDS.items())
                blocks[-1].append((y, bins.reshape(len(y), n_features), scores.reshape(len(y), k)))
                rows += len(y)
            if rows >= BLOCK:
                yield whole()
                blocks, rows = [], 0
    if blocks:
        yield whole()


def _histograms(batches: Iterator[pa.RecordBatch], pending: list[list[Tree]], growing: list[Tree], wanted: list[list[int]], n_features: int, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One task's histograms of the wanted nodes of each class, as (class, node, g, h, n), and the val loss, where val rows are read, as class -1."""
    k = len(growing)
    total = [np.zeros((3, len(w), n_features, BINS + 1)) for w in wanted]
    loss, rows = 0.0, 0
    for (y, bins, scores), *held in _unpacked(batches, n_features, k):
        for val_y, val_bins, val_scores in held:
            p = softmax(_scores(val_bins, val_scores, pending))
            loss -= float(np.log(np.maximum(p[np.arange(len(val_y)), val_y], 1e-15)).sum())
            rows += len(val_y)
        if not len(y) or not any(wanted):
            continue
        scores, weight, columns = _scores(bins, scores, pending), weights[y], np.ascontiguousarray(bins.T)
        found = []
        for c in range(k):
            place = np.full(len(growing[c].feature), -1)
            place[wanted[c]] = np.arange(len(wanted[c]))
            at = place[growing[c].nodes_of(bins, wanted[c])] if wanted[c] else np.full(len(y), -1)
            own = np.flatnonzero(at >= 0)
            found.append((own, at[own]))
        every = softmax(scores) if sum(len(own) for own, _ in found) > len(y) else None
        for c, (own, at) in enumerate(found):
            if not len(own):
                continue
            pc, wc = every[own, c] if every is not None else softmax(scores[own])[:, c], weight[own]
            g, h = wc * (pc - (y[own] == c)), wc * pc * (1 - pc) * (k / max(1, k - 1))
            first, cells = at * (BINS + 1), len(wanted[c]) * (BINS + 1)
            for f, column in enumerate(columns):  # a feature at a time: its sums stay in the processor's cache
                key = first + column.take(own)
                for i, v in enumerate((g, h, None)):
                    total[c][i, :, f] += np.bincount(key, v, cells).reshape(-1, BINS + 1)
    out = [(-1, 0, np.array([loss]).tobytes(), np.array([float(rows)]).tobytes(), np.zeros(1).tobytes())] if rows else []
    for c in range(k):
        out += [(c, node, *(total[c][i, j].tobytes() for i in range(3))) for j, node in enumerate(wanted[c]) if total[c][2, j].any()]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["class", "node", "g", "h", "n"])


#: What is known of a node: the best split, the node's sums and, where kept, its histogram (or the summed val loss).
FOUND = "class int, node int, feature int, gain double, bin int, g double, h double, whole binary"


def _best(key: tuple, table: pa.Table, keep: bool = False) -> pa.Table:
    """The best split of one node, with the node's sums (or the summed val loss)."""
    g, h, n = (np.sum([np.frombuffer(b) for b in table[c].to_pylist()], axis=0) for c in "ghn")
    if key[0].as_py() >= 0:
        g, h, n = (x.reshape(-1, BINS + 1) for x in (g, h, n))
        gain, feature, at = best_split(g, h, n)
        own = g[0].sum(), h[0].sum()  # every feature's bins hold all rows
    else:
        (gain, feature, at), own, keep = (0.0, 0, 0), (g[0], h[0]), False
    whole = np.stack([g, h, n]).tobytes() if keep else None
    return pa.table({"class": [key[0].cast(pa.int32())], "node": [key[1].cast(pa.int32())], "feature": pa.array([feature], pa.int32()), "gain": [gain], "bin": pa.array([at], pa.int32()), "g": [float(own[0])], "h": [float(own[1])], "whole": pa.array([whole], pa.binary())})


def _left_over(parent: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The histogram of the other child. Bins without rows hold exactly nothing, so that equal splits stay equal."""
    out = parent - child
    out[:2][:, out[2] == 0] = 0
    return out


def _grown(expanded: Tree, splits: dict, leaves: int, rate: float) -> tuple[Tree | None, set[int]]:
    """The leaf-wise tree from what is known: the next leaf is always that of the largest gain (ties: the one found first). None
    where a leaf is due whose children have no histograms yet; then all known leaves that could be in the tree, which go next."""
    out, source = Tree(), {0: 0}
    gain = lambda i: splits[source[i]][0] if source[i] in splits else 0.0
    open_, missing = [0], set()
    while len(open_) + len(missing) < leaves:
        at = max(open_, key=lambda i: (gain(i), -i), default=None)
        if at is None or gain(at) <= 0:
            break
        node = source[at]
        if expanded.feature[node] < 0:  # due, but not yet expanded: it would be two leaves
            missing.add(node)
            open_.remove(at)
            continue
        g, feature, b, *_ = splits[node]
        left, right = out.split(at, feature, b)
        out.gain[at] = g
        source[left], source[right] = expanded.left[node], expanded.right[node]
        open_.remove(at)
        open_ += [left, right]
    if missing:
        return None, missing
    for i in open_:
        g, h = splits[source[i]][3:] if source[i] in splits else (0.0, 1.0)
        out.value[i] = -rate * g / h if h > 0 else 0.0
    return out, set()


def fit(split: DataFrame, features: list[str], label: str = "hard_label", rounds: int = 500, leaves: int = 63, rate: float = 0.05, stop: int = 50) -> Boosted:
    """Boosted trees from rows with features, label (0, 1, ...) and split; balanced class weights on the train block.

    Missing features count as 0. Without val rows all rounds are made. A class that the train block lacks keeps a first score
    so low that it is never predicted. An empty train block gives a model without trees.
    """
    rows = split.where(F.col(label) >= 0).withColumn("is_val", F.col("split") == "val").where("split in ('train', 'val')")
    train = rows.where("not is_val")
    weights = class_weights(train, label).groupBy(label).agg(F.first("weight").alias("weight"), F.count("*").alias("n"))  # a row for each class
    sizes = {r[label]: (r["weight"], r["n"]) for r in weights.collect()}
    k = (rows.agg(F.max(label)).first()[0] or 0) + 1
    filled = [F.coalesce(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), F.lit(0.0)).alias(f) for f in features]
    quantiles = train.select(*filled).approxQuantile(features, [i / BINS for i in range(1, BINS)], 1 / (4 * BINS)) if sizes else [[] for _ in features]
    edges = [sorted(set(q)) for q in quantiles]
    mass = sum(w * n for w, n in sizes.values()) or 1.0
    start = [float(np.log(sizes[c][0] * sizes[c][1] / mass)) if c in sizes else -30.0 for c in range(k)]
    model = Boosted(features, edges, start, [])
    if not sizes:
        return model

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                val, columns = np.asarray(batch.column("is_val").cast(pa.int8())).astype(bool), (np.asarray(batch.column("y")), model.bins(batch), np.tile(start, (n, 1)))
                yield _packed(*(tuple(c[rows] for c in columns) for rows in (~val, val)))

    by_class = np.array([sizes[c][0] if c in sizes else 1.0 for c in range(k)], np.float64)
    cores = rows.sparkSession.sparkContext.defaultParallelism  # a task's histograms are as large for few rows as for many: as many tasks as run at once
    data = saved(rows.select(F.col(label).cast("int").alias("y"), "is_val", *filled).coalesce(cores).mapInArrow(binned, PACKED))
    pending: list[list[Tree]] = []
    best, best_loss = 0, np.inf
    n_features = len(features)

    keep = 24 * n_features * (BINS + 1) * leaves * k <= HELD

    def found(growing: list[Tree], wanted: list[list[int]], first: bool) -> tuple[dict, dict, float | None]:
        read = data if first else data.select(*KINDS)
        sums = read.mapInArrow(lambda it: _histograms(it, pending, growing, wanted, n_features, by_class), "class int, node int, g binary, h binary, n binary")
        got = sums.groupBy("class", "node").applyInArrow(lambda key, table: _best(key, table, keep), FOUND).collect()  # a row for each class and wanted node
        by = {(r["class"], r["node"]): (r["gain"], r["feature"], r["bin"], r["g"], r["h"]) for r in got if r["class"] >= 0}
        histograms = {(r["class"], r["node"]): np.frombuffer(r["whole"]).reshape(3, n_features, BINS + 1) for r in got if r["whole"] is not None}
        held = [(r["g"], r["h"]) for r in got if r["class"] < 0]
        return by, histograms, held[0][0] / held[0][1] if held and held[0][1] else None

    for turn in range(rounds + 1):
        growing, splits = [Tree() for _ in range(k)], [{} for _ in range(k)]
        wanted, done = [[0] if turn < rounds else [] for _ in range(k)], [None] * k
        first, whole, others = True, {}, {}  # histograms by class and node; the nodes that follow from another, with their parent
        while first or any(wanted):
            by, made, held = found(growing, wanted, first)
            whole |= made
            for (c, node), (other, parent) in others.items():
                whole[c, other] = _left_over(whole.pop((c, parent)), whole[c, node])
                by[c, other] = (*best_split(*whole[c, other]), *(float(x[0].sum()) for x in whole[c, other][:2]))
            if first and turn and held is not None:
                model.losses.append(held)
                if held < best_loss:
                    best, best_loss = turn, held
            first = False
            for (c, node), s in by.items():
                splits[c][node] = s
            if held is not None and turn - best >= stop:
                break
            wanted, others = [[] for _ in range(k)], {}
            for c in range(k if turn < rounds else 0):
                if done[c] is None:
                    done[c], missing = _grown(growing[c], splits[c], leaves, rate)
                    for node in sorted(missing):
                        feature, at = splits[c][node][1:3]
                        children = growing[c].split(node, feature, at)
                        if (c, node) in whole:
                            n = whole[c, node][2, feature]
                            small, large = children if 2 * n[: at + 1].sum() <= n.sum() else children[::-1]
                            others[c, small], children = (large, node), (small,)
                        wanted[c] += children
        if turn == rounds or any(t is None for t in done):
            break
        if all(len(t.feature) == 1 for t in done):  # nothing left to split
            break
        model.trees.append(done)
        pending.append(done)
        if len(pending) == KEEP:
            kept, pending = pending, []

            def scored(batches: Iterator[pa.RecordBatch], kept=kept) -> Iterator[pa.RecordBatch]:
                for blocks in _unpacked(batches, n_features, k):
                    yield _packed(*((y, bins, _scores(bins, scores, kept)) for y, bins, scores in blocks))

            data = saved(data.mapInArrow(scored, PACKED))
    if model.losses:
        model.trees = model.trees[:best]
    return model
