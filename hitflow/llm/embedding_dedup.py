"""Near-duplicate vectors by a dual traversal of a cover tree: exact pairs above a cosine threshold.

On unit vectors, cosine >= c is a distance of at most e = sqrt(2 - 2c). The steps, for each length of vectors:

1. Equal vectors collapse to one representative with a weight (map-side aggregation first).
2. The tree has nested levels of centres whose radii halve from level to level. Its upper part is
   fitted on the `SAMPLE` representatives with the smallest hash, by farthest-first insertion: a
   centre belongs to every level whose radius is below its distance from all centres before it. A
   leaf that gets more than `BLOCK` vectors grows a subtree of its own from a sample of its vectors,
   in a task of its own, and so on until no leaf is larger (or all of its vectors are within e / 8 of
   its centre). Each sample's spots that `HEAVY` vectors share get a ball of radius e / 8.
   Every vector, sampled or not, goes to its ball or nearest centre, and each node's covering
   radius is measured over all its vectors, so the samples decide speed and not results.
3. Dual traversal: a pair of nodes goes if its centres are further apart than both covering radii
   and e; it is settled by counts if all its vectors are within e of each other (a ball and itself,
   however many vectors it holds); else its children are visited. The upper part is traversed from
   (root, root) on the driver, its size is bounded; pairs of subtrees are traversed on Spark, a level a round.
4. Pairs of leaves that stay open are compared on Spark. A leaf is packed into blocks of at most
   `BLOCK` vectors, in the order of the block's own last level of up to `BLOCK_CELLS` cells. A task gets
   two blocks, prunes their pairs of cells by the same bound, and compares what is left. It returns a weight sum and
   one spanning edge for each linked vector, never the pairs. Components of the edges end the work.

Bounds on distances hold with a slack of 1e-6, above the rounding of a distance near 0; what lies
within it is compared. In data without structure (independent directions in many dimensions) no
tree prunes, and step 4 is a blocked comparison of all vectors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, local_components
from .frames import join_by_key, prepare, saved

SAMPLE, HEAVY = 2048, 8
LEAST_CELLS, MOST_CELLS = 16, 256
SUB_SAMPLE, SUB_CELLS = 512, 64
BLOCK_CELLS = 128
LEAST_BLOCK, BLOCK = 256, 8192
BLOCK_VALUES = 1 << 20
FAN, ROUNDS = 1024, 5
SLACK = 1e-6
BROADCAST_ROWS = 500_000


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def place(x: np.ndarray, centres: np.ndarray, n_balls: int, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of the ball (the first n_balls centres take only what is within rho) or else nearest centre of each vector."""
    far = _distance(x, centres)
    cell = n_balls + far[:, n_balls:].argmin(axis=1)
    if n_balls:
        ball = far[:, :n_balls].argmin(axis=1)
        cell = np.where(far[np.arange(len(x)), ball] <= rho, ball, cell)
    return cell, far[np.arange(len(x)), cell]


class Tree:
    """Centres (balls first), and for each cell its level and parent."""

    def __init__(self, sample: np.ndarray, cells: int, reach: float):
        self.reach, self.rho = reach, reach / 8
        far = _distance(sample, sample)
        left, balls = np.ones(len(sample), bool), []
        while left.any():
            near = ((far <= self.rho / 2) & left).sum(axis=1) * left
            at = int(near.argmax())
            if near[at] < HEAVY:
                break
            balls.append(at)
            left &= far[at] > self.rho / 2
        order, gap, nearest = [0], [2.0], far[0].copy()
        while len(order) < min(cells, len(sample)):
            at = int(nearest.argmax())
            if nearest[at] <= self.rho:
                break
            order.append(at)
            gap.append(float(nearest[at]))
            nearest = np.minimum(nearest, far[at])
        self.n_balls = len(balls)
        self.centres = sample[balls + order]
        # A ball is a child on the lowest level of the nearest cell.
        level = [0 if g >= 2 else int(np.ceil(-np.log2(g / 2))) for g in gap]
        self.depth = max(level) + 1
        self.level = np.array([self.depth] * len(balls) + level)
        self.parent = np.zeros(len(self.centres), np.int64)
        between = _distance(self.centres, self.centres)
        for i in range(len(self.centres)):
            above = np.flatnonzero(self.level < self.level[i])
            self.parent[i] = above[between[i, above].argmin()] if len(above) else i

    def traverse(self, radius: dict[int, float]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """(open, settled) pairs of leaves; a leaf is a centre with its own vectors, radius its covering radius."""
        n = len(self.centres)
        between = _distance(self.centres, self.centres)
        np.fill_diagonal(between, 0.0)
        own = np.array([radius.get(i, -1.0) for i in range(n)])
        whole = own.copy()  # covering radius of all that hangs below a centre
        order = np.argsort(-self.level, kind="stable")
        below = [[] for _ in range(n)]
        for i in order:
            if self.parent[i] != i:
                below[self.parent[i]].append(int(i))
                if whole[i] >= 0:
                    whole[self.parent[i]] = max(whole[self.parent[i]], between[self.parent[i], i] + whole[i])
        roots = [i for i in range(n) if self.parent[i] == i]
        todo = [(a, b, False, False) for k, a in enumerate(roots) for b in roots[k:]]
        open_, settled = [], []
        while todo:
            a, b, leaf_a, leaf_b = todo.pop()
            ra, rb = (own if leaf_a else whole)[a], (own if leaf_b else whole)[b]
            if ra < 0 or rb < 0 or between[a, b] - ra - rb > self.reach + SLACK:
                continue
            if leaf_a and leaf_b:
                (settled if between[a, b] + ra + rb < self.reach - SLACK else open_).append((min(a, b), max(a, b)))
                continue
            if a == b and not leaf_a and not leaf_b:
                parts = [(a, True), *((c, False) for c in below[a])]
                todo += [(*x[:1], *y[:1], x[1], y[1]) for k, x in enumerate(parts) for y in parts[k:]]
            elif not leaf_a and (leaf_b or ra >= rb):
                todo += [(a, b, True, leaf_b), *((c, b, False, leaf_b) for c in below[a])]
            else:
                todo += [(a, b, leaf_a, True), *((a, c, leaf_a, False) for c in below[b])]
        return open_, settled


def _rows_of(column: pa.Array | pa.ChunkedArray, dtype: str) -> np.ndarray:
    """The vectors of a binary column."""
    vectors = column.to_pylist()
    return np.frombuffer(b"".join(vectors), dtype).reshape(len(vectors), -1)


_PLACED = "rep long, w long, vec binary, node long, far double"
_GROWN = "node long, child long, ball boolean, centre binary"
_PAIRS = "i long, j long, settled boolean"
_PACKED = "node long, slice int, reps binary, ws binary, vecs binary, starts binary, radii binary"
_LINKS = "rep long, root long, n long"


def _place(batches: Iterable[pa.RecordBatch], tree: Tree, dtype: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            cell, far = place(unit(_rows_of(batch.column("vec"), dtype)), tree.centres, tree.n_balls, tree.rho)
            yield pa.record_batch([*(batch.column(c) for c in ("rep", "w", "vec")), pa.array(cell.astype(np.int64)), pa.array(far)], names=["rep", "w", "vec", "node", "far"])


def _grow(table: pa.Table, dtype: str, cells: int, block: int, reach: float) -> pa.Table:
    """A leaf's subtree from a sample of its vectors: about two cells for each block that it fills, `cells` at most."""
    cells = min(cells, max(3, 2 * table["n"][0].as_py() // block))
    x = unit(_rows_of(table["vec"], dtype))[np.argsort(np.asarray(table["rep"]), kind="stable")]
    tree, node = Tree(x, cells, reach), table["node"][0].as_py()
    k = len(tree.centres)
    return pa.table({"node": pa.array([node] * k, pa.int64()), "child": pa.array(node * FAN + 1 + np.arange(k)), "ball": pa.array(np.arange(k) < tree.n_balls), "centre": pa.array([c.tobytes() for c in tree.centres], pa.binary())})


def _place_again(rows: pa.Table, grown: pa.Table, dtype: str, reach: float) -> pa.Table:
    if not rows.num_rows:
        return pa.table({"rep": pa.array([], pa.int64()), "w": pa.array([], pa.int64()), "vec": pa.array([], pa.binary()), "node": pa.array([], pa.int64()), "far": pa.array([], pa.float64())})
    grown = grown.sort_by("child")
    cell, far = place(unit(_rows_of(rows["vec"], dtype)), _rows_of(grown["centre"], "float64"), int(np.asarray(grown["ball"]).sum()), reach / 8)
    return pa.table({**{c: rows[c] for c in ("rep", "w", "vec")}, "node": pa.array(np.asarray(grown["child"])[cell]), "far": pa.array(far)})


def _visit(table: pa.Table, reach: float) -> pa.Table:
    """The pairs of children of one pair of nodes that are not pruned, and whether they are settled."""
    sides = []
    for c in ("ours", "theirs"):
        parts = table[c][0].as_py()
        sides.append((np.array([p["node"] for p in parts]), np.frombuffer(b"".join(p["centre"] for p in parts)).reshape(len(parts), -1), np.array([p["radius"] for p in parts])))
    (na, ca, ra), (nb, cb, rb) = sides
    between = _distance(ca, cb)
    between[na[:, None] == nb[None, :]] = 0.0
    reached = ra[:, None] + rb[None, :]
    near = between - reached <= reach + SLACK
    if table["i"][0].as_py() == table["j"][0].as_py():
        near &= na[:, None] <= nb[None, :]
    p, q = np.nonzero(near)
    return pa.table({"i": np.minimum(na[p], nb[q]), "j": np.maximum(na[p], nb[q]), "settled": (between + reached < reach - SLACK)[p, q]})


def _pack(table: pa.Table, dtype: str, reach: float) -> pa.Table:
    """A block of vectors as one row, in the order of its cells."""
    raw = _rows_of(table["vec"], dtype)
    at, w, _, starts, radii = _in_cells(np.arange(len(raw)), np.asarray(table["w"]), unit(raw), reach)
    row = {"reps": np.asarray(table["rep"])[at], "ws": w, "vecs": raw[at], "starts": starts.astype(np.int64), "radii": radii}
    return pa.table({"node": table["node"].slice(0, 1), "slice": table["slice"].slice(0, 1), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in row.items()}})


def _in_cells(reps: np.ndarray, w: np.ndarray, x: np.ndarray, reach: float) -> tuple[np.ndarray, ...]:
    """A block in the order of its own cells (centres first), and where each begins, with its radius."""
    order, nearest, cell = [0], _distance(x[:1], x)[0], np.zeros(len(x), np.int64)
    nearest[0] = 0.0
    while len(order) < min(BLOCK_CELLS, len(x) // 8):
        at = int(nearest.argmax())
        if nearest[at] <= reach / 4:
            break
        far = _distance(x[at : at + 1], x)[0]
        far[at] = 0.0
        cell[far < nearest] = len(order)
        nearest = np.minimum(nearest, far)
        order.append(at)
    by = np.lexsort((~np.isin(np.arange(len(x)), order), cell))
    starts = np.searchsorted(cell[by], np.arange(len(order)))
    return reps[by], w[by], x[by], starts, np.maximum.reduceat(nearest[by], starts)


def _links(sides: list[tuple[np.ndarray, ...]], cosine: float, reach: float) -> pa.Table:
    """Weight sums and spanning edges of the links between two blocks, or within one, each as _in_cells gives it."""
    (ra, wa, a, starts_a, radius_a), alone = sides[0], len(sides) == 1
    rb, wb, b, starts_b, radius_b = sides[-1]
    near = _distance(a[starts_a], b[starts_b]) - radius_a[:, None] - radius_b[None, :] <= reach + SLACK
    cells_b = np.diff(np.append(starts_b, len(b)))
    off = 0 if alone else len(ra)
    reps = ra if alone else np.concatenate([ra, rb])
    total, root = np.zeros(len(reps), np.int64), np.arange(len(reps))
    for cell, (first, end) in enumerate(zip(starts_a.tolist(), [*starts_a[1:].tolist(), len(a)], strict=True)):
        theirs = np.flatnonzero(np.repeat(near[cell], cells_b))
        if alone:
            theirs = theirs[theirs >= first]
        if not len(theirs):
            continue
        other = b[theirs].T
        for start in range(first, end, 256):
            i, j = np.nonzero(a[start : min(start + 256, end)] @ other >= cosine)
            i, j = i + start, theirs[j]
            if alone:
                later = i < j
                i, j = i[later], j[later]
            total += np.bincount(i, wb[j], len(total)).astype(np.int64) + np.bincount(j + off, wa[i], len(total)).astype(np.int64)
            new = root[i] != root[j + off]
            if new.any():
                root = local_components(len(root), np.concatenate([np.arange(len(root)), i[new]]), np.concatenate([root, j[new] + off]))
    some = np.flatnonzero(total)
    return pa.table({"rep": reps[some], "root": reps[root[some]], "n": total[some]})


def _compare(table: pa.Table, dtype: str, dim: int, cosine: float, reach: float) -> pa.Table:
    sides = []
    for row in table.select(["reps", "ws", "vecs", "starts", "radii"]).to_pylist():
        numbers = [np.frombuffer(row[c], t) for c, t in (("reps", np.int64), ("ws", np.int64), ("starts", np.int64), ("radii", np.float64))]
        sides.append((*numbers[:2], unit(np.frombuffer(row["vecs"], dtype).reshape(-1, dim)), *numbers[2:]))
    return _links(sides, cosine, reach)


def _compare_all(table: pa.Table, dtype: str, cosine: float, reach: float) -> pa.Table:
    return _links([_in_cells(np.asarray(table["rep"]), np.asarray(table["w"]), unit(_rows_of(table["vec"], dtype)), reach)], cosine, reach)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _by_tree(units: DataFrame, n: int, dim: int, dtype: str, cosine: float, sample: int) -> tuple[DataFrame, DataFrame]:
    """(rep, n) counts of linked rows among other representatives and (a, b) spanning edges, of units (rep, w, h1, h2, vec) of one length."""
    spark, reach = units.sparkSession, float(np.sqrt(2 - 2 * cosine))
    block = min(BLOCK, max(LEAST_BLOCK, n // 32), max(16, BLOCK_VALUES // dim))
    chosen = units.orderBy(F.xxhash64("h1"), "h1", "h2").limit(min(sample, max(64, (1 << 23) // dim))).select("vec").collect()
    tree = Tree(unit(np.frombuffer(b"".join(bytes(r["vec"]) for r in chosen), dtype).reshape(len(chosen), -1)), min(MOST_CELLS, max(LEAST_CELLS, n // block)), reach)
    placed = saved(units.select("rep", "w", "vec").mapInArrow(lambda it: _place(it, tree, dtype), _PLACED))
    measured = lambda df: df.groupBy("node").agg(F.max("far").alias("radius"), F.count("*").alias("n"), F.sum("w").alias("w"), F.min("rep").alias("least"))
    upper = measured(placed).collect()  # a row for each centre of the upper part, at most MOST_CELLS + SAMPLE / HEAVY
    open_, settled = tree.traverse({r["node"]: r["radius"] for r in upper})
    leaves = saved(spark.createDataFrame([(*r, bytearray(tree.centres[r["node"]].tobytes())) for r in upper], "node long, radius double, n long, w long, least long, centre binary"))
    pairs = spark.createDataFrame([(a, b, False) for a, b in open_] + [(a, b, True) for a, b in settled], _PAIRS)

    for _ in range(ROUNDS):
        large = leaves.where((F.col("n") > BLOCK) & (F.col("radius") > reach / 8)).select("node", "n")
        n_large = large.count()
        if not n_large:
            break
        large = _small(large, n_large)
        slices = F.ceil(F.col("n") / block).cast("int")
        rows = placed.join(large, "node").withColumn("slice", F.pmod(F.xxhash64("rep"), slices).cast("int"))
        draw = F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
        grown = saved(rows.where(draw < SUB_SAMPLE / F.col("n")).select("node", "rep", "vec", "n").groupBy("node").applyInArrow(lambda t: _grow(t, dtype, SUB_CELLS, BLOCK, reach), _GROWN))
        dealt = grown.join(large, "node").withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("n")
        moved = rows.drop("n", "far").groupBy("node", "slice").cogroup(dealt.groupBy("node", "slice")).applyInArrow(lambda a, b: _place_again(a, b, dtype, reach), _PLACED)
        placed = saved(placed.join(large.select("node"), "node", "left_anti").select("rep", "w", "vec", "node", "far").unionByName(moved))
        children = grown.select(F.col("node").alias("above"), F.col("child").alias("node"), "centre").join(measured(placed), "node")
        was = leaves.join(large.select("node"), "node", "left_anti").withColumn("above", F.col("node"))
        now = saved(was.unionByName(children))
        # Pairs of which a side was split are visited again with its children.
        split = large.select("node", F.lit(True).alias("is_split"))
        parts = now.groupBy(F.col("above").alias("node")).agg(F.collect_list(F.struct("node", "centre", "radius")).alias("parts"))  # at most SUB_CELLS + SUB_SAMPLE / HEAVY children of a node, give or take
        flagged = pairs.join(split.select(F.col("node").alias("i"), F.col("is_split").alias("si")), "i", "left").join(split.select(F.col("node").alias("j"), F.col("is_split").alias("sj")), "j", "left")
        touched = flagged.where("si or sj").select("i", "j")
        ours, theirs = (parts.select(F.col("node").alias(k), F.col("parts").alias(name)) for k, name in (("i", "ours"), ("j", "theirs")))
        visited = touched.join(ours, "i").join(theirs, "j").select("i", "j", "ours", "theirs").groupBy("i", "j").applyInArrow(lambda t: _visit(t, reach), _PAIRS)
        pairs = saved(flagged.where("si is null and sj is null").select("i", "j", "settled").unionByName(visited))
        leaves = now.drop("above")

    pairs = saved(pairs)
    sliced = leaves.select("node", F.ceil(F.col("n") / block).cast("int").alias("own"))
    n_leaves, n_pairs = leaves.count(), pairs.count()
    open_pairs = pairs.where("not settled").select("i", "j")
    sides = open_pairs.select(F.col("i").alias("node"), F.col("j").alias("other")).unionByName(open_pairs.where("i <> j").select(F.col("j").alias("node"), F.col("i").alias("other")))
    sides = sides.join(_small(sliced.select(F.col("node").alias("other"), F.col("own").alias("others")), n_leaves), "other")
    packed = placed.join(_small(sliced, n_leaves), "node").withColumn("slice", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("own")).cast("int"))
    packed = packed.select("node", "slice", "rep", "w", "vec").groupBy("node", "slice").applyInArrow(lambda t: _pack(t, dtype, reach), _PACKED)
    met = packed.join(_small(sides, 2 * n_pairs), "node").withColumn("t", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    first, same = F.col("node") < F.col("other"), F.col("node") == F.col("other")
    met = met.select(
        F.least("node", "other").alias("i"), F.greatest("node", "other").alias("j"),
        F.when(same, F.least("slice", "t")).when(first, F.col("slice")).otherwise(F.col("t")).alias("s"),
        F.when(same, F.greatest("slice", "t")).when(first, F.col("t")).otherwise(F.col("slice")).alias("u"),
        "reps", "ws", "vecs", "starts", "radii",
    )
    links = saved(met.groupBy("i", "j", "s", "u").applyInArrow(lambda t: _compare(t, dtype, dim, cosine, reach), _LINKS))

    # All vectors of a settled pair of leaves link with each other: counts come from weights, and one
    # edge leads from each vector to the first of a leaf that its own is settled with.
    done = pairs.where("settled")
    both = done.select(F.col("i").alias("node"), F.col("j").alias("other")).unionByName(done.where("i <> j").select(F.col("j").alias("node"), F.col("i").alias("other")))
    facts = both.join(leaves.select(F.col("node").alias("other"), "w", "least"), "other").groupBy("node").agg(F.sum("w").alias("base"), F.min("least").alias("hub"), F.max((F.col("node") == F.col("other")).cast("int")).alias("ball"))
    known = placed.select("rep", "w", "node").join(_small(facts, n_leaves), "node")
    met_leaves = done.where("i <> j").join(leaves.select(F.col("node").alias("i"), F.col("least").alias("a")), "i").join(leaves.select(F.col("node").alias("j"), F.col("least").alias("b")), "j")
    edges = links.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(known.select(F.col("rep").alias("a"), F.col("hub").alias("b"))).unionByName(met_leaves.select("a", "b"))
    counts = links.select("rep", "n").unionByName(known.select("rep", (F.col("base") - F.when(F.col("ball") > 0, F.col("w")).otherwise(0)).alias("n")))
    return counts, edges


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: the id, n_links (other rows linked directly), component_id and kept.

    component_id is the smallest id reachable by links, the row's own included; kept is true where
    it is the row's own. Vectors that are null, empty, zero or hold a null or non-finite component
    link with nothing, and so do rows with a null id (their component_id is null, and they are
    kept). Vectors of different lengths do not link. Repeated rows are rows of their own that link
    with each other, and so are rows that share an id but not the vector. Other columns are not read.
    """
    spark = prepare(vectors.sparkSession)
    id_type, kind = vectors.schema[id_col].dataType, vectors.schema[vec_col].dataType.elementType.simpleString()
    dtype = "float32" if kind == "float" else "float64"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{'float' if kind == 'float' else 'double'}>").alias("vec"))
    fine = F.expr("id is not null and vec is not null and exists(vec, x -> x <> 0) and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    keyed = rows.select("id", "vec", F.coalesce(fine, F.lit(False)).alias("fine"), F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))
    units = keyed.where("fine").groupBy("h1", "h2").agg(F.min("id").alias("least_id"), F.count("*").alias("w"), F.any_value("vec").alias("vec"))

    def packed(batches):
        for batch in batches:
            size = np.diff(np.asarray(batch.column("vec").offsets)).tolist()
            flat, at, out = np.asarray(batch.column("vec").flatten()), 0, []
            for n in size:
                out.append(flat[at : at + n].tobytes())
                at += n
            yield pa.record_batch([*(batch.column(c) for c in ("h1", "h2", "least_id", "w")), pa.array(size, pa.int32()), pa.array(out, pa.binary())], names=["h1", "h2", "least_id", "w", "dim", "vec"])

    units = saved(units.mapInArrow(packed, "h1 long, h2 long, least_id long, w long, dim int, vec binary"))
    units = units.withColumn("rep", F.monotonically_increasing_id())  # of checkpointed partitions, hence the same each time
    by_dim = units.groupBy("dim").agg(F.count("*").alias("n"))
    own_tree = by_dim.where((F.col("n") > LEAST_BLOCK) | (F.col("n") * F.col("dim") > BLOCK_VALUES)).collect()  # lengths that more than 256 vectors have
    reach = float(np.sqrt(2 - 2 * cosine))
    rest = units.where(~F.col("dim").isin([r["dim"] for r in own_tree])) if own_tree else units
    links = saved(rest.select("dim", "rep", "w", "vec").groupBy("dim").applyInArrow(lambda t: _compare_all(t, dtype, cosine, reach), _LINKS))
    counts, edges = links.select("rep", "n"), links.select(F.col("rep").alias("a"), F.col("root").alias("b"))
    for r in own_tree:
        more, joined = _by_tree(units.where(F.col("dim") == r["dim"]), r["n"], r["dim"], dtype, cosine, sample)
        counts, edges = counts.unionByName(more), edges.unionByName(joined)

    found = connected_components(edges).withColumnRenamed("node", "rep")
    ids = units.select("h1", "h2", "rep", "least_id", "w").join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    ids = ids.join(counts.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left").select("h1", "h2", "w", "component", "least_id", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    ids = saved(ids)
    least = ids.groupBy("component").agg(F.min("least_id").alias("component_id"))
    ids = saved(ids.join(least, "component").select("h1", "h2", "w", "n_links", "component_id"))
    # A vector that very many rows share, or that is none, is one key: the one is broadcast, the other joins nothing.
    linked = join_by_key(keyed.where("fine").select("id", "h1", "h2"), ids, ["h1", "h2"], count="w").select("id", "n_links", "component_id")
    alone = keyed.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    out = linked.unionByName(alone)
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").cast(id_type).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast(id_type).alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def brute_force(rows: Iterable[tuple[int, list | None]], cosine: float = 0.95) -> dict[int, tuple[int, int]]:
    """Reference for tests: id -> (n_links, component id)."""
    good = {k: np.array(v, np.float64) for k, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    comp, links = {k: k for k, _ in rows}, {k: 0 for k, _ in rows}

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    keys = sorted(good)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if len(good[a]) == len(good[b]) and good[a] @ good[b] / (np.linalg.norm(good[a]) * np.linalg.norm(good[b])) >= cosine:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {k: (links[k], root(k)) for k in comp}
