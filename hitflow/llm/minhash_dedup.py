"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full sets.

A document's set holds its distinct `shingle`-word shingles (ASCII upper case folded; a document
of fewer words has the whole sequence as its one shingle). Documents link when the Jaccard
similarity of their sets is at least `percent` / 100. The steps:

1. One pass over the texts makes each set, its size, a 128-bit set hash and `BITS` MinHash values,
   of which the signature keeps a bit each. Documents with equal sets collapse to one node
   (map-side aggregation first, so a group of copies of any size is one row afterwards).
2. Forest: `TREES` trees, each a signature order that starts with three MinHash values of its own.
   The rows (tree, key, signature) are range-sorted as a whole, so a dense region spreads over
   tasks, and each row is compared with its `NEIGHBOURS` longest-common-prefix neighbours below. In
   a sparse region the neighbours reach back to the least depth of three values. Pairs whose
   signatures agree enough become candidates, and each task sends on a spanning forest of them,
   never more edges than rows.
3. Depth adapts to the region. Where more rows than `NEIGHBOURS` share a tree's key (or a task's
   border cuts such a group), the neighbours do not reach all. If the group's rows are not yet one
   candidate cluster, its signatures are compared in full up to `DIRECT` rows; the rows of larger
   groups go to a second forest of `DEEP_TREES` trees of `DEEP_BITS` bits, and what shares a key
   there is compared in full, a task for each pair of blocks.
4. Components of the candidate graph are candidate clusters. A pair of signatures agrees enough at
   4 standard deviations fewer bits than expected at the threshold (a link does not, three times in
   100 000 at the threshold and less above). Of pairs at similarity 0.5, one in 10 million agrees.
5. Each cluster is settled on full sets: a breadth-first search compares every reached document
   with every one not yet reached (above 64, with those whose signatures agree). A cluster above a
   block (`BLOCK` documents or `BLOCK_SHINGLES` shingles) is dealt to one task for each pair of its
   blocks. What comes out is a spanning forest of confirmed links, whose components are the result.

A pair at exactly 0.85 misses all trees of the first forest with a probability of
(1 - 0.85**3)**16 = 2.4e-7 (at 0.8: 1.0e-5), and all of the second with (1 - 0.925**24)**96 = 1e-7
(at 0.8: 3e-4).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, local_components
from .frames import prepare, saved
from .wordhash import SPACE, U64, blocks, mix, words_of

TREES, DEPTH = 16, 3
BITS = 512
DEEP_TREES, DEEP_BITS = 96, 24
NEIGHBOURS = 64
DIRECT, SIGNATURE_BLOCK = 2048, 16384
BLOCK, BLOCK_SHINGLES = 2048, 4 << 20
BROADCAST_ROWS = 500_000
HOT_SHARE = 1000
U32 = np.uint32
_WORDS = BITS // 64
_MULTIPLIERS = (mix(np.arange(1, BITS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(U32) | U32(1)
_ADDENDS = (mix(np.arange(1, BITS + 1, dtype=U64) * U64(0xC2B2AE3D27D4EB4F)) >> U64(32)).astype(U32)
#: The bits of each tree of the second forest.
_DEEP = np.argsort(mix(np.arange(DEEP_TREES * BITS, dtype=U64) + U64(77)).reshape(DEEP_TREES, BITS), axis=1)[:, :DEEP_BITS]


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents' sets as one array of sorted hashes, and where each set starts and ends."""
    words = words_of(texts, SPACE, fold=True)
    counts = words.counts
    at, h = words.grams(shingle)
    doc = words.doc[at]
    for n in range(1, shingle):
        at, own = words.grams(n)
        short = counts[words.doc[at]] == n
        doc, h = np.concatenate([doc, words.doc[at][short]]), np.concatenate([h, own[short]])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(counts) + 1))


def signatures(flat: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (a row for each set, a column for each tree) and signatures (BITS / 8 bytes) of non-empty sets."""
    x, starts = (flat >> U64(32)).astype(U32), cut[:-1]
    n, scratch = len(starts), np.empty(len(flat), U32)
    low = np.empty((n, BITS), U32)
    for v in range(BITS):
        np.multiply(x, _MULTIPLIERS[v], out=scratch)
        np.add(scratch, _ADDENDS[v], out=scratch)
        low[:, v] = np.minimum.reduceat(scratch, starts)
    value = mix(low.astype(U64) + (np.arange(BITS, dtype=U64) << U64(32)))
    tree = value[:, : TREES * DEPTH].reshape(n, TREES, DEPTH)
    keys = mix(tree[..., 0] + mix(tree[..., 1] + mix(tree[..., 2]))).view(np.int64)
    return keys, np.packbits((value >> U64(63)).astype(np.uint8), axis=1)


_SIGNED = "id long, th long, n_shingles long, s1 long, s2 long, keys array<long>, sig binary"


def _sign(batches: Iterable[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*((c, pa.int64()) for c in ("id", "th", "n_shingles", "s1", "s2")), ("keys", pa.list_(pa.int64())), ("sig", pa.binary())])
    for batch in (b for whole in batches for b in blocks(whole, "text")):
        flat, cut = shingle_sets(batch.column("text"), shingle)
        size, n = np.diff(cut), batch.num_rows
        some = np.flatnonzero(size)
        sums, keys, sig = np.zeros((2, n), np.int64), np.zeros((n, TREES), np.int64), np.zeros((n, BITS // 8), np.uint8)
        if len(some):
            starts = cut[:-1][some]
            sums[0, some] = np.add.reduceat(mix(flat), starts).view(np.int64)
            sums[1, some] = np.add.reduceat(mix(flat ^ U64(0x5851F42D4C957F2D)), starts).view(np.int64)
            keys[some], sig[some] = signatures(flat, np.append(starts, len(flat)))
        columns = [batch.column("id"), batch.column("th"), pa.array(size.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1])]
        columns += [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * TREES), pa.array(keys.ravel())), pa.array([r.tobytes() for r in sig], pa.binary())]
        yield pa.record_batch(columns, schema=schema)


def least_agreement(percent: int) -> int:
    """Bits that a link's signatures share at least, but for 4 standard deviations; bits of other shingles agree by halves."""
    p = (1 + percent / 100) / 2
    return int(BITS * p - 4 * (BITS * p * (1 - p)) ** 0.5)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def _bits(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), U64).reshape(-1, _WORDS)


_FOUND = "a long, b long, tree int, key long"


def _neighbours(batches: Iterable[pa.RecordBatch], agree: int) -> Iterator[pa.RecordBatch]:
    """Spanning candidate edges between each row and the rows before it that share its tree's key, as (a, b); and
    as (tree, key) the groups that this leaves open: those of more than `NEIGHBOURS` rows, and the first and last of the task."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tree", pa.int32()), ("key", pa.int64())])

    def found(a, b, tree, key):
        n, m = len(a), len(tree)
        columns = [(pa.array(a, pa.int64()), pa.nulls(m, pa.int64())), (pa.array(b, pa.int64()), pa.nulls(m, pa.int64())), (pa.nulls(n, pa.int32()), pa.array(tree, pa.int32())), (pa.nulls(n, pa.int64()), pa.array(key, pa.int64()))]
        return pa.record_batch([pa.concat_arrays(c) for c in columns], schema=schema)

    empty = np.empty(0, np.int64)
    open_group = None
    tree, key, node, sig = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, _WORDS), U64)
    for batch in batches:
        old = len(key)
        tree = np.concatenate([tree, np.asarray(batch.column("tree")).astype(np.int32)])
        key = np.concatenate([key, np.asarray(batch.column("key"))])
        node = np.concatenate([node, np.asarray(batch.column("node"))])
        sig = np.concatenate([sig, _bits(batch.column("label"))])
        if open_group is None and len(key):
            yield found(empty, empty, tree[:1], key[:1])
        at = np.arange(max(old, NEIGHBOURS), len(key))
        at = at[(key[at] == key[at - NEIGHBOURS]) & (tree[at] == tree[at - NEIGHBOURS])]
        if len(at):
            large = np.unique(np.stack([tree[at].astype(np.int64), key[at]]), axis=1)
            yield found(empty, empty, large[0], large[1])
        if len(key):
            open_group = tree[-1:], key[-1:]
        near, far = [], []
        for back in range(1, min(NEIGHBOURS, len(key) - 1) + 1):
            at = np.arange(max(old, back), len(key))
            at = at[(key[at] == key[at - back]) & (tree[at] == tree[at - back])]
            if not len(at):
                break
            at = at[_differ(sig[at], sig[at - back]) <= BITS - agree]
            near.append(at)
            far.append(at - back)
        if near:
            a, b = np.concatenate(near), np.concatenate(far)
            root = local_components(len(key), a, b)
            moved = np.flatnonzero(root != np.arange(len(root)))
            a, b = node[moved], node[root[moved]]
            yield found(a[a != b], b[a != b], empty, empty)
        tree, key, node, sig = tree[-NEIGHBOURS:], key[-NEIGHBOURS:], node[-NEIGHBOURS:], sig[-NEIGHBOURS:]
    if open_group is not None:
        yield found(empty, empty, *open_group)


def _all_pairs(table: pa.Table, agree: int) -> pa.Table:
    """Spanning candidate edges among one block of a group, or between two of its blocks, by comparing all pairs of signatures."""
    node, own, i, j = np.asarray(table["node"]), np.asarray(table["own"]), table["i"][0].as_py(), table["j"][0].as_py()
    sig, known = _bits(table["sig"]), np.unique(np.asarray(table["component"]), return_inverse=True)[1]
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    _, first = np.unique(known, return_index=True)
    root, started = first[known], first[known]  # rows of one candidate cluster need no edges
    for y in range(0, len(right), 1024):
        b = right[y : y + 1024]
        for x in range(0, len(left) if i != j else min(len(left), y + 1024), 256):
            a = left[x : x + 256]
            if root[a].max() == root[a].min() == root[b].max() == root[b].min():
                continue
            differ = np.zeros((len(a), len(b)), np.uint16)
            for v in range(_WORDS):
                differ += np.bitwise_count(sig[a, v][:, None] ^ sig[b, v][None, :])
            p, q = np.nonzero(differ <= BITS - agree)
            p, q = a[p], b[q]
            new = root[p] != root[q]
            if new.any():
                root = local_components(len(root), np.concatenate([np.arange(len(root)), p[new]]), np.concatenate([root, q[new]]))
    moved = np.flatnonzero((root != started) & (started == np.arange(len(root))))
    return pa.table({"a": pa.array(node[moved], pa.int64()), "b": pa.array(node[root[moved]], pa.int64())})


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _search(trees: DataFrame, before: DataFrame | None, agree: int) -> tuple[DataFrame, DataFrame | None]:
    """Spanning candidate edges among rows (node, sig, tree, key, label), with the edges of `before`; and the rows
    (tree, key, node, sig, component, n) of the groups of n rows that are left open and not yet one cluster, None without any."""
    ordered = trees.select("tree", "key", "node", "label").repartitionByRange("tree", "key", "label").sortWithinPartitions("tree", "key", "label")
    found = saved(ordered.mapInArrow(lambda it: _neighbours(it, agree), _FOUND))
    edges = found.where("a is not null").select("a", "b")
    edges = edges if before is None else edges.unionByName(before)
    groups = saved(found.where("a is null").select("tree", "key").distinct())
    n = groups.count()
    if not n:
        return edges, None
    joined = connected_components(edges)
    rows = trees.select("tree", "key", "node", "sig").join(_small(groups, n), ["tree", "key"])
    rows = rows.join(joined.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = saved(rows.groupBy("tree", "key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("tree", "key", "n"))
    n = sizes.count()
    edges = joined.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return edges, rows.join(_small(sizes, n), ["tree", "key"]) if n else None


def _in_full(rows: DataFrame, agree: int) -> DataFrame:
    group = ["tree", "key"]
    n_blocks = F.ceil(F.col("n") / SIGNATURE_BLOCK).cast("int")
    dealt = (
        rows.withColumn("n_blocks", n_blocks)
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, n_blocks - 1)")))
        .select(*group, "node", "sig", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    return dealt.groupBy(*group, "i", "j").applyInArrow(lambda t: _all_pairs(t, agree), "a long, b long")


def _deep_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document and tree of the second forest."""
    weights = (U64(1) << np.arange(DEEP_BITS, dtype=U64)).astype(np.int64)
    for whole in batches:
        for start in range(0, whole.num_rows, 2048):
            batch = whole.slice(start, 2048)
            sig = batch.column("sig").to_pylist()
            bits = np.unpackbits(np.frombuffer(b"".join(sig), np.uint8).reshape(-1, BITS // 8), axis=1)
            for tree in range(DEEP_TREES):
                key = bits[:, _DEEP[tree]].astype(np.int64) @ weights
                yield pa.record_batch([batch.column("node"), batch.column("sig"), pa.array(np.full(len(sig), tree, np.int32)), pa.array(key), batch.column("sig")], names=["node", "sig", "tree", "key", "label"])


def _candidates(sets: DataFrame, agree: int) -> DataFrame:
    """Spanning candidate edges (a, b) among rows of (node, sig, keys)."""
    trees = sets.select("node", "sig", F.posexplode("keys").alias("tree", "key"))
    turn = BITS // 8 // TREES
    trees = trees.withColumn("label", F.expr(f"concat(substring(sig, tree * {turn} + 1), substring(sig, 1, tree * {turn}))"))
    edges, rest = _search(trees, None, agree)
    if rest is None:
        return edges
    rest = saved(rest)
    edges = edges.unionByName(_in_full(rest.where(F.col("n") <= DIRECT), agree))
    deep = saved(rest.where(F.col("n") > DIRECT).select("node").distinct())
    if not deep.isEmpty():
        rows = sets.select("node", "sig").join(deep, "node", "left_semi").mapInArrow(_deep_rows, "node long, sig binary, tree int, key long, label binary")
        edges, rest = _search(saved(rows), edges, agree)
        if rest is not None:
            edges = edges.unionByName(_in_full(rest, agree))
    return edges


def _settle(table: pa.Table, shingle: int, percent: int, agree: int) -> pa.Table:
    """Spanning forest of the links among one cluster (or two blocks of it), on full sets."""
    node, sig = np.asarray(table["node"]), _bits(table["sig"])
    flat, cut = shingle_sets(table["text"], shingle)
    vocabulary, flat = np.unique(flat, return_inverse=True)
    size = np.diff(cut)
    own = [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    left = np.argsort(node, kind="stable")
    left = left[size[left] > 0]
    mask = np.zeros(len(vocabulary), bool)
    a, b = [], []
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.flatnonzero(_differ(sig[left], sig[x]) <= BITS - agree) if len(left) > 64 else np.arange(len(left))
            if not len(near):
                continue
            sizes = size[left[near]]
            mask[own[x]] = True
            both = np.add.reduceat(mask[np.concatenate([own[i] for i in left[near]])].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            mask[own[x]] = False
            near = near[100 * both >= percent * (sizes + size[x] - both)]
            if len(near):
                found = left[near]
                queue += found.tolist()
                a.append(node[found])
                b.append(np.full(len(found), node[root]))
                left = np.delete(left, near)
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


_SAME = ["s1", "s2", "n_shingles"]


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Signed rows (id, th, and the set's key), and for each distinct set its component, the component's least id, and the
    (least) row that stays."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    signed = saved(rows.mapInArrow(lambda it: _sign(it, shingle), _SIGNED))
    first = F.struct(F.col("id").isNull().alias("unnamed"), "id", "th")
    sets = signed.where("n_shingles > 0").groupBy(*_SAME).agg(F.min(first).alias("first"), F.count("*").alias("w"), F.any_value("sig").alias("sig"), F.any_value("keys").alias("keys"))
    sets = saved(sets).withColumn("node", F.monotonically_increasing_id())  # of checkpointed partitions, hence the same each time

    agree = least_agreement(percent)
    clusters = connected_components(_candidates(sets.select("node", "sig", "keys"), agree))
    members = saved(clusters.join(sets.select("node", "n_shingles", "sig", F.col("first.id").alias("id"), F.col("first.th").alias("th")), "node"))
    n_members = members.count()
    n_blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy("component").agg(n_blocks.alias("n_blocks"))
    wanted = _small(members.select("node", F.col("id").alias("own_id"), F.col("th").alias("own_th")), n_members)
    # Rows that repeat id and text would come more than once.
    texts = rows.join(wanted, (F.col("th") == F.col("own_th")) & F.col("id").eqNullSafe(F.col("own_id"))).groupBy("node").agg(F.any_value("text").alias("text"))
    dealt = (
        members.join(sizes, "component")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
        .select("component", "node", "sig", "own", F.explode(F.expr("if(n_blocks = 1, array(0), filter(sequence(0, n_blocks - 1), x -> x <> own))")).alias("other"))
        .select("component", "node", "sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    links = dealt.join(texts, "node").groupBy("component", "i", "j").applyInArrow(lambda t: _settle(t, shingle, percent, agree), "a long, b long")
    found = connected_components(links)
    sets = sets.select("node", *_SAME, "first", "w").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sets = saved(sets.select(*_SAME, "first", "w", "component"))
    least = sets.groupBy("component").agg(F.min("first").alias("least"))
    return signed, saved(sets.join(least, "component").select(*_SAME, "w", "component", "least"))


def _with_sets(signed: DataFrame, sets: DataFrame) -> DataFrame:
    """Each row with what is known of its set. The sets of more than a thousandth of all rows (a thousand at most) are
    broadcast, so that the rows of one set meet it in many tasks; the others are joined by key."""
    total = signed.count()
    hot = F.broadcast(sets.where(F.col("w") * HOT_SHARE > total))
    common = signed.join(hot, _SAME)
    rest = signed.join(hot.select(*_SAME), _SAME, "left_anti")
    return common.unionByName(rest.join(sets, _SAME, "left"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: the id, n_shingles, component_id and kept.

    component_id is the smallest id reachable by links, the row's own included; kept is true where
    it is the row's own. Null, empty and blank texts have no shingles and link with nothing. Rows
    that share an id are documents of their own. A row with a null id may join a component, whose id
    then is that of the others; without others the component's id is null and its rows are kept. Other columns are
    not read. Similarities are exact; see the module's docstring for the chance of a missed pair.
    """
    id_type = docs.schema[id_col].dataType
    signed, sets = _grouped(docs, id_col, text_col, shingle, percent)
    out = _with_sets(signed.select("id", *_SAME), sets.select(*_SAME, "w", F.col("least.id").alias("component_id"), F.lit(True).alias("some")))
    component = F.when(F.col("some"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").cast(id_type).alias(id_col), "n_shingles", component.cast(id_type).alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns as they are, of which exactly one of each component stays: that with the smallest id
    (nulls last; of equal ids, the text of the smallest hash; of equal rows, any). Rows without shingles stay, each of them."""
    signed, sets = _grouped(docs, id_col, text_col, shingle, percent)
    empty = signed.where("n_shingles = 0").select("id", "th")
    winner = sets.select("component", "least").distinct().select("least.id", "least.th")
    repeated = signed.where("n_shingles > 0").groupBy("id", "th").count().where("count > 1").select(F.col("id").alias("r_id"), F.col("th").alias("r_th"))
    stays = winner.join(repeated, (F.col("th") == F.col("r_th")) & F.col("id").eqNullSafe(F.col("r_id")), "left").select("id", "th", F.col("r_th").isNotNull().alias("repeats"))
    stays = saved(stays.unionByName(empty.distinct().withColumn("repeats", F.lit(False))))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col(id_col).cast("long").alias("k_id"), F.xxhash64(F.col(text_col)).alias("k_th"))
    out = own.join(stays, (F.col("k_th") == F.col("th")) & F.col("k_id").eqNullSafe(F.col("id")))
    once = out.where("repeats").groupBy("k_id", "k_th").agg(*(F.any_value(n).alias(n) for n in names.values()))
    columns = [F.col(n).alias(c) for c, n in names.items()]
    return out.where("not repeats").select(*columns).unionByName(once.select(*columns))


def brute_force(rows: Iterable[tuple[int, str | None]], shingle: int = 5, percent: int = 80) -> dict[int, tuple[int, int]]:
    """Reference for tests: id -> (set size, component id), by comparing all pairs."""
    sets, fold = {}, bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    for key, text in rows:
        w = (text or "").encode().translate(fold).split()
        sets[key] = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
    comp = {k: k for k in sets}

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    keys = sorted(sets)
    for i, x in enumerate(keys):
        for y in keys[i + 1 :]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((root(x), root(y)))
                comp[b] = a
    return {k: (len(sets[k]), root(k)) for k in keys}
