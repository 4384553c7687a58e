"""Sharding by a k-d tree over document metadata, with shards of near-equal bytes.

A document's size is the UTF-8 bytes of its text plus `overhead`. Documents with equal texts are
one unit and stay together; a unit larger than a shard is dealt into parts by id. Units above
1/20 of a shard (800 at most, whatever the input) are placed first, largest first, on the shard
with the fewest bytes. The k-d tree then splits all other units: a node that stands for m shards
is cut at the weighted quantile that gives its first m // 2 shards their share of bytes, along
the metadata dimension (id, size, source, language) that is widest within the node; a leaf is one
shard. Ties on a coordinate are ordered by the unit's hash, so a third of all rows in one source
split as evenly as any others.

Weighted medians are found on Spark: for all nodes of a level at once, one grouped sum over
`BINS` bins of the coordinate's range, narrowed bin by bin until what is left in the bin weighs
less than 1/500 of a shard or is one unit. The driver sees only bins of at most 40 nodes.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import join_by_key, prepare, saved

BINS = 1024
DIMENSIONS = ("k_id", "k_size", "k_source", "k_lang")
_LOW_BITS, _HIGH = 36, 1 << 20
SLICES = 64
BUCKETS = 1024


@dataclass
class Node:
    """A subtree: its shards, and once it is cut, the dimension, threshold and children."""

    shards: list[int]
    name: int
    dim: str | None = None
    cut: int | None = None
    children: list[Node] = field(default_factory=list)

    def leaves(self) -> list[Node]:
        return [self] if not self.children else [x for c in self.children for x in c.leaves()]


def _by_bytes(units: DataFrame, name: str) -> DataFrame:
    """(name, k_name): the place of a value of a text dimension is the share of all bytes that lie in values before it (and
    half of its own), so two values are as far apart as the bytes between them. Values count by buckets of their hash."""
    bucket = F.pmod(F.xxhash64(name), F.lit(BUCKETS))
    rows = units.groupBy(bucket.alias("b")).agg(F.sum("bytes").alias("w")).collect()  # BUCKETS rows at most
    total, before, at = sum(r["w"] for r in rows) or 1, 0, {}
    for r in sorted(rows, key=lambda r: r["b"]):
        at[r["b"]] = int((before + r["w"] / 2) / total * (_HIGH - 1))
        before += r["w"]
    table = F.broadcast(units.sparkSession.createDataFrame(list(at.items()), "b long, place long"))
    return units.withColumn("b", bucket.cast("long")).join(table, "b", "left").drop("b").withColumnRenamed("place", f"p_{name}")


def _coordinates(units: DataFrame) -> DataFrame:
    """Each dimension as 20 bits of position and 36 bits of unit hash to break ties."""
    low, high, most = units.agg(F.min("first_id"), F.max("first_id"), F.max("size")).first()
    span = max(1, (high or 0) - (low or 0))
    units = _by_bytes(_by_bytes(units, "source"), "lang")
    where = {
        "k_id": F.floor((F.coalesce("first_id", F.lit(low or 0)) - (low or 0)) / F.lit(float(span)) * (_HIGH - 1)),
        "k_size": F.floor(F.log1p(F.col("size").cast("double")) / F.log1p(F.lit(float(most or 1))) * (_HIGH - 1)),
        "k_source": F.coalesce("p_source", F.lit(0)),
        "k_lang": F.coalesce("p_lang", F.lit(0)),
    }
    tie = F.pmod(F.xxhash64("text_hash", "text_crc32", "part"), F.lit(1 << _LOW_BITS))
    return units.withColumns({k: (c.cast("long") * F.lit(1 << _LOW_BITS) + tie).cast("long") for k, c in where.items()})


def _by_node(nodes: list[Node], pick, other: Column | None = None) -> Column:
    """A value for each node, in one flat CASE."""
    out = F.when(F.lit(False), pick(nodes[0]))
    for n in nodes:
        out = out.when(F.col("node") == n.name, pick(n))
    return out.otherwise(F.lit(None) if other is None else other)


def _split_level(units: DataFrame, nodes: list[Node], room: dict[int, float], tolerance: float) -> None:
    """Cut every node of the list; two or three aggregates for all of them."""
    at = units.where(F.col("node").isin([n.name for n in nodes]))
    aggs = [f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]
    seen = {r["node"]: r for r in at.groupBy("node").agg(F.sum("bytes").alias("w"), *aggs).collect()}
    todo = {}
    for n in nodes:
        r = seen.get(n.name)
        if r is None:
            n.dim, n.cut = DIMENSIONS[0], 0
            continue
        n.dim = max(DIMENSIONS, key=lambda d: r[f"max_{d}"] - r[f"min_{d}"])
        left = n.shards[: len(n.shards) // 2]
        share = sum(room[s] for s in left) / (sum(room[s] for s in n.shards) or 1.0)
        todo[n.name] = [r[f"min_{n.dim}"], r[f"max_{n.dim}"] + 1, share * r["w"], 0.0]  # range, wanted and settled bytes on the left
    open_ = [n for n in nodes if n.name in todo]
    while open_:
        low, wide = (lambda n: F.lit(todo[n.name][0])), (lambda n: F.lit(max(1, -(-(todo[n.name][1] - todo[n.name][0]) // BINS))))
        key = _by_node(open_, lambda n: F.col(n.dim))
        binned = at.where(F.col("node").isin([n.name for n in open_])).select("node", "bytes", key.cast("long").alias("key"), _by_node(open_, low).cast("long").alias("low"), _by_node(open_, lambda n: F.lit(todo[n.name][1])).cast("long").alias("high"), _by_node(open_, wide).cast("long").alias("wide"))
        rows = binned.where("key >= low and key < high").groupBy("node", F.expr("(key - low) div wide").alias("bin")).agg(F.sum("bytes").alias("w"), F.count("*").alias("n")).collect()
        still = []
        for n in open_:
            lo, hi, want, left = todo[n.name]
            step = max(1, -(-(hi - lo) // BINS))
            for r in sorted((r for r in rows if r["node"] == n.name), key=lambda r: r["bin"]):
                if left + r["w"] <= want:
                    left += r["w"]
                    continue
                a, b = lo + r["bin"] * step, min(hi, lo + (r["bin"] + 1) * step)
                if r["n"] == 1 or r["w"] <= tolerance or b - a <= 1:
                    n.cut = b if left + r["w"] - want < want - left else a
                else:
                    todo[n.name] = [a, b, want, left]
                    still.append(n)
                break
            else:
                n.cut = hi
        open_ = still


def kd_tree(units: DataFrame, room: dict[int, float]) -> tuple[Node, DataFrame]:
    """Split units (bytes and the coordinates) among the shards of `room` in proportion to their room: the tree, and the units with
    their leaf as node. Each level is written before the next, so no plan holds more than one level's cuts."""
    root, target = Node(sorted(room), 1), sum(room.values()) / max(1, len(room))
    units = units.withColumn("node", F.lit(1))
    while nodes := [n for n in root.leaves() if len(n.shards) > 1]:
        _split_level(units, nodes, room, target / 500)
        for n in nodes:
            half = len(n.shards) // 2
            n.children = [Node(n.shards[:half], 2 * n.name), Node(n.shards[half:], 2 * n.name + 1)]
        units = saved(units.withColumn("node", _by_node(nodes, lambda n: F.when(F.col(n.dim) < F.lit(n.cut), 2 * n.name).otherwise(2 * n.name + 1), F.col("node"))))
    return root, units


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", overhead: int = 16) -> DataFrame:
    """One row per input row: the id, size, text_crc32, shard, and slot (gapless from 0 in a shard).

    A null text has `overhead` bytes and the CRC of no bytes, and shares its unit with the empty text. Null ids and null metadata are
    values like others. Repeated rows are equal texts and stay together. Other columns are not
    read; a missing metadata column counts as null. An empty table gives no rows. With fewer units than shards, some shards are empty.
    """
    prepare(docs.sparkSession)
    extra = [(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(k) for k, c in (("source", source_col), ("lang", lang_col))]
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = saved(docs.select(F.col(id_col).alias("id"), *extra, (F.octet_length(body) + overhead).cast("long").alias("size"), F.crc32(body.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(body).alias("text_hash")))
    same = ["text_hash", "text_crc32", "size"]
    groups = rows.groupBy(*same).agg(F.min(F.col("id").cast("long")).alias("first_id"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.count("*").alias("n"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    target = max(1.0, total / shards)
    parts = F.when(F.col("size") * F.col("n") > target, F.ceil(F.col("size") * F.col("n") / (target / 25))).otherwise(1).cast("int")
    groups = saved(groups.withColumn("parts", F.least(parts, F.col("n").cast("int"))))
    split = groups.where("parts > 1").select(*same, "parts")
    # Rows of a split unit fall into its parts by a hash of id; of another, into part 0.
    dealt = rows.join(F.broadcast(split), same, "left").withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")  # at most `shards` rows are broadcast
    split_units = dealt.join(F.broadcast(split.select(*same)), same, "left_semi").groupBy(*same, "part").agg(F.min(F.col("id").cast("long")).alias("first_id"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.count("*").alias("n"))
    columns = [*same, "part", "first_id", "source", "lang", (F.col("size") * F.col("n")).alias("bytes")]
    units = groups.where("parts = 1").withColumn("part", F.lit(0)).select(*columns).unionByName(split_units.select(*columns))
    units = saved(_coordinates(units))

    load = dict.fromkeys(range(shards), 0.0)
    large = units.where(F.col("bytes") > target / 20).orderBy(F.desc("bytes"), "text_hash", "part").select(*same, "part", "bytes").collect()  # fewer than 20 * shards rows
    fixed = []
    for u in large:
        s = min(load, key=lambda k: (load[k], k))
        load[s] += u["bytes"]
        fixed.append((u["text_hash"], u["text_crc32"], u["size"], u["part"], s, u["bytes"] // u["size"]))
    small = saved(units.where(F.col("bytes") <= target / 20))
    tree, small = kd_tree(small, {s: max(0.0, target - w) for s, w in load.items()})
    shard_of = _by_node(tree.leaves(), lambda leaf: F.lit(leaf.shards[0]))
    key = [*same, "part"]
    rows_of = (F.col("bytes") / F.col("size")).cast("long")
    placed = small.select(*key, shard_of.cast("int").alias("shard"), rows_of.alias("n"))
    placed = placed.unionByName(docs.sparkSession.createDataFrame(fixed, "text_hash long, text_crc32 long, size long, part int, shard int, n long"))

    # A unit below a shard's bytes may still have very many rows, of empty texts say: such keys are broadcast.
    out = saved(join_by_key(dealt, saved(placed), key).select("id", "size", "text_crc32", "text_hash", "shard", F.pmod(F.xxhash64("id", "text_hash"), F.lit(SLICES)).cast("int").alias("slice")))
    # A slot is the slices before plus the place in the slice, so no shard is sorted as a whole.
    before = out.groupBy("shard", "slice").count().selectExpr("shard", "slice", "sum(count) over (partition by shard order by slice) - count as before")
    ranked = out.selectExpr("*", "row_number() over (partition by shard, slice order by id, text_hash) - 1 as place")
    ranked = ranked.join(F.broadcast(before), ["shard", "slice"])  # at most shards * SLICES rows
    return ranked.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("before") + F.col("place")).cast("long").alias("slot"))


def with_law(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return result.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def check_plan(rows: Iterable, shards: int) -> dict:
    """For tests and reports: the bytes of each shard, and whether slots are gapless."""
    load, slots = dict.fromkeys(range(shards), 0), {}
    for r in rows:
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    return {"bytes": load, "gapless": all(sorted(s) == list(range(len(s))) for s in slots.values())}
