"""Compression of vectors into one code byte a part: product quantisation in exact integer arithmetic.

Every component x counts as floor(`SCALE` * x), and a vector is cut into `parts` equal consecutive parts. Each part position has a
codebook of `entries` entries, which begins as that part of the kept vectors with the smallest ids. A round gives each part to its
nearest entry (squared Euclidean distance, ties to the lower index) and moves each entry to the componentwise floor of the mean of
its parts; an entry without parts stays.

The nearest entry is found by segment-mean lower bounds. Cut both part and entry into blocks; by Cauchy and Schwarz their squared
distance is at least the sum over blocks of (difference of block sums)^2 / block length + (difference of residual norms)^2, where a
residual norm is the length of what is left of a block without its mean. Blocks go from the whole part to halves and quarters; an
entry whose bound lies above the distance of the entry with the least first bound is out, with a margin for rounding, and only
survivors get their exact integer distance. A filter never decides by itself, so results do not depend on rounding.

A round is one pass over the vectors: tasks add up their parts' components for each entry and Spark adds the tasks' sums (as limbs of
32 bits, so they are exact for components of any size). Nothing but the codebooks and these sums, whose number does not depend on
the input, reaches the driver. The vectors are read once a round; cache or save what is dear to make.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import join_by_key, prepare, saved

SCALE = 4096
#: Components below this size have exact squared distances in 64 bits (up to 4 096 of them in a part).
SMALL = 1 << 24
MOST = (1 << 63) - 1
LIMB = 32


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither nulls nor components that are not finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of each component, shorter vectors filled up with zeros; Python integers where 64 bits could not hold them."""
    lengths = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    flat = np.asarray(vectors.flatten(), np.float64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    if not len(flat) or np.abs(flat).max() < (1 << 50):
        out = np.zeros((len(lengths), width), np.int64)
        out[rows, at] = np.floor(flat * SCALE).astype(np.int64)
        return out
    out = np.zeros((len(lengths), width), object)
    out[rows, at] = [int(np.floor(x * SCALE)) if abs(x) < (1 << 50) else int(x) * SCALE for x in flat.tolist()]  # a large double is an integer
    return out


def _levels(n: int) -> list[np.ndarray]:
    """Block starts from coarse to fine: the whole part, halves, quarters."""
    return [np.unique(np.arange(k) * n // k) for k in (1, 2, 4) if k <= n]


def _block_shape(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block sums, residual norms and block lengths."""
    length = np.diff(np.append(starts, x.shape[1])).astype(np.float64)
    total = np.add.reduceat(x, starts, axis=1).astype(np.float64)
    square = np.add.reduceat(x.astype(np.float64) ** 2, starts, axis=1)
    return total, np.sqrt(np.maximum(square - total**2 / length, 0.0)), length


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and exact squared distance of the nearest row of `book` for each row of x; ties to the lower index."""
    n = len(x)
    if x.dtype == object or book.dtype == object or max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) >= SMALL:
        d = np.array([[sum((a - b) ** 2 for a, b in zip(p, e, strict=True)) for e in book.tolist()] for p in x.tolist()], object).reshape(n, len(book))
        best = np.array([min(range(len(book)), key=lambda k, r=r: (r[k], k)) for r in d], np.int64)
        return best, d[np.arange(n), best]
    exact = lambda rows, entries: ((x[rows] - book[entries]) ** 2).sum(axis=1)
    levels = _levels(x.shape[1])
    (s, r, length), (bs, br, _) = _block_shape(x, levels[0]), _block_shape(book, levels[0])
    bound = (s - bs.T) ** 2 / length[0] + (r - br.T) ** 2
    most = exact(np.arange(n), bound.argmin(axis=1)).astype(np.float64)
    slack = 1e-9 * (most + (x.astype(np.float64) ** 2).sum(axis=1) + (book.astype(np.float64) ** 2).sum(axis=1).max()) + 1e-6
    rows, entries = np.nonzero(bound <= (most + slack)[:, None])
    for starts in levels[1:]:
        (s, r, length), (bs, br, _) = _block_shape(x, starts), _block_shape(book, starts)
        bound = ((s[rows] - bs[entries]) ** 2 / length + (r[rows] - br[entries]) ** 2).sum(axis=1)
        keep = bound <= (most + slack)[rows]
        rows, entries = rows[keep], entries[keep]
    d = exact(rows, entries)
    order = np.lexsort((entries, d, rows))  # every row has a survivor: its nearest entry
    first = order[np.searchsorted(rows[order], np.arange(n))]
    return entries[first], d[first]


def _assign(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, parts) and distances (n, parts)."""
    width = x.shape[1] // len(books)
    found = [nearest(x[:, p * width : (p + 1) * width], book) for p, book in enumerate(books)]
    return np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(number, limb) with value = sum of limb << (LIMB * number); only the last may be negative."""
    i = 0
    while not -(1 << LIMB) < value < (1 << LIMB):
        yield i, value & ((1 << LIMB) - 1)
        value >>= LIMB
        i += 1
    yield i, value


def _sums(batches: Iterator[pa.RecordBatch], width: int, books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One task's (part, entry, position, limb, value); position -1 holds the number of parts."""
    k, n_parts, own = len(books[0]), len(books), width // len(books)
    total, count = np.zeros((n_parts, k, own), object), np.zeros((n_parts, k), np.int64)
    for batch in batches:
        x = integers(batch.column("vector"), width)
        codes, _ = _assign(x, books)
        for p in range(n_parts):
            part = x[:, p * own : (p + 1) * own]
            count[p] += np.bincount(codes[:, p], minlength=k)
            for e in np.unique(codes[:, p]):
                mine = part[codes[:, p] == e]
                small = mine.dtype != object and np.abs(mine).max(initial=0) < 1 << 40
                total[p, e] += mine.sum(axis=0).astype(object) if small else mine.astype(object).sum(axis=0)
    rows = [(p, e, -1, 0, int(count[p, e])) for p in range(n_parts) for e in range(k) if count[p, e]]
    rows += [(p, e, j, i, v) for p, e, at, _, _ in list(rows) for j in range(own) for i, v in _limbs(int(total[p, e, j]))]
    yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["part", "entry", "at", "limb", "value"])


def _array(rows: list[list[int]]) -> np.ndarray:
    return np.array(rows, np.int64 if all(-MOST < v < MOST for r in rows for v in r) else object)


def codebooks(vectors: DataFrame, width: int, parts: int = 8, entries: int = 16, rounds: int = 6) -> list[np.ndarray]:
    """A codebook for each part position from rows (id, vector) of finite vectors. With fewer vectors than entries, as many entries."""
    first = vectors.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()
    if not first:
        return []
    begin, own = integers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), width), width // parts
    books = [begin[:, p * own : (p + 1) * own] for p in range(parts)]
    for _ in range(rounds):
        sums = vectors.select("vector").mapInArrow(lambda it, books=books: _sums(it, width, books), "part int, entry int, at int, limb int, value long")
        total: dict = {}
        for r in sums.groupBy("part", "entry", "at", "limb").agg(F.sum("value").alias("value")).collect():  # a few for each component of the codebooks
            key = r["part"], r["entry"], r["at"]
            total[key] = total.get(key, 0) + (r["value"] << (LIMB * r["limb"]))
        books = [_array([[total.get((p, e, j), 0) // n if (n := total.get((p, e, -1), 0)) else int(old) for j, old in enumerate(entry)] for e, entry in enumerate(book)]) for p, book in enumerate(books)]
    return books


def digest_of(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for book in books for entry in book for v in entry).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per kept vector: the id, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold null or non-finite components are left out. Vectors of different lengths (and lengths that `parts`
    does not divide) are filled up with zeros to the longest, so none is lost; an empty vector is all zeros. Null and repeated ids are
    rows like others; among the first entries null ids come last and equal ids go by their vectors. Null labels are one label; without a label column all are
    null. An error beyond 64 bits is given as the largest long. Other columns are not read. An empty table gives no rows.
    """
    prepare(vectors.sparkSession)
    label = F.col(label_col) if label_col in vectors.columns else F.lit(None).cast("int")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), label.alias("label")).where(finite(F.col("vector")))
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = parts * max(1, -(-longest // parts))
    books = codebooks(rows, width, parts, entries, rounds)
    kinds = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, far = _assign(integers(batch.column("vector"), width), books)
            text = [bytes(r).hex() for r in codes.astype(np.uint8)]
            error = [min(MOST, int(d)) for d in reduce(np.add, list(far.T))]
            yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array(text), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    coded = saved(rows.mapInArrow(code, f"id {kinds[0]}, label {kinds[1]}, code string, error long"))
    by_label = coded.groupBy("label").agg(F.count("*").alias("n"), F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST)).cast("long").alias("label_error"))
    out = join_by_key(coded, saved(by_label), ["label"])
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))
