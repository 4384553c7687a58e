"""Removal of repeated word spans by difference-cover anchors.

A window is `window` consecutive words of one document. Every word covered by a window whose
word sequence also starts earlier (in a smaller document id, or earlier in the same document)
is removed. Windows are judged on the input.

Two equal windows at any two offsets share an anchor of `window - period + 1` words at a position
that lies, in both documents, on a difference cover modulo `period`: the cover has a pair of
members for every difference of offsets. So only the anchors at cover positions are hashed and
matched (4 of 13 positions for a window of 20), and only windows around an anchor that occurs
elsewhere are extended to whole windows and compared. Anchors are a filter: a false hit costs one
more window and changes no result. Windows are compared by 96 bits of hash, from word hashes of two bases.

Work is spread as follows. Documents are dealt to groups of about 2 MB by a hash of id and text,
so copies of one text spread over all groups. Each group sends each of its distinct anchors and
distinct windows once to the bucket of its hash; a key that a third of all rows share reaches its
bucket once per group, never once per row. The texts are shuffled once; the exchange is reused.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import group_count, prepare, text_volume
from .wordhash import SPACE, U64, Words, words_of

#: Perfect difference sets, period -> members.
COVERS = {
    1: (0,),
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
}

_OUT = "id {id}, n_words long, n_removed long, kept_text string, removed array<struct<start:long,stop:long>>"


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest known cover whose anchors keep at least a third of the window."""
    period = max(p for p in COVERS if p == 1 or window - p + 1 >= max(2, window // 3))
    return period, COVERS[period]


def _packed(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Runs of equal (sorted) keys, and each column's values of a run as one binary value."""
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    ends = np.append(cut, len(key)).astype(np.int64)
    out = []
    for c in columns:
        data = np.ascontiguousarray(c)
        out.append(pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer((ends * data.itemsize).astype(np.int32)), pa.py_buffer(data)]))
    return key[cut], out


def _values(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed column, and the number of the row that each came from."""
    rows = [np.frombuffer(x, dtype) for x in column.to_pylist() if x is not None]
    if not rows:
        return np.empty(0, dtype), np.empty(0, np.int64)
    return np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


def _in_order(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")], null_placement="at_start"))


def _anchors(words: Words, window: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and code (bucket and 32 hash bits) of each anchor at a cover position."""
    period, members = cover_for(window)
    cover = np.zeros(period, bool)
    cover[list(members)] = True
    at, h = words.grams(window - period + 1)
    on = cover[(at - words.first[words.doc[at]]) % period]
    at, h = at[on], h[on]
    return at, ((h % U64(buckets)) << U64(32)) | (h >> U64(32))


def _send_anchors(table: pa.Table, window: int, buckets: int) -> pa.Table:
    table = _in_order(table)
    code = np.unique(_anchors(words_of(table["text"], SPACE), window, buckets)[1])
    bucket, (values,) = _packed((code >> U64(32)).astype(np.int32), code.astype(np.uint32))
    group = np.full(len(bucket), table["grp"][0].as_py(), np.int32)
    return pa.table({"bucket": bucket, "grp": group, "anchors": values})


def _meet_anchors(table: pa.Table) -> pa.Table:
    """Of each group's anchors, those that another group sent too."""
    value, row = _values(table["anchors"], np.uint32)
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    same = value[1:] == value[:-1]
    met = np.zeros(len(value), bool)
    met[1:] |= same
    met[:-1] |= same
    value, row = value[met], row[met]
    order = np.argsort(row, kind="stable")
    rows, (values,) = _packed(row[order], value[order])
    return pa.table({"grp": np.asarray(table["grp"])[rows].astype(np.int32), "bucket": np.asarray(table["bucket"])[rows].astype(np.int32), "anchors": values})


_WINDOWS = "bucket int, grp int, h1 binary, h2 binary, ids binary, starts binary"


def _send_windows(texts: pa.Table, hits: pa.Table, window: int, buckets: int) -> pa.Table:
    """The distinct windows around anchors that recur; later repeats within the group are settled."""
    schema = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), *((c, pa.binary()) for c in ("h1", "h2", "ids", "starts"))])
    if not texts.num_rows:
        return schema.empty_table()
    texts = _in_order(texts)
    words = words_of(texts["text"], SPACE)
    at, code = _anchors(words, window, buckets)
    value, row = _values(hits["anchors"], np.uint32)
    known = np.sort((np.asarray(hits["bucket"]).astype(np.uint64)[row] << U64(32)) | value) if len(value) else np.empty(0, np.uint64)
    unique, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    hot = count > 1
    if len(known):
        place = np.minimum(np.searchsorted(known, unique), len(known) - 1)
        hot |= known[place] == unique
    at = at[hot[inverse]]
    reach = window - cover_for(window)[0] + 1
    step = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(step, np.maximum(at - (window - reach), words.first[words.doc[at]]), 1)
    np.add.at(step, at + 1, -1)
    start, h1 = words.grams(window, 0)
    h2 = words.grams(window, 1)[1]
    near = (np.cumsum(step)[:-1] > 0)[start] if len(start) else np.empty(0, bool)
    start, h1, h2 = start[near], h1[near], (h2[near] >> U64(32)).astype(np.uint32)
    order = np.lexsort((start, h2, h1))
    start, h1, h2 = start[order], h1[order], h2[order]
    first = np.ones(len(start), bool)
    first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    late = np.sort(start[~first]).astype(np.uint32)
    start, h1, h2 = start[first], h1[first], h2[first]
    bucket = (h1 % U64(buckets)).astype(np.int32)
    order = np.lexsort((start, bucket))
    start, h1, h2, bucket = start[order], h1[order], h2[order], bucket[order]
    ids = np.asarray(pc.fill_null(texts["id"], np.iinfo(np.int64).min)).astype(np.int64)[words.doc[start]]
    grp = texts["grp"][0].as_py()
    keys, packed = _packed(bucket, h1, h2, ids, start.astype(np.uint32))
    out = pa.table([pa.array(keys, pa.int32()), pa.array(np.full(len(keys), grp, np.int32)), *packed], schema=schema)
    if len(late):
        own = pa.table([pa.array([grp % buckets], pa.int32()), pa.array([grp], pa.int32()), *(pa.nulls(1, pa.binary()) for _ in range(3)), pa.array([late.tobytes()], pa.binary())], schema=schema)
        out = pa.concat_tables([out, own])
    return out


def _meet_windows(table: pa.Table) -> pa.Table:
    """Of each window that several groups sent, all but the earliest."""
    settled = table.filter(pc.is_null(table["h1"])).select(["grp", "starts"])
    table = table.filter(pc.is_valid(table["h1"]))
    h1, row = _values(table["h1"], np.uint64)
    h2, ids, start = (_values(table[c], t)[0] for c, t in (("h2", np.uint32), ("ids", np.int64), ("starts", np.uint32)))
    grp = np.asarray(table["grp"]).astype(np.int32)[row] if len(row) else np.empty(0, np.int32)
    order = np.lexsort((start, grp, ids, h2, h1))
    h1, h2 = h1[order], h2[order]
    late = np.zeros(len(order), bool)
    late[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
    order = order[late]
    grp, start = grp[order], start[order]
    order = np.lexsort((start, grp))
    keys, (packed,) = _packed(grp[order], start[order])
    return pa.concat_tables([settled.cast(pa.schema([("grp", pa.int32()), ("starts", pa.binary())])), pa.table({"grp": pa.array(keys, pa.int32()), "starts": packed})])


def _cut(texts: pa.Table, late: pa.Table, window: int, schema: pa.Schema) -> pa.Table:
    """Drop the covered words of each text."""
    if not texts.num_rows:
        return schema.empty_table()
    texts = _in_order(texts)
    words = words_of(texts["text"], SPACE)
    start = _values(late["starts"], np.uint32)[0].astype(np.int64)
    step = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, np.minimum(start + window, len(words.hash)), -1)
    gone = np.cumsum(step)[:-1] > 0
    keep = (~gone).tobytes()
    counts = words.counts
    removed = np.add.reduceat(np.append(gone, 0).astype(np.int64), words.first[:-1]) * (counts > 0) if len(counts) else counts
    kept, spans = [], []
    for i, (text, a, b) in enumerate(zip(texts["text"].to_pylist(), words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        own = (text or "").encode().split()
        kept.append(b" ".join(own if not removed[i] else compress(own, keep[a:b])).decode())
        if removed[i]:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]])))
            spans.append([{"start": s, "stop": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
        else:
            spans.append([])
    return pa.table([texts["id"], pa.array(counts), pa.array(removed), pa.array(kept, pa.string()), pa.array(spans, schema.field("removed").type)], schema=schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, groups: int | None = None) -> DataFrame:
    """Cut every repeated span of at least `window` words but its first occurrence.

    Words are maximal runs of bytes other than ASCII white space, unchanged. Returns one row per
    input row: the id, n_words, n_removed, kept_text (kept words joined by one space) and removed
    (word ranges [start, stop)). Null and empty texts have no words and an empty kept_text. A null
    id sorts before all others. Rows that share an id count as separate documents in a fixed
    order, so a repeated row counts as later than its first copy. Other columns are not read.
    `groups` is the number of document groups and hash buckets; by default one for each 2 MB.
    """
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = groups or group_count(text_volume(rows, "text"))
    rows = rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int").alias("grp"), "id", "text")
    by_group = rows.groupBy("grp")
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])

    anchors = by_group.applyInArrow(lambda t: _send_anchors(t, window, n), "bucket int, grp int, anchors binary")
    hits = anchors.groupBy("bucket").applyInArrow(_meet_anchors, "grp int, bucket int, anchors binary")
    windows = by_group.cogroup(hits.groupBy("grp")).applyInArrow(lambda a, b: _send_windows(a, b, window, n), _WINDOWS)
    late = windows.groupBy("bucket").applyInArrow(_meet_windows, "grp int, starts binary")
    out = by_group.cogroup(late.groupBy("grp")).applyInArrow(lambda a, b: _cut(a, b, window, schema), _OUT.format(id="long"))
    return out.select(F.col("id").cast(id_type).alias(id_col), "n_words", "n_removed", "kept_text", "removed")


def digest(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result without its texts: one hash of the kept words per document."""
    return result.select(id_col, "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), F.size("removed").cast("long").alias("n_spans"))


def brute_force(rows: Iterable[tuple[int, str | None]], window: int = 20) -> dict[int, tuple[int, int, str]]:
    """Reference for tests: id -> (n_words, n_removed, kept text)."""
    seen: set[tuple[bytes, ...]] = set()
    out = {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        out[key] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode())
    return out
