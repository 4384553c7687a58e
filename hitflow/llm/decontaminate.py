"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A window is
`window` consecutive words of an item, or the whole item where it has fewer. A document word
inside any occurrence of any window is hit.

Winnowing with k-grams of `min(5, window)` words keeps, for each run of `window - k + 1`
consecutive k-grams, the smallest hash. Two equal windows have the same k-grams and so the same
smallest hash: every shared span of at least `window` words shares a fingerprint. Documents'
distinct fingerprints meet the benchmark's in a join. In the documents that this finds, and in no
others, the k-grams that a fingerprint names are placed, and the windows around them are cut out and
compared with the items' windows word by word.

Items shorter than `window` get fingerprints of their own length, made only for lengths that occur.
The benchmark's tables are broadcast only if their windows are counted at `BROADCAST_ROWS` and
`BROADCAST_BYTES` of words at most; above either, the joins shuffle. So it is with the rows that are hit.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import prepare, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def gram_size(length: int) -> int:
    return min(5, length)


def _upto(n: Column, f) -> Column:
    """f(0) .. f(n-1) as an array, empty for n < 1."""
    return F.when(n >= 1, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), f))


def _grams(w: Column, k: int) -> Column:
    return _upto(F.size(w) - (k - 1), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))


def _least(grams: Column, run: int) -> Column:
    """The smallest hash of each `run` consecutive k-grams, each once."""
    return F.array_distinct(grams if run == 1 else _upto(F.size(grams) - (run - 1), lambda i: F.array_min(F.slice(grams, i + 1, run))))


def _fingerprints(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds fps: the distinct fingerprints of df's column w, tagged with the window length that they are for."""
    sizes = sorted({gram_size(n) for n in lengths})
    df = df.withColumns({f"g{k}": _grams(F.col("w"), k) for k in sizes})
    tagged = lambda n: F.transform(_least(F.col(f"g{gram_size(n)}"), n - gram_size(n) + 1), lambda x: F.xxhash64(x, F.lit(n)))
    parts = [F.coalesce(tagged(n), F.array().cast("array<bigint>")) for n in lengths]
    return df.withColumn("fps", F.concat(*parts) if len(parts) > 1 else parts[0]).drop(*(f"g{k}" for k in sizes))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _prints(df: DataFrame, *keep: str) -> DataFrame:
    """One row per fingerprint. The outer form keeps the optimiser from copying the array's whole
    expression, lambdas included, into a filter on its size."""
    return df.select(*keep, F.explode_outer("fps").alias("fp")).where("fp is not null")


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, length, span): the distinct windows of each item."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    items = items.withColumn("length", F.least(F.size("w"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)
    return items.select("item", "length", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.col("length")))).alias("span")).distinct()


def _hit_rows(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int) -> DataFrame | None:
    """(id, row_hash, hit_starts, items) of the rows that hold a window; None without any items."""
    spans = saved(item_windows(benchmark, item_col, item_text_col, window))
    volume = F.octet_length(F.array_join("span", " ")) + F.octet_length(F.coalesce("item", F.lit("")))
    per_length = spans.groupBy("length").agg(F.count("*").alias("n"), F.sum(volume).alias("volume")).collect()  # one row for each window length, at most `window` rows
    lengths = sorted(r["length"] for r in per_length)
    if not lengths:
        return None
    small = sum(r["n"] for r in per_length) <= BROADCAST_ROWS and sum(r["volume"] for r in per_length) <= BROADCAST_BYTES
    near = F.broadcast if small else (lambda df: df)

    # 1. Rows of which a fingerprint is one of the benchmark's.
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_hash"), F.col(text_col).alias("text"))
    item_prints = _prints(_fingerprints(spans.withColumnRenamed("span", "w"), lengths)).select("fp").distinct()
    hits = saved(_prints(_fingerprints(rows.select("id", "row_hash", words(F.col("text")).alias("w")), lengths), "id", "row_hash").join(near(item_prints), "fp", "left_semi").select("id", "row_hash").distinct())
    n_hits = hits.count()
    same = lambda df: (F.col("row_hash") == F.col("hit_hash")) & F.col("id").eqNullSafe(F.col("hit_id"))
    named = lambda df: df.withColumnsRenamed({"id": "hit_id", "row_hash": "hit_hash"})
    met = rows.join(_small(named(hits), n_hits), same(hits)).select("id", "row_hash", words(F.col("text")).alias("w"))

    # 2. The places of the k-grams that a fingerprint names.
    anchors = None
    for k in sorted({gram_size(x) for x in lengths}):
        own = [x for x in lengths if gram_size(x) == k]
        grams = [spans.where(F.col("length") == x).select("length", F.explode(_least(_grams(F.col("span"), k), x - k + 1)).alias("gram")) for x in own]
        grams = reduce(DataFrame.unionByName, grams).distinct()
        placed = met.select("id", "row_hash", F.posexplode(F.coalesce(_grams(F.col("w"), k), F.array().cast("array<bigint>"))).alias("p", "gram"))
        found = placed.join(near(grams), "gram").select("id", "row_hash", "length", "p")
        anchors = found if anchors is None else anchors.unionByName(found)
    anchors = saved(anchors.groupBy("id", "row_hash").agg(F.collect_set(F.struct("length", "p")).alias("at")))

    # 3. The windows around them, compared word by word. Each carries its own words only, not the text's.
    n = F.size("w")

    def around(a: Column) -> Column:
        first, last = F.greatest(a["p"] - (a["length"] - F.least(a["length"], F.lit(5))), F.lit(0)), F.least(a["p"], n - a["length"])
        return F.when(first <= last, F.transform(F.sequence(first, F.greatest(first, last)), lambda s: F.struct(a["length"].alias("length"), s.cast("int").alias("start"))))

    places = anchors.agg(F.sum(F.size("at"))).first()[0] or 0  # a text of any length may have many
    held = met.join(_small(named(anchors), n_hits + places // 4), same(anchors))
    wide = F.array_distinct(F.flatten(F.filter(F.transform("at", around), lambda x: x.isNotNull())))
    cut = held.select("id", "row_hash", "w", wide.alias("wide")).select("id", "row_hash", F.explode(F.transform("wide", lambda a: F.struct(a.alias("at"), F.slice("w", a["start"] + 1, a["length"]).alias("span")))).alias("x"))
    seen = cut.select("id", "row_hash", "x.at", "x.span").join(near(spans.select("span", "item")), "span")
    return seen.groupBy("id", "row_hash").agg(F.array_sort(F.collect_set("at")).alias("hit_starts"), F.array_sort(F.collect_set("item")).alias("items"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10
) -> DataFrame:
    """One row per input row: the id, n_words, n_hit, hit_starts, items and contaminated.

    hit_starts holds (length, start) of each window found, items the sorted item ids as strings.
    Null and empty texts have no words and no hits; null ids are kept. Equal rows get equal
    results. Items without words are ignored, and items whose id is null are not counted as items
    though their words count as hit. An empty benchmark hits nothing. Other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_hash"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    found = _hit_rows(docs, benchmark, id_col, text_col, item_col, item_text_col, window)
    starts, items = F.array().cast("array<struct<length:int,start:int>>"), F.array().cast("array<string>")
    if found is None:
        out = rows.withColumns({"hit_starts": starts, "items": items})
    else:
        found = saved(found)
        size = found.agg(F.count("*").alias("n"), F.sum(F.size("hit_starts")).alias("places")).first()
        found = found.select(F.col("id").alias("hit_id"), F.col("row_hash").alias("hit_hash"), "hit_starts", "items")
        found = _small(found, size["n"] + (size["places"] or 0) // 4)
        out = rows.join(found, (F.col("row_hash") == F.col("hit_hash")) & F.col("id").eqNullSafe(F.col("hit_id")), "left").withColumns({"hit_starts": F.coalesce("hit_starts", starts), "items": F.coalesce("items", items)})
    # hit_starts is sorted: the words of a window that no window before has covered count. Windows differ in length, so the furthest end so far is kept.
    step = "struct<stop:int,n:bigint>"
    by_start = F.array_sort(F.transform("hit_starts", lambda a: F.struct(a["start"].alias("start"), (a["start"] + a["length"]).alias("stop"))))
    covered = F.aggregate(
        by_start, F.struct(F.lit(0).alias("stop"), F.lit(0).cast("long").alias("n")).cast(step),
        lambda s, a: F.struct(F.greatest(s["stop"], a["stop"]).alias("stop"), (s["n"] + F.greatest(a["stop"] - F.greatest(a["start"], s["stop"]), F.lit(0))).cast("long").alias("n")),
    )
    return out.select(F.col("id").alias(id_col), "n_words", covered["n"].alias("n_hit"), "hit_starts", "items", (F.size("hit_starts") > 0).alias("contaminated"))


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10
) -> DataFrame:
    """The rows of docs, all columns as they are, that hold no window of the benchmark. Each row is judged by its own text."""
    prepare(docs.sparkSession)
    found = _hit_rows(docs, benchmark, id_col, text_col, item_col, item_text_col, window)
    if found is None:
        return docs
    bad = saved(found.select(F.col("id").alias("hit_id"), F.col("row_hash").alias("hit_hash")))
    return docs.join(_small(bad, bad.count()), F.col(id_col).eqNullSafe(F.col("hit_id")) & (F.xxhash64(F.col(id_col), F.col(text_col)) == F.col("hit_hash")), "left_anti")


def digest(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    joined = F.array_join("items", ",")
    return result.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i : i + least(len(w), 10) - 1] AS span FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, w[i : i + n - 1] AS span FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.span = bw.span AND dw.n = bw.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def brute_force(rows: Iterable[tuple[int, str | None]], items: Iterable[tuple[int, str | None]], window: int = 10) -> dict[int, tuple[int, int, list[str]]]:
    """Reference for tests: id -> (n_words, n_hit, item ids)."""
    import re

    fold = str.maketrans(UPPER, LOWER)
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(fold))
    spans: dict[tuple[str, ...], set[str]] = {}
    for key, text in items:
        w = split(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            spans.setdefault(tuple(w[i : i + n]), set()).add(str(key))
    out = {}
    for key, text in rows:
        w, hit, seen = split(text), set(), set()
        for n in {len(s) for s in spans}:
            for i in range(len(w) - n + 1):
                if (s := tuple(w[i : i + n])) in spans:
                    hit.update(range(i, i + n))
                    seen |= spans[s]
        out[key] = (len(w), len(hit), sorted(seen))
    return out
