"""Toxicity by a classifier chain of linear models.

Categories are predicted in order. Each has a logistic model over word features, a few document
statistics and the probabilities of all earlier categories. A later model is trained on out-of-fold
predictions of the earlier ones, so it meets probabilities of the quality it will meet later; at
prediction time, the earlier models are the ones fitted on the whole sample.

Word features are the presence of a lower-cased word, or of a word's first 4, 5 or 6 bytes. For
each category, the `FEATURES` features with the strongest association (a signed chi-square of
`LEAST_SCORE` at least, so that chance does not choose) are found by counting all features of the
sample on Spark, fold by fold: the features of an out-of-fold model are chosen without its fold's labels.
The sample is the `SAMPLE` labelled documents with the smallest
hash of id (a bound on what is fitted, whatever the size of the corpus); its rows, reduced to
the chosen features, are fitted in one task. Every document is scored, over its whole text.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import prepare, saved
from .wordhash import NOT_ALNUM, U64, blocks, mix, text_bytes, words_of

SAMPLE = 8000
FEATURES = 384
LEAST_SCORE = 16.0
PREFIXES = (4, 5, 6)
FOLDS = 4
RIDGE = 1.0
STATS = 4
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_MARK = (NOT_ALNUM & ~np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])).astype(np.int64)


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature hash) of every word and word prefix of a block."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    buf, _ = text_bytes(lower)
    w = words_of(lower, NOT_ALNUM)
    docs, out = [w.doc], [w.hash]
    size = w.end - w.start
    for n in PREFIXES:
        long = np.flatnonzero(size > n)
        value = np.zeros(len(long), U64)
        for i in range(n):
            value = value * U64(257) + buf[w.start[long] + i]
        docs.append(w.doc[long])
        out.append(mix(value + (U64(n) << U64(56))))
    return np.concatenate(docs), np.concatenate(out)


def _stats(texts: pa.Array) -> np.ndarray:
    """Shares of symbols, capitals and immediate repeats, and the log of the number of words."""
    buf, off = text_bytes(texts)
    words = words_of(texts, NOT_ALNUM)
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1)
    sums = [np.diff(np.concatenate([[0], np.cumsum(t[buf])])[off]) / size for t in (_MARK, _UPPER)]
    again = np.zeros(len(words.hash), np.int64)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    repeats = np.bincount(words.doc, again, minlength=n)[:n] / np.maximum(words.counts, 1)
    return np.column_stack([*sums, repeats, np.log1p(words.counts) / 5])


def _present(texts: pa.Array, chosen: np.ndarray) -> np.ndarray:
    """Documents by chosen features, 1 where the document has the feature."""
    x = np.zeros((len(texts), len(chosen)), np.float32)
    if len(chosen):
        doc, h = _features(texts)
        at = np.minimum(np.searchsorted(chosen, h), len(chosen) - 1)
        hit = chosen[at] == h
        x[doc[hit], at[hit]] = 1
    return x


def _count(batches: Iterable[pa.RecordBatch], n_labels: int) -> Iterator[pa.RecordBatch]:
    """Documents with each feature, by fold: all (n<fold>), and those of each label (n<fold>_<label>)."""
    for batch in (b for whole in batches for b in blocks(whole, "text")):
        doc, h = _features(batch.column("text"))
        order = np.lexsort((doc, h))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        doc, h = doc[new], h[new]
        feature, at = np.unique(h, return_inverse=True)
        fold, labels = np.asarray(batch.column("fold"))[doc], [np.ones(len(doc)), *(np.asarray(batch.column(f"y{i}"))[doc] for i in range(n_labels))]
        counts = [np.bincount(at, (fold == f) * y, minlength=len(feature)).astype(np.int64) for f in range(FOLDS) for y in labels]
        yield pa.record_batch([pa.array(feature.view(np.int64)), *map(pa.array, counts)], names=["feature", *_count_names(n_labels)])


def _count_names(n_labels: int) -> list[str]:
    return [f"n{f}{x}" for f in range(FOLDS) for x in ("", *(f"_{i}" for i in range(n_labels)))]


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 8) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * v[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def _cut(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1 on out-of-fold predictions, in the middle of its range, of those that are right
    at least every second time (predictions without skill would else call everything toxic); 0.5 without any."""
    grid = np.linspace(0.05, 0.95, 91)
    hit = np.array([((p >= t) & (y > 0)).sum() for t in grid])
    called = np.array([(p >= t).sum() for t in grid])
    f1 = np.where((2 * hit >= called) & (hit > 0), 2 * hit / np.maximum(1, called + (y > 0).sum()), 0.0)
    if not f1.any():
        return 0.5
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    return float(grid[best[len(best) // 2]])


def chain(x: np.ndarray, fold: np.ndarray, labels: list[np.ndarray], chosen: list[np.ndarray]) -> list[dict]:
    """The links of the chain: weights over (features, probabilities of earlier categories) and threshold. `chosen` says for
    each fold which columns its out-of-fold models may use, and at the end those of the whole."""
    links = []
    for y in labels:
        earlier = np.ones(len(links), bool)
        out = np.zeros(len(x))
        for f in range(FOLDS):
            train, test, on = fold != f, fold == f, np.append(chosen[f], earlier)
            if test.any() and train.any():
                out[test] = _probability(x[test][:, on], _logistic(x[train][:, on], y[train]))
        on = np.append(chosen[-1], earlier)
        w = np.zeros(len(on) + 1)
        w[np.append(on, True)] = _logistic(x[:, on], y)
        links.append({"w": w.tolist(), "cut": _cut(out, y)})
        x = np.column_stack([x, out])
    return links


def _fit(table: pa.Table, n_labels: int, chosen: list[np.ndarray]) -> pa.Table:
    order = np.argsort(np.asarray(table["key"]), kind="stable")
    n_chosen = len(chosen[0])
    x = np.zeros((len(order), n_chosen + STATS), np.float64)
    for i, (present, stats) in enumerate(zip(table["present"].to_pylist(), table["stats"].to_pylist(), strict=True)):
        x[i, present] = 1
        x[i, n_chosen:] = stats
    labels = [np.asarray(table[f"y{c}"]).astype(np.float64)[order] for c in range(n_labels)]
    links = chain(x[order], np.asarray(table["fold"])[order], labels, [np.append(c, np.ones(STATS, bool)) for c in chosen])
    return pa.table({"model": [json.dumps(links)]})


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict | None:
    """The chain's model: chosen features and, per category, weights and threshold. `labels` has id_col and a 0/1
    column for each category; rows with a null are left out, and an id labelled twice counts once.
    None where no labelled document is found."""
    prepare(docs.sparkSession)
    own = labels.groupBy(F.col(id_col).cast("long").alias("key")).agg(*(F.max(F.col(c).cast("int")).alias(f"y{i}") for i, c in enumerate(categories)))
    own = own.where(" and ".join(["key is not null", *(f"y{i} is not null" for i in range(len(categories)))]))
    own = own.orderBy(F.xxhash64("key"), "key").limit(sample)  # a few numbers for each row of the bounded sample
    fold = F.pmod(F.xxhash64("key", F.lit(13)), F.lit(FOLDS)).cast("int")
    # One row for each label: of rows that share an id, one whose text is not null, picked by its hash.
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).join(F.broadcast(own.select("key")), "key")
    texts = texts.groupBy("key").agg(F.min_by("text", F.when(F.col("text").isNotNull(), F.struct(F.xxhash64("text"), F.col("text")))).alias("text"))
    rows = saved(texts.join(F.broadcast(own), "key").withColumn("fold", fold))
    k, names = len(categories), _count_names(len(categories))
    per_fold = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), *(F.sum(f"y{i}").alias(f"n{i}") for i in range(k))).collect()}
    if not per_fold:
        return None
    shape = ", ".join(["feature long", *(f"{c} long" for c in names)])
    counts = rows.select("text", "fold", *(f"y{i}" for i in range(k))).mapInArrow(lambda it: _count(it, k), shape)
    counts = counts.groupBy("feature").agg(*(F.sum(c).alias(c) for c in names)).where(" + ".join(f"n{f}" for f in range(FOLDS)) + " >= 3")
    counts, best = saved(counts), None
    for f in range(FOLDS + 1):  # without fold f, and at last with all
        others = [g for g in range(FOLDS) if g != f]
        n = float(sum(per_fold[g]["n"] for g in others if g in per_fold))
        for i in range(k):
            share = sum(per_fold[g][f"n{i}"] for g in others if g in per_fold) / max(n, 1.0)
            seen, labelled = (sum((F.col(f"n{g}{x}") for g in others), F.lit(0)) for x in ("", f"_{i}"))
            score = (labelled - seen * share) * F.abs(labelled - seen * share) / (seen * share + 0.5)
            top = counts.select(F.lit(f).alias("f"), "feature", score.alias("score")).where(F.col("score") >= LEAST_SCORE).orderBy(F.desc("score"), "feature").limit(FEATURES)
            best = top if best is None else best.unionByName(top)
    found = best.select("f", "feature").distinct().collect()  # (FOLDS + 1) * categories * FEATURES rows at most
    picked = np.sort(np.array(sorted({r["feature"] for r in found}), np.int64).view(np.uint64))
    chosen = [np.isin(picked.view(np.int64), [r["feature"] for r in found if r["f"] == f]) for f in range(FOLDS + 1)]

    def reduce(batches):
        for batch in (b for whole in batches for b in blocks(whole, "text")):
            x = _present(batch.column("text"), picked)
            fields = [batch.column("key"), batch.column("fold"), *(batch.column(f"y{i}") for i in range(k)), pa.array([np.flatnonzero(r).astype(np.int32) for r in x], pa.list_(pa.int32())), pa.array(list(_stats(batch.column("text"))), pa.list_(pa.float64()))]
            yield pa.record_batch(fields, names=["key", "fold", *(f"y{i}" for i in range(k)), "present", "stats"])

    reduced = rows.mapInArrow(reduce, ", ".join(["key long", "fold int", *(f"y{i} int" for i in range(k)), "present array<int>", "stats array<double>"]))
    fitted = reduced.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(lambda t: _fit(t, k, chosen), "model string").first()["model"]
    return {"categories": categories, "chosen": picked, "links": json.loads(fitted)}


def _probabilities(texts: pa.Array, model: dict) -> np.ndarray:
    x = np.column_stack([_present(texts, model["chosen"]), _stats(texts)])
    for link in model["links"]:
        x = np.column_stack([x, _probability(x, np.array(link["w"]))])
    return x[:, -len(model["links"]) :]


def score(docs: DataFrame, model: dict | None, categories: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, p_<category> and <category> for each category.

    Null and empty texts are never toxic (probability 0). Without a model all probabilities are 0.
    Null and repeated ids are rows like others; other columns are not read.
    """
    shape = ", ".join([f"id {docs.schema[id_col].dataType.simpleString()}", *(f"p_{c} double" for c in categories), *(f"{c} boolean" for c in categories)])

    def run(batches):
        for batch in (b for whole in batches for b in blocks(whole, "text")):
            texts, n = batch.column("text"), batch.num_rows
            p = _probabilities(texts, model) if model else np.zeros((n, len(categories)))
            p[np.asarray(pc.fill_null(pc.equal(pc.binary_length(texts), 0), True))] = 0
            cut = [link["cut"] for link in model["links"]] if model else [1.0] * len(categories)
            yield pa.record_batch([batch.column("id"), *(pa.array(p[:, i]) for i in range(p.shape[1])), *(pa.array(p[:, i] >= t) for i, t in enumerate(cut))], names=["id", *(f"p_{c}" for c in categories), *categories])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, shape)
    return out.withColumnRenamed("id", id_col)


def without(docs: DataFrame, model: dict | None, category: str, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that the chain does not put in `category`."""
    if model is None:
        return docs
    at = model["categories"].index(category)
    place = docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            named = pa.RecordBatch.from_arrays(whole.columns, names=[str(i) for i in range(whole.num_columns)])
            for batch in blocks(named, str(place)):
                texts = batch.column(place)
                bad = _probabilities(texts, model)[:, at] >= model["links"][at]["cut"]
                bad &= ~np.asarray(pc.fill_null(pc.equal(pc.binary_length(texts), 0), True))
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(~bad)).columns, schema=whole.schema)

    return docs.mapInArrow(run, docs.schema)
