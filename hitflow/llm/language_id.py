"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased and every run of characters that are not letters counts as one space. Each
language has a model of order `ORDER`: the highest order is estimated from counts of n-grams, the
lower ones from the number of distinct characters that precede an n-gram, with absolute discounting
at every order (the discount is n1 / (n1 + 2 n2)) and interpolation down to the uniform
distribution.

A model is fitted on about `PER_LANGUAGE` whole documents per language, those whose id hashes
below the share that this number is of the language's documents (a bound on what is fitted,
whatever the size of the corpus). Distinct n-grams are counted on Spark and only their counts come
to the driver. All languages share one sorted array of n-gram hashes per order, with a row of
interpolated log probabilities and of back-off weights, one column per language, so that one binary
search serves all languages.

A document gets the language with the lowest cross-entropy per character over its whole text.
Rejection is calibrated on the sample itself, each half scored by models of the other half. A text's
excess, its cross-entropy above its language's mean, shrinks with the root of its length, so excess
times root is alike at all lengths; of all sampled documents of any language, the `REJECT` with the most lie
above the limit (with fewer than 1 / `REJECT` documents nothing is rejected).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import prepare, saved
from .wordhash import U64, blocks, mix

ORDER = 4
PER_LANGUAGE = 2000
HALVES = 2
REJECT = 0.01
TEMPERATURE = 20.0
_BITS = U64(21)  # a code point


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each text between two spaces, and where each text starts and ends."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+", " ")
    plain = pc.binary_join_element_wise("", pc.utf8_trim_whitespace(plain), "", " ")
    size = np.asarray(pc.utf8_length(plain), dtype=np.int64)
    points = np.frombuffer("".join(plain.to_pylist()).encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(size)])


def _grams(points: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each position (0 where fewer lie in the text): a sum of mixed code points."""
    h = points.astype(np.uint64) + U64(1)
    total = h.copy()
    for back in range(1, n):
        total[back:] += mix(h[:-back] << _BITS | U64(back))
    total[place < n - 1] = 0
    return total


def _count(batches: Iterable[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams of the highest order with their count, per language and half."""
    for batch in (b for whole in batches for b in blocks(whole, "text")):
        points, cut = characters(batch.column("text"))
        which = np.repeat(np.asarray(batch.column("number")) * HALVES + np.asarray(batch.column("half")), np.diff(cut)).astype(np.int64)
        if len(points) < order:
            continue
        doc = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        at = np.flatnonzero(doc[order - 1 :] == doc[: len(doc) - order + 1])
        both = np.column_stack([which[at], *(points[at + i].astype(np.int64) for i in range(order))])
        packed = np.ascontiguousarray(both).view([("", np.int64)] * (order + 1)).ravel()
        unique, n = np.unique(packed, return_counts=True)
        names = unique.dtype.names
        yield pa.record_batch([pa.array(unique[x]) for x in names] + [pa.array(n)], names=["number", *(f"c{i}" for i in range(order)), "n"])


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each wanted hash in a sorted array, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    row = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return row, keys[row] == wanted


@dataclass
class Model:
    """Per order, sorted hashes of n-grams with log probabilities and of contexts with log back-off
    weights, one column per language."""

    languages: list[str]
    keys: list[np.ndarray]
    log_p: list[np.ndarray]
    contexts: list[np.ndarray]
    log_gamma: list[np.ndarray]
    unseen: np.ndarray  # log probability of an unknown character
    usual: np.ndarray | None = None  # mean cross-entropy of each language's own texts
    limit: float = np.inf  # of excess times the root of the length

    def entropy(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character in bits, texts by languages, and the number of characters scored."""
        points, cut = characters(texts)
        n, k, top = len(cut) - 1, len(self.languages), len(self.keys)
        total = np.zeros((n, k))
        if not len(points):
            return total, np.zeros(n, np.int64)
        doc = np.repeat(np.arange(n), np.diff(cut))
        where = np.arange(len(points)) - cut[:-1][doc]
        hashes = [_grams(points, where, i + 1) for i in range(top)]
        todo = np.flatnonzero(where > 0)  # the leading space is given
        scored = np.bincount(doc[todo], minlength=n)
        place = where[todo]
        for order in range(top, 0, -1):
            able = place >= order - 1
            at = todo[able]
            h = hashes[order - 1][at]
            row, hit = _find(self.keys[order - 1], h)
            self._add(total, doc[at[hit]], self.log_p[order - 1][row[hit]])
            if order > 1:  # what is unknown falls back by the weight of its context
                lost = at[~hit]
                row, known = _find(self.contexts[order - 2], hashes[order - 2][lost - 1])
                self._add(total, doc[lost[known]], self.log_gamma[order - 2][row[known]])
            else:
                total += np.bincount(doc[at[~hit]], minlength=n)[:, None] * self.unseen
            left = np.concatenate([at[~hit], todo[~able]])
            todo, place = left, where[left]
        return -total / np.log(2) / np.maximum(scored, 1)[:, None], scored

    @staticmethod
    def _add(total: np.ndarray, doc: np.ndarray, values: np.ndarray) -> None:
        for i in range(total.shape[1]):
            total[:, i] += np.bincount(doc, values[:, i], minlength=len(total))

    def answer(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language number (-1: no letter), posterior, cross-entropy, and whether the text is rejected."""
        bits, n = self.entropy(texts)
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(best)), best]
        odds = np.exp(-TEMPERATURE * (bits - low[:, None]))
        score = 1 / odds.sum(axis=1)
        excess = 0.0 if self.usual is None else (low - self.usual[best]) * np.sqrt(n)
        none = np.asarray(pc.fill_null(pc.invert(pc.match_substring_regex(texts, r"\p{L}")), True))
        return np.where(none, -1, best), np.where(none, 0.0, score), np.where(none, 0.0, low), none | (excess > self.limit)


def _hash_of(columns: np.ndarray) -> np.ndarray:
    """The hash of _grams for n-grams given as rows of code points."""
    points = columns.astype(np.uint64) + U64(1)
    total = points[:, -1].copy()
    for back in range(1, columns.shape[1]):
        total += mix(points[:, -1 - back] << _BITS | U64(back))
    return total


def _collapse(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    packed = np.ascontiguousarray(grams).view([("", np.int64)] * grams.shape[1]).ravel()
    unique, at = np.unique(packed, return_inverse=True)
    return unique.view(np.int64).reshape(len(unique), -1), np.bincount(at.ravel(), n, minlength=len(unique))


def kneser_ney(counts: list[tuple[np.ndarray, np.ndarray]], languages: list[str], order: int = ORDER) -> Model:
    """Models from each language's distinct n-grams (rows of code points) and counts."""
    k = len(languages)
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = []  # from the highest order down
    levels.append(counts)
    for _ in range(order - 1):
        levels.append([_collapse(g[:, 1:], np.ones(len(g))) if len(g) else (g[:, 1:], n) for g, n in levels[-1]])
    levels = levels[::-1]
    alphabet = np.unique(np.concatenate([g[:, 0] for g, _ in levels[0]] or [np.zeros(0, np.int64)]))
    floor = 1.0 / (len(alphabet) + 1)
    keys, log_p, contexts, log_gamma = [], [], [], []
    lower: tuple[np.ndarray, np.ndarray] | None = None  # (keys, p) of the order below
    for level, own in enumerate(levels, 1):
        grams = np.unique(np.concatenate([g for g, _ in own]), axis=0) if any(len(g) for g, _ in own) else np.zeros((0, level), np.int64)
        h = _hash_of(grams) if len(grams) else np.zeros(0, np.uint64)
        place = np.argsort(h)
        grams, h = grams[place], h[place]
        below = np.full((len(h), k), floor)
        if lower is not None and len(h):
            below = lower[1][np.searchsorted(lower[0], _hash_of(grams[:, 1:]))]
        heads = np.unique(_hash_of(grams[:, :-1])) if level > 1 and len(grams) else np.zeros(1, np.uint64)
        context = np.searchsorted(heads, _hash_of(grams[:, :-1])) if level > 1 and len(grams) else np.zeros(len(h), np.int64)
        p, gamma = np.zeros((len(h), k)), np.ones((len(heads), k))
        for i, (g, n) in enumerate(own):
            if not len(g):
                p[:, i] = below[:, i]
                continue
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
            seen = np.searchsorted(h, _hash_of(g))
            held = context[seen]
            total, kinds = np.bincount(held, n, minlength=len(heads)), np.bincount(held, minlength=len(heads))
            gamma[:, i] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            p[:, i] = gamma[context, i] * below[:, i]
            p[seen, i] += np.maximum(n - discount, 0) / total[held]
        if level == 1:
            unseen = np.log(floor * gamma[0])
        else:
            contexts.append(heads)
            log_gamma.append(np.log(gamma).astype(np.float32))
        keys.append(h)
        log_p.append(np.log(np.maximum(p, 1e-12)).astype(np.float32))
        lower = (h, p)
    return Model(languages, keys, log_p, contexts, log_gamma, unseen)


def fit_languages(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """A model for each non-null value of lang_col among the rows where `learn` is true (all by default); None without any."""
    prepare(docs.sparkSession)
    rows = docs.where(learn) if learn is not None else docs
    rows = rows.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return None
    languages = sorted(sizes)
    share = [(x, i, min(1.0, per_language / sizes[x])) for i, x in enumerate(languages)]
    table = F.broadcast(docs.sparkSession.createDataFrame(share, "lang string, number int, share double"))  # a row for each language
    draw = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    sample = saved(rows.withColumn("draw", draw).join(table, "lang").where("draw < share").select("number", "text", F.pmod(F.xxhash64("key", F.lit(5)), F.lit(HALVES)).cast("int").alias("half")))
    names = [f"c{i}" for i in range(ORDER)]
    shape = ", ".join(["number long", *(f"{c} long" for c in names), "n long"])
    found = sample.mapInArrow(lambda it: _count(it, ORDER), shape).groupBy("number", *names).agg(F.sum("n").alias("n")).toArrow()  # distinct n-grams of the bounded sample
    number, grams, n = np.asarray(found["number"]), np.column_stack([np.asarray(found[c]) for c in names]), np.asarray(found["n"]).astype(np.float64)

    def counted(halves: list[int]) -> Model:
        own = [np.isin(number, [i * HALVES + h for h in halves]) for i in range(len(languages))]
        return kneser_ney([_collapse(grams[x], n[x]) if x.any() else (grams[:0], n[:0]) for x in own], languages)

    trials = [counted([h for h in range(HALVES) if h != own]) for own in range(HALVES)]
    scored = saved(sample.mapInArrow(lambda it: _calibration(it, trials), "number int, chars long, bits double"))
    usual = np.zeros(len(languages))
    for r in scored.groupBy("number").agg((F.sum(F.col("bits") * F.col("chars")) / F.sum("chars")).alias("mean")).collect():
        usual[r["number"]] = r["mean"]
    excess = (F.col("bits") - F.get(F.array(*(F.lit(float(u)) for u in usual)), F.col("number"))) * F.sqrt("chars")
    known, limit = scored.agg(F.count("*"), F.percentile_approx(excess, 1 - REJECT, 100_000)).first()
    model = counted(list(range(HALVES)))
    model.usual, model.limit = usual, float(limit) if known * REJECT >= 1 else np.inf
    return model


def _calibration(batches: Iterable[pa.RecordBatch], trials: list[Model]) -> Iterator[pa.RecordBatch]:
    """Characters and cross-entropy of each text under its language's model of the other half."""
    for batch in (b for whole in batches for b in blocks(whole, "text")):
        for half, model in enumerate(trials):
            own = batch.filter(pc.equal(batch.column("half"), half))
            if own.num_rows:
                bits, n = model.entropy(own.column("text"))
                number, some = np.asarray(own.column("number")), np.flatnonzero(n > 0)
                yield pa.record_batch([pa.array(number[some].astype(np.int32)), pa.array(n[some].astype(np.int64)), pa.array(bits[some, number[some]])], names=["number", "chars", "bits"])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, lang_pred, score (0 to 1), bits (per character) and rejected.

    lang_pred is `und` and score 0 where the text is null, empty or has no letter, and everywhere
    without a model. Otherwise it names the closest language even where the text is rejected (too
    unlike all learned ones). Ties go to the first language in alphabetic order. Null and repeated
    ids are rows like others; other columns are not read.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that was fitted
    shape = f"id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, bits double, rejected boolean"

    def run(batches):
        own = shared.value
        for batch in (b for whole in batches for b in blocks(whole, "text")):
            n = batch.num_rows
            best, score, bits, rejected = own.answer(batch.column("text")) if own else (np.full(n, -1), np.zeros(n), np.zeros(n), np.ones(n, bool))
            names = np.array([*(own.languages if own else []), "und"], object)[best]
            yield pa.record_batch([batch.column("id"), pa.array(names, pa.string()), pa.array(score), pa.array(bits), pa.array(rejected)], names=["id", "lang_pred", "score", "bits", "rejected"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, shape).withColumnRenamed("id", id_col)


def fold(id_col: str = "doc_id", folds: int = 4) -> Column:
    """The fold of a row: CRC-32 of the id's text modulo `folds`; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def held_out(key) -> bool:
    """fold() == 2 for one id, for tests."""
    return key is not None and zlib.crc32(str(key).encode()) % 4 == 2
