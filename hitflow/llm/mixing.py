"""Mixing to target weights by soft domain membership, with DataFrame functions only.

1. A naive Bayes classifier is counted from a labelled table: each document has a few bounded
   features (binned shares of symbols, capitals, distinct words, word length, size, and word scores), and the
   posterior of a domain is the normalised product of its prior and feature likelihoods. A word score is the mean, over a document's
   words, of the log odds of a domain against the others; words fall into `BUCKETS` buckets by hash, whose odds are counted on one half of
   about `LABELLED` labelled documents (a bound on what is fitted). Its bins have equal shares of the other half, which alone counts their likelihoods.
2. Document rates start at 1 and follow an accelerated projected gradient of the squared relative gap
   between each domain's expected tokens, sum(rate * tokens * posterior), and its target. The gap
   counts relative to the domain's tokens, and a document's step is the average of its domains'
   relative gaps, so that a domain of a millionth of all tokens moves as fast as any other. Rates are
   projected on rate >= 0 (and <= max_rate where given) after each step. A step needs one number
   per domain, summed on Spark over the posteriors; documents of equal posteriors (to 3 significant digits) are
   summed before, so a step reads a small table and never the texts. Every `KEEP` steps that table is written with its rates. Steps end where each domain is
   within `GAP` of its target, or where no step helps (a warning says so: the targets are out of reach).
3. A document appears floor(rate + u) times, u being a hash of its id in [0, 1): the expected count
   is its rate.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import prepare, saved

LETTERS_AND_SPACE = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n\t\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = ("symbols", "capitals", "distinct", "length", "size")
BIN_COUNT = 16
BUCKETS, LABELLED = 4096, 20_000
DIGITS, LEAST = 3, 1e-9
GAP, KEEP = 3e-3, 10


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once for each row: the optimiser copies a plain expression to every place that names it."""
    return df.withColumn("once", F.explode_outer(F.array(value))).withColumn(name, F.col("once")).drop("once")


def tokens(text: Column) -> Column:
    """White-space separated words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _word_scores(words: dict | None) -> list[Column]:
    """The scores of a row with tok: for each domain the mean of its words' log odds."""
    if words is None:
        return []
    n = F.greatest(F.size("tok"), F.lit(1))
    # The table of a domain is one constant; a word costs a hash and a look into it.
    tables = [F.split(F.lit(",".join(f"{x:.5g}" for x in odds)), ",").cast("array<double>") for odds in words["odds"]]
    total = lambda t: F.aggregate("tok", F.lit(0.0), lambda a, w: a + F.get(t, F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))
    return [F.round(total(t) / n, 6) for t in tables]  # sums of equal words are equal in any order


def fit_words(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, label_id_col: str, domain_col: str, sample: int = LABELLED) -> dict | None:
    """Log odds by bucket for each domain (one of two), and the bins of the scores; None with fewer than two domains."""
    own = labelled.select(F.col(label_id_col).alias("id"), F.col(domain_col).cast("string").alias("domain")).where("id is not null and domain is not null").distinct()
    own = saved(own.orderBy(F.xxhash64("id", "domain"), "id", "domain").limit(sample))  # ids and domains of the bounded sample
    domains = sorted(r[0] for r in own.select("domain").distinct().collect())
    if len(domains) < 2:
        return None
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(own), "id").withColumn("half", F.pmod(F.xxhash64("id", F.lit(17)), F.lit(2)).cast("int"))
    rows = saved(rows.select("id", "domain", "half", tokens(F.col("text")).alias("tok")))
    buckets = rows.where("half = 0").select("domain", F.explode(F.array_distinct("tok")).alias("w")).groupBy("domain", F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("b")).count().collect()  # domains * BUCKETS rows at most
    counts = {d: [0.5] * BUCKETS for d in domains}
    for r in buckets:
        counts[r["domain"]][r["b"]] += r["count"]
    chosen = domains[:1] if len(domains) == 2 else domains  # the second of two has the opposite odds
    odds = []
    for d in chosen:
        rest = [sum(counts[o][b] for o in domains if o != d) for b in range(BUCKETS)]
        inside, outside = sum(counts[d]), sum(rest)
        odds.append([math.log(counts[d][b] / inside) - math.log(rest[b] / outside) for b in range(BUCKETS)])
    words = {"domains": domains, "odds": odds}
    cuts = [f"percentile_approx(s{i}, array({', '.join(str(j / BIN_COUNT) + 'D' for j in range(1, BIN_COUNT))}), 1000)" for i in range(len(odds))]
    scored = rows.where("half = 1").select(*(x.alias(f"s{i}") for i, x in enumerate(_word_scores(words))))
    found = scored.selectExpr(*cuts).first()
    return words | {"cuts": [sorted(set(c or [0.0])) for c in found]}


def _binned(df: DataFrame, words: dict | None = None) -> DataFrame:
    """Adds n_tokens and one bin number from 0 to 15 for each feature; df has text and tok."""
    scores = []
    for i, score in enumerate(_word_scores(words)):
        df = _once(df, f"score{i}", score)
        scores.append(sum((F.when(F.col(f"score{i}") > c, 1).otherwise(0) for c in words["cuts"][i]), F.lit(0)))
    n, chars = F.size("tok"), F.greatest(F.char_length("text"), F.lit(1))
    symbols = F.char_length(F.regexp_replace("text", r"[\p{L}\p{N}\s]", "")) / chars
    capitals = (F.char_length("text") - F.char_length(F.translate("text", CAPITALS, ""))) / chars
    share = lambda x, scale: F.least(F.floor(F.sqrt(x) * scale), F.lit(BIN_COUNT - 1)).cast("int")
    return df.select(
        *(c for c in df.columns if c not in ("text", "tok", *(f"score{i}" for i in range(len(scores))))),
        n.cast("long").alias("n_tokens"),
        F.array(
            share(symbols, 30.0),
            share(capitals, 20.0),
            F.least(F.floor(F.size(F.array_distinct("tok")) / F.greatest(n, F.lit(1)) * 16), F.lit(15)).cast("int"),
            F.least(F.floor(chars / F.greatest(n, F.lit(1)) * 1.0), F.lit(15)).cast("int"),
            F.least(F.floor(F.log2(1.0 + n)), F.lit(15)).cast("int"),
            *scores,
        ).alias("bins"),
    )


def document_features(docs: DataFrame, id_col: str, text_col: str, words: dict | None = None) -> DataFrame:
    """(id, n_tokens, bins) of each row, in one pass over the texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _binned(_once(rows, "tok", tokens(F.col("text"))), words)


def fit_domains(features: DataFrame, labelled: DataFrame, id_col: str, domain_col: str) -> dict:
    """Log prior and log likelihood of each (feature, bin) per domain, from counts over all labelled rows; of word scores, over the half that gave no odds."""
    own = labelled.select(F.col(id_col).alias("id"), F.col(domain_col).cast("string").alias("domain")).where("domain is not null").distinct()
    seen = features.select("id", F.posexplode("bins").alias("feature", "bin")).where((F.col("feature") < len(FEATURES)) | (F.pmod(F.xxhash64("id", F.lit(17)), F.lit(2)) == 1))
    counts = seen.join(own, "id").groupBy("domain", "feature", "bin").count().collect()
    domains = sorted({r["domain"] for r in counts})  # the table has at most domains * features * 16 rows
    size = max((r["feature"] for r in counts), default=0) + 1
    table = {d: [[1.0] * BIN_COUNT for _ in range(size)] for d in domains}
    for r in counts:
        table[r["domain"]][r["feature"]][r["bin"]] += r["count"]
    return {"domains": domains, "prior": [sum(table[d][0]) for d in domains], "table": [table[d] for d in domains]}


def _short(p: Column) -> Column:
    """To DIGITS significant digits, so that rows of alike posteriors meet and no domain's small shares are lost."""
    scale = F.pow(F.lit(10.0), DIGITS - 1 - F.floor(F.log10(F.greatest(p, F.lit(LEAST)))))
    return F.when(p < LEAST, 0.0).otherwise(F.round(p * scale) / scale)


def posteriors(features: DataFrame, model: dict) -> DataFrame:
    """Adds post, an array of one posterior per domain, to 3 significant digits (0 below LEAST)."""
    weights = []
    for prior, table in zip(model["prior"], model["table"], strict=True):
        w = F.log(F.lit(float(prior)))
        for i, row in enumerate(table):
            total = float(sum(row))
            w = w + F.get(F.array(*(F.log(F.lit(x / total)) for x in row)), F.get("bins", F.lit(i)))
        weights.append(w)
    scored = _once(features, "score", F.array(*weights)).withColumn("top", F.array_max("score"))
    scored = _once(scored, "score", F.transform("score", lambda s: F.exp(s - F.col("top"))))
    scored = _once(scored, "whole", F.aggregate("score", F.lit(0.0), lambda a, x: a + x))
    return _once(scored, "post", F.transform("score", lambda s: _short(s / F.col("whole")))).drop("score", "top", "whole")


def _with_share(df: DataFrame, have: list[float]) -> DataFrame:
    """Adds share: how a row's step is averaged over its domains, by posterior relative to the domain's tokens."""
    df = _once(df, "share", F.zip_with("post", F.array(*(F.lit(1.0 / h if h > 0 else 0.0) for h in have)), lambda p, u: p * u))
    df = _once(df, "whole", F.aggregate("share", F.lit(0.0), lambda a, x: a + x))
    return _once(df, "share", F.transform("share", lambda x: F.when(F.col("whole") > 0, x / F.col("whole")).otherwise(0.0))).drop("whole")


def _rate(history: list[tuple[list[float], float]], high: float, at: str, r: str = "1.0D", y: str = "1.0D") -> Column:
    """The rate (or the extrapolated point) of a row's share after the steps of history (a relative gap per domain, and momentum), from r and y on."""
    if not history:
        return F.expr(r if at == "r" else y)
    past = ", ".join(f"struct(array({', '.join(f'{x!r}D' for x in g)}) AS g, {b!r}D AS beta)" for g, b in history)
    # r follows y - step, cut at 0 and at the highest rate; y is extrapolated from r.
    return F.expr(f"""aggregate(array({past}), struct({r} AS r, {y} AS y), (s, h) ->
        element_at(transform(array(least(greatest(s.y - aggregate(zip_with(share, h.g, (p, g) -> p * g), 0.0D, (a, x) -> a + x), 0.0D), {high!r}D)), r -> struct(r AS r, r + h.beta * (r - s.r) AS y)), 1)).{at}""")


def fit_rates(groups: DataFrame, have: list[float], targets: list[float], max_rate: float | None = None, steps: int = 60) -> list:
    """The steps (relative gap per domain, momentum) that lead to the rates; `groups` has post, share and tokens, `have` each domain's tokens."""
    k, high, history, t = len(targets), float(max_rate or 1e18), [], 1.0
    before, idle, pending = None, 0, []
    groups = groups.select("tokens", "post", "share", F.lit(1.0).alias("r0"), F.lit(1.0).alias("y0"))
    for _ in range(steps):
        if len(pending) == KEEP:  # a step replays the last few only
            groups = saved(groups.select("tokens", "post", "share", *(_rate(pending, high, c, "r0", "y0").alias(f"{c}0") for c in "ry")))
            pending = []
        at = groups.select("tokens", "post", _rate(pending, high, "y", "r0", "y0").alias("y"))
        sums = at.agg(*(F.sum(F.col("tokens") * F.col("y") * F.get("post", F.lit(i))) for i in range(k))).first()
        gap = [((x or 0.0) - t) / h if h > 0 else 0.0 for x, t, h in zip(sums, targets, have, strict=True)]
        size = max(map(abs, gap))
        if size < GAP:
            return history
        value = sum(g * g for g in gap)
        idle = idle + 1 if before is not None and value > before * (1 - 2e-2) else 0
        if idle == 4:
            break
        before = value
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        history.append((gap, (t - 1) / after))
        pending.append(history[-1])
        t = after
    warnings.warn(f"mixing: a domain stays {size:.2%} of its tokens off its target", stacklevel=2)
    return history


def _fitted(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], domain_col: str, id_col: str, text_col: str, label_id_col: str | None, total_tokens: float | None, max_rate: float | None):
    """Features of all rows, and the model with its domains' tokens and steps; None without labelled rows."""
    words = fit_words(docs, labelled, id_col, text_col, label_id_col or id_col, domain_col)
    features = saved(document_features(docs, id_col, text_col, words))
    model = fit_domains(features, labelled, label_id_col or id_col, domain_col) | {"words": words}
    names = model["domains"]
    if not names:
        return features, None
    scored = posteriors(features, model)
    groups = saved(scored.groupBy("post").agg(F.sum("n_tokens").cast("double").alias("tokens")))  # far fewer rows than documents: posteriors are rounded
    have = [float(x or 0.0) for x in groups.agg(*(F.sum(F.col("tokens") * F.get("post", F.lit(i))) for i in range(len(names)))).first()]
    wanted = {d: float(w) for d, w in weights.items() if w > 0}
    if lost := sorted(d for d in wanted if d not in names or not have[names.index(d)]):
        warnings.warn(f"mixing: domains without labels or tokens are left out: {lost}", stacklevel=3)
        wanted = {d: w for d, w in wanted.items() if d not in lost}
    share = [wanted.get(d, 0.0) / (sum(wanted.values()) or 1.0) for d in names]
    total = total_tokens or min((h / s for h, s in zip(have, share, strict=True) if s > 0), default=sum(have))
    return features, model | {"have": have, "steps": fit_rates(saved(_with_share(groups, have)), have, [s * total for s in share], max_rate) if wanted else [], "high": float(max_rate or 1e18)}


def _rated(features: DataFrame, model: dict, seed: int) -> DataFrame:
    """Adds post, rate and copies."""
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    rated = _once(_with_share(posteriors(features, model), model["have"]), "rate", F.round(_rate(model["steps"], model["high"], "r"), 9)).drop("share")
    return rated.withColumn("copies", F.floor(F.col("rate") + draw).cast("int"))


def mix(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], domain_col: str, id_col: str = "doc_id", text_col: str = "text",
    label_id_col: str | None = None, total_tokens: float | None = None, max_rate: float | None = None, seed: int = 11,
) -> DataFrame:
    """One row per input row: the id, n_tokens, post (map of domain to posterior), rate and copies.

    `weights` gives each domain's share of tokens; domains without one have target 0. A domain without labels or
    without tokens cannot be mixed in: it is left out of the shares, with a warning. By default
    the total is the largest that needs no domain to grow. Null and empty texts have no tokens and
    get features like any text. With no labelled rows, or none that match, every rate is 1. A null
    id draws its own fixed number; rows that share an id draw the same. Repeated label rows count once.
    """
    prepare(docs.sparkSession)
    features, model = _fitted(docs, labelled, weights, domain_col, id_col, text_col, label_id_col, total_tokens, max_rate)
    if model is None:
        return features.select(F.col("id").alias(id_col), "n_tokens", F.create_map().cast("map<string,double>").alias("post"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    post = F.map_from_arrays(F.array(*(F.lit(d) for d in model["domains"])), F.col("post"))
    return _rated(features, model, seed).select(F.col("id").alias(id_col), "n_tokens", post.alias("post"), "rate", "copies")


def resampled(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], domain_col: str, id_col: str = "doc_id", text_col: str = "text",
    label_id_col: str | None = None, total_tokens: float | None = None, max_rate: float | None = None, seed: int = 11,
) -> DataFrame:
    """The rows of docs, all columns as they are, each as often as mix() says. Each row is judged by its own text; its features are computed again, no text is shuffled."""
    prepare(docs.sparkSession)
    _, model = _fitted(docs, labelled, weights, domain_col, id_col, text_col, label_id_col, total_tokens, max_rate)
    if model is None:
        return docs
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    binned = _binned(_once(own, "tok", tokens(F.col("text"))), model["words"])
    rated = _rated(_once(binned, "bins", F.col("bins")), model, seed).where("copies > 0")
    if max_rate is None or max_rate > 1:
        rated = rated.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rated.select(*(F.col(n).alias(c) for c, n in names.items()))


def reference_rates(rows: Iterable[tuple[float, list[float]]], targets: list[float], max_rate: float | None = None, steps: int = 20000) -> list[float]:
    """For tests: plain projected gradient over (tokens, posteriors) rows, in numpy."""
    import numpy as np

    rows = list(rows)
    w, p = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    have = w @ p
    u = p / have
    u /= u.sum(axis=1, keepdims=True)
    r = np.ones(len(rows))
    for _ in range(steps):
        r = np.clip(r - u @ (((r * w) @ p - np.array(targets)) / have), 0, max_rate or np.inf)
    return r.tolist()
