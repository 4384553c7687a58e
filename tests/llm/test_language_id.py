import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hitflow.llm import language_id, registry
from hitflow.llm.language_id import ORDER, fit_languages, held_out, identify, kneser_ney


def prose(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize()


SYLLABLES = {"aa": ["ba", "ke", "lo", "mi"], "bb": ["ab", "ek", "ól", "im"], "cc": ["ша", "ке", "ло"]}


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    return [(i, prose(rng, SYLLABLES[lang], rng.randint(3, 60)), lang) for i in range(n) for lang in [rng.choice(list(SYLLABLES))]]


def plain_kneser_ney(texts):
    """Probabilities from a direct recursion over dictionaries."""
    counts = [Counter() for _ in range(ORDER)]
    for t in texts:
        s = " " + "".join(c if c.isalpha() else " " for c in t.lower()).strip() + " "
        for i in range(len(s) - ORDER + 1):
            counts[-1][s[i : i + ORDER]] += 1
    for n in range(ORDER - 1, 0, -1):
        for g in counts[n]:
            counts[n - 1][g[1:]] += 1
    floor = 1 / (len(counts[0]) + 1)
    sums, kinds, discount = defaultdict(float), defaultdict(int), []
    for level in counts:
        ones, twos = sum(v == 1 for v in level.values()), sum(v == 2 for v in level.values())
        discount.append(min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5)
        for g, v in level.items():
            sums[len(g), g[:-1]] += v
            kinds[len(g), g[:-1]] += 1

    def p(gram):
        n = len(gram)
        if n == 0:
            return floor
        s = sums.get((n, gram[:-1]), 0)
        if not s:
            return p(gram[1:])
        d = discount[n - 1]
        return max(counts[n - 1].get(gram, 0) - d, 0) / s + d * kinds[n, gram[:-1]] / s * p(gram[1:])

    return p


def test_probabilities_match_a_direct_recursion():
    rng = random.Random(3)
    texts = [prose(rng, SYLLABLES["aa"], 30) for _ in range(20)]
    points, cut = language_id.characters(pa.array(texts))
    grams = np.array([points[i : i + ORDER].astype(np.int64) for d in range(len(cut) - 1) for i in range(cut[d], cut[d + 1] - ORDER + 1)])
    unique, n = np.unique(grams, axis=0, return_counts=True)
    model = kneser_ney([(unique, n.astype(float))], ["aa"])
    p = plain_kneser_ney(texts)
    for text in ("balo mike", "lolo zzk", "k"):
        s = " " + text + " "
        want = [math.log2(p(s[max(0, i - ORDER + 1) : i + 1])) for i in range(1, len(s))]
        bits, _ = model.entropy(pa.array([text]))
        assert abs(bits[0, 0] + sum(want) / len(want)) < 1e-4, text


def test_held_out_accuracy_and_rejection(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = fit_languages(df, language_id.fold() != 2)
    got = {r.doc_id: r for r in identify(df, model).collect()}
    held = [r for r in df.collect() if held_out(r.doc_id)]
    assert len(held) > 50 and all(got[r.doc_id].lang_pred == r.lang for r in held)
    assert sum(got[r.doc_id].rejected for r in held) <= 0.04 * len(held)
    strange = spark.createDataFrame([(1, "qwrx zvvx jjqx " * 20)], "doc_id long, text string")
    assert identify(strange, model).first().rejected


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "123 ,. %"), (None, "Balo."), (4, "x"), (4, "balo " * 60000), (5, "中文 \U00020000")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'zz' as id", "text as lang_pred")
    model = fit_languages(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    got = identify(df, model).collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and got[3].lang_pred == "aa" and got[5].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got) and got[6].lang_pred in SYLLABLES
    assert fit_languages(spark.createDataFrame([], "doc_id long, text string, lang string")) is None
    assert {r.lang_pred for r in identify(df, None).collect()} == {"und"}
    assert identify(df.where("false"), model).collect() == []


def test_query(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = registry.op4_language_id(spark, sf).collect()
    assert len(got) == len(docs) and all(r.held_out == held_out(r.doc_id) for r in got)
    held = [r for r in got if r.held_out and docs[r.doc_id].text]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_rejection_keeps_its_rate(spark):
    """Of fresh texts of all lengths, about REJECT are rejected; of strange ones nearly all, down to a few words."""
    df = spark.createDataFrame(corpus(3000, 2), "doc_id long, text string, lang string")
    model = fit_languages(df)
    fresh = spark.createDataFrame(corpus(3000, 7), "doc_id long, text string, lang string")
    rate = identify(fresh, model).where("rejected").count() / 3000
    assert language_id.REJECT / 3 <= rate <= language_id.REJECT * 2, rate
    rng = random.Random(1)
    strange = spark.createDataFrame([(i, prose(rng, ["qwr", "xzv", "jj", "gf"], rng.randint(6, 40))) for i in range(200)], "doc_id long, text string")
    assert identify(strange, model).where("rejected").count() >= 196
