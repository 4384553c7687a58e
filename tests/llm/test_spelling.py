import random
import re
import zlib
from collections import Counter

import pytest
from hitflow.llm import registry, spelling


def plain_words(rows, one_in=199, length=6, least=5):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c in spelling.UPPER else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= length and c >= least}


def plain_variants(n):
    by_gap, near = {}, {w: set() for w in n}
    for w in n:  # every way to blank or leave out one character
        for i in range(len(w)):
            by_gap.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    for w in n:
        for i in range(len(w)):
            near[w] |= by_gap[w[:i], w[i + 1 :]] - {w}
            if (s := w[:i] + w[i + 1 :]) in n and s != w:
                near[w].add(s)
                near[s].add(w)
    out, form = [], {}
    for w, c in n.items():
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * c else None
    for w, c in n.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, c, len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def found(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_query_matches_plain_search(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain_variants(plain_words(rows))
    assert len(want) > 100 and any(r[1] for r in want)
    assert found(registry.op11_spelling(spark, sf)) == want


@pytest.mark.parametrize("hot", [64, 3, 1])
def test_dense_words_are_cut_again(spark, monkeypatch, hot):
    """Short alphabets, so that segments are shared by most words, and many edits of a few words."""
    monkeypatch.setattr(spelling, "HOT", hot)
    monkeypatch.setattr(spelling, "SHARD", 300)
    rng = random.Random(5)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 8))) for _ in range(260)} | {"a", "b", "ab", "é", "aaaaaaaa", "aaaaaaaaa"}
    for w in ("entscheidung", "théâtrale", "a" * 40):
        for _ in range(60):
            i = rng.randrange(len(w))
            words.add(rng.choice((w[:i] + rng.choice("xyzß") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("xyzß") + w[i + 1 :])))
        words.add(w)
    n = {w: rng.choice((5, 5, 30, 160, 900, 6000)) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert found(spelling.variants(df)) == plain_variants(n)


def test_texts_of_any_kind(spark):
    rows = [(1, None), (2, ""), (None, "Straßen ×÷abcd " * 9), (3, "Recieve receive RECEIVE received " * 30000), (3, "receive"), (3, "receive"), (4, "receíve İstanbul 世界")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as word", "2 as id")
    for one_in in (199, 1, 2):
        want = plain_words(rows, one_in)
        assert {r.word: r.n for r in spelling.count_words(df, one_in).collect()} == want
        assert found(spelling.variants(spelling.count_words(df, one_in))) == plain_variants(want)
    assert found(spelling.variants(spelling.count_words(df.where("false")))) == []
    none = spark.createDataFrame([(None, 4), ("", 9), ("ab", 5)], "word string, n long")
    assert found(spelling.variants(none)) == [("ab", None, "ab", 5, 0, None)]


def test_within_one():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(n)) for n in (5, rng.choice((5, 6))))
        edits = {a[:i] + c + a[i + 1 :] for i in range(5) for c in "ab"} if len(b) == 5 else {a[:i] + c + a[i:] for i in range(6) for c in "ab"}
        assert spelling.within_one(a, b) == (b in edits and a != b)
