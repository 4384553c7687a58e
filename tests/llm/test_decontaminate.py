import random

import duckdb
import pytest

from hitflow.llm import decontaminate, registry
from hitflow.llm.decontaminate import brute_force, contamination


def result(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.items) for r in df.collect()}


def fixture(short):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(30)] + ["é", "ÉÀ", "x1"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([10, 14, 30, *short])))) for i in range(20)]
    items += [(97, None), (98, "..."), (99, items[0][1].upper() + " " + items[1][1])]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 4)):
            piece = rng.choice(items)[1] if rng.random() < 0.6 else " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 20)))
            piece = (piece or "").split()
            a = rng.randint(0, 3)
            words += piece[a:] if rng.random() < 0.5 else piece
        rows.append((i, rng.choice([" ", "--", "\n"]).join(words).capitalize()))
    return rows + [(500, None), (501, ""), (502, "?!"), (503, "w1 " * 500)], items


@pytest.mark.parametrize("short", [(), (1, 3, 7)])
def test_matches_brute_force(spark, short, monkeypatch):
    rows, items = fixture(short)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_force(rows, items)
    assert any(h for _, h, _ in want.values()) and result(contamination(docs, bench)) == want
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert result(contamination(docs, bench)) == want


def test_edges(spark):
    text = "a b c d e f g h i j k"
    docs = spark.createDataFrame([(1, text, 1), (1, text, 2), (None, text, 3), (2, "nothing", 4)], "doc_id long, text string, found int")
    bench = spark.createDataFrame([(5, text), (None, "nothing")], "item_id long, text string")
    got = sorted(map(str, ((r.doc_id, r.n_hit, r.items) for r in contamination(docs, bench).collect())))
    assert got == sorted(map(str, [(1, 11, ["5"]), (1, 11, ["5"]), (None, 11, ["5"]), (2, 1, [])]))
    assert [r.n_hit for r in contamination(docs, bench.where("false")).collect()] == [0] * 4
    assert contamination(docs.where("false"), bench).collect() == []


def test_very_long_texts(spark):
    """A window at the end of a text of 300 000 words, and a text that is one item over and over."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu"
    rows = [(1, "word " * 300_000 + item), (2, (item + " ") * 3000), (3, "x" * 2_000_000)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    got = result(contamination(docs, bench))
    assert got == {1: (300_012, 12, ["7"]), 2: (36_000, 36_000, ["7"]), 3: (1, 0, [])}


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(con.sql(decontaminate.ORACLE).fetchall())
    got = sorted(tuple(r) for r in registry.op10_decontaminate(spark, sf).collect())
    assert got == want and any(r[-1] for r in got)
