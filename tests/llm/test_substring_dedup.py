import random

from hitflow.llm import registry
from hitflow.llm.substring_dedup import COVERS, brute_force, cover_for, remove_repeats


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in df.collect()}


def test_covers_have_every_difference():
    for period, members in COVERS.items():
        assert {(a - b) % period for a in members for b in members} == set(range(period))
    assert cover_for(20) == (13, (0, 1, 3, 9))


def test_random_repeats_match_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(15, 60))] for _ in range(8)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages)[rng.randint(0, 9) :] if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        rows.append((i, rng.choice([" ", "\n", "\t ", " \x0b"]).join(words)))
    rows += [(200, None), (201, ""), (202, " \n "), (203, "a " * 300), (204, "é b " * 45), (205, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for groups in (1, 7, 64):
        assert result(remove_repeats(df, groups=groups)) == brute_force(rows)
    assert result(remove_repeats(df, window=5)) == brute_force(rows, 5)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    text = " ".join(f"x{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, 5, "a"), (1, text, 5, "b"), (None, text, 6, "c")], "doc_id long, text string, grp int, bucket string")
    got = sorted((r.doc_id is None, r.n_removed) for r in remove_repeats(df).collect())
    assert got == [(False, 30), (False, 30), (True, 0)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).collect() == []


def test_query_matches_brute_force(spark, sf):
    import hashlib

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {k: (n, r, hashlib.sha256(t.encode()).hexdigest()) for k, (n, r, t) in brute_force((d.doc_id, d.text) for d in docs).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in registry.op1_substring_dedup(spark, sf).collect()}
    assert got == want
