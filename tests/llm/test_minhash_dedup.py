import random

from hitflow.llm import minhash_dedup, registry
from hitflow.llm.components import connected_components
from hitflow.llm.minhash_dedup import brute_force, near_duplicates


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def family(rng, n, edits):
    base = [f"v{rng.randint(0, 5000)}" for _ in range(120)]
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
        yield " ".join(words)


def fixture(seed=3):
    rng = random.Random(seed)
    texts = [t for _ in range(12) for t in family(rng, rng.randint(2, 12), 8)] + list(family(rng, 150, 7))
    texts += [None, "", "  ", "one", "ONE", "two words", "Two  Words", "a b c", "x " * 5000, "y x " * 10]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_components_match_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(df, shingle=3, percent=85)) == brute_force(rows, 3, 85)
    assert result(near_duplicates(df)) == brute_force(rows, 5, 80)


def test_clusters_above_a_block(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 20)
    rows = fixture(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(df, shingle=3, percent=85)) == brute_force(rows, 3, 85)


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(7, text, 1), (7, text, 2), (None, text, 3), (None, None, 4), (9, text + " z", 5)], "doc_id long, text string, rep int")
    got = sorted(map(str, ((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df, shingle=3, percent=85).collect())))
    assert got == sorted(map(str, [(7, 7, True), (7, 7, True), (None, 7, False), (None, None, True), (9, 7, False)]))
    assert near_duplicates(df.where("false")).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (502, 501), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 500: 500, 501: 500, 502: 500}


def test_query_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(registry.op7_minhash_dedup(spark, sf)) == brute_force(rows, 3, 85)


def test_links_in_a_dense_group_are_candidates(spark, monkeypatch):
    """One group shares a key; its links are far apart in the order of each tree."""
    rng = random.Random(5)
    n, size, trees = 600, minhash_dedup.BITS // 8, minhash_dedup.TREES
    rows = []
    for i in range(0, n, 2):
        sig = bytes(rng.randrange(256) for _ in range(size))
        # Each tree's order begins with another bit, so that the two are not neighbours in it.
        other = bytes(x ^ 128 if v % (size // trees) == 0 else x for v, x in enumerate(sig))
        rows += [(i, bytearray(sig), [7] * trees), (i + 1, bytearray(other), [7] * trees)]
    df = spark.createDataFrame(rows, "node long, sig binary, keys array<long>").repartition(5)
    agree = minhash_dedup.least_agreement(85)
    for direct, block in ((2048, 16384), (2048, 100), (50, 100)):
        monkeypatch.setattr(minhash_dedup, "DIRECT", direct)
        monkeypatch.setattr(minhash_dedup, "SIGNATURE_BLOCK", block)
        got = connected_components(minhash_dedup._candidates(df, agree)).groupBy("component").count().collect()
        assert len(got) == n // 2 and all(r["count"] == 2 and r.component % 2 == 0 for r in got), (direct, block)


def template_pages(rng, n, pairs):
    """n texts that share 60 of 90 words in three places, of which the first `pairs` have a near copy each."""
    shared = [[f"t{p}w{i}" for i in range(20)] for p in range(3)]
    rows = []
    for i in range(n):
        words = [w for part in shared for w in [*part, *(f"u{i}x{rng.randint(0, 10**6)}" for _ in range(10))]]
        rows.append((i, " ".join(words)))
        if i < pairs:
            rows.append((10**6 + i, " ".join(words + [f"more{i}", "end"])))
    return rows


def test_a_template_is_no_cluster_and_hides_no_copy(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "DIRECT", 150)
    rows = template_pages(random.Random(2), 1500, 200)
    got = result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85))
    assert {k: v[1] for k, v in got.items()} == {k: k % 10**6 for k, _ in rows}


def test_one_row_of_each_component_stays(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(7, texts[0], "s"), (3, texts[0], "s"), (7, texts[1], "s"), (5, texts[1] + " z", "s"), (None, texts[2], "s"), (None, texts[2], "s"), (9, texts[2] + " z", "s"), (1, None, "s"), (1, None, "s"), (2, "", "s"), (4, "short", "x"), (4, "short", "x"), (None, "alone", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, th string")
    got = sorted(map(tuple, minhash_dedup.without_duplicates(df).collect()), key=str)
    assert got == sorted([rows[1], rows[3], rows[6], rows[7], rows[7], rows[9], rows[10], rows[12]], key=str)
