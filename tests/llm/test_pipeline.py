"""Each stage of the pipeline, and the whole of it, on planted rows; ids are null or repeated for some."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from hitflow.llm import decontaminate, minhash_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted(seed=6):
    """Rows (doc_id, text), labels (doc_id, quality, toxic), benchmark items, and row numbers by what was planted."""
    rng = random.Random(seed)
    vocab = [f"{rng.choice('bcdfgl')}{rng.choice('aeiou')}{rng.randint(0, 400)}" for _ in range(1500)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, prose(rng.choice([12, 20]))) for i in range(12)]
    rows, labels, kinds = [], [], defaultdict(list)

    def add(key, text, kind, label=None):
        kinds[kind].append(len(rows))
        rows.append((key, text))
        if label:
            labels.append((key, *label))

    for i in range(240):
        add(i, prose(rng.randint(30, 90)), "clean", (1, 0))
    for i in range(300, 360):
        add(i, " ".join(rng.choice(["nasty", "vile"]) if rng.random() < 0.1 else w for w in ("nasty " + prose(50)).split()), "toxic", (1, 1) if i < 340 else None)
    for i in range(400, 440):
        add(i, " ".join(w + "!!!" for w in prose(60).split()), "poor", (0, 0) if i < 430 else None)
    for i in range(500, 520):
        add(i, f"{prose(15)} {items[i % 12][1].upper()} {prose(15)}", "leak")
    for i in range(600, 630):
        words = rows[i - 600][1].split()
        words[rng.randrange(len(words))] = "changed"
        add(i, " ".join([*words, "end"]) if len(words) > 60 else rows[i - 600][1], "copy")
    whole = prose(60)
    add(None, whole, "unnamed")
    add(None, f"{prose(10)} {items[0][1]}", "leak")
    add(None, "nasty vile " + prose(20), "toxic")
    add(5, f"{prose(10)} {items[1][1]}", "leak")  # shares the id of a clean row
    add(900, whole, "copy")
    add(901, prose(50), "clean")
    add(901, prose(50), "clean")
    add(902, None, "empty")
    add(None, "", "empty")
    return rows, labels, items, kinds


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    rows, labels, items, kinds = planted()
    folder = str(tmp_path_factory.mktemp("pipeline"))
    table = [(k, t, "en", "hot" if i % 3 else "cold", len(t or "")) for i, (k, t) in enumerate(rows)]
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, table, kinds, items


def of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_toxic_rows_go_and_others_stay(spark, given):
    folder, table, kinds, _ = given
    out = corpus_pipeline.drop_toxic(spark, spark.createDataFrame(table, SCHEMA), folder)
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    left = of(out)
    assert not any(left[table[i][:2]] for i in kinds["toxic"])
    others = [i for i in range(len(table)) if i not in set(kinds["toxic"])]
    assert sum(left[table[i][:2]] > 0 for i in others) >= 0.99 * len(others)


def test_one_row_of_each_group_stays(spark, given):
    folder, table, kinds, _ = given
    left = of(corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(table, SCHEMA), folder))
    groups, empty = defaultdict(list), []
    for at, (_, c) in minhash_dedup.brute_force([(at, r[1]) for at, r in enumerate(table)]).items():
        (groups[c] if (table[at][1] or "").strip() else empty).append(at)
    assert len(groups) < len(table) - 25
    want = Counter(table[i][:2] for i in empty)
    for group in groups.values():
        least = min((table[i][0] is None, table[i][0] or 0) for i in group)
        mine = [table[i][:2] for i in group if (table[i][0] is None, table[i][0] or 0) == least]
        kept = [r for r in mine if left[r]]
        assert len(kept) == 1 and left[kept[0]] == 1, mine
        want[kept[0]] += 1
    assert left == want


def test_rows_with_benchmark_windows_go(spark, given):
    folder, table, kinds, items = given
    left = of(corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(table, SCHEMA), folder))
    hit = decontaminate.brute_force([(at, r[1]) for at, r in enumerate(table)], items)
    assert left == Counter(r[:2] for at, r in enumerate(table) if not hit[at][1])
    assert all(hit[i][1] for i in kinds["leak"]) and left[5, table[5][1]] == 1


def test_poor_rows_are_thinned(spark, given):
    folder, table, kinds, _ = given
    left = of(corpus_pipeline.mix_quality(spark, spark.createDataFrame(table, SCHEMA), folder))
    assert all(n <= of_table for r, n in left.items() for of_table in [Counter(t[:2] for t in table)[r]])
    assert all(left[table[i][:2]] for i in kinds["clean"]) and sum(left[table[i][:2]] for i in kinds["poor"]) < 0.8 * len(kinds["poor"])


def test_shards_hold_every_row(spark, given):
    folder, table, _, _ = given
    got = corpus_pipeline.shard_documents(spark, spark.createDataFrame(table, SCHEMA), folder).collect()
    assert len(got) == len(table) and all(0 <= r.shard < 40 for r in got)
    assert sum(r["size"] for r in got) == sum(len((r[1] or "").encode()) + 16 for r in table)


def test_the_whole(spark, given):
    folder, table, kinds, _ = given
    got = corpus_pipeline.run(spark, folder).collect()
    ids = Counter(r.doc_id for r in got)
    assert not any(ids[table[i][0]] for kind in ("toxic", "leak") for i in kinds[kind] if table[i][0] not in (None, 5))
    assert not any(ids[k] for k in range(600, 630)) and ids[901] == 2 and ids[5] == 1
    assert sum(ids[i] > 0 for i in range(240)) >= 0.98 * 240
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_an_empty_table_stops_nothing(spark, tmp_path, empty):
    rows, labels, items, _ = planted()
    tables = {"documents": ([(k, t, "en", "s", len(t or "")) for k, t in rows[:60]], SCHEMA), "labels": (labels[:60], "doc_id long, quality int, toxic int"), "benchmark": (items, "item_id long, text string")}
    for name, (data, schema) in tables.items():
        spark.createDataFrame([] if name == empty else data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == (0 if empty == "documents" else 60)
