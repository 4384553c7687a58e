import random
import zlib

from hitflow.llm import registry, shards
from hitflow.llm.shards import check_plan, shard


def test_near_equal_whole_groups_and_slots(spark):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randint(0, 400) + str(i), "hot" if rng.random() < 0.4 else f"s{rng.randint(0, 9)}", rng.choice(["en", "de", None])) for i in range(3000)]
    rows += [(5000 + i, "same text " * 20, "hot", "en") for i in range(12)]
    rows += [(6000 + i, "huge group " * 20, "s1", "en") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = shard(df, 10).collect()
    plan = check_plan(got, 10)
    mean = sum(plan["bytes"].values()) / 10
    assert plan["gapless"] and len(got) == len(rows)
    assert all(abs(b - mean) < 0.03 * mean for b in plan["bytes"].values()), plan
    assert len({r["shard"] for r in got if 5000 <= r["doc_id"] < 6000}) == 1
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["size"] == len(t) + 16 and by_id[i]["text_crc32"] == zlib.crc32(t.encode()) for i, t, _, _ in rows)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (1, None, 1), (None, "", 2), (3, "é", 3)], "doc_id long, text string, shard int")
    got = shard(df, 4).collect()
    assert sorted(r["size"] for r in got) == [16, 16, 16, 18] and check_plan(got, 4)["gapless"]
    assert shard(df.where("false"), 4).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = registry.op9_kd_shards(spark, sf).collect()
    plan = check_plan(got, 40)
    assert len(got) == len(docs) and plan["gapless"] and {r["law"] for r in got} == {"bytes"} and {r["shard"] for r in got} == set(range(40))
    mean = sum(plan["bytes"].values()) / 40
    assert all(0.95 * mean < b < 1.05 * mean for b in plan["bytes"].values()), plan
    homes = {}
    for r in got:
        text = docs[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 16 and r["text_crc32"] == zlib.crc32(text.encode()) and r["grown_shard"] is None
        homes.setdefault(text, set()).add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())


def test_a_dimension_is_as_wide_as_its_bytes(spark):
    """Two sources of equal bytes are half of the width apart, whatever their names; a rare one is close to its neighbour."""
    rows = [(i, i, 100, "p" if i % 2 else "q", None if i % 50 else "x") for i in range(1000)]
    units = spark.createDataFrame(rows, "first_id long, text_hash long, bytes long, source string, lang string").selectExpr("*", "bytes as size", "1L as text_crc32", "0 as part")
    got = shards._coordinates(units).selectExpr("max(k_source) - min(k_source) as s", "max(k_lang) - min(k_lang) as l").first()
    whole = 1 << 56
    assert 0.49 * whole < got.s < 0.51 * whole and 0.49 * whole < got.l < 0.51 * whole


def test_very_long_empty_and_tied_texts(spark):
    """A third of all rows null or empty, some texts far above a shard's bytes, and all metadata equal."""
    rows = [(i, None if i % 2 else "", "s", "en") for i in range(1200)] + [(5000 + i, f"t{i:04d} " * 40, "s", "en") for i in range(2400)]
    rows += [(9000 + i, chr(97 + i) * 400_000, "s", "en") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 as size", "'z' as shard", "2 as part", "3 as n")
    got = shard(df, 4).collect()
    plan = check_plan(got, 4)
    assert plan["gapless"] and len(got) == len(rows)
    large = {r["doc_id"]: r["shard"] for r in got if r["doc_id"] >= 9000}
    mean = sum(plan["bytes"].values()) / 4
    assert len(set(large.values())) == 3 and all(abs(b - mean) < 0.03 * mean for b in plan["bytes"].values()), plan
