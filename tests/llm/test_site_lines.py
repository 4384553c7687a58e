import time

import duckdb
from pyspark.sql import functions as F

from hitflow.llm import registry, site_lines


def test_frequent_lines_of_a_host_go(spark):
    rows = [(i, "a", ["menu", f"own {i}", "menu"]) for i in range(8)] + [(9, "a", None), (10, "b", ["menu"]), (11, "b", ["x"]), (12, None, [""]), (12, None, ["q"])]
    df = spark.createDataFrame(rows, "page_id long, h string, l array<string>")
    got = {(r.page_id, r.n_lines, r.n_dropped, r.kept_text) for r in site_lines.drop_site_lines(df, F.col("l"), F.col("h")).collect()}
    assert got == {(i, 3, 2, f"own {i}") for i in range(8)} | {(9, 0, 0, ""), (10, 1, 0, "menu"), (11, 1, 0, "x"), (12, 1, 0, ""), (12, 1, 0, "q")}
    assert site_lines.drop_site_lines(df.where("false"), F.col("l"), F.col("h")).collect() == []


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(con.sql(site_lines.oracle()).fetchall())
    got = sorted(tuple(r) for r in registry.op8_site_lines(spark, sf).collect())
    assert got == want


def test_rows_of_any_kind(spark):
    rows = [(1, "a", ["menu", "x"]), (1, "a", ["menu", "x"]), (1, "a", ["menu", "y"]), (None, "a", ["menu"]), (2, None, None), (3, "", [])]
    df = spark.createDataFrame(rows, "page_id long, h string, l array<string>").selectExpr("*", "1 as id", "'q' as host", "'z' as line", "3 as salt", "4 as gone")
    got = sorted(((r.page_id or 0), r.n_lines, r.n_dropped, r.kept_text) for r in site_lines.drop_site_lines(df, F.col("l"), F.col("h")).collect())
    assert got == [(0, 1, 1, ""), (1, 2, 1, "x"), (1, 2, 1, "x"), (1, 2, 1, "y"), (2, 0, 0, ""), (3, 0, 0, "")]


def test_long_pages_take_linear_time(spark):
    """Markup without an end, equal lines and very many lines that all go: none takes time with the square of the page."""
    for unit in ("<!--", "<script>", "<style ", "<", "<p ", "</", "< "):
        df = spark.createDataFrame([(1, "http://a", unit * (1_000_000 // len(unit)))], "page_id long, url string, html string")
        began = time.time()
        site_lines.drop_site_lines(df, site_lines.html_lines(F.col("html")), site_lines.host_of(F.col("url"))).collect()
        assert time.time() - began < 20, unit
    lines = F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.lit("same"))
    many = F.transform(F.sequence(F.lit(1), F.lit(50_000)), lambda i: F.concat(F.lit("line "), i.cast("string")))
    for column in (lines, many):
        df = spark.range(3).select(F.col("id").alias("page_id"), F.lit("a").alias("h"), F.concat(column, F.array(F.concat(F.lit("own "), F.col("id").cast("string")))).alias("l"))
        began = time.time()
        got = site_lines.drop_site_lines(df, F.col("l"), F.col("h")).collect()
        assert time.time() - began < 20
        assert sorted(r.kept_text for r in got) == ["own 0", "own 1", "own 2"]
