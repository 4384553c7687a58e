"""Line removal by site-relative frequency, with DataFrame functions only.

Pages are grouped by the host of their url. For each line, the number of the host's pages that
contain it is divided by the host's number of pages; a line above `ratio` is boilerplate of the
site and is dropped from all its pages. Hosts with fewer than `min_pages` pages say nothing about
frequency and keep all lines.

A page sends each distinct line once, as a hash; counts are pre-aggregated before the shuffle, so
a host or line that a third of all pages share sends one row per task. Host totals reach the
line counts over `SALTS` salted keys. Lines to drop come back to pages as sets of hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import prepare, saved

SALTS = 32
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)"
#: What is left open takes the rest of the page, and a tag ends at the next one: each pattern passes over a page once.
DROPPED = r"(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)"
BREAKS = r"(?i)</?(?:p|div|li|ul|ol|br|h[1-6]|article|section|header|footer|nav|aside|main|table|tr|td|th|form|blockquote|pre|title|body|head|html)\b[^<>]*>"


def html_lines(html: Column) -> Column:
    """Text lines of a page: block tags and line feeds end lines, other tags vanish, blanks are dropped."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), DROPPED, "")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), r"<[^<>]*>", "")
    return F.array_remove(F.split(F.regexp_replace(F.regexp_replace(text, r"[ \t\r]+", " "), r" ?\n ?", "\n"), r"\n+"), "")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def _among(x: Column, few: Column) -> Column:
    """Whether x is in a sorted array: by looking through a short one, and by halving a long one."""
    step = lambda s, _: F.struct(
        F.when(F.get(few, F.floor((s["low"] + s["high"]) / 2).cast("int")) < x, F.floor((s["low"] + s["high"]) / 2).cast("int") + 1).otherwise(s["low"]).alias("low"),
        F.when(F.get(few, F.floor((s["low"] + s["high"]) / 2).cast("int")) < x, s["high"]).otherwise(F.floor((s["low"] + s["high"]) / 2).cast("int")).alias("high"),
    )
    halves = F.sequence(F.lit(1), (F.floor(F.log2(F.size(few) + 1)) + 1).cast("int"))
    at = F.aggregate(halves, F.struct(F.lit(0).alias("low"), F.size(few).alias("high")), step)["low"]
    return F.when(F.size(few) <= 32, F.array_contains(few, x)).otherwise(F.coalesce(F.get(few, at) == x, F.lit(False)))


def drop_site_lines(pages: DataFrame, lines: Column, host: Column, id_col: str = "page_id", ratio: float = 0.5, min_pages: int = 3) -> DataFrame:
    """One row per input row: the id, host, n_lines, n_dropped and kept_text (kept lines joined by line feeds).

    A page counts a line once however often it repeats. Null lines count as none; a null host is
    one like others, as is the empty one. Pages without lines count in their host's total. Rows that share an
    id are pages of their own. Other columns are not read.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(lines, F.array().cast("array<string>")).alias("line"))
    rows = saved(rows.withColumn("row_hash", F.xxhash64("id", "host", "line")))  # pages are parsed once
    totals = rows.groupBy("host").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    totals = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = rows.select("host", F.explode_outer(F.array_distinct(F.transform("line", lambda x: F.xxhash64(x)))).alias("hash")).where("hash is not null")
    counted = each.groupBy("host", "hash").agg(F.count("*").alias("n")).withColumn("salt", F.pmod("hash", F.lit(SALTS)).cast("int"))
    frequent = saved(counted.join(totals, ["host", "salt"]).where(F.col("n") > F.col("n_pages") * F.lit(ratio)).select("host", "hash"))
    # At most 1 / ratio frequent lines for each line of a page: the set of a host is as small as a page.
    spread = frequent.groupBy("host").agg(F.array_sort(F.collect_set("hash")).alias("gone")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.withColumn("salt", F.pmod("row_hash", F.lit(SALTS)).cast("int")).join(spread, ["host", "salt"], "left")
    kept = F.when(F.col("gone").isNull(), F.col("line")).otherwise(F.filter("line", lambda x: ~_among(F.xxhash64(x), F.col("gone"))))
    out = out.select("id", "host", F.size("line").cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select(F.col("id").alias(id_col), "host", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))


def digest(result: DataFrame, id_col: str = "page_id") -> DataFrame:
    return result.select(id_col, "host", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def oracle(ratio: float = 0.5, min_pages: int = 3) -> str:
    strip = rf"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{DROPPED}', '', 'g'), '{BREAKS}', chr(10), 'g'), '<[^<>]*>', '', 'g')"
    return rf"""
WITH p AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
    list_filter(string_split_regex(regexp_replace(regexp_replace({strip}, '[ \t\r]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n+'), lambda x: x <> '') AS line FROM pages),
tot AS (SELECT host, count(*) AS n_pages FROM p GROUP BY host),
c AS (SELECT host, x, count(*) AS n FROM (SELECT host, unnest(list_distinct(line)) AS x FROM p) GROUP BY host, x),
gone AS (SELECT c.host, list(x) AS gone FROM c JOIN tot USING (host) WHERE n_pages >= {min_pages} AND n > n_pages * {ratio} GROUP BY c.host),
k AS (SELECT page_id, p.host, line, CASE WHEN gone IS NULL THEN line ELSE list_filter(line, lambda x: NOT list_contains(gone, x)) END AS kept FROM p LEFT JOIN gone ON p.host = gone.host)
SELECT page_id, host, CAST(len(line) AS BIGINT) AS n_lines, CAST(len(line) - len(kept) AS BIGINT) AS n_dropped, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM k
"""
