"""Hits, edges and truth derived from the star-schema test tables, in Spark and in DuckDB SQL.

Every line item is a hit and every order gives four pulses. Orders are spread over time by
arithmetic on their keys: four pulses each, one pulse left out after twelve orders, and up to seven
pulses of delay for an order's hits, so that some orders overlap; one order in 23 has a time of its own. Pulses begin 40 periods late, so
the first hits have none before them. All times are multiples of 0.5, so sums of doubles are exact on either engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _hits(div: str, table: str) -> str:
    species = f"(l_orderkey {div} 8) % 10"
    mean = f"CASE WHEN l_orderkey % 23 = 5 THEN (l_orderkey * 7919) % 1785 WHEN {species} < 6 THEN 175 WHEN {species} < 9 THEN 250 ELSE 2100 END"
    pulse = f"(l_orderkey * 4 + l_orderkey {div} 12 + ((l_orderkey * l_orderkey * 31 + l_orderkey) % 1009) % 8)"
    return f"""SELECT CAST((l_orderkey * 37) % 251 + l_partkey % 3 AS INT) AS x_pix, CAST((l_orderkey * 101) % 251 + l_suppkey % 3 AS INT) AS y_pix,
  CAST({pulse} * 1785 + {mean} + (l_orderkey * 7919) % 41 - 20 + (l_linenumber * 7 + l_partkey) % 50 AS DOUBLE) AS time_ns,
  CAST(l_quantity AS INT) * 10 + l_linenumber AS tot, l_orderkey AS given_id, CAST({species} AS INT) AS species
FROM {table}"""


def _edges(div: str, four: str, table: str) -> str:
    return f"""SELECT arrival, CAST((arrival + o_orderkey {div} 12 + 40) * 1785 + ((arrival * 7919) % 1009 % 3 - 1) * 0.5 AS DOUBLE) AS time_ns
FROM (SELECT o_orderkey, o_orderkey * 4 + j AS arrival FROM (SELECT o_orderkey, {four} AS j FROM {table}))"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_hits("div", "{t}"), t=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_edges("div", "explode(array(0, 1, 2, 3))", "{t}"), t=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def truth(hits: DataFrame) -> DataFrame:
    return hits.selectExpr("given_id as cluster_id", "species", "if(species = 9, 1, 0) as wrap_count").distinct()


HITS_SQL = _hits("//", "lineitem")
EDGES_SQL = _edges("//", "unnest([0, 1, 2, 3])", "orders")
