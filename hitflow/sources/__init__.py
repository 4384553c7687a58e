"""Sources and sinks: files by suffix, checked hit and edge tables, reports, raw files by plug-in."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import require
from ..operators import quality

HITS = T.StructType([T.StructField("x_pix", T.IntegerType()), T.StructField("y_pix", T.IntegerType()), T.StructField("time_ns", T.DoubleType()), T.StructField("tot", T.IntegerType())])
EDGES = T.StructType([T.StructField("time_ns", T.DoubleType())])
SEPARATORS = {".csv": ",", ".tsv": "\t", ".txt": "\t"}


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet, CSV or tab-separated table by its suffix; ValueError for any other, before anything runs."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix not in SEPARATORS:
        raise ValueError(f"no reader for {suffix or 'files without a suffix'}: {path}")
    reader = spark.read.option("header", True).option("sep", SEPARATORS[suffix])
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    # The header says where the columns are; the schema says what they are.
    named = reader.csv(path)
    kinds = {f.name: f.dataType for f in schema}
    return named.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in named.columns))


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared types, and null for NaN, which Spark would order above all numbers."""
    kinds = {f.name: f.dataType for f in schema if f.name in df.columns}
    out = df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, k in kinds.items() if isinstance(k, T.DoubleType)})


def load_hits(spark: SparkSession, path: str, column_map: dict[str, str] | None = None, check: bool = True) -> DataFrame:
    df = read_table(spark, path, HITS).withColumnsRenamed(column_map or {})
    return _checked(_typed(require(df, {"x_pix", "y_pix", "time_ns"}, "hits"), HITS), path, check)


def load_edges(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    return _checked(_typed(require(read_table(spark, path, EDGES), {"time_ns"}, "edges"), EDGES), path, check)


def _checked(df: DataFrame, path: str, check: bool) -> DataFrame:
    """Warns of times out of order (by `arrival` where the table has it, else by place in the files) and of spans that cannot be; never fails."""
    if check:
        rows = df if "arrival" in df.columns else df.withColumn("arrival", F.monotonically_increasing_id())
        for said in quality.warnings(rows, "time_ns", "arrival"):
            warnings.warn(f"{path}: {said}", stacklevel=3)
    return df


def choose_source(spark: SparkSession, raw: Callable | None, hits_path: str | None, edges_path: str | None, synth: Callable, synth_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Raw reader, else files, else generated data."""
    if raw is not None and not synth_only:
        return raw(spark)
    if hits_path and edges_path and not synth_only:
        return load_hits(spark, hits_path), load_edges(spark, edges_path)
    return synth(spark)


class RawHits(DataSource):
    """spark.read.format("rawhits").option("reader", "module:function").load(path): `function(path)` yields
    tuples of (x_pix, y_pix, time_ns, tot), or of the columns that option "schema" declares; each comma-separated path is one partition."""

    @classmethod
    def name(cls) -> str:
        return "rawhits"

    def schema(self) -> T.StructType | str:
        return self.options.get("schema") or HITS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _RawReader(self.options)


@dataclass
class _Part(InputPartition):
    path: str


class _RawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.call = options["path"].split(","), options["reader"]

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.paths]

    def read(self, partition: _Part) -> Iterator[tuple]:
        import importlib

        module, _, function = self.call.partition(":")
        yield from getattr(importlib.import_module(module), function)(partition.path)


def load_raw(spark: SparkSession, paths: list[str], reader: str, column_map: dict[str, str] | None = None, schema: str | None = None) -> DataFrame:
    """Raw files through a reader function; `schema` declares its columns where they are not those of hits, and `column_map` renames them."""
    spark.dataSource.register(RawHits)
    source = spark.read.format("rawhits").option("reader", reader)
    df = (source.option("schema", schema) if schema else source).load(",".join(paths)).withColumnsRenamed(column_map or {})
    return _typed(require(df, {"x_pix", "y_pix", "time_ns"}, "raw hits"), HITS)


def write_stage(df: DataFrame, folder: str, stage: str) -> DataFrame:
    """Each stage has a directory of its own, as Spark cannot overwrite what it reads."""
    df.write.mode("overwrite").parquet(f"{folder}/{stage}.parquet")
    return df.sparkSession.read.parquet(f"{folder}/{stage}.parquet")


def write_report(report: DataFrame, folder: str, name: str) -> None:
    """A report of a few rows as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}.json")


def load_period(spark: SparkSession, folder: str, override: float | None = None) -> float:
    """The override, else the period of the saved edge report; FileNotFoundError without one."""
    if override is not None:
        return float(override)
    try:
        report = spark.read.json(f"{folder}/edge_report.json")
    except AnalysisException as e:
        raise FileNotFoundError(f"no edge report in {folder}") from e
    return float(report.first()["period_ns"])


@dataclass(frozen=True)
class Config:
    """Settings of all stages, with their defaults."""

    seed: int = 42
    period_ns: float | None = None
    missed_edge_threshold: float = 1.5
    dt_ns: float = 2000.0
    max_gap: int = 0
    time_criterion: str = "chain"
    safety_margin_ns: float = 200.0
    cluster_time: str = "t_min"
    peak_means: tuple[float, ...] = (175.0, 250.0)
    peak_stds: tuple[float, ...] = (20.0, 20.0)
    em_iterations: int = 200
    confidence: float = 0.9
    train_fraction: float = 0.70
    val_fraction: float = 0.15
    patch: int = 16
    extra: dict = field(default_factory=dict)


def load_config(text_or_path: str) -> Config:
    """From YAML text or a YAML file: top-level keys are fields of Config, others go to `extra`."""
    import yaml

    text = text_or_path
    if "\n" not in text and text.endswith((".yaml", ".yml")):
        with open(text) as f:
            text = f.read()
    own = yaml.safe_load(text) or {}
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in own.items() if k in Config.__dataclass_fields__}
    return Config(**known, extra={k: v for k, v in own.items() if k not in known})


def to_json(report: DataFrame) -> str:
    return json.dumps([r.asDict(recursive=True) for r in report.collect()], default=str)
