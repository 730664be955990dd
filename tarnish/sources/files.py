"""Readers and sinks."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_csv(spark: SparkSession, path: str | list[str], schema: str, sep: str = ",") -> DataFrame:
    """Header CSV with a declared schema: no inference pass over the data."""
    return (spark.read.option("header", True).option("sep", sep).option("multiLine", False)
            .schema(schema).csv(path))


def decimal_comma(c: str | Column, sentinel: str = "Unknown") -> Column:
    """Number written with a decimal comma; the sentinel and other texts become null."""
    text = F.col(c) if isinstance(c, str) else c
    return F.when(text != sentinel, F.replace(text, F.lit(","), F.lit(".")).try_cast("double"))


def union_csv_files(spark: SparkSession, parts: dict[str, str], sep: str = ",") -> DataFrame:
    """Several result files (path -> schema) as one table; missing columns are null."""
    frames = [scan_csv(spark, path, schema, sep) for path, schema in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sink_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """One CSV folder, written in parallel, a header in every part."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def sink_create_or_append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Create the table, or add rows to it."""
    writer = df.write.mode("append")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


@dataclass(frozen=True)
class Dataset:
    """A named table: where it is, its text column and its target."""

    name: str
    path: str
    target: str
    text: str = "name"
    renames: dict[str, str] = field(default_factory=dict)

    def load(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).withColumnsRenamed(self.renames)

    def features(self, spark: SparkSession) -> DataFrame:
        return self.load(spark).drop(self.target)


class Catalog:
    """Data sets by name."""

    def __init__(self, *datasets: Dataset):
        self.by_name = {d.name: d for d in datasets}

    def resolve(self, name: str) -> Dataset:
        if name not in self.by_name:
            raise KeyError(f"unknown data set {name!r}, known: {sorted(self.by_name)}")
        return self.by_name[name]

    def register_views(self, spark: SparkSession) -> None:
        for d in self.by_name.values():
            d.load(spark).createOrReplaceTempView(d.name)


def load_join_triple(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Left table, right table and known matches of one join benchmark."""
    return tuple(table(spark, folder, name) for name in ("left", "right", "gt"))
