"""Vectors of texts kept between runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


class VectorCache:
    """Parquet table of ``(text, v)`` partitioned by data set, column and encoder.

    Entries are keyed by text, so a cache filled from one sample serves any other: only texts it
    does not hold are encoded, and they are appended.
    """

    PARTITION = ["dataset", "column", "encoder"]
    SCHEMA = "text string, v array<double>, dataset string, column string, encoder string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, dataset: str, column: str, encoder: str) -> DataFrame:
        if self.exists():
            rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        else:
            rows = self.spark.createDataFrame([], self.SCHEMA)
        # two writers may have added the same text
        return rows.where((F.col("dataset") == dataset) & (F.col("column") == column)
                          & (F.col("encoder") == encoder)).select("text", "v").dropDuplicates(["text"])

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def missing(self, texts: DataFrame, dataset: str, column: str, encoder: str) -> DataFrame:
        """Distinct texts the cache does not hold."""
        return texts.select("text").where("text is not null").distinct().join(
            self.read(dataset, column, encoder), "text", "left_anti")

    def write(self, vectors: DataFrame, dataset: str, column: str, encoder: str,
              override: bool = False) -> None:
        labelled = vectors.select("text", F.col("v").cast("array<double>").alias("v"),
                                  F.lit(dataset).alias("dataset"), F.lit(column).alias("column"),
                                  F.lit(encoder).alias("encoder"))
        writer = labelled.write.partitionBy(*self.PARTITION)
        if override:
            # replaces this data set, column and encoder only
            writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)
        else:
            writer.mode("append").parquet(self.path)

    def encode(self, df: DataFrame, column: str, dataset: str, encoder: str,
               model: Callable[[DataFrame], DataFrame], use_cache: bool = True,
               override_cache: bool = False, fail_if_not_cached: bool = False) -> DataFrame:
        """Give every row the vector ``v`` of its text; ``model`` maps ``(text)`` to ``(text, v)``.

        Reads, and where texts are missing writes, the cache before it returns.
        """
        texts = df.select(F.col(column).alias("text"))
        if not use_cache:
            vectors = model(texts.where("text is not null").distinct())
        else:
            todo = (texts.where("text is not null").distinct() if override_cache
                    else self.missing(texts, dataset, column, encoder))
            if not override_cache and fail_if_not_cached and not todo.isEmpty():
                raise FileNotFoundError(f"vectors missing for {dataset}/{column}/{encoder}")
            if override_cache or not todo.isEmpty():
                self.write(model(todo), dataset, column, encoder, override_cache)
            vectors = self.read(dataset, column, encoder)
        return df.join(vectors.withColumnRenamed("text", column), column, "left")
