"""File sources and sinks: JSON lines with a fixed schema, JSON documents, manifests, partitioned results."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRODUCT = "url string, title string, price_raw string, price_vnd long, description string, promo string, image string, crawled_at timestamp, content_hash string"


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines by a fixed schema; blank lines are skipped, unreadable ones stand in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def validate(df: DataFrame) -> DataFrame:
    """Products with composed, squeezed texts (words for null become empty), URLs without spaces, and a hash where there is none."""
    from petalstream.functions.text import content_hash, normalize_text

    texts = ("title", "price_raw", "description", "promo", "image")
    out = df.select(*[c for c in df.columns if c not in (*texts, "url")], *[normalize_text(c).alias(c) for c in texts], F.replace(normalize_text("url"), F.lit(" "), F.lit("")).alias("url"))
    own = content_hash("url", "title", "price_raw", "description", "promo", "image")
    return out.withColumn("content_hash", F.coalesce(F.nullif("content_hash", F.lit("")), own)).select(*df.columns)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(url, label) of a manifest: one JSON document with a map `corrupted` of URLs to lists of labels."""
    doc = spark.read.schema("seed int, corrupted map<string,array<string>>").option("multiLine", True).json(path)
    return doc.select(F.explode("corrupted").alias("url", "labels")).select("url", F.explode("labels").alias("label"))


def write_manifest(truth: DataFrame, path: str, seed: int, rates: dict[str, float] | None = None, n_clean: int = 0, n_corrupt: int = 0) -> None:
    """Writes (url, label) as a manifest that `read_manifest` reads: one JSON document with the seed, the rates, both row counts, a summary of the labels
    and the map of URLs to their labels. It is one document, so it is made in one task; a truth too large for that goes to `write_results`."""
    of = truth.where("url is not null and label is not null").distinct()
    labels = of.groupBy("url").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    summary = of.groupBy("label").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("summary"))
    doc = labels.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("url", "labels")))).alias("corrupted")).join(F.broadcast(summary))
    fixed = F.struct(F.lit(seed).alias("seed"), F.create_map(*[x for k, v in (rates or {}).items() for x in (F.lit(k), F.lit(v))]).cast("map<string,double>").alias("rates"),
                     F.lit(n_clean).alias("n_clean_input"), F.lit(n_corrupt).alias("n_corrupt_output"))
    doc.select(fixed.alias("f"), "summary", "corrupted").select("f.*", "summary", "corrupted").coalesce(1).write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of few rows as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """The JSON documents that match a glob, with the file that each comes from; none where nothing matches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    paths = [str(f.getPath()) for f in found or []]
    if not paths:
        return spark.createDataFrame([], f"{schema}, file string")
    return spark.read.schema(schema).option("multiLine", True).json(paths).withColumn("file", F.input_file_name())


def values_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of constants, with `seq` for their order."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{schema}, seq long")


def write_results(df: DataFrame, path: str, *by: str) -> None:
    """Parquet, one folder per value of the partition columns; only those present are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_through(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at the path; made and written first where it isn't there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def column_values(df: DataFrame, c: str) -> DataFrame:
    """The distinct non-empty values of one column; only it is read."""
    return df.select(c).where(F.col(c).isNotNull() & (F.col(c) != "")).distinct()
