"""Other sources and sinks: recognition results, references, palettes, CSV evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = (
    "algorithm string, status string, source string, image struct<width:bigint,height:bigint>, candidates array<struct<code:string,quantity:bigint,source:string,evidenceIds:array<string>>>, "
    "evidence array<struct<id:string,rawText:string,region:array<double>>>, doubts array<struct<reason:string,rawText:string,region:array<double>,evidenceId:string>>, total bigint, titleTotal bigint"
)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Recognition results, one JSON document a line.

    ``image_id`` is what a document says (``imageId``), else its file; ``document`` tells
    documents of one file apart, by their text.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("_file"), "value").filter(F.trim("value") != "")
    read = lines.select("_file", F.sha2("value", 256).alias("document"), F.from_json("value", f"{RESULT}, imageId string", {"mode": "PERMISSIVE"}).alias("_r"))
    return read.select("_r.*", "_file", "document").withColumn("image_id", F.coalesce("imageId", "_file")).drop("imageId", "_file")


def read_references(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Reference counts by code, and ids that stand more than once and are refused."""
    rows = spark.read.schema("id string, status string, expected map<string,bigint>").json(path)
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    good = rows.join(twice, "id", "left_anti")
    return good.select("id", "status", F.explode_outer("expected").alias("code", "qty")), twice


def read_palette(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue as a small dimension: code, grp, r, g, b (S6).  Broadcast by its users: 221 rows."""
    return spark.read.schema("code string, grp string, r int, g int, b int").json(path)


def write_evidence(parts: list[DataFrame], path: str) -> None:
    """CSV with the union of all columns as header."""
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines of restock lists, partitioned by pattern, in the order of their keys."""
    lines.repartitionByRange("pattern_id", "key").sortWithinPartitions("pattern_id", "key").select("line").write.mode("overwrite").text(path)
