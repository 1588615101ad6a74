"""Reading tables, folders of documents, questions and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.text import setting, strip

PAYLOAD = "speaker string, text string, is_final boolean, timestamp double, spoken_at double, transcribed_at double, _bad string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parsed_payloads(raw: DataFrame) -> DataFrame:
    """Fields of the payloads that are whole JSON objects; others are left out."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    body = strip("payload")
    parsed = raw.where(body.startswith("{")).withColumn("p", F.from_json(body, PAYLOAD, options)).where("p._bad is null")
    return parsed.select("segment_id", "session_id", "p.speaker", "p.text", "p.is_final", "p.timestamp", "p.spoken_at", "p.transcribed_at")


def document_files(spark: SparkSession, root: str, products: list[str], with_category: list[str], pattern: str = "*.pdf") -> DataFrame:
    """Files under ``root/product[/category]/folder`` of the products named, in order, with what their path tells."""
    paths = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path", "length")
    parts = F.split(F.regexp_replace("path", r"^\w+:/*", "/"), "/")
    below = F.slice(parts, F.lit(root.rstrip("/").count("/") + 2), F.size(parts))
    cut = paths.withColumn("below", below).withColumn("product_type", F.get("below", F.lit(0)))
    deep = F.col("product_type").isin(*with_category)
    kept = cut.where(F.col("product_type").isin(*products) & (F.size("below") == F.when(deep, 4).otherwise(3)))
    return kept.select("path", "length", "product_type", F.when(deep, F.get("below", F.lit(1))).otherwise("").alias("category"), F.element_at("below", -2).alias("source_folder"), F.element_at("below", -1).alias("source_file")).orderBy("path")


def questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A bank ``{product: [{id, question}]}`` as rows."""
    bank = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<struct<id:int,question:string>>>").alias("bank"))
    rows = bank.select(F.explode("bank").alias("product_type", "own")).select("product_type", F.inline("own"))
    return rows.orderBy("product_type", "id").limit(limit) if limit else rows


def settings(spark: SparkSession, path: str) -> DataFrame:
    """``KEY=VALUE`` lines as rows."""
    return spark.read.text(path).select(setting("value").alias("s")).where("s is not null").select("s.key", "s.value")


def text_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\n\n")).alias("place", "part")).select("place", strip("part").alias("paragraph")).where("paragraph <> ''")
