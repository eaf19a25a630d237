"""Page dumps in, result files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, title, text) of a page dump (XML, plain or compressed): articles that aren't redirects and hold text."""
    schema = "id string, ns string, title string, redirect struct<_title: string>, revision struct<text: string>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    text = F.col("revision.text")
    rows = pages.where((F.trim("ns") == "0") & F.col("title").isNotNull() & text.isNotNull() & (F.trim(text) != "") & F.col("id").rlike(r"^\s*\d+\s*$"))
    return rows.where("redirect is null").select(F.trim("id").cast("long").alias("page_id"), "title", text.alias("text"))


def append_csv(df: DataFrame, path: str) -> None:
    """Result rows with a header, added to what is there."""
    df.write.mode("append").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Result rows as JSON lines, in place of what is there."""
    df.write.mode("overwrite").json(path)
