"""Files: JSON batches, Parquet and JSONL sinks, table bundles, and the medallion layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_batch(spark: SparkSession, path: str, item_schema: str) -> DataFrame:
    """Items of JSON files that hold an array, an object with `items`, or one object. Compressed files are read by their ending."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    listed = F.from_json("v", f"array<{item_schema}>")
    wrapped = F.from_json("v", f"struct<items:array<{item_schema}>>")["items"]
    single = F.array(F.from_json("v", item_schema))
    items = F.when(F.col("v").startswith("["), listed).when(F.get_json_object("v", "$.items").isNotNull(), wrapped).otherwise(single)
    return text.select(F.explode(items).alias("item")).select("item.*")


#: Folders of a run. Fixed values.
LAYERS = ("bronze", "silver", "gold", "gold/marts", "reports", "insights")


def layout(base: str, run_id: str) -> dict[str, str]:
    return {layer: f"{base.rstrip('/')}/{run_id}/{layer}" for layer in LAYERS}


def write_bundle(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Each table as Parquet below folder; empty ones keep their types."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return sorted(tables)


def write_jsonl(table: DataFrame, path: str, codec: str = "none") -> None:
    table.write.mode("overwrite").option("compression", codec).json(path)


def register(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Parquet tables of a bundle as SQL views."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def manifest(spark: SparkSession, run_id: str, counts: dict[str, int], seconds: dict[str, float], crisis_level: str | None = None) -> DataFrame:
    """One row that says what a run did."""
    return spark.createDataFrame([(run_id, counts, seconds, crisis_level)], "run_id string, counts map<string,bigint>, seconds map<string,double>, crisis_level string")
