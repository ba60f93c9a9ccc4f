"""Sinks: Parquet, CSV or JSON by name, partitioned by columns; graphs and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "error") -> None:
    """The format is the path's extension, Parquet without one. Partitions take the place of one file per frequency or side."""
    kind = next((k for k in ("csv", "json") if path.rstrip("/").endswith(f".{k}")), "parquet")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def write_edges(edges: DataFrame, path: str, mode: str = "error") -> None:
    write_table(edges.select("from", "to", "type"), path, mode=mode)


def summary_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
