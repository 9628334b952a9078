"""Sinks: CSV and JSON tables, training samples, and small text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in a fixed order, with a header."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def text_table(df: DataFrame, rows: int = 1000) -> str:
    """A summary as fixed-width text; nulls are N/A, numbers have three decimals. It is meant for the eye: behind ``rows`` rows a line says how many more there are."""
    show = lambda v: "N/A" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [df.columns, *([show(v) for v in row] for row in df.limit(rows).collect())]
    widths = [max(len(line[i]) for line in lines) for i in range(len(df.columns))]
    left = df.count() - rows if len(lines) > rows else 0
    more = [f"and {left} more rows"] if left else []
    return "\n".join(["  ".join(cell.ljust(w) for cell, w in zip(line, widths)).rstrip() for line in lines] + more)


def export_counts(details: DataFrame) -> DataFrame:
    """(row_count, non_empty_sequence_count) of an export."""
    return details.agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("sequence_name").alias("non_empty_sequence_count"))
