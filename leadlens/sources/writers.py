"""Sinks: merged daily files, audit rows and small exports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.operators.joins import fresh, union_keep_first
from leadlens.operators.windows import keep_first
from leadlens.session import drop_path, materialise, scratch
from leadlens.sources.readers import exists


def merge_append(new: DataFrame, path: str, key: list[str], order: list[Column]) -> None:
    """Write a folder anew with the rows it has and the new ones of other keys; the old row of a key stays.

    The merged rows are written beside the folder first, as a folder cannot be read and overwritten
    at once.
    """
    spark = new.sparkSession
    parts = [spark.read.parquet(path), new] if exists(spark, path) else [new]
    beside = scratch(spark, "merge")
    union_keep_first(parts, key, order).write.parquet(beside)
    spark.read.parquet(beside).write.mode("overwrite").parquet(path)
    drop_path(spark, beside)


def append_new(new: DataFrame, state: str, key: str, order: list[Column]) -> DataFrame:
    """The first row of every key that the state has not; their keys are appended to the state, a folder."""
    spark = new.sparkSession
    first = keep_first(new, [key], order)
    fresh_rows = materialise(fresh(first, spark.read.parquet(state), key) if exists(spark, state) else first, "new")
    fresh_rows.select(key).write.mode("append").parquet(state)
    return fresh_rows


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """Write the tables of one set side by side, each in a folder of its name."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def append_audit(row: DataFrame, path: str) -> None:
    """Append one run's figures; totals are summed where the audit is read."""
    row.write.mode("append").parquet(path)


def export_json(df: DataFrame, path: str, limit: int = 10_000) -> int:
    """A small report as one JSON array on the driver; a table over ``limit`` rows is refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: write a table instead")
    with open(path, "w", encoding="utf-8") as file:
        json.dump([r.asDict(recursive=True) for r in rows], file, ensure_ascii=False, indent=2, default=str)
    return len(rows)


def markdown_report(df: DataFrame, columns: list[str], limit: int = 200) -> str:
    """A numbered Markdown table of at most ``limit`` rows, bars escaped."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|").alias(c) for c in columns]
    lines = ["| # | " + " | ".join(columns) + " |", "|-|" + "-|" * len(columns)]
    lines += [f"| {i} | " + " | ".join(row) + " |" for i, row in enumerate(df.select(*cells).limit(limit).collect(), 1)]
    return "\n".join(lines) + "\n"
