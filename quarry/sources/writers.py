"""Sinks: tables as JSON, CSV and folders by page and feature."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv_lines(df: DataFrame, headers: list[str], keep: list[str] = ()) -> DataFrame:
    """(line, and the columns kept): rows as CSV: only cells with quotes, commas or line ends are quoted; nulls are empty. Columns as in ``headers``."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    quoted = lambda c: F.when(cell(c).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(cell(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell(c))
    return df.select(F.concat_ws(",", *[quoted(c) for c in headers]).alias("line"), *keep)


def write_document(df: DataFrame, path: str) -> None:
    """One JSON document, indented, of a small table's rows: a meta file, an index. The rows go through one task."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("row"))
    one = rows.agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("row"), ",\n"), F.lit("\n]")).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, headers: list[str]) -> None:
    """CSV part files, each with a byte order mark and a heading; cells are quoted only where they must be."""
    head = csv_lines(df.sparkSession.createDataFrame([tuple(headers)], ", ".join(f"`{h}` string" for h in headers)), headers).first().line
    told = csv_lines(df, headers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["\ufeff" + head]})
        for b in batches:
            yield b.rename(columns={"line": "value"})

    told.mapInPandas(run, "value string").write.mode("overwrite").text(path)


def write_run(tables: dict[str, DataFrame], path: str) -> None:
    """A run's tables, each in a folder of its name; those with page and feature in one folder for each."""
    for name, df in tables.items():
        if {"page_id", "feature_id"} <= set(df.columns):
            df.repartition("page_id", "feature_id").write.mode("overwrite").partitionBy("page_id", "feature_id").json(f"{path}/{name}")
        else:
            df.write.mode("overwrite").json(f"{path}/{name}")


def register_run(runs: DataFrame, path: str) -> None:
    """Append entries (run_id, output_dir) to the registry; the latest of a run counts when it is read, and the newest file is the latest run."""
    runs.select(F.col("run_id").alias("runId"), F.col("output_dir").alias("outputDir")).write.mode("append").json(path)


def report_text(tokens: DataFrame) -> DataFrame:
    """(section, text): tokens (section, feature_id, ord, text) of a section's features as paragraphs, empty ones left out."""
    paragraphs = tokens.groupBy("section", "feature_id").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(ord, text))), x -> x.text)"), "").alias("p")).where("trim(p) <> ''")
    return paragraphs.groupBy("section").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(feature_id, p))), x -> x.p)"), "\n\n").alias("text"))
