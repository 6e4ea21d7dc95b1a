"""Nested JSON to dotted string maps and back."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def to_dots(value, path: str = "") -> dict[str, str]:
    """One nested value as a dotted map: nulls, blanks and malformed JSON texts are left out."""
    out: dict[str, str] = {}
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else [("", value)]
    for key, item in items:
        name = f"{path}.{key}" if path and key != "" else f"{key}" if key != "" else path
        if isinstance(item, str) and item.strip()[:1] in ("{", "["):
            try:
                item = json.loads(item)
            except ValueError:
                continue
        if isinstance(item, (dict, list)):
            out |= to_dots(item, name)
        elif item is not None and (text := (str(item).lower() if isinstance(item, bool) else f"{item}").strip()):
            out[name] = text.encode("utf-16", "surrogatepass").decode("utf-16", "ignore")
    return out


def flatten_json(rows: DataFrame, column: str, out: str = "properties") -> DataFrame:
    """Adds a dotted map made of a JSON text column, in Arrow batches."""
    schema = rows.select("*", F.create_map().cast("map<string,string>").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for text in batch.column(column).to_pylist():
                try:
                    maps.append(list(to_dots(json.loads(text)).items()) if text else [])
                except ValueError:
                    maps.append([])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maps, pa.map_(pa.string(), pa.string()))], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, schema)


def strip_empty(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))


def merge_maps(old: Column, new: Column) -> Column:
    """Keys of both; new values win unless they are empty."""
    return F.map_zip_with(old, strip_empty(new), lambda k, a, b: F.coalesce(b, a))


def render(template: Column, values: dict[str, Column]) -> Column:
    """A template with {{name}} replaced."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def dots_of(texts: pd.Series) -> pd.Series:
    """JSON texts as dotted maps, in Arrow batches; none for malformed ones."""
    return texts.map(_dots_or_none)


def _dots_or_none(text: str | None) -> dict[str, str]:
    try:
        return to_dots(json.loads(text)) if text else {}
    except ValueError:
        return {}


def register_functions(spark: SparkSession) -> None:
    """SQL functions week_start(t), strip_empty(m), to_dots(json) and window_funnel(pairs, steps, window_ms).

    ``pairs`` is an array of (ts, step) with steps from 1; a null window has no limit.
    """
    spark.udf.register("to_dots", F.pandas_udf(dots_of, "map<string,string>"))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION week_start(t TIMESTAMP) RETURNS TIMESTAMP RETURN date_trunc('week', t)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION strip_empty(m MAP<STRING, STRING>) RETURNS MAP<STRING, STRING> RETURN map_filter(m, (k, v) -> v IS NOT NULL AND v <> '')")
    # held: for each step the latest start of a chain that reached it, and when; events of one time go by falling step
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION window_funnel(pairs ARRAY<STRUCT<ts: BIGINT, step: INT>>, steps INT, window_ms BIGINT) RETURNS INT RETURN
        size(filter(aggregate(
          array_sort(transform(pairs, p -> struct(p.ts AS ts, -p.step AS back))),
          transform(sequence(1, steps), i -> CAST(NULL AS STRUCT<first: BIGINT, last: BIGINT>)),
          (held, p) -> transform(held, (h, i) -> CASE
            WHEN i <> -p.back - 1 THEN h
            WHEN i = 0 THEN struct(p.ts AS first, p.ts AS last)
            WHEN held[i - 1].last < p.ts AND (window_ms IS NULL OR p.ts - held[i - 1].first <= window_ms) THEN struct(held[i - 1].first AS first, p.ts AS last)
            ELSE h END)), h -> h IS NOT NULL))"""
    )
