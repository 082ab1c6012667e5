"""Results to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.columns import col, is_nested


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet, CSV with a header, or JSON lines; CSV carries nested cells as JSON."""
    if fmt == "csv":
        cells = [
            (F.to_json(col(f.name)) if is_nested(f.dataType) else col(f.name)).alias(f.name) for f in df.schema.fields
        ]
        # Doubled quotes and untouched white space, as other readers expect.
        plain = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        df.select(*cells).write.options(**plain).csv(path)
    else:
        df.write.format(fmt).save(path)


def enriched(scored: DataFrame, score: str = "prediction_score") -> DataFrame:
    """Scored rows, the highest score first; the sort is range-partitioned."""
    return scored.orderBy(F.desc(score)) if score in scored.columns else scored


def append_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("append").partitionBy("run_id").parquet(path)
