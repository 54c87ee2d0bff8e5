"""Streams of texts: the same operators as on tables, a message at a time, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.candidates import Detector, Options, detect, extract, masked, safe


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def masked_stream(df: DataFrame, placeholder: str = "", options: Options | None = None, text_col: str = "text") -> DataFrame:
    """Messages with their texts replaced by masked ones."""
    out = masked(df, placeholder, options, text_col, "masked__")
    return out.withColumn(text_col, out["masked__"]).drop("masked__", "n_masked")


def findings_stream(df: DataFrame, detector: Detector | None = None, options: Options | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings without raw values, as messages come."""
    return safe(detect(df, detector, options, id_col, text_col))


def candidates_stream(df: DataFrame, options: Options | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return safe(extract(df, options, id_col, text_col))


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to Parquet files; once: all that is there now, then end."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
