"""Detection on a stream of pages: row-local operators, so append mode and no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.patterns import detect_patterns
from ..plans.detect import detect_regex_mode


def stream_pages(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    """Pages of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path).select("doc_id", F.lit(0).alias("page"), "text")


def stream_matches(pages: DataFrame) -> DataFrame:
    """Rule matches of streamed pages, nested ones included. Stateless."""
    return detect_patterns(pages)


def write_detections(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the full plan's detections of each micro-batch; a batch that is run again replaces its own output."""

    def batch(df: DataFrame, number: int) -> None:
        detect_regex_mode(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()
