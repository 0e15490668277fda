"""Incremental ingest: new e-mails are parsed and judged once, however often the stream is started."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailgauge.operators.hidden import detected
from mailgauge.operators.mime import parse_messages


def email_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.eml").load(folder)
    return files.select("path", "content")


def judged(emails: DataFrame) -> DataFrame:
    """Parsed e-mails with fragments; works on batches and streams alike."""
    parsed = emails.withColumn("m", parse_messages("content")).select("path", F.col("m.html").alias("html"), F.col("m.error").alias("parse_error"))
    return detected(parsed)


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, per_trigger: int = 1000) -> StreamingQuery:
    """Append judged e-mails to Parquet until all files there are done; the checkpoint remembers them."""
    return judged(email_stream(spark, folder, per_trigger)).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
