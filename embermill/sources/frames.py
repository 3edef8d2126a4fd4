"""Request frames in, answers, counters and spans out, as files that batches and streams read and write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

FRAME = "request_id long, provider string, authorization string, body string"


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Frames from JSON lines, one a line; a line that is none has null fields and is answered as a broken request."""
    return spark.read.schema(FRAME).json(path)


def stream_requests(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The same as a stream of the files that arrive in a folder."""
    return spark.readStream.schema(FRAME).option("maxFilesPerTrigger", files_per_batch).json(path)


def write_answers(answers: DataFrame, path: str) -> None:
    """request_id, status, hits, misses (null for a failure) and body as JSON lines."""
    answers.write.mode("append").json(path)


def stream_judgement(judged: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """request_id and status of a stream of judged frames, as Parquet, each batch once."""
    return judged.select("request_id", "status").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_lines(spark: SparkSession, lines: DataFrame | Sequence[str], path: str) -> None:
    """Counters (a frame with the column value) or spans (a few lines) as a text file."""
    df = lines if isinstance(lines, DataFrame) else spark.createDataFrame([(x,) for x in lines], "value string")
    df.select("value").coalesce(1).write.mode("overwrite").text(path)
