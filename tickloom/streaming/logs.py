"""Response-log tail: records parsed as files arrive."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tickloom.sources.growing import GrowingLog
from tickloom.sources.logs import parse_records, stream_log
from tickloom.streaming.bars import to_parquet


def tail_log(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the parsed form of every record in new log files under ``path`` to ``out``."""
    return to_parquet(parse_records(stream_log(spark, path)), out, checkpoint)


def tail_growing_log(spark: SparkSession, path: str, work: str, out: str) -> StreamingQuery:
    """Append the parsed form of every record that the files under ``path``, new or grown, gained
    since the last call to ``out``; each record once. ``work`` holds segments and checkpoint."""
    GrowingLog(spark, path, f"{work}/segments").advance()
    return tail_log(spark, f"{work}/segments", out, f"{work}/checkpoint")
