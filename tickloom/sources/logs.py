"""Response log: fenced text records in, typed table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.responses import strip
from tickloom.schema import PARSED_LOG

# The log's fence and record layout.
FENCE = "=" * 80
STAMP = r"(?U)Timestamp:\s*(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
RECORD = (
    r"(?s)" + STAMP + r".*?FINAL DECISION:\s*(.*?)\*\*.*?Trade Execution.*?"
    r"- Entry:\s*\[([\d\.-]+)\].*?- Stop Loss:\s*\[([\d\.]+)\].*?- Take Profit:\s*\[([\d\.]+)\]"
)
MARK = "\u0001"          # between fields on the way; no log line holds it


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; the fence is the line separator, so large logs split across tasks."""
    return spark.read.option("lineSep", FENCE).text(path).withColumnRenamed("value", "record")


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    """The same records as a stream over a folder of log files."""
    return spark.readStream.option("lineSep", FENCE).text(path).withColumnRenamed("value", "record")


def log_text(ts: Column, response: Column) -> Column:
    """A record as the log holds it, without the closing fence the writer's separator adds."""
    return F.concat(F.lit("\n" + FENCE + "\n"), F.lit("Timestamp: "),
                    F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("\n"), response, F.lit("\n"))


def append_log(df: DataFrame, path: str, ts: str = "ts", response: str = "response") -> None:
    """Append responses as fenced records."""
    df.select(log_text(F.col(ts), F.col(response)).alias("value")).write.mode("append").option(
        "lineSep", FENCE + "\n").text(path)


def parse_records(records: DataFrame, column: str = "record") -> DataFrame:
    """Typed rows of the records that match the full layout; others are dropped.

    One replacement writes all fields side by side, the free text last, so the pattern runs once a
    record; the generator keeps the planner from running it again for the filter.
    """
    laid_out = F.regexp_replace(F.col(column), r"(?s)\A.*?" + RECORD + r".*\z",
                                "".join(f"{MARK}${g}" for g in (1, 3, 4, 5, 2)))
    fields = records.select(F.explode(F.array(F.split(laid_out, MARK, 6))).alias("f")).filter(
        (F.size("f") == 6) & (F.col("f")[0] == ""))
    stamp = F.try_to_timestamp(F.col("f")[1], F.lit("yyyy-MM-dd HH:mm:ss"))
    return fields.select(
        stamp.cast("timestamp_ntz").alias("timestamp"), strip(F.col("f")[5]).alias("decision"),
        F.col("f")[2].alias("entry"), F.col("f")[3].alias("stop_loss"),
        F.col("f")[4].alias("take_profit"))


def latest_stamp(records: DataFrame, column: str = "record") -> DataFrame:
    """Newest record time, one row."""
    stamp = F.try_to_timestamp(
        F.regexp_extract(F.col(column), STAMP, 1), F.lit("yyyy-MM-dd HH:mm:ss"))
    return records.agg(F.max(stamp.cast("timestamp_ntz")).alias("latest"))


def parse_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_records(read_log(spark, path))


def log_latest(spark: SparkSession, path: str) -> DataFrame:
    return latest_stamp(read_log(spark, path))


def write_parsed(parsed: DataFrame, path: str) -> None:
    """Typed Parquet sink of the parsed log."""
    parsed.select(*[F.col(f.name).cast(f.dataType) for f in PARSED_LOG.fields]).write.mode(
        "overwrite").parquet(path)
