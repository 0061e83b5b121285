"""Field extraction and the response log."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.operators import responses as T
from tickloom.sources import logs as L
from tickloom.streaming import logs as SL

NOW = dt.datetime(2024, 3, 1, 4, 30)


@pytest.fixture
def one(spark):
    def run(text, column):
        return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]
    return run


@pytest.mark.parametrize("text,want", [
    ("a FINAL DECISION: CONFIRM b", "CONFIRM"), ("FINAL DECISION: REJECT. FINAL DECISION: CONFIRM", "REJECT"),
    ("FINAL DECISION: [CONFIRM]", "UNKNOWN"), ("FINAL DECISION: **CONFIRM**", "UNKNOWN"),
    ("final decision: CONFIRM", "UNKNOWN"), ("Error: 500, x", "UNKNOWN"), ("", "UNKNOWN")])
def test_decision(one, text, want):
    assert one(text, T.extract_decision) == want


@pytest.mark.parametrize("text,want", [
    ("Justification: a\nb \n\nc", "a\nb"), ("Justification:\tend", "end"),
    ("Justification: x\n", "x"), ("Justification:", ""), ("nothing", T.NO_JUSTIFICATION)])
def test_justification(one, text, want):
    assert one(text, T.extract_justification) == want


def test_execution(one):
    got = one("entry: [1.0850-1.0860]\nENTRY : 1.1\nStop Loss:[1.08]\n", T.execution_fields)
    assert (got["Entry"], got["Stop_Loss"], got["Take_Profit"]) == ("1.1", "1.08", None)
    got = one("Entry: [1.0850-1.0860]", T.execution_fields)
    assert got["Entry"] == "1.0850-1.0860"
    got = one("*Entry*: [1.1] Entry: [2] *take profit*: [3]",
              lambda t: T.execution_fields(t, strict=True))
    assert (got["entry"], got["stop_loss"], got["take_profit"]) == ("1.1", None, "3")


def test_json(one):
    read = lambda t: T.extract_json(t, "a int, b string")
    assert tuple(one('x {"a": 1,\n "b": "{z}"} y', read)) == (1, "{z}")
    assert one("{broken: }", read) is None and one("none", read) is None


def test_split(one):
    assert one("x FINAL DECISION: \n yes \nFINAL DECISION: no", T.split_decision) == "yes"
    assert one("x", T.split_decision) == "invalid"


def test_review_rows_and_quarantine(spark):
    rows = [(1, NOW, "FINAL DECISION: CONFIRM\nEntry: 1.1-1.2 Stop Loss: 1 Take Profit: 2"),
            (2, NOW, "FINAL DECISION: REJECT\nEntry: 1.1"), (3, NOW, "Entry: 1 Stop Loss: 1 Take Profit: 2")]
    parsed = T.parse_responses(spark.createDataFrame(
        rows, "id int, ts timestamp_ntz, response string")).withColumns(
        {"currency_pair": F.lit("EUR/USD"), "model_suggestion": F.lit("buy")})
    good, bad = T.executions(parsed)
    assert [r["id"] for r in good.collect()] == [1] and [r["id"] for r in bad.collect()] == [2]
    bounds = T.price_bounds(good).first()
    assert (bounds["entry_low"], bounds["entry_high"], bounds["numeric"]) == (1.1, 1.2, True)
    review = T.review_table(parsed).collect()
    assert review[1]["stop_loss"] == "" and review[0]["timestamp_local"] == "2024-02-29 23:30:00"
    assert review[0]["timestamp_market"] == "2024-03-01 09:30:00"


BODY = ("**FINAL DECISION: CONFIRM** ok\nTrade Execution:\n- Entry: [1.1-1.2]\n"
        "- Stop Loss: [1.0]\n- Take Profit: [1.3]\n")


def test_log_roundtrip(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(NOW, BODY), (NOW + dt.timedelta(hours=1), "no fields"), (NOW, BODY.replace("[1.3]", "1.3"))]
    L.append_log(spark.createDataFrame(rows, "ts timestamp_ntz, response string"), path)
    parsed = L.parse_log(spark, path).collect()
    assert [tuple(r) for r in parsed] == [(NOW, "CONFIRM", "1.1-1.2", "1.0", "1.3")]
    assert L.log_latest(spark, path).first()["latest"] == NOW + dt.timedelta(hours=1)
    L.write_parsed(L.parse_log(spark, path), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_bad_stamp_is_null_not_an_error(spark):
    df = spark.createDataFrame([("Timestamp: 2024-13-41 00:00:00\n" + BODY,)], "record string")
    assert L.parse_records(df).first()["timestamp"] is None


def test_log_tail_sees_only_new_records(spark, tmp_path):
    path, out, check = (str(tmp_path / x) for x in ("log", "out", "check"))
    for hour in range(2):
        L.append_log(spark.createDataFrame(
            [(NOW + dt.timedelta(hours=hour), BODY)], "ts timestamp_ntz, response string"), path)
        SL.tail_log(spark, path, out, check).awaitTermination()
        assert spark.read.parquet(out).count() == hour + 1
