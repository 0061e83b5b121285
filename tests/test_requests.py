"""Requests that wait get the answers a batch gives them."""

import datetime as dt

import pytest
from pyspark.sql import types as T

from tickloom.plans.decision import decisions_as_of
from tickloom.plans.presets import StrategyConfig
from tickloom.streaming.requests import TOLD, RequestStream

ASKED = T.StructType([T.StructField("request_id", T.LongType()), T.StructField("strategy", T.StringType()),
                      T.StructField("to_time", T.TimestampNTZType())])
STRATEGIES = [StrategyConfig(name=n, side="buy", symbol=n.lower(), threshold=0.0, min_votes=0, rules=(),
                             aliases=(f"{n}-",)) for n in ("A", "B")]


def at(hours, minutes=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours, minutes=minutes)


@pytest.fixture
def told(spark):
    def build(rows, batch=0):
        return spark.createDataFrame([(s, at(h), f"s{v}", f"b{v}", f"{s}{h}:{v}", batch) for s, h, v in rows],
                                     TOLD)
    return build


@pytest.fixture
def asked(spark):
    return lambda rows: spark.createDataFrame(rows, ASKED)


def rows(df):
    return sorted(tuple(r) for r in df.select("request_id", "symbol", "bar_time", "action").collect())


BARS = {1: [("A", h, 0) for h in range(30)] + [("B", 2, 0)],
        2: [("A", h, 0) for h in range(30, 130)] + [("B", h, 0) for h in range(3, 50)],
        3: [("B", 120, 0)]}
ASKS = {1: [(1, "A-x", at(5, 20)), (2, "A-x", at(29)), (3, "A-x", at(29, 1)), (4, "B-y", at(40)),
            (5, "nobody", at(1)), (6, "A-x", None), (7, "A-x", at(-3)), (8, "B-y", at(4000))],
        2: [(9, "A-x", at(7)), (10, "B-y", at(119, 59)), (11, None, at(3)), (9, "A-x", at(7))],
        3: [(12, "B-y", at(121)), (13, "A-x", at(60))]}


def test_answers_equal_the_batch(spark, told, asked, tmp_path):
    stream = RequestStream(spark, str(tmp_path / "r"), STRATEGIES, ASKED)
    waits = {1: {3, 4, 8}, 2: {8, 10}, 3: {8, 12}}
    for batch in BARS:
        for _ in range(2):                         # a repeated batch counts once
            stream.add(asked(ASKS[batch]), told(BARS[batch]), batch)
        assert {r["request_id"] for r in stream.pending().collect()} == waits[batch]
    everything = decisions_as_of(asked(sum(ASKS.values(), [])), told(sum(BARS.values(), [])), STRATEGIES)
    want = rows(everything)
    assert rows(stream.read(waiting=True)) == want
    assert rows(stream.read()) == [r for r in want if r[0] not in waits[3]]


def test_a_waiting_request_sees_corrections(spark, told, asked, tmp_path):
    stream = RequestStream(spark, str(tmp_path / "r"), STRATEGIES, ASKED, "2 hours")
    stream.add(asked([(1, "A-", at(5))]), told([("A", h, 0) for h in range(7)]), 0)
    assert rows(stream.read()) == [] and rows(stream.read(waiting=True)) == [(1, "a", at(5), "A5:0")]
    stream.add(asked([]), told([("A", 5, 0)], 0).union(told([("A", 5, 1)], 1)), 1)     # the newest counts
    stream.add(asked([]), told([("A", 7, 0)], 2), 2)
    stream.add(asked([]), told([("A", 5, 2)], 3), 3)                                   # too late
    assert rows(stream.read()) == [(1, "a", at(5), "A5:1")] and stream.pending().isEmpty()


def test_a_writer_that_dies_answers_once(spark, told, asked, tmp_path, monkeypatch):
    stream = RequestStream(spark, str(tmp_path / "r"), STRATEGIES, ASKED)
    stream.add(asked([(1, "A-", at(2)), (2, "A-", at(50))]), told([("A", 1, 0)]), 0)

    def dies(*args):
        raise RuntimeError
    with monkeypatch.context() as patched:
        patched.setattr(stream.waiting, "commit", dies)
        with pytest.raises(RuntimeError):
            stream.add(asked([(3, "A-", at(1))]), told([("A", 3, 0)]), 1)
    later = RequestStream(spark, str(tmp_path / "r"), STRATEGIES, ASKED)
    later.add(asked([(3, "A-", at(1))]), told([("A", 3, 0)]), 1)
    assert rows(later.read()) == [(1, "a", at(1), "A1:0"), (3, "a", at(1), "A1:0")]
    assert [r["request_id"] for r in later.pending().collect()] == [2]


def test_a_batch_rewrites_the_days_it_touches(spark, told, asked, tmp_path):
    stream = RequestStream(spark, str(tmp_path / "r"), STRATEGIES, ASKED)
    stream.add(asked([(1, "A-", at(30)), (2, "B-", at(60)), (3, "B-", at(100))]),
               told([("A", h, 0) for h in range(60)]), 0)
    before = stream.waiting.manifest(0), stream.answers.manifest(0)
    stream.add(asked([(4, "A-", at(400))]), told([("B", 61, 0)]), 1)
    after = stream.waiting.manifest(1), stream.answers.manifest(1)
    assert set(before[0]) - set(after[0]) == {"asked/2024-01-03"}       # answered, nobody waits
    assert after[0]["asked/2024-01-05"] == before[0]["asked/2024-01-05"]
    assert {k for k in after[1] if after[1][k] != before[1].get(k)} == {
        "rows/2024-01-03", "lasts/2024-01-03", "marks/all"}
    assert rows(stream.read()) == [(1, "a", at(30), "A30:0"), (2, "b", None, None)]


def test_empty_streams(spark, told, asked, tmp_path):
    stream = RequestStream(spark, str(tmp_path / "r"), STRATEGIES, ASKED)
    stream.add(asked([]), told([]), 0)
    assert rows(stream.read(waiting=True)) == [] and stream.pending().isEmpty()
    stream.add(asked([(1, "A-", at(1))]), told([]), 1)
    assert rows(stream.read(waiting=True)) == [(1, "a", None, None)]
