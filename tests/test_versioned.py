"""Bar store: appends touch their days, readers see whole commits, losers of a race merge again."""

import datetime as dt

import pytest

from tickloom.schema import BAR
from tickloom.sources.barstore import BarStore
from tickloom.sources.versioned import Conflict


def bar(symbol, day, hour, close):
    at = None if day is None else dt.datetime(2024, 1, day, hour)
    return (symbol, at, 1.0, 2.0, 0.5, float(close), 1, 1)


def rows(df):
    return sorted(((r["symbol"], str(r["time"]), r["close"]) for r in df.collect()))


def test_append_rewrites_touched_days_only(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "bars"))
    assert store.read().count() == 0
    assert store.append(spark.createDataFrame([], BAR)) is None
    first = [bar(s, d, h, 10 * d + h) for s in "AB" for d in (1, 2, 3) for h in (0, 5)]
    assert store.append(spark.createDataFrame(first, BAR)) == 0
    before = store.table.manifest(0)
    change = [bar("A", 2, 5, 99), bar("C", 4, 0, 7), bar("N", None, 0, 1)]
    assert store.append(spark.createDataFrame(change, BAR)) == 1
    after = store.table.manifest(1)
    assert {k for k in after if before.get(k) != after[k]} == {
        "bars/2024-01-02", "bars/2024-01-04", "bars/none"}
    want = {(r[0], str(r[1])): r[5] for r in first} | {(r[0], str(r[1])): r[5] for r in change}
    assert rows(store.read()) == sorted((*k, v) for k, v in want.items())
    assert len(rows(store.read(version=0))) == len(first)
    day = store.read(dt.date(2024, 1, 2), dt.date(2024, 1, 3))
    assert len(rows(day)) == 8 and len(day.inputFiles()) == 2     # other days are not scanned


def test_failed_write_and_vacuum(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "bars"))
    store.append(spark.createDataFrame([bar("A", 1, 0, 1), bar("A", 2, 0, 2)], BAR))
    store.append(spark.createDataFrame([bar("A", 1, 0, 66)], BAR), publish=False)   # dies before it
    assert [r[2] for r in rows(store.read())] == [1.0, 2.0]
    assert store.vacuum() == 1 and len(rows(store.read())) == 2
    store.append(spark.createDataFrame([bar("A", 1, 0, 3)], BAR))
    store.replace(spark.createDataFrame([bar("B", 9, 0, 5)], BAR))
    assert rows(store.read()) == [("B", "2024-01-09 00:00:00", 5.0)]
    assert store.vacuum(1) == 2 and len(rows(store.read())) == 1


def test_second_writer_of_a_version_merges_again(spark, tmp_path, monkeypatch):
    one, two = (BarStore(spark, str(tmp_path / "bars")) for _ in range(2))
    one.append(spark.createDataFrame([bar("A", 1, 0, 1)], BAR))
    commit, raced = two.table.commit, []

    def late(*args, **kw):
        if not raced:
            raced.append(one.append(spark.createDataFrame([bar("B", 1, 1, 2)], BAR)))
        return commit(*args, **kw)
    monkeypatch.setattr(two.table, "commit", late)
    assert two.append(spark.createDataFrame([bar("C", 1, 2, 3)], BAR)) == 2
    assert [r[0] for r in rows(one.read())] == ["A", "B", "C"]
    with pytest.raises(Conflict):
        two.table._publish(1, {})
    assert len(rows(one.read(version=1))) == 2
