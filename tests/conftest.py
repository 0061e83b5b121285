import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_bars(spark):
    """Bars from lists of closes per symbol; other columns derived or given."""
    import datetime as dt

    from tickloom.schema import BAR

    def build(series, flat=False, volume=None, spread=1, skip=()):
        rows = []
        for symbol, closes in series.items():
            previous = closes[0]
            for i, close in enumerate(closes):
                if i in skip:
                    continue
                high, low = (close, close) if flat else (max(close, previous) + 1, min(close, previous) - 1)
                rows.append((symbol, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i),
                             float(close if flat else previous), float(high), float(low), float(close),
                             volume[i] if volume else 10 + i % 7, spread))
                previous = close
        return spark.createDataFrame(rows, BAR)
    return build
