"""A growing log file: every record once, records half written wait, replaced files start anew."""

import pytest

from tickloom.sources import growing
from tickloom.sources.growing import GrowingLog
from tickloom.sources.logs import FENCE


def record(n, size=10):
    return f"\n{FENCE}\nrecord {n} {'é' * size}\n{FENCE}\n".encode()


def texts(folder):
    found = b"".join(p.read_bytes() for p in sorted(folder.glob("*.log")))
    return found.decode()


@pytest.mark.parametrize("segment,block", [(64 << 20, 1 << 20), (500, 100), (50, 90)])
def test_each_record_once(spark, tmp_path, monkeypatch, segment, block):
    monkeypatch.setattr(growing, "SEGMENT", segment)
    monkeypatch.setattr(growing, "BLOCK", block)
    log, out = tmp_path / "log", tmp_path / "segments"
    log.mkdir()
    source, tail = log / "service.log", GrowingLog(spark, str(log), str(out))
    assert tail.advance() == 0
    source.write_bytes(b"".join(record(n, 40 * n) for n in range(5)) + record(5)[:95])
    assert tail.advance() >= 1
    assert [n for n in range(7) if f"record {n} " in texts(out)] == [0, 1, 2, 3, 4]
    assert tail.advance() == 0                                   # nothing new ends in a fence
    whole = b"".join(record(n, 40 * n) for n in range(5)) + record(5) + record(6)
    source.write_bytes(whole)
    (log / "other.log").write_bytes(record(9))
    tail.advance()
    assert texts(out).count("record ") == 8
    own = sorted(out.glob("*.log"), key=lambda p: p.name.split("-")[1:])
    assert sum(len(p.read_bytes()) for p in own) == len(whole) + len(record(9))
    source.write_bytes(record(10))                               # replaced by a shorter file
    assert tail.advance() >= 1 and "record 10 " in texts(out)
    assert tail.advance() == 0
